"""Fact tables of a corpus: one pass over every file, split by kind."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FACTS
from .languages import facts

_SCHEMA = pa.schema([("path", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("module", pa.string()), ("items", pa.list_(pa.string())), ("flag", pa.bool_()), ("line", pa.int32())])


def all_facts(files: DataFrame, path: str = "relative_path", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """FACTS rows of files (path, content), of the named kinds only if any are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *f) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for f in facts(p, c or "") if kinds is None or f[0] in kinds]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array([list(x) for x in c] if f.name == "items" else c, f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)

    return files.select(F.col(path).alias("path"), "content").mapInArrow(run, FACTS)


def cached_facts(files: DataFrame, store: str) -> DataFrame:
    """all_facts through a Parquet store keyed by path and content hash: only files that it lacks are read again.

    A file without facts leaves a row of kind `none`, so that it counts as known.
    """
    spark = files.sparkSession
    keyed = files.select("relative_path", "content", F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash"))
    try:
        known = spark.read.parquet(store)
    except AnalysisException:
        known = None
    fresh = keyed if known is None else keyed.join(known.select(F.col("path").alias("relative_path"), "hash").distinct(), ["relative_path", "hash"], "left_anti")
    rows = all_facts(fresh).join(fresh.select(F.col("relative_path").alias("path"), "hash"), "path", "right")
    rows.withColumn("kind", F.coalesce("kind", F.lit("none"))).write.mode("append").parquet(store)
    names = [f.split()[0] for f in FACTS.split(", ")]
    held = spark.read.parquet(store).join(keyed.select(F.col("relative_path").alias("path"), "hash"), ["path", "hash"], "left_semi")
    return held.where("kind <> 'none'").select(*names)


def split(found: DataFrame) -> dict[str, DataFrame]:
    """imports, calls, defs, type_refs, type_defs."""
    of = lambda k: found.where(F.col("kind") == k)
    return {
        "imports": of("import").select("path", "module", "items", F.col("flag").alias("is_relative"), "line"),
        "calls": of("call").select("path", "name", "module", "line"),
        "defs": of("def").select("path", "name", F.col("flag").alias("is_exported"), "line"),
        "type_refs": of("type_ref").select("path", "name", "module", "line"),
        "type_defs": of("type_def").select("path", "name", F.col("module").alias("kind"), "line"),
    }
