"""Priorities, overheads and the greedy token budget."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import tokens
from .graph import settle

#: Candidates that one greedy pass takes at most.
CHUNK = 100_000


def boost(files: DataFrame, edges: DataFrame, share: float = 0.2, cap: float = 5.0) -> DataFrame:
    """files (path, priority) where each import of a file adds a share of the importer's priority; only boosted rows are capped."""
    gain = edges.join(files.select(F.col("path").alias("src"), F.col("priority").alias("p")), "src").groupBy(F.col("dst").alias("path")).agg(F.sum(F.col("p") * share).alias("gain"))
    out = files.join(gain, "path", "left")
    lifted = F.when(F.col("gain") > 0, F.least(F.col("priority") + F.col("gain"), F.lit(cap))).otherwise(F.col("priority"))
    return out.withColumn("priority", lifted).select(*files.columns)


def structure_overhead(files: DataFrame, header: str = "# Code Context: .\n\n") -> DataFrame:
    """One row: tokens of header, statistics, tree allowance and table of contents over all candidates."""
    toc = tokens(F.concat(F.lit("- ["), F.col("relative_path"), F.lit("](#"), F.lower(F.translate("relative_path", "/\\. ", "----")), F.lit(")\n")))
    head = tokens(F.lit(header)) + tokens(F.lit("## Statistics\n\n"))
    return files.agg((F.first(head) + 200 + 20 * F.count("*") + F.coalesce(F.sum(toc), F.lit(0))).cast("bigint").alias("overhead"))


def _take(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = budget
        for b in batches:
            kept = []
            for n, copies in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                fits = copies if n <= 0 else min(copies, max(0, left) // n)
                left -= n * fits
                kept.append(fits)
            got = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], got], ["p", "t", "s", "kept"]).filter(pc.greater(got, 0))

    return run


def greedy_budget(df: DataFrame, budget: int, size: str = "tokens", priority: str = "priority", tie: str = "path", chunk: int = CHUNK) -> DataFrame:
    """The rows that fit in turn, by falling priority and rising tie; one that does not fit is skipped and later ones may.

    The order makes the choice sequential, so a pass handles the next `chunk` candidates that
    still fit by size: a distributed top-k, then one streaming task. Passes go on until nothing
    left could fit, which is soon as every pass uses up budget or candidates. Passes see priority,
    tie and size only, each combination once with its number of rows; the rows come back by a join.
    Nulls come last in priority and tie; rows without a size are never taken. Of rows that agree in
    all three, as many are taken as fit.
    """
    slim = df.select(F.col(priority).alias("p"), F.col(tie).alias("t"), F.col(size).cast("long").alias("s")).where("s is not null")
    rest, left, taken = settle(slim.groupBy("p", "t", "s").agg(F.count("*").alias("n"))), budget, None
    order = F.struct(F.col("p").isNull(), -F.col("p"), F.col("t").isNull(), F.col("t"), F.col("s"))
    kinds = dict(rest.dtypes)
    while True:
        rest = rest.where(F.col("s") <= left)
        part = settle(rest.orderBy(order).limit(chunk))
        got = settle(part.coalesce(1).sortWithinPartitions(order).mapInArrow(_take(left), f"p {kinds['p']}, t {kinds['t']}, s long, kept long"))
        taken = got if taken is None else taken.union(got)
        edge = part.agg(F.count("*").alias("n"), F.max(order).alias("last"))
        if edge.first()["n"] < chunk:
            break
        left -= got.agg(F.coalesce(F.sum(F.col("s") * F.col("kept")), F.lit(0))).first()[0]
        rest = rest.crossJoin(F.broadcast(edge.select("last"))).where(order > F.col("last")).drop("last")  # one row
    key = F.col(priority).eqNullSafe(F.col("_p")) & F.col(tie).eqNullSafe(F.col("_t")) & (F.col(size) == F.col("_s"))
    found = df.join(taken.toDF("_p", "_t", "_s", "_kept"), key)
    nth = F.row_number().over(Window.partitionBy("_p", "_t", "_s").orderBy(F.lit(0)))
    return found.withColumn("_nth", nth).where("_nth <= _kept").select(*df.columns)
