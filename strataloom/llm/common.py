"""Shared pieces: stage tables, checked broadcasts, Arrow streaming helpers and components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

#: A side is broadcast only when its measured size is below this.
BROADCAST_BYTES = 16 << 20

_stages: dict[str, SparkSession] = {}


#: Rows and bytes that pass between Spark and Python at once; long texts make large rows.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
#: Batches after which a worker gives back memory that it does not use.
BREATH = 16


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session: a worker then holds a few MB of texts, however long they are."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where it is unset and everything runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        held = getattr(spark, "_strataloom_dir", None)
        if held is None:
            held = spark._strataloom_dir = tempfile.mkdtemp(prefix="strataloom-")
        named = f"file://{held}"
    return named.rstrip("/")


def stage_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the process ends if not before."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _stages:
        atexit.register(drop_stages)
    _stages[path] = spark
    return path


def save_stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = stage_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._strataloom_path = path
    return out


def drop_stages(paths: list[str] | None = None) -> None:
    """Delete the named stage tables (all of this process by default); lazily built results that read them end here."""
    for path in list(_stages) if paths is None else paths:
        spark = _stages.pop(path, None)
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone: nothing is left to tidy with
            continue


class Scratch:
    """Stage tables of one operator: leaving the block deletes all that were saved through it."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def save(self, df: DataFrame, label: str) -> DataFrame:
        out = save_stage(df, label)
        self.paths.append(out._strataloom_path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        gone = [t._strataloom_path for t in tables]
        drop_stages(gone)
        self.paths = [p for p in self.paths if p not in gone]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        drop_stages(self.paths)


def row_bytes(df: DataFrame) -> Column:
    """What a row takes: fixed parts by type, strings, binaries and arrays of numbers by their own length."""
    fixed, own = 0, F.lit(0)
    for f in df.schema:
        if isinstance(f.dataType, (StringType, BinaryType)):
            own = own + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, ArrayType):
            own = own + 8 * F.greatest(F.coalesce(F.size(f.name), F.lit(0)), F.lit(0))
        elif isinstance(f.dataType, StructType):
            fixed += 8 * len(f.dataType)
        fixed += 16
    return own + F.lit(fixed)


def checked(df: DataFrame) -> DataFrame:
    """df marked for broadcast if the measured bytes of its rows allow it, else as it is (a shuffle join follows)."""
    held = df.agg(F.sum(row_bytes(df)).alias("b")).first()["b"] or 0
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _give_back() -> None:
    """Return free memory to the system: idle workers would keep it otherwise, and an executor has several."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def _keep_little() -> None:
    """Large arrays go back to the system as soon as they are freed, for all of the process."""
    with contextlib.suppress(OSError, AttributeError):
        for key, value in ((-3, 4 << 20), (-1, 8 << 20), (-8, 2)):  # thresholds of mapping and of trimming, number of arenas
            ctypes.CDLL(None).mallopt(key, value)


def thrifty(fn: Callable) -> Callable:
    """fn for mapInArrow, in a worker that gives back memory as it goes and when it is done."""

    def breathing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in enumerate(batches, 1):
            yield b
            if k % BREATH == 0:
                _give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_little()
        try:
            yield from fn(breathing(batches))
        finally:
            _give_back()

    return run


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in a stream that is sorted by them; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        columns = [b.column(b.schema.get_field_index(k)) for k in keys]
        for c in columns:
            v = c.to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        same = last == tuple(c[0].as_py() for c in columns)  # the first run goes on with the batch before
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and not same:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            same = False
        last = tuple(c[n - 1].as_py() for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def by_group(df: DataFrame, keys: list[str], order: list[str], fn: Callable, schema: str, n: int) -> DataFrame:
    """fn(table) -> RecordBatches for each run of equal keys; many groups share one Python call, unlike applyInPandas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, keys):
            yield from fn(table)

    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(thrifty(run), schema)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition, without those that close a circle; each is (larger, smaller)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
    nodes = sorted(root)
    for lo in range(0, len(nodes), 65536):
        part = nodes[lo : lo + 65536]
        pairs = [(x, find(x)) for x in part]
        pairs = [p for p in pairs if p[0] != p[1]]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """Connected components of undirected edges over long ids: rows (node, root), root the smallest id of its component.

    Partitions first shrink to forests; large-star and small-star rounds then run until the
    edges are stars. Minima are pre-aggregated and neighbours never gathered, so a hub costs
    no more than its edges. The result reads a stage table, which `scratch` takes over. Self loops, repeated edges and nulls are harmless; nodes without
    edges give no row. Raises after `most` rounds instead of returning a part.
    """
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").mapInArrow(thrifty(_forest), "a long, b long")
    e = save_stage(e.distinct(), "cc")
    seen, old = None, None
    for _ in range(most):
        sign = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if sign == seen:
            if scratch is not None:
                scratch.paths.append(e._strataloom_path)
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
        if old is not None:
            drop_stages([old])
        seen, old = sign, e._strataloom_path
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        e = save_stage(small, "cc")
    raise RuntimeError(f"components: not settled after {most} rounds")


def words(hashes: np.ndarray) -> np.ndarray:
    """A finishing mix for 64-bit values (the splitmix64 steps)."""
    with np.errstate(over="ignore"):
        h = hashes.astype(np.uint64, copy=True)
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        return h
