"""Exact top-k by inner product over vector-approximation files.

1. Vectors are numbered and written as a table of exact rows. Beside it stands the approximation
   file: a table of blocks, each holding one small cell number for every component of its rows and
   the range that the cells divide (an eighth of the exact bytes).
2. First scan: the cells bound every score from both sides; each query keeps its k best lower
   bounds. The exact vectors of these rows are fetched by a join, and the k-th best of their exact
   scores is a score that the result reaches for certain.
3. Second scan: rows whose upper bound reaches that score are the candidates. What has not been
   read yet is fetched by the same join; all other exact vectors stay unread.

Queries are rows of the same table; blocks of cells meet blocks of queries by their numbers, and
nothing grows beyond a block in a task. Of identical vectors only the k + 1 smallest ids can rank
(one of them may be the query's own row), so only these are kept, which is exact.

A vector that is null, or holds a null or a non-finite component, takes no part; an empty one and
one with a null id neither. Vectors meet only vectors of their own length. Only the query's own
row is no candidate: repeats of it are, and every query row has a list of its own, repeated ids
included. Ties go to smaller ids. An empty table gives no rows; columns other than the id and the
vector do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, by_group, partitions, save_stage, thrifty

#: Rows of a data block and of a query block: a task's memory.
DATA_BLOCK, QUERY_BLOCK = 8192, 1024
#: Queries whose bounds over a block are held at once.
AT_ONCE = 64


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id, v array<long> = floor(scale * x) of the vectors that take part."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & ~bad & F.col(id_col).isNotNull()
    return df.where(ok).select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in chunks]).reshape(sum(map(len, chunks)), -1)


class Cells:
    """The approximation of a block: cell numbers of `bits` bits over each component's own range."""

    def __init__(self, low: np.ndarray, width: np.ndarray, code: np.ndarray):
        self.low, self.width, self.code = low, width, code

    @classmethod
    def of(cls, m: np.ndarray, bits: int = 6) -> Cells:
        low = m.min(axis=0).astype(np.float64)
        span = m.max(axis=0).astype(np.float64) - low
        width = np.maximum(span / (1 << bits), 1.0)
        return cls(low, width, np.minimum((m - low) / width, (1 << bits) - 1).astype(np.uint8 if bits <= 8 else np.uint16))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower bounds of q's scores (query by row) and what to add for the upper ones; a little slack covers rounding."""
        q = q.astype(np.float64)
        step = q * self.width
        base = (q @ self.low)[:, None] + step @ self.code.T.astype(np.float64)
        slack = 1e-9 * (np.abs(q) @ (np.abs(self.low) + self.width * 256)) + 1e-6
        return base + np.minimum(step, 0).sum(axis=1)[:, None] - slack[:, None], np.abs(step).sum(axis=1) + 2 * slack


def scores(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of m with those of q."""
    top = int(np.abs(m).max(initial=0)) * int(np.abs(q).max(initial=0)) * m.shape[1]
    if top < 1 << 62:
        return np.einsum("ij,ij->i", m, q)
    return np.array([sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for r, s in zip(m, q, strict=True)], object)


def approximate(rows: DataFrame, blocks: int, bits: int, parts: int) -> DataFrame:
    """The approximation file of rows (rid, v): a row for each block and vector length."""

    def cells(t: pa.Table) -> Iterator[pa.RecordBatch]:
        m = _matrix(t.column("v"))
        c = Cells.of(m, bits)
        blobs = [t.column("rid").to_numpy(), c.low, c.width, c.code]
        yield pa.RecordBatch.from_arrays([pa.array([t.column("block")[0].as_py()], pa.int32()), pa.array([m.shape[1]], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in blobs]], ["block", "d", "rids", "low", "width", "code"])

    keyed = rows.select(F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int").alias("block"), F.size("v").alias("d"), "rid", "v")
    return by_group(keyed, ["block", "d"], ["rid"], cells, "block int, d int, rids binary, low binary, width binary, code binary", parts)


def query_blocks(asked: DataFrame, blocks: int, parts: int) -> DataFrame:
    """Queries (rid, v, least double: a score that the result reaches for certain) as a row for each block and vector length."""

    def gather(t: pa.Table) -> Iterator[pa.RecordBatch]:
        m = _matrix(t.column("v"))
        blobs = [t.column("rid").to_numpy(), m, t.column("least").to_numpy()]
        yield pa.RecordBatch.from_arrays([pa.array([t.column("qb")[0].as_py()], pa.int32()), pa.array([m.shape[1]], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in blobs]], ["qb", "d", "qids", "q", "least"])

    keyed = asked.select(F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int").alias("qb"), F.size("v").alias("d"), "rid", "v", "least")
    return by_group(keyed, ["qb", "d"], ["rid"], gather, "qb int, d int, qids binary, q binary, least binary", parts)


def scan(approximation: DataFrame, queries: DataFrame, blocks: int, k: int, bits: int, first: bool) -> DataFrame:
    """qid, rid, low: of each block, the rows with a query's k best lower bounds (first), or all whose upper bound reaches its `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                d = r["d"]
                rids, qids = np.frombuffer(r["rids"], np.int64), np.frombuffer(r["qids"], np.int64)
                code = np.frombuffer(r["code"], np.uint8 if bits <= 8 else np.uint16).reshape(-1, d)
                cells = Cells(np.frombuffer(r["low"], np.float64), np.frombuffer(r["width"], np.float64), code)
                q, least = np.frombuffer(r["q"], np.int64).reshape(-1, d), np.frombuffer(r["least"], np.float64)
                for lo in range(0, len(q), AT_ONCE):
                    own = qids[lo : lo + AT_ONCE]
                    low, gap = cells.bounds(q[lo : lo + AT_ONCE])
                    low[own[:, None] == rids] = -np.inf
                    if first:
                        n = min(k, len(rids))
                        at = np.argpartition(-low, n - 1, axis=1)[:, :n]
                        who, at = np.repeat(np.arange(len(own)), n), at.ravel()
                    else:
                        who, at = np.nonzero(low + gap[:, None] >= least[lo : lo + AT_ONCE, None])
                    on = np.isfinite(low[who, at])
                    who, at = who[on], at[on]
                    for p in range(0, len(who), 1 << 16):
                        w, x = who[p : p + (1 << 16)], at[p : p + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.array(own[w]), pa.array(rids[x]), pa.array(low[w, x])], ["qid", "rid", "low"])

    dealt = approximation.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(queries, ["qb", "d"])
    return dealt.select("d", "rids", "low", "width", "code", "qids", "q", "least").mapInArrow(thrifty(run), "qid long, rid long, low double")


def read_exact(wanted: DataFrame, rows: DataFrame, asked: DataFrame) -> DataFrame:
    """qid, query_id, rid, vec_id, score of wanted pairs (qid, rid), from the exact vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column(5).to_numpy()
            for d in np.unique(size).tolist():
                own = b.filter(pa.array(size == d))
                s = scores(_matrix(own.column(4)), _matrix(own.column(2)))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(3), own.column(6), pa.array(s.tolist(), pa.int64())], ["qid", "query_id", "rid", "vec_id", "score"])

    asked = asked.select(F.col("rid").alias("qid"), F.col("id").alias("query_id"), F.col("v").alias("qv"))
    pairs = wanted.select("qid", "rid").join(asked, "qid").join(rows.select("rid", "v", F.size("v").alias("d"), F.col("id").alias("vec_id")), "rid")
    return pairs.select("qid", "query_id", "qv", "rid", "v", "d", "vec_id").mapInArrow(thrifty(run), "qid long, query_id long, rid long, vec_id long, score long")


def best(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each query in the given order, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", bits: int = 6, counts: dict | None = None) -> DataFrame:
    """query_id, rank int, vec_id, score long: the k best candidates of each row whose id is_query marks, by the integer inner product.

    `counts`, if given, receives how many exact vectors were fetched (`read`) and how many pairs there are (`pairs`).
    """
    parts = partitions(vectors.sparkSession)
    with Scratch() as scratch:
        every = integer_vectors(vectors, id_col, vec_col, scale)
        # The table is written once, so the numbers that name its rows from here on are fixed.
        every = scratch.save(every.withColumn("asked", F.coalesce(is_query(F.col("id")), F.lit(False))).withColumn("rid", F.monotonically_increasing_id()), "vectors")
        alike = F.row_number().over(Window.partitionBy("v").orderBy("id", "rid"))
        rows = scratch.save(every.select("rid", "id", "v").withColumn("alike", alike).where(F.col("alike") <= k + 1).drop("alike"), "exact")
        asked = every.where("asked").select("rid", "id", "v")
        n_rows, n_asked = rows.count(), asked.count()
        blocks, q_blocks = max(1, -(-n_rows // DATA_BLOCK)), max(1, -(-n_asked // QUERY_BLOCK))
        cells = scratch.save(approximate(rows, blocks, bits, parts), "cells")
        found = scan(cells, query_blocks(asked.withColumn("least", F.lit(float("-inf"))), q_blocks, parts), q_blocks, k, bits, True)
        near = scratch.save(read_exact(best(found, k, F.desc("low"), F.col("rid")), rows, asked), "near")
        # With fewer than k candidates nothing is certain.
        least = near.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        known = asked.join(least.withColumnRenamed("qid", "rid"), "rid", "left").withColumn("least", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf"))))
        wanted = scan(cells, query_blocks(known, q_blocks, parts), q_blocks, k, bits, False)
        rest = scratch.save(read_exact(wanted.join(near.select("qid", "rid"), ["qid", "rid"], "left_anti"), rows, asked), "rest")
        if counts is not None:
            counts.update(read=near.count() + rest.count(), pairs=n_rows * n_asked)
        out = best(near.union(rest), k, F.desc("score"), F.col("vec_id"), F.col("rid"))
        return save_stage(out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "topk")
