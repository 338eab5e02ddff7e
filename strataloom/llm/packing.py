"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids (plus id 0), longer ones are cut from the end into pieces of
`capacity` so that only their first piece may be shorter, and the pieces are spread over
regions of bounded size by a hash of their row number (repeated rows spread, too). In each region several islands evolve packings.
Crossover injects whole well-filled bins of one parent into the other, removes the bins
that now hold duplicates and best-fits the displaced pieces; mutation empties the least
filled bins. After each round the elite of an island migrates to the next one on the ring
(by a shuffle on region and island). A region stops as soon as it meets its lower bound.

Null and empty texts are one token (id 0). Repeated rows are packed once each. An empty
table gives no rows. Within a region ties are broken by size, id, piece and checksum; which
region a piece falls into follows the partitions of the input. Texts of any length are encoded
whole. Columns other than the id and the text stay behind, whatever their names.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_group, partitions, save_stage, thrifty

CAPACITY = 2048
#: Pieces in a region, and the size of the search: islands, members of a population, generations between migrations, migrations.
REGION, ISLANDS, MEMBERS, GENERATIONS, ROUNDS = 8192, 2, 6, 8, 2

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, encoder: Callable, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document; encoder() gives a worker's object with ids(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder()
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(enc.ids(text.as_py()), 0).astype("<u4")
                at = len(ids) % capacity
                cuts = [0, *range(at or capacity, len(ids) + 1, capacity)]
                out += [(doc, i, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(thrifty(run), PIECES)


class Bins:
    """Bins under construction: rooms are found by a bit set, the smallest that fits first."""

    def __init__(self, capacity: int, fill: list[int] | None = None):
        self.capacity, self.rooms, self.fill, self.at = capacity, 0, [], {}
        for f in fill or ():
            self._put(len(self.fill), f, new=True)

    def _put(self, b: int, fill: int, new: bool = False) -> None:
        if new:
            self.fill.append(fill)
        else:
            self.fill[b] = fill
        room = self.capacity - fill
        self.at.setdefault(room, []).append(b)
        self.rooms |= 1 << room

    def add(self, size: int) -> int:
        """Best fit: the bin that the piece leaves fullest; a new one if none has room."""
        fits = self.rooms >> size
        if not fits:
            self._put(len(self.fill), size, new=True)
            return len(self.fill) - 1
        room = size + (fits & -fits).bit_length() - 1
        held = self.at[room]
        b = held.pop()
        if not held:
            self.rooms &= ~(1 << room)
        self._put(b, self.fill[b] + size)
        return b


def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    bins = Bins(capacity)
    out = np.zeros(len(sizes), np.int32)
    for i, s in zip(order.tolist(), sizes[order].tolist(), strict=True):
        out[i] = bins.add(s)
    return out


def fills(sizes: np.ndarray, bins: np.ndarray) -> np.ndarray:
    return np.bincount(bins, weights=sizes, minlength=int(bins.max(initial=-1)) + 1).astype(np.int64)


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then emptier leftovers (the mean squared fill); larger is better."""
    f = fills(sizes, bins)
    return -len(f), float(np.mean((f / capacity) ** 2)) if len(f) else 0.0


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    return max(int(-(-int(sizes.sum()) // capacity)), int((2 * sizes > capacity).sum()))


def _rebuild(sizes: np.ndarray, kept: np.ndarray, loose: np.ndarray, capacity: int) -> np.ndarray:
    """kept: a bin for each piece or -1; the loose pieces, largest first, go where they fit best."""
    _, packed = np.unique(kept[~loose], return_inverse=True)
    out = np.full(len(sizes), -1, np.int32)
    out[~loose] = packed
    bins = Bins(capacity, fills(sizes[~loose], packed).tolist() if len(packed) else [])
    todo = np.flatnonzero(loose)
    for i in todo[np.argsort(-sizes[todo], kind="stable")].tolist():
        out[i] = bins.add(int(sizes[i]))
    return out


def crossover(sizes: np.ndarray, host: np.ndarray, donor: np.ndarray, capacity: int, rng: random.Random) -> np.ndarray:
    """Well-filled bins of the donor enter the host; host bins that share a piece with them dissolve."""
    f = fills(sizes, donor)
    good = np.flatnonzero(f >= np.median(f)).tolist()
    chosen = np.array(rng.sample(good, max(1, len(good) // 3)))
    inject = np.isin(donor, chosen)
    broken = np.isin(host, np.unique(host[inject]))
    base = int(host.max()) + 1
    kept = np.where(inject, donor + base, host)
    return _rebuild(sizes, kept, broken & ~inject, capacity)


def mutate(sizes: np.ndarray, bins: np.ndarray, capacity: int, rng: random.Random) -> np.ndarray:
    f = fills(sizes, bins)
    worst = np.argsort(f, kind="stable")[: max(1, len(f) // 20)].tolist()
    gone = worst + rng.sample(range(len(f)), min(len(f), len(worst)))
    return _rebuild(sizes, bins, np.isin(bins, gone), capacity)


def evolve(sizes: np.ndarray, elites: list[np.ndarray], capacity: int, seed: int, members: int = MEMBERS, generations: int = GENERATIONS) -> np.ndarray:
    """One island's best packing after some generations; elites are packings that are known already."""
    rng = random.Random(seed)
    least = least_bins(sizes, capacity)
    order = np.argsort(-sizes, kind="stable")
    people = list(elites) or [best_fit(sizes, order, capacity)]
    score = lambda p: fitness(sizes, p, capacity)
    best = max(people, key=score)
    if -score(best)[0] <= least or len(sizes) < 3:
        return best
    while len(people) < members:  # noise on the sizes gives other orders
        noise = np.array([rng.uniform(0.8, 1.2) for _ in range(len(sizes))])
        people.append(best_fit(sizes, np.argsort(-sizes * noise, kind="stable"), capacity))
    for _ in range(generations):
        people.sort(key=score, reverse=True)
        half = people[: max(2, members // 2)]
        young = []
        while len(half) + len(young) < members:
            host, donor = rng.sample(half, 2)
            child = crossover(sizes, host, donor, capacity, rng)
            young.append(mutate(sizes, child, capacity, rng) if rng.random() < 0.5 else child)
        people = half + young
        best = max(people, key=score)
        if -score(best)[0] <= least:
            break
    return best


def _regions(pieces: DataFrame, capacity: int, n_regions: int) -> DataFrame:
    """One row for each region: its pieces in a fixed order, as bytes."""

    def gather(t: pa.Table) -> Iterator[pa.RecordBatch]:
        a = {c: t.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
        null = np.array(t.column("doc_id").is_null().to_numpy(zero_copy_only=False), bool)
        doc = np.where(null, 0, a["doc_id"]).astype(np.int64)
        order = np.lexsort((a["ids_crc32"], a["piece"], doc, null, a["length"]))
        blobs = [null.astype(np.int8)[order], doc[order], a["piece"].astype(np.int64)[order], a["start"].astype(np.int64)[order], a["length"].astype(np.int64)[order], a["ids_crc32"].astype(np.int64)[order]]
        yield pa.RecordBatch.from_arrays([pa.array([t.column("region")[0].as_py()], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in blobs]], ["region", "none", "doc", "piece", "start", "length", "crc"])

    keyed = pieces.withColumn("region", F.pmod(F.xxhash64("row"), F.lit(n_regions)))
    return by_group(keyed, ["region"], [], gather, "region long, none binary, doc binary, piece binary, start binary, length binary, crc binary", min(n_regions, 4 * partitions(pieces.sparkSession)))


def _round(state: DataFrame, capacity: int, number: int) -> DataFrame:
    """Every island evolves once; `known` holds the packings that it starts with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                sizes = np.frombuffer(r["length"], np.int64)
                known = [np.frombuffer(x, np.int32) for x in r["known"] or []]
                best = evolve(sizes, known, capacity, hash((r["region"], r["island"], number)))
                bins, level = fitness(sizes, best, capacity)
                yield pa.RecordBatch.from_pylist([{"region": r["region"], "island": r["island"], "elite": best.astype(np.int32).tobytes(), "bins": -bins, "level": level, "done": -bins <= least_bins(sizes, capacity)}], schema)

    schema = pa.schema([("region", pa.int64()), ("island", pa.int32()), ("elite", pa.binary()), ("bins", pa.int64()), ("level", pa.float64()), ("done", pa.bool_())])
    return state.mapInArrow(thrifty(run), "region long, island int, elite binary, bins long, level double, done boolean")


def pack(pieces: DataFrame, capacity: int = CAPACITY, islands: int = ISLANDS, rounds: int = ROUNDS) -> DataFrame:
    """pieces (PIECES) with sequence_id long and offset long."""
    pieces = save_stage(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")  # fixed, as the table is written once
    n_regions = max(1, -(-pieces.count() // REGION))
    regions = save_stage(_regions(pieces, capacity, n_regions), "regions")
    n = min(max(1, n_regions * islands), 4 * partitions(pieces.sparkSession))
    lengths = regions.select("region", "length")
    start = lengths.select("*", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.lit(None).cast("array<binary>").alias("known"))
    elites = save_stage(_round(start.repartition(n, "region", "island"), capacity, 0), "elites")
    for number in range(1, rounds + 1):
        own = Window.partitionBy("region")
        open_ = elites.withColumn("ended", F.max("done").over(own)).where(~F.col("ended")).select("region", "island", "elite")
        if open_.isEmpty():
            break
        moved = open_.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int")).withColumnRenamed("elite", "guest")
        state = open_.join(moved, ["region", "island"]).join(lengths, "region").select("region", "length", "island", F.array("elite", "guest").alias("known"))
        elites = elites.unionByName(save_stage(_round(state.repartition(n, "region", "island"), capacity, number), "elites"))
    best = elites.groupBy("region").agg(F.min_by("elite", F.struct("bins", -F.col("level"), "island")).alias("elite"))

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                none, doc, piece, at, length, crc = (np.frombuffer(r[c], np.int8 if c == "none" else np.int64) for c in ("none", "doc", "piece", "start", "length", "crc"))
                bins = np.frombuffer(r["elite"], np.int32)
                order = np.argsort(bins, kind="stable")
                run = np.cumsum(length[order]) - length[order]
                first = np.append(True, np.diff(bins[order]) != 0)
                offset = np.zeros(len(bins), np.int64)
                offset[order] = run - np.maximum.accumulate(np.where(first, run, 0))
                cols = [pa.array(doc, mask=none.astype(bool)), pa.array(piece.astype(np.int32)), pa.array(at), pa.array(length), pa.array(crc), pa.array((r["region"] << 24) + bins.astype(np.int64)), pa.array(offset)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return regions.join(best, "region").mapInArrow(thrifty(unfold), f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, encoder: Callable, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(token_pieces(docs, encoder, capacity), capacity)
