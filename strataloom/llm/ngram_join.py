"""Near-duplicate documents: a similarity join on word n-gram sets by MinHash banding.

1. Every text becomes its set of hashed 5-word runs; equal sets form one class of copies,
   which the rest of the work meets once, whatever its size.
2. Band and row counts are chosen for the target recall at the threshold. Signatures are
   cut into bands and shuffled on the band hashes; a band that several sets share links each
   of them to the smallest (minima are pre-aggregated, no pairs are made).
3. Linked sets form candidate clusters. A cluster is dealt out in blocks of bounded bytes and
   count; each pair of blocks is a task that verifies the pairs sharing a band on the full sets.
   Tasks return counts and a spanning forest of links, never the pairs. (Every pair of a cluster
   has to be counted, so the work is quadratic in a cluster of different texts; copies are one.)
4. Classes are the components of the verified links.

Texts with 1 to 4 words are one run of all their words. Texts without words (null, empty,
punctuation) resemble nothing: each is a class of its own. Words are runs of letters and
digits, lower-cased. Repeated ids are kept as they come (the class id is the smallest doc_id
of the class); a null id counts as a number beyond 2**62 that its text gives. Texts of any length
are read in slices; a run of more than 65536 letters and digits counts as several words. An empty
table gives no rows. Other columns do not matter, whatever their names (see one_of_each).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_group, checked, components, partitions, save_stage, thrifty
from .common import words as mix
from .textkernel import portions, shingle, shingle_set, split_words

N_GRAM, THRESHOLD, RECALL = 5, 0.8, 0.99
#: Sets and n-grams in a block of a cluster, about; postings that are counted at once.
BLOCK, BLOCK_GRAMS, POSTINGS = 2048, 1 << 19, 1 << 18


def choose_bands(threshold: float, recall: float, rows_most: int = 8) -> tuple[int, int]:
    """(bands, rows): the longest rows up to rows_most, and as few bands as reach the recall at the threshold."""
    rows = rows_most
    bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
    return bands, rows


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    s = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (s[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (s[n:] >> np.uint64(32)).astype(np.uint32)


def signature_bands(gram: np.ndarray, a: np.ndarray, b: np.ndarray, bands: int) -> np.ndarray:
    """Band hashes of one set: MinHash by multiply and add in 32 bits, then a mix of each band's rows."""
    x = (gram >> np.uint64(32)).astype(np.uint32) ^ gram.astype(np.uint32)
    low = np.full(len(a), np.uint32(0xFFFFFFFF))
    with np.errstate(over="ignore"):
        for lo in range(0, len(x), 2048):
            y = np.multiply.outer(a, x[lo : lo + 2048])
            y += b[:, None]
            y ^= y >> np.uint32(15)
            low = np.minimum(low, y.min(axis=1))
        m = low.reshape(bands, -1).astype(np.uint64)
        h = np.arange(bands, dtype=np.uint64)
        for j in range(m.shape[1]):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + m[:, j])
    return h.view(np.int64)


def _names(g: np.ndarray) -> tuple[int | None, int | None]:
    """128 bits that name a set of hashes; nulls for the empty one."""
    if not len(g):
        return None, None
    with np.errstate(over="ignore"):
        return int(mix(g).sum(dtype=np.uint64).view(np.int64)), int((mix(g + np.uint64(1)) | np.uint64(1)).prod(dtype=np.uint64).view(np.int64))


def _sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """The sorted 64-bit hashes of each text's n-gram set."""
    for i, _, whole in portions(texts):
        if whole is None:
            yield shingle_set(texts[i], n)
            continue
        w = split_words(whole)
        h, first = shingle(w.hash, w.first, n)
        for s, e in zip(first, first[1:], strict=False):
            yield np.unique(h[s:e])


def document_keys(id_col: str = "doc_id") -> tuple[Column, Column]:
    """The id, or for a null id a number beyond 2**62 that the text gives; and a hash of the text that tells rows of one id apart."""
    own = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 3)
    return F.coalesce(F.col(id_col).cast("long"), own), F.xxhash64("text")


def keyed_texts(docs: DataFrame, id_col: str) -> DataFrame:
    """id, doc, row and text: doc and row name a document as document_keys does."""
    doc, row = document_keys(id_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), doc.alias("doc"), row.alias("row"), "text")


def fingerprints(texts: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """id, doc, row, lo and hi (the name of the n-gram set; null without words), grams (its size), bands array<long>."""
    a, b = _seeds(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            lo, hi, size, sig = [], [], [], []
            for g in _sets(x.column(3).to_pylist(), n):
                name = _names(g)
                lo.append(name[0])
                hi.append(name[1])
                size.append(len(g))
                sig.append(signature_bands(g, a, b, bands) if len(g) else None)
            yield pa.RecordBatch.from_arrays([*x.columns[:3], pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(size, pa.int64()), pa.array(sig, pa.list_(pa.int64()))], ["id", "doc", "row", "lo", "hi", "grams", "bands"])

    return texts.mapInArrow(thrifty(run), "id long, doc long, row long, lo long, hi long, grams long, bands array<long>")


def with_grams(members: DataFrame, n: int) -> DataFrame:
    """members (text, lo, hi and more) whose text has the set that lo and hi name, with grams (bytes) in place of the text."""
    rest = [c for c in members.columns if c not in ("text", "lo", "hi")]
    kinds = dict(members.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            lo, hi = x.column(1).to_pylist(), x.column(2).to_pylist()
            own, sets, held = [], [], 0
            for k, g in enumerate(_sets(x.column(0).to_pylist(), n)):
                if _names(g) == (lo[k], hi[k]):
                    own.append(k)
                    sets.append(g.tobytes())
                    held += len(sets[-1])
                if held > 1 << 22:
                    yield pa.RecordBatch.from_arrays([*[c.take(pa.array(own)) for c in x.columns[1:]], pa.array(sets, pa.binary())], ["lo", "hi", *rest, "grams"])
                    own, sets, held = [], [], 0
            if own:
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(own)) for c in x.columns[1:]], pa.array(sets, pa.binary())], ["lo", "hi", *rest, "grams"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in ("lo", "hi", *rest)) + ", grams binary"
    return members.select("text", "lo", "hi", *rest).mapInArrow(thrifty(run), schema)


class Postings:
    """Which sets of a block hold each n-gram."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        flat = np.concatenate([np.zeros(0, np.uint64), *sets])
        by = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(self.n, dtype=np.int32), [len(s) for s in sets])[by]
        flat = flat[by]
        start = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
        self.grams, self.at = flat[start], np.append(start, len(flat))

    def common(self, own: np.ndarray) -> np.ndarray:
        """How many n-grams of `own` each set of the block holds."""
        spot = np.searchsorted(self.grams, own)
        on = spot < len(self.grams)
        spot, own = spot[on], own[on]
        spot = spot[self.grams[spot] == own]
        start, size = self.at[spot], self.at[spot + 1] - self.at[spot]
        out, ends, lo = np.zeros(self.n, np.int64), np.cumsum(size), 0
        while lo < len(spot):  # a bounded number of postings at once
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + POSTINGS, side="right")))
            n = size[lo:hi]
            at = np.repeat(start[lo:hi] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            out += np.bincount(self.owner[at], minlength=self.n)
            lo = hi
        return out


def _verify(threshold: float, bands: int, rows: int):
    a, b = _seeds(bands * rows)

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        blk, ident, copies = t.column("blk").to_numpy(), t.column("sid").to_numpy(), t.column("copies").to_numpy()
        order = np.lexsort((ident, blk))
        blk, ident, copies = blk[order], ident[order], copies[order]
        raw = [x for c in t.column("grams").chunks for x in c]
        sets = [np.frombuffer(raw[k].as_buffer(), np.uint64) for k in order]
        sig = np.stack([signature_bands(s, a, b, bands) for s in sets])
        size = np.array([len(s) for s in sets])
        left = np.flatnonzero(blk == i)
        right = left if i == j else np.flatnonzero(blk == j)
        held: Postings | None = None
        links, texts, copied = np.zeros(len(ident), np.int64), np.zeros(len(ident), np.int64), []
        root = np.arange(len(ident))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        theirs = sig[right]
        for x in left:
            near = (theirs == sig[x]).any(axis=1)
            near &= right > x if i == j else True
            cand = np.flatnonzero(near)
            if not len(cand):
                continue
            if len(cand) <= 4:
                common = np.array([np.intersect1d(sets[x], sets[right[c]], assume_unique=True).size for c in cand])
            else:
                held = held or Postings([sets[k] for k in right])
                common = held.common(sets[x])[cand]
            hit = right[cand[common >= threshold * (size[x] + size[right[cand]] - common) - 1e-9]]
            if len(hit):
                links[x] += copies[hit].sum()
                texts[x] += len(hit)
                links[hit] += copies[x]
                texts[hit] += 1
                for y in hit.tolist():
                    u, v = find(x), find(y)
                    if u != v:
                        root[max(u, v)] = min(u, v)
                        copied.append((int(ident[x]), int(ident[y])))
        some = np.flatnonzero(texts)
        kinds = [pa.int64()] * 4
        cols = [[*ident[some].tolist(), *[c[0] for c in copied]], [None] * len(some) + [c[1] for c in copied], [*links[some].tolist(), *[0] * len(copied)], [*texts[some].tolist(), *[0] * len(copied)]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["sid", "other", "links", "texts"])

    return run


def similarity_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = N_GRAM, id_col: str = "doc_id") -> DataFrame:
    """doc_id, class_id, n_copies, n_links, n_text_links for every row.

    class_id: smallest id of the class. n_copies: other rows with the same n-gram set; n_links:
    all other rows at the threshold or above, copies among them; n_text_links: other sets at it.
    """
    return classes(docs, threshold, recall, n, id_col).select(F.col("id").alias("doc_id"), "class_id", "n_copies", "n_links", "n_text_links")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = N_GRAM, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs without those of a class that another row stands for; the row with the class's own id stays, once.

    Other columns pass through, whatever their names, save that names that start with _copy_ are reserved.
    """
    with Scratch() as scratch:
        found = scratch.save(classes(docs, threshold, recall, n, id_col).where("n_copies > 0 or n_text_links > 0").select("doc", "row", "class_id"), "classes")
        rows = found.groupBy("class_id", "doc", "row").agg(F.count("*").alias("n"))
        stay = rows.groupBy("class_id").agg(F.min(F.struct("doc", "row", "n")).alias("stay"))
        rows = rows.join(stay, "class_id").withColumn("stays", F.struct("doc", "row") == F.struct("stay.doc", "stay.row"))
        rows = save_stage(rows.select(F.col("doc").alias("_copy_doc"), F.col("row").alias("_copy_row"), "stays", "n"), "stays")
    doc, row = document_keys(id_col)
    keyed = docs.withColumns({"_copy_doc": doc, "_copy_row": row})
    out = keyed.join(checked(rows.where("not stays").select("_copy_doc", "_copy_row")), ["_copy_doc", "_copy_row"], "left_anti")
    repeated = rows.where("stays and n > 1").select("_copy_doc", "_copy_row")
    if not repeated.isEmpty():  # the row that stays is there more than once
        repeated = checked(repeated)
        out = out.join(repeated, ["_copy_doc", "_copy_row"], "left_anti").union(out.join(repeated, ["_copy_doc", "_copy_row"], "left_semi").dropDuplicates(["_copy_doc", "_copy_row"]))
    return out.select(*docs.columns)


def classes(docs: DataFrame, threshold: float, recall: float, n: int, id_col: str) -> DataFrame:
    """What similarity_classes returns, with the keys id, doc and row in place of doc_id."""
    parts = partitions(docs.sparkSession)
    bands, rows = choose_bands(threshold, recall)
    texts = keyed_texts(docs, id_col)
    stage = save_stage(fingerprints(texts, n, bands, rows), "fingerprints")
    with Scratch() as scratch:
        # One row for each set: its smallest id stands for it, the number of copies goes along.
        keyed = stage.where("lo is not null")
        # The table is written once, so the numbers that name its sets from here on are fixed.
        reps = keyed.groupBy("lo", "hi").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"), F.first("grams").alias("grams"))
        reps = scratch.save(reps.withColumn("sid", F.monotonically_increasing_id()), "sets")
        # The low half of a set's name links it; should two sets share it, their candidate cluster is only wider.
        banded = keyed.select(F.explode("bands").alias("band"), F.col("lo").alias("set"))
        shared = banded.groupBy("band").agg(F.min("set").alias("least"), F.max("set").alias("most")).where("least <> most").select("band", "least")
        shared = scratch.save(shared, "shared")
        links = banded.join(checked(shared), "band").where("`set` <> least").select(F.col("set").alias("a"), F.col("least").alias("b"))
        clusters = scratch.save(components(links, scratch=scratch).select(F.col("node").alias("lo"), F.col("root").alias("cluster")), "clusters")
        members = reps.join(checked(clusters), "lo")
        sizes = members.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("grams") / BLOCK_GRAMS)).cast("int").alias("blocks"))
        members = members.join(sizes, "cluster").withColumn("blk", F.pmod(F.xxhash64("lo", "hi"), F.col("blocks")).cast("int"))
        want = scratch.save(members.select("lo", "hi", F.col("rep").alias("doc"), "sid", "copies", "cluster", "blk", "blocks"), "members")
        held = with_grams(texts.select("doc", "text").join(checked(want), "doc").drop("doc"), n).dropDuplicates(["lo", "hi"])
        pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("blk")).alias("i"), F.greatest(o, F.col("blk")).alias("j"))))
        dealt = held.select("cluster", "blk", "sid", "copies", "grams", pair.alias("ij")).select("cluster", "ij.i", "ij.j", "blk", "sid", "copies", "grams")
        found = scratch.save(by_group(dealt, ["cluster", "i", "j"], [], _verify(threshold, bands, rows), "sid long, other long, links long, texts long", parts), "links")
        counts = found.where("other is null").groupBy("sid").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
        linked = components(found.where("other is not null"), "sid", "other", scratch=scratch).select(F.col("node").alias("sid"), "root")
        linked = linked.join(reps.select("sid", "rep"), "sid")
        roots = linked.groupBy("root").agg(F.min("rep").alias("class_id"))
        by_set = reps.join(counts, "sid", "left").join(linked.join(roots, "root").select("sid", "class_id"), "sid", "left")
        by_set = by_set.select("lo", "hi", "rep", "copies", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts"))
        by_set = save_stage(by_set.where("copies > 1 or texts > 0"), "bysets")
    out = stage.select("id", "doc", "row", "lo", "hi").join(checked(by_set), ["lo", "hi"], "left")
    return out.select(
        "id",
        "doc",
        "row",
        F.coalesce("class_id", "doc").alias("class_id"),
        F.coalesce(F.col("copies") - 1, F.lit(0)).alias("n_copies"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_text_links"),
    )
