"""Convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of hashed rows: two independent hashes of the word and one for
each of some prefix lengths. Filters of several widths run over the words of a text and
keep their maxima, which a logistic output combines. Training is Adam on a bounded sample
of labelled rows; rows start from the smoothed log-odds of their bucket, each kind of row in
a component of its own that one narrow filter reads. On a held part of
that sample a threshold is set for each language and the scores are shifted so that one
half is that threshold. The language comes from the text's function words alone.

Scores depend on the whole text and nothing else. Null, empty and wordless texts hold only
padding and get the score of an empty text. Repeated rows get equal scores. A label that is
null, or whose document is missing, teaches nothing; several labels of one document count as
toxic if one is. Without both classes in the sample every score is the share of toxic labels
(below one half if there are no labels). Texts pass in slices of bounded size whose maxima and
counts add up, so a text's length costs no memory; a run of more than 65536 letters and digits
counts as several words. A language gets a threshold of its own if the held part has OWN toxic
texts of it, else that of all languages together. Other columns do not matter, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import thrifty
from .common import words as mix
from .textkernel import portions, slices, split_words

BUCKETS, DIM, WIDTHS, FILTERS, PREFIXES = 1 << 18, 8, (1, 2, 3), 8, (3, 4, 5)
#: Hashed rows of a word, and the component that the log-odds of each start in.
ROWS, COMPONENT = 2 + len(PREFIXES), (0, 0, 1, 2, 3)
#: The training sample holds so many rows of either class at most, by the hash of the id.
SAMPLE = {1: 1000, 0: 2000}
#: Bytes of a text that may teach (others are only scored), and of all of the sample.
TEACH, TEACH_ALL = 1 << 16, 24 << 20
LANGUAGES = ("en", "fr", "de", "es", "other")
#: Toxic texts of a language in the held part from which on it has a threshold of its own.
OWN = 10

#: Function words that tell languages apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it was with as on be by are this have not or from they an",
    "fr": "le la les des et est du une que dans qui pour au ce sur pas plus par ne se sont avec elle aux",
    "de": "der die und das den von zu mit ist des im nicht ein eine auf dem sich als auch es an werden aus",
    "es": "el los las del y en un por con una su para es lo como más pero sus al se le ha que",
}


def word_ids(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket numbers (words, ROWS) above 0, n + 1 offsets, and each text's count of function words by language."""
    w = split_words(texts, prefix=PREFIXES)
    room = np.uint64(BUCKETS - 1)
    with np.errstate(over="ignore"):
        ids = np.stack([h % room for h in (w.hash, mix(w.hash + np.uint64(1)), *w.prefix)], 1).astype(np.int32) + 1
    lookup = split_words([FUNCTION_WORDS[k] for k in LANGUAGES[:-1]])
    votes = np.zeros((len(texts), len(LANGUAGES) - 1), np.int64)
    for k in range(len(LANGUAGES) - 1):
        own = lookup.hash[lookup.first[k] : lookup.first[k + 1]]
        votes[:, k] = np.bincount(w.doc[np.isin(w.hash, own)], minlength=len(texts))
    return ids, w.first, votes


def language(votes: np.ndarray) -> np.ndarray:
    """The language number with most function words; the last one without any."""
    return np.where(votes.any(1), votes.argmax(1), votes.shape[1]).astype(np.int32)


@dataclass
class Network:
    table: np.ndarray  #: (BUCKETS, DIM); row 0 is padding
    filters: list[np.ndarray]  #: (width, DIM, FILTERS) each
    bias: np.ndarray  #: (len(WIDTHS) * FILTERS)
    out: np.ndarray
    out_bias: float
    shift: np.ndarray  #: threshold of each language, on the logit

    def pooled(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Maxima by text and filter, and what training needs of the way there."""
        front = max(WIDTHS) - 1
        n = len(first) - 1
        at = first[:-1] + front * np.arange(n)  # every text is preceded by padding
        padded = np.zeros((len(ids) + front * (n + 1), ROWS), np.int32)
        place = np.arange(len(ids)) + front * (np.repeat(np.arange(n), np.diff(first)) + 1)
        padded[place] = ids
        x = self.table[padded[:, 0]]
        for k in range(1, ROWS):
            x += self.table[padded[:, k]]
        m = len(padded) - front
        tops, convs = [], []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            c = x[:m] @ f[0]
            for j in range(1, w):
                c += x[j : m + j] @ f[j]
            convs.append(c)
            tops.append(np.maximum.reduceat(c, at, axis=0) if n else np.zeros((0, FILTERS), np.float32))
        return np.concatenate(tops, 1) + self.bias, (padded, x, at, m, convs)

    def logits(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        top, _ = self.pooled(ids, first)
        return np.maximum(top, 0) @ self.out + self.out_bias

    def windows(self, ids: np.ndarray) -> np.ndarray:
        """Maxima by filter over the windows that begin early enough for the widest filter."""
        m = len(ids) - max(WIDTHS) + 1
        x = self.table[ids[:, 0]]
        for k in range(1, ROWS):
            x += self.table[ids[:, k]]
        tops = []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            c = x[:m] @ f[0]
            for j in range(1, w):
                c += x[j : m + j] @ f[j]
            tops.append(c.max(axis=0))
        return np.concatenate(tops)

    def long_logit(self, text: str) -> tuple[float, int]:
        """Logit and language of one text of any length, slice by slice: maxima and counts go on from one to the next."""
        pad = np.zeros((max(WIDTHS) - 1, ROWS), np.int32)
        carry, votes, top = pad, 0, np.full(len(self.bias), -np.inf, np.float32)
        for part in chain(slices(text), [None]):
            ids, own = pad, 0
            if part is not None:
                ids, _, own = word_ids([part])
            feed = np.concatenate([carry, ids])
            if len(feed) >= max(WIDTHS):
                top = np.maximum(top, self.windows(feed))
            carry, votes = feed[len(feed) - len(pad) :], votes + own
        return float(np.maximum(top + self.bias, 0) @ self.out + self.out_bias), int(language(votes)[0])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        logit, lang = np.zeros(len(texts)), np.zeros(len(texts), np.int32)
        for lo, hi, whole in portions(texts):
            if whole is None:
                logit[lo], lang[lo] = self.long_logit(texts[lo])
            else:
                ids, first, votes = word_ids(whole)
                logit[lo:hi], lang[lo:hi] = self.logits(ids, first), language(votes)
        return 1 / (1 + np.exp(-np.clip(logit - self.shift[lang], -30, 30)))


def _start(docs: list[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> Network:
    """Small random weights, and the log-odds of each kind of row; a bucket of one or two texts says nothing yet."""
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    table = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
    table[:, : max(COMPONENT) + 1] = 0
    for k, component in enumerate(COMPONENT):
        seen = np.zeros((2, BUCKETS))
        for d, label in zip(docs, y, strict=True):
            seen[int(label), np.unique(d[:, k])] += 1
        total = seen.sum(0)
        odds = np.clip(np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1)), -2, 4)
        table[:, component] += np.where(total > 2, odds * (total - 2) / (total + 1), 0) / COMPONENT.count(component)
    table[0] = 0
    filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    parts = max(COMPONENT) + 1
    filters[0][0, :, :parts] = np.eye(DIM, parts)
    out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
    out[:parts] = 0.7
    return Network(table, filters, np.zeros(len(WIDTHS) * FILTERS, np.float32), out, -3.0, np.zeros(len(LANGUAGES)))


def _gradients(net: Network, batch: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Gradients of filters, bias, out and out_bias, then the rows of the table that were used and theirs."""
    first = np.concatenate([[0], np.cumsum([len(d) for d in batch])])
    ids = np.concatenate(batch)
    top, (padded, x, at, m, convs) = net.pooled(ids, first)
    act = np.maximum(top, 0)
    p = 1 / (1 + np.exp(-np.clip(act @ net.out + net.out_bias, -30, 30)))
    d = (p - y) * weight / len(y)
    d_top = d[:, None] * net.out * (top > 0)
    dx = np.zeros_like(x)
    doc = np.repeat(np.arange(len(batch)), np.diff(np.append(at, m)))
    d_filters = []
    for i, (w, f, c) in enumerate(zip(WIDTHS, net.filters, convs, strict=True)):
        high = np.maximum.reduceat(c, at, axis=0)
        t, k = np.nonzero(c == high[doc])
        _, one = np.unique(doc[t] * FILTERS + k, return_index=True)
        t, k = t[one], k[one]
        g = d_top[doc[t], i * FILTERS + k].astype(np.float32)
        d_f = np.zeros_like(f)
        for j in range(w):
            np.add.at(d_f[j].T, k, g[:, None] * x[t + j])
            np.add.at(dx, t + j, g[:, None] * f[j][:, k].T)
        d_filters.append(d_f)
    used = np.flatnonzero(np.abs(dx).sum(1))
    rows, spot = np.unique(padded[used].ravel(), return_inverse=True)
    d_rows = np.zeros((len(rows), DIM), np.float32)
    np.add.at(d_rows, spot, np.repeat(dx[used], ROWS, axis=0))
    return [*d_filters, d_top.sum(0), act.T @ d, np.array(d.sum())], rows, d_rows


def _threshold(z: np.ndarray, y: np.ndarray) -> float | None:
    """The logit that parts the classes best, precision counting double (F0.5), in the middle of its gap; None if a class is missing."""
    if not 0 < y.sum() < len(y):
        return None
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    hit = np.cumsum(y)
    f = 1.25 * hit / (np.arange(1, len(y) + 1) + 0.25 * y.sum())
    best = int(np.argmax(f))
    below = z[best + 1] if best + 1 < len(z) else z[best] - 2
    return float((z[best] + below) / 2)


def train(docs: list[np.ndarray], y: np.ndarray, lang: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = 3) -> Network:
    """docs: bucket numbers (words, ROWS) of each text. One row in five sets the thresholds and is not trained on."""
    rng = np.random.default_rng(seed)
    y = y.astype(np.float32)
    if not 0 < y.sum() < len(y):
        net = _start(docs[:0], y[:0], rng)
        net.out[:] = 0
        share = min(0.95, max(0.05, float(y.mean()) if len(y) else 0.05))
        net.out_bias = float(np.log(share / (1 - share)))
        return net
    order = rng.permutation(len(docs))
    fold = np.zeros(len(docs), bool)
    for c in (0, 1):
        own = order[y[order] == c]
        fold[own[: len(own) // 5]] = True
    fit = order[~fold[order]]
    net = _start([docs[i] for i in fit], y[fit], rng)
    weight = np.where(y == 1, np.sqrt((y == 0).sum() / y.sum()), 1.0).astype(np.float32)
    dense = [*net.filters, net.bias, net.out]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in dense]
    row_m, row_v, step, bias_m = np.zeros_like(net.table), np.zeros(BUCKETS, np.float32), 0, 0.0
    for epoch in range(epochs):
        turn = rng.permutation(fit)
        for lo in range(0, len(turn), 32):
            some = turn[lo : lo + 32]
            step += 1
            grads, rows, d_rows = _gradients(net, [docs[i] for i in some], y[some], weight[some])
            lr = rate / (1 + epoch)
            for p, g, (m, v) in zip(dense, grads, moments, strict=False):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6) + lr * 1e-3 * p
            bias_m += 0.1 * (float(grads[-1]) - bias_m)
            net.out_bias -= lr * 5 * bias_m
            keep = rows > 0
            rows, d_rows = rows[keep], d_rows[keep]
            row_m[rows] += 0.5 * (d_rows - row_m[rows])
            row_v[rows] += (d_rows * d_rows).mean(1)  # rows that are seen often move less
            net.table[rows] -= lr * 5 * row_m[rows] / (np.sqrt(row_v[rows])[:, None] + 1e-4)
    held = np.flatnonzero(fold)
    z = np.concatenate([net.logits(docs[i], np.array([0, len(docs[i])])) for i in order]) if len(order) else np.zeros(0)
    logit = np.zeros(len(docs))
    logit[order] = z
    common = _threshold(logit[held], y[held])
    if common is None:
        common = _threshold(logit, y)
    for k in range(len(LANGUAGES)):
        own = held[lang[held] == k]
        cut = _threshold(logit[own], y[own]) if y[own].sum() >= OWN else None
        net.shift[k] = common if cut is None else cut
    return net


def may_teach(key: Column, folds: int, held: int) -> Column:
    """Rows whose crc32 of the id as text leaves another remainder than the held-out one."""
    return F.crc32(key.cast("string").cast("binary")) % folds != held


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> Network:
    """Train on a bounded sample of the rows of docs that labels marks (doc_id, toxic) and may_teach allows."""
    marks = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = docs.select("doc_id").where(may_teach(F.col("doc_id"), 5, 0)).distinct().join(marks, "doc_id")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            for lo, hi, _ in portions(texts):
                ids, first, votes = word_ids(texts[lo:hi])  # no text is longer than TEACH
                lang = language(votes)
                bag = [ids[p:q].tobytes() for p, q in zip(first, first[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(bag, pa.binary()), pa.array(lang)], ["doc_id", "toxic", "ids", "lang"])

    most_all = sample or SAMPLE
    few = [known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(most) for label, most in most_all.items()]
    chosen = F.broadcast(few[0].union(few[1]))  # as many rows as the sample at most
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= TEACH).join(chosen, "doc_id").select("doc_id", "toxic", "text").limit(2 * sum(most_all.values()))
    held = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("held", held).where(F.col("held") <= TEACH_ALL).drop("held")  # at most 2 * SAMPLE rows reach this window
    found = rows.mapInArrow(thrifty(bags), "doc_id long, toxic int, ids binary, lang int")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["doc_id"], r["toxic"], r["ids"]))
        net = train([np.frombuffer(r["ids"], np.int32).reshape(-1, ROWS) for r in held], np.array([r["toxic"] for r in held]), np.array([r["lang"] for r in held], np.int32))
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(net)]})

    # One task trains on the sample, whose size is fixed; the driver only sees the model.
    return pickle.loads(found.coalesce(1).mapInArrow(thrifty(learn), "model binary").collect()[0][0])


def score(docs: DataFrame, net: Network, columns: list[str] | None = None, name: str = "toxicity") -> DataFrame:
    """The given columns of docs (doc_id by default) and the score, a double called `name`."""
    held = docs.sparkSession.sparkContext.broadcast(net)  # BUCKETS x DIM floats: its size is fixed
    columns = columns or ["doc_id"]
    at = columns.index("text") if "text" in columns else -1  # a text that is returned passes once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = held.value.scores(b.column(at % b.num_columns).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(s, pa.float64())], [*columns, name])

    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in columns) + f", `{name}` double"
    return docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], *[F.col("text").alias("t")] * (at < 0)).mapInArrow(thrifty(run), schema)
