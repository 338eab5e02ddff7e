"""Hierarchical language identification: the family first, then the languages within it.

Features are relative frequencies of hashed character pairs and triples of the lower-cased
text, all but letters read as spaces. Linear support vector machines (squared hinge, by
accelerated gradient steps) stand one against one, first between families, then between
the languages of each family. The most wins are taken, ties go to the larger margin.

Null texts and those without a letter are `und` with score 0. Languages that the table of
families lacks form a family of their own. With one language in the sample every text with
letters gets it; with none, `und`. The whole text counts, in slices of bounded size whose
counts add up; a prediction depends on its text only. Repeated rows get equal results, whatever
their ids. Other columns do not matter, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import thrifty
from .textkernel import SLICE, class_table, code_points, portions
from .toxicity import may_teach

BUCKETS = 4096
#: Documents of a language in the training sample, by the hash of the id; and of all languages together.
SAMPLE, SAMPLE_ALL = 250, 4000
#: Texts whose counts are held at once.
TEXTS = 128

#: Language families.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb yi",
    "romance": "fr es it pt ro ca gl oc la co",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk uz ky tt",
    "semitic": "ar he mt am",
    "iranic": "fa ku ps tg",
    "indic": "hi bn ur mr ne gu pa",
    "austronesian": "id ms tl jv",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket of pairs and triples occurs in each text (texts, BUCKETS), and whether a text has a letter; long texts are read in slices."""
    out, letters = np.zeros((len(texts), BUCKETS), np.int32), np.zeros(len(texts), bool)
    for lo, hi, whole in portions(texts):
        parts = [whole] if whole is not None else [[texts[lo][p : p + SLICE + 2]] for p in range(0, len(texts[lo]), SLICE)]
        for k, part in enumerate(parts):
            u, first = code_points(part)
            letter = class_table("letter")[u]
            letters[lo:hi] |= np.logical_or.reduceat(letter, first[:-1])
            s = np.where(letter, u, 32).astype(np.uint32)
            doc = np.repeat(np.arange(hi - lo), np.diff(first))
            if whole is not None or k == len(parts) - 1:
                last = first[1:] - 1  # the closing separator, read as a space
            else:
                last = np.array([SLICE + 1])
            for n in (2, 3):
                h = np.zeros(len(s), np.uint32)
                with np.errstate(over="ignore"):
                    for j in range(n):
                        h[: len(s) - j] = (h[: len(s) - j] ^ s[j:]) * np.uint32(0x9E3779B1)
                    h ^= h >> np.uint32(15)
                    h *= np.uint32(0x85EBCA77)
                on = np.arange(len(s)) + n - 1 <= last[doc]
                if whole is None and k < len(parts) - 1:
                    on &= np.arange(len(s)) < SLICE
                out[lo:hi] += np.bincount(doc[on] * BUCKETS + (h[on] >> np.uint32(20)).astype(np.int64), minlength=(hi - lo) * BUCKETS).reshape(-1, BUCKETS).astype(np.int32)
    return out, letters


def features(texts: list[str | None]) -> np.ndarray:
    """Relative frequencies (texts, BUCKETS)."""
    out = counts(texts)[0].astype(np.float32)
    return out / np.maximum(out.sum(1, keepdims=True), 1)


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine for labels -1 and 1; classes weigh alike."""
    n = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = np.zeros(x1.shape[1], np.float32)
    v, rate = w.copy(), 1 / (1 + 2 * c * float((n[:, None] * x1 * x1).sum()))
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x1 @ v))
        g = v - 2 * c * (x1.T @ (n * y * slack))
        g[-1] -= v[-1]
        new = v - rate * g
        v, w = new + k / (k + 3) * (new - w), new
    return w[:-1], float(w[-1])


@dataclass
class Model:
    classes: list[str]  #: languages
    tiers: list[tuple[list[str], list[int]]]  #: first the families, then each family's languages; with their machines' columns
    pairs: list[tuple[str, str]]
    weights: np.ndarray  #: (BUCKETS, machines)
    bias: np.ndarray

    def _vote(self, m: np.ndarray, tier: tuple[list[str], list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner of a tier and its smallest margin over another."""
        names, cols = tier
        wins, gap = np.zeros((len(m), len(names))), np.full((len(m), len(names)), np.inf)
        for c in cols:
            a, b = (names.index(n) for n in self.pairs[c])
            for k, side in ((a, m[:, c]), (b, -m[:, c])):
                wins[:, k] += (side > 0) + 1e-3 * np.tanh(side)
                gap[:, k] = np.minimum(gap[:, k], side)
        best = wins.argmax(1)
        return best, gap[np.arange(len(m)), best]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs: list[str] = []
        scores = [np.zeros(0)]
        for lo in range(0, len(texts), TEXTS):
            part = texts[lo : lo + TEXTS]
            if not self.classes:
                langs += ["und"] * len(part)
                scores.append(np.zeros(len(part)))
                continue
            n, letters = counts(part)
            # Whole counts times double weights: the same sums wherever a text was cut and whatever stands beside it.
            m = np.stack([n @ w for w in self.weights.T.astype(np.float64)], 1) if len(self.bias) else np.zeros((len(part), 0))
            m = m / np.maximum(n.sum(1), 1)[:, None] + self.bias
            family, gap = self._vote(m, self.tiers[0])
            out = np.array([""] * len(part), object)
            for k, tier in enumerate(self.tiers[1:]):
                own = np.flatnonzero(family == k)
                best, near = self._vote(m[own], tier)
                out[own] = np.array(tier[0], object)[best]
                gap[own] = np.minimum(gap[own], near)
            s = np.where(letters, 1 / (1 + np.exp(-3 * np.clip(gap, -10, 10))), 0)
            langs += [x if ok else "und" for x, ok in zip(out, letters, strict=True)]
            scores.append(s)
        return langs, np.concatenate(scores)


def train(x: np.ndarray, langs: list[str]) -> Model:
    classes = sorted(set(langs))
    family = {c: FAMILY_OF.get(c, c) for c in classes}
    names = sorted(set(family.values()))
    lang, fam = np.array(langs, object), np.array([family[c] for c in langs], object)
    scale = (1 / (x.std(0) + 1e-3 * x.std(0).max() + 1e-12)).astype(np.float32) / np.sqrt(BUCKETS) if len(x) else np.ones(BUCKETS, np.float32)
    centre = x.mean(0) if len(x) else np.zeros(BUCKETS, np.float32)
    z = (x - centre) * scale
    weights, bias, pairs, tiers = [], [], [], []
    for members, of in [(names, fam), *[([c for c in classes if family[c] == f], lang) for f in names]]:
        cols = []
        for a, b in combinations(members, 2):
            own = (of == a) | (of == b)
            w, w0 = svm(z[own], np.where(of[own] == a, 1.0, -1.0).astype(np.float32))
            cols.append(len(pairs))
            pairs.append((a, b))
            weights.append(w * scale)
            bias.append(w0 - float((w * scale) @ centre))
        tiers.append((members, cols))
    table = np.stack(weights, 1).astype(np.float32) if weights else np.zeros((BUCKETS, 0), np.float32)
    return Model(classes, tiers, pairs, table, np.array(bias))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from text and non-null lang of a bounded sample of the rows that are not held out."""
    rows = docs.where("lang is not null and text is not null").where(may_teach(F.col("doc_id"), 4, 2)).select("doc_id", "lang", "text")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    ids = rows.select("doc_id", "lang", F.xxhash64("doc_id", F.lit(11)).alias("h")).withColumn("r", rank).where(F.col("r") <= sample)
    ids = ids.orderBy("r", "lang").limit(SAMPLE_ALL).select("doc_id", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            for lo in range(0, len(texts), TEXTS):
                hi = min(lo + TEXTS, len(texts))
                x = features(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "lang", "x"])

    few = rows.join(F.broadcast(ids), ["doc_id", "lang"]).select("doc_id", "lang", "text").limit(2 * SAMPLE_ALL)  # ids hold SAMPLE_ALL rows at most

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["lang"], r["doc_id"], r["x"]))
        x = np.stack([np.frombuffer(r["x"], np.float32) for r in held]) if held else np.zeros((0, BUCKETS), np.float32)
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(train(x, [r["lang"] for r in held]))]})

    # One task trains on the sample, whose size is fixed; the driver only sees the model.
    found = few.mapInArrow(thrifty(run), "doc_id long, lang string, x binary").coalesce(1).mapInArrow(thrifty(learn), "model binary")
    return pickle.loads(found.collect()[0][0])


def identify(docs: DataFrame, model: Model, columns: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """The given columns of docs (doc_id by default), then language (string) and score (double), called by `names`."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    columns = columns or ["doc_id"]
    at = columns.index("text") if "text" in columns else -1  # a text that is returned passes once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, s = held.value.predict(b.column(at % b.num_columns).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(langs, pa.string()), pa.array(s, pa.float64())], [*columns, *names])

    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in columns) + f", `{names[0]}` string, `{names[1]}` double"
    return docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], *[F.col("text").alias("t")] * (at < 0)).mapInArrow(thrifty(run), schema)
