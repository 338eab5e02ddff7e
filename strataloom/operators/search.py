"""Text and symbol search, and line diffs."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import lines_of, snippet
from ..schema import MAX_FILE_BYTES


def contains_line(content: Column, pattern: str) -> Column:
    """Any line holds the pattern, whatever the case; a pattern with a line break never does."""
    low = pattern.lower()
    if "\n" in low or "\r" in low:
        return F.lit(False)
    return F.lower(content).contains(low)


def files_with_match(files: DataFrame, pattern: str, most: int = MAX_FILE_BYTES) -> DataFrame:
    return files.where(F.col("size") <= most).where(contains_line(F.col("content"), pattern))


def matching_lines(files: DataFrame, pattern: str, names: str | None = None) -> DataFrame:
    """path, line (from 1), text, snippet of every line with the pattern; `names` is a file name suffix (*.x) or part."""
    if names:
        files = files.where(F.col("path").endswith(names[1:]) if names.startswith("*") else F.col("path").contains(names))
    hit = files.where(contains_line(F.col("content"), pattern))
    lines = hit.select("path", F.posexplode(lines_of(F.col("content"))).alias("p", "text"))
    return lines.where(contains_line(F.col("text"), pattern)).select("path", (F.col("p") + 1).cast("int").alias("line"), "text", snippet(F.col("text"), pattern).alias("snippet"))


def search_lines(files: DataFrame, pattern: str, most: int, names: str | None = None) -> DataFrame:
    """The first `most` matching lines by path and line."""
    return matching_lines(files, pattern, names).orderBy("path", "line").limit(most)


def symbols(facts: dict[str, DataFrame], query: str, kind: str, most: int | None) -> DataFrame:
    """path, name, line, kind of facts whose name holds the query: functions, types, imports or references (calls and types); all of them if `most` is None."""
    low = query.lower()
    pick = lambda name, column, label: facts[name].where(F.lower(column).contains(low)).select("path", F.col(column).alias("name"), "line", F.lit(label).alias("kind"))
    found = {
        "functions": lambda: pick("defs", "name", "function"),
        "types": lambda: pick("type_refs", "name", "type"),
        "imports": lambda: pick("imports", "module", "import"),
        "references": lambda: pick("calls", "name", "call").unionByName(pick("type_refs", "name", "type")),
    }[kind]()
    return found if most is None else found.orderBy("path", "line", "name", "kind").limit(most)


def _runs_of(words: Column, n: int) -> Column:
    """The distinct runs of n words, each joined by blanks; null if there are none."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " ")))


def texts_with_passage(docs: DataFrame, items: DataFrame, words: int = 4) -> DataFrame:
    """doc, item for each text (doc, text) that holds a passage (item, passage): a containment join made equi.

    A text that holds a passage holds all of its words but the first and the last whole (these may
    be parts of longer ones), so up to `words` of them in a row are the key. Texts give keys of the
    lengths that occur only. Passages of one or two words have no key and are compared with every text.
    """
    inner = F.split("passage", " ")
    length = F.least(F.size(inner) - 2, F.lit(words))
    items = items.select("item", "passage", length.alias("n"), F.array_join(F.slice(inner, 2, F.greatest(length, F.lit(0))), " ").alias("key"))
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # `words` + 2 values at most
    split = docs.select("doc", "text", F.split("text", " ").alias("w"))
    out = None
    for n in lengths:
        own = items.where(F.col("n") == n)
        if n <= 0:
            pairs = docs.join(own, F.col("text").contains(F.col("passage")))
        else:
            pairs = split.select("doc", "text", F.explode(_runs_of(F.col("w"), n)).alias("key")).join(own, "key").where(F.col("text").contains(F.col("passage")))
        out = pairs.select("doc", "item") if out is None else out.union(pairs.select("doc", "item"))
    return docs.select("doc").limit(0).crossJoin(items.select("item").limit(0)) if out is None else out.distinct()


@dataclass
class Hunk:
    """One difference: where it starts (from 1, context included), how many lines of either side it covers, and its text."""

    old_start: int
    old_lines: int
    new_start: int
    new_lines: int
    removed: int
    added: int
    text: str


def hunks(a: list[str], b: list[str], context: int = 3) -> list[Hunk]:
    """The differences in order; after one, the sides move on to the nearest place where `context` lines agree (or both end).

    The text holds up to `context` lines before it (with a blank), the removed lines with `-`, the
    added ones with `+`, and up to `context` lines after it. The lines after it are not counted as
    covered, as the next difference may start there.
    """
    out, i, j, need = [], 0, 0, max(1, context)
    where: dict[tuple, list[int]] | None = None
    while True:
        while i < len(a) and j < len(b) and a[i] == b[j]:
            i, j = i + 1, j + 1
        if i >= len(a) and j >= len(b):
            return out
        if where is None:  # places of each run of lines in b, built once
            where = {}
            for q in range(len(b)):
                where.setdefault(tuple(b[q : q + need]), []).append(q)
        p, q = _meet(a, where, i, j, len(b), need)
        before = min(context, i)
        after = min(context, len(a) - p, len(b) - q)
        text = [*(f" {x}\n" for x in a[i - before : i]), *(f"-{x}\n" for x in a[i:p]), *(f"+{x}\n" for x in b[j:q]), *(f" {x}\n" for x in a[p : p + after])]
        first = j - min(context, j)
        out.append(Hunk(i - before + 1, p - i + before, first + 1, q - first, p - i, q - j, "".join(text)))
        i, j = p, q


def _meet(a: list[str], where: dict[tuple, list[int]], i: int, j: int, end: int, context: int) -> tuple[int, int]:
    """The place (p, q) from (i, j) on with the fewest lines before it whose next lines agree; the ends of both if there is none."""
    best = None
    for p in range(i, len(a)):
        if best and p - i >= best[0]:
            break
        places = where.get(tuple(a[p : p + context]), ())
        k = bisect_left(places, j)
        if k < len(places):
            cost = (p - i) + (places[k] - j)
            if best is None or cost < best[0]:
                best = (cost, p, places[k])
    return (best[1], best[2]) if best else (len(a), end)


def _lines(text: str) -> list[str]:
    """Lines that a line feed ends (with or without a carriage return); one empty line after a last feed does not count."""
    rows = [x.removesuffix("\r") for x in text.split("\n")]
    return rows[:-1] if not rows[-1] else rows


def diff(pairs: DataFrame, context: int = 3) -> DataFrame:
    """A row for each hunk of pairs (key, old, new); a null text is empty, texts with a NUL give one binary hunk without lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = []
            for key, old, new in zip(*(c.to_pylist() for c in x.columns), strict=True):
                old, new = old or "", new or ""
                if "\0" in old or "\0" in new:
                    found = [Hunk(1, 0, 1, 0, 0, 0, "binary\n")] if old != new else []
                else:
                    found = hunks(_lines(old), _lines(new), context)
                rows += [(key, n, h.old_start, h.old_lines, h.new_start, h.new_lines, h.removed, h.added, h.text) for n, h in enumerate(found)]
            cols = list(zip(*rows, strict=True)) or [()] * 9
            kinds = (x.schema.field(0).type, *[pa.int32()] * 7, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "hunk", "old_start", "old_lines", "new_start", "new_lines", "removed", "added", "text"])

    kind = dict(pairs.dtypes)["key"]
    return pairs.select("key", "old", "new").mapInArrow(run, f"key {kind}, hunk int, old_start int, old_lines int, new_start int, new_lines int, removed int, added int, text string")


def changed_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, change (added, removed, modified) between two snapshots with equal columns."""
    rest = [c for c in old.columns if c != key]
    sign = lambda df: df.select(key, F.md5(F.to_json(F.struct(*rest))).alias("h"))
    a, b = sign(old).toDF(key, "a"), sign(new).toDF(key, "b")
    both = a.join(b, key, "full")
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    return both.select(key, kind.alias("change")).where("change is not null")


def numstat_totals(numstat: DataFrame) -> DataFrame:
    """One row: files, insertions, deletions of (path, insertions, deletions) texts; a binary `-` counts its file only."""
    n = lambda c: F.coalesce(F.sum(F.expr(f"try_cast({c} as bigint)")), F.lit(0)).alias(c)
    return numstat.agg(F.count("*").alias("files_changed"), n("insertions"), n("deletions"))
