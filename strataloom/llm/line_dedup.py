"""Fuzzy line deduplication over a corpus.

1. Lines are normalised (lower case, digits as 0, words of letters and digits joined by one
   space) and named by 128 bits; equal lines become one row with their first occurrence.
2. Two feature sets name a line for the search: its longer words, and all words and word pairs
   where it has few longer ones (between the two, a line has both). Each set gives BANDS MinHash
   bands of ROWS rows, chosen once for RECALL at the Jaccard similarity of two lines with a fifth
   of their words replaced; the number of lines plays no part. Band keys travel as sorted blocks
   of bytes, one for each range of keys; members of a band are linked to its smallest one.
3. Linked lines form candidate clusters. One that fits a block is verified as a whole; a larger
   one is verified block by block first, then its lines are dealt out by the bands in which lines
   meet that are not connected yet, so that no line is copied more often than it has bands (and a
   band that exceeds a block in pairs of blocks). All pairs that share a band and are not
   connected yet are verified by edit similarity.
4. Of each connected group the first occurrence stays (by document, text, then position).

Lines without letters or digits are never removed. A null text stays null; an empty one
stays empty. A null id counts as a number beyond 2**62 that its text gives. Rows that
repeat both id and text are one document, cleaned alike. Texts are cleaned whole, in slices of
bounded size; a run of more than 65536 letters and digits counts as several words. Other columns
pass through, whatever their names, save that names with the prefix _line_ are reserved. An
empty table stays empty.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_group, checked, components, groups, partitions, save_stage, thrifty
from .common import words as mix
from .ngram_join import _seeds, choose_bands, document_keys, keyed_texts
from .textkernel import SLICE, fold, portions, slices, split_lines, split_words

SIMILARITY = 0.8
#: Letters of a longer word; function words are mostly shorter.
LONG = 5
#: Lines of fewer longer words are sought by all words and pairs, lines of at least FEW by longer words; FEW to MANY by both.
FEW, MANY = 4, 8
#: Share of pairs with a fifth of their words replaced (Jaccard similarity 0.8 / 1.2) that must share a band, and the rows of one.
RECALL = 0.95
BANDS, ROWS = choose_bands(SIMILARITY / (2 - SIMILARITY), RECALL, 5)
#: Lines that a task verifies together, and local members of a band that are linked before the shuffle.
BLOCK, CROWD = 2048, 8
#: Band keys that a task holds before it sends them, and links or lines in a batch of rows.
HELD, LINKS = 1 << 18, 1 << 16
#: Lines and characters that are verified in one go, and buckets of the profile that rules pairs out.
LINES, CHARS, PROFILE = 8192, 1 << 21, 512
#: Letters of pairs that are compared side by side, bits of their letter masks, and how often a comparison looks whether a pair is out of reach.
SIDE, MASKS, LOOKS = 1 << 14, 1 << 23, 8

_DIGITS = re.compile("[1-9]")


_WORD = re.compile(r"[^\W_]+")
#: What becomes of each ASCII character in a normal form.
_PLAIN = bytes((48 if 48 <= c < 58 else ord(chr(c).lower())) if c < 128 and chr(c).isalnum() else 32 for c in range(256))


def normal_line(line: str) -> str:
    """Lower-cased words of letters and digits (as 0), one space between them; empty without any."""
    if line.isascii():
        return b" ".join(line.encode().translate(_PLAIN).split()).decode()
    return " ".join(_WORD.findall(_DIGITS.sub("0", fold(line))))


def _trimmed(a: str, b: str, least: float) -> tuple[str, str, int]:
    """The shorter and the longer string without what they begin and end with alike, and the edits that `least` allows."""
    if len(a) > len(b):
        a, b = b, a
    most = int(len(b) * (1 - least) + 1e-9)
    if len(b) - len(a) > most:
        return a, b, most
    same = 0
    while same < len(a) and a[same : same + 64] == b[same : same + 64]:
        same += 64
    same = min(same, len(a))
    while same < len(a) and a[same] == b[same]:
        same += 1
    a, b, same = a[same:], b[same:], 0
    while same < len(a) and a[-1 - same] == b[-1 - same]:
        same += 1
    return a[: len(a) - same], b[: len(b) - same], most


def _distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance of a (not empty, no longer) and b, bit-parallel over a; something above `most` as soon as that is out of reach."""
    n, m = len(b), len(a)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << m) - 1
    masks = [at.get(c, 0) for c in b]
    up, down, d = full, 0, m
    every = max(32, n // LOOKS)
    for lo in range(0, n, every):
        for eq in masks[lo : lo + every]:  # the bits of up beyond the column are never read
            diag = ((eq & up) + up ^ up | eq | down) & full
            more = ((down | (diag | up) ^ full) << 1 | 1) & full
            up = (up & diag) << 1 | (diag | more) ^ full
            down = more & diag
        up &= full
        done = min(n, lo + every)
        d = done + up.bit_count() - down.bit_count()  # the last cell of column `done`, whose first cell is `done`
        if d - (n - done) > most:
            return most + 1
        if done < n and _least(_bits(up, 1, m // 8 + 1), _bits(down, 1, m // 8 + 1), np.array([m]), np.array([n - done]), np.array([done]))[0] > most:
            return most + 1
    return d


def _bits(x: int, count: int, width: int) -> np.ndarray:
    """The fields of `width` bytes that x holds, the first one lowest."""
    return np.frombuffer(x.to_bytes(count * width, "little"), np.uint8).reshape(count, width)


def _number(fields: np.ndarray) -> int:
    return int.from_bytes(fields.tobytes(), "little")


def _least(up: np.ndarray, down: np.ndarray, m: np.ndarray, left: np.ndarray, done: np.ndarray) -> np.ndarray:
    """The distance that each pair reaches at least, `done` columns done and `left` to come: the best cell of its column and what it lacks to the corner."""
    step = np.unpackbits(up, axis=1, bitorder="little").view(np.int8) - np.unpackbits(down, axis=1, bitorder="little").view(np.int8)
    cell = np.cumsum(step, axis=1, dtype=np.int32)
    i = np.arange(1, cell.shape[1] + 1, dtype=np.int32)
    cell += np.abs((m[:, None] - i).astype(np.int32) - left[:, None].astype(np.int32))
    cell[i > m[:, None]] = 1 << 30
    return done + np.minimum(cell.min(axis=1), np.abs(m - left))


def edit_similarity(a: str, b: str, least: float = 0.0) -> float:
    """1 - Levenshtein distance / longer length; 0 where it is below `least`."""
    longest = max(len(a), len(b))
    a, b, most = _trimmed(a, b, least)
    d = len(b) if not a else most + 1 if len(b) - len(a) > most else _distance(a, b, most)
    return 0.0 if d > most else 1 - d / longest if longest else 1.0


def _apart(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Whether each pair is further apart than `most` edits: _distance of all pairs at once, each in a field of the same numbers.

    a: the shorter strings (none empty), of like lengths. A field has a bit more than its string, which takes the carry.
    All pairs end at the last column; one whose b is shorter begins later and keeps its first column until then.
    """
    m, n, count = np.array([len(x) for x in a]), np.array([len(x) for x in b]), len(a)
    flat = np.frombuffer("".join(a + b).encode("utf-32-le", "surrogatepass"), np.uint32)
    if int(flat.max()) < 1 << 13:
        table = np.zeros(int(flat.max()) + 1, np.int32)
        table[flat] = 1
        code = (np.cumsum(table, dtype=np.int32) - 1)[flat]
    else:
        code = np.unique(flat, return_inverse=True)[1]
    columns, letters, width = int(n.max()), int(code.max()) + 1, int(m.max()) // 8 + 1
    if count == 1 or count * letters * width * 8 > MASKS:
        return np.array([_distance(x, y, k) > k for x, y, k in zip(a, b, most.tolist(), strict=True)])
    here = np.arange(width * 8) < m[:, None]
    pattern = np.full(here.shape, -1, np.int64)
    pattern[here] = code[: int(m.sum())]
    eq = np.zeros((count, letters + 1, width), np.uint8)  # the last letter is none: it fills the columns before a pair begins
    eq[:, :letters] = np.packbits(pattern[:, None] == np.arange(letters)[:, None], axis=2, bitorder="little")
    begin = columns - n
    text = np.full((count, columns), letters, np.int64)
    text[np.arange(columns) >= begin[:, None]] = code[int(m.sum()) :]
    cell, text = np.packbits(here, axis=1, bitorder="little"), text.T.copy()
    full = up = _number(cell)
    down, out, own = 0, np.zeros(count, bool), np.arange(count)
    every = max(64, columns // LOOKS)
    lo = 0
    for hi in sorted({*begin[begin > 0].tolist(), *range(every, columns, every), columns}):
        size = len(own) * width
        masks = eq[np.arange(len(own)), text[lo:hi]].tobytes()
        one = np.zeros((len(own), width), np.uint8)
        one[:, 0] = begin <= lo
        one = _number(one)
        for at in range(0, len(masks), size):
            e = int.from_bytes(masks[at : at + size], "little")
            diag = ((e & up) + up ^ up | e | down) & full
            more = (down | (diag | up) ^ full) << 1 | one
            up = ((up & diag) << 1 | (diag | more) ^ full) & full
            down = more & diag
        lo = hi
        if hi < columns and hi % every:
            continue
        ups, downs, left = _bits(up, len(own), width), _bits(down, len(own), width), np.minimum(columns - hi, n)
        far = _least(ups, downs, m, left, n - left) > most  # at the last column, the distance itself
        out[own[far]] = True
        if far.all():
            break
        if hi < columns and 2 * far.sum() >= len(far):  # pairs that are out of reach go
            stay = ~far
            eq, text, cell, begin, m, n, most, own = eq[stay], text[:, stay], cell[stay], begin[stay], m[stay], n[stay], most[stay], own[stay]
            up, down, full = _number(ups[stay]), _number(downs[stay]), _number(cell)
    return out


def _replaced(a: str, b: str) -> int:
    """Edits that turn one line into the other by inserting one run of words and replacing others at their places: no fewer than the distance."""
    p, q = a.split(" "), b.split(" ")
    if len(p) > len(q):
        p, q = q, p
    longer = len(q) - len(p)
    cost = tail = sum(0 if x == y else max(len(x), len(y)) for x, y in zip(p, q[longer:], strict=True)) + sum(len(x) + 1 for x in q[:longer])
    if not longer:
        return cost
    for i, x in enumerate(p):  # the run moves one word on: word i now meets its own place
        y, z = q[i], q[i + longer]
        tail += (0 if x == y else max(len(x), len(y))) - (0 if x == z else max(len(x), len(z))) + len(z) - len(y)
        cost = min(cost, tail)
    return cost


def similar(a: list[str], b: list[str], least: float) -> np.ndarray:
    """Whether the edit similarity of each pair reaches `least`, as edit_similarity gives it; the distance itself is found only where bounds don't decide."""
    out = np.zeros(len(a), bool)
    held: list[tuple[int, str, str, int]] = []
    for i, (one, two) in enumerate(zip(a, b, strict=True)):
        x, y, most = _trimmed(one, two, least)
        if len(y) <= most:
            out[i] = True
        elif not x or len(y) - len(x) > most:
            continue
        elif _replaced(x, y) <= most:
            out[i] = True
        else:
            held.append((i, x, y, most))
    held.sort(key=lambda h: len(h[2]))
    while held:
        longest = len(held[-1][2])
        step = max(1, SIDE // (longest + 8))
        lo = max(len(held) - step, bisect_right(held, longest * 2 // 3, key=lambda h: len(h[2])))
        some = held[lo:]
        del held[lo:]
        out[[h[0] for h in some]] = ~_apart([h[1] for h in some], [h[2] for h in some], np.array([h[3] for h in some]))
    return out


def minhash_rows(feature: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(BANDS * ROWS, lines) minima over the lines' sets of features; every line must have one."""
    a, b = _seeds(BANDS * ROWS)
    x = (feature >> np.uint64(32)).astype(np.uint32) ^ feature.astype(np.uint32)
    low = np.empty((BANDS * ROWS, len(first) - 1), np.uint32)
    step = max(1, (1 << 17) // max(1, len(x)))
    with np.errstate(over="ignore"):
        for k in range(0, len(a), step):
            y = np.multiply.outer(a[k : k + step], x)
            y += b[k : k + step, None]
            y ^= y >> np.uint32(15)
            low[k : k + step] = np.minimum.reduceat(y, first[:-1], axis=1)
    return low


def minhash_bands(low: np.ndarray) -> np.ndarray:
    """(lines, BANDS) keys of minima."""
    with np.errstate(over="ignore"):
        m = low.reshape(BANDS, ROWS, -1).astype(np.uint64)
        h = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None], m.shape[2], 1)
        for j in range(ROWS):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + m[:, j])
    return h.T.view(np.int64)


def _pairs(word: np.ndarray) -> np.ndarray:
    """A feature for each word and the one after it."""
    with np.errstate(over="ignore"):
        return mix(word[:-1] * np.uint64(7) + word[1:])


def _places(word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each word and its place, whose sums name a line."""
    with np.errstate(over="ignore"):
        place = mix(at.astype(np.uint64) + np.uint64(1))
        return mix(word * np.uint64(3) + place), mix(word ^ (place * np.uint64(5)))


def _long_line(line: str, bands: bool) -> tuple[np.ndarray, ...]:
    """read_lines of one line of any length, slice by slice."""
    size = held = 0
    lo = hi = np.uint64(0)
    low_long = low_all = np.full((BANDS * ROWS, 1), 0xFFFFFFFF, np.uint32)
    last = np.zeros(0, np.uint64)
    for part in slices(line):
        w = split_words([part], zeros=True)
        if not len(w.hash):
            continue
        with np.errstate(over="ignore"):
            one, two = (x.sum(dtype=np.uint64) for x in _places(w.hash, size + np.arange(len(w.hash))))
            lo, hi = lo + one, hi + two
        size += len(w.hash)
        if bands:
            long = w.hash[w.end - w.start >= LONG]
            held += len(long)
            if len(long):
                low_long = np.minimum(low_long, minhash_rows(long, np.array([0, len(long)])))
            if held < MANY:
                every = np.concatenate([w.hash, _pairs(np.concatenate([last, w.hash]))])
                low_all = np.minimum(low_all, minhash_rows(every, np.array([0, len(every)])))
            last = w.hash[-1:]
    keys = [minhash_bands(x).ravel() for x, on in ((low_long, held >= FEW), (low_all, held < MANY and size)) if on and bands]
    key = np.concatenate([np.zeros(0, np.int64), *keys])
    return np.array([size]), np.array([lo], np.uint64).view(np.int64), np.array([hi], np.uint64).view(np.int64), np.zeros(len(key), np.int64), key


def read_lines(text: str, bands: bool = True) -> tuple[np.ndarray, ...]:
    """Words, lo and hi of each line of a text, then line and key: BANDS keys by its longer words, by all words and pairs, or by both."""
    if len(text) > SLICE and "\n" not in text:
        return _long_line(text, bands)
    w = split_lines(text, zeros=True)
    n, size = len(w.first) - 1, np.diff(w.first)
    one, two = _places(w.hash, np.arange(len(w.hash)) - np.repeat(w.first[:-1], size))
    with np.errstate(over="ignore"):
        one, two = (np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (one, two))
        lo, hi = ((x[w.first[1:]] - x[w.first[:-1]]).view(np.int64) for x in (one, two))  # sums by line, modulo 2**64
    line, key = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if bands and len(w.hash):
        long = w.end - w.start >= LONG
        held = np.bincount(w.doc[long], minlength=n)
        few = np.repeat(held < MANY, size)
        pair = np.append(_pairs(w.hash), np.uint64(0))
        last = np.zeros(len(w.hash), bool)
        last[w.first[1:][size > 0] - 1] = True
        take = long & np.repeat(held >= FEW, size)
        for feature, owner in (
            (w.hash[take], w.doc[take]),
            (np.concatenate([w.hash[few], pair[few & ~last]]), np.concatenate([w.doc[few], w.doc[few & ~last]])),
        ):
            if len(feature):
                by = np.argsort(owner, kind="stable")
                own, start = np.unique(owner[by], return_index=True)
                line.append(np.repeat(own, BANDS))
                key.append(minhash_bands(minhash_rows(feature[by], np.append(start, len(by)))).ravel())
    return size, lo, hi, np.concatenate(line), np.concatenate(key)


def _line_runs(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
    """Text index and number of lines, and the lines, joined: in runs that a kernel call can take; a long line comes alone."""
    for lo, hi, whole in portions(texts):
        if whole is not None:
            per = np.array([(t or "").count("\n") + 1 for t in whole])
            yield np.repeat(np.arange(lo, hi), per), np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per), "\n".join(t or "" for t in whole)
            continue
        text, at, number = texts[lo], 0, 0
        while at <= len(text):
            end = text.rfind("\n", at, at + SLICE)  # as many whole lines as fit, or one that does not
            if end < 0:
                end = text.find("\n", at)
            if end < 0 or len(text) - at <= SLICE:
                end = len(text)
            part = text[at:end]
            n = part.count("\n") + 1
            yield np.full(n, lo), np.arange(number, number + n), part
            at, number = end + 1, number + n


def line_table(texts: list[str | None]) -> Iterator[tuple[np.ndarray, ...]]:
    """Text index, line number, lo, hi, and whether the text has it here first, of every line that has a word."""
    for text, number, run in _line_runs(texts):
        size, lo, hi, *_ = read_lines(run, bands=False)
        rows = np.flatnonzero(size > 0)
        text, number, lo, hi = text[rows], number[rows], lo[rows], hi[rows]
        by = np.lexsort((number, hi, lo, text))
        head = np.ones(len(by), bool)
        head[by[1:]] = (lo[by[1:]] != lo[by[:-1]]) | (hi[by[1:]] != hi[by[:-1]]) | (text[by[1:]] != text[by[:-1]])
        yield text, number.astype(np.int32), lo, hi, head


def _repeated(key: np.ndarray) -> np.ndarray:
    """Where the keys are that occur more than once."""
    by = np.argsort(key)
    same = np.flatnonzero(key[by[1:]] == key[by[:-1]])
    on = np.zeros(len(key), bool)
    on[by[same]] = on[by[same + 1]] = True
    return np.flatnonzero(on)


def _runs(key: np.ndarray, ident: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key and ident sorted by key, and for each row the smallest ident and the size of its run."""
    by = np.argsort(key)
    key, ident = key[by], ident[by]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(head)
    size = np.diff(np.append(start, len(key)))
    least = np.minimum.reduceat(ident, start) if len(start) else ident
    return key, ident, np.repeat(least, size), np.repeat(size, size)


def _range(key: np.ndarray, parts: int) -> np.ndarray:
    """The range of unsigned keys, 0 to parts - 1, that each key falls into."""
    return ((key.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _blocks(kind: int, key: np.ndarray, rows: np.ndarray, parts: int) -> pa.RecordBatch:
    """A row for each range of keys that has any: part, kind, and its rows (pairs of numbers) as bytes."""
    part = _range(key, parts)
    by = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")  # short numbers are sorted faster
    part, rows = part[by], rows[by]
    start = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    ends = [*start[1:].tolist(), len(part)]
    blobs = [rows[p:q].tobytes() for p, q in zip(start.tolist(), ends, strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(part[start], pa.int32()), pa.array([kind] * len(start), pa.int32()), pa.array(blobs, pa.binary())], ["part", "kind", "rows"])


def _band_links(texts: DataFrame, parts: int, ranges: int) -> DataFrame:
    """a, b: links of lines (by lo) to the smallest member of each band that they share with another."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, keys, owners, held, lines = [], [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            name, key, owner = np.concatenate(names), np.concatenate(keys), np.concatenate(owners)
            _, one = np.unique(name, return_index=True)  # a line that many texts have goes once
            on = np.zeros(len(name), bool)
            on[one] = True
            on = on[owner]
            key, ident = key[on], name[owner[on]]
            least = ident.copy()
            many = np.sort(key)
            many = np.unique(many[CROWD:][many[CROWD:] == many[: len(many) - CROWD]])
            if len(many):  # crowded bands are linked here; their links need no meeting
                at = many[np.minimum(np.searchsorted(many, key), len(many) - 1)] == key
                crowd, own, first, _ = _runs(key[at], ident[at])
                rest = ~at
                key, ident, least = np.append(key[rest], crowd), np.append(ident[rest], own), np.append(least[rest], first)
            linked = ident != least
            yield _blocks(0, key[~linked], np.stack([key[~linked], ident[~linked]], 1), ranges)
            if linked.any():
                yield _blocks(1, mix(ident[linked].view(np.uint64)), np.stack([ident[linked], least[linked]], 1), ranges)

        for x in batches:
            for _, _, some in _line_runs(x.column(0).to_pylist()):
                _, lo, _, line, key = read_lines(some)
                names.append(lo)
                keys.append(key)
                owners.append(line + lines)
                lines += len(lo)
                held += len(key)
                if held >= HELD:
                    yield from flush()
                    names, keys, owners, held, lines = [], [], [], 0, 0
        if names:
            yield from flush()

    def meet(t: pa.Table) -> Iterator[pa.RecordBatch]:
        kind, blobs = t.column("kind").to_pylist(), t.column("rows")
        links = [np.frombuffer(r.as_buffer(), np.int64).reshape(-1, 2) for k, r in zip(kind, blobs, strict=True) if k == 1]
        met = [np.frombuffer(r.as_buffer(), np.int64).reshape(-1, 2) for k, r in zip(kind, blobs, strict=True) if k == 0]
        if met:
            met = np.concatenate(met)
            met = met[_repeated(met[:, 0].copy())]
            _, ident, least, _ = _runs(met[:, 0].copy(), met[:, 1].copy())
            on = ident != least
            links.append(np.stack([ident[on], least[on]], 1))
        for rows in links:
            for lo in range(0, len(rows), LINKS):
                some = rows[lo : lo + LINKS]
                yield pa.RecordBatch.from_arrays([pa.array(some[:, 0].copy()), pa.array(some[:, 1].copy())], ["a", "b"])

    sent = texts.select("text").mapInArrow(thrifty(spread), "part int, kind int, rows binary")
    return by_group(sent, ["part"], [], meet, "a long, b long", parts)


def _lines_at(docs: DataFrame) -> DataFrame:
    """Rows of a document with `wanted` array<struct<pos, id, ...>> become a row for each wanted line, with its normal form."""
    kinds = dict(docs.dtypes)["wanted"].removeprefix("array<struct<").removesuffix(">>")
    names = [f.split(":")[0] for f in kinds.split(",")]
    schema = ", ".join(f.replace(":", " ", 1) for f in kinds.split(",")) + ", line string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            wanted = x.column(1)
            flat = wanted.flatten()
            lines: list[str] = []
            for text, want in zip(x.column(0), wanted, strict=True):
                held = text.as_py().split("\n")
                lines += [normal_line(held[w["pos"]]) for w in want.as_py()]
            yield pa.RecordBatch.from_arrays([*[flat.field(n) for n in names], pa.array(lines, pa.string())], [*names, "line"])

    return docs.select("text", "wanted").mapInArrow(thrifty(run), schema)


def _profiles(lines: list[str]) -> np.ndarray:
    """(lines, PROFILE) counts of hashed letter triples: an edit changes six of them at most."""
    out = np.zeros(len(lines) * PROFILE, np.int32)
    for i, j, whole in portions(lines):
        for k, part in [(i, whole)] if whole is not None else [(i, [lines[i][p : p + SLICE + 2]]) for p in range(0, len(lines[i]), SLICE)]:
            u = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
            if len(u) < 3:
                continue
            size = np.array([len(x) for x in part])
            of = np.repeat(np.arange(len(part)), size)
            with np.errstate(over="ignore"):
                h = ((u[:-2] * np.uint32(0x9E3779B1) ^ u[1:-1]) * np.uint32(0x85EBCA77) ^ u[2:]) * np.uint32(0xC2B2AE3D) >> np.uint32(23)
            inside = of[2:] == of[:-2]
            out[k * PROFILE : (k + len(part)) * PROFILE] += np.bincount(of[:-2][inside] * PROFILE + h[inside].astype(np.int64), minlength=len(part) * PROFILE).astype(np.int32)
    return out.reshape(len(lines), PROFILE)


def _connect(group: np.ndarray, ident: np.ndarray, known: np.ndarray, side: np.ndarray, lines: list[str], least: float) -> np.ndarray:
    """Links (index pairs) that connect the lines of each group that are similar and share a band; side: 1 and 2 meet, 3 meets all.

    Lines of a group with the same `known` are connected already: one link to the smallest line joins all of them to others.
    """
    n = len(lines)
    order = np.argsort(ident, kind="stable")  # the result does not depend on the order of rows
    group, known, side, lines = group[order], known[order], side[order], [lines[i] for i in order.tolist()]
    of, key = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j, whole in portions(lines):
        *_, line, k = read_lines("\n".join(lines[i:j] if whole is None else whole))
        of.append(line + i)
        key.append(k)
    of, key = np.concatenate(of), np.concatenate(key)
    on = _repeated(key)
    of, key = of[on], key[on]
    by = np.lexsort((of, key, group[of]))
    of, key = of[by], key[by]
    run = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (group[of[1:]] != group[of[:-1]]))) if len(of) else np.zeros(0, np.int64)
    root, seen = np.arange(n), set()
    by = np.lexsort((root, known, group))
    head = np.flatnonzero(np.append(True, (known[by[1:]] != known[by[:-1]]) | (group[by[1:]] != group[by[:-1]])))
    root[by] = np.repeat(by[head], np.diff(np.append(head, n)))
    first = root == np.arange(n)
    size = np.array([len(x) for x in lines], np.int64)
    profile = _profiles(lines)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def hear(x: np.ndarray, y: np.ndarray) -> None:
        """Verify pairs: first one for each two components, then twice as many of those whose components still differ, and so on."""
        x, y = np.minimum(x, y), np.maximum(x, y)
        on = (root[x] != root[y]) & ((side[x] | side[y]) == 3)
        code = np.array([c for c in np.unique(x[on] * n + y[on]).tolist() if c not in seen], np.int64)
        most_each = 1
        while len(code):
            x, y = code // n, code % n
            a, b = root[x], root[y]
            code = code[a != b]
            if not len(code):
                return
            two = (np.minimum(a, b) * n + np.maximum(a, b))[a != b]
            by = np.argsort(two, kind="stable")
            start = np.flatnonzero(np.append(True, two[by[1:]] != two[by[:-1]]))
            nth = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
            now = np.zeros(len(code), bool)
            now[by[nth < most_each]] = True
            verify(code[now])
            code, most_each = code[~now], 2 * most_each

    def verify(code: np.ndarray) -> None:
        for lo in range(0, len(code), 4096):
            some = code[lo : lo + 4096]
            seen.update(some.tolist())
            p, q = some // n, some % n
            longest = np.maximum(size[p], size[q])
            most = (longest * (1 - least) + 1e-9).astype(np.int64)
            near = longest - np.minimum(size[p], size[q]) <= most
            p, q, most = p[near], q[near], most[near]
            near = np.concatenate([np.zeros(0, bool), *[np.abs(profile[p[k : k + 512]] - profile[q[k : k + 512]]).sum(1) <= 6 * most[k : k + 512] for k in range(0, len(p), 512)]])
            p, q = p[near], q[near]
            hit = similar([lines[i] for i in p], [lines[i] for i in q], least)
            for i, j in zip(p[hit].tolist(), q[hit].tolist(), strict=True):
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
        while (root[root] != root).any():
            root[:] = root[root]

    start = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(run) else run
    if len(run):
        hear(np.repeat(of[start], np.diff(np.append(start, len(of)))), of)  # each band's first line with all others
    step = 1
    while len(of) > step:
        start = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        length = np.diff(np.append(start, len(run)))
        split = np.logical_or.reduceat(root[of] != np.repeat(root[of[start]], length), start) & (length > step)
        keep = np.repeat(split, length)
        of, run = of[keep], run[keep]
        if len(of) <= step:
            break
        pair = run[step:] == run[:-step]
        hear(of[:-step][pair], of[step:][pair])
        step += 1
    linked = np.flatnonzero(first & (root != np.arange(n)))
    return order[np.stack([linked, root[linked]], 1)]


def _verify(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Streams groups by (cluster, i, j); many small ones are verified in one go."""
    held: list[pa.Table] = []
    rows = chars = 0

    def flush() -> pa.RecordBatch:
        t = pa.concat_tables(held)
        ident, known, blk = (t.column(c).to_numpy() for c in ("id", "known", "blk"))
        side = (blk == t.column("i").to_numpy()) + 2 * (blk == t.column("j").to_numpy())
        found = _connect(np.repeat(np.arange(len(held)), [x.num_rows for x in held]), ident, known, side, t.column("line").to_pylist(), least)
        return pa.RecordBatch.from_arrays([pa.array(ident[found[:, 0]]), pa.array(ident[found[:, 1]])], ["a", "b"])

    for t in groups(batches, ["cluster", "i", "j"]):
        size = sum(c.nbytes for c in t.column("line").chunks)
        if held and (rows + t.num_rows > LINES or chars + size > CHARS):
            yield flush()
            held, rows, chars = [], 0, 0
        held.append(t)
        rows, chars = rows + t.num_rows, chars + size
    if held:
        yield flush()


def _dealt(lines: DataFrame) -> DataFrame:
    """Lines (cluster, blocks, id, known, line) as members (cluster, i, j, blk, id, known, line) of each pair of blocks that they belong to."""
    blk = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("blk")).alias("i"), F.greatest(o, F.col("blk")).alias("j"))))
    return lines.withColumn("blk", blk).select("cluster", "blk", "id", "known", "line", pair.alias("ij")).select("cluster", "ij.i", "ij.j", "blk", "id", "known", "line")


def _own_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        ident, known, lines = x.column(0).to_numpy(), x.column(1).to_numpy(), x.column(2).to_pylist()
        for i, j, whole in portions(lines):
            *_, of, key = read_lines("\n".join(lines[i:j] if whole is None else whole))
            yield pa.RecordBatch.from_arrays([pa.array(ident[i:j][of]), pa.array(known[i:j][of]), pa.array(key)], ["id", "known", "cluster"])


def _similar_lines(found: DataFrame, least: float, parts: int, scratch: Scratch) -> DataFrame:
    """a, b: ids of similar lines; found: cluster, blocks, id, line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _verify(batches, least)

    def verified(dealt: DataFrame) -> DataFrame:
        return dealt.repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(thrifty(run), "a long, b long")

    blk = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    same = scratch.save(verified(found.select("cluster", blk.alias("i"), blk.alias("j"), blk.alias("blk"), "id", F.col("id").alias("known"), "line")), "same")
    large = found.where("blocks > 1")
    if large.isEmpty():
        return same
    # Each block has linked its lines to the smallest of their group; across blocks, bands in which groups meet are verified.
    large = scratch.save(large.join(same.toDF("id", "b"), "id", "left").select("id", F.coalesce("b", "id").alias("known"), "line"), "large")
    bands = scratch.save(large.select("id", "known", "line").mapInArrow(thrifty(_own_bands), "id long, known long, cluster long"), "bands")
    shared = bands.groupBy("cluster").agg(F.count("*").alias("n"), F.min("known").alias("a"), F.max("known").alias("b")).where("a <> b").select("cluster", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    by_band = bands.select("id", "cluster").join(shared, "cluster").join(large, "id")
    return same.union(scratch.save(verified(_dealt(by_band)), "same"))


def _occurrences(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            doc, row = x.column(0).to_numpy(), x.column(1).to_numpy()
            known: set[tuple[int, int, int]] = set()  # lines of a text that comes in several runs
            before = -1
            for of, pos, lo, hi, head in line_table(x.column(2).to_pylist()):
                if len(of):
                    if of[0] == before:
                        head = head & np.array([k not in known for k in zip(lo.tolist(), hi.tolist(), strict=True)])
                    else:
                        known = set()
                    if of[0] == of[-1]:
                        known.update(zip(lo.tolist(), hi.tolist(), strict=True))
                    before = of[-1]
                yield pa.RecordBatch.from_arrays([pa.array(doc[of]), pa.array(row[of]), pa.array(pos), pa.array(lo), pa.array(hi), pa.array(head)], ["doc", "row", "pos", "lo", "hi", "head"])

    return texts.mapInArrow(thrifty(run), "doc long, row long, pos int, lo long, hi long, head boolean")


def repeated_lines(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id") -> DataFrame:
    """doc, row, gone array<int>: positions of the lines of a text that repeat an earlier occurrence; texts without any are absent."""
    parts = partitions(docs.sparkSession)
    texts = keyed_texts(docs, id_col).where("text is not null")
    with Scratch() as scratch:
        seen = scratch.save(_occurrences(texts.select("doc", "row", "text")), "lines")
        # The first occurrence by document; all of the buffers are numbers, so that this is a hash aggregation. Of texts that share an id and a line, one is taken.
        here = F.when(F.col("head"), F.col("doc"))
        at = F.struct(F.col("doc"), F.col("row"), F.col("pos"))
        first = seen.groupBy("lo", "hi").agg(F.min("doc").alias("doc"), F.min_by("row", here).alias("row"), F.min_by("pos", here).alias("pos"), F.count("*").alias("n"))
        # The table is written once, so the numbers that name its lines from here on are fixed.
        lines = scratch.save(first.select("lo", "hi", at.alias("at"), "n", F.monotonically_increasing_id().alias("id")), "distinct")
        links = _band_links(texts, parts, 4 * parts)
        # Two lines that share lo only widen their cluster.
        clusters = scratch.save(components(links, scratch=scratch).select(F.col("node").alias("lo"), F.col("root").alias("cluster")), "clusters")
        members = lines.join(checked(clusters), "lo")
        sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        members = members.join(sizes, "cluster").select("at.doc", "at.row", F.struct(F.col("at.pos").alias("pos"), "id", "cluster", "blocks").alias("w"))
        wanted = scratch.save(members.groupBy("doc", "row").agg(F.collect_list("w").alias("wanted")), "wanted")
        found = _lines_at(texts.join(wanted, ["doc", "row"])).dropDuplicates(["id"])  # many texts are wanted: both sides are shuffled at any size
        found = scratch.save(found.select("cluster", "blocks", "id", "line"), "found")
        same = _similar_lines(found, least, parts, scratch)
        groups_ = scratch.save(components(same, scratch=scratch).select(F.col("node").alias("id"), F.col("root").alias("grp")), "groups")
        grouped = lines.select("lo", "hi", "at", "n", "id").join(checked(groups_), "id", "left")
        stay = grouped.where("grp is not null").groupBy("grp").agg(F.min("at").alias("stay"))
        keep = grouped.where("grp is not null or n > 1").join(stay, "grp", "left").select("lo", "hi", F.coalesce("stay", "at").alias("stay"))
        keep = scratch.save(keep, "keep")
        gone = seen.select("doc", "row", "pos", "lo", "hi").join(checked(keep), ["lo", "hi"]).where(F.struct("doc", "row", "pos") != F.col("stay"))
        return save_stage(gone.groupBy("doc", "row").agg(F.array_sort(F.collect_set("pos")).alias("gone")), "gone")


def clean(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", counts: tuple[str, str] = ("n_lines", "n_gone")) -> DataFrame:
    """docs with text rid of repeated lines, and two int columns (lines, lines gone) named by `counts`; every row and column stays.

    Names that start with _line_ are reserved.
    """
    gone = repeated_lines(docs, least, id_col)
    # A row's key is computed beside its own columns, under names that documents do not use.
    doc, row = document_keys(id_col)
    keyed = docs.withColumns({"_line_doc": doc, "_line_row": row})
    out = keyed.join(checked(gone.select(F.col("doc").alias("_line_doc"), F.col("row").alias("_line_row"), F.col("gone").alias("_line_gone"))), ["_line_doc", "_line_row"], "left")
    lines = F.split("text", "\n", -1)
    stays = F.filter(lines, lambda x, i: ~F.array_contains(F.col("_line_gone"), i))
    text = F.when(F.col("_line_gone").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n"))
    sizes = dict(zip(counts, (F.coalesce(F.size(lines), F.lit(0)), F.coalesce(F.size("_line_gone"), F.lit(0))), strict=True))
    return out.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], *[v.cast("int").alias(k) for k, v in sizes.items()])
