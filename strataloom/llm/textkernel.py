"""Vectorised word and character hashing over texts in slices of bounded size, without a Python object per word.

A word is a run of letters and digits, lower-cased; a run longer than LONGEST characters counts
as several words of that length and a rest. So every text can be cut into slices that hold whole
words, and no kernel call ever sees more than about SLICE characters, whatever a text's length.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .common import words as mix

#: Characters of a kernel call, about; and the longest word.
SLICE, LONGEST = 1 << 17, 1 << 16

_P = np.uint64(0x9E3779B97F4A7C15)
_tables: dict[str, np.ndarray] = {}


def _inverse(odd: int) -> int:
    x = odd
    for _ in range(6):
        x = x * (2 - odd * x) % (1 << 64)
    return x


def class_table(name: str) -> np.ndarray:
    """Per code point: 'word' = letter, digit or mark that str.isalnum accepts; 'letter' = str.isalpha."""
    if name not in _tables:
        test = str.isalnum if name == "word" else str.isalpha
        _tables[name] = np.fromiter((test(chr(c)) for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _tables[name]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    held = _tables.get("powers")
    if held is None or held.shape[1] < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            up = np.full(size, _P, np.uint64)
            up[0] = 1
            down = np.full(size, np.uint64(_inverse(int(_P))), np.uint64)
            down[0] = 1
            held = _tables["powers"] = np.stack([np.multiply.accumulate(up), np.multiply.accumulate(down)])
    return held[0], held[1]


def fold(text: str) -> str:
    """Lower case, letter by letter: the same wherever a text is cut, and of the same length."""
    if not text.isascii():
        text = text.replace("İ", "i").replace("Σ", "σ")
    return text.lower()


@dataclass
class Words:
    hash: np.ndarray  #: 64 bits for each word
    start: np.ndarray  #: first code point of each word, in the joined batch
    end: np.ndarray
    doc: np.ndarray  #: index of each word's text
    first: np.ndarray  #: n + 1 offsets of the texts in the word arrays
    prefix: list[np.ndarray]  #: hashes of the first characters, for each length asked for


def code_points(texts: list[str | None], zeros: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the folded texts joined by NUL (a NUL inside becomes a space), and n + 1 offsets; with `zeros`, 1 to 9 become 0."""
    clean = [fold("" if t is None else t).replace("\0", " ") for t in texts]
    u = np.frombuffer(("\0".join(clean) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    if zeros:
        u = np.where((u > 48) & (u < 58), np.uint32(48), u)
    first = np.zeros(len(clean) + 1, np.int64)
    first[1:] = np.flatnonzero(u == 0) + 1 if clean else []
    return u, first


def cuts(text: str, most: int = 0) -> list[int]:
    """0, the places where slices of at most `most` (SLICE) characters begin, and the length; every slice holds whole words.

    Inside a run of letters and digits, places are whole multiples of LONGEST from its beginning.
    """
    most = max(most or SLICE, LONGEST)
    out, at = [0], 0
    while len(text) - at > most:
        stop = at + most
        low = max(at, stop - LONGEST)
        p = stop
        while p > low and text[p - 1].isalnum():
            p -= 1
        if p == low:  # a long run: where did it begin, counted from this slice's start?
            while p > at and text[p - 1].isalnum():
                p -= 1
            p += (stop - p) // LONGEST * LONGEST
        at = p
        out.append(at)
    return [*out, len(text)]


def portions(texts: list[str | None], most: int = 0) -> Iterator[tuple[int, int, list[str | None] | None]]:
    """(lo, hi, texts[lo:hi]) for runs of texts that a kernel call can take whole, (i, i + 1, None) for a text that has to be cut."""
    most = max(most or SLICE, LONGEST)
    lo, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "") + 1
        if held and held + n > most:
            yield lo, i, texts[lo:i]
            lo, held = i, 0
        if n > most + 1:
            yield i, i + 1, None
            lo = i + 1
        else:
            held += n
    if lo < len(texts):
        yield lo, len(texts), texts[lo:]


def slices(text: str) -> Iterator[str]:
    """The text in slices of whole words."""
    at = cuts(text)
    for lo, hi in zip(at, at[1:], strict=False):
        yield text[lo:hi]


def split_lines(text: str, zeros: bool = False) -> Words:
    """The words of each line of a text (or of several, joined by line feeds), without a string for each line; with `zeros`, digits are 0."""
    u = np.frombuffer((fold(text) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    if zeros:
        u = np.where((u > 48) & (u < 58), np.uint32(48), u)
    return _words(u, np.append(0, np.flatnonzero(u == 10) + 1), ())


def _split_long(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = -(-(end - start) // LONGEST)
    nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(start, parts) + nth * LONGEST
    return begin, np.minimum(begin + LONGEST, np.repeat(end, parts))


def split_words(texts: list[str | None], prefix: tuple[int, ...] = (), zeros: bool = False) -> Words:
    """The words of each text, hashed by a polynomial in 64 bits and mixed."""
    return _words(*code_points(texts, zeros), prefix)


def _words(u: np.ndarray, first: np.ndarray, prefix: tuple[int, ...]) -> Words:
    inside = class_table("word")[u]
    if len(u):
        edge = np.flatnonzero(np.concatenate([inside[:1], inside[1:] != inside[:-1], inside[-1:]]))  # words begin and end in turn
    else:
        edge = np.zeros(0, np.int64)
    start, end = edge[::2], edge[1::2]
    if len(start) and int((end - start).max()) > LONGEST:
        start, end = _split_long(start, end)
    up, down = _powers(len(u) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(u) + 1, np.uint64)
        np.add(u, np.uint64(1), out=total[1:])
        total[1:] *= up[: len(u)]
        np.cumsum(total[1:], out=total[1:])
        h = mix((total[end] - total[start]) * down[start])
        short = [mix((total[np.minimum(start + n, end)] - total[start]) * down[start] + np.uint64(77 + n)) for n in prefix]
    offsets = np.searchsorted(start, first)
    return Words(h, start, end, np.repeat(np.arange(len(first) - 1), np.diff(offsets)), offsets, short)


def shingle(word: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word runs of each text, and n + 1 offsets; a text with 1 to n - 1 words gives one run of them all."""
    counts = np.diff(first)
    size = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    at = np.repeat(first[:-1] - out[:-1], size) + np.arange(out[-1])
    left = np.repeat(np.minimum(counts, n), size)
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            here = k < left
            step = word[np.where(here, at + k, 0)] if len(word) else np.zeros(len(at), np.uint64)
            h = np.where(here, (h + step) * _P + np.uint64(k + 1), h)
    return mix(h), out


def shingle_set(text: str, n: int) -> np.ndarray:
    """The sorted distinct run hashes of one text of any length, slice by slice."""
    held: list[np.ndarray] = []
    carry = np.zeros(0, np.uint64)
    for part in slices(text):
        word = np.concatenate([carry, split_words([part]).hash])
        if len(word) >= n:
            held.append(np.unique(shingle(word, np.array([0, len(word)]), n)[0]))
            word = word[len(word) - n + 1 :]
        carry = word
        if sum(map(len, held[1:])) > len(held[0]) if held else False:
            held = [np.unique(np.concatenate(held))]
    if not held:
        held = [shingle(carry, np.array([0, len(carry)]), n)[0]]
    return np.unique(np.concatenate(held))
