"""BPE encoding by dynamic programming over prefixes, and decoding.

The encoding of every prefix of a word ends in one certain token. An automaton over the
vocabulary follows the word; its suffix links list all tokens that end at a position. Of
these exactly one forms a compatible pair with the token stored for the prefix before it:
no merge across their border would come before the merges that build them. That token is
stored, and back-pointers from the last position give the exact ids.

Null and empty texts have no ids. Texts of any length are encoded whole, in slices that begin
before white space; words are cut by the vocabulary's own normaliser and pattern, with a plain
path for Latin text. Memory is bounded by word and pair memos that restart when full. Repeated
rows are encoded as they come. An empty table gives no rows; columns other than the id and the
text stay behind, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import thrifty

#: Entries of the word memo and of the pair memo of a worker; longer words (LONG characters) are not remembered.
WORDS, PAIRS, LONG = 300_000, 1_000_000, 64
#: Characters that are cut into words at once, about.
SLICE = 1 << 17

_END = "</w>"
#: Texts of these characters only need no normaliser but lower case, and their classes are the ones spelled out in _LATIN_WORD.
_LATIN = re.compile(r"[\t\n\r -~¡-¬®-ÿ]*\Z")
_LATIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PrefixBpe:
    """Vocabulary, merges and the automaton. Base symbols: a letter, or a letter with the end-of-word mark."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = _END):
        self.end = end
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        spelled: dict[int, tuple] = {}
        for token, i in vocab.items():
            if len(token) == 1:
                spelled[i] = (token,)
            elif end and len(token) == 1 + len(end) and token.endswith(end):
                spelled[i] = (token,)
        self.base = {s[0]: i for i, s in spelled.items()}
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if z in self.halves or x not in spelled or y not in spelled:
                raise ValueError(f"merge {a} {b}: a token has one merge, after those of its halves")
            self.rank[x, y], self.halves[z], self.made[z] = r, (x, y), r
            spelled[z] = spelled[x] + spelled[y]
        self.step: list[dict[str, int]] = [{}]
        token: list[int] = [-1]
        for i, symbols in spelled.items():
            at = 0
            for s in symbols:
                if s not in self.step[at]:
                    self.step[at][s] = len(self.step)
                    self.step.append({})
                    token.append(-1)
                at = self.step[at][s]
            token[at] = i
        fail, self.ends = [0] * len(self.step), [()] * len(self.step)
        queue = [0]
        for at in queue:
            own = ((token[at], len(spelled[token[at]])),) if token[at] >= 0 else ()
            self.ends[at] = own + (self.ends[fail[at]] if at else ())
            for s, to in self.step[at].items():
                up = fail[at]
                while at and s not in self.step[up] and up:
                    up = fail[up]
                fail[to] = self.step[up].get(s, 0) if at else 0
                queue.append(to)
        self.fail = fail
        self.size = {i: len(symbols) for i, symbols in spelled.items()}
        self.pairs: dict[tuple[int, int], bool] = {}

    def _chain(self, token: int, side: int) -> list[tuple[int, float]]:
        """The symbols at one border of a token as it is built, each with the rank at which it is used up."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in self.halves:
                return out
            until = self.made[token]
            token = self.halves[token][side]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of left's and right's text together is just these two.

        A merge over the border happens if its two symbols stand there at its turn: before
        the left one is used up, and no later than the right one (equal ranks go left to right).
        """
        key = (left, right)
        held = self.pairs.get(key)
        if held is None:
            rank, held = self.rank, True
            ends = self._chain(right, 0)
            for a, a_until in self._chain(left, 1):
                for b, b_until in ends:
                    r = rank.get((a, b))
                    if r is not None and r < a_until and r <= b_until:
                        held = False
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = held
        return held

    def encode_symbols(self, symbols: Iterable[str], many: bool = False) -> list[int] | array:
        """The ids of one word; with `many` symbols the stored tokens and the ids take four bytes each."""
        last = array("i", [-1]) if many else [-1]
        step, fail, ends, at, i = self.step, self.fail, self.ends, 0, 0
        for s in symbols:
            i += 1
            while at and s not in step[at]:
                at = fail[at]
            at = step[at].get(s, 0)
            for token, n in ends[at]:
                if i == n or self.compatible(last[i - n], token):
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends with {s!r}")
        out, size = array("i") if many else [], self.size
        while i:
            token = last[i]
            out.append(token)
            i -= size[token]
        out.reverse()
        return out

    def encode_word(self, word: str) -> list[int] | array:
        """word: byte-level letters; the last one takes the end mark."""
        base = self.base
        if len(word) > LONG:
            return self.encode_symbols((s for s in chain(islice(word, len(word) - 1), [word[-1] + self.end]) if s in base), True)
        symbols = [*word[:-1], word[-1] + self.end]
        return self.encode_symbols([s for s in symbols if s in base])


class WordEncoder:
    """encode and decode as the tokenizers library does with this file, without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.bpe = PrefixBpe(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.text = [""] * (max(max(model["vocab"].values()), *self.special.values()) + 1)
        for t, i in (model["vocab"] | self.special).items():
            self.text[i] = t
        self.number = [str(i) for i in range(len(self.text))]
        letters = byte_letters()
        self.letters = {b: letters[b] for b in range(256)}
        self.words: dict[str, tuple[int, ...]] = {}

    def _word(self, word: str, byte_level: bool) -> tuple[int, ...] | array:
        if not byte_level:
            word = word.encode().decode("latin-1").translate(self.letters)
        ids = self.bpe.encode_word(word)
        return ids if len(word) > LONG else tuple(ids)

    def _plain(self, text: str) -> Iterator[list[int]]:
        if _LATIN.match(text):
            cut, mark = _LATIN_WORD.findall(text.lower()), ""
        else:
            normal = self.library.normalizer.normalize_str(text)
            cut, mark = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)], "\0"
        memo = self.words
        if len(memo) > WORDS:
            memo.clear()
        if mark:  # byte-level words have a memo key of their own
            cut = list(map(mark.__add__, cut))
        long = False
        for w in set(cut).difference(memo):  # long words are never in it
            if len(w) <= LONG:
                memo[w] = self._word(w[len(mark) :], bool(mark))
            else:
                long = True
        if not long:
            yield list(chain.from_iterable(map(memo.__getitem__, cut)))
            return
        out: list[int] = []
        for w in cut:
            if len(w) <= LONG:
                out += memo[w]
                continue
            yield out
            ids, out = self._word(w[len(mark) :], bool(mark)), []
            for k in range(0, len(ids), SLICE):
                yield list(ids[k : k + SLICE])
        yield out

    def pieces(self, text: str | None) -> Iterator[list[int]]:
        """The ids of a text, slice by slice; slices begin before white space, which no word and no composed letter spans."""
        if not text:
            return
        for part in self.cut.split(text) if "<|" in text else [text]:
            if part in self.special:
                yield [self.special[part]]
                continue
            at = 0
            while len(part) - at > SLICE:
                stop = max(part.rfind(c, at + 1, at + SLICE) for c in " \n\t")
                if stop < 0:
                    stop = min((p for c in " \n\t" if (p := part.find(c, at + SLICE)) >= 0), default=len(part))
                yield from self._plain(part[at:stop])
                at = stop
            yield from self._plain(part[at:] if at else part)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.pieces(text)))

    def decode(self, ids: list[int]) -> str:
        """The file has no decoder: the tokens as they are written, joined by one space."""
        return " ".join(map(self.text.__getitem__, ids))

    def numbers(self, ids: list[int]) -> str:
        return " ".join(map(self.number.__getitem__, ids))


_held: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker."""
    if path not in _held:
        _held[path] = WordEncoder(path)
    return _held[path]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ids array<int> of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(path)
        for b in batches:
            ids = pa.array([enc.encode(t.as_py()) for t in b.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(thrifty(run), f"{id_col} {dict(df.dtypes)[id_col]}, ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """id_col and the decoded text of ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(path)
        for b in batches:
            texts = pa.array([None if t is None else enc.decode(t) for t in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], [id_col, "text"])

    return df.select(id_col, "ids").mapInArrow(thrifty(run), f"{id_col} {dict(df.dtypes)[id_col]}, text string")


def round_trip_digest(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass over each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(path)
        for b in batches:
            n, i, d = [], [], []
            for t in b.column(1):
                count, digests = 0, (hashlib.sha256(), hashlib.sha256())
                for ids in enc.pieces(t.as_py()):
                    if not ids:
                        continue
                    for digest, own in zip(digests, (enc.numbers(ids), enc.decode(ids)), strict=True):
                        if count:
                            digest.update(b" ")
                        digest.update(own.encode("utf-8", "surrogatepass"))
                    count += len(ids)
                n.append(count)
                i.append(digests[0].hexdigest())
                d.append(digests[1].hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").mapInArrow(thrifty(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
