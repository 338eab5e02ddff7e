"""Exact ids of the byte-level vocabulary, by the faster of two public libraries with the same ranks."""

from __future__ import annotations

import base64
import json
import re
from functools import cached_property

import numpy as np
import public_tokenizers

_held: dict[str, object] = {}

#: Characters on which the two libraries' splitting patterns may disagree go to the slower library: whatever is outside the common blocks.
_COMMON = re.compile(r"[\t\n\r -~¡-ɏͰ-ϿЀ-ҁҊ-ԯ‐-‧‰-⁞₠-₵ぁ-ゖァ-ヺ一-龥가-힣]*\Z")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    return public_tokenizers.path(name)


class ByteEncoder:
    """ids(text) as tokenizers gives them with add_special_tokens=False: the end-of-text string is its special id."""

    def __init__(self, path: str, ranks_path: str | None = None):
        with open(path, encoding="utf-8") as f:
            self.special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.path = path
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def slow(self):
        from tokenizers import Tokenizer

        held = Tokenizer.from_file(self.path)
        held.no_truncation()
        held.no_padding()
        return held

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is None or not _COMMON.match(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        if self.cut is None or not any(s in text for s in self.special):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        parts = [np.array([self.special[p]] if p in self.special else self.fast.encode_ordinary(p), np.uint32) for p in self.cut.split(text) if p]
        return np.concatenate(parts)


def byte_encoder(name: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken") -> ByteEncoder:
    """One encoder for each Python worker."""
    if name not in _held:
        _held[name] = ByteEncoder(vocabulary(name), vocabulary(ranks) if ranks else None)
    return _held[name]
