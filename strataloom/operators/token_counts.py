"""Token counts by a real vocabulary, beside the offline estimate of functions.columns.tokens."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts whose counts a worker remembers, and characters that are encoded at once.
MEMO, SLICE = 10_000, 1 << 17

_held: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _held:
        from tokenizers import Tokenizer

        held = Tokenizer.from_file(path)
        held.no_truncation()
        held.no_padding()
        _held[path] = held
    return _held[path]


def count_text(text: str | None, path: str) -> int:
    """Tokens of a text of any length: it is cut before a line break that follows a letter, which no token of a byte-level vocabulary spans."""
    if not text:
        return 0
    tok, total, at = _tokenizer(path), 0, 0
    while len(text) - at > SLICE:
        stop = text.rfind("\n", at + 1, at + SLICE)
        while stop > at and not (text[stop - 1].isalpha() and text[stop + 1].isalpha()):
            stop = text.rfind("\n", at + 1, stop)
        if stop <= at:
            break
        total += len(tok.encode(text[at:stop], add_special_tokens=False).ids)
        at = stop
    return total + len(tok.encode(text[at:], add_special_tokens=False).ids)


def with_token_counts(df: DataFrame, path: str, text: str = "content", name: str = "tokens") -> DataFrame:
    """df with a bigint column of the text's tokens in the vocabulary file; a null text has none. Equal texts are counted once while a worker remembers them."""
    columns = [c for c in df.columns if c != name]
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: OrderedDict[str, int] = OrderedDict()
        for b in batches:
            out = []
            for x in b.column(len(columns)):
                t = x.as_py()
                n = memo.get(t) if t is not None else 0
                if n is None:
                    n = count_text(t, path)
                    if len(t) < 4096:
                        memo[t] = n
                        if len(memo) > MEMO:
                            memo.popitem(last=False)
                out.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(out, pa.int64())], [*columns, name])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + f", `{name}` bigint"
    return df.select(*columns, F.col(text).alias("_text_to_count")).mapInArrow(run, schema)
