"""Source text without comments and string contents, line structure kept."""

from __future__ import annotations

import re

_C_LIKE = re.compile(
    r"""(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<raw>r(?P<h>\#*)".*?"(?P=h))|(?P<text>"(?:\\.|[^"\\\n])*"?)|(?P<tick>`(?:\\.|[^`\\])*`?)|(?P<char>'(?:\\.[^']{0,8}|[^'\\\n])')""",
    re.S | re.X,
)
_QUOTED = re.compile(_C_LIKE.pattern.replace("""'(?:\\\\.[^']{0,8}|[^'\\\\\\n])'""", """'(?:\\\\.|[^'\\\\\\n])*'?"""), re.S | re.X)


def blank(source: str, single_quotes: bool = False, keep_text: bool = False) -> str:
    """Comments and strings become spaces; with keep_text quoted strings stay. single_quotes: they hold strings, not characters."""

    def cover(m: re.Match) -> str:
        if keep_text and m.lastgroup in ("text", "char"):
            return m.group()
        return re.sub(r"[^\n]", " ", m.group())

    return (_QUOTED if single_quotes else _C_LIKE).sub(cover, source)


class Lines:
    """Line numbers (from 1) of places in a text."""

    def __init__(self, source: str):
        self.breaks = [m.start() for m in re.finditer("\n", source)]

    def at(self, place: int) -> int:
        lo, hi = 0, len(self.breaks)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.breaks[mid] < place:
                lo = mid + 1
            else:
                hi = mid
        return lo + 1
