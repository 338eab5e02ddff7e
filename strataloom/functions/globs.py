"""Globs as regular expressions: the gitignore dialect, plain globs, and checks of patterns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


class BadPattern(ValueError):
    pass


def check_pattern(pattern: str) -> str:
    """At most 1000 characters, no control characters, relative, without a parent step."""
    if len(pattern) > 1000 or any(ord(c) < 32 or ord(c) == 127 for c in pattern):
        raise BadPattern("pattern too long or with control characters")
    if pattern.startswith("/") or re.match(r"[A-Za-z]:[\\/]", pattern) or ".." in re.split(r"[\\/]", pattern):
        raise BadPattern(f"pattern must stay below its root: {pattern}")
    return pattern


def _body(glob: str) -> str:
    """Regex of a glob: `*` and `?` stay within a folder, `**` crosses them, classes and (nested) braces work."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            stars = re.match(r"\*+", glob[i:]).group()
            i += len(stars)
            if len(stars) > 1 and i < len(glob) and glob[i] == "/":
                out.append("(?:.*/)?")
                i += 1
            else:
                out.append(".*" if len(stars) > 1 else "[^/]*")
            continue
        if c == "[" and (end := glob.find("]", i + 2)) > 0:
            inside = glob[i + 1 : end]
            out.append("[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", "\\\\") + "]")
            i = end
        elif c == "?":
            out.append("[^/]")
        elif c == "{" and "}" in glob[i:]:
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def plain_regex(glob: str) -> str:
    return f"^{_body(glob)}$"


def ignore_regex(glob: str) -> str:
    """gitignore: without an inner slash it matches at any depth; a match covers what lies below it."""
    folder = glob.endswith("/")
    bare = glob.rstrip("/")
    anchored = "/" in bare
    start = "^" if anchored else "^(?:.*/)?"
    return start + _body(bare.lstrip("/")) + ("/.*$" if folder else "(?:/.*)?$")


def matches_any(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(ignore_regex(check_pattern(g)))
    return out


def selected(path: Column, include: list[str], ignore: list[str]) -> Column:
    """Included (or nothing is asked for) and not ignored; ignoring wins."""
    inside = matches_any(path, include) if include else F.lit(True)
    return inside & ~matches_any(path, ignore)


@dataclass
class IgnoreRules:
    """Lines of ignore files: comments, negation, anchors, folders only; the last match decides."""

    rules: list[tuple[re.Pattern, bool, bool]] = field(default_factory=list)

    def add(self, text: str, base: str = "") -> None:
        for line in text.splitlines():
            line = line.rstrip("\n").rstrip(" ") if not line.endswith("\\ ") else line
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            body = line[1:] if keep or line.startswith("\\") else line
            only_dir = body.endswith("/")
            body = body.rstrip("/")
            anchored = "/" in body
            prefix = re.escape(base + "/") if base else ""
            pattern = f"^{prefix}" + ("" if anchored else "(?:.*/)?") + _body(body.lstrip("/")) + "$"
            self.rules.append((re.compile(pattern), keep, only_dir))

    def ignored(self, path: str, is_dir: bool) -> bool:
        state = False
        for pattern, keep, only_dir in self.rules:
            if (is_dir or not only_dir) and pattern.match(path):
                state = not keep
        return state
