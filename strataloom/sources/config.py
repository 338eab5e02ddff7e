"""Settings from TOML files and call arguments, and the token budget that follows from them."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

#: Tokens that a model of each family reads by default.
TOOL_TOKENS = {"large": 1_000_000, "medium": 200_000, "small": 4_096}
RESERVE = 1000
NAMES = (".strataloom.toml", ".strataloomrc.toml")


@dataclass
class Settings:
    paths: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    priorities: list[tuple[str, float]] = field(default_factory=list)
    max_tokens: int | None = None
    tool_tokens: dict[str, int] = field(default_factory=dict)
    tool: str = "large"
    prompt: str | None = None
    semantic_depth: int = 2
    imports: bool = False
    callers: bool = False
    types: bool = False
    format: str = "markdown"
    history: int = 0  #: commits of each file to show

    def check(self) -> Settings:
        if self.format not in ("markdown", "xml", "plain", "paths"):
            raise ValueError(f"unknown format {self.format}")
        if self.max_tokens is not None and self.max_tokens <= 0:
            raise ValueError("max_tokens must be positive")
        if not 0 <= self.semantic_depth <= 10:
            raise ValueError("semantic_depth must be 0 to 10")
        return self

    @property
    def directories(self) -> list[str]:
        return self.paths or ["."]

    def budget(self) -> int | None:
        """Given tokens, else with a prompt the tool's from the file or the default one; less prompt and reserve."""
        total = self.max_tokens
        if total is None and self.prompt is not None:
            total = self.tool_tokens.get(self.tool, TOOL_TOKENS.get(self.tool))
        if total is None:
            return None
        used = -(-len(self.prompt.encode()) // 4) + RESERVE if self.prompt is not None else 0
        return max(0, total - used)


def find_config(folder: str = ".", home: str | None = None) -> str | None:
    places = [Path(folder, n) for n in NAMES] + [Path(home or Path.home(), n) for n in NAMES]
    return next((str(p) for p in places if p.is_file()), None)


def load(path: str | None, **given) -> Settings:
    """A file's settings under the given ones; lists that are given replace the file's."""
    raw = tomllib.loads(Path(path).read_text()) if path else {}
    base = dict(raw.get("defaults", {}))
    base |= {k: raw[k] for k in ("include", "ignore") if k in raw}
    if "priorities" in raw:
        base["priorities"] = [(p["pattern"], float(p["weight"])) for p in raw["priorities"]]
    if "tokens" in raw:
        base["tool_tokens"] = raw["tokens"]
    known = set(Settings.__dataclass_fields__)
    if unknown := set(base) - known:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return Settings(**(base | {k: v for k, v in given.items() if v not in (None, [])})).check()
