"""Changed files, statistics and history of a git repository, as DataFrames."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import DataFrame, SparkSession


class GitError(RuntimeError):
    pass


def check_ref(ref: str) -> str:
    """A plain revision name: no option, no range, no shell or control characters."""
    if not re.fullmatch(r"(?!-)[A-Za-z0-9_./~^@{}+\-]{1,256}", ref) or ".." in ref:
        raise GitError(f"not a revision: {ref!r}")
    return ref


def _git(repo: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, timeout=300)
    if done.returncode:
        raise GitError(done.stderr.strip().splitlines()[-1][:200] if done.stderr.strip() else "git failed")
    return done.stdout


def repository_root(path: str) -> str:
    return _git(path, "rev-parse", "--show-toplevel").strip()


def changed_files(spark: SparkSession, repo: str, old: str, new: str) -> DataFrame:
    """path of every file that differs between two revisions."""
    names = _git(repo, "diff", "--name-only", "-z", check_ref(old), check_ref(new)).split("\0")
    return spark.createDataFrame([(n,) for n in names if n and not n.startswith("/") and ".." not in n.split("/")], "path string")


def numstat(spark: SparkSession, repo: str, old: str, new: str) -> DataFrame:
    """path, insertions, deletions as texts; `-` for binary files."""
    rows = [line.split("\t", 2) for line in _git(repo, "diff", "--numstat", check_ref(old), check_ref(new)).splitlines()]
    return spark.createDataFrame([(p, a, b) for a, b, p in rows], "path string, insertions string, deletions string")


def history(spark: SparkSession, repo: str, depth: int = 3) -> DataFrame:
    """path, ord (1 is the newest), message, author of the last `depth` commits that touch each file."""
    log = _git(repo, "log", "--name-only", "--format=%x01%an%x02%s")
    seen: dict[str, int] = {}
    rows = []
    for block in log.split("\x01")[1:]:
        head, *paths = block.split("\n")
        author, message = head.split("\x02", 1)
        for p in filter(None, paths):
            seen[p] = seen.get(p, 0) + 1
            if seen[p] <= depth:
                rows.append((p, seen[p], message, author))
    return spark.createDataFrame(rows, "path string, ord int, message string, author string")


def parse_repository_url(url: str) -> tuple[str, str]:
    """(owner, name) of a web address of a repository."""
    m = re.fullmatch(r"https?://[^/\s]+/([A-Za-z0-9_.\-]+)/([A-Za-z0-9_.\-]+?)(?:\.git)?/?", url)
    if not m or ".." in m[1] + m[2]:
        raise GitError(f"not a repository address: {url}")
    return m[1], m[2]


def fetch(url: str, target: str) -> str:
    """A shallow copy of a repository (http, https, file:// or a local path) in the target folder."""
    if not url.startswith("file://") and "://" in url:
        parse_repository_url(url)
    source = url if "://" in url else f"file://{url}"
    done = subprocess.run(["git", "clone", "-q", "--depth", "1", "--", source, target], capture_output=True, text=True, timeout=600)
    if done.returncode:
        raise GitError(done.stderr.strip()[-200:])
    return target
