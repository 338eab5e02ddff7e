"""Scan a folder of source files into the corpus model, honouring ignore files.

The driver lists paths, many folders at a time (ignored folders are never entered); globs and
binary extensions are settled there, before anything is read. Executors read contents in tasks
that hold about equal bytes, as Arrow batches of bounded bytes; without `content` they read
nothing. Contents must be UTF-8; other files become rows with an error and no content. On a
cluster the folder must be one that all executors can read.
"""

from __future__ import annotations

import os
import re
import stat
import subprocess
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.columns import base_priority, custom_priority, file_type, is_binary_content
from ..functions.globs import IgnoreRules, check_pattern, ignore_regex
from ..schema import BINARY_EXTENSIONS, FILE_TYPES, FILES, MAX_FILE_BYTES

IGNORE_FILES = (".gitignore", ".ignore", ".corpusignore")
#: Files that mark the root of a project.
MARKERS = ("Cargo.toml", "package.json", "pyproject.toml", "setup.py", "go.mod", "Package.swift", "pom.xml", "build.gradle", "Makefile", "README.md")
TASK_BYTES, BATCH_BYTES = 32 << 20, 4 << 20
#: Folders that are listed at once.
LISTERS = 16


@dataclass
class ScanOptions:
    include: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    hidden: bool = False
    follow_links: bool = False
    use_ignore_files: bool = True
    max_bytes: int = MAX_FILE_BYTES
    skip_binary: bool = False
    rules: list[tuple[str, float]] = field(default_factory=list)


def project_root(start: str) -> str:
    """The nearest folder above with .git, else with a marker file, else the start."""
    here = Path(start).resolve()
    here = here if here.is_dir() else here.parent
    ups = [here, *here.parents]
    return str(next((p for p in ups if (p / ".git").exists()), None) or next((p for p in ups if any((p / m).exists() for m in MARKERS)), here))


def _global_ignores() -> str:
    """The text of git's global ignore file, if there is one."""
    try:
        named = subprocess.run(["git", "config", "--global", "--get", "core.excludesFile"], capture_output=True, text=True, timeout=10).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        named = ""
    home = Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config")
    place = Path(named).expanduser() if named else home / "git/ignore"
    return place.read_text(errors="replace") if place.is_file() else ""


def _own_rules(folder: str, names: tuple[str, ...] = IGNORE_FILES) -> list[tuple[str, str]]:
    """(text, folder) of the ignore files of a folder, in the order in which later ones win."""
    found = [os.path.join(folder, n) for n in names]
    return [(Path(f).read_text(errors="replace"), folder) for f in found if os.path.isfile(f)]


def _rules_above(top: Path) -> list[tuple[str, str]]:
    """Rules that hold before the folder's own: git's global ones, those of the repository, and those of the folders between."""
    ups = [top, *top.parents]
    home = next((p for p in ups if (p / ".git").exists()), None)
    if home is None:
        return [(_global_ignores(), str(top))]
    out = [(_global_ignores(), str(home))]
    exclude = home / ".git/info/exclude"
    if exclude.is_file():
        out.append((exclude.read_text(errors="replace"), str(home)))
    for p in reversed(ups[1 : ups.index(home) + 1]):
        out += _own_rules(str(p))
    return out


def list_files(root: str, options: ScanOptions) -> list[tuple[str, str, int]]:
    """(path, relative path, size) in path order; ignored, hidden (unless asked for) and oversize files are left out, and what the globs say."""
    top = Path(root)
    if top.is_file():
        return [(str(top), top.name, top.stat().st_size)]
    if not top.is_dir():
        raise FileNotFoundError(root)
    include, ignore = ([re.compile(ignore_regex(check_pattern(p))) for p in ps] for ps in (options.include, options.ignore))
    base = os.path.abspath(top)

    def wanted(rel: str) -> bool:
        if options.skip_binary and rel.rsplit("/", 1)[-1].rpartition(".")[2].lower() in BINARY_EXTENSIONS and "." in rel.rsplit("/", 1)[-1][1:]:
            return False
        return (not include or any(p.match(rel) for p in include)) and not any(p.match(rel) for p in ignore)

    def one(task: tuple[str, str, IgnoreRules]) -> tuple[list[tuple[str, str, int]], list[tuple[str, str, IgnoreRules]]]:
        folder, at, above = task
        rules, files, folders = above, [], []
        if options.use_ignore_files and (own := _own_rules(folder)):
            rules = IgnoreRules([*above.rules])
            for text, place in own:
                rules.add(text, place.strip("/"))
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            if entry.name == ".git" or (entry.name.startswith(".") and not options.hidden):
                continue
            if entry.is_symlink() and not options.follow_links:
                continue
            is_dir, rel = entry.is_dir(), f"{at}/{entry.name}" if at else entry.name
            if rules.ignored(os.path.join(folder, entry.name).strip("/"), is_dir):
                continue
            if is_dir:
                folders.append((entry.path, rel, rules))
            elif stat.S_ISREG((s := entry.stat()).st_mode) and s.st_size <= options.max_bytes and wanted(rel):
                files.append((os.path.join(str(top), rel), rel, s.st_size))
        return files, folders

    rules = IgnoreRules()
    if options.use_ignore_files:
        for text, place in _rules_above(Path(base)):
            rules.add(text, place.strip("/"))
    found: list[tuple[str, str, int]] = []
    with ThreadPoolExecutor(LISTERS) as pool:
        level = [(base, "", rules)]
        while level:
            done = list(pool.map(one, level))
            found += [f for files, _ in done for f in files]
            level = [t for _, folders in done for t in folders]
    return sorted(found, key=lambda f: f[1])


def _read(path: str) -> tuple[str | None, str | None]:
    try:
        return Path(path).read_bytes().decode("utf-8"), None
    except (OSError, UnicodeDecodeError) as e:
        return None, f"{type(e).__name__}: {e}"[:300]


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, str, int]]):
        super().__init__(len(files))
        self.files = files


class CorpusSource(DataSource):
    """spark.read.format("corpus").load(folder), after spark.dataSource.register(CorpusSource)."""

    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return "path string, relative_path string, size bigint, content string, error string"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        split = lambda k: [p for p in o.get(k, "").split("\n") if p]
        options = ScanOptions(include=split("include"), ignore=split("ignore"), hidden=o.get("hidden") == "true", max_bytes=int(o.get("maxBytes", MAX_FILE_BYTES)), skip_binary=o.get("skipBinary") == "true")
        return _CorpusReader(o["path"], options, o.get("content", "true") == "true")


class _CorpusReader(DataSourceReader):
    def __init__(self, root: str, options: ScanOptions, content: bool):
        self.root, self.options, self.content = root, options, content

    def partitions(self) -> list[InputPartition]:
        parts, held, size = [], [], 0
        for f in list_files(self.root, self.options):
            held.append(f)
            size += f[2]
            if size >= TASK_BYTES:
                parts.append(_Files(held))
                held, size = [], 0
        return [*parts, _Files(held)] if held or not parts else parts

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for path, rel, size in partition.files:
            content, error = _read(path) if self.content else (None, None)
            rows.append((path, rel, size, content, error))
            held += size if self.content else 64
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "relative_path", "size", "content", "error"])


def scan(spark: SparkSession, root: str, options: ScanOptions | None = None, content: bool = True) -> DataFrame:
    """The files of a folder as FILES rows; globs select, rules add to priorities. Without `content`, that column is null and no file is opened.

    skip_binary leaves out binary extensions (unread) and texts with a NUL near their beginning.
    """
    o = options or ScanOptions()
    spark.dataSource.register(CorpusSource)
    flag = lambda x: str(x).lower()
    reader = spark.read.format("corpus").option("hidden", flag(o.hidden)).option("maxBytes", str(o.max_bytes)).option("skipBinary", flag(o.skip_binary)).option("content", flag(content))
    files = reader.option("include", "\n".join(o.include)).option("ignore", "\n".join(o.ignore)).load(root)
    if o.skip_binary:
        files = files.where(~F.coalesce(is_binary_content(F.col("content")), F.lit(False)))
    files = files.withColumn("file_type", file_type(F.col("relative_path")))
    priority = custom_priority(base_priority(F.col("file_type"), F.col("relative_path")), F.col("relative_path"), o.rules)
    return files.withColumn("priority", priority).select(*[f.split()[0] for f in FILES.split(", ")])


def rejects(files: DataFrame) -> DataFrame:
    return files.where("error is not null").select("path", "error")


def file_metadata(path: str) -> dict:
    """Size, change time in seconds, whether it is a link, and the language of one file (the fence name of its type, else its extension)."""
    s, ext = os.lstat(path), Path(path).suffix[1:].lower()
    language = next((t[4] for t in FILE_TYPES if ext and ext in t[1].split()), ext)
    return {"path": path, "size": os.stat(path).st_size, "modified": int(s.st_mtime), "is_symlink": stat.S_ISLNK(s.st_mode), "extension": ext, "language": language}
