"""Module resolution: candidate paths with an order, joined to the files that exist.

A candidate generator is a pure function of (file, module, project facts); the first
candidate that exists wins. Modules that nothing matches are external, with a confidence.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CANDIDATES = "path string, module string, item string, ord int, target string, confidence double"

_SCRIPT = {"js": ("js", "jsx", "ts", "tsx"), "ts": ("ts", "tsx", "js", "jsx")}
_SCRIPT_FILES = ("js", "jsx", "mjs", "cjs", "ts", "tsx")
_RUST_STD = ("std", "core", "alloc", "proc_macro", "test")
#: First parts of module names that always mean an outside package: Node's own, common packages of JavaScript, more of TypeScript, Python's own, common packages of Python.
NODE_BUILTINS = frozenset(
    "assert buffer child_process cluster crypto dgram dns domain events fs http https net os path punycode querystring readline repl stream string_decoder tls tty url util v8 vm zlib process console timers module".split()
)
COMMON_PACKAGES = frozenset(
    "react react-dom vue angular lodash express next webpack babel eslint typescript jest mocha chai sinon axios moment dayjs socket.io cors helmet bcrypt jsonwebtoken passport multer nodemailer mongoose sequelize prisma"
    " graphql apollo redux mobx zustand styled-components emotion tailwindcss".split()
)
TYPED_PACKAGES = frozenset("@types/node @types/react @types/express ts-node tsx tsc".split())
PYTHON_STANDARD = frozenset(
    "os sys json math random datetime collections itertools functools re time subprocess pathlib typing asyncio unittest logging argparse urllib http email csv sqlite3 threading multiprocessing abc enum dataclasses"
    " contextlib io pickle copy hashlib base64 secrets uuid platform socket ssl select queue struct array bisect heapq weakref types importlib pkgutil inspect ast dis traceback linecache tokenize keyword builtins __future__"
    " gc signal atexit concurrent xml html ftplib poplib imaplib smtplib telnetlib socketserver xmlrpc ipaddress shutil tempfile glob fnmatch stat filecmp zipfile tarfile gzip bz2 lzma zlib configparser netrc plistlib"
    " statistics decimal fractions numbers cmath operator difflib textwrap unicodedata stringprep codecs encodings locale gettext warnings pprint reprlib graphlib".split()
)
PYTHON_PACKAGES = frozenset(
    "numpy pandas requests flask django pytest matplotlib scipy sklearn tensorflow torch beautifulsoup4 selenium pygame pillow sqlalchemy celery redis pymongo aiohttp fastapi pydantic click tqdm colorama setuptools pip wheel".split()
)


def is_external(file: str, module: str) -> bool:
    """Whether the module's first part is an outside package, whatever files there are."""
    ext = file.rsplit(".", 1)[-1].lower()
    if ext in ("py", "pyi"):
        return module.split(".")[0] in PYTHON_STANDARD | PYTHON_PACKAGES
    if ext in _SCRIPT_FILES:
        first = module.split("/")[0]
        return first in NODE_BUILTINS or first in COMMON_PACKAGES or module in TYPED_PACKAGES or module.startswith("node:")
    return ext == "rs" and module.split("::")[0] in _RUST_STD


@dataclass
class Project:
    """What manifests say: names in Cargo.toml and go.mod, and folders of Swift targets."""

    crate: str | None = None
    go_module: str | None = None
    swift_targets: dict[str, str] = field(default_factory=dict)


def _up(folder: str, levels: int) -> str | None:
    for _ in range(levels):
        if not folder:
            return None
        folder = posixpath.dirname(folder)
    return folder


def _join(*parts: str) -> str:
    return posixpath.normpath(posixpath.join(*[p for p in parts if p])) if any(parts) else ""


def _rust(file: str, module: str, item: str | None, p: Project) -> Iterator[tuple[str, float]]:
    here, name = posixpath.dirname(file), posixpath.basename(file).removesuffix(".rs")
    own = here if name in ("mod", "lib", "main") else _join(here, name)
    parts = module.split("::")
    tail = [item] if item and item.isidentifier() and item[:1].islower() else []

    def inside(bases: list[str], path: list[str], sure: float) -> Iterator[tuple[str, float]]:
        for n in range(len(path), 0, -1):
            for base in bases:
                stem = _join(base, *path[:n])
                yield f"{stem}.rs", sure
                yield f"{stem}/mod.rs", sure

    crate = (p.crate or "").replace("-", "_")
    if parts[0] in ("crate", crate) and parts[0]:
        yield from inside(["src", ""], parts[1:] + tail, 0.9)
    elif parts[0] == "self":
        yield from inside([own, here], parts[1:] + tail, 0.9)
    elif parts[0] == "super":
        ups = len([x for x in parts if x == "super"])
        base = _up(own, ups)
        if base is not None:
            yield from inside([base], parts[ups:] + tail, 0.9)
            for f in ("lib.rs", "mod.rs"):
                yield _join(base, f), 0.9
            if base:
                yield f"{base}.rs", 0.9
    elif parts[0] not in _RUST_STD:
        yield from inside([own, here, "src", ""], parts + tail, 0.85)


def _python(file: str, module: str, item: str | None, p: Project) -> Iterator[tuple[str, float]]:
    dots = len(module) - len(module.lstrip("."))
    rest = [x for x in module[dots:].split(".") if x]
    here = posixpath.dirname(file)
    if dots:
        base = _up(here, dots - 1)
        bases = [] if base is None else [base]
    elif is_external(file, module):
        return
    else:
        bases = ["", here]
    for base in bases:
        options = [rest + [item]] if item and item != "*" and item.isidentifier() else []
        for path in [*options, rest]:
            stem = _join(base, *path)
            if path:
                yield f"{stem}.py", 0.9
            yield _join(stem, "__init__.py"), 0.9


def _script(extensions: tuple[str, ...]):
    def run(file: str, module: str, item: str | None, p: Project) -> Iterator[tuple[str, float]]:
        here = posixpath.dirname(file)
        if module.startswith("."):
            bases = [here]
        elif is_external(file, module):
            return
        else:
            bases = ["", "src", here]
        for base in bases:
            stem = _join(base, module)
            if stem.startswith(".."):
                continue
            if posixpath.splitext(stem)[1]:
                yield stem, 0.9
            for e in extensions:
                yield f"{stem}.{e}", 0.9
            for e in extensions:
                yield f"{stem}/index.{e}", 0.9

    return run


def _go(file: str, module: str, item: str | None, p: Project) -> Iterator[tuple[str, float]]:
    """Folders; which file stands for one is chosen later."""
    here = posixpath.dirname(file)
    if module.startswith("."):
        yield _join(here, module), 0.9
    elif p.go_module and (module == p.go_module or module.startswith(p.go_module + "/")):
        yield module[len(p.go_module) :].strip("/"), 0.95
    else:
        yield module, 0.8
        yield _join(here, module), 0.7


def _swift(file: str, module: str, item: str | None, p: Project) -> Iterator[tuple[str, float]]:
    if module in p.swift_targets:
        yield p.swift_targets[module], 0.95
    for folder in (f"Sources/{module}", f"Tests/{module}", f"Tests/{module}Tests", module):
        yield folder, 0.9
    yield f"{module}.swift", 0.8


GENERATORS = {"rs": _rust, "py": _python, "pyi": _python, "js": _script(_SCRIPT["js"]), "jsx": _script(_SCRIPT["js"]), "mjs": _script(_SCRIPT["js"]), "cjs": _script(_SCRIPT["js"]), "ts": _script(_SCRIPT["ts"]), "tsx": _script(_SCRIPT["ts"]), "go": _go, "swift": _swift}


def candidates(file: str, module: str, item: str | None, project: Project) -> list[tuple[str, float]]:
    """Distinct candidates in order, all within the project."""
    make = GENERATORS.get(file.rsplit(".", 1)[-1].lower())
    found = make(file, module, item, project) if make else ()
    return list(dict.fromkeys((t, c) for t, c in found if t and not t.startswith(("/", ".."))))


def external_confidence(file: str, module: str) -> float:
    """1.0 for what is known to lie outside, 0.5 for what merely was not found."""
    known = is_external(file, module) or (file.endswith(".go") and "." not in module.split("/")[0])
    return 1.0 if known else 0.5


def resolve(imports: DataFrame, files: DataFrame, project: Project | None = None) -> DataFrame:
    """path, module, item, target, is_external, confidence for each import (path, module, items)."""
    p = project or Project()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for file, module, item in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = candidates(file, module or "", item, p)
                rows += [(file, module, item, n, t, c) for n, (t, c) in enumerate(found)] or [(file, module, item, 0, None, None)]
                rows.append((file, module, item, 1 << 30, None, external_confidence(file, module or "")))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["path", "module", "item", "ord", "target", "confidence"])

    asked = imports.select("path", "module", F.explode_outer("items").alias("item")).distinct()
    wanted = asked.mapInArrow(run, CANDIDATES)
    # Merge joins: estimates know nothing of the several candidates that Python makes of an import, so Spark would broadcast all of them.
    known = files.select(F.col("relative_path").alias("target"), F.col("relative_path").alias("file")).union(package_files(files).select(F.col("folder").alias("target"), "file"))
    hits = wanted.join(known.hint("merge"), "target").where("file <> path").withColumn("found", F.struct("ord", "file", "confidence"))
    best = hits.groupBy("path", "module", "item").agg(F.min("found").alias("found"))
    last = wanted.where(F.col("ord") == 1 << 30).select("path", "module", "item", F.col("confidence").alias("outside"))
    same = (last["path"] == best["path"]) & (last["module"] == best["module"]) & last["item"].eqNullSafe(best["item"])
    out = last.join(best.hint("merge"), same, "left")
    return out.select(last["path"], last["module"], last["item"], F.col("found.file").alias("target"), F.col("found").isNull().alias("is_external"), F.coalesce("found.confidence", "outside").alias("confidence"))


def package_files(files: DataFrame) -> DataFrame:
    """folder, file: the file that stands for a Go or Swift folder: named as it, doc.go, types.go, else the first that is no test."""
    source = files.where(F.col("relative_path").endswith(".go") | F.col("relative_path").endswith(".swift")).where(~F.col("relative_path").endswith("_test.go"))
    folder = F.regexp_replace("relative_path", "/?[^/]*$", "")
    name = F.element_at(F.split("relative_path", "/"), -1)
    own = F.element_at(F.split(folder, "/"), -1)
    rank = F.when(name == F.concat(own, F.lit(".go")), 0).when(name == "doc.go", 1).when(name == "types.go", 2).otherwise(3)
    return source.where(folder != "").groupBy(folder.alias("folder")).agg(F.min_by("relative_path", F.struct(rank, F.col("relative_path"))).alias("file"))


def siblings(files: DataFrame, project: Project | None = None) -> DataFrame:
    """src, dst: files of one Go package (same folder) or Swift target (deepest target folder), tests left out as dst."""
    folder = F.regexp_replace("relative_path", "/?[^/]*$", "")
    p = F.col("relative_path")
    go = files.where(p.endswith(".go")).select(p.alias("file"), folder.alias("group"))
    target = F.lit(None).cast("string")
    for place in sorted((project or Project()).swift_targets.values(), key=len):  # the deepest is tested first: it wraps the others
        target = F.when(p.startswith(f"{place}/"), F.lit(place)).otherwise(target)
    swift = files.where(p.endswith(".swift")).select(p.alias("file"), F.coalesce(target, F.regexp_extract(p, r"^((?:Sources|Tests)/[^/]+)/", 1)).alias("group")).where("group <> ''")
    g = go.union(swift)
    other = g.select("group", F.col("file").alias("dst")).where(~F.col("dst").endswith("_test.go"))
    return g.withColumnRenamed("file", "src").join(other, "group").where("src <> dst").select("src", "dst")


def rust_declarers(files: DataFrame, imports: DataFrame) -> DataFrame:
    """src, dst: a Rust file and the parent that declares it by `mod name`."""
    mods = imports.where("is_relative and path like '%.rs' and size(items) = 0").select(F.col("path").alias("dst"), F.col("module").alias("name"))
    base = F.regexp_replace("relative_path", r"(?:/mod)?\.rs$", "")
    parent = F.regexp_replace(base, "/?[^/]*$", "")
    kids = files.where("relative_path like '%.rs'").select(F.col("relative_path").alias("src"), F.element_at(F.split(base, "/"), -1).alias("name"), parent.alias("folder"))
    slot = F.regexp_replace("dst", r"(?:(?:^|/)(?:mod|lib|main))?\.rs$", "")
    return kids.join(mods.withColumn("folder", slot), ["name", "folder"]).where("src <> dst").select("src", "dst").distinct()
