"""Classification, scoring and formatting of corpus rows, as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BINARY_EXTENSIONS, FILE_TYPES


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """What stands before the last slash; empty at the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def extension(path: Column) -> Column:
    """Lower-cased suffix of the file name; empty without a dot, and for names that only start with one."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def is_binary_extension(path: Column) -> Column:
    return extension(path).isin(*BINARY_EXTENSIONS)


def is_binary_content(content: Column, probe: int = 8192) -> Column:
    """A NUL among the first characters of a text."""
    return F.left(content, F.lit(probe)).contains("\0")


def file_type(path: Column) -> Column:
    """By extension, then text unless the extension is a binary one."""
    by_extension = F.create_map(*[F.lit(x) for t in FILE_TYPES for e in t[1].split() for x in (e, t[0])])
    return F.coalesce(by_extension[extension(path)], F.when(is_binary_extension(path), F.lit("Other")).otherwise(F.lit("Text")))


def _of_type(kind: Column, place: int) -> Column:
    return F.create_map(*[F.lit(x) for t in FILE_TYPES for x in (t[0], t[place])])[kind]


def type_weight(kind: Column) -> Column:
    return _of_type(kind, 2)


def type_display(kind: Column) -> Column:
    return _of_type(kind, 3)


def fence_language(kind: Column) -> Column:
    return _of_type(kind, 4)


def type_order(kind: Column) -> Column:
    return _of_type(kind, 5)


#: Fence languages of further extensions.
EXTENSION_FENCES = {
    "sh": "bash", "bash": "bash", "zsh": "zsh", "fish": "fish", "ps1": "powershell", "sql": "sql", "pl": "perl", "vim": "vim", "clj": "clojure",
    "erl": "erlang", "ml": "ocaml", "fs": "fsharp", "vb": "vb", "proto": "protobuf", "graphql": "graphql", "tf": "hcl", "tex": "latex", "ini": "ini", "conf": "conf",
}


def fence_of_extension(path: Column) -> Column:
    known = {e: t[4] for t in FILE_TYPES for e in t[1].split()} | EXTENSION_FENCES
    return F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[extension(path)], F.lit("text"))


def graph_language(path: Column) -> Column:
    """The language label of a graph node: the fence of a known source type, else the extension itself."""
    known = {e: t[4] for t in FILE_TYPES[:21] for e in t[1].split()}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[extension(path)], extension(path))


def base_priority(kind: Column, relative_path: Column) -> Column:
    """Type weight times the factors whose words occur in the lower-cased path, 2.0 at most; the root bonus needs a bare name."""
    p = F.lower(relative_path)
    has = lambda *words: F.greatest(*[p.contains(w).cast("int") for w in words], F.lit(0)) == 1
    config = type_order(kind).isin(22, 23, 24)
    factor = lambda test, by: F.when(test, F.lit(by)).otherwise(F.lit(1.0))
    score = type_weight(kind) * factor(has("main", "index"), 1.5) * factor(has("lib", "src"), 1.2) * factor(has("test", "spec"), 0.8)
    score = score * factor(has("example", "sample"), 0.7) * factor(config & ~relative_path.contains("/"), 1.3)
    return F.least(score, F.lit(2.0))


def custom_priority(base: Column, relative_path: Column, rules: Iterable[tuple[str, float]]) -> Column:
    """The first rule (regex, weight) that matches adds its weight, past the cap of the base."""
    gains = [F.when(relative_path.rlike(pattern), F.lit(float(weight))) for pattern, weight in rules]
    return base + F.coalesce(*gains, F.lit(0.0))


def human_size(n: Column, largest: str = "GB") -> Column:
    """Bytes in units up to `largest`, MB or GB."""
    k = 1024.0
    shown = lambda unit, by: F.concat(F.format_string("%.2f", F.bround(n / by, 2)), F.lit(f" {unit}"))
    out = F.when(n < k, F.concat(n.cast("string"), F.lit(" B"))).when(n < k**2, shown("KB", k))
    return out.otherwise(shown("MB", k**2)) if largest == "MB" else out.when(n < k**3, shown("MB", k**2)).otherwise(shown("GB", k**3))


def anchor(path: Column) -> Column:
    return F.lower(F.translate(path, "/\\. ", "----"))


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def capitalise(s: Column) -> Column:
    return F.concat(F.upper(F.left(s, F.lit(1))), F.substring(s, F.lit(2), F.length(s)))


def common_ancestor(a: Column, b: Column) -> Column:
    """The longest run of leading path parts that both share."""
    x, y = F.split(a, "/"), F.split(b, "/")
    n = F.least(F.size(x), F.size(y))
    differ = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(x, i) != F.element_at(y, i))
    keep = F.when(F.size(differ) == 0, n).otherwise(F.element_at(differ, F.lit(1)) - 1)
    return F.array_join(F.slice(x, F.lit(1), keep), "/")


def import_display(path: Column) -> Column:
    """File name without a source extension; a package initialiser shows its folder."""
    parts = F.split(path, "/")
    return F.when((basename(path) == "__init__.py") & (F.size(parts) > 1), F.element_at(parts, -2)).otherwise(F.regexp_replace(basename(path), r"\.(py|rs|js|ts)$", ""))


def call_display(name: Column, module: Column) -> Column:
    return F.when(module.isNull(), name).otherwise(F.concat(module, F.lit("."), name))


def type_display_name(name: Column, module: Column) -> Column:
    return F.when(module.isNull(), name).when(module.endswith(F.concat(F.lit("::"), name)), module).otherwise(F.concat(module, F.lit("."), name))


def module_path(module: Column) -> Column:
    return F.replace(F.replace(module, F.lit("::"), F.lit("/")), F.lit("."), F.lit("/"))


def tokens(text: Column) -> Column:
    """The offline estimate: a quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("bigint")


def rough_tokens(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("bigint")


def output_estimate(size: Column) -> Column:
    """Bytes that a rendered file is expected to take: a fifth more than its own, rounded up."""
    return F.ceil(size * 1.2).cast("bigint")


def overhead_tokens(path: Column) -> Column:
    """Header and footer of a rendered file."""
    return tokens(F.concat(F.lit("## "), path, F.lit("\n\n```\n"))) + tokens(F.lit("```\n\n"))


def snippet(line: Column, query: str, around: int = 20) -> Column:
    """The first match with some characters on each side; dots where the line goes on."""
    at = F.locate(query.lower(), F.lower(line))
    lo = F.greatest(at - around, F.lit(1))
    hi = F.least(at + len(query) - 1 + around, F.length(line))
    cut = F.substring(line, lo, hi - lo + 1)
    return F.when(at > 0, F.concat(F.when(lo > 1, F.lit("...")).otherwise(F.lit("")), cut, F.when(hi < F.length(line), F.lit("...")).otherwise(F.lit(""))))


def lines_of(content: Column) -> Column:
    """Lines without carriage returns; one empty line after a last newline does not count."""
    whole = F.regexp_replace(content, r"\r?\n\z", "")
    return F.when(F.length(content) == 0, F.array().cast("array<string>")).otherwise(F.split(whole, r"\r?\n", -1))


def epoch_nanos(stamp: Column) -> Column:
    """Nanoseconds since 1970 of an RFC 3339 text; null if it is none."""
    return F.unix_micros(F.try_to_timestamp(stamp)) * 1000


def time_range(text: Column) -> Column:
    """struct(start_ns, end_ns) of `start/end` in RFC 3339; null unless both are times and the first comes before the second."""
    parts = F.split(text, "/")
    a, b = epoch_nanos(F.get(parts, 0)), epoch_nanos(F.get(parts, 1))
    return F.when((F.size(parts) == 2) & (a < b), F.struct(a.alias("start_ns"), b.alias("end_ns")))


def duration_ms(start_ns: Column, end_ns: Column) -> Column:
    return F.when(end_ns >= start_ns, (end_ns - start_ns) / 1e6)


def content_hash(text: Column) -> Column:
    return F.md5(text)


#: System folders and schemes that an import must not name.
BLOCKED_IMPORTS = ("/etc/", "/sys/", "/proc/", "/dev/", "/root/", "c:\\windows", "file://", "javascript:", "data:")


def is_secure_import(module: Column, most_up: int = 3) -> Column:
    """Not empty, no blocked place, at most so many `..`, no NUL."""
    low = F.lower(module)
    blocked = F.lit(False)
    for b in BLOCKED_IMPORTS:
        blocked = blocked | low.contains(b)
    ups = F.size(F.split(module, r"\.\.", -1)) - 1
    return (F.length(F.trim(module)) > 0) & ~blocked & (ups <= most_up) & ~module.contains("\0")


def is_contained(path: Column, root: str) -> Column:
    """Below the (absolute) root once `.` and `..` are worked out; relative paths start there. Percent signs are not trusted."""
    base = root.rstrip("/")
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(f"{base}/"), path))
    kept = F.filter(F.split(whole, "/"), lambda x: ~x.isin("", "."))
    empty = F.array().cast("array<string>")
    # A step up leaves the root of the file system out of reach: what is empty stays so.
    walked = F.aggregate(kept, empty, lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)))
    real = F.concat(F.lit("/"), F.array_join(walked, "/"))
    return F.coalesce(~path.contains("%") & ((real == base) | real.startswith(f"{base}/")), F.lit(False))


def is_valid_module(module: Column) -> Column:
    """Up to 255 letters, digits and name punctuation, without `..`."""
    return (F.length(module).between(1, 255)) & module.rlike(r"^[A-Za-z0-9_./:@\-]+$") & ~module.contains("..")
