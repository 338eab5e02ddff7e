"""Joins between files and facts: callers, importers, stems, definitions, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import basename, capitalise, dirname, stem


def callers_of(targets: DataFrame, defs: DataFrame, calls: DataFrame, residual: Column | None = None, by_file_name: bool = True) -> DataFrame:
    """target, node: files that call a function which a target (path) exports.

    A caller whose file name (or path, if by_file_name is false) is that of any target is left
    out. `residual` narrows the pairs further; it may use target, node, name and module.
    """
    exported = defs.where("is_exported").join(targets.select("path").distinct(), "path", "left_semi").select(F.col("path").alias("target"), "name").distinct()
    pairs = exported.join(calls.select(F.col("path").alias("node"), "name", "module").distinct(), "name")
    if residual is not None:
        pairs = pairs.where(residual)
    own = targets.select((basename(F.col("path")) if by_file_name else F.col("path")).alias("own")).distinct()
    key = basename(F.col("node")) if by_file_name else F.col("node")
    return pairs.withColumn("own", key).join(own, "own", "left_anti").select("target", "node").distinct()


def calling_files(targets: DataFrame, defs: DataFrame, calls: DataFrame) -> DataFrame:
    """node: the files that callers_of names for any target, without a row for each pair, so that a common name costs its calls and definitions only.

    Outside Go and Swift the name alone decides: a semi join. Within them, a call reaches its own
    folder or the package that it names, which makes the folder part of the key.
    """
    exported = defs.where("is_exported").join(targets.select("path").distinct(), "path", "left_semi").select(F.col("path").alias("target"), "name").distinct()
    asked = calls.select(F.col("path").alias("node"), "name", "module").distinct()
    scoped = F.col("target").endswith(".go") | F.col("target").endswith(".swift")
    free = asked.join(exported.where(~scoped).select("name").distinct(), "name", "left_semi")
    # Scoped targets: the same folder, or (by its name) the last part of the call's module; a Swift call without a module reaches any.
    near = exported.where(scoped).select("name", dirname(F.col("target")).alias("folder"))
    here = asked.withColumn("folder", dirname(F.col("node"))).join(near, ["name", "folder"], "left_semi").drop("folder")
    package = near.select("name", basename(F.col("folder")).alias("package")).distinct()
    named = asked.where("module is not null").join(package, "name").where(F.col("module").endswith(F.col("package"))).select("node", "name", "module")
    swift = exported.where(F.col("target").endswith(".swift")).select("name").distinct()
    loose = asked.where("module is null").join(swift, "name", "left_semi")
    found = free.select("node").union(here.select("node")).union(named.select("node")).union(loose.select("node")).distinct()
    own = targets.select(basename(F.col("path")).alias("own")).distinct()
    return found.withColumn("own", basename(F.col("node"))).join(own, "own", "left_anti").select("node")


def call_may_reach(target: Column, node: Column, module: Column) -> Column:
    """A call in a Go or Swift file reaches its own folder's files, or those of the package that it names; other languages go by name alone."""
    near = (dirname(target) == dirname(node)) | module.endswith(basename(dirname(target)))
    scoped = target.endswith(".go") | target.endswith(".swift")
    return ~scoped | F.coalesce(near, F.lit(False)) | (target.endswith(".swift") & module.isNull())


def importers_of(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """node: files with an edge to a target that are no targets themselves."""
    t = targets.select(F.col("path").alias("dst")).distinct()
    return edges.join(t, "dst", "left_semi").select(F.col("src").alias("node")).distinct().join(t.toDF("node"), "node", "left_anti")


def module_key(path: Column) -> Column:
    """What a call's module is compared with: the stem, or the folder's name for mod, index and __init__ files."""
    return F.when(stem(path).isin("mod", "index", "__init__"), basename(dirname(path))).otherwise(stem(path))


def call_edges(calls: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst: a call whose module is the key of another file."""
    keyed = files.select(F.col("path").alias("dst"), module_key(F.col("path")).alias("module"))
    return calls.where("module is not null").select(F.col("path").alias("src"), "module").distinct().join(keyed, "module").where("src <> dst").select("src", "dst").distinct()


def type_edges(type_refs: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst, name: a type whose name is the stem of another file, or that stem with a capital."""
    s = stem(F.col("path"))
    keyed = files.select(F.col("path").alias("dst"), F.explode(F.array_distinct(F.array(s, capitalise(s)))).alias("name"))
    return type_refs.select(F.col("path").alias("src"), "name").distinct().join(keyed, "name").where("src <> dst").select("src", "dst", "name").distinct()


def definition_paths(type_refs: DataFrame, files: DataFrame) -> DataFrame:
    """src, name, definition_path: the least file that the type's name points at."""
    return type_edges(type_refs, files).groupBy("src", "name").agg(F.min("dst").alias("definition_path"))


def type_definitions(refs: DataFrame, type_defs: DataFrame) -> DataFrame:
    """src, name, definition_path: the file that defines the type, nearest first (most shared folders), then least."""
    d = type_defs.select(F.col("path").alias("def"), "name").distinct()
    parts = lambda c: F.split(dirname(c), "/")
    pairs = refs.select(F.col("path").alias("src"), "name").distinct().join(d, "name").where("src <> def")
    shared = F.size(F.array_intersect(parts(F.col("src")), parts(F.col("def"))))
    return pairs.groupBy("src", "name").agg(F.max_by("def", F.struct(shared, F.col("def"))).alias("definition_path"))


def first_match(candidates: DataFrame, key: list[str], value: str, known: DataFrame, order: str = "ord") -> DataFrame:
    """Per key the candidate of the lowest order that exists in `known` (column `value`)."""
    return candidates.join(known.select(value).distinct(), value, "left_semi").groupBy(*key).agg(F.min_by(value, order).alias(value), F.min(order).alias(order))


def with_default(left: DataFrame, right: DataFrame, key: str, defaults: dict) -> DataFrame:
    """left's keys with right's columns where there are any, else the defaults."""
    out = left.select(key).distinct().join(right, key, "left")
    return out.select(key, *[F.coalesce(F.col(c), F.lit(defaults.get(c))).alias(c) for c in right.columns if c != key])


def merge_rows(df: DataFrame, key: str, lists: list[str]) -> DataFrame:
    """One row a key; list columns become sorted unions, others their least value."""
    rest = [c for c in df.columns if c != key and c not in lists]
    out = df.groupBy(key).agg(*[F.min(c).alias(c) for c in rest])
    for c in lists:  # single items meet: a hot key gathers each of them once, not a list for every row
        out = out.join(_united(df, [key], c), key, "left").withColumn(c, F.coalesce(c, F.array().cast(dict(df.dtypes)[c])))
    return out.select(key, *rest, *lists)


def _united(df: DataFrame, keys: list[str], items: str) -> DataFrame:
    """keys and the sorted distinct items of their list columns."""
    single = df.select(*keys, F.explode(items).alias("_item")).where("_item is not null").distinct()
    return single.groupBy(*keys).agg(F.array_sort(F.collect_list("_item")).alias(items))


def index_stats(defs: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: called function names, files with exports, distinct caller pairs."""
    a = calls.agg(F.countDistinct("name").alias("functions"), F.countDistinct(F.struct("name", "path")).alias("callers"), F.lit(0).cast("bigint").alias("files_with_exports"))
    none = F.lit(0).cast("bigint")
    b = defs.where("is_exported").agg(none.alias("functions"), none.alias("callers"), F.countDistinct("path").alias("files_with_exports"))
    return a.unionByName(b).agg(*[F.sum(c).alias(c) for c in a.columns])


def merge_imports(imports: DataFrame) -> DataFrame:
    """One row for each path and module with the union of its items."""
    keyed = imports.withColumn("module", F.coalesce("module", F.lit("")))
    out = keyed.groupBy("path", "module").agg(F.max("is_relative").alias("is_relative"), F.min("line").alias("line"))
    out = out.join(_united(keyed, ["path", "module"], "items"), ["path", "module"], "left")
    return out.select("path", "module", F.coalesce("items", F.array().cast(dict(imports.dtypes)["items"])).alias("items"), "is_relative", "line")


def qualify(facts: DataFrame, imports: DataFrame) -> DataFrame:
    """Facts (path, name, module) whose missing module is filled from the file's import that lists the name; the last line wins."""
    named = imports.select("path", "line", F.col("module").alias("m"), F.explode("items").alias("name")).groupBy("path", "name").agg(F.max_by("m", F.struct("line", "m")).alias("m"))
    return facts.join(named, ["path", "name"], "left").withColumn("module", F.coalesce("module", "m")).select(*facts.columns)


def prefer_qualified(refs: DataFrame) -> DataFrame:
    """One reference for each path, name and line, with a module if any of them has one."""
    return refs.groupBy("path", "name", "line").agg(F.min("module").alias("module")).select("path", "name", "module", "line")
