"""Documents in four formats, file trees and reports, as ordered fragments.

A fragment table (ord, fragment) is what scales: `write_fragments` sorts it over the cluster
and writes text files in order; `join_fragments` makes one string where it is known to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import anchor, fence_language, fence_of_extension, human_size, type_display, type_order

RULE = "=" * 64
LINE = "-" * 64


def tree(files: DataFrame) -> DataFrame:
    """sort_key, depth, name, is_dir: every folder and file once; folders come before files of the same parent."""
    parts = F.split("relative_path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path"), (i < F.size(parts)).alias("is_dir")))
    nodes = files.select(F.explode(steps).alias("s")).select("s.*").distinct()
    names = F.split("path", "/")
    last = F.size(names)
    key = F.array_join(F.transform(names, lambda n, i: F.concat(F.when((i < last - 1) | F.col("is_dir"), F.lit("0")).otherwise(F.lit("1")), n)), "/")
    return nodes.select(key.alias("sort_key"), (last - 1).cast("int").alias("depth"), F.element_at(names, -1).alias("name"), "is_dir")


def tree_lines(files: DataFrame) -> DataFrame:
    """sort_key, line with guides."""
    return tree(files).select("sort_key", F.concat(F.repeat(F.lit("│   "), F.col("depth")), F.lit("├── "), F.col("name"), F.when(F.col("is_dir"), F.lit("/")).otherwise(F.lit(""))).alias("line"))


def _list_line(label: str, values: str, columns: list[str]) -> Column:
    if values not in columns:
        return F.lit("")
    return F.when(F.size(values) > 0, F.concat(F.lit(f"{label}: "), F.array_join(values, ", "), F.lit("\n\n"))).otherwise(F.lit(""))


def markdown_files(files: DataFrame, by_type: bool = False) -> DataFrame:
    """ord struct, fragment of each file, by falling priority and path (and type order first, if asked for)."""
    body = F.coalesce("content", F.lit(""))
    closed = F.when(body.endswith("\n"), body).otherwise(F.concat(body, F.lit("\n")))
    c = files.columns
    told = F.lit("")
    if "history" in c:  # commits, newest first, three at most
        lines = F.transform(F.slice("history", 1, 3), lambda h: F.concat(F.lit("  - "), F.trim(h["message"]), F.lit(" by "), h["author"], F.lit("\n")))
        told = F.when(F.size("history") > 0, F.concat(F.lit("Git history:\n"), F.array_join(lines, ""), F.lit("\n"))).otherwise(F.lit(""))
    facts = F.concat(told, _list_line("Imports", "imports", c), _list_line("Imported by", "imported_by", c), _list_line("Function calls", "function_calls", c), _list_line("Type references", "type_references", c))
    fragment = F.concat(F.lit("## "), F.col("relative_path"), F.lit("\n\n"), facts, F.lit("```"), fence_language(F.col("file_type")), F.lit("\n"), closed, F.lit("```\n\n"))
    group = type_order(F.col("file_type")) if by_type else F.lit(0)
    return files.select(F.struct(group.alias("g"), (-F.col("priority")).alias("p"), F.col("relative_path").alias("path")).alias("ord"), fragment.alias("fragment"))


def toc_lines(files: DataFrame) -> DataFrame:
    return files.select(F.struct((-F.col("priority")).alias("p"), F.col("relative_path").alias("path")).alias("ord"), F.concat(F.lit("- ["), F.col("relative_path"), F.lit("](#"), anchor(F.col("relative_path")), F.lit(")")).alias("fragment"))


def statistics(files: DataFrame, largest: str = "GB") -> DataFrame:
    """ord, fragment: totals (the size in units up to `largest`) and counts by type, the commonest first."""
    total = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("s"))
    head = total.select(F.struct(F.lit(0).alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit("").alias("c")).alias("ord"), F.concat(F.lit("## Statistics\n\n- Total files: "), F.col("n").cast("string"), F.lit("\n- Total size: "), human_size(F.col("s"), largest), F.lit("\n")).alias("fragment"))
    kinds = files.groupBy("file_type").count()
    rows = kinds.select(F.struct(F.lit(1).alias("a"), (-F.col("count")).alias("b"), F.col("file_type").alias("c")).alias("ord"), F.concat(F.lit("  - "), type_display(F.col("file_type")), F.lit(": "), F.col("count").cast("string"), F.lit("\n")).alias("fragment"))
    return head.unionByName(rows)


def xml_files(files: DataFrame) -> DataFrame:
    """A closing CDATA mark in a text is split over two sections."""
    body = F.replace(F.coalesce("content", F.lit("")), F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    path = F.replace(F.replace(F.replace(F.col("relative_path"), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))
    return files.select(F.col("relative_path").alias("ord"), F.concat(F.lit('<file path="'), path, F.lit('"><![CDATA['), body, F.lit("]]></file>\n")).alias("fragment"))


def plain_files(files: DataFrame) -> DataFrame:
    return files.select(F.col("relative_path").alias("ord"), F.concat(F.lit(f"{RULE}\nFile: "), F.col("relative_path"), F.lit(f"\n{LINE}\n"), F.coalesce("content", F.lit("")), F.lit("\n")).alias("fragment"))


def path_lines(files: DataFrame) -> DataFrame:
    return files.select(F.col("relative_path").alias("ord"), F.col("relative_path").alias("fragment"))


FORMATS = {"markdown": markdown_files, "xml": xml_files, "plain": plain_files, "paths": path_lines}


#: Headings of a document that name no file.
HEADINGS = ("## Statistics", "## File Structure", "## Table of Contents")


def document(files: DataFrame, label: str = ".", statistics_: bool = True, tree_: bool = True, toc: bool = True, largest: str = "GB") -> DataFrame:
    """part, place, key, fragment of a whole Markdown document, in that order: header, statistics, tree, table of contents, files.

    Everything stays a table: `write_document` sorts it over the cluster, and no part is gathered.
    """
    spark = files.sparkSession
    fixed = [(0, 0, f"# Code Context: {label}\n\n")]
    fixed += [(1, 2, "\n")] if statistics_ else []
    fixed += [(2, 0, "## File Structure\n\n```\n"), (2, 2, "```\n\n")] if tree_ else []
    fixed += [(3, 0, "## Table of Contents\n\n"), (3, 2, "\n")] if toc else []
    out = spark.createDataFrame([(p, q, "", t) for p, q, t in fixed], "part int, place int, key string, fragment string")
    # Falling priority, then path, as one text that sorts so.
    rank = F.concat(F.format_string("%013.6f", F.lit(100_000.0) + F.col("ord.p")), F.col("ord.path"))
    at = lambda p, q: (F.lit(p).alias("part"), F.lit(q).alias("place"))
    if statistics_:
        common = F.format_string("%012d", F.lit(999_999_999_999) + F.col("ord.b"))
        rows = statistics(files, largest)
        out = out.union(rows.select(F.lit(1), F.col("ord.a"), F.when(F.col("ord.a") == 0, F.lit("")).otherwise(F.concat(common, F.col("ord.c"))), "fragment"))
    if tree_:
        out = out.union(tree_lines(files).select(*at(2, 1), F.col("sort_key"), F.concat("line", F.lit("\n"))))
    if toc:
        out = out.union(toc_lines(files).select(*at(3, 1), rank, F.concat("fragment", F.lit("\n"))))
    return out.union(markdown_files(files).select(*at(4, 1), rank, "fragment"))


def joined(fragments: DataFrame) -> str:
    """The text of a document that is known to be small (a token budget bounds it)."""
    return "".join(r["fragment"] for r in fragments.orderBy("part", "place", "key").toLocalIterator())


def write_document(fragments: DataFrame, path: str) -> None:
    """Text files whose names follow the order of a document's fragments, which all end a line."""
    fragments.orderBy("part", "place", "key").select(F.regexp_replace("fragment", r"\n\z", "")).write.text(path)


def file_count(fragments: DataFrame) -> DataFrame:
    """One row: how many lines look like a file's heading."""
    lines = fragments.select(F.explode(F.split("fragment", "\n")).alias("line"))
    return lines.where(F.col("line").startswith("## ") & ~F.col("line").isin(*HEADINGS)).agg(F.count("*").alias("file_count"))


def metrics_report(metrics: DataFrame) -> DataFrame:
    """ord, fragment of each function (path, name, call_count, p50, p95, error_rate), by file."""
    text = F.concat(
        F.lit("### "), F.col("name"), F.lit("\n- calls: "), F.col("call_count").cast("string"), F.lit("\n- p50: "), F.format_string("%.1f", F.bround("p50", 1)), F.lit(" ms\n- p95: "),
        F.format_string("%.1f", F.bround("p95", 1)), F.lit(" ms\n- error rate: "), F.format_string("%.1f", F.bround(F.col("error_rate") * 100, 1)), F.lit("%\n"),
    )
    heads = metrics.select(F.struct("path", F.lit("").alias("name")).alias("ord"), F.concat(F.lit("## "), F.col("path"), F.lit("\n")).alias("fragment")).distinct()
    return heads.union(metrics.select(F.struct("path", "name").alias("ord"), text.alias("fragment")))


def diff_document(files: DataFrame, totals: DataFrame, old: str, new: str) -> DataFrame:
    """part, place, key, fragment of the report on two revisions: totals, changed files, files of the context, contents, and what it all takes.

    files: relative_path, content, error and changed; totals: one row of files_changed, insertions, deletions.
    """
    spark, path = files.sparkSession, F.col("relative_path")
    named = files.select(path, "content", "error", F.col("changed").alias("changed"))
    fixed = [(0, 0, f"# Git Diff Analysis: {old} → {new}\n\nFrom: {old}\nTo: {new}\n\n"), (2, 0, "## Changed Files\n\n"), (2, 2, "\n"), (4, 0, "## File Contents\n\n")]
    out = spark.createDataFrame([(p, q, "", t) for p, q, t in fixed], "part int, place int, key string, fragment string")
    row = lambda part, place, key, text: (F.lit(part).alias("part"), F.lit(place).alias("place"), key.alias("key"), text.alias("fragment"))
    none, line = F.lit(""), F.concat(F.lit("- `"), path, F.lit("`\n"))
    said = F.concat(*[x for label, c in (("Files changed", "files_changed"), ("Lines added", "insertions"), ("Lines removed", "deletions")) for x in (F.lit(f"- **{label}**: "), F.col(c).cast("string"), F.lit("\n"))])
    out = out.union(totals.select(*row(1, 0, none, F.concat(F.lit("## Diff Statistics\n\n"), said, F.lit("\n")))))
    out = out.union(named.where("changed").select(*row(2, 1, path, line)))
    counts = named.agg(F.count_if("changed").alias("c"), F.count_if(~F.col("changed")).alias("s"), F.count("*").alias("n"))
    out = out.union(counts.where("c = 0").select(*row(2, 1, none, F.lit("No files changed.\n"))))
    out = out.union(counts.where("s > 0").select(*row(3, 0, none, F.lit("## Semantic Context Files\n\n")))).union(counts.where("s > 0").select(*row(3, 2, none, F.lit("\n"))))
    out = out.union(named.where("not changed").select(*row(3, 1, path, line)))
    body = F.when(F.col("error").isNull(), F.concat(F.lit("```"), fence_of_extension(path), F.lit("\n"), F.coalesce("content", F.lit("")), F.lit("\n```\n\n"))).otherwise(F.concat(F.lit("*Error reading file: "), F.col("error"), F.lit("*\n\n")))
    out = out.union(named.select(*row(4, 1, path, F.concat(F.lit("### "), path, F.lit("\n\n"), body))))
    taken = out.agg(F.ceil(F.sum(F.octet_length("fragment")) / 4).cast("bigint").alias("t"))
    last = counts.crossJoin(taken)  # one row each
    return out.union(last.select(*row(5, 0, none, F.concat(F.lit("## Context Statistics\n\n- **Files processed**: "), F.col("n").cast("string"), F.lit("\n- **Estimated tokens**: "), F.col("t").cast("string"), F.lit("\n")))))


def join_fragments(fragments: DataFrame, between: str = "") -> DataFrame:
    """One row: all fragments in order. For results of bounded size (a token budget); others are written by write_fragments."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "fragment"))), lambda x: x["fragment"])
    return fragments.agg(F.array_join(parts, between).alias("document"))


def write_fragments(fragments: DataFrame, path: str) -> None:
    """Text files whose names follow the order of their fragments."""
    fragments.orderBy("ord").select("fragment").write.text(path)
