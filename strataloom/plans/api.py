"""The four queries of the engine and its service calls, from folders and files to DataFrames."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.facts import all_facts, split
from ..extract.languages import swift_targets
from ..functions.columns import overhead_tokens, tokens
from ..operators import graph, joins, rank, search, telemetry
from ..operators.resolve import Project, resolve, rust_declarers, siblings
from ..sources import corpus, gitlog, otlp
from ..sources.config import Settings
from . import render


@dataclass
class Analysis:
    """Files of a project with their facts and edges; each table is computed once."""

    files: DataFrame
    facts: dict[str, DataFrame]
    imports: DataFrame  #: src, dst
    types: DataFrame  #: src, dst

    @property
    def edges(self) -> DataFrame:
        return self.imports.union(self.types).distinct()


def read_project(root: str) -> Project:
    p, top = Project(), Path(root)
    if (top / "Cargo.toml").is_file():
        import tomllib

        p.crate = tomllib.loads((top / "Cargo.toml").read_text()).get("package", {}).get("name")
    if (top / "go.mod").is_file():
        p.go_module = next((line.split()[1] for line in (top / "go.mod").read_text().splitlines() if line.startswith("module ")), None)
    if (top / "Package.swift").is_file():
        p.swift_targets = swift_targets((top / "Package.swift").read_text())
    return p


def analyse(files: DataFrame, project: Project | None = None) -> Analysis:
    """Facts, resolved imports, and edges from calls and types (callee module or type name equal to a file's stem)."""
    found = split(graph.settle(all_facts(files)))
    keyed = files.select(F.col("relative_path").alias("path"), "relative_path")
    resolved = resolve(found["imports"], files, project)
    by_import = resolved.where("not is_external").select(F.col("path").alias("src"), F.col("target").alias("dst"))
    by_call = joins.call_edges(found["calls"], keyed)
    by_name = joins.type_edges(found["type_refs"], keyed).select("src", "dst")
    by_def = joins.type_definitions(found["type_refs"], found["type_defs"]).select("src", F.col("definition_path").alias("dst"))
    imports = graph.edges_of(by_import.union(by_call), "src", "dst")
    return Analysis(files, found, graph.settle(imports), graph.settle(graph.edges_of(by_name.union(by_def), "src", "dst")))


def _expanded(a: Analysis, seeds: DataFrame, s: Settings, project: Project | None) -> DataFrame:
    """seeds (relative_path, priority) and what they reach, as files with priority; reached files have 1.0."""
    nodes = seeds.select(F.col("relative_path").alias("node"))
    none = a.imports.limit(0)
    imports = none
    if s.imports:
        extra = siblings(a.files, project).union(rust_declarers(a.files, a.facts["imports"]))
        direct = a.imports.union(a.imports.toDF("src", "mid").join(extra.toDF("mid", "dst"), "mid").select("src", "dst"))
        imports = graph.settle(direct.where("src <> dst").distinct())
    callers = None
    if s.callers:
        targets = seeds.select(F.col("relative_path").alias("path"))
        called = joins.calling_files(targets, a.facts["defs"], a.facts["calls"])
        importing = a.imports.join(targets.toDF("dst"), "dst", "left_semi").select(F.col("src").alias("node"))
        callers = called.union(importing.select("node")).distinct()
    reached = graph.expand(imports, nodes, s.semantic_depth, a.types if s.types else None, callers)
    out = reached.select(F.col("node").alias("relative_path")).join(a.files.drop("priority"), "relative_path")
    given = seeds.select("relative_path", F.col("priority").alias("given"))
    return out.join(given, "relative_path", "left").withColumn("priority", F.coalesce("given", F.lit(1.0))).drop("given")


def _with_importers(files: DataFrame, edges: DataFrame) -> DataFrame:
    """imports and imported_by of each file, within the result only."""
    own = files.select(F.col("relative_path").alias("src"))
    inner = edges.join(own, "src", "left_semi").join(own.toDF("dst"), "dst", "left_semi").select("src", "dst")
    by = graph.imported_by(inner).withColumnRenamed("node", "relative_path")
    to = graph.imported_by(graph.reverse(inner)).toDF("relative_path", "imports")
    empty = F.array().cast("array<string>")
    return files.join(by, "relative_path", "left").join(to, "relative_path", "left").withColumns({"imported_by": F.coalesce("imported_by", empty), "imports": F.coalesce("imports", empty)})


def fit(files: DataFrame, edges: DataFrame | None, budget: int | None) -> DataFrame:
    """Boosted priorities and, with a budget, the greedy choice of files within what the structure leaves."""
    if edges is not None:
        named = files.withColumn("path", F.col("relative_path"))
        files = rank.boost(named, edges)
    sized = files.withColumn("tokens", tokens(F.coalesce("content", F.lit(""))) + overhead_tokens(F.col("relative_path")))
    if budget is None:
        return sized
    left = max(0, budget - (rank.structure_overhead(sized).first()[0] or 0))
    return rank.greedy_budget(sized, left, tie="relative_path")


def corpus_query(spark: SparkSession, s: Settings) -> DataFrame:
    """Files of all folders: scanned, expanded by facts if asked for, ranked and fitted; root tells the folder."""
    parts = []
    for root in s.directories:
        options = corpus.ScanOptions(include=s.include, ignore=s.ignore, rules=s.priorities, skip_binary=s.prompt is not None)
        files = corpus.scan(spark, root, options)
        edges = None
        if s.imports or s.callers or s.types:
            home = corpus.project_root(root) if Path(root).is_file() else root
            project = read_project(home)
            whole = corpus.scan(spark, home, replace(options, include=[]))
            a = analyse(whole, project)
            files = _with_importers(_expanded(a, files.select("relative_path", "priority"), s, project), a.edges)
            edges = a.edges
        files = fit(files, edges, s.budget()).withColumn("root", F.lit(root))
        parts.append(with_history(files, spark, root, s.history) if s.history else files)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def with_history(files: DataFrame, spark: SparkSession, root: str, depth: int) -> DataFrame:
    """files with history: the last `depth` commits of each (message, author), newest first; empty outside a repository."""
    try:
        top = Path(gitlog.repository_root(root))
    except gitlog.GitError:
        return files.withColumn("history", F.array().cast("array<struct<message:string,author:string>>"))
    below = Path(root).resolve().relative_to(top.resolve()).as_posix()
    at = F.col("relative_path") if below == "." else F.concat(F.lit(f"{below}/"), F.col("relative_path"))
    rows = gitlog.history(spark, str(top), depth).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "message", "author"))).alias("h"))
    told = files.withColumn("_at", at).join(rows.withColumnRenamed("path", "_at"), "_at", "left").drop("_at")
    return told.withColumn("history", F.coalesce(F.transform("h", lambda x: F.struct(x["message"].alias("message"), x["author"].alias("author"))), F.array().cast("array<struct<message:string,author:string>>"))).drop("h")


def whole_document(spark: SparkSession, s: Settings) -> DataFrame:
    """part, place, key, fragment of a Markdown document for each root, in order of root_no: header, statistics, tree, contents, files."""
    out = None
    for n, root in enumerate(s.directories):
        one = render.document(corpus_query(spark, replace(s, paths=[root])), root).withColumn("root_no", F.lit(n))
        out = one if out is None else out.union(one)
    return out


def ask(spark: SparkSession, s: Settings, command: list[str], seconds: float = 600.0) -> str:
    """What a program says that reads the prompt and the document; both must fit the token budget, which bounds what the driver holds."""
    if s.budget() is None:
        raise ValueError("a program is only given a document within a token budget")
    text = render.joined(whole_document(spark, replace(s, paths=s.directories[:1])).drop("root_no"))
    done = subprocess.run(command, input=f"{s.prompt or ''}\n\n{text}".lstrip("\n"), capture_output=True, text=True, timeout=seconds)
    if done.returncode:
        raise RuntimeError(done.stderr.strip()[-200:] or f"{command[0]} failed")
    return done.stdout


def document(spark: SparkSession, s: Settings) -> DataFrame:
    """Fragments (ord, fragment) of the corpus query in the chosen format."""
    return render.FORMATS[s.format](corpus_query(spark, s))


def search_query(spark: SparkSession, pattern: str, s: Settings) -> DataFrame:
    """Files with a matching line (priority 10), with what they reach by imports, callers and types."""
    parts = []
    for root in s.directories:
        whole = corpus.scan(spark, root, corpus.ScanOptions(ignore=s.ignore, rules=s.priorities))
        hits = search.files_with_match(whole, pattern).withColumn("priority", F.lit(10.0))
        if not (s.imports or s.callers or s.types):
            parts.append(fit(hits, None, s.budget()).withColumn("root", F.lit(root)))
            continue
        project = read_project(root)
        a = analyse(whole, project)
        files = _with_importers(_expanded(a, hits.select("relative_path", "priority"), s, project), a.edges)
        parts.append(fit(files, a.edges, s.budget()).withColumn("root", F.lit(root)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def diff_query(spark: SparkSession, repo: str, old: str, new: str, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(files, statistics): changed files that exist now, with semantic context (changed = false), always ranked."""
    root = gitlog.repository_root(repo)
    changed = gitlog.changed_files(spark, root, old, new)
    whole = corpus.scan(spark, root, corpus.ScanOptions(rules=s.priorities))
    own = whole.join(changed.toDF("relative_path"), "relative_path", "left_semi")
    edges, files = None, own
    if s.imports or s.callers or s.types:
        project = read_project(root)
        a = analyse(whole, project)
        files, edges = _with_importers(_expanded(a, own.select("relative_path", "priority"), s, project), a.edges), a.edges
    out = fit(files, edges, s.budget())
    marks = changed.toDF("relative_path").withColumn("changed", F.lit(True))
    out = out.join(marks, "relative_path", "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
    return out, search.numstat_totals(gitlog.numstat(spark, root, old, new))


def diff_document(spark: SparkSession, repo: str, old: str, new: str, s: Settings) -> DataFrame:
    """Fragments of the report on what changed between two revisions."""
    return render.diff_document(*diff_query(spark, repo, old, new, s), old, new)


def telemetry_query(spark: SparkSession, traces: str, roots: list[str], service: str | None = None, between: tuple[int, int] | None = None) -> dict[str, DataFrame]:
    """metrics by function, the correlated spans and a one-row summary."""
    spans = otlp.read(spark, traces).where("error is null")
    if service is not None:
        spans = telemetry.by_service(spans, service)
    if between is not None:
        spans = telemetry.in_time(spans, *between)
    spans = graph.settle(spans.withColumnRenamed("name", "span_name").withColumn("span_id", F.monotonically_increasing_id()))  # fixed before it is joined back
    defs = None
    for root in roots:
        found = split(all_facts(corpus.scan(spark, root)))["defs"].select("path", "name")
        defs = found if defs is None else defs.union(found)
    both = telemetry.cascade(spans, defs)
    hit = both.where("name is not null").drop("function_name", "file_path")
    failed = F.col("attributes")["status.code"].isin("2", "ERROR", "STATUS_CODE_ERROR")
    m = telemetry.metrics(hit, ["path", "name"], "duration_ms", ["span_id"], failed, F.col("attributes")["status.message"])
    return {"metrics": m, "spans": both, "summary": telemetry.summary(both), "report": render.metrics_report(m)}


# Service calls: each takes plain arguments and returns a DataFrame or a small dictionary.


def health() -> dict:
    return {"status": "healthy"}


def search_codebase(spark: SparkSession, root: str, query: str, most: int = 100, names: str | None = None) -> DataFrame:
    _check_path(root)
    return search.search_lines(corpus.scan(spark, root).withColumn("path", F.col("relative_path")), query, most, names)


def semantic_search(spark: SparkSession, root: str, query: str, kind: str = "functions", most: int = 100) -> DataFrame:
    _check_path(root)
    return search.symbols(split(all_facts(corpus.scan(spark, root))), query, kind, most)


def diff_files(spark: SparkSession, old: str, new: str, context: int = 3) -> DataFrame:
    for p in (old, new):
        _check_path(p)
    a, b = (Path(p).read_bytes().decode("utf-8", "replace") for p in (old, new))
    return search.diff(spark.createDataFrame([(new, a, b)], "key string, old string, new string"), context)


def file_metadata(path: str) -> dict:
    _check_path(path)
    return corpus.file_metadata(path)


def process_remote(spark: SparkSession, url: str, target: str, s: Settings) -> DataFrame:
    return corpus_query(spark, replace(s, paths=[gitlog.fetch(url, target)]))


def _check_path(path: str) -> None:
    if ".." in Path(path).parts or path.startswith("~"):
        raise ValueError(f"path must not step up or name a home: {path}")
