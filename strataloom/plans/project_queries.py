"""Queries that run extraction, resolution and expansion over the project corpus, each with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..extract.facts import all_facts, split
from ..functions import columns as C
from ..operators import graph, joins, search, telemetry
from ..operators.resolve import resolve
from ..sources import projects as P
from ..sources import tables as S
from ..sources.config import Settings
from . import api, render
from .catalog import CORPUS, TRANSITIONS, _graph, query

WITH = f"WITH {P.PATHS} "


def _facts(spark, d, *kinds: str):
    return split(all_facts(P.files(spark, d), kinds=kinds))


def _rows(*rules: tuple[int, str]) -> str:
    """SQL: for each (language number, columns), a row for every file of that language; in the columns {i} and {j} are ids."""
    one = lambda k, columns: f"SELECT path, {columns.replace('{i}', 'i').replace('{j}', '(i + 6)')} FROM f WHERE k = {k}"
    return " UNION ALL ".join(one(k, c) for k, c in rules)


# Facts


@query(WITH + ", x(path, module, items, is_relative, line) AS (" + _rows(
    (0, "'os', []::VARCHAR[], false, 1"), (0, "'py.m' || {j}, ['M' || {j}], false, 2"), (0, "'py.m' || {j}, ['helper' || {j}], false, 2"),
    (1, "'crate::m' || {j}, ['M' || {j}], true, 1"), (1, "'crate::m' || {j}, ['helper' || {j}], true, 1"), (1, "'std::fmt', []::VARCHAR[], false, 2"),
    (2, "'./m' || {j}, ['M' || {j}, 'helper' || {j}], true, 1"), (2, "'fs', ['*'], false, 2"),
    (3, "'fmt', []::VARCHAR[], false, 4"), (3, "'example.org/app/go/p' || {j}, ['q'], false, 5"),
    (4, "'./j' || {j}, []::VARCHAR[], true, 1"), (5, "'Foundation', []::VARCHAR[], false, 1"), (5, "'T' || {j}, []::VARCHAR[], false, 2"),
) + ") SELECT path, module, array_to_string(items, ',') AS items, is_relative, line::INTEGER AS line FROM x")
def project_imports(spark, d):
    return _facts(spark, d, "import")["imports"].select("path", "module", F.array_join("items", ",").alias("items"), "is_relative", "line")


@query(WITH + ", x(path, name, module, line) AS (" + _rows(
    (0, "'helper' || {j}, NULL, 6"), (0, "'getpid', 'os', 9"), (0, "'getpid', NULL, 9"),
    (1, "'helper' || {j}, 'm' || {j}, 7"), (1, "'helper' || {i}, NULL, 11"), (2, "'helper' || {j}, NULL, 7"),
    (3, "'Println', 'fmt', 11"), (3, "'Helper' || {j}, 'example.org/app/go/p' || {j}, 11"),
    (4, "'require', NULL, 1"), (4, "'helper' || {j}, 'dep', 4"), (5, "'helper' || {j}, NULL, 6"),
) + ") SELECT path, name, module, line::INTEGER AS line FROM x")
def project_calls(spark, d):
    return _facts(spark, d, "call")["calls"]


DEFS = ", x(path, name, is_exported, line) AS (" + _rows(
    (0, "'run', true, 5"), (0, "'helper' || {i}, true, 8"), (0, "'_hidden' || {i}, false, 11"), (1, "'helper' || {i}, true, 6"), (1, "'hidden' || {i}, false, 10"),
    (2, "'helper' || {i}, true, 6"), (3, "'Helper' || {i}, true, 10"), (4, "'helper' || {i}, true, 3"), (4, "'helper' || {i}, true, 7"), (5, "'run', true, 5"),
) + ")"


@query(WITH + DEFS + " SELECT path, name, is_exported, line::INTEGER AS line FROM x")
def project_definitions(spark, d):
    return _facts(spark, d, "def")["defs"]


@query(WITH + ", x(path, name, module, line) AS (" + _rows(
    (0, "'M' || {j}, NULL, 4"), (0, "'M' || {j}, NULL, 5"), (1, "'M' || {j}, 'crate::m' || {j}, 1"), (1, "'M' || {i}, NULL, 4"), (1, "'M' || {j}, 'crate::m' || {j}, 6"), (1, "'M' || {j}, 'crate::m' || {j}, 11"),
    (2, "'M' || {j}, NULL, 6"), (3, "'M' || {i}, NULL, 8"), (3, "'M' || {j}, 'example.org/app/go/p' || {j}, 10"), (5, "'M' || {j}, NULL, 5"),
) + ") SELECT path, name, module, line::INTEGER AS line FROM x")
def project_type_references(spark, d):
    return _facts(spark, d, "type_ref")["type_refs"]


@query(WITH + ", x(path, name, kind, line) AS (" + _rows(
    (0, "'M' || {i}, 'class', 4"), (0, "'run', 'def', 5"), (0, "'helper' || {i}, 'def', 8"), (0, "'_hidden' || {i}, 'def', 11"), (1, "'M' || {i}, 'struct', 4"),
    (2, "'M' || {i}, 'interface', 4"), (3, "'M' || {i}, '', 8"), (4, "'helper' || {i}, 'function', 3"), (5, "'M' || {i}, 'struct', 4"),
) + ") SELECT path, name, kind, line::INTEGER AS line FROM x")
def project_type_definitions(spark, d):
    return _facts(spark, d, "type_def")["type_defs"]


# Resolution and joins over facts

RESOLVED = ", x(path, module, item, i, j, sure, outside) AS (" + " UNION ALL ".join(
    f"SELECT path, {m}, {item}, i, {j}, {sure}, {outside} FROM f WHERE k = {k}".replace("{j}", "(i + 6)")
    for k, m, item, j, sure, outside in (
        (0, "'os'", "NULL", "NULL", "0.9", "1.0"), (0, "'py.m' || {j}", "'M' || {j}", "i + 6", "0.9", "0.5"), (0, "'py.m' || {j}", "'helper' || {j}", "i + 6", "0.9", "0.5"),
        (1, "'crate::m' || {j}", "'M' || {j}", "i + 6", "0.9", "0.5"), (1, "'crate::m' || {j}", "'helper' || {j}", "i + 6", "0.9", "0.5"), (1, "'std::fmt'", "NULL", "NULL", "0.9", "1.0"),
        (2, "'./m' || {j}", "'M' || {j}", "i + 6", "0.9", "0.5"), (2, "'./m' || {j}", "'helper' || {j}", "i + 6", "0.9", "0.5"), (2, "'fs'", "'*'", "NULL", "0.9", "1.0"),
        (3, "'fmt'", "NULL", "NULL", "0.95", "1.0"), (3, "'example.org/app/go/p' || {j}", "'q'", "i + 6", "0.95", "0.5"),
        (4, "'./j' || {j}", "NULL", "i + 6", "0.9", "0.5"), (5, "'Foundation'", "NULL", "NULL", "0.9", "0.5"), (5, "'T' || {j}", "NULL", "i + 6", "0.9", "0.5"),
    )
) + ")"


@query(WITH + RESOLVED + " SELECT x.path, module, item, f.path AS target, f.path IS NULL AS is_external, CASE WHEN f.path IS NULL THEN outside ELSE sure END::DOUBLE AS confidence FROM x LEFT JOIN f ON f.i = x.j")
def project_resolution(spark, d):
    files = P.files(spark, d)
    return resolve(split(all_facts(files, kinds=("import",)))["imports"], files, P.PROJECT)


@query(WITH + "SELECT a.path AS src, b.path AS dst FROM f a JOIN f b ON b.i = a.i + 6 WHERE a.k = 1")
def project_call_edges(spark, d):
    """Calls that name the module they call: Rust's, here."""
    return joins.call_edges(_facts(spark, d, "call")["calls"], P.files(spark, d))


@query(WITH + "SELECT a.path AS src, 'M' || b.i AS name, b.path AS definition_path FROM f a JOIN f b ON b.i = a.i + 6 WHERE a.k <> 4")
def project_definition_paths(spark, d):
    return joins.definition_paths(_facts(spark, d, "type_ref")["type_refs"], P.files(spark, d))


@query(WITH + "SELECT a.path AS src, 'M' || b.i AS name, b.path AS definition_path FROM f a JOIN f b ON b.i = a.i + 6 WHERE a.k <> 4")
def project_type_joins(spark, d):
    found = _facts(spark, d, "type_ref", "type_def")
    return joins.type_definitions(found["type_refs"], found["type_defs"])


@query(WITH + "SELECT b.path AS target, a.path AS node FROM f a JOIN f b ON b.i = a.i + 6 WHERE b.i % 5 = 0 AND a.i % 5 <> 0 AND a.k <> 5")
def project_callers(spark, d):
    files, found = P.files(spark, d), _facts(spark, d, "def", "call")
    return joins.callers_of(files.where("doc_id % 5 = 0").select("path"), found["defs"], found["calls"], joins.call_may_reach(F.col("target"), F.col("node"), F.col("module")))


@query(WITH + "SELECT DISTINCT a.path AS node FROM f a JOIN f b ON b.i = a.i + 6 WHERE b.i % 5 = 0 AND a.i % 5 <> 0 AND a.k <> 5")
def project_calling_files(spark, d):
    files, found = P.files(spark, d), _facts(spark, d, "def", "call")
    return joins.calling_files(files.where("doc_id % 5 = 0").select("path"), found["defs"], found["calls"])


EXPANDED = WITH + """, s AS (SELECT i FROM f WHERE i % 97 = 0),
r AS (SELECT DISTINCT f.i, f.k, f.path, f.i % 97 = 0 AS seed FROM s, (VALUES (-6), (0), (6), (12), (18)) v(d) JOIN f ON f.i = s.i + v.d)
SELECT r.path AS relative_path, CASE WHEN b.path IS NULL THEN '' ELSE b.path END AS imports, CASE WHEN a.path IS NULL THEN '' ELSE a.path END AS imported_by, r.seed
FROM r LEFT JOIN r b ON b.i = r.i + 6 LEFT JOIN r a ON a.i = r.i - 6"""


@query(EXPANDED)
def project_expansion(spark, d):
    """Imports and types to depth 3 and callers, with the edges within the result."""
    files = P.files(spark, d)
    a = api.analyse(files, P.PROJECT)
    seeds = files.where("doc_id % 97 = 0").select("relative_path", F.lit(9.0).alias("priority"))
    found = api._with_importers(api._expanded(a, seeds, Settings(imports=True, callers=True, types=True, semantic_depth=3), P.PROJECT), a.edges)
    return found.select("relative_path", F.array_join("imports", ",").alias("imports"), F.array_join("imported_by", ",").alias("imported_by"), (F.col("priority") == 9.0).alias("seed"))


@query(WITH + DEFS + ", c(path, name) AS (" + _rows((0, "'getpid'"), (0, "'helper' || {j}"), (1, "'helper' || {j}"), (1, "'helper' || {i}"), (2, "'helper' || {j}"), (3, "'Println'"), (3, "'Helper' || {j}"), (4, "'require'"), (4, "'helper' || {j}"), (5, "'helper' || {j}"))
       + ") SELECT (SELECT count(DISTINCT name) FROM c) AS functions, (SELECT count(DISTINCT path) FROM x WHERE is_exported) AS files_with_exports, (SELECT count(DISTINCT (name, path)) FROM c) AS callers")
def project_index_stats(spark, d):
    found = _facts(spark, d, "def", "call")
    return joins.index_stats(found["defs"], found["calls"])


@query(WITH + DEFS + " SELECT path, name, line::INTEGER AS line, 'function' AS kind FROM x WHERE contains(lower(name), 'helper1') ORDER BY path, line, name LIMIT 40")
def project_symbol_search(spark, d):
    return search.symbols(_facts(spark, d, "def"), "HELPER1", "functions", 40)


# Columns that only these queries reach


@query(CORPUS + """SELECT path, regexp_extract(path, '([^.]*)$', 1) AS label, CASE regexp_extract(path, '([^.]*)$', 1) WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' ELSE 'markdown' END AS fence,
CASE regexp_extract(path, '([^.]*)$', 1) WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' ELSE 'md' END AS language, file_type AS display,
CASE file_type WHEN 'Rust' THEN 1 WHEN 'Python' THEN 2 WHEN 'TypeScript' THEN 3 WHEN 'Go' THEN 4 ELSE 21 END::INTEGER AS place, size // 4 AS rough, ceil(size * 1.2)::BIGINT AS estimate,
'a/b/' || path AS forward, CASE lang WHEN 'en' THEN path ELSE 'm.' || path END AS called, CASE lang WHEN 'en' THEN path ELSE 'm::' || path END AS typed, replace(replace(path, '::', '/'), '.', '/') AS module FROM c JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)""")  # fmt: skip
def path_labels(spark, d):
    p, kind = F.col("path"), F.col("file_type")
    module = F.when(F.col("file_type") != "Rust", F.lit("m"))
    return S.corpus(spark, d).select(
        "path", C.extension(p).alias("label"), C.fence_of_extension(p).alias("fence"), C.graph_language(p).alias("language"), C.type_display(kind).alias("display"), C.type_order(kind).alias("place"),
        C.rough_tokens(F.col("content")).alias("rough"), C.output_estimate(F.col("size")).alias("estimate"), C.forward_slashes(F.concat(F.lit("a\\b\\"), p)).alias("forward"),
        C.call_display(p, module).alias("called"), C.type_display_name(p, F.when(module.isNotNull(), F.concat(F.lit("m::"), p))).alias("typed"), C.module_path(p).alias("module"),
    )


@query("""SELECT event_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE epoch_us(ts) * 1000 END AS start_ns, CASE WHEN user_id % 3 = 0 THEN NULL ELSE epoch_us(ts) * 1000 + 60000000000 END AS end_ns,
CASE WHEN user_id % 3 <> 0 THEN 60000.0::DOUBLE END AS ms FROM events""")  # fmt: skip
def time_ranges(spark, d):
    """Ranges `start/end`; every third one is turned round and gives nothing."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    a, b = stamp(F.col("ts").cast("timestamp")), stamp(F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 MINUTE"))
    text = F.when(F.col("user_id") % 3 == 0, F.concat(b, F.lit("/"), a)).otherwise(F.concat(a, F.lit("/"), b))
    r = C.time_range(text)
    return S.table(spark, d, "events").select("event_id", r["start_ns"].alias("start_ns"), r["end_ns"].alias("end_ns"), C.duration_ms(r["start_ns"], r["end_ns"]).alias("ms"))


@query("SELECT event_id, (user_id % 4 <> 3) AS inside FROM events")
def path_containment(spark, d):
    k, n = F.col("user_id") % 4, F.col("event_id").cast("string")
    path = F.when(k == 0, F.concat(F.lit("src/./a"), n)).when(k == 1, F.concat(F.lit("src/x/../b"), n)).when(k == 2, F.concat(F.lit("/work/src/"), n))
    path = path.otherwise(F.when(F.col("event_id") % 3 == 0, F.lit("src/%2e%2e/x")).when(F.col("event_id") % 3 == 1, F.lit("../work2/x")).otherwise(F.lit("/workshop/x")))
    return S.table(spark, d, "events").select("event_id", C.is_contained(path, "/work").alias("inside"))


@query("SELECT event_id AS span_id, CASE WHEN user_id % 2 = 0 THEN '/srv/app/f' || user_id ELSE '/abs/f' || user_id END AS file_path FROM events")
def span_paths_from_base(spark, d):
    rel = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("f"), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("/abs/f"), F.col("user_id").cast("string")))
    return telemetry.from_base(S.table(spark, d, "events").select(F.col("event_id").alias("span_id"), rel.alias("file_path")), "/srv/app/")


# Graph orders and whole documents


@query("WITH RECURSIVE " + TRANSITIONS + """, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r AS (SELECT node AS a, node AS b FROM n UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b),
c AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a),
k AS (SELECT e.* FROM e JOIN c p ON p.node = e.src JOIN c q ON q.node = e.dst WHERE p.component <> q.component),
l AS (SELECT node, 0 AS level FROM n UNION SELECT k.src, l.level + 1 FROM l JOIN k ON k.dst = l.node) SELECT node, max(level)::INTEGER AS level FROM l GROUP BY node""")  # fmt: skip
def levels_without_cycles(spark, d):
    return graph.levels_without_cycles(_graph(spark, d)[0])


@query(CORPUS + """, h AS (SELECT 0 AS part, 0 AS place, '' AS key, '# Code Context: .' || chr(10) || chr(10) AS fragment),
t AS (SELECT file_type, count(*) AS n FROM c GROUP BY 1),
st AS (SELECT 1 AS part, 0 AS place, '' AS key, '## Statistics' || chr(10) || chr(10) || '- Total files: ' || count(*) || chr(10) || '- Total size: ' ||
    CASE WHEN sum(size) < 1024 THEN sum(size) || ' B' WHEN sum(size) < 1048576 THEN printf('%.2f KB', sum(size) / 1024.0::DOUBLE) ELSE printf('%.2f MB', sum(size) / 1048576.0::DOUBLE) END || chr(10) AS fragment FROM c
  UNION ALL SELECT 1, 1, printf('%012d', 999999999999 - n) || file_type, '  - ' || file_type || ': ' || n || chr(10) FROM t UNION ALL SELECT 1, 2, '', chr(10)),
tr AS (SELECT DISTINCT array_to_string(list_transform(p[1:i], lambda x, k: CASE WHEN k < i OR i < len(p) THEN '0' ELSE '1' END || x), '/') AS key, repeat('│   ', i - 1) || '├── ' || p[i] || CASE WHEN i < len(p) THEN '/' ELSE '' END || chr(10) AS fragment
  FROM (SELECT DISTINCT string_split(path, '/') AS p, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM c)),
b AS (SELECT *, printf('%013.6f', 100000 - priority) || path AS r FROM c)
SELECT part::INTEGER AS part, place::INTEGER AS place, key, fragment FROM h UNION ALL SELECT part::INTEGER, place::INTEGER, key, fragment FROM st
UNION ALL SELECT 2, 0, '', '## File Structure' || chr(10) || chr(10) || '```' || chr(10) UNION ALL SELECT 2, 1, key, fragment FROM tr UNION ALL SELECT 2, 2, '', '```' || chr(10) || chr(10)
UNION ALL SELECT 3, 0, '', '## Table of Contents' || chr(10) || chr(10) UNION ALL SELECT 3, 1, r, '- [' || path || '](#' || lower(translate(path, '/\\. ', '----')) || ')' || chr(10) FROM b UNION ALL SELECT 3, 2, '', chr(10)
UNION ALL SELECT 4, 1, r, '## ' || path || chr(10) || chr(10) || '```' || CASE file_type WHEN 'Rust' THEN 'rust' WHEN 'Python' THEN 'python' WHEN 'TypeScript' THEN 'typescript' WHEN 'Go' THEN 'go' ELSE 'markdown' END || chr(10) || content || CASE WHEN suffix(content, chr(10)) THEN '' ELSE chr(10) END || '```' || chr(10) || chr(10) FROM b""")  # fmt: skip
def whole_document(spark, d):
    """Header, statistics, tree, table of contents and bodies, with the keys that order them; the SQL tells the total size in MB at most."""
    return render.document(S.corpus(spark, d), ".", largest="MB")


@query(CORPUS + "SELECT count(*) AS file_count FROM (SELECT unnest(string_split('## ' || path || chr(10) || content, chr(10))) AS line FROM c) WHERE starts_with(line, '## ') AND line NOT IN ('## Statistics', '## File Structure', '## Table of Contents')")
def document_file_count(spark, d):
    """Lines that look like file headings, but for the three of the document itself; content lines that look so count, too."""
    return render.file_count(render.document(S.corpus(spark, d), "."))


DIFFED = """, x AS (SELECT path, content, doc_id % 6 = 0 AS changed, regexp_extract(path, '([^.]*)$', 1) AS e FROM c WHERE doc_id % 3 = 0),
d(part, place, key, fragment) AS (SELECT 0, 0, '', '# Git Diff Analysis: a → b' || chr(10) || chr(10) || 'From: a' || chr(10) || 'To: b' || chr(10) || chr(10)
 UNION ALL SELECT 1, 0, '', '## Diff Statistics' || chr(10) || chr(10) || '- **Files changed**: ' || count(*) FILTER (changed) || chr(10) || '- **Lines added**: 7' || chr(10) || '- **Lines removed**: 5' || chr(10) || chr(10) FROM x
 UNION ALL SELECT 2, 0, '', '## Changed Files' || chr(10) || chr(10) UNION ALL SELECT 2, 1, path, '- `' || path || '`' || chr(10) FROM x WHERE changed UNION ALL SELECT 2, 2, '', chr(10)
 UNION ALL SELECT 3, 0, '', '## Semantic Context Files' || chr(10) || chr(10) UNION ALL SELECT 3, 1, path, '- `' || path || '`' || chr(10) FROM x WHERE NOT changed UNION ALL SELECT 3, 2, '', chr(10)
 UNION ALL SELECT 4, 0, '', '## File Contents' || chr(10) || chr(10)
 UNION ALL SELECT 4, 1, path, '### ' || path || chr(10) || chr(10) || '```' || CASE e WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' ELSE 'markdown' END || chr(10) || content || chr(10) || '```' || chr(10) || chr(10) FROM x)
SELECT * FROM d UNION ALL SELECT 5, 0, '', '## Context Statistics' || chr(10) || chr(10) || '- **Files processed**: ' || (SELECT count(*) FROM x) || chr(10) || '- **Estimated tokens**: ' || ceil(sum(strlen(fragment)) / 4.0)::BIGINT || chr(10) FROM d"""


@query(CORPUS + DIFFED)
def diff_document(spark, d):
    files = S.corpus(spark, d).where("doc_id % 3 = 0").withColumns({"changed": F.col("doc_id") % 6 == 0, "error": F.lit(None).cast("string")})
    totals = files.agg(F.count_if("changed").alias("files_changed"), F.lit(7).alias("insertions"), F.lit(5).alias("deletions"))
    return render.diff_document(files, totals, "a", "b")
