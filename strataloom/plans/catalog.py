"""The reference's queries over the driver's tables, each with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.globs import selected
from ..operators import graph, joins, rank, search, telemetry
from ..sources import tables as S
from . import render

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The corpus view in SQL, for the oracles.
CORPUS = """
WITH c0 AS (SELECT *, source || '/' || lang || '/doc_' || doc_id || '.' || CASE lang WHEN 'en' THEN 'rs' WHEN 'fr' THEN 'py' WHEN 'de' THEN 'ts' WHEN 'es' THEN 'go' ELSE 'md' END AS path FROM documents),
c AS (SELECT path, path AS relative_path, strlen(text)::BIGINT AS size, text AS content, doc_id,
  CASE lang WHEN 'en' THEN 'Rust' WHEN 'fr' THEN 'Python' WHEN 'de' THEN 'TypeScript' WHEN 'es' THEN 'Go' ELSE 'Markdown' END AS file_type,
  least(2.0::DOUBLE, CASE lang WHEN 'en' THEN 1.0::DOUBLE WHEN 'fr' THEN 0.9 WHEN 'de' THEN 0.95 WHEN 'es' THEN 0.9 ELSE 0.6 END
    * CASE WHEN contains(lower(path), 'main') OR contains(lower(path), 'index') THEN 1.5::DOUBLE ELSE 1.0 END * CASE WHEN contains(lower(path), 'lib') OR contains(lower(path), 'src') THEN 1.2::DOUBLE ELSE 1.0 END
    * CASE WHEN contains(lower(path), 'test') OR contains(lower(path), 'spec') THEN 0.8::DOUBLE ELSE 1.0 END * CASE WHEN contains(lower(path), 'example') OR contains(lower(path), 'sample') THEN 0.7::DOUBLE ELSE 1.0 END) AS priority,
  ceil(strlen(text) / 4.0)::BIGINT AS tokens FROM c0)
"""
TRANSITIONS = """
e AS (SELECT DISTINCT a.user_id AS src, b.user_id AS dst FROM events a JOIN events b ON b.event_id = a.event_id + 1
  WHERE a.user_id <> b.user_id)
"""


def query(sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def queries() -> dict[str, Query]:
    from . import project_queries  # noqa: F401  it registers its own here

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


# Scans, classification, filters


@query(CORPUS + "SELECT path, size, file_type FROM c WHERE size <= 10485760")
def corpus_scan(spark, d):
    return S.corpus(spark, d).where(F.col("size") <= 10 << 20).select("path", "size", "file_type")


@query(CORPUS + "SELECT file_type, count(*) AS files, sum(size)::BIGINT AS bytes, row_number() OVER (ORDER BY count(*) DESC, file_type)::INTEGER AS rank FROM c GROUP BY file_type")
def corpus_stats_by_type(spark, d):
    kinds = S.corpus(spark, d).groupBy("file_type").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return kinds.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("files"), "file_type")))  # one row a type


@query("SELECT md5(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dupes(spark, d):
    g = S.table(spark, d, "documents").groupBy(C.content_hash(F.col("text")).alias("content_hash"))
    return g.agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query(CORPUS + "SELECT path FROM c WHERE regexp_matches(path, '^(.*/)?[^/]*\\.(rs|go)$') AND NOT regexp_matches(path, '^src1/') AND NOT regexp_matches(path, '/doc_[^/]*7\\.rs$')")
def include_ignore_globs(spark, d):
    return S.corpus(spark, d).where(selected(F.col("path"), ["**/*.{rs,go}"], ["src1/", "doc_*7.rs"])).select("path")


@query(r"SELECT page_id, regexp_extract(url, '://[^/]*/([^?#]*)', 1) AS path FROM pages WHERE NOT regexp_matches(lower(url), '\.(exe|zip|png|gif|mp4|pdf|db|o)([?#]|$)')")
def binary_ext_anti(spark, d):
    return S.url_path(S.table(spark, d, "pages")).where(~C.is_binary_extension(F.col("path"))).select("page_id", "path")


@query(CORPUS + "SELECT path, round(priority, 6) AS priority FROM c")
def base_priority(spark, d):
    return S.corpus(spark, d).select("path", F.round("priority", 6).alias("priority"))


@query(CORPUS + "SELECT path, round(priority + CASE WHEN regexp_matches(path, '^src1/') THEN 5.0 WHEN regexp_matches(path, '\\.rs$') THEN 2.5 WHEN regexp_matches(path, '^src') THEN -0.5 ELSE 0 END, 6) AS priority FROM c")
def custom_priority_first_match(spark, d):
    rules = [("^src1/", 5.0), (r"\.rs$", 2.5), ("^src", -0.5)]
    return S.corpus(spark, d).select("path", F.round(C.custom_priority(F.col("priority"), F.col("path"), rules), 6).alias("priority"))


@query(CORPUS + "SELECT sum(tokens)::BIGINT AS content_tokens, sum(ceil(strlen('## ' || path || chr(10) || chr(10) || '```' || chr(10)) / 4.0) + 2)::BIGINT AS overhead_tokens, count(*) AS files FROM c")
def token_totals(spark, d):
    files = S.corpus(spark, d)
    return files.agg(F.sum("tokens").alias("content_tokens"), F.sum(C.overhead_tokens(F.col("path"))).alias("overhead_tokens"), F.count("*").alias("files"))


@query(
    CORPUS.replace("WITH c0", "WITH RECURSIVE c0", 1)
    + """, o AS (SELECT path, priority, tokens, row_number() OVER (ORDER BY priority DESC, path) AS rn FROM c),
r AS (SELECT 0::BIGINT AS rn, NULL::VARCHAR AS path, 0::BIGINT AS tokens, 20000::BIGINT AS rest, false AS kept
  UNION ALL SELECT o.rn, o.path, o.tokens, CASE WHEN o.tokens <= r.rest THEN r.rest - o.tokens ELSE r.rest END, o.tokens <= r.rest FROM r JOIN o ON o.rn = r.rn + 1)
SELECT path, tokens FROM r WHERE kept"""
)
def budget_greedy(spark, d):
    files = S.corpus(spark, d).select("path", "priority", "tokens")
    return rank.greedy_budget(files, 20_000).select("path", "tokens")


@query(CORPUS + "SELECT (ceil(strlen('# Code Context: .' || chr(10) || chr(10)) / 4.0) + ceil(strlen('## Statistics' || chr(10) || chr(10)) / 4.0) + 200 + 20 * count(*) + sum(ceil(strlen('- [' || path || '](#' || lower(translate(path, '/\\. ', '----')) || ')' || chr(10)) / 4.0)))::BIGINT AS overhead FROM c")
def structure_overhead(spark, d):
    return rank.structure_overhead(S.corpus(spark, d))


@query(CORPUS + "SELECT regexp_replace(path, '/[^/]*$', '') AS folder, path, row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY priority DESC, path)::INTEGER AS place FROM c")
def group_by_directory(spark, d):
    files = S.corpus(spark, d).withColumn("folder", C.dirname(F.col("path")))
    return files.select("folder", "path", F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("priority"), "path")).alias("place"))


@query(CORPUS + "SELECT path, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.2f KB', size / 1024.0::DOUBLE) ELSE printf('%.2f MB', size / 1048576.0::DOUBLE) END AS shown FROM c")
def human_size(spark, d):
    return S.corpus(spark, d).select("path", C.human_size(F.col("size")).alias("shown"))


@query(CORPUS + "SELECT path, lower(translate(path, '/\\. ', '----')) AS anchor, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.(py|rs|js|ts)$', '') AS shown FROM c")
def path_anchors(spark, d):
    p = F.col("path")
    return S.corpus(spark, d).select("path", C.anchor(p).alias("anchor"), C.import_display(p).alias("shown"))


@query(
    r"""WITH p AS (SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages),
j AS (SELECT a.page_id, string_split(a.path, '/') AS x, string_split(b.path, '/') AS y FROM p a JOIN p b ON b.page_id = a.page_id + 1)
SELECT page_id, coalesce(array_to_string(list_slice(x, 1, coalesce(list_min(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[i] <> y[i])) - 1, least(len(x), len(y)))), '/'), '') AS ancestor FROM j"""
)
def lca_path(spark, d):
    p = S.table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"://([^?#]*)", 1).alias("path"))
    nxt = p.select((F.col("page_id") - 1).alias("page_id"), F.col("path").alias("other"))
    return p.join(nxt, "page_id").select("page_id", C.common_ancestor(F.col("path"), F.col("other")).alias("ancestor"))


@query("SELECT doc_id, substr(text, 1, 1) AS head, CASE substr(text, 1, 1) WHEN 'ß' THEN 'SS' ELSE upper(substr(text, 1, 1)) END || substr(text, 2) AS shown FROM documents")
def capitalised(spark, d):
    t = F.col("text")
    return S.table(spark, d, "documents").select("doc_id", F.left(t, F.lit(1)).alias("head"), C.capitalise(t).alias("shown"))


@query("SELECT event_id, epoch_us(ts) * 1000 AS nanos FROM events")
def rfc3339_nanos(spark, d):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return S.table(spark, d, "events").select("event_id", C.epoch_nanos(stamp).alias("nanos"))


@query("SELECT page_id, ord::INTEGER AS ord, target, (length(trim(target)) > 0 AND NOT contains(lower(target), '/etc/') AND NOT contains(lower(target), 'javascript:') AND NOT contains(lower(target), 'data:') AND NOT contains(lower(target), 'file://')) AS secure, (length(target) BETWEEN 1 AND 255 AND regexp_matches(target, '^[A-Za-z0-9_./:@\\-]+$') AND NOT contains(target, '..')) AS valid FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target, generate_subscripts(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), 1) - 1 AS ord FROM pages)")
def import_safety(spark, d):
    t = F.col("target")
    return S.hrefs(spark, d).select("page_id", "ord", "target", C.is_secure_import(t).alias("secure"), C.is_valid_module(t).alias("valid"))


# Extraction and joins

HREFS = "h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target, generate_subscripts(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), 1) - 1 AS ord FROM pages)"


@query(f"WITH {HREFS} SELECT page_id, ord::INTEGER AS ord, target FROM h")
def href_imports(spark, d):
    return S.hrefs(spark, d)


@query(
    f"""WITH {HREFS}, k AS (SELECT DISTINCT split_part(text, ' ', 1) AS w FROM documents), cand AS (
SELECT page_id, h.ord, x.o, x.w FROM h, LATERAL (VALUES (0, substr(target, 2)), (1, regexp_replace(substr(target, 2), '[.,]$', '')), (2, CASE substr(target, 2, 1) WHEN 'ß' THEN 'SS' ELSE upper(substr(target, 2, 1)) END || substr(target, 3))) x(o, w))
SELECT page_id, ord::INTEGER AS ord, arg_min(w, o) AS resolved, min(o)::INTEGER AS choice FROM cand SEMI JOIN k USING (w) GROUP BY page_id, ord"""
)
def import_resolve_ranked(spark, d):
    """Links resolve to documents whose first word they name: as written, without punctuation, capitalised."""
    bare = F.substring("target", F.lit(2), F.length("target"))
    cand = F.array(F.struct(F.lit(0).alias("o"), bare.alias("w")), F.struct(F.lit(1).alias("o"), F.regexp_replace(bare, "[.,]$", "").alias("w")), F.struct(F.lit(2).alias("o"), C.capitalise(bare).alias("w")))
    rows = S.hrefs(spark, d).select("page_id", "ord", F.explode(cand).alias("c")).select("page_id", "ord", "c.o", "c.w")
    known = S.table(spark, d, "documents").select(F.split("text", " ", 2)[0].alias("w"))
    return joins.first_match(rows, ["page_id", "ord"], "w", known, "o").select("page_id", "ord", F.col("w").alias("resolved"), F.col("o").alias("choice"))


@query(f"WITH {HREFS} SELECT target AS node, list_sort(list(DISTINCT page_id)) AS imported_by FROM h GROUP BY target")
def reverse_edges(spark, d):
    return graph.imported_by(S.hrefs(spark, d).select(F.col("page_id").alias("src"), F.col("target").alias("dst")))


@query("SELECT doc_id, item_id FROM documents, benchmark WHERE contains(documents.text, benchmark.text)")
def type_refs_by_passage(spark, d):
    docs, items = S.table(spark, d, "documents"), S.table(spark, d, "benchmark")
    found = search.texts_with_passage(docs.select(F.col("doc_id").alias("doc"), "text"), items.select(F.col("item_id").alias("item"), F.col("text").alias("passage")))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


@query("SELECT DISTINCT c.c_custkey AS src, s.s_suppkey AS dst FROM customer c JOIN supplier s ON split_part(c.c_name, '#', 2) = split_part(s.s_name, '#', 2)")
def stem_join_edges(spark, d):
    stem = lambda c: F.split_part(c, F.lit("#"), F.lit(2))
    cust = S.table(spark, d, "customer").select(F.col("c_custkey").alias("src"), stem(F.col("c_name")).alias("k"))
    return cust.join(S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("dst"), stem(F.col("s_name")).alias("k")), "k").select("src", "dst").distinct()


@query("WITH t AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey IN (1, 2, 3)), x AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem SEMI JOIN t USING (l_suppkey)) SELECT DISTINCT 's' || x.l_suppkey AS target, 'o' || c.l_orderkey AS node FROM x JOIN lineitem c USING (l_partkey)")
def callers_of_files(spark, d):
    defs = S.exports(spark, d)
    targets = defs.where(F.col("path").isin("s1", "s2", "s3")).select("path").distinct()
    return joins.callers_of(targets, defs, S.calls(spark, d))


@query(f"WITH {HREFS}, e AS (SELECT DISTINCT 'p' || page_id AS src, target AS dst FROM h), t AS (SELECT dst FROM e GROUP BY dst HAVING count(*) BETWEEN 2 AND 5) SELECT DISTINCT src AS node FROM e SEMI JOIN t USING (dst)")
def importers_of_files(spark, d):
    e = S.hrefs(spark, d).select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("src"), F.col("target").alias("dst")).distinct()
    targets = e.groupBy(F.col("dst").alias("path")).count().where("count between 2 and 5")
    return joins.importers_of(targets, e)


@query("SELECT count(DISTINCT l_partkey) AS functions, count(DISTINCT (l_partkey, l_orderkey)) AS callers, count(DISTINCT l_suppkey) AS files_with_exports FROM lineitem")
def index_stats(spark, d):
    out = joins.index_stats(S.exports(spark, d), S.calls(spark, d))
    return out.select("functions", "callers", "files_with_exports")


@query("SELECT user_id, min(event_id) AS first_event, list_sort(list(DISTINCT event_type)) AS kinds FROM events GROUP BY user_id")
def normalize_merge(spark, d):
    e = S.table(spark, d, "events").select("user_id", F.col("event_id").alias("first_event"), F.array("event_type").alias("kinds"))
    return joins.merge_rows(e, "user_id", ["kinds"])


@query("SELECT p_partkey AS path, coalesce(n, 0)::BIGINT AS uses FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1) ON l_partkey = p_partkey")
def left_with_default(spark, d):
    uses = S.table(spark, d, "lineitem").where("l_quantity > 40").groupBy(F.col("l_partkey").alias("path")).agg(F.count("*").alias("uses"))
    return joins.with_default(S.table(spark, d, "part").select(F.col("p_partkey").alias("path")), uses, "path", {"uses": 0})


@query("WITH a AS (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A') SELECT 'both' AS part, count(*) AS n FROM (SELECT DISTINCT k FROM a SEMI JOIN b USING (k)) UNION ALL SELECT 'only_r', count(*) FROM (SELECT DISTINCT k FROM a ANTI JOIN b USING (k)) UNION ALL SELECT 'all', count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b) UNION ALL SELECT 'distinct', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)")
def union_except_semi_anti(spark, d):
    li = S.table(spark, d, "lineitem")
    a, b = (li.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k")) for f in "RA")
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return n(a.join(b, "k", "left_semi").distinct(), "both").union(n(a.join(b, "k", "left_anti").distinct(), "only_r")).union(n(a.union(b), "all")).union(n(a.union(b).distinct(), "distinct"))


@query("SELECT 'h' || (user_id // 10) AS path, event_type AS module, list_sort(list(DISTINCT props)) AS items, bool_or(value > 50) AS is_relative, min(event_id)::INTEGER AS line FROM events GROUP BY ALL")
def merged_imports(spark, d):
    """Imports of one file and module become one row."""
    e = S.table(spark, d, "events")
    path = F.concat(F.lit("h"), F.floor(F.col("user_id") / 10).cast("string")).alias("path")
    return joins.merge_imports(e.select(path, F.col("event_type").alias("module"), F.array("props").alias("items"), (F.col("value") > 50).alias("is_relative"), F.col("event_id").cast("int").alias("line")))


@query("SELECT user_id AS path, event_type AS name, min(CASE WHEN value > 50 THEN props END) AS module, (event_id // 1000)::INTEGER AS line FROM events GROUP BY ALL")
def qualified_references(spark, d):
    """References by path, name and line, with a module where any of them has one."""
    e = S.table(spark, d, "events")
    return joins.prefer_qualified(e.select(F.col("user_id").alias("path"), F.col("event_type").alias("name"), F.when(F.col("value") > 50, F.col("props")).alias("module"), F.floor(F.col("event_id") / 1000).cast("int").alias("line")))


@query("WITH i AS (SELECT user_id AS path, event_id AS line, event_type AS name, props AS m FROM events WHERE event_type IN ('view', 'click')), n AS (SELECT path, name, arg_max(m, (line, m)) AS m FROM i GROUP BY ALL) SELECT e.event_id AS line, e.user_id AS path, e.event_type AS name, n.m AS module FROM events e LEFT JOIN n ON n.path = e.user_id AND n.name = e.event_type")
def correlated_types(spark, d):
    """Names take the module of the last import of their file that lists them."""
    e = S.table(spark, d, "events")
    imports = e.where("event_type in ('view', 'click')").select(F.col("user_id").alias("path"), F.col("event_id").alias("line"), F.array("event_type").alias("items"), F.col("props").alias("module"))
    refs = e.select(F.col("event_id").alias("line"), F.col("user_id").alias("path"), F.col("event_type").alias("name"), F.lit(None).cast("string").alias("module"))
    return joins.qualify(refs, imports)


@query("WITH n AS (SELECT 'r' || n_regionkey || '/' || n_name || '.py' AS path, n_name AS name FROM nation), c AS (SELECT DISTINCT 'r' || (c_nationkey % 5) || '/c' || c_custkey || '.py' AS src, n_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey) SELECT src, c.name, n.path AS definition_path FROM c JOIN n ON n.name = c.name")
def type_definition_join(spark, d):
    """Each reference finds the file that defines its type."""
    nation = S.table(spark, d, "nation")
    defs = nation.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/"), F.col("n_name"), F.lit(".py")).alias("path"), F.col("n_name").alias("name"))
    cust = S.table(spark, d, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    refs = cust.select(F.concat(F.lit("r"), (F.col("c_nationkey") % 5).cast("string"), F.lit("/c"), F.col("c_custkey").cast("string"), F.lit(".py")).alias("path"), F.col("n_name").alias("name"))
    return joins.type_definitions(refs, defs)


# Graphs

SEEDS = "s AS (SELECT min(src) AS node FROM e)"
BFS = "WITH RECURSIVE " + TRANSITIONS + ", " + SEEDS + ", r AS (SELECT node, 0 AS depth FROM s UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < {n}), m AS (SELECT node, min(depth)::INTEGER AS depth FROM r GROUP BY node)"
REACH = "WITH RECURSIVE " + TRANSITIONS + ", " + SEEDS + ", r AS (SELECT node FROM s UNION SELECT e.dst FROM r JOIN e ON e.src = r.node)"


def _graph(spark, d):
    e = graph.settle(S.transitions(spark, d))
    return e, e.agg(F.min("src").alias("node"))


@query(BFS.format(n=3) + " SELECT node, depth FROM m")
def bfs_depth_n(spark, d):
    return graph.bfs(*_graph(spark, d), 3)


@query(BFS.format(n=2) + " SELECT node FROM m WHERE depth = 2")
def nodes_at_depth(spark, d):
    return graph.nodes_at_depth(*_graph(spark, d), 2)


@query(REACH + " SELECT node FROM r")
def reachable(spark, d):
    return graph.reachable(*_graph(spark, d))


@query(BFS.format(n=2) + " SELECT node, depth, CASE depth WHEN 0 THEN 'seed' ELSE 'import' END AS via FROM m")
def bounded_expansion(spark, d):
    return graph.expand(*_graph(spark, d), 2)


@query("WITH RECURSIVE " + TRANSITIONS + ", s AS (SELECT min(src) AS a, max(dst) AS z FROM e), r AS (SELECT a AS node, 0 AS depth FROM s UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < (SELECT count(DISTINCT src) FROM e)) SELECT min(depth)::BIGINT AS length FROM r, s WHERE node = z HAVING min(depth) IS NOT NULL")
def shortest_path_len(spark, d):
    e, _ = _graph(spark, d)
    a, z = e.agg(F.min("src"), F.max("dst")).first()
    return graph.shortest_path(e, a, z).select("length")


SCC = "WITH RECURSIVE " + TRANSITIONS + ", n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r AS (SELECT node AS a, node AS b FROM n UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b), c AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"


@query(SCC + " SELECT component, count(*) AS nodes FROM c GROUP BY component")
def scc_sizes(spark, d):
    return graph.strong_components(_graph(spark, d)[0]).groupBy("component").agg(F.count("*").alias("nodes"))


@query(SCC + " SELECT component, list_sort(list(node)) AS members FROM c GROUP BY component HAVING count(*) > 1")
def cycles(spark, d):
    return graph.cycles(_graph(spark, d)[0])


@query("WITH RECURSIVE " + TRANSITIONS + ", f AS (SELECT * FROM e WHERE src < dst), n AS (SELECT src AS node FROM f UNION SELECT dst FROM f), r AS (SELECT node, 0 AS level FROM n UNION SELECT f.src, r.level + 1 FROM r JOIN f ON f.dst = r.node) SELECT node, max(level)::INTEGER AS level FROM r GROUP BY node")
def topo_levels(spark, d):
    return graph.topological_levels(_graph(spark, d)[0].where("src < dst"))


@query("WITH f AS (SELECT 's' || s_suppkey AS path, s_acctbal / 1000 AS priority FROM supplier UNION ALL SELECT 'p' || p_partkey, p_size / 10.0::DOUBLE FROM part), e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem), g AS (SELECT dst AS path, sum(0.2::DOUBLE * priority) AS gain FROM e JOIN f ON f.path = e.src GROUP BY dst) SELECT path, round(CASE WHEN gain > 0 THEN least(priority + gain, 5.0) ELSE priority END, 6) AS priority FROM f LEFT JOIN g USING (path)")
def dependency_boost(spark, d):
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string")).alias("path")
    files = S.table(spark, d, "supplier").select(key("s", "s_suppkey"), (F.col("s_acctbal") / 1000).alias("priority")).union(S.table(spark, d, "part").select(key("p", "p_partkey"), (F.col("p_size") / 10.0).alias("priority")))
    e = S.table(spark, d, "lineitem").select(key("p", "l_partkey").alias("src"), key("s", "l_suppkey").alias("dst")).distinct()
    return rank.boost(files, e).withColumn("priority", F.round("priority", 6))


# Telemetry


@query("SELECT event_id AS span_id, event_type AS function_name FROM events WHERE user_id = 7 AND ts BETWEEN (SELECT min(ts) FROM events) AND (SELECT min(ts) + INTERVAL 5 DAY FROM events)")
def span_filter_service_time(spark, d):
    s = S.spans(spark, d)
    lo = s.agg(F.min("start_ns")).first()[0]
    return telemetry.in_time(telemetry.by_service(s, "7"), lo, lo + 5 * 86_400 * 10**9).select("span_id", "function_name")


@query("SELECT event_type AS function_name, count(*) AS call_count, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def function_latency_percentiles(spark, d):
    m = telemetry.metrics(S.spans(spark, d), ["function_name"], "duration_ms", ["start_ns", "span_id"], recent=None)
    return m.select("function_name", "call_count", "p50", "p95", "p99")


@query("WITH k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT event_type AS function_name, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM k WHERE r <= 1000 GROUP BY 1")
def function_latency_last1000(spark, d):
    return telemetry.metrics(S.spans(spark, d), ["function_name"], "duration_ms", ["start_ns", "span_id"]).select("function_name", "p50", "p95", "p99")


@query("SELECT user_id, count(*) AS call_count, count(*) FILTER (event_type = 'error') AS error_count, round(count(*) FILTER (event_type = 'error') / count(*)::DOUBLE, 6) AS error_rate FROM events GROUP BY user_id")
def function_error_rate(spark, d):
    m = telemetry.metrics(S.spans(spark, d), ["user_id"], "duration_ms", ["start_ns", "span_id"], F.col("function_name") == "error")
    return m.select("user_id", "call_count", "error_count", F.round("error_rate", 6).alias("error_rate"))


@query("SELECT user_id, arg_max(props, (ts, event_id)) FILTER (event_type = 'error') AS last_error FROM events GROUP BY user_id")
def last_error_per_key(spark, d):
    m = telemetry.metrics(S.spans(spark, d), ["user_id"], "duration_ms", ["ts", "span_id"], F.col("function_name") == "error", F.col("props"))
    return m.select("user_id", "last_error")


CASCADE = """WITH s AS (SELECT event_id AS span_id, 'n' || (user_id % 5) AS file_path, CASE event_type WHEN 'view' THEN 'BRAZIL' WHEN 'click' THEN 'iran' WHEN 'purchase' THEN 'STATES' WHEN 'signup' THEN 'NEW INDIA' ELSE 'nowhere' END AS function_name FROM events),
f AS (SELECT 'n' || n_regionkey AS path, n_name AS name FROM nation),
x AS (SELECT s.*, f.path, f.name, CASE WHEN f.path = s.file_path AND f.name = s.function_name THEN 1 WHEN f.name = s.function_name THEN 2 WHEN lower(f.name) = lower(s.function_name) THEN 3 WHEN suffix(f.name, s.function_name) THEN 4 WHEN suffix(s.function_name, f.name) THEN 5 END AS rank FROM s JOIN f ON true),
b AS (SELECT span_id, arg_min(path, (rank, name, path)) AS path, arg_min(name, (rank, name, path)) AS name, min(rank)::INTEGER AS rank FROM x WHERE rank IS NOT NULL GROUP BY span_id)
"""


def _cascade(spark, d):
    e = S.table(spark, d, "events")
    name = F.when(F.col("event_type") == "view", "BRAZIL").when(F.col("event_type") == "click", "iran").when(F.col("event_type") == "purchase", "STATES").when(F.col("event_type") == "signup", "NEW INDIA").otherwise("nowhere")
    spans = e.select(F.col("event_id").alias("span_id"), F.concat(F.lit("n"), (F.col("user_id") % 5).cast("string")).alias("file_path"), name.alias("function_name"))
    functions = S.table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_regionkey").cast("string")).alias("path"), F.col("n_name").alias("name"))
    return telemetry.cascade(spans, functions)


@query(CASCADE + "SELECT s.span_id, b.path, b.name, b.rank FROM s LEFT JOIN b USING (span_id)")
def span_cascade_join(spark, d):
    return _cascade(spark, d).select("span_id", "path", "name", "rank")


@query(CASCADE + "SELECT count(*) AS spans, count(b.name) AS correlated, count(DISTINCT (b.path, b.name)) FILTER (b.name IS NOT NULL) AS functions FROM s LEFT JOIN b USING (span_id)")
def correlation_summary(spark, d):
    return telemetry.summary(_cascade(spark, d))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k_int FROM events")
def json_attributes(spark, d):
    return S.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")).withColumn("k_int", F.expr("try_cast(k as bigint)"))


ONE_DECIMAL = "printf('%.1f', round_even({}::DECIMAL(30, 12), 1)::DOUBLE)"


@query(
    "WITH k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events),"
    " m AS (SELECT event_type AS f, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM k WHERE r <= 1000 GROUP BY 1),"
    " c AS (SELECT event_type AS f, count(*) AS n, 100.0::DOUBLE * (count(*) FILTER (event_type = 'error') / count(*)::DOUBLE) AS rate FROM events GROUP BY 1)"
    f" SELECT f AS function_name, '// calls: ' || n || ', p50: ' || {ONE_DECIMAL.format('p50')} || ' ms, p95: ' || {ONE_DECIMAL.format('p95')} || ' ms, p99: ' || {ONE_DECIMAL.format('p99')} || ' ms, errors: ' || {ONE_DECIMAL.format('rate')} || '%' AS comment FROM m JOIN c USING (f)"
)
def function_comments(spark, d):
    m = telemetry.metrics(S.spans(spark, d), ["function_name"], "duration_ms", ["start_ns", "span_id"], F.col("function_name") == "error")
    return m.select("function_name", telemetry.function_comment().alias("comment"))


# Search, history, diffs


@query(CORPUS + "SELECT path FROM c WHERE contains(lower(content), 'license')")
def files_with_match(spark, d):
    return search.files_with_match(S.corpus(spark, d), "License").select("path")


@query(CORPUS + ", l AS (SELECT path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM c), m AS (SELECT *, strpos(lower(text), 'license') AS pos FROM l) SELECT path, line::INTEGER AS line, (CASE WHEN pos > 21 THEN '...' ELSE '' END || substr(text, greatest(pos - 20, 1)::BIGINT, (least(pos + 26, length(text)) - greatest(pos - 20, 1) + 1)::BIGINT) || CASE WHEN pos + 26 < length(text) THEN '...' ELSE '' END) AS snippet FROM m WHERE pos > 0 ORDER BY path, line LIMIT 50")
def line_search_limit(spark, d):
    return search.search_lines(S.corpus(spark, d), "license", 50).select("path", "line", "snippet")


@query(f"WITH {HREFS} SELECT page_id AS path, target AS name, ord::INTEGER AS line, 'call' AS kind FROM h WHERE contains(lower(target), 'the') UNION ALL SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1), 0, 'type' FROM pages WHERE contains(lower(regexp_extract(html, '<title>([^<]*)', 1)), 'the')")
def symbol_search_union(spark, d):
    h = S.hrefs(spark, d).select(F.col("page_id").alias("path"), F.col("target").alias("name"), F.col("ord").alias("line"))
    t = S.table(spark, d, "pages").select(F.col("page_id").alias("path"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("name"), F.lit(0).alias("line"))
    return search.symbols({"calls": h, "type_refs": t}, "the", "references", None)


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text)::INTEGER AS place FROM conversations QUALIFY place <= 3")
def topn_history(spark, d):
    late = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")
    return S.table(spark, d, "conversations").withColumn("place", F.row_number().over(late)).where("place <= 3").select("conv_id", "turn", "role", "place")


@query("WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderstatus <> 'F') SELECT o_orderkey AS key, CASE WHEN o_orderstatus IS NULL THEN 'added' WHEN s IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b USING (o_orderkey) WHERE o_orderstatus IS DISTINCT FROM s")
def changed_files(spark, d):
    o = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("s"), "o_totalprice")
    new = o.where("s <> 'F'").select("key", F.when(F.col("o_totalprice") > 300000, "X").otherwise(F.col("s")).alias("s"))
    return search.changed_rows(o.where("s <> 'P'").select("key", "s"), new, "key")


@query("SELECT count(*) AS files_changed, coalesce(sum(try_cast(l_quantity::BIGINT::VARCHAR AS BIGINT)) FILTER (l_returnflag <> 'R'), 0)::BIGINT AS insertions, coalesce(sum(l_linenumber), 0)::BIGINT AS deletions FROM lineitem")
def diff_stats(spark, d):
    li = S.table(spark, d, "lineitem")
    plus = F.when(F.col("l_returnflag") == "R", "-").otherwise(F.col("l_quantity").cast("bigint").cast("string"))
    return search.numstat_totals(li.select(F.col("l_orderkey").cast("string").alias("path"), plus.alias("insertions"), F.col("l_linenumber").cast("string").alias("deletions")))


@query("""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: i || ' ' || x) AS a FROM documents), k AS (SELECT *, (1 + doc_id % len(a))::INTEGER AS k FROM l)
SELECT doc_id AS key, 0 AS hunk, greatest(1, k - 3)::INTEGER AS old_start, (least(3, k - 1) + 1)::INTEGER AS old_lines, greatest(1, k - 3)::INTEGER AS new_start, (least(3, k - 1) + 1)::INTEGER AS new_lines, 1 AS removed, 1 AS added,
array_to_string(list_concat(list_transform(CASE WHEN k > 1 THEN a[greatest(1, k - 3):k - 1] ELSE [] END, lambda x: ' ' || x || chr(10)), ['-' || a[k] || chr(10), '+changed' || chr(10)], list_transform(a[k + 1:k + 3], lambda x: ' ' || x || chr(10))), '') AS text FROM k""")  # fmt: skip
def one_line_diff(spark, d):
    """Each document, its lines numbered, against itself with one line changed."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat((i + 1).cast("string"), F.lit(" "), x))
    docs = S.table(spark, d, "documents").select(F.col("doc_id").alias("key"), lines.alias("a"))
    at = F.pmod(F.col("key"), F.size("a"))
    return search.diff(docs.select("key", F.array_join("a", "\n").alias("old"), F.array_join(F.transform("a", lambda x, i: F.when(i == at, F.lit("changed")).otherwise(x)), "\n").alias("new")))


@query()
def two_doc_diff(spark, d):
    """Each document against the next one."""
    docs = S.table(spark, d, "documents")
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("new"))
    return search.diff(docs.join(nxt, "doc_id").select(F.col("doc_id").alias("key"), F.col("text").alias("old"), "new"))


# Rendering


@query(CORPUS + ", n AS (SELECT DISTINCT string_split(path, '/') AS p, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM c) SELECT DISTINCT array_to_string(list_transform(p[1:i], lambda x, k: CASE WHEN k < i OR i < len(p) THEN '0' ELSE '1' END || x), '/') AS sort_key, repeat('│   ', i - 1) || '├── ' || p[i] || CASE WHEN i < len(p) THEN '/' ELSE '' END AS line FROM n")
def tree_render(spark, d):
    return render.tree_lines(S.corpus(spark, d))


@query(CORPUS + "SELECT path, '## ' || path || chr(10) || chr(10) || '```' || CASE file_type WHEN 'Rust' THEN 'rust' WHEN 'Python' THEN 'python' WHEN 'TypeScript' THEN 'typescript' WHEN 'Go' THEN 'go' ELSE 'markdown' END || chr(10) || content || CASE WHEN suffix(content, chr(10)) THEN '' ELSE chr(10) END || '```' || chr(10) || chr(10) AS fragment FROM c")
def markdown_doc(spark, d):
    return render.markdown_files(S.corpus(spark, d)).select("ord.path", "fragment")


@query(CORPUS + "SELECT path AS ord, '<file path=\"' || path || '\"><![CDATA[' || replace(content, ']]>', ']]]]><![CDATA[>') || ']]></file>' || chr(10) AS fragment FROM c")
def xml_doc(spark, d):
    return render.xml_files(S.corpus(spark, d))


@query(CORPUS + "SELECT path AS ord, repeat('=', 64) || chr(10) || 'File: ' || path || chr(10) || repeat('-', 64) || chr(10) || content || chr(10) AS fragment FROM c")
def plain_doc(spark, d):
    return render.plain_files(S.corpus(spark, d))


@query(CORPUS + "SELECT path AS ord, path AS fragment FROM c")
def paths_doc(spark, d):
    return render.path_lines(S.corpus(spark, d))


@query(CORPUS + "SELECT path AS ord, '- [' || path || '](#' || lower(translate(path, '/\\. ', '----')) || ')' AS fragment FROM c")
def table_of_contents(spark, d):
    return render.toc_lines(S.corpus(spark, d)).select("ord.path", "fragment").withColumnRenamed("path", "ord")
