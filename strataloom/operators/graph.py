"""Graph operators over edge tables (src, dst), as frontier loops and joins.

Each level is a join of a small frontier with the edges and an anti join with what has been
seen; levels are written to the checkpoint folder so that plans stay short and lost
executors cost one level only. Nothing but counts reaches the driver.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """df, computed once and cut off from its lineage by a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def _folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or f"file://{tempfile.mkdtemp(prefix='strataloom-graph-')}"


def edges_of(df: DataFrame, src: str, dst: str) -> DataFrame:
    """Edges without self loops and repeats."""
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst").distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def imported_by(edges: DataFrame) -> DataFrame:
    """node, imported_by: the sorted distinct sources of its edges."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("imported_by"))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """node, depth: the least number of steps from any seed (column node), up to `depth` if given."""
    seen = settle(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    front, level = seen, 0
    while depth is None or level < depth:
        level += 1
        step = front.select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node")).distinct()
        front = settle(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(level)))
        if front.isEmpty():
            break
        seen = settle(seen.union(front))
    return seen


def nodes_at_depth(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    return bfs(edges, seeds, depth).where(F.col("depth") == depth).select("node")


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return bfs(edges, seeds).select("node")


def shortest_path(edges: DataFrame, start, goal) -> DataFrame:
    """path array and length of one shortest path (least node first among equals); no row if there is none."""
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    front = spark.range(1).select(F.lit(start).cast(kind).alias("node")).withColumn("path", F.array("node"))
    seen = front.select("node")
    while True:
        hit = front.where(F.col("node") == F.lit(goal))
        if not hit.isEmpty():
            return hit.select("path", (F.size("path") - 1).cast("bigint").alias("length"))
        step = front.select(F.col("node").alias("src"), "path").join(edges, "src").select(F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
        step = step.groupBy("node").agg(F.min("path").alias("path")).join(seen, "node", "left_anti")
        front = settle(step)
        if front.isEmpty():
            return front.select("path", F.size("path").cast("bigint").alias("length"))
        seen = settle(seen.union(front.select("node")))


def topological_levels(edges: DataFrame) -> DataFrame:
    """node, level: 0 for nodes that depend on nothing, else one above the highest of their dependencies (src depends on dst).

    Counts of open dependencies go down level by level, so that every edge is met once. Raises
    ValueError if a cycle is left.
    """
    edges = settle(edges.select("src", "dst").distinct())
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    open_ = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))
    state = nodes.join(open_, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("left"))
    state = settle(state.withColumn("level", F.when(F.col("left") == 0, F.lit(0))))
    level = 0
    while not (front := state.where(F.col("level") == level)).isEmpty():
        met = front.select(F.col("node").alias("dst")).join(edges, "dst").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("met"))
        left = F.col("left") - F.coalesce("met", F.lit(0))
        level += 1
        state = settle(state.join(met, "node", "left").select("node", left.alias("left"), F.coalesce("level", F.when(left == 0, F.lit(level))).alias("level")))
    if not state.where("level is null").isEmpty():
        raise ValueError("the graph has a cycle")
    return state.select("node", "level")


def _spread_least(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """labels (node, label) after each node has taken the least label among itself and all that can reach it."""
    while True:
        sent = labels.join(edges, labels["node"] == edges["src"]).select(F.col("dst").alias("node"), "label")
        new = settle(labels.union(sent).groupBy("node").agg(F.min("label").alias("label")))
        if new.join(labels, ["node", "label"], "left_anti").isEmpty():
            return new
        labels = new


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node), by trimming, colouring forward and collecting backward; every node has a row."""
    kind = dict(edges.dtypes)["src"]
    nodes = settle(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    left = settle(edges.where("src <> dst"))
    found = nodes.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    while True:
        while True:  # a node without a way in or out is a component of its own
            both = left.select(F.col("src").alias("node")).intersect(left.select(F.col("dst").alias("node")))
            alone = settle(nodes.join(both, "node", "left_anti"))
            if alone.isEmpty():
                break
            found = found.union(alone.select("node", F.col("node").alias("component")))
            nodes = settle(nodes.join(alone, "node", "left_anti"))
            left = settle(left.join(nodes.toDF("src"), "src", "left_semi").join(nodes.toDF("dst"), "dst", "left_semi").select("src", "dst"))
        if nodes.isEmpty():
            return found
        colour = _spread_least(left, nodes.select("node", F.col("node").alias("label")))
        # Within a colour, what reaches its least node backward is the component of that node.
        c1, c2 = colour.toDF("src", "a"), colour.toDF("dst", "b")
        inner = settle(left.join(c1, "src").join(c2, "dst").where("a = b").select("src", "dst"))
        roots = colour.where("node = label").select("node")
        back = bfs(reverse(inner), roots).select("node")
        part = settle(colour.join(back, "node", "left_semi").select("node", F.col("label").alias("component")))
        found = settle(found.union(part))
        nodes = settle(nodes.join(part, "node", "left_anti"))
        left = settle(left.join(nodes.toDF("src"), "src", "left_semi").join(nodes.toDF("dst"), "dst", "left_semi").select("src", "dst"))


def cycles(edges: DataFrame) -> DataFrame:
    """component, members: strong components of more than one node, and nodes with a self loop."""
    comp = strong_components(edges)
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct().withColumn("loop", F.lit(True))
    groups = comp.join(loops, "node", "left").groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members"), F.max("loop").alias("loop"))
    return groups.where((F.size("members") > 1) | F.col("loop")).select("component", "members")


def levels_without_cycles(edges: DataFrame) -> DataFrame:
    """node, level as topological_levels has them, with the edges inside a strong component left out: an order for any graph."""
    edges = settle(edges.where("src <> dst"))
    comp = settle(strong_components(edges))
    a, b = comp.toDF("src", "a"), comp.toDF("dst", "b")
    between = edges.join(a, "src").join(b, "dst").where("a <> b").select("src", "dst")
    levels = topological_levels(between)
    alone = comp.select("node").join(levels, "node", "left_anti").withColumn("level", F.lit(0))
    return levels.union(alone)


def expand(edges: DataFrame, seeds: DataFrame, depth: int, types: DataFrame | None = None, callers: DataFrame | None = None, ignored: DataFrame | None = None) -> DataFrame:
    """node, depth, via: bounded expansion of seeds by imports, types and callers.

    Imports reach max(1, depth) steps; types (src, dst) reach `depth` and none at 0; callers (node,
    and target if they belong to some seeds only) are one step and never go on. What is seen once is not expanded again; in a level imports come
    before types. Ignored nodes are dropped at the end but seeds stay.
    """
    seen = seeds.select("node").distinct().withColumns({"depth": F.lit(0), "via": F.lit("seed")})
    if callers is not None:
        if "target" in callers.columns:
            callers = callers.join(seeds.select(F.col("node").alias("target")), "target", "left_semi")
        first = callers.select("node").distinct().join(seen, "node", "left_anti")
        seen = seen.union(first.withColumns({"depth": F.lit(1), "via": F.lit("caller")}))
    seen = settle(seen)
    front_i = front_t = seen.where("via = 'seed'").select("node")
    for level in range(1, max(1, depth) + 1):
        new_i = settle(front_i.toDF("src").join(edges, "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        seen = settle(seen.union(new_i.withColumns({"depth": F.lit(level), "via": F.lit("import")})))
        new_t = None
        if types is not None and level <= depth:
            new_t = settle(front_t.toDF("src").join(types, "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
            seen = settle(seen.union(new_t.withColumns({"depth": F.lit(level), "via": F.lit("type")})))
        front_i, front_t = new_i, new_i if new_t is None else new_i.union(new_t)
        if front_t.isEmpty():
            break
    if ignored is not None:
        seen = seen.where("via = 'seed'").union(seen.where("via <> 'seed'").join(ignored, "node", "left_anti"))
    return seen
