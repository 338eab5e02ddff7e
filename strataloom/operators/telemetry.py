"""Trace spans: filters, the cascade join to functions, and per-function metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Latencies of a function that percentiles look at: the last ones in order of arrival.
RECENT = 1000


def by_service(spans: DataFrame, service) -> DataFrame:
    return spans.where(F.col("service_name") == F.lit(service))


def in_time(spans: DataFrame, start_ns: Column | int, end_ns: Column | int) -> DataFrame:
    """Spans that start in the range, both ends included."""
    return spans.where(F.col("start_ns").between(F.lit(start_ns), F.lit(end_ns)))


def with_code(spans: DataFrame) -> DataFrame:
    return spans.where("function_name is not null or file_path is not null")


def from_base(spans: DataFrame, base: str) -> DataFrame:
    """Spans whose relative file paths start at the base."""
    at = F.col("file_path")
    return spans.withColumn("file_path", F.when(at.startswith("/"), at).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), at)))


def cascade(spans: DataFrame, functions: DataFrame) -> DataFrame:
    """Each span (span_id, file_path, function_name) with its function (path, name) and the rank of the strategy that found it.

    1 same file and name, 2 same name, 3 same name in lower case, 4 a function that ends with
    the span's name, 5 a span's name that ends with the function's. Lower ranks win, then the
    least (name, path). The suffix steps run on distinct names only, as equi joins: a name's
    suffixes are spelled out, so no pair of unlike names meets.
    """
    f = functions.select("path", "name").distinct()
    names = spans.select(F.col("function_name").alias("asked")).where("asked is not null and asked <> ''").distinct()
    least = F.min(F.struct("name", "path")).alias("f")
    exact = spans.join(f, (spans["file_path"] == f["path"]) & (spans["function_name"] == f["name"])).select("span_id", F.struct("name", "path").alias("f"), F.lit(1).alias("rank"))
    same = names.join(f, names["asked"] == f["name"]).groupBy("asked").agg(least).withColumn("rank", F.lit(2))
    rest = names.join(same, "asked", "left_anti")
    lower = rest.join(f, F.lower("asked") == F.lower("name")).groupBy("asked").agg(least).withColumn("rank", F.lit(3))
    rest = rest.join(lower, "asked", "left_anti")
    tails = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, i, F.length(c)))
    short = f.where("name <> ''").select("path", "name", F.explode(tails(F.col("name"))).alias("tail"))
    ends = rest.join(short, rest["asked"] == short["tail"]).groupBy("asked").agg(least).withColumn("rank", F.lit(4))
    rest = rest.join(ends, "asked", "left_anti").select("asked", F.explode(tails(F.col("asked"))).alias("tail"))
    ended = rest.join(f, F.col("tail") == F.col("name")).groupBy("asked").agg(least).withColumn("rank", F.lit(5))
    by_name = same.union(lower).union(ends).union(ended)
    named = spans.join(by_name, spans["function_name"] == by_name["asked"]).select("span_id", "f", "rank")
    best = exact.union(named).groupBy("span_id").agg(F.min(F.struct("rank", "f")).alias("b"))
    return spans.join(best, "span_id", "left").select(*[spans[c] for c in spans.columns], F.col("b.f.path").alias("path"), F.col("b.f.name").alias("name"), F.col("b.rank").cast("int").alias("rank"))


def metrics(spans: DataFrame, keys: list[str], value: str, arrival: list[str], error: Column | None = None, message: Column | None = None, recent: int | None = RECENT) -> DataFrame:
    """Per key: call_count, p50, p95, p99 (nearest rank, of the last `recent` values, or of all if None), error_count, error_rate, last_error."""
    if recent is None:
        ranks = _nearest_ranks(spans, keys, value)
    else:
        late = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in arrival])
        kept = spans.select(*keys, value, F.row_number().over(late).alias("_r")).where(F.col("_r") <= recent)
        ranks = kept.groupBy(*keys).agg(*[F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {value})").alias(f"p{p}") for p in (50, 95, 99)])
    error = F.lit(False) if error is None else error
    order = F.struct(*arrival)
    said = F.max_by(F.when(error, message if message is not None else F.lit(None).cast("string")), F.when(error, order))
    counts = spans.groupBy(*keys).agg(F.count("*").alias("call_count"), F.count_if(error).alias("error_count"), said.alias("last_error"))
    out = counts.join(ranks, keys, "left")
    return out.withColumn("error_rate", F.col("error_count") / F.col("call_count"))


def _nearest_ranks(spans: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, p50, p95, p99 over all values of a key: equal values are counted before anything is sorted, so a hot key costs its distinct values."""
    counted = spans.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    up = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.select(*keys, value, F.sum("_n").over(up).alias("_upto"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_all"))
    # The first value whose running share reaches p; shares in whole numbers, as ranks have no fractions.
    return placed.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") * 100 >= F.col("_all") * p, F.col(value))).alias(f"p{p}") for p in (50, 95, 99)])


def summary(correlated: DataFrame) -> DataFrame:
    """One row: spans, correlated spans, functions that they reach."""
    hit = F.col("name").isNotNull()
    return correlated.agg(F.count("*").alias("spans"), F.count_if(hit).alias("correlated"), F.countDistinct(F.when(hit, F.struct("path", "name"))).alias("functions"))


def _one_decimal(c: Column) -> Column:
    return F.format_string("%.1f", F.bround(c, 1))


def function_comment() -> Column:
    """A comment line of a metrics row."""
    ms = lambda c: F.concat(F.lit(f", {c}: "), _one_decimal(F.col(c)), F.lit(" ms"))
    return F.concat(F.lit("// calls: "), F.col("call_count").cast("string"), ms("p50"), ms("p95"), ms("p99"), F.lit(", errors: "), _one_decimal(F.col("error_rate") * 100), F.lit("%"))


def enrich_files(files: DataFrame, metrics_: DataFrame) -> DataFrame:
    """files (relative_path, content) with a header of comment lines, one for each measured function (path, name), above the content."""
    lines = metrics_.select(F.col("path").alias("relative_path"), F.struct("name", F.concat(F.lit("// "), F.col("name"), F.lit(" "), function_comment()).alias("line")).alias("l"))
    heads = lines.groupBy("relative_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("head"))
    out = files.join(heads, "relative_path", "left")
    return out.withColumn("content", F.when(F.col("head").isNull(), F.col("content")).otherwise(F.concat("head", F.lit("\n"), F.coalesce("content", F.lit(""))))).drop("head")
