"""The driver's tables in the shapes of the corpus model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import base_priority, file_type, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: source/lang/doc_<id>.<extension of the language>."""
    docs = table(spark, sf_dir, "documents")
    ext = F.when(F.col("lang") == "en", "rs").when(F.col("lang") == "fr", "py").when(F.col("lang") == "de", "ts").when(F.col("lang") == "es", "go").otherwise("md")
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), ext))
    out = docs.select(path.alias("path"), path.alias("relative_path"), F.octet_length("text").cast("bigint").alias("size"), F.col("text").alias("content"), "doc_id")
    out = out.withColumn("file_type", file_type(F.col("path")))
    return out.withColumn("priority", base_priority(F.col("file_type"), F.col("relative_path"))).withColumn("tokens", tokens(F.col("content")))


def url_path(pages: DataFrame) -> DataFrame:
    """pages with path: what follows the host of the url, without query and fragment."""
    return pages.withColumn("path", F.regexp_extract("url", r"://[^/]*/([^?#]*)", 1))


def hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, ord, target of every link of a page: the import facts of the tables."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("ord", "target"))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: the users of one event and the next, where they differ."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    nxt = e.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("dst"))
    return e.join(nxt, "event_id").select(F.col("user_id").alias("src"), "dst").where("src <> dst").distinct()


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as trace spans: the user is the service, the type the function, the value the duration."""
    e = table(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return e.select(
        F.col("event_id").alias("span_id"), F.col("event_type").alias("function_name"), F.col("user_id").cast("string").alias("service_name"),
        start.alias("start_ns"), F.col("value").alias("duration_ms"), "props", F.col("ts"), "user_id",
    )


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part keys as functions that their suppliers' files define and order keys call: path, name, is_exported."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("path"), F.col("l_partkey").cast("string").alias("name")).distinct().withColumn("is_exported", F.lit(True))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("path"), F.col("l_partkey").cast("string").alias("name"), F.lit(None).cast("string").alias("module"))
