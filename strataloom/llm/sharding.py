"""Two-pass external shuffle into shards, by DataFrame functions only.

Pass one scatters the records uniformly over memory-sized buckets: the shard comes from
rendezvous hashing of the key alone (so one more shard takes rows only into itself) and a
second seeded hash over key, size and checksum splits each shard into as many buckets as
its bytes and rows need; many equal records are dealt out in turn. The buckets are written to
the shared folder. Pass two brings each bucket into a task of its own number, sorts it into a
fixed order, applies Spark's `shuffle` (a Fisher-Yates over the array of the bucket, seeded by
the seed and that number) and numbers the slots; bucket offsets are running sums of bucket
counts. So slots depend on the records, the number of shards and the seed, not on partitions.

Nulls: a null key counts as one key; a null text has no bytes. Equal keys always share a
shard (the law `key`), yet their rows spread over that shard's buckets. Repeated rows each get
a slot of their own. An empty table gives no rows. A single record has to fit into a task.
Columns beside the key travel along as they are, except that names starting with
`_shuffle_`, shard, grown_shard and slot are reserved here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, save_stage, stage_path

#: A bucket holds about this many bytes and rows at most, so that one task can hold it.
BUCKET_BYTES, BUCKET_ROWS = 64 << 20, 20_000
#: Parts that a crowd of equal records is numbered in.
CROWD_PARTS = 1024


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The shard in 0 to shards - 1 whose seeded hash with the key is highest (ties to the higher number)."""
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(key, s, F.lit(seed)).alias("h"), s.alias("s"))))
    return best.getField("s").cast("int")


def _turn(df: DataFrame, same: list[Column], size: Column, split: int) -> DataFrame:
    """df with _shuffle_turn: 0, but a running number within groups of equal records that would crowd a bucket."""
    names = [f"_shuffle_k{i}" for i in range(len(same))]
    keyed = df.withColumns(dict(zip(names, same, strict=True)))
    crowds = keyed.groupBy(*names).agg(F.count("*").alias("_shuffle_n"), F.sum(size).alias("_shuffle_b"))
    crowds = crowds.where((F.col("_shuffle_n") > BUCKET_ROWS // 4) | (F.col("_shuffle_b") > BUCKET_BYTES // 4)).select(*[F.col(n).alias(f"{n}h") for n in names])
    if split == 1 or crowds.isEmpty():
        return df.withColumn("_shuffle_turn", F.lit(0).cast("long"))
    crowds = checked(crowds.withColumn("_shuffle_hot", F.lit(True)))
    on = [F.col(n).eqNullSafe(F.col(f"{n}h")) for n in names]
    flagged = keyed.join(crowds, on, "left").drop(*[f"{n}h" for n in names])
    # Written once, so that the parts of a crowd are fixed while their sizes and their numbers are taken.
    flagged = save_stage(flagged.withColumn("_shuffle_part", F.pmod(F.monotonically_increasing_id(), F.lit(CROWD_PARTS))), "crowds")
    hot = flagged.where("_shuffle_hot")
    sizes = hot.groupBy(*names, "_shuffle_part").agg(F.count("*").alias("_shuffle_n"))
    sizes = sizes.withColumn("_shuffle_base", F.coalesce(F.sum("_shuffle_n").over(Window.partitionBy(*names).orderBy("_shuffle_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sizes = sizes.select(*[F.col(n).alias(f"{n}h") for n in names], F.col("_shuffle_part").alias("_shuffle_ph"), "_shuffle_base")
    nth = F.row_number().over(Window.partitionBy(*names, "_shuffle_part").orderBy(F.lit(0))) - 1
    numbered = hot.withColumn("_shuffle_nth", nth).join(sizes, [*on, F.col("_shuffle_part") == F.col("_shuffle_ph")])
    numbered = numbered.withColumn("_shuffle_turn", F.col("_shuffle_base") + F.col("_shuffle_nth")).select(*df.columns, "_shuffle_turn")
    return flagged.where("_shuffle_hot is null").withColumn("_shuffle_turn", F.lit(0).cast("long")).select(*df.columns, "_shuffle_turn").unionByName(numbered)


def scatter(df: DataFrame, key: str, size: Column, spread: Column, shards: int, seed: int) -> tuple[DataFrame, int]:
    """Pass one: df with _shuffle_shard, _shuffle_grown and _shuffle_bucket, written to the shared folder; and the buckets of a shard.

    `size` gives a record's bytes, `spread` any further value that tells rows of one key apart.
    """
    total = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    split = max(1, -(-int(total["b"]) // (shards * BUCKET_BYTES)), -(-int(total["n"]) // (shards * BUCKET_ROWS)))
    out = _turn(df, [F.col(key), size, spread], size, split)
    rest = F.pmod(F.pmod(F.xxhash64(F.col(key), size, spread, F.lit(seed + 1)), F.lit(split)) + F.col("_shuffle_turn"), F.lit(split)).cast("int")
    out = out.withColumn("_shuffle_shard", rendezvous(F.col(key), shards, seed))
    last = F.xxhash64(F.col(key), F.lit(shards), F.lit(seed))
    held = F.xxhash64(F.col(key), F.col("_shuffle_shard"), F.lit(seed))
    out = out.withColumn("_shuffle_grown", F.when(last >= held, F.lit(shards)).otherwise(F.col("_shuffle_shard")))
    return save_stage(out.withColumn("_shuffle_bucket", F.col("_shuffle_shard") * F.lit(split) + rest).drop("_shuffle_turn"), "scatter"), split


def two_pass_shuffle(df: DataFrame, key: str, size: Column, spread: Column, shards: int = 24, seed: int = 20, order: list[str] | None = None) -> DataFrame:
    """df's rows with shard int, grown_shard int and slot long (gapless from 0 in each shard, in shuffled order).

    `order` names the columns that fix a bucket's order before it is shuffled (all of df's by default; maps can't be ordered).
    """
    cols = df.columns
    rows, split = scatter(df, key, size, spread, shards, seed)
    counts = rows.groupBy("_shuffle_shard", "_shuffle_bucket").agg(F.count("*").alias("_shuffle_n"))
    before = Window.partitionBy("_shuffle_shard").orderBy("_shuffle_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_shuffle_bucket", F.coalesce(F.sum("_shuffle_n").over(before), F.lit(0)).alias("_shuffle_at"))
    record = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order or [])], F.struct(*[F.col(c).alias(c) for c in cols]).alias("r"), F.col("_shuffle_shard").alias("s"), F.col("_shuffle_grown").alias("g"))
    # Partition number = bucket number, which seeds `shuffle` beside the seed itself.
    buckets = rows.repartitionById(shards * split, F.col("_shuffle_bucket")).groupBy("_shuffle_bucket").agg(F.sort_array(F.collect_list(record)).alias("rows"))
    mixed = buckets.select("_shuffle_bucket", F.shuffle("rows", F.lit(seed)).alias("rows"))
    dealt = mixed.join(checked(counts), "_shuffle_bucket").select("_shuffle_at", F.posexplode("rows").alias("_shuffle_pos", "_shuffle_row"))
    return dealt.select("_shuffle_row.r.*", F.col("_shuffle_row.s").alias("shard"), F.col("_shuffle_row.g").alias("grown_shard"), (F.col("_shuffle_at") + F.col("_shuffle_pos")).cast("long").alias("slot"))


def write_shards(shuffled: DataFrame, path: str, shards: int = 24) -> None:
    """Write two_pass_shuffle's rows: each shard as a folder shard=N of Parquet files whose rows stand in slot order; large shards get a file for each range of slots.

    Pass two deals ranges of buckets to its tasks, so the rows need no further shuffle, whatever the number of shards.
    """
    shuffled.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 20) -> DataFrame:
    """The digest of a two-pass shuffle of whole documents, taken from the shards as they were written."""
    size, crc = F.coalesce(F.octet_length("text"), F.lit(0)), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    out = two_pass_shuffle(docs, "doc_id", size, crc, shards, seed)
    path = stage_path(docs.sparkSession, "shards")
    write_shards(out, path, shards)
    held = docs.sparkSession.read.schema(out.schema).parquet(path)
    return held.select("doc_id", (size + 8).cast("long").alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")
