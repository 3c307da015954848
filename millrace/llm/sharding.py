"""Two-pass external shuffle: every record to a random shard and a random place in it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import without

#: What a record weighs beside its text.
RECORD_BYTES = 16


def record_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(RECORD_BYTES)).cast("long")


def external_shuffle(df: DataFrame, by: list[str], shards: int, size: Column, seed: int = 1, bucket_bytes: int = 32 << 20, bucket_rows: int = 50_000) -> DataFrame:
    """df with ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in each shard), in uniformly random order.

    by: the columns whose hash deals a record out; size: a record's bytes. Pass one scatters the records by a seeded
    hash into buckets that fit a task's memory: as many as keep the mean bucket under bucket_bytes and bucket_rows.
    Pass two shuffles each bucket by itself (Spark's shuffle() is a Fisher-Yates shuffle). Buckets follow one another;
    a record's place in that order, modulo the number of shards, is its shard, so row counts differ by one at most
    (the law `rows`), and its place in the shard is the quotient. Of the buckets only their counts meet in one place.
    The order depends on the seed, the records and the number of buckets alone: a lost task makes the same order again.

    Nulls are values like others; equal rows each keep a place; an empty table stays empty. Columns named shard or
    slot in df are replaced.
    """
    df = without(df, "shard", "slot")
    total = df.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    buckets = max(1, math.ceil((total.b or 0) / bucket_bytes), math.ceil(total.n / bucket_rows))
    dealt = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in by]).alias("h"))
    dealt = dealt.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)))
    # a fixed number of partitions and the sorts make the order, and so shuffle()'s draws, the same in every attempt
    pools = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "h", *[F.col("row").getField(c) for c in by])
    pools = pools.groupBy("bucket").agg(F.collect_list("row").alias("pool")).sortWithinPartitions("bucket")
    placed = pools.select("bucket", F.posexplode(F.shuffle("pool", seed)).alias("i", "x"))
    counts = dealt.groupBy("bucket").count()
    first = counts.select("bucket", (F.sum("count").over(_in_order()) - F.col("count")).alias("first"))
    place = F.col("first") + F.col("i")
    return placed.join(first, "bucket").select("x.*", F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"))


def _in_order():
    from pyspark.sql import Window

    return Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)


def write_shards(df: DataFrame, path: str, by: list[str], shards: int, size: Column, files_per_shard: int = 1, **how) -> None:
    """Shuffle df and write one folder for each shard; each file is a range of slots in order."""
    out = external_shuffle(df, by, shards, size, **how)
    part = F.pmod(F.col("slot"), F.lit(files_per_shard)) if files_per_shard > 1 else F.lit(0)
    out.repartition(shards * files_per_shard, "shard", part).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
