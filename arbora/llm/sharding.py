"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters the records uniformly over memory-sized buckets by a seeded hash of the whole record. Pass two
shuffles each bucket (``shuffle`` is Fisher-Yates; every bucket is sorted first and sits in the partition its number
names, so the result depends on the seed alone). Buckets in order then form one random permutation of all records;
shards are equal runs of it, so their row counts differ by one at most, and ``slot`` is the place in the shard.

A record that repeats in all columns more than ``HOT_COPIES`` times is counted first (partial counts before the
shuffle); its copies are numbered and hashed with their numbers, so they spread over all buckets.

Defined cases: null columns are hashed like any value; records that are equal in all columns are interchangeable;
empty and very long texts only count by their bytes; an empty table gives no rows. The output has the input's
columns, whatever their names, then ``shard`` and ``slot``, which replace columns of these names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.common import cut

#: Bytes of records in a bucket; a bucket is shuffled in memory.
BUCKET_BYTES = 8 << 20
#: Partitions that buckets are dealt over; with more buckets than that, a partition holds several, one at a time.
MOST_PARTITIONS = 100_000
#: Copies of one record that may share a bucket.
HOT_COPIES = 1_000


def scatter(records: DataFrame, buckets: int, seed: int, hot_copies: int = HOT_COPIES) -> DataFrame:
    """``bucket`` and ``record``, a struct of the hash that names its bucket (``place``) and the columns (``row``)."""
    columns = [F.col(f"`{c.replace('`', '``')}`") for c in records.columns]
    placed = records.select(F.xxhash64(F.lit(seed), *columns).alias("place"), F.struct(*columns).alias("row"))
    hot = cut(placed.groupBy("place").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > hot_copies).select("place"))
    if not hot.isEmpty():
        fields = placed.select("place", "row.*").toDF("place", *(f"c{i}" for i in range(len(columns))))
        counted = fields.join(hot, "place", "left_semi").groupBy(*fields.columns).agg(F.count(F.lit(1)).alias("copies"))
        numbered = counted.withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        row = F.struct(*(F.col(f"c{i}").alias(c) for i, c in enumerate(records.columns)))
        spread = numbered.select(F.xxhash64(F.lit(seed), "place", "number").alias("place"), row.alias("row"))
        placed = placed.join(hot, "place", "left_anti").unionByName(spread)
    return placed.select(F.pmod("place", F.lit(buckets)).cast("int").alias("bucket"), F.struct("place", "row").alias("record"))


def bucket_starts(scattered: DataFrame, buckets: int) -> DataFrame:
    """``of`` and ``start``, the records in buckets before it: sums inside groups of buckets, then over the groups."""
    width = max(1, math.isqrt(buckets))
    counts = cut(scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("grp", F.expr(f"bucket div {width}")))
    inside = Window.partitionBy("grp").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)  # one row per group, a root of the buckets
    sums = counts.groupBy(F.col("grp").alias("g")).agg(F.sum("n").alias("m"))
    sums = sums.select("g", F.coalesce(F.sum("m").over(across), F.lit(0)).alias("ahead"))
    local = counts.select("grp", "bucket", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("within"))
    return local.join(sums, F.col("grp") == F.col("g")).select(F.col("bucket").alias("of"), (F.col("ahead") + F.col("within")).alias("start"))


def shuffle_into_shards(records: DataFrame, shards: int, seed: int = 7, bucket_bytes: int = BUCKET_BYTES, text: str = "text") -> DataFrame:
    """The records in random order over ``shards`` shards."""
    records = records.drop(*(c for c in records.columns if c.lower() in ("shard", "slot")))
    row_bytes = F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(8 * len(records.columns))
    n, total = records.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes), F.lit(0))).first()
    buckets = max(1, math.ceil(total / bucket_bytes))
    scattered = scatter(records, buckets, seed)
    starts = cut(bucket_starts(scattered, buckets))
    filled = (
        scattered.repartition(min(buckets, MOST_PARTITIONS), "bucket")
        .groupBy("bucket")
        .agg(F.array_sort(F.collect_list("record")).alias("held"))
        .sortWithinPartitions("bucket")
        .select("bucket", F.shuffle("held", F.lit(seed)).alias("held"))
    )
    placed = filled.join(starts, F.col("bucket") == F.col("of")).select("start", F.posexplode("held").alias("i", "record"))
    shard = f"(((start + i) * {shards}L) div {max(n, 1)}L)"
    first = f"(({shard} * {n}L + {shards - 1}L) div {shards}L)"
    return placed.select("record.row.*", F.expr(f"int({shard})").alias("shard"), F.expr(f"start + i - {first}").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard. A shard is a run of buckets, so each task writes its buckets where they are, in the order of ``slot``."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
