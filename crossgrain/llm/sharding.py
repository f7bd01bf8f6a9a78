"""Weighted rendezvous hashing of record keys over shards, in DataFrame functions only.

Each (key, shard) pair has a hash in (0, 1); the record goes to the shard with the least
-ln(hash) / weight. Adding a shard moves only the records that the new shard wins, and in
proportion to its weight.

Within a shard records are numbered without gaps from 0. Records are first grouped by everything
that the result shows, so that copies of one record, however many, are one row with a count before
they meet in a shuffle; (shard, bucket) totals give each bucket its first number; and a count is
laid out into its numbers again at the end, in steps, so that no array is longer than `RUN`.

Edge cases: a null text has no bytes (size 8) and the checksum of an empty text; a null key is a
key of its own; repeated rows take neighbouring slots; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossgrain.llm.common import pick

#: Buckets in which a shard's records are numbered, and the longest run of numbers made from one row.
BUCKETS, RUN = 512, 4096


def distance(keys: Sequence[Column], shard: int, weight: float) -> Column:
    """-ln(hash) / weight, where hash has 53 bits and is never 0 or 1."""
    bits = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(shard)), 11)
    return -F.log((bits.cast("double") + 0.5) * F.lit(2.0**-53)) / F.lit(float(weight))


def assign(keys: Sequence[Column], weights: Sequence[float]) -> tuple[Column, Column]:
    """The shard of a record and its distance to it; of equal distances the lower shard wins."""
    if not weights or min(weights) <= 0 or not all(map(math.isfinite, weights)):
        raise ValueError("each shard needs a positive weight")
    # Spark's xxhash64 skips nulls, so a null key is given a mark that no long has beside it.
    marked = [c for k in keys for c in (F.coalesce(k, F.lit(0).cast("long")), k.isNull())]
    best = F.array_min(F.array(*[F.struct(distance(marked, s, w).alias("d"), F.lit(s).alias("s")) for s, w in enumerate(weights)]))
    return best["s"], best["d"]


def shard_records(df: DataFrame, key: str, text: str, weights: Sequence[float], grown_weight: float = 1.0) -> DataFrame:
    """One row for each row of `df`: key, size, text_crc32, shard, slot and grown_shard (with one more shard)."""
    weights, keys = list(weights), [F.col(key).cast("long")]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = pick(df, key, text).select(key, (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    records = rows.groupBy(key, "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    shard, d = assign(keys, weights)
    more = [c for k in keys for c in (F.coalesce(k, F.lit(0).cast("long")), k.isNull())]
    placed = records.select("*", shard.alias("shard"), d.alias("_d")).select(
        key, "size", "text_crc32", "copies", "shard",
        F.when(distance(more, len(weights), grown_weight) < F.col("_d"), F.lit(len(weights))).otherwise(F.col("shard")).alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit(7), key, "size", "text_crc32"), F.lit(BUCKETS)).cast("int").alias("_bucket"),
    )
    # BUCKETS numbers a shard, however many records there are.
    totals = placed.groupBy("shard", "_bucket").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select("shard", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("shard", "_bucket").orderBy(F.col(key).asc_nulls_first(), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("_within", F.coalesce(F.sum("copies").over(within), F.lit(0))).join(F.broadcast(first), ["shard", "_bucket"])
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(RUN).cast("long")))
    runs = numbered.withColumn("_run", run)
    one = F.explode(F.sequence(F.col("_run"), F.least(F.col("_run") + (RUN - 1), F.col("copies") - 1)))
    return runs.withColumn("_copy", one).select(key, "size", "text_crc32", "shard", (F.col("_first") + F.col("_within") + F.col("_copy")).alias("slot"), "grown_shard")
