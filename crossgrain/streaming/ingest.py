"""Event-time bars from a stream, and an idempotent upsert of bars by window and key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bars(events: DataFrame, every: str = "1 day", late: str = "1 day", key: str = "event_type") -> DataFrame:
    """date, start, stock_code, first, last, low, high, volume of each window of `events` (ts, value, key).

    Windows close `late` after their end; what comes later is dropped. Works on a batch as well.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    g = timed.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), F.col(key).alias("stock_code"))
    at = F.struct("ts", "value")
    x = g.agg(F.min(at).alias("_a"), F.max(at).alias("_z"), F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("volume"))
    return x.select(F.to_date("w.start").alias("date"), F.col("w.start").alias("start"), "stock_code", F.col("_a.value").alias("first"), F.col("_z.value").alias("last"), "low", "high", "volume")


def upsert_by_date(path: str, keys: Sequence[str] = ("start", "stock_code")) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink partitioned by date: a batch's rows replace the stored ones of the same keys, all others stay.

    Only the partitions of the batch's dates are read and rewritten, all at once as the job commits. Column
    `batch` tells which batch wrote a row; of rows with equal keys the latest batch's stays, so a repeated
    batch changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("batch", F.lit(number).cast("long"))
        if new.isEmpty():
            return
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            dates = [r.date for r in new.select("date").distinct().collect()]  # a batch's dates
            stored = spark.read.schema(new.schema).parquet(path).where(F.col("date").isin(dates))
            order = Window.partitionBy("date", *keys).orderBy(F.desc("batch"))
            new = stored.unionByName(new).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
        new.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)

    return write
