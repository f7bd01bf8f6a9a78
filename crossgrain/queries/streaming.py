"""The streaming ingest's query, run on the events table as a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossgrain.queries.registry import query
from crossgrain.sources import proxy
from crossgrain.streaming.ingest import bars


@query("stream_daily_bars", "", """SELECT CAST(ts AS DATE) AS date, event_type AS stock_code, arg_min(value, (ts, value)) AS first, arg_max(value, (ts, value)) AS last, min(value) AS low, max(value) AS high, count(*) AS volume FROM events GROUP BY 1, 2""", "date stock_code ~first ~last ~low ~high volume")
def _(spark, sf_dir):
    return bars(proxy.table(spark, sf_dir, "events")).drop("start")


@query("stream_hourly_bars", "", """SELECT CAST(ts AS DATE) AS date, date_trunc('hour', ts) AS start, event_type AS stock_code, arg_min(value, (ts, value)) AS first, arg_max(value, (ts, value)) AS last, min(value) AS low, max(value) AS high, count(*) AS volume FROM events GROUP BY 1, 2, 3""", "date start stock_code ~first ~last ~low ~high volume")
def _(spark, sf_dir):
    return bars(proxy.table(spark, sf_dir, "events"), "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))
