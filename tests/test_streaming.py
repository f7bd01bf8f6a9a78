from __future__ import annotations

import datetime as dt

import pytest
from conftest import SF

from crossgrain.sources import proxy, scratch
from crossgrain.streaming.ingest import bars, upsert_by_date

ORDER = ["date", "start", "stock_code", "first", "last", "low", "high", "volume"]


def rows(df):
    return sorted(map(tuple, df.select(ORDER).collect()))


def run(spark, source, sink, marks, schema, mode, every="1 day", late="40 days", files=None):
    reader = spark.readStream.schema(schema)
    reader = reader if files is None else reader.option("maxFilesPerTrigger", files)
    q = bars(reader.parquet(source), every, late).writeStream.outputMode(mode).foreachBatch(lambda b, n: upsert_by_date(sink)(b, n))
    q.option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination(240)


def test_stream_equals_batch(spark):
    events = proxy.table(spark, SF, "events")
    source, sink, marks = (scratch.new_path(spark, n) for n in ("events", "bars", "marks"))
    events.repartition(3).write.parquet(source)
    run(spark, source, sink, marks, events.schema, "update")
    assert rows(spark.read.parquet(sink)) == rows(bars(events))


@pytest.mark.parametrize(("mode", "every"), [("update", "1 day"), ("update", "1 hour"), ("append", "1 hour")])
def test_sink_equals_batch_after_every_batch(spark, mode, every):
    """Several batches of one day, bars shorter than a day, rows that come late but in time."""
    at = lambda d, h, m=0: dt.datetime(2024, 3, d, h, m)
    batches = [
        [(at(1, 9), "a", 1.0), (at(1, 9, 30), "b", 2.0), (at(1, 10), "a", 3.0)],
        [(at(1, 11), "a", 4.0), (at(1, 9, 50), "b", 9.0)],  # the same day again; b's first hour gets a late row
        [(at(2, 0, 10), "c", 5.0), (at(1, 10, 59), "a", -1.0)],
        [(at(9, 12), "z", 0.0)],  # closes everything before
    ]
    schema = "ts timestamp, event_type string, value double"
    source, sink, marks = (scratch.new_path(spark, n) for n in ("events", "bars", "marks"))
    seen = []
    for batch in batches:
        seen += batch
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        run(spark, source, sink, marks, schema, mode, every, "3 days")
        if mode == "update":
            assert rows(spark.read.parquet(sink)) == rows(bars(spark.createDataFrame(seen, schema), every))
    if mode == "append":  # what is closed, once each
        assert rows(spark.read.parquet(sink)) == rows(bars(spark.createDataFrame(seen[:-1], schema), every))


def test_a_repeated_batch_changes_nothing(spark):
    sink = scratch.new_path(spark, "bars")
    schema = "ts timestamp, event_type string, value double"
    one = bars(spark.createDataFrame([(dt.datetime(2024, 1, 1, 3), k, 1.0) for k in "ab"], schema), "1 hour")
    two = bars(spark.createDataFrame([(dt.datetime(2024, 1, 1, 3), "a", 7.0), (dt.datetime(2024, 1, 1, 4), "a", 8.0)], schema), "1 hour")
    for number, batch in ((0, one), (1, two), (1, two), (2, one.limit(0))):
        upsert_by_date(sink)(batch, number)
    assert sorted((r.start.hour, r.stock_code, r.last, r.batch) for r in spark.read.parquet(sink).collect()) == [(3, "a", 7.0, 1), (3, "b", 1.0, 0), (4, "a", 8.0, 1)]
