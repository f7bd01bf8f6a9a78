"""Stored tables: written once, made again if their files change, read without an exchange."""

from __future__ import annotations

import os
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from crossgrain.sources import layout


def test_a_table_is_stored_once_and_follows_its_files(spark, tmp_path):
    source, built = str(tmp_path / "source"), []
    spark.range(100).select(F.concat(F.lit("S"), F.col("id") % 7).alias("stock_code"), F.col("id").alias("date")).write.parquet(source)

    def build():
        built.append(1)
        return spark.read.parquet(source)

    first = layout.stored(spark, "t", [source], build)
    assert first.count() == 100 and layout.stored(spark, "t", [source], build).count() == 100 and len(built) == 1
    plan = first.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("stock_code")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    both = first.groupBy("stock_code", "date").agg(F.count(F.lit(1)).alias("m"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in both
    time.sleep(1.1)
    spark.range(5).select(F.lit("S1").alias("stock_code"), F.col("id").alias("date")).write.mode("append").parquet(source)
    assert layout.stored(spark, "t", [source], build).count() == 105 and len(built) == 2
    names = list(layout._stored[spark.sparkContext.applicationId].values())
    layout.forget(spark)
    assert not any(spark.catalog.tableExists(n) for n in names) and os.path.exists(source)
    assert layout.stored(spark, "t", [source], build).count() == 105 and len(built) == 3


def test_the_panel_shuffles_shipments_once_and_fills_gaps(spark, tmp_path, monkeypatch):
    from conftest import SF

    from crossgrain.sources import proxy

    monkeypatch.setattr(layout, "BUCKET_BYTES", 1 << 14)
    n = layout.parts(spark, proxy.panel_files(SF))
    assert n > int(spark.conf.get("spark.sql.shuffle.partitions"))  # buckets grow with the files, whatever the session's setting
    built = proxy.built_panel(spark, SF).repartition(n, "stock_code")
    plan = [x for x in built._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert len([x for x in plan if "stock_code" in x]) == 2  # shipments and suppliers; the calendar's are by date
    rows = built.select("date", "stock_code", "has_price_record", "post_close").collect()
    cells = {(r.date, r.stock_code): r.close for r in proxy.prices(spark, SF).collect()}
    assert len(rows) == len({(r.date, r.stock_code) for r in rows}) == len({d for d, _ in cells}) * len({s for _, s in cells})
    assert {(r.date, r.stock_code): r.post_close for r in rows if r.has_price_record} == cells


def test_a_sample_has_as_many_parts_as_the_files_ask_for(spark, monkeypatch):
    from conftest import SF

    from crossgrain.operators import factor_stats as S
    from crossgrain.queries import factor_stats
    from crossgrain.sources import proxy

    layout.forget(spark)
    monkeypatch.setattr(layout, "BUCKET_BYTES", 1 << 14)
    n = layout.parts(spark, proxy.panel_files(SF))
    sample = factor_stats.long(spark, SF)
    lines = sample._jdf.queryExecution().executedPlan().toString().splitlines()
    assert sample.rdd.getNumPartitions() == n and sum("Exchange" in x for x in lines) == 1 and not any("Join" in x for x in lines)
    assert S.daily_ic(sample).count() == 4 * sample.select("date").distinct().count()
    layout.forget(spark)


def test_ranks_and_features_of_a_date_have_as_many_parts_as_the_files_ask_for(spark, monkeypatch):
    from conftest import SF

    from crossgrain.queries import QUERIES
    from crossgrain.sources import proxy

    layout.forget(spark)
    monkeypatch.setattr(layout, "BUCKET_BYTES", 1 << 14)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the sides were too large
    try:
        n = layout.parts(spark, proxy.panel_files(SF))
        for name in ("x10_assign_quantiles", "x11_score_deciles", "x13_relevance", "d3_true_deciles", "k9_feature_frame"):
            found = QUERIES[name](spark, SF)
            lines = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
            assert found.rdd.getNumPartitions() == n, name
            rows = [x for x in lines if f", {n}), REPARTITION_BY_NUM" in x]
            assert rows if name == "k9_feature_frame" else len(lines) == 1 == len(rows), name
            assert not any("date" in x and "industry" in x and f", {n})" in x for x in lines), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        layout.forget(spark)
