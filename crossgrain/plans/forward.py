"""The forward run: features to scores to staggered ledgers up to an as-of date, published step by step.

A run is published by periods. A period is what one signal date decides for its path of each model: the
days from its execution to the day before the path's next execution. Tables of a run:

- `nav`, `trades`, `scores`, `snapshot`, partitioned by signal_date; a partition is written once and
  never changes. `snapshot` is what a path holds, and its cash, after the period's last day.
- `closing`, partitioned by path: the day after a path's last period, as if no signal followed. It is
  overwritten when one does.

A later run reads scores and market of its own new dates only and goes on from the snapshots. Writes
overwrite the partitions they touch and `nav` is written last, so a run that was cut off is repeated
without harm, and one with nothing new writes nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossgrain.functions.columns import by_day
from crossgrain.operators import ledger as P
from crossgrain.sources.scratch import Temporary, materialize

#: rows of the dates from the first to the last, both included.
Dated = Callable[[dt.date, dt.date], DataFrame]

NAV = "path string, date date, pos long, rebalance boolean, pre_nav double, nav double, cash double, sold double, bought double, sell_cost double, buy_cost double, n_sells long, n_buys long, scale double, notional double, n_held long, cash_blocked boolean"
TRADES = "path string, date date, stock_code string, side string, status string, reason string, gross_notional double, cost double, units double"
SNAPSHOT = "path string, stock_code string, entry_date date, entry_price double, notional double, mark double, cash double"
SCORES = "model string, stock_code string, score double"
SCHEMAS = {"nav": NAV, "trades": TRADES, "snapshot": SNAPSHOT, "scores": SCORES, "closing": NAV.removeprefix("path string, ")}
BY = {"closing": "path string"}


def staggered(scores: DataFrame, panel: DataFrame, calendar: DataFrame, terms: P.Terms, as_of: str | None = None) -> P.Ledger:
    """All (model, offset) paths of the scores; signals whose horizon isn't over by `as_of` are left out.

    scores: (model, date, stock_code, score).
    """
    if as_of is not None:
        calendar = calendar.where(F.col("date") <= F.to_date(F.lit(as_of)))
    desired = P.desired_set(scores, calendar, terms.k)
    active = P.active_desired(P.offset_schedule(calendar, terms.step), calendar)
    return P.simulate(P.paths(active, scores.select("model").distinct()), desired, panel, terms)


def daily(scores: DataFrame, panel: DataFrame, calendar: DataFrame, terms: P.Terms) -> P.Ledger:
    """The daily strategy of each model."""
    desired = P.desired_set(scores, calendar, terms.k)
    return P.simulate(P.daily_paths(desired, calendar), desired, panel, terms)


class ForwardRun:
    """A published run in a folder of its own."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """A published table, empty before the first run."""
        schema = f"{SCHEMAS[name]}, {BY.get(name, 'signal_date date')}"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def _write(self, df: DataFrame, name: str) -> None:
        by = BY.get(name, "signal_date date").split()[0]
        df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{self.folder}/{name}")

    def last_signal(self) -> dt.date | None:
        return self.table("nav").agg(F.max("signal_date")).first()[0]  # from the names of partitions

    def nav(self) -> DataFrame:
        """Every path's days so far: its periods, and the closing day after the last of them."""
        nav = self.table("nav")
        last = nav.groupBy("path").agg(F.max("pos").alias("_last"))
        closing = self.table("closing").join(last, "path").where(F.col("pos") == F.col("_last") + 1)
        return nav.select(*P.NAV_COLUMNS).unionByName(closing.select(*P.NAV_COLUMNS))

    def advance(self, scores: Dated, market: Dated, calendar: DataFrame, terms: P.Terms, as_of: dt.date) -> list[dt.date]:
        """Publishes all signals that are complete by `as_of` and new; returns their dates, in order.

        scores(first, last): (model, date, stock_code, score) of signal dates; market(first, last): the
        panel's rows; calendar: (date, pos), which later runs may only lengthen.
        """
        calendar = calendar.where(F.col("date") <= F.lit(as_of))
        before = self.last_signal()
        schedule = P.offset_schedule(calendar, terms.step)
        schedule = schedule if before is None else schedule.where(F.col("signal_date") > F.lit(before))
        new = [r.signal_date for r in schedule.select("signal_date").orderBy("signal_date").collect()]  # a row a date
        if not new:
            return []
        with Temporary(self.spark):
            self._publish(materialize(scores(new[0], new[-1]).select("model", "date", "stock_code", "score"), "scores"), market, calendar, schedule, terms, before)
        return new

    def _publish(self, scored: DataFrame, market: Dated, calendar: DataFrame, schedule: DataFrame, terms: P.Terms, before: dt.date | None) -> None:
        first, last = schedule.agg(F.min("execution_date"), F.max("horizon_date")).first()
        desired = P.desired_set(scored.join(by_day(schedule.select(F.col("signal_date").alias("date"))), "date", "left_semi"), calendar, terms.k)
        path_days = P.paths(P.active_desired(schedule, calendar), scored.select("model").distinct())
        opening = None if before is None else self._opening(path_days, calendar, before)
        ledger = P.simulate(path_days, desired, market(first, last), terms, opening)
        ends = Window.partitionBy("path")
        days = ledger.path_days.select("path", "pos", "signal_date", (F.col("pos") == F.max("pos").over(ends)).alias("closing"))
        days = days.withColumn("ends", ~F.col("closing") & (F.max(F.when(~F.col("closing"), F.col("pos"))).over(Window.partitionBy("path", "signal_date")) == F.col("pos")))
        nav = ledger.nav.select(*P.NAV_COLUMNS).join(days, ["path", "pos"])
        own = nav.where("not closing")
        self._write(scored.withColumnRenamed("date", "signal_date").join(by_day(schedule.select("signal_date"), "signal_date"), "signal_date", "left_semi"), "scores")
        dated = own.select("path", "date", "signal_date")
        self._write(P.trade_ledger(ledger, terms).join(dated, ["path", "date"]), "trades")
        kept = P.priced(ledger).where("held").join(days.where("ends").select("path", "pos", "signal_date"), ["path", "pos"])
        held = kept.select("path", "stock_code", "entry_date", "entry_price", "notional", "mark", F.lit(None).cast("double").alias("cash"), "signal_date")
        none = [F.lit(None).cast(t).alias(c) for c, t in (("entry_date", "date"), ("entry_price", "double"), ("notional", "double"), ("mark", "double"))]
        self._write(held.unionByName(own.where("ends").select("path", F.lit("CASH").alias("stock_code"), *none, "cash", "signal_date")), "snapshot")
        self._write(nav.where("closing").select(*P.NAV_COLUMNS), "closing")
        self._write(own.select(*P.NAV_COLUMNS, "signal_date"), "nav")

    def _opening(self, path_days: DataFrame, calendar: DataFrame, before: dt.date) -> P.Opening:
        """What the paths that go on hold: each one's last snapshot up to `before`."""
        first = path_days.groupBy("path").agg(F.min("pos").alias("_first"))
        snapshot = self.table("snapshot").where(F.col("signal_date") <= F.lit(before)).join(first, "path")
        rows = materialize(snapshot.withColumn("_latest", F.max("signal_date").over(Window.partitionBy("path"))).where("signal_date = _latest"), "opening")
        held = rows.where("stock_code <> 'CASH'").join(by_day(calendar.select(F.col("date").alias("entry_date"), F.col("pos").alias("entry_pos")), "entry_date"), "entry_date")
        holdings = held.select("path", "stock_code", "entry_date", "entry_pos", "entry_price", "notional", "mark", (F.col("_first") - 1).alias("mark_pos"))
        return P.Opening(rows.where("stock_code = 'CASH'").select("path", "cash"), holdings)
