"""Forward returns, tradeability, model tables and purged splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossgrain.functions.columns import KEYS, by_day, calendar_lag, change, finite, flag
from crossgrain.operators.calendar import exit_date, next_trading_date

#: How close to a limit counts as at it.
TOLERANCE = 1e-10


def forward_return(window: int) -> Column:
    return change(calendar_lag("post_close", -window), "post_close")


def forward_returns(panel: DataFrame, windows: Sequence[int]) -> DataFrame:
    """keys and return_{w}: close w calendar rows ahead over close now, less 1."""
    return panel.select(*KEYS, *[forward_return(w).alias(f"return_{w}") for w in windows])


def open_to_open(horizon: int) -> Column:
    """Open horizon + 1 rows ahead over the next open, less 1."""
    return finite(change(calendar_lag("post_open", -horizon - 1), calendar_lag("post_open", -1)))


def open_to_open_targets(panel: DataFrame, horizons: Sequence[int], keys: DataFrame | None = None) -> DataFrame:
    """keys and target_{h}d: open h + 1 rows ahead over the next open, less 1; for `keys`, if given."""
    out = panel.select(*KEYS, *[open_to_open(h).alias(f"target_{h}d") for h in horizons])
    return out if keys is None else keys.select(*KEYS).join(out, KEYS, "left")


STATE = ["is_st", "is_suspended", "listing_days", "raw_open", "limit_up", "limit_down"]


def execution_state(panel: DataFrame, calendar: DataFrame, prefix: str = "entry_") -> DataFrame:
    """keys and the next date's status, open and limits; the last date has none."""
    following = panel.select(F.col("date").alias("next_date"), "stock_code", *[F.col(c).alias(prefix + c) for c in STATE], F.lit(True).alias("_found"))
    days = next_trading_date(calendar)
    out = panel.select(*KEYS).join(by_day(days), "date").join(following, ["next_date", "stock_code"], "left")
    return out.withColumn("entry_data_available", flag("_found", False)).drop("_found").withColumnRenamed("next_date", "entry_date").select(*KEYS, "entry_date", "entry_data_available", *[prefix + c for c in STATE])


def at_limit_up(price: Column, limit: Column) -> Column:
    return F.coalesce(price >= limit - TOLERANCE, F.lit(False))


def at_limit_down(price: Column, limit: Column) -> Column:
    return F.coalesce(price <= limit + TOLERANCE, F.lit(False))


def eligible_sample(panel: DataFrame, calendar: DataFrame, min_listing_days: int) -> DataFrame:
    """panel rows with their next date's state and `eligible`: in the universe now and tradeable at the next open.

    A null status counts as excluded.
    """
    joined = panel.select(*KEYS, "in_universe", "industry", "market_cap").join(execution_state(panel, calendar), KEYS, "left")
    ok = (
        flag("in_universe", False) & ~flag("entry_is_st", True) & ~flag("entry_is_suspended", True) & flag(F.col("entry_listing_days") >= min_listing_days, False)
        & F.col("entry_raw_open").isNotNull() & ~at_limit_up(F.col("entry_raw_open"), F.col("entry_limit_up")) & ~at_limit_down(F.col("entry_raw_open"), F.col("entry_limit_down"))
    )
    return joined.withColumn("eligible", ok)


def tradeability(rows: DataFrame, min_listing_days: int) -> DataFrame:
    """rows (with entry_ columns) with entry_open_limit_up, entry_open_limit_down and entry_tradeable."""
    o, up, down = (F.col(f"entry_{c}") for c in ("raw_open", "limit_up", "limit_down"))
    hit_up, hit_down = at_limit_up(o, up), at_limit_down(o, down)
    ok = (
        flag("entry_data_available", False) & ~flag("entry_is_st", True) & ~flag("entry_is_suspended", True) & flag(F.col("entry_listing_days") >= min_listing_days, False)
        & flag(o > 0, False) & flag(up > 0, False) & flag(down > 0, False) & flag(up > down, False) & ~hit_up & ~hit_down
    )
    return rows.withColumn("entry_open_limit_up", hit_up).withColumn("entry_open_limit_down", hit_down).withColumn("entry_tradeable", ok)


def factor_wide(keys: DataFrame, factors: DataFrame, names: Sequence[str]) -> DataFrame:
    """One column a factor on the rows of `keys`: a union of long factors, pivoted in one shuffle."""
    wide = factors.groupBy(*KEYS).pivot("factor", list(names)).agg(F.first(finite("factor_value")))
    return keys.select(*KEYS).join(wide, KEYS, "left")


def factor_coverage(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """factor, rows, present, coverage."""
    n = F.count(F.lit(1))
    cols = [F.struct(F.lit(x).alias("factor"), n.alias("rows"), F.count(x).alias("present"), (F.count(x) / n).alias("coverage")) for x in names]
    return wide.agg(F.array(*cols).alias("a")).select(F.inline("a"))


def model_dataset(wide: DataFrame, targets: DataFrame, panel: DataFrame, calendar: DataFrame, min_listing_days: int) -> DataFrame:
    """Features, targets, metadata, entry state and tradeability, in this order of columns."""
    meta = panel.select(*KEYS, "industry", "market_cap")
    out = wide.join(targets, KEYS, "left").join(meta, KEYS, "left").join(execution_state(panel, calendar), KEYS, "left")
    return tradeability(out, min_listing_days)


def panel_dataset(panel: DataFrame, calendar: DataFrame, factors: Mapping[str, Column], horizons: Sequence[int], min_listing_days: int, rows: Column) -> DataFrame:
    """`model_dataset` of one panel (with pos) and factors that are expressions over it, for the rows that `rows` holds for.

    Features, targets and the next date's state are windows over a stock's calendar, so all come from one
    scan and one sort of the panel, with no join but the calendar's.
    """
    entry = calendar_lag("post_open", -1)
    x = panel.select(
        *KEYS, "industry", "market_cap", rows.alias("_kept"), *[finite(c).alias(n) for n, c in factors.items()],
        *[finite(change(calendar_lag("post_open", -h - 1), entry)).alias(f"target_{h}d") for h in horizons],
        F.coalesce(calendar_lag(F.lit(True), -1), F.lit(False)).alias("entry_data_available"), *[calendar_lag(c, -1).alias(f"entry_{c}") for c in STATE],
    ).where("_kept")
    x = x.join(by_day(next_trading_date(calendar).withColumnRenamed("next_date", "entry_date")), "date", "left")
    x = x.select(*KEYS, *factors, *[f"target_{h}d" for h in horizons], "industry", "market_cap", "entry_date", "entry_data_available", *[f"entry_{c}" for c in STATE])
    return tradeability(x, min_listing_days)


def base_period(date: Column | str, periods: Mapping[str, tuple[str, str]]) -> Column:
    """The name of the period (first and last day) that holds the date, else null; periods may not overlap."""
    spans = sorted(periods.values())
    if any(a[1] >= b[0] for a, b in zip(spans, spans[1:], strict=False)):
        raise ValueError("periods overlap")
    date = F.col(date) if isinstance(date, str) else date
    out = F.lit(None).cast("string")
    for name, (first, last) in periods.items():
        out = F.when(date.between(F.to_date(F.lit(first)), F.to_date(F.lit(last))), name).otherwise(out)
    return out


def period_end(period: Column, periods: Mapping[str, tuple[str, str]]) -> Column:
    out = F.lit(None).cast("date")
    for name, (_, last) in periods.items():
        out = F.when(period == name, F.to_date(F.lit(last))).otherwise(out)
    return out


def sample_index(rows: DataFrame, calendar: DataFrame, periods: Mapping[str, tuple[str, str]], horizons: Sequence[int], final: tuple[str, str]) -> DataFrame:
    """keys, base_period and, for each horizon, exit_date_h, split_h (purged) and final_train_h.

    A row keeps its period as split if it has a label and its exit lies in the period; it is in the
    final training set if date and exit lie in `final` and it has a label.
    """
    out = rows.select(*KEYS, *[f"target_{h}d" for h in horizons]).withColumn("base_period", base_period("date", periods))
    for h in horizons:
        out = out.join(by_day(exit_date(calendar, h).withColumnRenamed("exit_date", f"exit_date_{h}")), "date", "left")
        exits, label = F.col(f"exit_date_{h}"), F.col(f"target_{h}d").isNotNull()
        split = F.when(label & (exits <= period_end(F.col("base_period"), periods)), F.col("base_period"))
        first, last = (F.to_date(F.lit(x)) for x in final)
        out = out.withColumn(f"split_{h}", split).withColumn(f"final_train_{h}", F.coalesce(label & (F.col("date") >= first) & (F.col("date") <= last) & (exits <= last), F.lit(False)))
    return out.select(*KEYS, "base_period", *[f"{n}_{h}" for h in horizons for n in ("exit_date", "split", "final_train")], *[f"target_{h}d" for h in horizons])


def split_summary(index: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """horizon, base_period, rows, kept, purged, missing_label, first_date, last_date."""
    per = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"split_{h}").alias("split"), F.col(f"target_{h}d").alias("target")) for h in horizons])
    long = index.select("date", "base_period", F.inline(per)).where("base_period is not null")
    kept = F.col("split").isNotNull()
    return long.groupBy("horizon", "base_period").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(kept).alias("kept"), F.count_if(~kept & F.col("target").isNotNull()).alias("purged"), F.count_if(F.col("target").isNull()).alias("missing_label"),
        F.min(F.when(kept, F.col("date"))).alias("first_date"), F.max(F.when(kept, F.col("date"))).alias("last_date"),
    )


def development_split(index: DataFrame, horizon: int, train: str = "train", validation: str = "validation") -> DataFrame:
    """keys and split of the rows to develop on; only labelled rows have a split."""
    split = F.col(f"split_{horizon}")
    return index.where(split.isin(train, validation)).select(*KEYS, split.alias("split"), F.col(f"target_{horizon}d").alias("target"))


def final_refit_rows(index: DataFrame, horizon: int, boundary: tuple[str, str], end: str) -> DataFrame:
    """Train and validation rows, and those purged only at the boundary between them whose exit is in time.

    boundary: last day of training, first day of validation.
    """
    exits, split = F.col(f"exit_date_{horizon}"), F.col(f"split_{horizon}")
    last, first = (F.to_date(F.lit(x)) for x in boundary)
    crossing = split.isNull() & (F.col("date") <= last) & (exits >= first) & (exits <= F.to_date(F.lit(end))) & F.col(f"target_{horizon}d").isNotNull() & F.col("base_period").isNotNull()
    rows = index.where(split.isin("train", "validation") | F.coalesce(crossing, F.lit(False)))
    return rows.select(*KEYS, F.coalesce(split, F.lit("boundary")).alias("split"), F.col(f"target_{horizon}d").alias("target"))


def mask_incomplete_labels(index: DataFrame, horizon: int, split: str, end: str) -> DataFrame:
    """keys and target, null unless the row is of that split and its exit is in time."""
    ok = (F.col(f"split_{horizon}") == split) & (F.col(f"exit_date_{horizon}") <= F.to_date(F.lit(end)))
    return index.select(*KEYS, F.when(ok, F.col(f"target_{horizon}d")).alias("target"))
