"""Calendar, universe and panel assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossgrain.functions.columns import FIRST_DATE, KEYS, by_day, flag, one_row


def calendar_index(rows: DataFrame, date: str = "date") -> DataFrame:
    """date, pos: the distinct dates, numbered from 0. One row a date, so the single sort stays small."""
    return rows.select(F.to_date(date).alias("date")).where("date is not null").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")).cast("long") - 1)


def shifted(calendar: DataFrame, by: int, name: str) -> DataFrame:
    """date and `name`: the date `by` positions on, null past the end."""
    return calendar.select("date", F.lead("date", by).over(Window.orderBy("pos")).alias(name))


def next_trading_date(calendar: DataFrame) -> DataFrame:
    return shifted(calendar, 1, "next_date")


def exit_date(calendar: DataFrame, horizon: int) -> DataFrame:
    """date, exit_date: entry is the next date, exit `horizon` dates after it."""
    return shifted(calendar, horizon + 1, "exit_date")


def lookback_start(calendar: DataFrame, start: Column | str, n: int) -> DataFrame:
    """One row, lookback_start: the date n trading days before the first one at or after `start`."""
    start = F.to_date(F.lit(start)) if isinstance(start, str) else start
    at = calendar.where(F.col("date") >= start).agg(F.min("pos").alias("at"))
    return calendar.join(F.broadcast(at), F.col("pos") == F.col("at") - n).select(F.col("date").alias("lookback_start"))


def resolve_as_of(calendar: DataFrame, requested: str | None = None) -> DataFrame:
    """One row, as_of: the latest date, at or before `requested` if given."""
    known = calendar if requested is None else calendar.where(F.col("date") <= F.to_date(F.lit(requested)))
    return known.agg(F.max("date").alias("as_of"))


def last_complete_signal(calendar: DataFrame, horizon: int, requested: str | None = None) -> DataFrame:
    """One row, signal_date: the last date whose entry and exit lie at or before the as-of date."""
    as_of = resolve_as_of(calendar, requested).join(calendar, F.col("as_of") == F.col("date")).select("as_of", F.col("pos").alias("at"))
    return calendar.join(F.broadcast(as_of), F.col("pos") == F.col("at") - horizon - 1).select("as_of", F.col("date").alias("signal_date"))


def universe_asof(calendar: DataFrame, snapshots: DataFrame) -> DataFrame:
    """date, stock_code: members of the latest snapshot at or before each date.

    snapshots: (snapshot_date, stock_code). Dates before the first snapshot have no members;
    `dates_without_snapshot` lists them.
    """
    days = calendar.select("date", F.lit(None).cast("date").alias("snap"), F.lit(1).alias("_on"))
    marks = snapshots.select(F.col("snapshot_date").alias("date"), F.col("snapshot_date").alias("snap"), F.lit(0).alias("_on")).distinct()
    latest = F.last("snap", ignorenulls=True).over(Window.orderBy("date", "_on").rowsBetween(Window.unboundedPreceding, 0))
    of_day = days.unionByName(marks).withColumn("snapshot_date", latest).where("_on = 1 and snapshot_date is not null").select("date", "snapshot_date")
    return snapshots.distinct().join(by_day(of_day), "snapshot_date").select("date", "stock_code")


def dates_without_snapshot(calendar: DataFrame, snapshots: DataFrame) -> DataFrame:
    first = snapshots.agg(F.min("snapshot_date").alias("first"))
    return calendar.join(F.broadcast(first), (F.col("date") < F.col("first")) | F.col("first").isNull()).select("date")


def price_join(raw: DataFrame, adjusted: DataFrame) -> DataFrame:
    """Unadjusted prices with the adjusted ones beside them; keys must be unique on both sides, or the query fails."""
    return one_row(raw, KEYS).join(one_row(adjusted, KEYS), KEYS, "left")


def listing_days(rows: DataFrame, calendar: DataFrame, listed: str = "listed_date") -> DataFrame:
    """`rows` with listing_days: calendar dates from the listing date to the row's, both counted.

    Unknown listing date: null; not listed yet: 0.
    """
    # Listing dates before the calendar count as its first date, those after it as the day after its last: as many
    # calendar dates lie before them, and however many stocks there are, the distinct ones lie in the calendar's range.
    ends = calendar.agg(F.min("date").alias("_first"), F.date_add(F.max("date"), 1).alias("_end"))
    none = F.to_date(F.lit(FIRST_DATE))
    clipped = F.greatest(F.least(F.col(listed), F.coalesce("_end", none)), F.coalesce("_first", none))
    rows = rows.crossJoin(F.broadcast(ends)).withColumn("_l", F.when(F.col(listed).isNotNull(), clipped)).drop("_first", "_end")
    dates = rows.select("_l").where("_l is not null").distinct()
    both = dates.select(F.col("_l").alias("d"), F.lit(None).cast("long").alias("pos")).unionByName(calendar.select(F.col("date").alias("d"), "pos"))
    # Calendar dates before each listing date: one row a date on either side.
    before = F.count("pos").over(Window.orderBy("d").rangeBetween(Window.unboundedPreceding, -1))
    ranked = both.withColumn("d", F.unix_date("d")).withColumn("_n", before).where("pos is null").select(F.date_from_unix_date(F.col("d").cast("int")).alias("_l"), "_n")
    placed = rows.join(by_day(calendar.select("date", F.col("pos").alias("_p"))), "date", "left").join(by_day(ranked, "_l"), "_l", "left").drop("_l")
    return placed.withColumn("listing_days", F.greatest(F.lit(0), F.col("_p") - F.col("_n") + 1)).withColumn("listing_days", F.when(F.col("_n").isNotNull(), F.col("listing_days"))).drop("_p", "_n")


def status_merge(st: DataFrame, suspended: DataFrame) -> DataFrame:
    """date, stock_code, is_st, is_suspended; whatever one side doesn't know counts as true."""
    return st.join(suspended, KEYS, "full").select(*KEYS, flag("is_st", True).alias("is_st"), flag("is_suspended", True).alias("is_suspended"))


def exposure_join(universe: DataFrame, industry: DataFrame, market_cap: DataFrame) -> DataFrame:
    joined = universe.join(industry, KEYS, "left").join(market_cap, KEYS, "left")
    return joined.withColumn("industry", F.coalesce("industry", F.lit("Unknown")))


def panel_skeleton(calendar: DataFrame, members: DataFrame, prices: DataFrame, status: DataFrame) -> DataFrame:
    """Every calendar date x every stock that ever was a member, with prices, status and record flags."""
    grid = members.select("stock_code").distinct().crossJoin(by_day(calendar.select("date")))
    full = grid.join(prices.withColumn("_p", F.lit(True)), KEYS, "left").join(status.withColumn("_s", F.lit(True)), KEYS, "left")
    full = full.withColumn("has_price_record", flag("_p", False)).withColumn("has_status_record", flag("_s", False)).drop("_p", "_s")
    inside = members.select(*KEYS).distinct().withColumn("in_universe", F.lit(True))
    full = full.join(inside, KEYS, "left").withColumn("in_universe", flag("in_universe", False))
    return full.withColumn("is_st", flag("is_st", True)).withColumn("is_suspended", flag("is_suspended", True))


def panel_simple(prices: DataFrame, members: DataFrame, status: DataFrame, exposures: DataFrame) -> DataFrame:
    """One row a price record, with membership, status and exposures beside it."""
    inside = members.select(*KEYS).distinct().withColumn("in_universe", F.lit(True))
    out = prices.join(inside, KEYS, "left").withColumn("in_universe", flag("in_universe", False))
    out = out.join(status, KEYS, "left").withColumn("is_st", flag("is_st", True)).withColumn("is_suspended", flag("is_suspended", True))
    return out.join(exposures, KEYS, "left").withColumn("industry", F.coalesce("industry", F.lit("Unknown")))


def normalize_industry(industry: Column | str) -> Column:
    """Trimmed; null, empty and any spelling of unknown become UNKNOWN."""
    name = F.trim(F.col(industry) if isinstance(industry, str) else industry)
    return F.when(name.isNull() | (name == "") | (F.lower(name) == "unknown"), "UNKNOWN").otherwise(name)
