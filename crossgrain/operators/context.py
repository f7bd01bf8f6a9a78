"""Market and industry context: one row a date, or a (date, industry), aggregated in one shuffle each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossgrain.functions.columns import by_day, by_stock, change, compounded, flag, ratio
from crossgrain.operators.calendar import normalize_industry
from crossgrain.operators.cross_section import cross_section_transform, fill_missing_flags, log_cap_impute

#: Tolerance of limit hits, and the cap coverage under which the equal return stands in.
LIMIT_TOLERANCE, LEAST_COVERAGE = 1e-8, 0.95


def daily_return_valid(panel: DataFrame) -> DataFrame:
    """panel with daily_return: close over the previous row's close, less 1, where both are positive."""
    before = F.lag("post_close").over(by_stock("date"))
    return panel.withColumn("daily_return", F.when((F.col("post_close") > 0) & (before > 0), change("post_close", before)))


def _share(hit: Column, among: Column) -> Column:
    """Share of `hit` among the rows where `among` holds; null without any."""
    return F.avg(F.when(flag(among, False), flag(hit, False).cast("double")))


def market_daily(panel: DataFrame) -> DataFrame:
    """Statistics of the universe of each date; panel needs daily_return."""
    r, cap = F.col("daily_return"), F.when(F.col("market_cap") > 0, F.col("market_cap"))
    log_cap, has_r = F.log(cap), F.col("daily_return").isNotNull()
    weighted = F.when(has_r, cap)
    rows = panel.where(flag("in_universe", False))
    g = rows.groupBy("date").agg(
        F.avg(r).alias("market_equal_return"),
        F.avg((r > 0).cast("double")).alias("market_up_ratio"),
        F.stddev_pop(r).alias("market_return_std"),
        *[F.percentile(r, q).alias(f"market_return_q{int(q * 100)}") for q in (0.1, 0.5, 0.9)],
        _share(F.col("raw_close") >= F.col("limit_up") - LIMIT_TOLERANCE, (F.col("limit_up") > 0) & F.col("raw_close").isNotNull()).alias("market_limit_up_ratio"),
        _share(F.col("raw_close") <= F.col("limit_down") + LIMIT_TOLERANCE, (F.col("limit_down") > 0) & F.col("raw_close").isNotNull()).alias("market_limit_down_ratio"),
        F.avg(flag("is_suspended", False).cast("double")).alias("market_suspended_ratio"),
        F.avg(flag("is_st", False).cast("double")).alias("market_st_ratio"),
        F.avg(log_cap).alias("market_log_cap_mean"), F.median(log_cap).alias("market_log_cap_median"), F.stddev_pop(log_cap).alias("market_log_cap_std"),
        F.avg(has_r.cast("double")).alias("market_return_coverage"), F.avg(cap.isNotNull().cast("double")).alias("market_cap_coverage"),
        ratio(F.sum(weighted * r), F.sum(weighted)).alias("_cap_return"), ratio(F.sum(weighted), F.sum(cap)).alias("_covered"),
    )
    return cap_weighted_return(g)


def cap_weighted_return(rows: DataFrame) -> DataFrame:
    """market_cap_return with market_cap_return_fallback = 1 where the caps cover too little and the equal return stands in."""
    ok = flag(F.col("_covered") >= LEAST_COVERAGE, False) & F.col("_cap_return").isNotNull()
    return rows.withColumn("market_cap_return", F.when(ok, F.col("_cap_return")).otherwise(F.col("market_equal_return"))).withColumn("market_cap_return_fallback", (~ok).cast("int")).drop("_cap_return", "_covered")


def industry_daily(panel: DataFrame) -> DataFrame:
    """Statistics of each known industry of each date's universe."""
    cap = F.when(F.col("market_cap") > 0, F.col("market_cap"))
    rows = panel.where(flag("in_universe", False)).withColumn("industry", normalize_industry("industry")).where("industry <> 'UNKNOWN'")
    r, has_r = F.col("daily_return"), F.col("daily_return").isNotNull()
    g = rows.groupBy("date", "industry").agg(
        F.avg(r).alias("industry_equal_return"), F.avg((r > 0).cast("double")).alias("industry_up_ratio"), F.stddev_pop(r).alias("industry_return_std"),
        (F.percentile(r, 0.9) - F.percentile(r, 0.1)).alias("industry_return_range"), F.count(F.lit(1)).alias("industry_count"), F.median(F.log(cap)).alias("industry_log_cap_median"), F.sum(cap).alias("_cap"),
        F.avg(flag("is_suspended", False).cast("double")).alias("industry_suspended_ratio"), F.avg(has_r.cast("double")).alias("industry_return_coverage"),
    )
    return g.withColumn("industry_cap_share", ratio("_cap", F.sum("_cap").over(Window.partitionBy("date")))).drop("_cap")


def compound_return(rows: DataFrame, value: str, window: int, by: Sequence[str], out: str) -> DataFrame:
    """Product of 1 + value over the last `window` rows less 1, null unless all are present; rows are dense and few."""
    w = Window.partitionBy(*by).orderBy("date") if by else Window.orderBy("date")
    w = w.rowsBetween(-(window - 1), 0)
    return rows.withColumn(out, F.when(F.count(value).over(w) >= window, compounded(value, w)))


def calendar_reindex(rows: DataFrame, calendar: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """rows on every calendar date (x every value of `by` that occurs)."""
    days = calendar.select("date")
    grid = rows.select(*by).distinct().crossJoin(by_day(days)) if by else days
    return grid.join(rows, ["date", *by], "left")


def industry_excess(industries: DataFrame, market: DataFrame, window: int) -> DataFrame:
    """date, industry, industry_excess_{window}: the industry's compound return less the market's."""
    i = compound_return(industries, "industry_equal_return", window, ["industry"], "_i")
    m = compound_return(market, "market_equal_return", window, [], "_m").select("date", "_m")
    return i.join(by_day(m), "date").select("date", "industry", (F.col("_i") - F.col("_m")).alias(f"industry_excess_{window}"))


def context_join(rows: DataFrame, market: DataFrame, industries: DataFrame, market_columns: Sequence[str], industry_columns: Sequence[str]) -> DataFrame:
    """rows with both contexts, missing as 0 with a __missing flag; an UNKNOWN industry has none."""
    out = rows.withColumn("industry", normalize_industry("industry")).join(by_day(market.select("date", *market_columns)), "date", "left")
    if industry_columns:
        # A row a date holds its industries, so that rows which lie by date aren't shuffled by industry; Spark broadcasts it only if it is small.
        entry = F.struct("industry", F.struct(*industry_columns))
        own = industries.where("industry is not null").groupBy("date").agg(F.map_from_entries(F.collect_list(entry)).alias("_own"))
        out = out.join(own, "date", "left").withColumn("_own", F.try_element_at("_own", "industry"))
        out = out.select("*", *[F.col("_own")[c].alias(c) for c in industry_columns]).drop("_own")
    return fill_missing_flags(out, [*market_columns, *industry_columns])


def feature_frame(rows: DataFrame, factors: Sequence[str], market: DataFrame, industries: DataFrame, market_columns: Sequence[str], industry_columns: Sequence[str]) -> DataFrame:
    """keys, industry and all features in a fixed order: factors, log cap, market, industry, then the flags."""
    x = cross_section_transform(rows.select("date", "stock_code", "industry", "market_cap", *factors), factors)
    x = log_cap_impute(x)
    x = context_join(x, market, industries, market_columns, industry_columns)
    order = [*factors, "log_market_cap", *market_columns, *industry_columns]
    return x.select("date", "stock_code", "industry", *order, *[f"{c}__missing" for c in order])
