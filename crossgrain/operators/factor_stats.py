"""Single-factor statistics: information coefficients, quantiles, long/short value, turnover, yearly tables.

The long form of a sample is (date, stock_code, variant, window, value, ret, quantile): factor variants
and return windows are data, so one job serves all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossgrain.functions.columns import average_rank, both, col, correlation, flag, ratio
from crossgrain.operators.cross_section import assign_quantiles

SERIES = ["variant", "window"]
#: Fixed value: trading days a year.
YEAR = 252


def positive(x: Column | str) -> Column:
    """Whether a statistic is over 0 by more than the noise of its sums."""
    return F.round(col(x), 12) > 0


def long_sample(rows: DataFrame, variants: Sequence[str], windows: Sequence[int]) -> DataFrame:
    """date, stock_code, variant, window, value, ret of wide rows with variant and return_{w} columns."""
    pairs = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(w).alias("window"), F.col(v).alias("value"), F.col(f"return_{w}").alias("ret")) for v in variants for w in windows])
    return rows.select("date", "stock_code", F.inline(pairs))


def daily_ic(long: DataFrame, least: int = 3) -> DataFrame:
    """date, variant, window, ic, rank_ic, n over complete pairs; ranks are of the complete pairs only.

    One pass over `long`: rows without a pair stay as nulls, which rank last, so no join brings back groups without pairs.
    """
    keys = ["date", *SERIES]
    pairs = long.select(*keys, both("value", "ret").alias("value"), both("ret", "value").alias("ret"))
    ranked = pairs.withColumn("_rv", average_rank("value", *keys)).withColumn("_rr", average_rank("ret", *keys))
    return ranked.groupBy(*keys).agg(correlation("value", "ret", least=least).alias("ic"), correlation("_rv", "_rr", least=least).alias("rank_ic"), F.count("value").alias("n"))


def cumulative_ic(ic: DataFrame, columns: Sequence[str] = ("ic", "rank_ic")) -> DataFrame:
    """ic with cumulative_{c}: running sums that skip nulls and are null where the value is."""
    w = Window.partitionBy(*SERIES).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return ic.select("*", *[F.when(F.col(c).isNotNull(), F.sum(c).over(w)).alias(f"cumulative_{c}") for c in columns])


def ic_summary(ic: DataFrame) -> DataFrame:
    """variant, window, metric, mean, std, icir, annual_icir, positive_ratio, n over the present values."""
    both = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("x")) for c in ("ic", "rank_ic")])
    rows = ic.select(*SERIES, F.inline(both)).where("x is not null")
    g = rows.groupBy(*SERIES, "metric").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.avg(positive("x").cast("double")).alias("positive_ratio"), F.count("x").alias("n"))
    icir = ratio("mean", "std")
    return g.select(*SERIES, "metric", "mean", "std", icir.alias("icir"), (icir * F.sqrt(F.lit(float(YEAR)))).alias("annual_icir"), "positive_ratio", "n")


def with_quantiles(long: DataFrame, q: int) -> DataFrame:
    """long with `quantile` by value among the rows that have one, per date and variant; null under q of them."""
    return long.withColumn("quantile", assign_quantiles("value", q, "date", *SERIES))


def quantile_daily_returns(grouped: DataFrame) -> DataFrame:
    """date, variant, window, quantile, mean_return, n of rows with a quantile and a return."""
    return grouped.where("quantile is not null and ret is not null").groupBy("date", *SERIES, "quantile").agg(F.avg("ret").alias("mean_return"), F.count(F.lit(1)).alias("n"))


def quantile_means(daily: DataFrame) -> DataFrame:
    return daily.groupBy(*SERIES, "quantile").agg(F.avg("mean_return").alias("mean_return"), F.count(F.lit(1)).alias("n"))


def quantile_summary(daily: DataFrame) -> DataFrame:
    """variant, window, monotonicity, top, bottom, spread over the groups that exist."""
    means = quantile_means(daily)
    ranked = means.withColumn("_g", average_rank("quantile", *SERIES)).withColumn("_m", average_rank(F.round("mean_return", 12), *SERIES))
    g = ranked.groupBy(*SERIES).agg(correlation("_g", "_m").alias("monotonicity"), F.max_by("mean_return", "quantile").alias("top"), F.min_by("mean_return", "quantile").alias("bottom"))
    return g.withColumn("spread", F.col("top") - F.col("bottom"))


def long_short_nav(daily: DataFrame, q: int, direction: int = 1, window: int = 1) -> DataFrame:
    """date, variant, g1, gq, long_short, nav: the top less the bottom group, compounded; null returns count as 0."""
    rows = daily.where(F.col("window") == window)
    legs = rows.groupBy("date", "variant").agg(F.max(F.when(F.col("quantile") == 1, F.col("mean_return"))).alias("g1"), F.max(F.when(F.col("quantile") == q, F.col("mean_return"))).alias("gq"))
    legs = legs.withColumn("long_short", (F.col("gq") - F.col("g1")) * direction)
    w = Window.partitionBy("variant").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    r = F.coalesce("long_short", F.lit(0.0))
    # exp(sum(log)) wherever it is defined: a running sum, not a growing list. Falls of all value or more are rare.
    sane = F.min(r).over(Window.partitionBy("variant")) > -1
    log_nav = F.exp(F.sum(F.log1p(F.when(r > -1, r).otherwise(0.0))).over(w))
    product = F.aggregate(F.collect_list(F.when(~sane, 1 + r)).over(w), F.lit(1.0), lambda a, x: a * x)
    return legs.withColumn("_sane", sane).withColumn("_log", log_nav).withColumn("_product", product).withColumn("nav", F.when(F.col("_sane"), F.col("_log")).otherwise(F.col("_product"))).drop("_sane", "_log", "_product")


def drawdowns(nav: DataFrame, by: Sequence[str] = ("variant",), value: str = "nav") -> DataFrame:
    """nav with drawdown: value over its running maximum, which starts at the first value, less 1."""
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return nav.withColumn("drawdown", ratio(value, F.max(value).over(w)) - 1)


def max_drawdown(nav: DataFrame, by: Sequence[str] = ("variant",), value: str = "nav") -> DataFrame:
    return drawdowns(nav, by, value).groupBy(*by).agg(F.min("drawdown").alias("max_drawdown"))


def _with_previous(members: DataFrame) -> DataFrame:
    """members (date, variant, stock_code, ...) with _prev: the previous date on which the variant has members."""
    dates = members.select("variant", "date").distinct()
    dates = dates.withColumn("_prev", F.lag("date").over(Window.partitionBy("variant").orderBy("date")))
    return members.join(dates, ["variant", "date"])


def rank_turnover(members: DataFrame, least: int = 3) -> DataFrame:
    """date, variant, rank_turnover: 1 - rank correlation on the stocks common with the previous present date.

    members: (date, variant, stock_code, value). Null under `least` common stocks.
    """
    now = _with_previous(members.select("date", "variant", "stock_code", "value"))
    then = members.select(F.col("date").alias("_prev"), "variant", "stock_code", F.col("value").alias("_before"))
    common = now.join(then, ["_prev", "variant", "stock_code"])
    ranked = common.withColumn("_a", average_rank("value", "date", "variant")).withColumn("_b", average_rank("_before", "date", "variant"))
    out = ranked.groupBy("date", "variant").agg((1 - correlation("_a", "_b", least=least)).alias("rank_turnover"))
    return members.select("date", "variant").distinct().join(out, ["date", "variant"], "left")


def membership_turnover(members: DataFrame, q: int) -> DataFrame:
    """date, variant, top_turnover, bottom_turnover: 1 - overlap with the previous group / its size; null if it was empty."""
    legs = members.where(F.col("quantile").isin(1, q)).select("date", "variant", "stock_code", "quantile")
    marked = _with_previous(members.select("date", "variant", "stock_code", "quantile"))
    now = marked.where(F.col("quantile").isin(1, q)).select("date", "_prev", "variant", "stock_code", "quantile")
    then = legs.select(F.col("date").alias("_prev"), "variant", "stock_code", "quantile", F.lit(1).alias("_was"))
    kept = now.join(then, ["_prev", "variant", "stock_code", "quantile"]).groupBy("date", "variant", "quantile").agg(F.count(F.lit(1)).alias("kept"))
    size = legs.groupBy("date", "variant", "quantile").agg(F.count(F.lit(1)).alias("size"))
    days = marked.select("date", "_prev", "variant").distinct()
    sides = days.withColumn("quantile", F.explode(F.array(F.lit(1), F.lit(q))))
    full = sides.join(kept, ["date", "variant", "quantile"], "left").join(size.withColumnRenamed("date", "_prev"), ["_prev", "variant", "quantile"], "left")
    turned = 1 - ratio(F.coalesce("kept", F.lit(0)), "size")
    return full.groupBy("date", "variant").agg(F.max(F.when(F.col("quantile") == q, turned)).alias("top_turnover"), F.max(F.when(F.col("quantile") == 1, turned)).alias("bottom_turnover"))


def yearly_performance(ic: DataFrame, nav: DataFrame, turnover: DataFrame) -> DataFrame:
    """year, variant, window: IC statistics, long/short statistics (window 1 only) and mean turnovers.

    Positive and win ratios divide by all rows of the year, nulls included; n counts present values.
    """
    year = F.year("date").alias("year")
    i = ic.groupBy(year, *SERIES).agg(
        F.avg("rank_ic").alias("mean_rank_ic"), F.stddev_samp("rank_ic").alias("std_rank_ic"), F.avg(flag(positive("rank_ic"), False).cast("double")).alias("ic_positive_ratio"), F.count("rank_ic").alias("n"),
    )
    i = i.withColumn("rank_icir", ratio("mean_rank_ic", "std_rank_ic"))
    yearly = nav.withColumn("year", F.year("date"))
    r = F.coalesce("long_short", F.lit(0.0))
    w = Window.partitionBy("variant", "year").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    own = yearly.withColumn("_nav", F.exp(F.sum(F.log1p(F.when(r > -1, r).otherwise(-0.999999999999))).over(w)))
    own = own.withColumn("_dd", ratio("_nav", F.max("_nav").over(w)) - 1)
    s = own.groupBy("year", "variant").agg(
        (F.max_by("_nav", "date") - 1).alias("long_short_return"), F.avg(flag(positive("long_short"), False).cast("double")).alias("win_rate"), F.min("_dd").alias("max_drawdown"), F.lit(1).alias("window"),
    )
    t = turnover.groupBy(year, "variant").agg(*[F.avg(c).alias(f"mean_{c}") for c in ("rank_turnover", "top_turnover", "bottom_turnover")])
    return i.join(s, ["year", *SERIES], "left").join(t, ["year", "variant"], "left")


def rolling_mean(series: DataFrame, column: str, by: Sequence[str], window: int = 60, least: int = 10) -> DataFrame:
    """series with rolling_{column}: the mean of the last `window` rows, null under `least` present values."""
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(-(window - 1), 0)
    return series.withColumn(f"rolling_{column}", F.when(F.count(column).over(w) >= least, F.avg(column).over(w)))


def yearly_pivot(yearly: DataFrame, column: str, windows: Sequence[int]) -> DataFrame:
    return yearly.groupBy("year", "variant").pivot("window", list(windows)).agg(F.first(column))


def last_nav(nav: DataFrame) -> DataFrame:
    return nav.groupBy("variant").agg(F.max_by("nav", "date").alias("last_nav"))
