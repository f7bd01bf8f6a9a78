"""Factor builders: calendar-lag and rolling-window expressions.

All take a table with date, pos (calendar position), stock_code and price columns, and give
(date, stock_code, factor_value) without nulls. Windows are ranges of calendar positions within a
stock, so every price factor of a panel shares one exchange and one sort by (stock_code, pos).
`REGISTRY` maps names to builders; `build` makes several at once and takes further builders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossgrain.functions.columns import by_day, by_stock, calendar_lag, change, correlation, finite, one_row, padded, ratio, rolling


def factor(panel: DataFrame, value: Column) -> DataFrame:
    return panel.select("date", "stock_code", value.alias("factor_value")).where("factor_value is not null")


def reversal(lookback: int, skip: int = 0) -> Column:
    """-(P[t - skip] / P[t - lookback - skip] - 1) of the adjusted close; needs a dense grid if skip > 0."""
    now = calendar_lag("post_close", skip) if skip else F.col("post_close")
    return -change(now, calendar_lag("post_close", lookback + skip))


def rev_1d(panel: DataFrame) -> DataFrame:
    return factor(panel, reversal(1))


def rev_5d(panel: DataFrame) -> DataFrame:
    return factor(panel, reversal(5))


def rev_20d_skip1(panel: DataFrame) -> DataFrame:
    return factor(panel, reversal(20, 1))


def reverse_20d(panel: DataFrame, lookback: int = 20) -> DataFrame:
    return factor(panel, reversal(lookback))


def intraday_reversal(window: int) -> Column:
    return -rolling(F.avg, change("raw_close", "raw_open"), window)


def intraday_rev_5d(panel: DataFrame, window: int = 5) -> DataFrame:
    return factor(panel, intraday_reversal(window))


def overnight_rev_5d(panel: DataFrame, window: int = 5) -> DataFrame:
    moved = panel.withColumn("_x", change("raw_open", calendar_lag("raw_close", 1)))
    return factor(moved, -rolling(F.avg, "_x", window))


def tail_strength_20d(panel: DataFrame, window: int = 20) -> DataFrame:
    span = F.col("high") - F.col("low")
    moved = panel.withColumn("_x", F.when(span > 0, ratio(F.col("raw_close") - F.col("raw_open"), span)))
    return factor(moved, rolling(F.avg, "_x", window))


def daily_returns(panel: DataFrame, fill: str = "pad") -> DataFrame:
    """The panel with return r; fill="pad" carries the last price over gaps, "none" leaves them null."""
    if fill == "pad":
        panel = panel.withColumn("_p", padded("post_close"))
        return panel.withColumn("r", change("_p", F.lag("_p").over(by_stock()))).drop("_p")
    return panel.withColumn("r", change("post_close", calendar_lag("post_close", 1)))


def with_market(panel: DataFrame, market: DataFrame) -> DataFrame:
    """Joins market returns m by date; market: (date, index_close), a row a date, or the query fails."""
    m = one_row(market.select("date", "index_close"), ["date"]).withColumn("m", change("index_close", F.lag("index_close").over(Window.orderBy("date")))).select("date", "m")
    return panel.join(by_day(m), "date", "left")


def _pair(window: int) -> tuple[Column, Column, Column, Column]:
    """Gated rolling variance of r, of m, their covariance, and m's mean, over complete windows of each."""
    over = by_stock().rangeBetween(-(window - 1), 0)
    n_r, n_m = F.count("r").over(over), F.count("m").over(over)
    n = F.count(F.when(F.col("r").isNotNull() & F.col("m").isNotNull(), 1)).over(over)
    return (
        F.when(n_r >= window, F.var_samp("r").over(over)),
        F.when(n_m >= window, F.var_samp("m").over(over)),
        F.when(n >= window, F.covar_samp("r", "m").over(over)),
        F.when(n_m >= window, F.avg("m").over(over)),
    )


def ivol_20d(panel: DataFrame, market: DataFrame, window: int = 20, compat: bool = True, fill: str = "pad") -> DataFrame:
    """Root of the variance that the market doesn't explain; needs a dense grid.

    compat: windows that aren't full give 0, not null, on every cell of the grid.
    """
    x = with_market(daily_returns(panel, fill), market)
    var_r, var_m, cov, _ = _pair(window)
    x = x.withColumn("_vr", var_r).withColumn("_vm", var_m).withColumn("_c", cov)
    left = F.col("_vr") - ratio(F.col("_c") * F.col("_c"), F.when(F.col("_vm") > 0, F.col("_vm")))
    root = F.sqrt(F.greatest(left, F.lit(0.0)))
    root = F.when(left.isNotNull(), root)
    return factor(x, F.coalesce(root, F.lit(0.0)) if compat else root)


def downside_ivol_20d(panel: DataFrame, market: DataFrame, window: int = 20, compat: bool = True, fill: str = "pad") -> DataFrame:
    """Deviation of the negative residuals, each from the regression over its own trailing window."""
    x = with_market(daily_returns(panel, fill), market)
    over = by_stock().rangeBetween(-(window - 1), 0)
    _, var_m, cov, mean_m = _pair(window)
    x = x.withColumn("_b", ratio(cov, F.when(var_m > 0, var_m))).withColumn("_mr", rolling(F.avg, "r", window)).withColumn("_mm", mean_m)
    e = F.col("r") - (F.col("_mr") - F.col("_b") * F.col("_mm")) - F.col("_b") * F.col("m")
    down = F.when(e < 0, e).otherwise(0.0) if compat else F.least(e, F.lit(0.0)) + e * 0
    x = x.withColumn("_d", down)
    return factor(x, F.when(F.count("_d").over(over) >= window, F.stddev_samp("_d").over(over)))


def volume_price_divergence_20d(panel: DataFrame, window: int = 20, fill: str = "pad") -> DataFrame:
    x = daily_returns(panel, fill)
    return factor(x, -correlation("r", "turnover", by_stock().rangeBetween(-(window - 1), 0), least=window))


# -- event factors ----------------------------------------------------------------------------------


def clean_eps_reports(reports: DataFrame) -> DataFrame:
    """Reports with date, stock, institute and a numeric EPS; one a (date, stock, institute, fiscal year), the largest."""
    rows = reports.select(F.to_date("date").alias("date"), F.trim("stock_code").alias("stock_code"), F.trim("institute").alias("institute"), F.expr("try_cast(fiscal_year as int)").alias("fiscal_year"), finite("eps").alias("eps"))
    return rows.where("date is not null and stock_code <> '' and institute <> '' and eps is not null").groupBy("date", "stock_code", "institute", "fiscal_year").agg(F.max("eps").alias("eps"))


def feed_calendar(feed: DataFrame) -> DataFrame:
    """`feed` with pos: the position of its date among the feed's own dates."""
    dates = feed.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")).cast("long") - 1)
    return feed.join(by_day(dates), "date")


def eps_revision_60d(feed: DataFrame, lookback: int = 60) -> DataFrame:
    """EPS[t] / EPS[t - lookback] - 1 over the feed's own date index; feed: (date, stock_code, eps)."""
    return factor(feed_calendar(feed), change("eps", calendar_lag("eps", lookback)))


def classify_revisions(reports: DataFrame) -> DataFrame:
    """date, stock_code, institute, up, down of each report against the last of its (stock, institute, year).

    A report without predecessor is left out; years that are null form a group of their own.
    """
    w = Window.partitionBy("stock_code", "institute", "fiscal_year").orderBy("date")
    rows = reports.withColumn("_last", F.lag("eps").over(w)).where("_last is not null")
    return rows.select("date", "stock_code", "institute", "fiscal_year", (F.col("eps") > F.col("_last")).alias("up"), (F.col("eps") < F.col("_last")).alias("down"))


def rolling_distinct_active(events: DataFrame, calendar: DataFrame, window: int = 60) -> DataFrame:
    """date, stock_code, n: institutes with an event in the last `window` calendar rows; events off the calendar are dropped.

    Each institute's events become spans of positions cut where the next event takes over, so that
    no position counts an institute twice and a sum over the spans is the distinct count.
    """
    days = events.select("date", "stock_code", "institute").distinct().join(by_day(calendar), "date")
    following = F.lead("pos").over(Window.partitionBy("stock_code", "institute").orderBy("pos"))
    spans = days.select("stock_code", "pos", F.least(F.col("pos") + window, F.coalesce(following, F.col("pos") + window)).alias("stop"))
    active = spans.select("stock_code", F.explode(F.sequence(F.col("pos"), F.col("stop") - 1)).alias("pos"))
    return active.groupBy("stock_code", "pos").agg(F.count(F.lit(1)).alias("n")).join(by_day(calendar), "pos").select("date", "stock_code", "n")


def eps_revision_breadth_60d(reports: DataFrame, calendar: DataFrame, window: int = 60) -> DataFrame:
    """(up - down) / covered. A stock that never has an up (a down) event has no count of them, so no factor."""
    events = classify_revisions(reports)
    kinds = {"n_up": "up", "n_down": "down", "n_covered": "true"}
    counts = [rolling_distinct_active(events.where(c), calendar, window).withColumnRenamed("n", k) for k, c in kinds.items()]
    known = events.join(by_day(calendar.select("date")), "date", "left_semi")
    ever = known.groupBy("stock_code").agg(F.max("up").alias("ever_up"), F.max("down").alias("ever_down"))
    full = counts[2].join(counts[0], ["date", "stock_code"], "left").join(counts[1], ["date", "stock_code"], "left").join(ever, "stock_code")
    zero = lambda n, e: F.when(F.col(e), F.coalesce(n, F.lit(0)))
    return factor(full, ratio(zero("n_up", "ever_up") - zero("n_down", "ever_down"), "n_covered"))


def sue_events(events: DataFrame, history: int = 8, least: int = 4) -> DataFrame:
    """date, stock_code, surprise, sue: surprise over the deviation of the `history` before it.

    Of several events of a stock and date the one of the latest year, period and standard counts.
    """
    order = F.struct("report_year", "report_period", "appraisal_standard", "actual", "expected")
    one = events.groupBy("date", "stock_code").agg(F.max_by(F.struct("actual", "expected"), order).alias("e"))
    rows = one.select("date", "stock_code", (F.col("e.actual") - F.col("e.expected")).alias("surprise"))
    before = Window.partitionBy("stock_code").orderBy("date").rowsBetween(-history, -1)
    std = F.when(F.count("surprise").over(before) >= least, F.stddev_samp("surprise").over(before))
    return rows.select("date", "stock_code", "surprise", ratio("surprise", std).alias("sue"))


def asof_ffill(events: DataFrame, calendar: DataFrame, value: str) -> DataFrame:
    """The latest event value at or before every calendar date, for every stock of the events."""
    grid = events.select("stock_code").distinct().crossJoin(by_day(calendar.select("date"))).withColumn("_v", F.lit(None).cast("double")).withColumn("_on", F.lit(1))
    marks = events.where(F.col(value).isNotNull()).select("stock_code", "date", F.col(value).alias("_v"), F.lit(0).alias("_on"))
    w = Window.partitionBy("stock_code").orderBy("date", "_on").rowsBetween(Window.unboundedPreceding, 0)
    return factor(grid.unionByName(marks).withColumn("_f", F.last("_v", ignorenulls=True).over(w)).where("_on = 1"), F.col("_f"))


def sue_latest(events: DataFrame, calendar: DataFrame) -> DataFrame:
    return asof_ffill(sue_events(events), calendar, "sue")


#: Builders that need nothing but the panel. A new factor is one more entry.
REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {f.__name__: f for f in (rev_1d, rev_5d, rev_20d_skip1, reverse_20d, intraday_rev_5d, overnight_rev_5d, tail_strength_20d, volume_price_divergence_20d)}


def build(panel: DataFrame, names: list[str], builders: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """(date, stock_code, factor, factor_value) of the named factors."""
    known = REGISTRY | (builders or {})
    parts = [known[n](panel).withColumn("factor", F.lit(n)) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("date", "stock_code", "factor", "factor_value")
