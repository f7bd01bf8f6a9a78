"""Column expressions with the null rules of cross-sectional panels: no NaN, no infinity, no division error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

KEYS = ["date", "stock_code"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """A double, or null where it is NaN or infinite."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def change(now: Column | str, then: Column | str) -> Column:
    return ratio(now, then) - 1


def both(x: Column | str, y: Column | str, what: Column | str | None = None) -> Column:
    """`what` (x, if not given) where x and y are both present."""
    x, y = col(x), col(y)
    return F.when(x.isNotNull() & y.isNotNull(), col(what) if what is not None else x)


def correlation(x: Column | str, y: Column | str, over: WindowSpec | None = None, least: int = 2) -> Column:
    """Pearson correlation over complete pairs: null under `least` pairs or for a constant side.

    Built from covariance and deviations, as corr() fails on a constant column in ANSI mode.
    """
    x, y = col(x), col(y)
    px, py = both(x, y, x), both(x, y, y)
    aggregates = F.covar_samp(px, py), F.stddev_samp(px), F.stddev_samp(py), F.count(px)
    cov, sx, sy, n = (a.over(over) for a in aggregates) if over is not None else aggregates
    return F.when(n >= least, F.try_divide(cov, sx * sy))


def average_rank(value: Column | str, *partition: Column | str, descending: bool = False) -> Column:
    """1-based rank within the partition, ties sharing their mean rank; null for a null value.

    A value's first and last place come from one sort: its rank, and the rows up to its last peer.
    """
    value = col(value)
    w = Window.partitionBy(*[col(p) for p in partition]).orderBy(value.desc_nulls_last() if descending else value.asc_nulls_last())
    last = F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(value.isNotNull(), (F.rank().over(w) + last) / 2.0)


def rank_percentile(value: Column | str, *partition: Column | str, single: float | None = None) -> Column:
    """(average rank - 1) / (n - 1) over present values; `single` where n is 1."""
    n = F.count(col(value)).over(Window.partitionBy(*[col(p) for p in partition]))
    return F.when(n > 1, (average_rank(value, *partition) - 1) / F.greatest(n - 1, F.lit(1))).when(col(value).isNotNull(), F.lit(single).cast("double"))


def by_stock(order: str = "pos") -> WindowSpec:
    return Window.partitionBy("stock_code").orderBy(order)


def calendar_lag(value: Column | str, k: int) -> Column:
    """The value k calendar rows ago (ahead, if k < 0); null where that date has no row."""
    return F.max(col(value)).over(by_stock().rangeBetween(-k, -k))


def rolling(aggregate, value: Column | str, window: int, least: int | None = None) -> Column:
    """aggregate(value) over the last `window` calendar rows, null under `least` (default: all) values."""
    over = by_stock().rangeBetween(-(window - 1), 0)
    return F.when(F.count(col(value)).over(over) >= (window if least is None else least), aggregate(col(value)).over(over))


def padded(value: Column | str) -> Column:
    """The latest value up to this row."""
    return F.last(col(value), ignorenulls=True).over(by_stock().rowsBetween(Window.unboundedPreceding, 0))


def compounded(returns: Column | str, over: WindowSpec) -> Column:
    """Product of 1 + returns less 1 over a frame; exact for returns under -1 as well. For frames of a fixed length: a row collects its frame."""
    return F.aggregate(F.collect_list(1 + col(returns)).over(over), F.lit(1.0), lambda acc, r: acc * r) - 1


def one_row(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, which must have one row a key: a query fails where it has several."""
    rest = [c for c in df.columns if c not in keys]
    several = F.raise_error(F.concat(F.lit("several rows of "), F.concat_ws("|", *[F.col(k).cast("string") for k in keys])))
    row = F.when(F.count(F.lit(1)) > 1, several).otherwise(F.first(F.struct(*rest)))
    return df.groupBy(*keys).agg(row.alias("_row")).select(*[k if k in keys else F.col("_row")[k].alias(k) for k in df.columns])


#: Dates of a calendar lie between these: 146,097 of them at most.
FIRST_DATE, LAST_DATE = "1800-01-01", "2199-12-31"


def by_day(df: DataFrame, date: str = "date") -> DataFrame:
    """df, which has a row a date, as the side of a join to broadcast.

    A query fails on a date outside FIRST_DATE to LAST_DATE, so what is broadcast has a bound however
    many stocks there are.
    """
    day = F.col(date)
    outside = (day < F.to_date(F.lit(FIRST_DATE))) | (day > F.to_date(F.lit(LAST_DATE)))
    failed = F.raise_error(F.concat(F.lit(f"not a date of a calendar, {FIRST_DATE} to {LAST_DATE}: "), day.cast("string"))).cast("boolean")
    return F.broadcast(df.where(F.when(outside, failed).otherwise(True)))


def flag(c: Column | str, missing: bool) -> Column:
    return F.coalesce(col(c), F.lit(missing))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, minus zero made zero: for value comparison between engines."""
    return df.select(*[(F.round(F.col(c), digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
