"""Per-date transforms: winsorising, standardising, neutralising, ranks, quantiles.

Each takes long rows with date, stock_code and a value column and adds a column. Statistics of a
date are window aggregates or small per-date tables, never a collected group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossgrain.functions.columns import average_rank, by_day, col, finite, ratio


def per(*keys: str):
    return Window.partitionBy(*keys)


#: Scale of a MAD to a deviation, and the least spread of a full-rank regressor.
MAD_SCALE, RANK_EPSILON = 1.4826, 1e-12


def mad_winsorize(rows: DataFrame, value: str, out: str, width: float = 5.0, by: Sequence[str] = ("date",)) -> DataFrame:
    """Values clipped to median +- width * 1.4826 * MAD of their date; unchanged where the MAD is 0 or null.

    Exact medians take two aggregations; their results, one row a group, join back.
    """
    keys = list(by)
    mid = rows.groupBy(*keys).agg(F.median(value).alias("_med"))
    x = rows.join(mid, keys)
    mad = x.groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("_med"))).alias("_mad"))
    x = x.join(mad, keys)
    reach = F.col("_mad") * (width * MAD_SCALE)
    clipped = F.greatest(F.least(F.col(value), F.col("_med") + reach), F.col("_med") - reach)
    return x.withColumn(out, F.when((F.col("_mad") > 0) & F.col(value).isNotNull(), clipped).otherwise(F.col(value))).drop("_med", "_mad")


def zscore(value: Column | str, *by: str) -> Column:
    """(x - mean) / sample deviation of the group; null where that is null or 0."""
    value, w = col(value), per(*(by or ("date",)))
    return ratio(value - F.avg(value).over(w), F.stddev_samp(value).over(w))


def zscore_population(value: Column | str, *by: str) -> Column:
    """The model's variant: population deviation; groups of one or without spread give 0, missing gives 0."""
    value, w = col(value), per(*(by or ("date",)))
    z = ratio(value - F.avg(value).over(w), F.stddev_pop(value).over(w))
    return F.coalesce(F.when(F.count(value).over(w) >= 2, z), F.lit(0.0))


def neutralize(rows: DataFrame, value: str, out: str, least: int = 5, by: Sequence[str] = ("date",)) -> DataFrame:
    """Standardised residual of value on industry dummies and log market cap, per date.

    By the Frisch-Waugh theorem this is the regression of industry-demeaned values on
    industry-demeaned log caps, so only window sums are needed. Null where a date has too few valid
    rows, no more rows than coefficients, or caps without spread within industries.
    """
    keys = list(by)
    valid = F.col(value).isNotNull() & F.col("industry").isNotNull() & (F.col("market_cap") > 0)
    x = rows.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    x = x.withColumn("_y", F.when(F.col("_ok"), F.col(value))).withColumn("_x", F.when(F.col("_ok"), F.log("market_cap")))
    cell = per(*keys, "industry")
    x = x.withColumn("_yd", F.col("_y") - F.avg("_y").over(cell)).withColumn("_xd", F.col("_x") - F.avg("_x").over(cell))
    # One row a (date, industry) counts the industry: its first valid row.
    first = F.row_number().over(per(*keys, "industry", "_ok").orderBy("stock_code")) == 1
    x = x.withColumn("_first", F.when(F.col("_ok") & first, 1))
    w = per(*keys)
    n, k = F.count("_y").over(w), F.count("_first").over(w) + 1
    xx, xy = F.sum(F.col("_xd") * F.col("_xd")).over(w), F.sum(F.col("_xd") * F.col("_yd")).over(w)
    residual = F.col("_yd") - ratio(xy, xx) * F.col("_xd")
    x = x.withColumn("_e", F.when(F.col("_ok") & (n >= least) & (n > k) & (xx > RANK_EPSILON), residual))
    return x.withColumn(out, zscore("_e", *keys)).drop("_ok", "_y", "_x", "_yd", "_xd", "_first", "_e")


def cross_section_transform(wide: DataFrame, features: Sequence[str], width: float = 5.0) -> DataFrame:
    """Each feature clipped by MAD and standardised per date, missing as 0, with a __missing flag beside it.

    All features share two aggregations a date: the medians, then the medians of the distances.
    """
    x = wide.select("*", *[finite(f).alias(f"_{f}") for f in features])
    mids = x.groupBy("date").agg(*[F.median(f"_{f}").alias(f"_med_{f}") for f in features])
    x = x.join(mids, "date")
    mads = x.groupBy("date").agg(*[F.median(F.abs(F.col(f"_{f}") - F.col(f"_med_{f}"))).alias(f"_mad_{f}") for f in features])
    x = x.join(mads, "date")
    for f in features:
        v, med, reach = F.col(f"_{f}"), F.col(f"_med_{f}"), F.col(f"_mad_{f}") * (width * MAD_SCALE)
        x = x.withColumn(f"_c_{f}", F.when((F.col(f"_mad_{f}") > 0) & v.isNotNull(), F.greatest(F.least(v, med + reach), med - reach)).otherwise(v))
    kept = [c for c in wide.columns if c not in features]
    return x.select(*kept, *[zscore_population(f"_c_{f}").alias(f) for f in features], *[F.col(f"_{f}").isNull().cast("int").alias(f"{f}__missing") for f in features])


def log_cap_impute(rows: DataFrame, cap: str = "market_cap") -> DataFrame:
    """rows with log_market_cap (log1p of a positive cap, else the date's median, else 0) and its __missing flag."""
    x = rows.withColumn("_l", F.when(F.col(cap) > 0, F.log1p(F.col(cap))))
    mid = x.groupBy("date").agg(F.median("_l").alias("_m"))
    x = x.join(by_day(mid), "date")
    return x.withColumn("log_market_cap", F.coalesce("_l", "_m", F.lit(0.0))).withColumn("log_market_cap__missing", F.col("_l").isNull().cast("int")).drop("_l", "_m")


def fill_missing_flags(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, *[F.coalesce(finite(c), F.lit(0.0)).alias(c) for c in columns], *[finite(c).isNull().cast("int").alias(f"{c}__missing") for c in columns])


def fit_scale(rows: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column, in one aggregate row; a deviation of 0 becomes 1."""
    row = rows.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def standard_scale(rows: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return rows.select(*[((F.col(c) - fitted[c][0]) / fitted[c][1]).alias(c) if c in fitted else F.col(c) for c in rows.columns])


#: Industries that a vocabulary may have.
MOST_INDUSTRIES = 10_000


def fit_industries(rows: DataFrame, column: str = "industry", most: int = MOST_INDUSTRIES) -> list[str]:
    """Sorted vocabulary without UNKNOWN: a row an industry. More than `most` are an error."""
    found = rows.select(column).where(f"{column} is not null and {column} <> 'UNKNOWN'").distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted(r[0] for r in found)


def industry_one_hot(rows: DataFrame, vocabulary: Sequence[str], column: str = "industry") -> DataFrame:
    """rows with one 0/1 column an industry and industry_UNKNOWN last, which takes whatever is unseen."""
    known = F.coalesce(F.col(column).isin(*vocabulary), F.lit(False)) if vocabulary else F.lit(False)
    return rows.select("*", *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"industry_{v}") for v in vocabulary], (~known).cast("int").alias("industry_UNKNOWN"))


def equal_date_weights() -> Column:
    return 1.0 / F.count(F.lit(1)).over(per("date"))


def assign_quantiles(value: Column | str, q: int, *by: str) -> Column:
    """Group 1..q by rank (ties by stock), edges in integer arithmetic; null in groups of under q values."""
    value, keys = col(value), by or ("date",)
    missing = value.isNull()
    w = Window.partitionBy(*keys, missing)
    n = F.count(F.lit(1)).over(w)
    r = F.row_number().over(w.orderBy(value, "stock_code")).cast("long")
    bin_ = F.greatest(F.lit(1), F.floor(((r - 1) * q + n - 2) / F.greatest(n - 1, F.lit(1)))).cast("int")
    return F.when(~missing & (n >= q), bin_)


def score_deciles(score: Column | str, *by: str, bins: int = 10) -> Column:
    """1 holds the highest scores; ties by stock."""
    w = Window.partitionBy(*(by or ("date",)))
    return (F.floor((F.row_number().over(w.orderBy(col(score).desc(), "stock_code")) - 1) * bins / F.count(F.lit(1)).over(w)) + 1).cast("int")


def top_k(rows: DataFrame, score: str, k: int, by: Sequence[str] = ("date",), lowest: bool = False) -> DataFrame:
    """The k rows of highest (lowest) score of each group with their cohort_rank; ties by stock."""
    order = F.col(score).asc() if lowest else F.col(score).desc()
    ranked = rows.where(F.col(score).isNotNull()).withColumn("cohort_rank", F.row_number().over(Window.partitionBy(*by).orderBy(order, "stock_code")))
    return ranked.where(F.col("cohort_rank") <= k)


def relevance(rank: Column | str, levels: int = 100) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(levels - 1), F.floor(col(rank) * levels))).cast("int")


def true_deciles(value: Column | str, *by: str, bins: int = 10) -> Column:
    """min(bins, ceil(bins * average rank from the top / n)): ties share a group."""
    n = F.count(col(value)).over(per(*(by or ("date",))))
    return F.least(F.lit(bins), F.ceil(average_rank(value, *(by or ("date",)), descending=True) * bins / n)).cast("int")
