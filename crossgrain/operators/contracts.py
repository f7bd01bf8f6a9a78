"""Contract checks: each gives a table of violations, empty if all is well; `doctor` puts several together.

Violations have the form (check, key, detail), so that they can be stacked.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossgrain.functions.columns import KEYS, ratio

#: Names that no feature may have, how such names begin, what they hold, and a time after t in a status name.
FORBIDDEN = frozenset("""date stock_code target_10d rank_target_10d market_target_10d industry_target_10d alpha_target_10d
exit_date_10d split_10d entry_tradeable""".split())
FORBIDDEN_PREFIXES = ("target_", "split_", "exit_", "entry_", "future_", "next_")
FORBIDDEN_INFIXES = ("t+1", "t_plus_")
LATER = re.compile(r"t(?:_|\+|_?plus_?)?0*([1-9][0-9]*)")


def violation(check: str, key: Column, detail: Column) -> list[Column]:
    return [F.lit(check).alias("check"), key.cast("string").alias("key"), detail.cast("string").alias("detail")]


def key_text(*columns: str) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def forbidden_feature(name: str) -> bool:
    """Whether a column would leak a key, a label or the future into the features."""
    low = name.lower()
    named = low in FORBIDDEN or low.startswith(FORBIDDEN_PREFIXES) or any(x in low for x in FORBIDDEN_INFIXES)
    return named or ("status" in low and LATER.search(low) is not None)


def schema_contract(df: DataFrame, required: Sequence[str] = (), features: Sequence[str] | None = None) -> DataFrame:
    """Missing required columns and forbidden feature names; looks at the schema only."""
    rows = [("required", c, "missing") for c in required if c not in df.columns]
    rows += [("feature", c, "forbidden") for c in (features if features is not None else df.columns) if forbidden_feature(c)]
    return df.sparkSession.createDataFrame(rows, "check string, key string, detail string")


def check_unique_keys(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*violation("unique_keys", key_text(*keys), F.col("n")))


def check_keys_present(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """How many rows have a null or blank key, if any."""
    bad = reduce(lambda a, b: a | b, [F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "") for k in keys])
    return df.agg(F.count_if(bad).alias("n")).where("n > 0").select(*violation("keys_present", F.lit(",".join(keys)), F.col("n")))


def check_daily_size(df: DataFrame, size: int) -> DataFrame:
    return df.groupBy("date").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != size).select(*violation("daily_size", F.col("date"), F.col("n")))


def check_calendar_cover(df: DataFrame, calendar: DataFrame) -> DataFrame:
    days = df.select("date").distinct()
    missing = calendar.select("date").join(days, "date", "left_anti").select(*violation("calendar_cover", F.col("date"), F.lit("missing")))
    return missing.unionByName(days.join(calendar.select("date"), "date", "left_anti").select(*violation("calendar_cover", F.col("date"), F.lit("unknown"))))


def check_exact_key_match(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    left, right = (x.select(*keys).distinct().withColumn(n, F.lit(True)) for x, n in ((a, "_a"), (b, "_b")))
    both = left.join(right, list(keys), "full")
    return both.where("_a is null or _b is null").select(*violation("exact_key_match", key_text(*keys), F.when(F.col("_a").isNull(), "only right").otherwise("only left")))


def check_split_boundaries(index: DataFrame, horizon: int, periods: Mapping[str, tuple[str, str]], most_days: int = 31) -> DataFrame:
    """Split rows whose date or exit leaves the period or whose exit isn't 1 to `most_days` days on, and unexplained rows without split."""
    split, exits = F.col(f"split_{horizon}"), F.col(f"exit_date_{horizon}")
    inside, end = F.lit(False), F.lit(None).cast("date")
    for name, (first, last) in periods.items():
        lo, hi = F.to_date(F.lit(first)), F.to_date(F.lit(last))
        inside = inside | ((split == name) & F.col("date").between(lo, hi) & exits.between(lo, hi))
        end = F.when(F.col("base_period") == name, hi).otherwise(end)
    days = F.date_diff(exits, "date")
    label = F.col(f"target_{horizon}d").isNotNull()
    wrong = (
        F.when(split.isNotNull() & ~F.coalesce(inside, F.lit(False)), "outside period").when(split.isNotNull() & ~F.coalesce(days.between(1, most_days), F.lit(False)), "exit distance")
        .when(split.isNull() & F.col("base_period").isNotNull() & label & F.coalesce(exits <= end, F.lit(False)), "unexplained")
    )
    return index.withColumn("_w", wrong).where("_w is not null").select(*violation("split_boundaries", key_text(*KEYS), F.col("_w")))


def check_finite_features(df: DataFrame, features: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """Features with nulls or non-finite values (with their number), forbidden names, and a wrong order, in one aggregate."""
    missing = [f for f in features if f not in df.columns]
    have = [f for f in features if f in df.columns]
    bad = lambda f: F.col(f).isNull() | F.isnan(F.col(f).cast("double")) | (F.abs(F.col(f).cast("double")) == float("inf"))
    counts = df.agg(F.array(*[F.struct(F.lit(f).alias("key"), F.count_if(bad(f)).alias("n")) for f in have]).alias("a")).select(F.inline("a")).where("n > 0")
    out = counts.select(*violation("finite_features", F.col("key"), F.col("n")))
    rows = [("finite_features", f, "missing") for f in missing] + [("finite_features", f, "forbidden") for f in have if forbidden_feature(f)]
    if order is not None and list(order) != [c for c in df.columns if c in set(order)]:
        rows.append(("finite_features", ",".join(order), "order"))
    return out.unionByName(df.sparkSession.createDataFrame(rows, "check string, key string, detail string")) if rows else out


def check_return_rank_order(df: DataFrame, value: str, rank: str) -> DataFrame:
    """Rows whose rank is under that of a smaller or equal return of their date."""
    before = F.lag(rank).over(Window.partitionBy("date").orderBy(value, rank))
    return df.where(F.col(value).isNotNull()).withColumn("_b", before).where(F.col(rank) < F.col("_b")).select(*violation("return_rank_order", key_text(*KEYS), F.col(rank)))


def data_quality_report(sample: DataFrame, min_listing_days: int) -> DataFrame:
    """One row: numbers of rows, dates and stocks, eligible rows, and exclusions by reason (a row may have several)."""
    null_or = lambda c, cond: F.col(c).isNull() | cond
    return sample.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("date").alias("dates"), F.count_distinct("stock_code").alias("stocks"), F.count_if("eligible").alias("eligible"),
        F.count_if(null_or("in_universe", ~F.col("in_universe"))).alias("outside_universe"), F.count_if(null_or("entry_is_st", F.col("entry_is_st"))).alias("st"),
        F.count_if(null_or("entry_is_suspended", F.col("entry_is_suspended"))).alias("suspended"), F.count_if(null_or("entry_listing_days", F.col("entry_listing_days") < min_listing_days)).alias("listed_too_short"),
        F.count_if(F.col("entry_raw_open").isNull()).alias("no_open"), F.count_if(F.col("entry_raw_open") >= F.col("entry_limit_up") - 1e-10).alias("at_limit_up"), F.count_if(F.col("entry_raw_open") <= F.col("entry_limit_down") + 1e-10).alias("at_limit_down"),
    )


def label_coverage(df: DataFrame, target: str) -> DataFrame:
    """date, total, valid, coverage, tied: members of groups of equal targets all count as tied."""
    shared = F.count(F.lit(1)).over(Window.partitionBy("date", target))
    x = df.withColumn("_t", F.col(target).isNotNull() & (shared > 1))
    return x.groupBy("date").agg(F.count(F.lit(1)).alias("total"), F.count(target).alias("valid"), ratio(F.count(target), F.count(F.lit(1))).alias("coverage"), F.count_if("_t").alias("tied"))


def missing_feature_rates(df: DataFrame) -> DataFrame:
    """feature, rate of each __missing column, and of all together as '*'."""
    flags = [c for c in df.columns if c.endswith("__missing")]
    means = [F.avg((F.col(c) > 0).cast("double")) for c in flags]
    rows = [F.struct(F.lit(c.removesuffix("__missing")).alias("feature"), m.alias("rate")) for c, m in zip(flags, means, strict=True)]
    rows.append(F.struct(F.lit("*").alias("feature"), (sum(means[1:], means[0]) / len(means)).alias("rate")))
    return df.agg(F.array(*rows).alias("a")).select(F.inline("a"))


def unknown_industry_rate(df: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    return df.agg(F.avg((~F.coalesce(F.col("industry").isin(*vocabulary), F.lit(False))).cast("double")).alias("unknown_industry_rate"))


def common_as_of(sources: Mapping[str, DataFrame]) -> DataFrame:
    """source, as_of, agrees: whether all sources end on the same date."""
    rows = reduce(DataFrame.unionByName, [df.agg(F.max("date").alias("as_of")).withColumn("source", F.lit(n)) for n, df in sources.items()])
    one = (F.min("as_of").over(Window.partitionBy()) == F.max("as_of").over(Window.partitionBy())) & (F.count("as_of").over(Window.partitionBy()) == len(sources))
    return rows.select("source", "as_of", F.coalesce(one, F.lit(False)).alias("agrees"))


def prediction_contract(predictions: DataFrame, calendar: DataFrame, size: int, split: str, horizon: int, period: tuple[str, str]) -> DataFrame:
    """Every violation of a prediction table: keys, sizes, calendar, scores, split, horizon and period."""
    p = predictions
    checks = [check_keys_present(p), check_unique_keys(p), check_daily_size(p, size)]
    unknown = p.select("date").distinct().join(calendar.select("date"), "date", "left_anti")
    checks.append(unknown.select(*violation("calendar_cover", F.col("date"), F.lit("unknown"))))
    checks.append(check_finite_features(p, ["score"]))
    outside = ~F.col("date").between(F.to_date(F.lit(period[0])), F.to_date(F.lit(period[1])))
    for name, bad in (("split", ~F.col("split").eqNullSafe(split)), ("horizon", ~F.col("horizon").eqNullSafe(horizon)), ("period", outside)):
        checks.append(p.agg(F.count_if(bad).alias("n")).where("n > 0").select(*violation(name, F.lit(name), F.col("n"))))
    return reduce(DataFrame.unionByName, checks)


def schedule_annotation_check(published: DataFrame, schedule: DataFrame) -> DataFrame:
    """Rows of (path, date) where published and scheduled (rebalance, signal_date) differ or one side is missing."""
    cols = ["rebalance", "signal_date"]
    a, b = published.select("path", "date", *[F.col(c).alias(f"_a_{c}") for c in cols], F.lit(True).alias("_a")), schedule.select("path", "date", *[F.col(c).alias(f"_b_{c}") for c in cols], F.lit(True).alias("_b"))
    both = a.join(b, ["path", "date"], "full")
    same = reduce(lambda x, y: x & y, [F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")) for c in cols])
    detail = F.when(F.col("_a").isNull(), "not published").when(F.col("_b").isNull(), "not scheduled").otherwise("differs")
    return both.where(F.col("_a").isNull() | F.col("_b").isNull() | ~same).select(*violation("schedule", key_text("path", "date"), detail))


def doctor(spark: SparkSession, checks: Sequence[DataFrame]) -> DataFrame:
    """All violations of the given checks."""
    none = spark.createDataFrame([], "check string, key string, detail string")
    return reduce(DataFrame.unionByName, checks, none)


def prefixed(text: Column) -> Column:
    """A text with its length in bytes before it; null is a mark that no text can be."""
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("n"))


def canonical(c: str, kind: str) -> Column:
    """A value as text: equal values have equal texts (0.0 and -0.0 are equal)."""
    x = F.col(f"`{c}`")
    if kind in ("double", "float"):
        x = x + F.lit(0.0).cast(kind)
    return F.hex(x) if kind == "binary" else x.cast("string")


def table_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """schema, rows, digest_a, digest_b of the given columns, whatever the order of rows.

    schema hashes names and types in order. A row is the chain of its values, each with its length, so no
    two rows look alike; the digests are sums of two independent parts of the rows' hashes.
    """
    columns = list(df.columns if columns is None else columns)
    kinds = dict(df.dtypes)
    named = "".join(f"{len(x.encode())}:{x}" for c in columns for x in (c, kinds[c]))
    row = F.md5(F.concat(F.lit(""), *[prefixed(canonical(c, kinds[c])) for c in columns]).cast("binary"))
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return df.agg(F.count(F.lit(1)).alias("rows"), part(1).alias("digest_a"), part(17).alias("digest_b")).select(F.md5(F.lit(named).cast("binary")).alias("schema"), "rows", "digest_a", "digest_b")


def label_fingerprint(df: DataFrame, labels: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """The fingerprint of keys and labels alone: features may change without changing it."""
    return table_fingerprint(df, [*keys, *labels])
