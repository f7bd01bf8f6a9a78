"""Scans with coercion, and the sink."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossgrain.functions.columns import KEYS, col, finite

#: Words for true and false; the model's scans know t and f as well.
TRUE, FALSE = ("true", "1", "yes", "y"), ("false", "0", "no", "n")
MODEL_TRUE, MODEL_FALSE = (*TRUE, "t"), (*FALSE, "f")
ALIASES = {"order_book_id": "stock_code", "order_book_ids": "stock_code", "instrument": "stock_code", "datetime": "date", "trading_date": "date"}
CODE_SUFFIXES = (".XSHG", ".XSHE")

PANEL_SCHEMA = T.StructType(
    [T.StructField("date", T.DateType()), T.StructField("stock_code", T.StringType())]
    + [T.StructField(c, T.BooleanType()) for c in ("in_universe", "is_st", "is_suspended")]
    + [T.StructField(c, T.DoubleType()) for c in ("post_close", "raw_open", "raw_close", "limit_up", "limit_down", "listing_days", "market_cap")]
    + [T.StructField("industry", T.StringType())]
)


def normalize_stock_code(c: Column | str) -> Column:
    """Trimmed, without a trailing .0; up to six digits are padded to six."""
    code = F.regexp_replace(F.trim(col(c).cast("string")), r"\.0$", "")
    return F.when(code.rlike("^[0-9]{1,6}$"), F.lpad(code, 6, "0")).otherwise(code)


def normalize_keys(df: DataFrame, date: str = "date", code: str = "stock_code") -> DataFrame:
    return df.withColumn("date", F.to_date(date)).withColumn("stock_code", F.trim(F.col(code).cast("string")))


def parse_bool(c: Column | str, model: bool = False) -> Column:
    """true, false, or null for what is null or no word of the vocabulary (`bool_violations` finds the latter)."""
    word = F.lower(F.trim(col(c).cast("string")))
    true, false = (MODEL_TRUE, MODEL_FALSE) if model else (TRUE, FALSE)
    return F.when(word.isin(*true), True).when(word.isin(*false), False)


def bool_violations(df: DataFrame, column: str, model: bool = False) -> DataFrame:
    """value, n: words outside the vocabulary. Null is one for the single-factor scans, not for the model's."""
    bad = parse_bool(column, model).isNull()
    bad = bad & F.col(column).isNotNull() if model else bad
    return df.where(bad).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def coerce_numeric(c: Column | str) -> Column:
    """A double; unparsable, NaN and infinite become null."""
    return finite(col(c).cast("string").try_cast("double"))


def numeric_violations(df: DataFrame, column: str) -> DataFrame:
    """value, n: values that are present but no number (the strict scan's errors)."""
    bad = F.col(column).isNotNull() & F.col(column).cast("string").try_cast("double").isNull()
    return df.where(bad).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def unique_or_fail(df: DataFrame, name: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """`df`, which fails with the key if two rows share one; runs with whatever reads it, not as a job of its own.

    Rows are grouped by all keys but the first (by stock, of date and stock) and sorted by the first, as
    windows over a stock's time need them anyway: those find the rows in place and don't shuffle again.
    """
    first, *rest = keys
    w = Window.partitionBy(*rest).orderBy(first)
    key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    x = df.withColumn("_row", F.row_number().over(w)).withColumn("_same", F.lag(F.struct(first)).over(w).eqNullSafe(F.struct(first)))
    failed = F.raise_error(F.concat(F.lit(f"{name}: several rows have the key "), key)).cast("boolean")
    return x.where(F.when((F.col("_row") > 1) & F.col("_same"), failed).otherwise(True)).drop("_row", "_same")


def scan_factor(df: DataFrame, unique: bool = True) -> DataFrame:
    """(date, stock_code, factor_value) of a long table, or of a wide one: column date, else the first, and a column a stock.

    Keys are made uniform first and must be unique then, null values included, unless `unique` is false.
    """
    if not {"date", "stock_code", "factor_value"} <= set(df.columns):
        first = "date" if "date" in df.columns else df.columns[0]
        df = melt(df, first, [c for c in df.columns if c != first], "factor_value", "string")
    out = df.select(F.to_date("date").alias("date"), normalize_stock_code("stock_code").alias("stock_code"), coerce_numeric("factor_value").alias("factor_value"))
    return (unique_or_fail(out, "factor") if unique else out).where("factor_value is not null")


def conform(df: DataFrame, schema: T.StructType, model: bool = False) -> DataFrame:
    """The columns of `schema`, coerced; a missing one is an error."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    cast = {"boolean": lambda c: parse_bool(c, model), "double": coerce_numeric, "date": lambda c: F.to_date(c), "string": lambda c: F.trim(F.col(c).cast("string"))}
    return df.select(*[cast[f.dataType.simpleString()](f.name).alias(f.name) for f in schema])


def scan_market_panel(spark: SparkSession, path: str, fmt: str = "parquet", model: bool = False, unique: bool = True) -> DataFrame:
    """The panel's columns, coerced; its keys must be unique."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    panel = conform(reader.format(fmt).load(path), PANEL_SCHEMA, model)
    return unique_or_fail(panel, "market panel") if unique else panel


def scan_window(df: DataFrame, columns: Sequence[str], date: str, first: str, last: str, keys: Sequence[str] = ()) -> DataFrame:
    """Named columns of the days from first to last; both reach a Parquet scan as pruning and pushed filters.

    keys: columns, among those named, that must be unique together within the window.
    """
    kind = dict(df.dtypes)[date]
    lo, hi = F.lit(first).cast(kind), F.date_add(F.lit(last).cast("date"), 1).cast(kind)
    window = df.where((F.col(date) >= lo) & (F.col(date) < hi)).select(*columns)
    return unique_or_fail(window, "window", keys) if keys else window


def resolve_vendor_columns(df: DataFrame, aliases: Mapping[str, str] = ALIASES, sample: int = 20) -> DataFrame:
    """Known vendor names, in any case, become ours; else the first date type gives the date, and the first text column gives
    the stock of which any of `sample` present values ends in an exchange's suffix."""
    out = df.withColumnsRenamed({c: aliases[c.lower()] for c in df.columns if c.lower() in aliases and aliases[c.lower()] not in df.columns})
    if "date" not in out.columns:
        dates = [c for c, t in out.dtypes if t.startswith(("date", "timestamp"))]
        out = out.withColumnRenamed(dates[0], "date") if dates else out
    if "stock_code" not in out.columns:
        for c in (c for c, t in out.dtypes if t == "string"):
            values = out.select(F.col(f"`{c}`").alias("v")).where("v is not null").limit(sample).collect()
            if any(r.v.endswith(CODE_SUFFIXES) for r in values):
                return out.withColumnRenamed(c, "stock_code")
    return out


def melt(df: DataFrame, date: str, columns: Sequence[str], value: str, kind: str) -> DataFrame:
    """(date, stock_code, value) of the named columns, whatever their names hold (dots, for one); nulls are kept."""
    cells = F.array(*[F.struct(F.lit(c).alias("stock_code"), F.col(f"`{c}`").cast(kind).alias(value)) for c in columns])
    return df.select(F.col(f"`{date}`").alias("date"), F.inline(cells))


def unpivot_matrix(df: DataFrame, value: str, date: str = "date") -> DataFrame:
    """(date, stock_code, value) of a date x stock matrix, nulls kept."""
    rest = [c for c in df.columns if c != date]
    return melt(df, date, rest, value, dict(df.dtypes)[rest[0]])


def sink_table(df: DataFrame, path: str, fmt: str = "parquet", partition: str | None = None, sort: Sequence[str] = KEYS) -> None:
    """Overwrites a table, sorted by key inside each file; Parquet is zstd, split by year if `partition` names a date."""
    out = df.sortWithinPartitions(*sort)
    if partition:
        # A rebalance keeps a year together as far as partitions allow, and cuts one that is too large for a task.
        out = df.withColumn("year", F.year(partition)).hint("rebalance", "year").sortWithinPartitions("year", *sort)
    writer = out.write.mode("overwrite").format(fmt)
    writer = writer.option("compression", "zstd") if fmt == "parquet" else writer.option("header", True)
    (writer.partitionBy("year") if partition else writer).save(path)
