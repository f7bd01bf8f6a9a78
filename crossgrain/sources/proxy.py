"""A daily-panel-like table from the star schema: suppliers are stocks, shipments their prices.

`grid` is the calendar's step, week or month. Gaps (no shipment in a step) occur and stay gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossgrain.functions.columns import by_day, by_stock
from crossgrain.sources.layout import parts, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str, grid: str) -> DataFrame:
    """date (its step's first day), k and the order's columns of each shipment."""
    own = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"]
    return table(spark, sf_dir, "lineitem").select(F.date_trunc(grid, "l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("k"), *own)


def by_cell(rows: DataFrame, stock: str) -> DataFrame:
    """The cells of shipments that lie by `stock` already, so that no further shuffle is needed."""
    price = F.round(10 * F.log(1 + F.try_divide("l_extendedprice", "l_quantity")), 4)
    order = F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return rows.select("date", stock, price.alias("price"), order.alias("o"), "l_quantity").groupBy("date", stock).agg(
        F.min_by("price", "o").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "o").alias("close"), F.sum("l_quantity").alias("turnover"),
    )


def cells(spark: SparkSession, sf_dir: str, grid: str = "week") -> DataFrame:
    """date, k, open, high, low, close, turnover: one row a step and supplier that shipped."""
    return by_cell(lines(spark, sf_dir, grid).repartition(parts(spark, panel_files(sf_dir)), "k"), "k")


def days(spark: SparkSession, sf_dir: str, grid: str = "week") -> DataFrame:
    """date: the steps in which anything was shipped, without making the cells."""
    return lines(spark, sf_dir, grid).select("date").distinct()


def calendar(rows: DataFrame) -> DataFrame:
    """date and pos (from 0) of the distinct dates: one row a date, so one task numbers them."""
    return rows.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")).cast("long") - 1)


def stock_code(k: str) -> F.Column:
    return F.concat(F.lit("S"), F.lpad(F.col(k).cast("string"), 6, "0"))


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, stock_code, industry and market_cap of all suppliers."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    named = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return named.select(F.col("s_suppkey").alias("k"), stock_code("s_suppkey").alias("stock_code"), F.col("r_name").alias("industry"), (F.col("s_acctbal") * 1e6).alias("market_cap"))


def prices(spark: SparkSession, sf_dir: str, grid: str = "week") -> DataFrame:
    """Long price table without gaps filled: date, pos, stock_code, k and the cells' columns."""
    c = cells(spark, sf_dir, grid)
    return c.join(by_day(calendar(days(spark, sf_dir, grid))), "date").withColumn("stock_code", stock_code("k"))


def panel_files(sf_dir: str) -> list[str]:
    """What the panel is made from."""
    return [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "supplier", "nation", "region")]


def panel(spark: SparkSession, sf_dir: str, grid: str = "week") -> DataFrame:
    """The dense market panel, stored once a session in buckets of stocks."""
    return stored(spark, f"panel_{grid}", panel_files(sf_dir), lambda: built_panel(spark, sf_dir, grid))


def built_panel(spark: SparkSession, sf_dir: str, grid: str = "week") -> DataFrame:
    """The dense market panel: one row a date and stock that ever had a price."""
    shipped, n = lines(spark, sf_dir, grid), parts(spark, panel_files(sf_dir))
    # Shipments are shuffled once, to the buckets of the table; all that follows stays in a bucket.
    c = by_cell(shipped.withColumn("stock_code", stock_code("k")).drop("k").repartition(n, "stock_code"), "stock_code").withColumnRenamed("date", "_date")
    # The calendar has one row a step: a few thousand in a century.
    steps = calendar(shipped)
    ends = steps.withColumn("_end", F.max("pos").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # A cell also makes the rows of the gap behind it, a stock's first one those before it: no join with a skeleton.
    own = c.join(by_day(ends), F.col("_date").eqNullSafe(F.col("date"))).drop("date").withColumnRenamed("pos", "_pos")
    by_pos = by_stock("_pos")
    first_row = F.when(F.lag("_pos").over(by_pos).isNull(), F.lit(0).cast("long")).otherwise(F.col("_pos"))
    grown = own.withColumn("_from", first_row).withColumn("_to", F.coalesce(F.lead("_pos").over(by_pos) - 1, "_end")).withColumn("pos", F.explode(F.sequence("_from", "_to")))
    here = (F.col("pos") == F.col("_pos")) & F.col("_date").isNotNull()
    cell = [F.when(here, F.col(x)).alias(x) for x in ("open", "high", "low", "close", "turnover")]
    named = stocks(spark, sf_dir).repartition(n, "stock_code")
    full = grown.select("stock_code", "pos", *cell, here.alias("has_price_record")).join(by_day(steps), "pos").join(named, "stock_code")
    before = F.last("close", ignorenulls=True).over(by_stock().rowsBetween(Window.unboundedPreceding, -1))
    first = F.min(F.when(F.col("close").isNotNull(), F.col("pos"))).over(Window.partitionBy("stock_code"))
    quarter = F.year("date") * 4 + F.quarter("date")
    return full.select(
        "date", "pos", "stock_code", "k",
        ((F.col("k") + quarter) % 5 != 0).alias("in_universe"),
        F.col("close").alias("post_close"), F.col("open").alias("post_open"), F.col("open").alias("raw_open"), F.col("close").alias("raw_close"), "high", "low", "turnover",
        (before * 1.4).alias("limit_up"), (before * 0.6).alias("limit_down"),
        ((F.col("k") * 7 + F.col("pos")) % 23 == 0).alias("is_st"), ((F.col("k") * 11 + F.col("pos")) % 19 == 0).alias("is_suspended"),
        F.greatest(F.lit(0), F.col("pos") - first + 1).cast("double").alias("listing_days"),
        "industry", "market_cap", "has_price_record",
    )


# -- the same in DuckDB's SQL ---------------------------------------------------------------------


def _sql(grid: str, suffix: str) -> dict[str, tuple[str, str]]:
    """name -> (names it needs, body)."""
    return {
        f"cells{suffix}": ("", f"""
SELECT date, k, first(price ORDER BY a, b, c, d) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY a, b, c, d) AS close, sum(d) AS turnover
FROM (SELECT CAST(date_trunc('{grid}', l_shipdate) AS DATE) AS date, l_suppkey AS k, round(10 * ln(1 + l_extendedprice / nullif(l_quantity, 0)), 4) AS price,
             l_orderkey AS a, l_linenumber AS b, l_extendedprice AS c, l_quantity AS d FROM lineitem) GROUP BY date, k"""),
        f"cal{suffix}": (f"cells{suffix}", f"SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM cells{suffix})"),
        f"stocks{suffix}": (f"cells{suffix}", f"""
SELECT s_suppkey AS k, 'S' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS stock_code, r_name AS industry, s_acctbal * 1e6 AS market_cap
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey IN (SELECT k FROM cells{suffix})"""),
        f"prices{suffix}": (f"cells{suffix} cal{suffix}", f"SELECT c.*, pos, 'S' || lpad(CAST(k AS VARCHAR), 6, '0') AS stock_code FROM cells{suffix} c JOIN cal{suffix} USING (date)"),
        f"panel{suffix}": (f"cells{suffix} cal{suffix} stocks{suffix}", f"""
SELECT date, pos, stock_code, k, (k + year(date) * 4 + quarter(date)) % 5 <> 0 AS in_universe,
  close AS post_close, open AS post_open, open AS raw_open, close AS raw_close, high, low, turnover,
  last_value(close IGNORE NULLS) OVER before * 1.4 AS limit_up, last_value(close IGNORE NULLS) OVER before * 0.6 AS limit_down,
  (k * 7 + pos) % 23 = 0 AS is_st, (k * 11 + pos) % 19 = 0 AS is_suspended,
  CAST(greatest(0, pos - min(CASE WHEN close IS NOT NULL THEN pos END) OVER (PARTITION BY stock_code) + 1) AS DOUBLE) AS listing_days,
  industry, market_cap, close IS NOT NULL AS has_price_record
FROM stocks{suffix} CROSS JOIN cal{suffix} LEFT JOIN cells{suffix} USING (date, k)
WINDOW before AS (PARTITION BY stock_code ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""),
    }


SQL = _sql("week", "") | _sql("month", "_m")
