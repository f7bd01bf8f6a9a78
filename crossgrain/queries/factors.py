"""Queries F0 to F13."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossgrain.operators import factors as O
from crossgrain.queries.registry import part, query
from crossgrain.sources import proxy

OUT = "date stock_code ~factor_value"


def market(panel: DataFrame) -> DataFrame:
    """The mean price of each date: prices have four decimals, so a sum of integers is the same on any engine."""
    whole = F.sum(F.round(F.col("post_close") * 10_000).cast("long"))
    return panel.groupBy("date").agg((F.try_divide(whole, F.count("post_close") * F.lit(10_000.0))).alias("index_close"))


def orders_feed(spark, sf_dir: str) -> DataFrame:
    o = proxy.table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderdate").cast("date").alias("date"), F.concat(F.lit("C"), F.lpad((F.col("o_custkey") % 100).cast("string"), 3, "0")).alias("stock_code"),
        F.col("o_orderpriority").alias("institute"), F.year("o_orderdate").alias("fiscal_year"), F.col("o_totalprice").alias("eps"), "o_custkey", "o_orderkey", "o_orderstatus", F.quarter("o_orderdate").alias("q"),
    )


def earnings(spark, sf_dir: str) -> DataFrame:
    o = orders_feed(spark, sf_dir).where("o_orderstatus = 'F'")
    mean = o.groupBy("o_custkey").agg(F.avg("eps").alias("expected"))
    return o.join(mean, "o_custkey").select(
        "date", "stock_code", F.col("fiscal_year").alias("report_year"), F.concat(F.lit("Q"), "q").alias("report_period"), (F.col("o_orderkey") % 3).cast("int").alias("appraisal_standard"), F.col("eps").alias("actual"), "expected"
    )


part("o", "", """SELECT CAST(o_orderdate AS DATE) AS date, 'C' || lpad(CAST(o_custkey % 100 AS VARCHAR), 3, '0') AS stock_code, o_orderpriority AS institute,
  CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, o_totalprice AS eps, o_custkey, o_orderkey, o_orderstatus, quarter(o_orderdate) AS q FROM orders""")  # fmt: skip
part("reports", "o", "SELECT date, stock_code, institute, fiscal_year, max(eps) AS eps FROM o GROUP BY ALL")
part("revisions", "reports", """SELECT date, stock_code, institute, fiscal_year, eps > last AS up, eps < last AS down FROM
  (SELECT *, lag(eps) OVER (PARTITION BY stock_code, institute, fiscal_year ORDER BY date) AS last FROM reports) WHERE last IS NOT NULL""")
part("ocal", "o", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM o)")
part("actives", "revisions ocal", "SELECT r.*, pos FROM revisions r JOIN ocal USING (date)")


def revision_calendar(reports: DataFrame) -> DataFrame:
    """Trading dates of the proxy: all dates of the feed. Events off a calendar are tested on a small table."""
    return proxy.calendar(reports)


part("surprises", "o", """SELECT date, stock_code, actual - expected AS surprise FROM (
  SELECT f.date, f.stock_code, f.eps AS actual, e.expected,
         row_number() OVER (PARTITION BY f.date, f.stock_code ORDER BY fiscal_year DESC, q DESC, o_orderkey % 3 DESC, f.eps DESC, e.expected DESC) AS rn
  FROM o f JOIN (SELECT o_custkey, avg(eps) AS expected FROM o WHERE o_orderstatus = 'F' GROUP BY o_custkey) e USING (o_custkey) WHERE o_orderstatus = 'F') WHERE rn = 1""")
part("sues", "surprises", """SELECT date, stock_code, surprise, CASE WHEN count(surprise) OVER w >= 4 THEN surprise / nullif(stddev_samp(surprise) OVER w, 0) END AS sue
  FROM surprises WINDOW w AS (PARTITION BY stock_code ORDER BY date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)""")


def lag_sql(value: str, k: int) -> str:
    return f"max({value}) OVER (PARTITION BY stock_code ORDER BY pos RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING)"


def mean_sql(x: str, window: int, source: str) -> str:
    return f"""SELECT date, stock_code, {{sign}}avg(x) OVER w AS factor_value FROM (SELECT *, {x} AS x FROM {source})
      WINDOW w AS (PARTITION BY stock_code ORDER BY pos RANGE BETWEEN {window - 1} PRECEDING AND CURRENT ROW) QUALIFY count(x) OVER w = {window}"""


def reversal_query(name: str, build, lookback: int, skip: int = 0) -> None:
    now = lag_sql("post_close", skip) if skip else "post_close"
    body = f"SELECT * FROM (SELECT date, stock_code, -({now} / nullif({lag_sql('post_close', lookback + skip)}, 0) - 1) AS factor_value FROM panel) WHERE factor_value IS NOT NULL"
    query(name, "panel", body, OUT)(lambda spark, sf_dir: build(proxy.panel(spark, sf_dir)))


reversal_query("f1_rev_1d", O.rev_1d, 1)
reversal_query("f2_rev_5d", O.rev_5d, 5)
reversal_query("f3_rev_20d_skip1", O.rev_20d_skip1, 20, 1)
reversal_query("f4_reverse_lookback", lambda p: O.reverse_20d(p, 13), 13)


@query("f5_intraday_rev_5d", "panel", mean_sql("raw_close / nullif(raw_open, 0) - 1", 5, "panel").format(sign="-"), OUT)
def _(spark, sf_dir):
    return O.intraday_rev_5d(proxy.panel(spark, sf_dir))


@query("f6_overnight_rev_5d", "panel", mean_sql(f"raw_open / nullif({lag_sql('raw_close', 1)}, 0) - 1", 5, "panel").format(sign="-"), OUT)
def _(spark, sf_dir):
    return O.overnight_rev_5d(proxy.panel(spark, sf_dir))


@query("f7_tail_strength_20d", "panel_m", mean_sql("CASE WHEN high - low > 0 THEN (raw_close - raw_open) / (high - low) END", 20, "panel_m").format(sign=""), OUT)
def _(spark, sf_dir):
    return O.tail_strength_20d(proxy.panel(spark, sf_dir, "month"))


part("market_m", "panel_m", "SELECT date, index_close / nullif(lag(index_close) OVER (ORDER BY date), 0) - 1 AS m FROM (SELECT date, sum(CAST(round(post_close * 10000) AS BIGINT)) / nullif(count(post_close) * 10000.0, 0) AS index_close FROM panel_m GROUP BY date)")
part("ret_m", "panel_m market_m", """SELECT date, pos, stock_code, turnover, m, p / nullif(lag(p) OVER (PARTITION BY stock_code ORDER BY pos), 0) - 1 AS r FROM (
  SELECT date, pos, stock_code, turnover, m, last_value(post_close IGNORE NULLS) OVER (PARTITION BY stock_code ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p
  FROM panel_m LEFT JOIN market_m USING (date))""")
W20 = "WINDOW w AS (PARTITION BY stock_code ORDER BY pos RANGE BETWEEN 19 PRECEDING AND CURRENT ROW)"
part("pair_m", "ret_m", f"""SELECT *, CASE WHEN count(r) OVER w >= 20 THEN var_samp(r) OVER w END AS vr, CASE WHEN count(m) OVER w >= 20 THEN var_samp(m) OVER w END AS vm,
  CASE WHEN count(CASE WHEN r IS NOT NULL AND m IS NOT NULL THEN 1 END) OVER w >= 20 THEN covar_samp(r, m) OVER w END AS c,
  CASE WHEN count(r) OVER w >= 20 THEN avg(r) OVER w END AS mr, CASE WHEN count(m) OVER w >= 20 THEN avg(m) OVER w END AS mm FROM ret_m {W20}""")


@query("f8_ivol_20d", "pair_m", "SELECT date, stock_code, coalesce(CASE WHEN vr - c * c / CASE WHEN vm > 0 THEN vm END IS NOT NULL THEN sqrt(greatest(vr - c * c / CASE WHEN vm > 0 THEN vm END, 0)) END, 0.0) AS factor_value FROM pair_m", OUT)
def _(spark, sf_dir):
    p = proxy.panel(spark, sf_dir, "month")
    return O.ivol_20d(p, market(p))


@query("f9_downside_ivol_20d", "pair_m", f"""SELECT date, stock_code, stddev_samp(d) OVER w AS factor_value FROM (
  SELECT *, CASE WHEN r - (mr - b * mm) - b * m < 0 THEN r - (mr - b * mm) - b * m ELSE 0.0 END AS d FROM (SELECT *, c / CASE WHEN vm > 0 THEN vm END AS b FROM pair_m)) {W20} QUALIFY count(d) OVER w >= 20""", OUT)
def _(spark, sf_dir):
    p = proxy.panel(spark, sf_dir, "month")
    return O.downside_ivol_20d(p, market(p))


@query("f10_volume_price_divergence_20d", "ret_m", f"""SELECT * FROM (SELECT date, stock_code, CASE WHEN count(x) OVER w >= 20 THEN -(covar_samp(x, y) OVER w / nullif(stddev_samp(x) OVER w * stddev_samp(y) OVER w, 0)) END AS factor_value
  FROM (SELECT *, CASE WHEN turnover IS NOT NULL THEN r END AS x, CASE WHEN r IS NOT NULL THEN turnover END AS y FROM ret_m) {W20}) WHERE factor_value IS NOT NULL""", OUT)
def _(spark, sf_dir):
    return O.volume_price_divergence_20d(proxy.panel(spark, sf_dir, "month"))


@query("f0_factor_inputs", "reports", "SELECT * FROM reports", "date stock_code institute fiscal_year ~eps")
def _(spark, sf_dir):
    return O.clean_eps_reports(orders_feed(spark, sf_dir))


@query("f11_eps_revision_60d", "o", f"""SELECT * FROM (SELECT date, stock_code, eps / nullif({lag_sql('eps', 60)}, 0) - 1 AS factor_value FROM
  (SELECT date, stock_code, eps, dense_rank() OVER (ORDER BY date) - 1 AS pos FROM (SELECT date, stock_code, max(eps) AS eps FROM o GROUP BY ALL))) WHERE factor_value IS NOT NULL""", OUT)
def _(spark, sf_dir):
    return O.eps_revision_60d(orders_feed(spark, sf_dir).groupBy("date", "stock_code").agg(F.max("eps").alias("eps")))


@query("f12a_classify_revisions", "revisions", "SELECT * FROM revisions", "date stock_code institute fiscal_year up down")
def _(spark, sf_dir):
    return O.classify_revisions(O.clean_eps_reports(orders_feed(spark, sf_dir)))


ACTIVE = "SELECT c.date, stock_code, count(DISTINCT institute) AS n FROM actives a JOIN ocal c ON c.pos BETWEEN a.pos AND a.pos + 59 {where} GROUP BY ALL"


@query("f12b_rolling_distinct_active", "actives", ACTIVE.format(where="WHERE up"), "date stock_code n")
def _(spark, sf_dir):
    reports = O.clean_eps_reports(orders_feed(spark, sf_dir))
    return O.rolling_distinct_active(O.classify_revisions(reports).where("up"), revision_calendar(reports))


@query("f12c_eps_revision_breadth_60d", "actives", """SELECT * FROM (
  SELECT date, stock_code, (CASE WHEN eu THEN count(DISTINCT CASE WHEN up THEN institute END) END - CASE WHEN ed THEN count(DISTINCT CASE WHEN down THEN institute END) END) / count(DISTINCT institute) AS factor_value
  FROM (SELECT c.date, a.stock_code, institute, up, down, eu, ed FROM actives a JOIN ocal c ON c.pos BETWEEN a.pos AND a.pos + 59
        JOIN (SELECT stock_code, bool_or(up) AS eu, bool_or(down) AS ed FROM actives GROUP BY 1) e ON e.stock_code = a.stock_code) GROUP BY date, stock_code, eu, ed) WHERE factor_value IS NOT NULL""", OUT)
def _(spark, sf_dir):
    reports = O.clean_eps_reports(orders_feed(spark, sf_dir))
    return O.eps_revision_breadth_60d(reports, revision_calendar(reports))


@query("f13a_sue_events", "sues", "SELECT * FROM sues", "date stock_code ~surprise ~sue")
def _(spark, sf_dir):
    return O.sue_events(earnings(spark, sf_dir))


@query("f13b_sue_latest", "sues cal", """SELECT g.date, g.stock_code, s.sue AS factor_value FROM (SELECT date, stock_code FROM cal CROSS JOIN (SELECT DISTINCT stock_code FROM sues)) g
  ASOF JOIN (SELECT * FROM sues WHERE sue IS NOT NULL) s ON g.stock_code = s.stock_code AND g.date >= s.date""", OUT)
def _(spark, sf_dir):
    return O.sue_latest(earnings(spark, sf_dir), proxy.calendar(proxy.days(spark, sf_dir)))


@query("f_registry_build", "panel", f"""SELECT date, stock_code, 'rev_1d' AS factor, -(post_close / nullif({lag_sql('post_close', 1)}, 0) - 1) AS factor_value FROM panel QUALIFY factor_value IS NOT NULL
  UNION ALL SELECT date, stock_code, 'rev_5d', -(post_close / nullif({lag_sql('post_close', 5)}, 0) - 1) AS f FROM panel QUALIFY f IS NOT NULL""", "date stock_code factor ~factor_value")
def _(spark, sf_dir):
    return O.build(proxy.panel(spark, sf_dir), ["rev_1d", "rev_5d"])
