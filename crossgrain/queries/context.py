"""Queries K1 to K9."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossgrain.operators import context as O
from crossgrain.operators.calendar import calendar_index
from crossgrain.queries.registry import part, query
from crossgrain.sources import proxy
from crossgrain.sources.layout import parts

part("kr", "panel", """SELECT *, CASE WHEN market_cap > 0 THEN market_cap END AS cap, CASE WHEN post_close > 0 AND lag(post_close) OVER w > 0 THEN post_close / lag(post_close) OVER w - 1 END AS daily_return
  FROM panel WINDOW w AS (PARTITION BY stock_code ORDER BY date)""")


def share(hit: str, among: str) -> str:
    return f"avg(CASE WHEN coalesce({among}, FALSE) THEN CASE WHEN coalesce({hit}, FALSE) THEN 1.0 ELSE 0.0 END END)"


OK = "coalesce(covered >= 0.95, FALSE) AND cap_return IS NOT NULL"
part("km", "kr", f"""SELECT * EXCLUDE (cap_return, covered), CASE WHEN {OK} THEN cap_return ELSE market_equal_return END AS market_cap_return, CAST(NOT ({OK}) AS INTEGER) AS market_cap_return_fallback FROM (
  SELECT date, avg(daily_return) AS market_equal_return, avg(CASE WHEN daily_return > 0 THEN 1.0 WHEN daily_return IS NOT NULL THEN 0.0 END) AS market_up_ratio, stddev_pop(daily_return) AS market_return_std,
  quantile_cont(daily_return, 0.1) AS market_return_q10, quantile_cont(daily_return, 0.5) AS market_return_q50, quantile_cont(daily_return, 0.9) AS market_return_q90,
  {share('raw_close >= limit_up - 1e-8', 'limit_up > 0 AND raw_close IS NOT NULL')} AS market_limit_up_ratio, {share('raw_close <= limit_down + 1e-8', 'limit_down > 0 AND raw_close IS NOT NULL')} AS market_limit_down_ratio,
  avg(CASE WHEN is_suspended THEN 1.0 ELSE 0.0 END) AS market_suspended_ratio, avg(CASE WHEN is_st THEN 1.0 ELSE 0.0 END) AS market_st_ratio, avg(ln(cap)) AS market_log_cap_mean, median(ln(cap)) AS market_log_cap_median, stddev_pop(ln(cap)) AS market_log_cap_std,
  avg(CASE WHEN daily_return IS NOT NULL THEN 1.0 ELSE 0.0 END) AS market_return_coverage, avg(CASE WHEN cap IS NOT NULL THEN 1.0 ELSE 0.0 END) AS market_cap_coverage,
  sum(CASE WHEN daily_return IS NOT NULL THEN cap * daily_return END) / nullif(sum(CASE WHEN daily_return IS NOT NULL THEN cap END), 0) AS cap_return, sum(CASE WHEN daily_return IS NOT NULL THEN cap END) / nullif(sum(cap), 0) AS covered
  FROM kr WHERE in_universe GROUP BY date)""")
RAW = "CASE WHEN k % 9 = 0 THEN ' unknown' ELSE industry END"
NORMAL = f"CASE WHEN k % 9 = 0 THEN 'UNKNOWN' ELSE industry END"
part("ki", "kr", f"""SELECT * EXCLUDE (c), c / nullif(sum(c) OVER (PARTITION BY date), 0) AS industry_cap_share FROM (
  SELECT date, {NORMAL} AS industry, avg(daily_return) AS industry_equal_return, avg(CASE WHEN daily_return > 0 THEN 1.0 WHEN daily_return IS NOT NULL THEN 0.0 END) AS industry_up_ratio, stddev_pop(daily_return) AS industry_return_std,
  quantile_cont(daily_return, 0.9) - quantile_cont(daily_return, 0.1) AS industry_return_range, count(*) AS industry_count, median(ln(cap)) AS industry_log_cap_median, sum(cap) AS c,
  avg(CASE WHEN is_suspended THEN 1.0 ELSE 0.0 END) AS industry_suspended_ratio, avg(CASE WHEN daily_return IS NOT NULL THEN 1.0 ELSE 0.0 END) AS industry_return_coverage
  FROM kr WHERE in_universe AND {NORMAL} <> 'UNKNOWN' GROUP BY 1, 2)""")


def product(c: str, window: int, over: str) -> str:
    return f"CASE WHEN count({c}) OVER w >= {window} THEN list_product(list(1 + {c}) OVER w) - 1 END"


part("kx", "ki km", f"""SELECT i.date, i.industry, i.x - m.x AS industry_excess_5 FROM (SELECT date, industry, {product('industry_equal_return', 5, 'w')} AS x FROM ki WINDOW w AS (PARTITION BY industry ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) i
  JOIN (SELECT date, {product('market_equal_return', 5, 'w')} AS x FROM km WINDOW w AS (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) m USING (date)""")
MARKET = "market_equal_return market_up_ratio market_return_std market_return_q10 market_return_q50 market_return_q90 market_limit_up_ratio market_limit_down_ratio market_suspended_ratio market_st_ratio market_log_cap_mean market_log_cap_median market_log_cap_std market_return_coverage market_cap_coverage market_cap_return".split()
INDUSTRY = "industry_equal_return industry_up_ratio industry_return_std industry_return_range industry_log_cap_median industry_suspended_ratio industry_return_coverage industry_cap_share".split()


def panel(spark, sf_dir):
    p = O.daily_return_valid(proxy.panel(spark, sf_dir))
    return p.withColumn("industry", F.expr(RAW))


@query("k1_daily_return_valid", "kr", "SELECT * FROM kr", "date stock_code ~daily_return")
def _(spark, sf_dir):
    return panel(spark, sf_dir).select("date", "stock_code", "daily_return")


@query("k2_k3_market_daily", "km", "SELECT * FROM km", "date " + " ".join(f"~{c}" for c in MARKET) + " market_cap_return_fallback")
def _(spark, sf_dir):
    return O.market_daily(panel(spark, sf_dir))


@query("k4_industry_daily", "ki", "SELECT * FROM ki", "date industry industry_count " + " ".join(f"~{c}" for c in INDUSTRY))
def _(spark, sf_dir):
    return O.industry_daily(panel(spark, sf_dir))


@query("k5_compound_return", "km", f"SELECT date, {product('market_equal_return', 5, 'w')} AS market_return_5 FROM km WINDOW w AS (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", "date ~market_return_5")
def _(spark, sf_dir):
    return O.compound_return(O.market_daily(panel(spark, sf_dir)), "market_equal_return", 5, [], "market_return_5").select("date", "market_return_5")


@query("k6_calendar_reindex", "ki cal", "SELECT date, industry, industry_equal_return FROM cal CROSS JOIN (SELECT DISTINCT industry FROM ki) LEFT JOIN (SELECT * FROM ki WHERE industry_count > 12) USING (date, industry)", "date industry ~industry_equal_return")
def _(spark, sf_dir):
    p = panel(spark, sf_dir)
    rows = O.industry_daily(p)
    full = O.calendar_reindex(rows, calendar_index(p), ["industry"])
    return full.select("date", "industry", F.when(F.col("industry_count") > 12, F.col("industry_equal_return")).alias("industry_equal_return"))


@query("k7_industry_excess", "kx", "SELECT * FROM kx", "date industry ~industry_excess_5")
def _(spark, sf_dir):
    p = panel(spark, sf_dir)
    return O.industry_excess(O.industry_daily(p), O.market_daily(p), 5)


part("kj", "kr km ki", f"""SELECT p.date, p.stock_code, p.industry, coalesce(market_equal_return, 0.0) AS market_equal_return, coalesce(industry_equal_return, 0.0) AS industry_equal_return,
  CAST(market_equal_return IS NULL AS INTEGER) AS market_equal_return__missing, CAST(industry_equal_return IS NULL AS INTEGER) AS industry_equal_return__missing
  FROM (SELECT date, stock_code, {NORMAL} AS industry FROM kr) p LEFT JOIN km USING (date) LEFT JOIN ki ON ki.date = p.date AND ki.industry = p.industry""")


@query("k8_context_join", "kj", "SELECT * FROM kj", "date stock_code industry ~market_equal_return ~industry_equal_return market_equal_return__missing industry_equal_return__missing")
def _(spark, sf_dir):
    p = panel(spark, sf_dir)
    rows = p.select("date", "stock_code", "industry")
    return O.context_join(rows, O.market_daily(p), O.industry_daily(p), ["market_equal_return"], ["industry_equal_return"])


@query("k9_feature_frame", "kj kr", """SELECT j.*, coalesce(CASE WHEN count(c) OVER d >= 2 THEN (c - avg(c) OVER d) / nullif(stddev_pop(c) OVER d, 0) END, 0.0) AS turnover, CAST(c IS NULL AS INTEGER) AS turnover__missing,
  coalesce(l, median(l) OVER d, 0.0) AS log_market_cap, CAST(l IS NULL AS INTEGER) AS log_market_cap__missing FROM kj j JOIN (
    SELECT date, stock_code, CASE WHEN mad > 0 AND turnover IS NOT NULL THEN greatest(least(turnover, med + mad * (5.0 * 1.4826)), med - mad * (5.0 * 1.4826)) ELSE turnover END AS c, CASE WHEN market_cap > 0 THEN ln(1 + market_cap) END AS l FROM (
      SELECT *, median(abs(turnover - med)) OVER (PARTITION BY date) AS mad FROM (SELECT *, median(turnover) OVER (PARTITION BY date) AS med FROM kr))) x USING (date, stock_code) WINDOW d AS (PARTITION BY date)""",
       "date stock_code industry ~turnover ~log_market_cap ~market_equal_return ~industry_equal_return turnover__missing log_market_cap__missing market_equal_return__missing industry_equal_return__missing")
def _(spark, sf_dir):
    p = panel(spark, sf_dir)
    rows = p.select("date", "stock_code", "industry", "market_cap", "turnover").repartition(parts(spark, proxy.panel_files(sf_dir)), "date")
    return O.feature_frame(rows, ["turnover"], O.market_daily(p), O.industry_daily(p), ["market_equal_return"], ["industry_equal_return"])
