"""Queries S1 to S12, on rounded 5-week reversals and 1- and 5-week forward returns.

The proxy's returns are a fiftieth of its price changes, which are far wilder than real ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from crossgrain.operators import factor_stats as O
from crossgrain.operators import factors, labels
from crossgrain.plans.single_factor import Settings, single_factor
from crossgrain.queries.registry import part, query
from crossgrain.sources import proxy
from crossgrain.sources.layout import parts
from crossgrain.sources.scratch import materialize

Q = 5


def rank_sql(c: str, by: str) -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0)"


def corr_sql(x: str, y: str, least: int) -> str:
    return f"CASE WHEN count(*) >= {least} THEN covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0) END"


KEYS = "date, variant, win"
part("long", "v panel", """SELECT date, stock_code, variant, win, value, ret FROM (
  SELECT date, stock_code, v, round(-intra, 3) + 0.0 AS u, r1 / 50 AS r1, r5 / 50 AS r5 FROM v JOIN (SELECT date, stock_code, raw_close / nullif(raw_open, 0) - 1 AS intra,
    max(post_close) OVER (PARTITION BY stock_code ORDER BY pos RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) / nullif(post_close, 0) - 1 AS r1,
    max(post_close) OVER (PARTITION BY stock_code ORDER BY pos RANGE BETWEEN 5 FOLLOWING AND 5 FOLLOWING) / nullif(post_close, 0) - 1 AS r5 FROM panel) USING (date, stock_code))
  CROSS JOIN LATERAL (VALUES ('v', 1, v, r1), ('v', 5, v, r5), ('u', 1, u, r1), ('u', 5, u, r5)) AS t(variant, win, value, ret) WHERE value IS NOT NULL""")
part("ic", "long", f"""SELECT date, variant, win, ic, rank_ic, coalesce(n, 0) AS n FROM (SELECT DISTINCT {KEYS} FROM long) LEFT JOIN (
  SELECT {KEYS}, {corr_sql('value', 'ret', 3)} AS ic, {corr_sql('rv', 'rr', 3)} AS rank_ic, count(*) AS n FROM (
    SELECT *, {rank_sql('value', KEYS)} AS rv, {rank_sql('ret', KEYS)} AS rr FROM long WHERE ret IS NOT NULL) GROUP BY ALL) USING (date, variant, win)""")
part("grp", "long", f"""SELECT *, CASE WHEN n >= {Q} THEN CAST(greatest(1, ((r - 1) * {Q} + n - 2) // greatest(n - 1, 1)) AS INTEGER) END AS quantile FROM (
  SELECT *, count(*) OVER (PARTITION BY {KEYS}) AS n, row_number() OVER (PARTITION BY {KEYS} ORDER BY value, stock_code) AS r FROM long)""")
part("qd", "grp", f"SELECT {KEYS}, quantile, avg(ret) AS mean_return, count(*) AS n FROM grp WHERE quantile IS NOT NULL AND ret IS NOT NULL GROUP BY ALL")
part("nav", "qd", f"""SELECT *, exp(sum(ln(1 + coalesce(long_short, 0))) OVER (PARTITION BY variant ORDER BY date)) AS nav FROM (
  SELECT date, variant, max(CASE WHEN quantile = 1 THEN mean_return END) AS g1, max(CASE WHEN quantile = {Q} THEN mean_return END) AS gq, gq - g1 AS long_short FROM qd WHERE win = 1 GROUP BY date, variant)""")
part("mem", "grp", "SELECT date, variant, stock_code, value, quantile FROM grp WHERE win = 1 AND quantile IS NOT NULL")
part("memd", "mem", "SELECT variant, date, lag(date) OVER (PARTITION BY variant ORDER BY date) AS prev FROM (SELECT DISTINCT variant, date FROM mem)")
part("rturn", "mem memd", f"""SELECT date, variant, rank_turnover FROM memd LEFT JOIN (SELECT date, variant, 1 - {corr_sql('a', 'b', 3)} AS rank_turnover FROM (
  SELECT date, variant, {rank_sql('value', 'date, variant')} AS a, {rank_sql('before', 'date, variant')} AS b FROM (
    SELECT m.date, m.variant, m.value, p.value AS before FROM mem m JOIN memd d USING (variant, date) JOIN mem p ON p.variant = m.variant AND p.date = d.prev AND p.stock_code = m.stock_code)) GROUP BY ALL) USING (date, variant)""")
part("mturn", "mem memd", f"""SELECT date, variant, max(CASE WHEN quantile = {Q} THEN t END) AS top_turnover, max(CASE WHEN quantile = 1 THEN t END) AS bottom_turnover FROM (
  SELECT d.date, d.variant, q.quantile, 1 - (SELECT count(*) FROM mem m JOIN mem p ON p.variant = m.variant AND p.stock_code = m.stock_code AND p.quantile = m.quantile WHERE m.variant = d.variant AND m.date = d.date AND p.date = d.prev AND m.quantile = q.quantile)
    / nullif((SELECT count(*) FROM mem p WHERE p.variant = d.variant AND p.date = d.prev AND p.quantile = q.quantile), 0) AS t
  FROM memd d CROSS JOIN (VALUES (1), ({Q})) AS q(quantile)) GROUP BY ALL""")
part("turn", "rturn mturn", "SELECT * FROM rturn LEFT JOIN mturn USING (date, variant)")
part("yearly", "ic nav turn", """SELECT * FROM (SELECT CAST(year(date) AS INTEGER) AS year, variant, win, avg(rank_ic) AS mean_rank_ic, stddev_samp(rank_ic) AS std_rank_ic, avg(CASE WHEN round(rank_ic, 12) > 0 THEN 1.0 ELSE 0.0 END) AS ic_positive_ratio,
    count(rank_ic) AS n, avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) AS rank_icir FROM ic GROUP BY 1, 2, 3)
  LEFT JOIN (SELECT year, variant, 1 AS win, arg_max(ynav, date) - 1 AS long_short_return, avg(CASE WHEN round(long_short, 12) > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, min(ynav / top - 1) AS max_drawdown FROM (
    SELECT *, max(ynav) OVER (PARTITION BY variant, year ORDER BY date) AS top FROM (SELECT date, CAST(year(date) AS INTEGER) AS year, variant, long_short, exp(sum(ln(1 + coalesce(long_short, 0))) OVER (PARTITION BY variant, year(date) ORDER BY date)) AS ynav FROM nav)) GROUP BY year, variant) USING (year, variant, win)
  LEFT JOIN (SELECT CAST(year(date) AS INTEGER) AS year, variant, avg(rank_turnover) AS mean_rank_turnover, avg(top_turnover) AS mean_top_turnover, avg(bottom_turnover) AS mean_bottom_turnover FROM turn GROUP BY 1, 2) USING (year, variant)""")


def long(spark, sf_dir):
    """One pass over a stock's windows; then the sample goes by (date, variant, window), in as many parts as the files ask for."""
    p = proxy.panel(spark, sf_dir)
    v = (F.round(factors.reversal(5), 3) + 0.0).alias("v")
    u = (F.round(-F.expr("try_divide(raw_close, raw_open) - 1"), 3) + 0.0).alias("u")
    fwd = [(labels.forward_return(w) / 50).alias(f"return_{w}") for w in (1, 5)]
    rows = p.select("date", "stock_code", v, u, *fwd).where("v is not null")
    sample = O.long_sample(rows, ["v", "u"], (1, 5)).where("value is not null")
    return sample.repartition(parts(spark, proxy.panel_files(sf_dir)), "date", *O.SERIES)


def win(df):
    return df.withColumnRenamed("window", "win")


def quantile_rows(spark, sf_dir):
    return O.quantile_daily_returns(O.with_quantiles(long(spark, sf_dir), Q))


def members(spark, sf_dir):
    return O.with_quantiles(long(spark, sf_dir).where("window = 1"), Q).where("quantile is not null")


def turnover(spark, sf_dir):
    m = members(spark, sf_dir)
    return O.rank_turnover(m).join(O.membership_turnover(m, Q), ["date", "variant"], "left")


@query("s1_daily_ic", "ic", "SELECT * FROM ic", "date variant win ~ic ~rank_ic n")
def _(spark, sf_dir):
    return win(O.daily_ic(long(spark, sf_dir)))


@query("s2_cumulative_ic", "ic", "SELECT *, CASE WHEN ic IS NOT NULL THEN sum(ic) OVER w END AS cumulative_ic, CASE WHEN rank_ic IS NOT NULL THEN sum(rank_ic) OVER w END AS cumulative_rank_ic FROM ic WINDOW w AS (PARTITION BY variant, win ORDER BY date)", "date variant win ~cumulative_ic ~cumulative_rank_ic")
def _(spark, sf_dir):
    return win(O.cumulative_ic(O.daily_ic(long(spark, sf_dir)))).select("date", "variant", "win", "cumulative_ic", "cumulative_rank_ic")


@query("s3_ic_summary", "ic", " UNION ALL ".join(f"SELECT variant, win, '{c}' AS metric, avg({c}) AS mean, stddev_samp({c}) AS std, avg({c}) / nullif(stddev_samp({c}), 0) AS icir, avg({c}) / nullif(stddev_samp({c}), 0) * sqrt(252) AS annual_icir, avg(CASE WHEN round({c}, 12) > 0 THEN 1.0 ELSE 0.0 END) AS positive_ratio, count({c}) AS n FROM ic WHERE {c} IS NOT NULL GROUP BY variant, win" for c in ("ic", "rank_ic")), "variant win metric ~mean ~std ~icir ~annual_icir ~positive_ratio n")
def _(spark, sf_dir):
    return win(O.ic_summary(O.daily_ic(long(spark, sf_dir))))


@query("s4_quantile_daily_returns", "qd", "SELECT * FROM qd", "date variant win quantile ~mean_return n")
def _(spark, sf_dir):
    return win(quantile_rows(spark, sf_dir))


@query("s5_quantile_summary", "qd", f"""SELECT variant, win, {corr_sql('g', 'm', 2)} AS monotonicity, arg_max(mean_return, quantile) AS top, arg_min(mean_return, quantile) AS bottom, arg_max(mean_return, quantile) - arg_min(mean_return, quantile) AS spread FROM (
  SELECT *, {rank_sql('quantile', 'variant, win')} AS g, {rank_sql('round(mean_return, 12)', 'variant, win')} AS m FROM (SELECT variant, win, quantile, avg(mean_return) AS mean_return FROM qd GROUP BY ALL)) GROUP BY variant, win""", "variant win ~monotonicity ~top ~bottom ~spread")
def _(spark, sf_dir):
    return win(O.quantile_summary(quantile_rows(spark, sf_dir)))


@query("s6_long_short_nav", "nav", "SELECT * FROM nav", "date variant ~g1 ~gq ~long_short ~nav")
def _(spark, sf_dir):
    return O.long_short_nav(quantile_rows(spark, sf_dir), Q)


@query("s7_rank_turnover", "rturn", "SELECT * FROM rturn", "date variant ~rank_turnover")
def _(spark, sf_dir):
    return O.rank_turnover(members(spark, sf_dir))


@query("s8_membership_turnover", "mturn", "SELECT * FROM mturn", "date variant ~top_turnover ~bottom_turnover")
def _(spark, sf_dir):
    return O.membership_turnover(members(spark, sf_dir), Q)


@query("s9_yearly_performance", "yearly", "SELECT * FROM yearly", "year variant win ~mean_rank_ic ~std_rank_ic ~ic_positive_ratio n ~rank_icir ~long_short_return ~win_rate ~max_drawdown ~mean_rank_turnover ~mean_top_turnover ~mean_bottom_turnover")
def _(spark, sf_dir):
    rows = materialize(long(spark, sf_dir), "long")
    daily = O.quantile_daily_returns(O.with_quantiles(rows, Q))
    m = O.with_quantiles(rows.where("window = 1"), Q).where("quantile is not null")
    turned = O.rank_turnover(m).join(O.membership_turnover(m, Q), ["date", "variant"], "left")
    return win(O.yearly_performance(O.daily_ic(rows), O.long_short_nav(daily, Q), turned))


@query("s10_max_drawdown", "nav", "SELECT variant, min(nav / top - 1) AS max_drawdown FROM (SELECT *, max(nav) OVER (PARTITION BY variant ORDER BY date) AS top FROM nav) GROUP BY variant", "variant ~max_drawdown")
def _(spark, sf_dir):
    return O.max_drawdown(O.long_short_nav(quantile_rows(spark, sf_dir), Q))


@query("s11_rolling_rank_ic", "ic", "SELECT date, variant, win, CASE WHEN count(rank_ic) OVER w >= 10 THEN avg(rank_ic) OVER w END AS rolling_rank_ic FROM ic WINDOW w AS (PARTITION BY variant, win ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)", "date variant win ~rolling_rank_ic")
def _(spark, sf_dir):
    return win(O.rolling_mean(O.daily_ic(long(spark, sf_dir)), "rank_ic", O.SERIES)).select("date", "variant", "win", "rolling_rank_ic")


@query("s11_rolling_turnover", "rturn", "SELECT date, variant, CASE WHEN count(rank_turnover) OVER w >= 10 THEN avg(rank_turnover) OVER w END AS rolling_rank_turnover FROM rturn WINDOW w AS (PARTITION BY variant ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)", "date variant ~rolling_rank_turnover")
def _(spark, sf_dir):
    return O.rolling_mean(O.rank_turnover(members(spark, sf_dir)), "rank_turnover", ["variant"]).select("date", "variant", "rolling_rank_turnover")


@query("s11_quantile_means", "qd", "SELECT variant, win, quantile, avg(mean_return) AS mean_return, count(*) AS n FROM qd GROUP BY ALL", "variant win quantile ~mean_return n")
def _(spark, sf_dir):
    return win(O.quantile_means(quantile_rows(spark, sf_dir)))


@query("s11_yearly_pivot", "ic", "SELECT CAST(year(date) AS INTEGER) AS year, variant, avg(rank_ic) FILTER (WHERE win = 1) AS w1, avg(rank_ic) FILTER (WHERE win = 5) AS w5 FROM ic GROUP BY 1, 2", "year variant ~w1 ~w5")
def _(spark, sf_dir):
    yearly = O.daily_ic(long(spark, sf_dir)).groupBy(F.year("date").alias("year"), *O.SERIES).agg(F.avg("rank_ic").alias("mean_rank_ic"))
    return O.yearly_pivot(yearly, "mean_rank_ic", [1, 5]).withColumnsRenamed({"1": "w1", "5": "w5"})


@query("s11_last_nav", "nav", "SELECT variant, arg_max(nav, date) AS last_nav FROM nav GROUP BY variant", "variant ~last_nav")
def _(spark, sf_dir):
    return O.last_nav(O.long_short_nav(quantile_rows(spark, sf_dir), Q))


#: The flagship as SQL: eligibility, winsorising, standardising, neutralising, then summaries of both variants.
part("sfs", "eligible v", """SELECT e.date, e.stock_code, e.industry, e.market_cap, v FROM eligible e JOIN v USING (date, stock_code) WHERE eligible""")
part("sfz", "sfs", """SELECT *, (w - avg(w) OVER d) / nullif(stddev_samp(w) OVER d, 0) AS z FROM (SELECT *, CASE WHEN mad > 0 THEN greatest(least(v, med + mad * (5.0 * 1.4826)), med - mad * (5.0 * 1.4826)) ELSE v END AS w FROM (
  SELECT *, median(abs(v - med)) OVER (PARTITION BY date) AS mad FROM (SELECT *, median(v) OVER (PARTITION BY date) AS med FROM sfs))) WINDOW d AS (PARTITION BY date)""")
part("sfn", "sfz fwd", """SELECT date, stock_code, z, (e - avg(e) OVER d) / nullif(stddev_samp(e) OVER d, 0) AS neutral, return_1, return_5 FROM (
  SELECT *, CASE WHEN ok AND count(y) OVER d >= 5 AND count(y) OVER d > kk + 1 AND sum(xd * xd) OVER d > 1e-12 THEN yd - (sum(xd * yd) OVER d / nullif(sum(xd * xd) OVER d, 0)) * xd END AS e FROM (
    SELECT *, y - avg(y) OVER c AS yd, x - avg(x) OVER c AS xd, count(DISTINCT CASE WHEN ok THEN industry END) OVER (PARTITION BY date) AS kk FROM (
      SELECT *, CASE WHEN ok THEN z END AS y, CASE WHEN ok THEN ln(market_cap) END AS x FROM (SELECT *, coalesce(z IS NOT NULL AND market_cap > 0, FALSE) AS ok FROM sfz))
    WINDOW c AS (PARTITION BY date, industry)) WINDOW d AS (PARTITION BY date)) LEFT JOIN fwd USING (date, stock_code) WINDOW d AS (PARTITION BY date)""")


@query("s12_single_factor_run", "sfn", f"""SELECT variant, CAST(win AS INTEGER) AS win, avg(ic) AS mean, stddev_samp(ic) AS std, avg(ic) / nullif(stddev_samp(ic), 0) AS icir, avg(CASE WHEN round(ic, 12) > 0 THEN 1.0 ELSE 0.0 END) AS positive_ratio, count(ic) AS n FROM (
  SELECT date, variant, win, {corr_sql('value', 'ret', 3)} AS ic FROM (SELECT date, variant, win, value, ret FROM sfn CROSS JOIN LATERAL (VALUES ('standardized', 1, z, return_1), ('standardized', 5, z, return_5), ('neutralized', 1, neutral, return_1), ('neutralized', 5, neutral, return_5)) AS t(variant, win, value, ret)
    WHERE value IS NOT NULL AND ret IS NOT NULL) GROUP BY ALL) WHERE ic IS NOT NULL GROUP BY variant, win""", "variant win ~mean ~std ~icir ~positive_ratio n")
def _(spark, sf_dir):
    p = proxy.panel(spark, sf_dir)
    factor = p.select("date", "stock_code", (F.round(factors.reversal(5), 3) + 0.0).alias("factor_value")).where("factor_value is not null")
    run = single_factor(p, factor, Settings(windows=(1, 5), min_listing_days=20))
    return win(run.ic_summary.where("metric = 'ic'")).select("variant", "win", "mean", "std", "icir", "positive_ratio", "n")
