"""Queries X1 to X13 and D3."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossgrain.operators import cross_section as O
from crossgrain.operators import factors
from crossgrain.queries.registry import part, query
from crossgrain.sources import proxy
from crossgrain.sources.layout import parts

# Values are rounded before anything is ranked, so that engines can't differ on ties.
part("v", "panel", """SELECT * FROM (SELECT date, pos, stock_code, k, industry, market_cap, round(-(post_close / nullif(max(post_close) OVER (PARTITION BY stock_code ORDER BY pos RANGE BETWEEN 5 PRECEDING AND 5 PRECEDING), 0) - 1), 3) + 0.0 AS v
  FROM panel WHERE in_universe OR TRUE) WHERE v IS NOT NULL""")
part("wins", "v", """SELECT *, CASE WHEN mad > 0 THEN greatest(least(v, med + mad * (2.0 * 1.4826)), med - mad * (2.0 * 1.4826)) ELSE v END AS w FROM (
  SELECT *, median(abs(v - med)) OVER (PARTITION BY date) AS mad FROM (SELECT *, median(v) OVER (PARTITION BY date) AS med FROM v))""")
part("z", "wins", "SELECT *, (w - avg(w) OVER d) / nullif(stddev_samp(w) OVER d, 0) AS z FROM wins WINDOW d AS (PARTITION BY date)")
part("neu", "z", """SELECT date, stock_code, e, (e - avg(e) OVER d) / nullif(stddev_samp(e) OVER d, 0) AS neutral FROM (
  SELECT *, CASE WHEN ok AND count(y) OVER d >= 5 AND count(y) OVER d > kk + 1 AND sum(xd * xd) OVER d > 1e-12 THEN yd - (sum(xd * yd) OVER d / nullif(sum(xd * xd) OVER d, 0)) * xd END AS e FROM (
    SELECT *, y - avg(y) OVER c AS yd, x - avg(x) OVER c AS xd, count(DISTINCT CASE WHEN ok THEN industry END) OVER (PARTITION BY date) AS kk FROM (
      SELECT *, ok, CASE WHEN ok THEN z END AS y, CASE WHEN ok THEN ln(market_cap) END AS x FROM (SELECT *, coalesce(z IS NOT NULL AND market_cap > 0, FALSE) AS ok FROM z))
    WINDOW c AS (PARTITION BY date, industry)) WINDOW d AS (PARTITION BY date)) WINDOW d AS (PARTITION BY date)""")


def values(spark, sf_dir):
    p = proxy.panel(spark, sf_dir)
    v = (F.round(factors.reversal(5), 3) + 0.0).alias("v")
    return p.select("date", "pos", "stock_code", "k", "industry", "market_cap", v).where("v is not null")


def dated(spark, sf_dir):
    """`values` by date, in as many parts as the files ask for: ranks of a date are taken there."""
    return values(spark, sf_dir).select("date", "stock_code", "v").repartition(parts(spark, proxy.panel_files(sf_dir)), "date")


def standardised(spark, sf_dir):
    return O.mad_winsorize(values(spark, sf_dir), "v", "w", 2.0).withColumn("z", O.zscore("w"))


@query("x1_mad_winsorize", "wins", "SELECT * FROM wins", "date stock_code ~w")
def _(spark, sf_dir):
    return O.mad_winsorize(values(spark, sf_dir), "v", "w", 2.0).select("date", "stock_code", "w")


@query("x2_zscore", "z", "SELECT * FROM z", "date stock_code ~z")
def _(spark, sf_dir):
    return standardised(spark, sf_dir).select("date", "stock_code", "z")


@query("x3_neutralize", "neu", "SELECT * FROM neu", "date stock_code ~neutral")
def _(spark, sf_dir):
    return O.neutralize(standardised(spark, sf_dir), "z", "neutral").select("date", "stock_code", "neutral")


part("wide2", "panel", "SELECT date, stock_code, market_cap, industry, post_close / nullif(post_open, 0) - 1 AS a, turnover AS b FROM panel")


def pop_sql(c: str) -> str:
    return f"coalesce(CASE WHEN count(c{c}) OVER d >= 2 THEN (c{c} - avg(c{c}) OVER d) / nullif(stddev_pop(c{c}) OVER d, 0) END, 0.0) AS {c}, CAST({c} IS NULL AS INTEGER) AS {c}__missing"


@query("x4_cross_section_transform", "wide2", f"""SELECT date, stock_code, {pop_sql('a').replace('AS a,', 'AS ta,')}, {pop_sql('b').replace('AS b,', 'AS tb,')} FROM (
  SELECT *, CASE WHEN da > 0 AND a IS NOT NULL THEN greatest(least(a, ma + da * (3.0 * 1.4826)), ma - da * (3.0 * 1.4826)) ELSE a END AS ca, CASE WHEN db > 0 AND b IS NOT NULL THEN greatest(least(b, mb + db * (3.0 * 1.4826)), mb - db * (3.0 * 1.4826)) ELSE b END AS cb FROM (
    SELECT *, median(abs(a - ma)) OVER d AS da, median(abs(b - mb)) OVER d AS db FROM (SELECT *, median(a) OVER d AS ma, median(b) OVER d AS mb FROM wide2 WINDOW d AS (PARTITION BY date)) WINDOW d AS (PARTITION BY date)))
  WINDOW d AS (PARTITION BY date)""", "date stock_code ~ta ~tb a__missing b__missing")
def _(spark, sf_dir):
    p = proxy.panel(spark, sf_dir)
    wide = p.select("date", "stock_code", F.expr("try_divide(post_close, post_open) - 1").alias("a"), F.col("turnover").alias("b"))
    return O.cross_section_transform(wide, ["a", "b"], 3.0).withColumnsRenamed({"a": "ta", "b": "tb"})


@query("x5_log_cap_impute", "panel", """SELECT date, stock_code, coalesce(l, median(l) OVER (PARTITION BY date), 0.0) AS log_market_cap, CAST(l IS NULL AS INTEGER) AS log_market_cap__missing
  FROM (SELECT *, CASE WHEN market_cap > 0 THEN ln(1 + market_cap) END AS l FROM panel)""", "date stock_code ~log_market_cap log_market_cap__missing")
def _(spark, sf_dir):
    return O.log_cap_impute(proxy.panel(spark, sf_dir)).select("date", "stock_code", "log_market_cap", "log_market_cap__missing")


@query("x6_fill_missing_flags", "panel", "SELECT date, stock_code, coalesce(post_close, 0.0) AS post_close, coalesce(turnover, 0.0) AS turnover, CAST(post_close IS NULL AS INTEGER) AS post_close__missing, CAST(turnover IS NULL AS INTEGER) AS turnover__missing FROM panel", "date stock_code ~post_close ~turnover post_close__missing turnover__missing")
def _(spark, sf_dir):
    return O.fill_missing_flags(proxy.panel(spark, sf_dir).select("date", "stock_code", "post_close", "turnover"), ["post_close", "turnover"])


@query("x7_standard_scale", "wide2", "SELECT date, stock_code, (a - (SELECT avg(a) FROM wide2 WHERE date < DATE '1999-01-01')) / (SELECT stddev_pop(a) FROM wide2 WHERE date < DATE '1999-01-01') AS a, (b - (SELECT avg(b) FROM wide2 WHERE date < DATE '1999-01-01')) / (SELECT stddev_pop(b) FROM wide2 WHERE date < DATE '1999-01-01') AS b FROM wide2", "date stock_code ~a ~b")
def _(spark, sf_dir):
    wide = proxy.panel(spark, sf_dir).select("date", "stock_code", F.expr("try_divide(post_close, post_open) - 1").alias("a"), F.col("turnover").alias("b"))
    return O.standard_scale(wide, O.fit_scale(wide.where("date < date '1999-01-01'"), ["a", "b"]))


@query("x8_industry_one_hot", "panel", "SELECT date, stock_code, CAST(industry = 'ASIA' AS INTEGER) AS industry_ASIA, CAST(industry = 'EUROPE' AS INTEGER) AS industry_EUROPE, CAST(industry NOT IN ('ASIA', 'EUROPE') AS INTEGER) AS industry_UNKNOWN FROM panel", "date stock_code industry_ASIA industry_EUROPE industry_UNKNOWN")
def _(spark, sf_dir):
    p = proxy.panel(spark, sf_dir).select("date", "stock_code", "industry")
    return O.industry_one_hot(p, O.fit_industries(p.where("industry in ('ASIA', 'EUROPE')"))).drop("industry")


@query("x9_equal_date_weights", "prices", "SELECT date, stock_code, 1.0 / count(*) OVER (PARTITION BY date) AS weight FROM prices", "date stock_code ~weight")
def _(spark, sf_dir):
    return proxy.prices(spark, sf_dir).select("date", "stock_code", O.equal_date_weights().alias("weight"))


QUANTILE_SQL = "CASE WHEN n >= {q} THEN CAST(greatest(1, ((r - 1) * {q} + n - 2) // greatest(n - 1, 1)) AS INTEGER) END"


@query("x10_assign_quantiles", "v", f"SELECT date, stock_code, {QUANTILE_SQL.format(q=5)} AS q5, {QUANTILE_SQL.format(q=10)} AS q10 FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY v, stock_code) AS r FROM v)", "date stock_code q5 q10")
def _(spark, sf_dir):
    return dated(spark, sf_dir).select("date", "stock_code", O.assign_quantiles("v", 5).alias("q5"), O.assign_quantiles("v", 10).alias("q10"))


@query("x11_score_deciles", "v", "SELECT date, stock_code, CAST((row_number() OVER (PARTITION BY date ORDER BY v DESC, stock_code) - 1) * 10 // count(*) OVER (PARTITION BY date) + 1 AS INTEGER) AS decile FROM v", "date stock_code decile")
def _(spark, sf_dir):
    return dated(spark, sf_dir).select("date", "stock_code", O.score_deciles("v").alias("decile"))


@query("x12_top_k", "v", """SELECT 'top' AS side, date, stock_code, CAST(row_number() OVER (PARTITION BY date ORDER BY v DESC, stock_code) AS INTEGER) AS cohort_rank FROM v QUALIFY cohort_rank <= 10
  UNION ALL SELECT 'bottom', date, stock_code, CAST(row_number() OVER (PARTITION BY date ORDER BY v, stock_code) AS INTEGER) AS r FROM v QUALIFY r <= 10""", "side date stock_code cohort_rank")
def _(spark, sf_dir):
    v = values(spark, sf_dir)
    top, bottom = O.top_k(v, "v", 10).withColumn("side", F.lit("top")), O.top_k(v, "v", 10, lowest=True).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom).select("side", "date", "stock_code", "cohort_rank")


RANK_SQL = "(rank() OVER (PARTITION BY date ORDER BY v {d}) + (count(*) OVER (PARTITION BY date, v) - 1) / 2.0)"


@query("x13_relevance", "v", f"SELECT date, stock_code, CAST(greatest(0, least(99, floor(100 * (({RANK_SQL.format(d='')} - 1) / nullif(count(*) OVER (PARTITION BY date) - 1, 0))))) AS INTEGER) AS relevance FROM v", "date stock_code relevance")
def _(spark, sf_dir):
    from crossgrain.functions.columns import rank_percentile

    x = dated(spark, sf_dir).withColumn("r", rank_percentile("v", "date"))
    return x.select("date", "stock_code", O.relevance("r").alias("relevance"))


@query("d3_true_deciles", "v", f"SELECT date, stock_code, CAST(least(10, ceil(10 * {RANK_SQL.format(d='DESC')} / count(*) OVER (PARTITION BY date))) AS INTEGER) AS decile FROM v", "date stock_code decile")
def _(spark, sf_dir):
    return dated(spark, sf_dir).select("date", "stock_code", O.true_deciles("v").alias("decile"))
