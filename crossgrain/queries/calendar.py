"""Queries B1 to B12."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossgrain.functions.columns import by_day
from crossgrain.operators import calendar as O
from crossgrain.queries.registry import part, query
from crossgrain.sources import proxy


def cal(spark, sf_dir):
    return O.calendar_index(proxy.days(spark, sf_dir))


def snapshots(panel):
    """The first calendar date of each quarter with its members, as index providers publish them."""
    first = panel.groupBy(F.date_trunc("quarter", "date").alias("quarter")).agg(F.min("date").alias("date"))
    return panel.join(by_day(first.select("date")), "date").where("in_universe").select(F.col("date").alias("snapshot_date"), "stock_code")


part("snaps", "panel", "SELECT date AS snapshot_date, stock_code FROM panel WHERE in_universe AND date IN (SELECT min(date) FROM panel GROUP BY date_trunc('quarter', date))")
part("uni", "snaps cal", """SELECT c.date, s.stock_code FROM (SELECT date, d AS snapshot_date FROM cal ASOF JOIN (SELECT DISTINCT snapshot_date AS d FROM snaps) ON date >= d) c
  JOIN snaps s USING (snapshot_date)""")


@query("b1_calendar_index", "cal", "SELECT * FROM cal", "date pos")
def _(spark, sf_dir):
    return cal(spark, sf_dir)


@query("b2_universe_asof", "uni", "SELECT * FROM uni", "date stock_code")
def _(spark, sf_dir):
    p = proxy.panel(spark, sf_dir)
    return O.universe_asof(O.calendar_index(p), snapshots(p))


@query("b2b_price_join", "prices", "SELECT date, stock_code, open AS raw_open, close AS raw_close, CASE WHEN k % 3 > 0 THEN close * 0.5 END AS post_close FROM prices", "date stock_code ~raw_open ~raw_close ~post_close")
def _(spark, sf_dir):
    p = proxy.prices(spark, sf_dir)
    raw = p.select("date", "stock_code", F.col("open").alias("raw_open"), F.col("close").alias("raw_close"))
    return O.price_join(raw, p.where("k % 3 > 0").select("date", "stock_code", (F.col("close") * 0.5).alias("post_close")))


@query("b3_listing_days", "prices cal", """SELECT date, stock_code, CASE WHEN listed IS NOT NULL THEN greatest(0, pos - (SELECT count(*) FROM cal c WHERE c.date < listed) + 1) END AS listing_days
  FROM (SELECT *, CASE WHEN k % 7 > 0 THEN DATE '1995-01-02' + CAST(k * 9 AS INTEGER) END AS listed FROM prices)""", "date stock_code listing_days")
def _(spark, sf_dir):
    p = proxy.prices(spark, sf_dir).drop("pos")
    listed = F.when(F.col("k") % 7 > 0, F.date_add(F.lit("1995-01-02").cast("date"), (F.col("k") * 9).cast("int")))
    return O.listing_days(p.withColumn("listed_date", listed), O.calendar_index(p)).select("date", "stock_code", "listing_days")


@query("b4_status_merge", "panel", "SELECT date, stock_code, coalesce(CASE WHEN k % 3 > 0 THEN is_st END, TRUE) AS is_st, coalesce(CASE WHEN k % 4 > 0 THEN is_suspended END, TRUE) AS is_suspended FROM panel WHERE k % 3 > 0 OR k % 4 > 0", "date stock_code is_st is_suspended")
def _(spark, sf_dir):
    p = proxy.panel(spark, sf_dir)
    return O.status_merge(p.where("k % 3 > 0").select("date", "stock_code", "is_st"), p.where("k % 4 > 0").select("date", "stock_code", "is_suspended"))


@query("b5_exposure_join", "uni panel", "SELECT date, stock_code, coalesce(CASE WHEN k % 5 > 0 THEN industry END, 'Unknown') AS industry, CASE WHEN k % 6 > 0 THEN market_cap END AS market_cap FROM uni JOIN panel USING (date, stock_code)", "date stock_code industry ~market_cap")
def _(spark, sf_dir):
    p = proxy.panel(spark, sf_dir)
    universe = O.universe_asof(O.calendar_index(p), snapshots(p))
    return O.exposure_join(universe, p.where("k % 5 > 0").select("date", "stock_code", "industry"), p.where("k % 6 > 0").select("date", "stock_code", "market_cap"))


@query("b6_panel_skeleton", "panel uni", """SELECT p.date, p.stock_code, raw_open, raw_close, coalesce(CASE WHEN k % 4 > 0 THEN is_st END, TRUE) AS is_st, coalesce(CASE WHEN k % 4 > 0 THEN is_suspended END, TRUE) AS is_suspended,
  has_price_record, k % 4 > 0 AS has_status_record, u.date IS NOT NULL AS in_universe FROM panel p LEFT JOIN uni u ON p.date = u.date AND p.stock_code = u.stock_code
  WHERE p.stock_code IN (SELECT stock_code FROM uni)""", "date stock_code ~raw_open ~raw_close is_st is_suspended has_price_record has_status_record in_universe")
def _(spark, sf_dir):
    p = proxy.panel(spark, sf_dir)
    c = O.calendar_index(p)
    prices = p.where("has_price_record").select("date", "stock_code", "raw_open", "raw_close")
    return O.panel_skeleton(c, O.universe_asof(c, snapshots(p)), prices, p.where("k % 4 > 0").select("date", "stock_code", "is_st", "is_suspended"))


@query("b7_panel_simple", "panel uni", """SELECT p.date, p.stock_code, raw_open, raw_close, u.date IS NOT NULL AS in_universe, coalesce(CASE WHEN k % 4 > 0 THEN is_st END, TRUE) AS is_st, coalesce(CASE WHEN k % 4 > 0 THEN is_suspended END, TRUE) AS is_suspended,
  coalesce(CASE WHEN k % 5 > 0 THEN industry END, 'Unknown') AS industry, CASE WHEN k % 5 > 0 THEN market_cap END AS market_cap
  FROM panel p LEFT JOIN uni u ON p.date = u.date AND p.stock_code = u.stock_code WHERE has_price_record""", "date stock_code ~raw_open ~raw_close in_universe is_st is_suspended industry ~market_cap")
def _(spark, sf_dir):
    p = proxy.panel(spark, sf_dir)
    members = O.universe_asof(O.calendar_index(p), snapshots(p))
    prices = p.where("has_price_record").select("date", "stock_code", "raw_open", "raw_close")
    return O.panel_simple(prices, members, p.where("k % 4 > 0").select("date", "stock_code", "is_st", "is_suspended"), p.where("k % 5 > 0").select("date", "stock_code", "industry", "market_cap"))


@query("b8_next_trading_date", "cal", "SELECT date, lead(date) OVER (ORDER BY pos) AS next_date FROM cal", "date next_date")
def _(spark, sf_dir):
    return O.next_trading_date(cal(spark, sf_dir))


@query("b9_exit_date", "cal", "SELECT a.date, b.date AS exit_date FROM cal a LEFT JOIN cal b ON b.pos = a.pos + 11", "date exit_date")
def _(spark, sf_dir):
    return O.exit_date(cal(spark, sf_dir), 10)


@query("b10_lookback_start", "cal", "SELECT date AS lookback_start FROM cal WHERE pos = (SELECT min(pos) FROM cal WHERE date >= DATE '1998-01-01') - 20", "lookback_start")
def _(spark, sf_dir):
    return O.lookback_start(cal(spark, sf_dir), "1998-01-01", 20)


@query("b11_last_complete_signal", "cal", "SELECT a.date AS as_of, b.date AS signal_date FROM cal a JOIN cal b ON b.pos = a.pos - 11 WHERE a.date = (SELECT max(date) FROM cal WHERE date <= DATE '2001-06-30')", "as_of signal_date")
def _(spark, sf_dir):
    return O.last_complete_signal(cal(spark, sf_dir), 10, "2001-06-30")


RAW_INDUSTRY = "CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN ' unKnown ' WHEN 2 THEN NULL ELSE '  ' || industry || ' ' END"


@query("b12_normalize_industry", "panel", f"""SELECT date, stock_code, CASE WHEN x IS NULL OR x = '' OR lower(x) = 'unknown' THEN 'UNKNOWN' ELSE x END AS industry
  FROM (SELECT date, stock_code, trim({RAW_INDUSTRY}) AS x FROM panel)""", "date stock_code industry")
def _(spark, sf_dir):
    p = proxy.panel(spark, sf_dir).withColumn("industry", F.expr(RAW_INDUSTRY))
    return p.select("date", "stock_code", O.normalize_industry("industry").alias("industry"))
