"""Queries L1 to L17."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossgrain.functions.columns import rank_percentile
from crossgrain.operators import factors, labels as O
from crossgrain.operators.calendar import calendar_index
from crossgrain.queries.registry import part, query
from crossgrain.sources import proxy

PERIODS = {"train": ("1995-01-01", "1998-12-31"), "validation": ("1999-01-01", "1999-12-31"), "test": ("2000-01-01", "2001-12-31")}
FINAL = ("1995-01-01", "1999-12-31")
HORIZONS, LISTED = (1, 5, 10), 20
PERIOD_SQL = "CASE " + " ".join(f"WHEN date BETWEEN DATE '{a}' AND DATE '{b}' THEN '{n}'" for n, (a, b) in PERIODS.items()) + " END"
END_SQL = "CASE base_period " + " ".join(f"WHEN '{n}' THEN DATE '{b}'" for n, (_, b) in PERIODS.items()) + " END"


def ahead(c: str, k: int) -> str:
    return f"max({c}) OVER (PARTITION BY stock_code ORDER BY pos RANGE BETWEEN {k} FOLLOWING AND {k} FOLLOWING)"


part("fwd", "panel", "SELECT date, stock_code, " + ", ".join(f"{ahead('post_close', w)} / nullif(post_close, 0) - 1 AS return_{w}" for w in (1, 5, 10)) + " FROM panel")
part("targets", "panel", "SELECT date, stock_code, " + ", ".join(f"{ahead('post_open', h + 1)} / nullif({ahead('post_open', 1)}, 0) - 1 AS target_{h}d" for h in HORIZONS) + " FROM panel")
STATE = ", ".join(f"n.{c} AS entry_{c}" for c in O.STATE)
part("entry", "panel cal", f"""!SELECT p.date, p.stock_code, p.in_universe, p.industry, p.market_cap, c.next_date AS entry_date, n.date IS NOT NULL AS entry_data_available, {STATE}
  FROM panel p JOIN (SELECT date, lead(date) OVER (ORDER BY pos) AS next_date FROM cal) c USING (date) LEFT JOIN panel n ON n.date = c.next_date AND n.stock_code = p.stock_code""")
UP = "coalesce(entry_raw_open >= entry_limit_up - 1e-10, FALSE)"
DOWN = "coalesce(entry_raw_open <= entry_limit_down + 1e-10, FALSE)"
COMMON = f"NOT coalesce(entry_is_st, TRUE) AND NOT coalesce(entry_is_suspended, TRUE) AND coalesce(entry_listing_days >= {LISTED}, FALSE)"
part("eligible", "entry", f"SELECT *, coalesce(in_universe, FALSE) AND {COMMON} AND entry_raw_open IS NOT NULL AND NOT {UP} AND NOT {DOWN} AS eligible FROM entry")
part("tradeable", "entry", f"""SELECT *, {UP} AS entry_open_limit_up, {DOWN} AS entry_open_limit_down, coalesce(entry_data_available, FALSE) AND {COMMON} AND coalesce(entry_raw_open > 0, FALSE)
  AND coalesce(entry_limit_up > 0, FALSE) AND coalesce(entry_limit_down > 0, FALSE) AND coalesce(entry_limit_up > entry_limit_down, FALSE) AND NOT {UP} AND NOT {DOWN} AS entry_tradeable FROM entry""")
part("idx", "targets cal", "SELECT date, stock_code, base_period, " + ", ".join(
    f"exit_date_{h}, CASE WHEN target_{h}d IS NOT NULL AND exit_date_{h} <= {END_SQL} THEN base_period END AS split_{h}, "
    f"coalesce(target_{h}d IS NOT NULL AND date BETWEEN DATE '{FINAL[0]}' AND DATE '{FINAL[1]}' AND exit_date_{h} <= DATE '{FINAL[1]}', FALSE) AS final_train_{h}, target_{h}d" for h in HORIZONS)
    + f" FROM (SELECT t.*, {PERIOD_SQL} AS base_period, " + ", ".join(f"c{h}.date AS exit_date_{h}" for h in HORIZONS) + " FROM targets t JOIN cal c USING (date) " + " ".join(f"LEFT JOIN cal c{h} ON c{h}.pos = c.pos + {h + 1}" for h in HORIZONS) + ")")
part("ranked", "idx", """SELECT date, stock_code, target_10d, CASE WHEN n > 1 THEN (rk + (tied - 1) / 2.0 - 1) / (n - 1) END AS rank_target_10d FROM (
  SELECT date, stock_code, target_10d, count(*) OVER (PARTITION BY date) AS n, count(*) OVER (PARTITION BY date, target_10d) AS tied, rank() OVER (PARTITION BY date ORDER BY target_10d) AS rk
  FROM (SELECT date, stock_code, round(target_10d, 8) AS target_10d FROM idx WHERE target_10d IS NOT NULL))""")
NAMES = ["rev_1d", "rev_5d", "intraday_rev_5d"]
part("wide", "panel", """SELECT u.date, u.stock_code, a AS rev_1d, b AS rev_5d, c AS intraday_rev_5d FROM (SELECT date, stock_code FROM panel WHERE in_universe) u JOIN (
  SELECT date, stock_code, -(post_close / nullif(max(post_close) OVER (PARTITION BY stock_code ORDER BY pos RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) - 1) AS a,
    -(post_close / nullif(max(post_close) OVER (PARTITION BY stock_code ORDER BY pos RANGE BETWEEN 5 PRECEDING AND 5 PRECEDING), 0) - 1) AS b,
    CASE WHEN count(x) OVER w >= 5 THEN -avg(x) OVER w END AS c FROM (SELECT *, raw_close / nullif(raw_open, 0) - 1 AS x FROM panel)
  WINDOW w AS (PARTITION BY stock_code ORDER BY pos RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)) USING (date, stock_code)""")
ENTRY = "entry_date entry_data_available entry_is_st entry_is_suspended ~entry_listing_days ~entry_raw_open ~entry_limit_up ~entry_limit_down"
INDEX = "date stock_code base_period " + " ".join(f"exit_date_{h} split_{h} final_train_{h}" for h in HORIZONS) + " " + " ".join(f"~target_{h}d" for h in HORIZONS)


def index(p):
    return O.sample_index(O.open_to_open_targets(p, HORIZONS), calendar_index(p), PERIODS, HORIZONS, FINAL)


def wide(p):
    return O.factor_wide(p.where("in_universe"), factors.build(p, NAMES), NAMES)


@query("l1_forward_returns", "fwd", "SELECT * FROM fwd", "date stock_code ~return_1 ~return_5 ~return_10")
def _(spark, sf_dir):
    return O.forward_returns(proxy.panel(spark, sf_dir), (1, 5, 10))


@query("l2_open_to_open_targets", "targets panel", "SELECT t.* FROM targets t JOIN panel USING (date, stock_code) WHERE in_universe", "date stock_code ~target_1d ~target_5d ~target_10d")
def _(spark, sf_dir):
    p = proxy.panel(spark, sf_dir)
    return O.open_to_open_targets(p, HORIZONS, p.where("in_universe"))


@query("l3_execution_state", "entry", "SELECT * FROM entry", "date stock_code " + ENTRY)
def _(spark, sf_dir):
    p = proxy.panel(spark, sf_dir)
    return O.execution_state(p, calendar_index(p))


@query("l4_eligible_sample", "eligible", "SELECT * FROM eligible", "date stock_code in_universe industry ~market_cap eligible " + ENTRY)
def _(spark, sf_dir):
    p = proxy.panel(spark, sf_dir)
    return O.eligible_sample(p, calendar_index(p), LISTED)


@query("l5_entry_metadata", "entry", "SELECT date, stock_code, industry, market_cap, entry_date, entry_data_available FROM entry", "date stock_code industry ~market_cap entry_date entry_data_available")
def _(spark, sf_dir):
    p = proxy.panel(spark, sf_dir)
    return p.select("date", "stock_code", "industry", "market_cap").join(O.execution_state(p, calendar_index(p)).select("date", "stock_code", "entry_date", "entry_data_available"), ["date", "stock_code"], "left")


@query("l6_tradeability", "tradeable", "SELECT * FROM tradeable", "date stock_code entry_open_limit_up entry_open_limit_down entry_tradeable")
def _(spark, sf_dir):
    p = proxy.panel(spark, sf_dir)
    return O.tradeability(O.execution_state(p, calendar_index(p)), LISTED).select("date", "stock_code", "entry_open_limit_up", "entry_open_limit_down", "entry_tradeable")


@query("l7_factor_wide", "wide", "SELECT * FROM wide", "date stock_code ~rev_1d ~rev_5d ~intraday_rev_5d")
def _(spark, sf_dir):
    return wide(proxy.panel(spark, sf_dir))


@query("l7_factor_coverage", "wide", "UNPIVOT (SELECT count(*) AS rows, count(rev_1d) AS rev_1d, count(rev_5d) AS rev_5d, count(intraday_rev_5d) AS intraday_rev_5d FROM wide) ON rev_1d, rev_5d, intraday_rev_5d INTO NAME factor VALUE present", "factor rows present ~coverage".replace(" ~coverage", ""))
def _(spark, sf_dir):
    return O.factor_coverage(wide(proxy.panel(spark, sf_dir)), NAMES).drop("coverage")


DATASET = "date stock_code ~rev_1d ~rev_5d ~intraday_rev_5d ~target_1d ~target_5d ~target_10d industry ~market_cap " + ENTRY + " entry_open_limit_up entry_open_limit_down entry_tradeable"


@query("l8_model_dataset", "wide targets tradeable", "SELECT * FROM wide LEFT JOIN targets USING (date, stock_code) LEFT JOIN tradeable USING (date, stock_code)", DATASET)
def _(spark, sf_dir):
    p = proxy.panel(spark, sf_dir)
    columns = {"rev_1d": factors.reversal(1), "rev_5d": factors.reversal(5), "intraday_rev_5d": factors.intraday_reversal(5)}
    return O.panel_dataset(p, calendar_index(p), columns, HORIZONS, LISTED, F.col("in_universe"))


@query("l8_joined_dataset", "wide targets tradeable", "SELECT * FROM wide LEFT JOIN targets USING (date, stock_code) LEFT JOIN tradeable USING (date, stock_code)", DATASET)
def _(spark, sf_dir):
    p = proxy.panel(spark, sf_dir)
    return O.model_dataset(wide(p), O.open_to_open_targets(p, HORIZONS), p, calendar_index(p), LISTED)


@query("l9_base_period", "cal", f"SELECT date, {PERIOD_SQL} AS base_period FROM cal", "date base_period")
def _(spark, sf_dir):
    return calendar_index(proxy.days(spark, sf_dir)).select("date", O.base_period("date", PERIODS).alias("base_period"))


@query("l10_l11_sample_index", "idx", "SELECT * FROM idx", INDEX)
def _(spark, sf_dir):
    return index(proxy.panel(spark, sf_dir))


@query("l12_split_summary", "idx", " UNION ALL ".join(f"""SELECT CAST({h} AS INTEGER) AS horizon, base_period, count(*) AS rows, count(split_{h}) AS kept, count(*) FILTER (WHERE split_{h} IS NULL AND target_{h}d IS NOT NULL) AS purged,
  count(*) FILTER (WHERE target_{h}d IS NULL) AS missing_label, min(date) FILTER (WHERE split_{h} IS NOT NULL) AS first_date, max(date) FILTER (WHERE split_{h} IS NOT NULL) AS last_date
  FROM idx WHERE base_period IS NOT NULL GROUP BY base_period""" for h in HORIZONS), "horizon base_period rows kept purged missing_label first_date last_date")
def _(spark, sf_dir):
    return O.split_summary(index(proxy.panel(spark, sf_dir)), HORIZONS)


def ranked(p):
    rows = index(p).where("target_10d is not null").select("date", "stock_code", F.round("target_10d", 8).alias("target_10d"))
    return rows.withColumn("rank_target_10d", rank_percentile("target_10d", "date"))


@query("l13_rank_percentile", "ranked", "SELECT date, stock_code, rank_target_10d FROM ranked", "date stock_code ~rank_target_10d")
def _(spark, sf_dir):
    return ranked(proxy.panel(spark, sf_dir)).drop("target_10d")


@query("l14_rank_dataset", "ranked wide idx", "SELECT w.*, i.target_10d, rank_target_10d, split_10, exit_date_10 FROM wide w JOIN ranked r USING (date, stock_code) JOIN idx i USING (date, stock_code)",
       "date stock_code ~rev_1d ~rev_5d ~intraday_rev_5d ~target_10d ~rank_target_10d split_10 exit_date_10")
def _(spark, sf_dir):
    p = proxy.panel(spark, sf_dir)
    return wide(p).join(ranked(p).drop("target_10d"), ["date", "stock_code"]).join(index(p).select("date", "stock_code", "target_10d", "split_10", "exit_date_10"), ["date", "stock_code"])


@query("l15_development_split", "idx", "SELECT date, stock_code, split_10 AS split, target_10d AS target FROM idx WHERE split_10 IN ('train', 'validation')", "date stock_code split ~target")
def _(spark, sf_dir):
    return O.development_split(index(proxy.panel(spark, sf_dir)), 10)


@query("l16_final_refit_rows", "idx", """SELECT date, stock_code, coalesce(split_10, 'boundary') AS split, target_10d AS target FROM idx WHERE split_10 IN ('train', 'validation')
  OR (split_10 IS NULL AND date <= DATE '1998-12-31' AND exit_date_10 BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' AND target_10d IS NOT NULL AND base_period IS NOT NULL)""", "date stock_code split ~target")
def _(spark, sf_dir):
    return O.final_refit_rows(index(proxy.panel(spark, sf_dir)), 10, ("1998-12-31", "1999-01-01"), "1999-12-31")


@query("l17_mask_incomplete_labels", "idx", "SELECT date, stock_code, CASE WHEN split_10 = 'test' AND exit_date_10 <= DATE '2001-06-30' THEN target_10d END AS target FROM idx", "date stock_code ~target")
def _(spark, sf_dir):
    return O.mask_incomplete_labels(index(proxy.panel(spark, sf_dir)), 10, "test", "2001-06-30")
