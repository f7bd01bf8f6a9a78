"""Queries P1 to P16, on the two linear models' scores with ten stocks a signal."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from crossgrain.operators import contracts
from crossgrain.operators import ledger as P
from crossgrain.operators.calendar import calendar_index
from crossgrain.plans import forward
from crossgrain.queries.ranking import predictions
from crossgrain.queries.registry import PARTS, part, query
from crossgrain.sources import proxy
from crossgrain.sources.scratch import new_path

TERMS = P.Terms(k=10, min_listing_days=20)
METRICS = ["ending_nav", "max_drawdown", "sharpe_ratio", "total_cost"]

part("want", "pred cal", "SELECT model, date AS signal_date, next_date AS execution_date, stock_code, CAST(row_number() OVER (PARTITION BY model, date ORDER BY score DESC, stock_code) AS INTEGER) AS cohort_rank FROM pred JOIN (SELECT date, lead(date) OVER (ORDER BY pos) AS next_date FROM cal) USING (date) QUALIFY cohort_rank <= 10")
COMMON = """WHEN NOT coalesce(has_price_record, FALSE) THEN 'no_price_record' WHEN coalesce(is_suspended, TRUE) THEN 'suspended' WHEN NOT coalesce(raw_open > 0, FALSE) THEN 'invalid_raw_open' WHEN NOT coalesce(post_open > 0, FALSE) THEN 'invalid_post_open'"""
part("rules", "panel", f"""SELECT date, stock_code, CASE {COMMON} WHEN NOT coalesce(limit_down > 0, FALSE) THEN 'invalid_limit_down' WHEN NOT coalesce(raw_open > limit_down + 1e-8, FALSE) THEN 'at_limit_down' END AS sell_reason,
  CASE {COMMON} WHEN coalesce(is_st, TRUE) THEN 'st' WHEN NOT coalesce(listing_days >= 20, FALSE) THEN 'listed_too_short' WHEN NOT coalesce(limit_up > 0 AND limit_down > 0 AND limit_up > limit_down, FALSE) THEN 'invalid_limits'
  WHEN NOT coalesce(raw_open < limit_up - 1e-8, FALSE) THEN 'at_limit_up' WHEN NOT coalesce(raw_open > limit_down + 1e-8, FALSE) THEN 'at_limit_down' END AS buy_reason FROM panel""")
part("sched", "cal", "SELECT CAST(a.pos % 10 AS INTEGER) AS offset_, a.date AS signal_date, b.date AS execution_date, c.date AS horizon_date FROM cal a JOIN cal b ON b.pos = a.pos + 1 JOIN cal c ON c.pos = a.pos + 11")
part("act", "sched cal", """SELECT offset_, date, pos, s IS NOT NULL AS rebalance, last_value(s IGNORE NULLS) OVER (PARTITION BY offset_ ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS signal_date FROM (
  SELECT g.offset_, c.date, c.pos, s.signal_date AS s FROM (SELECT offset_, min(execution_date) AS a, max(horizon_date) AS b FROM sched GROUP BY offset_) g JOIN cal c ON c.date BETWEEN a AND b LEFT JOIN sched s ON s.offset_ = g.offset_ AND s.execution_date = c.date)""")
part("pd", "act", "SELECT m.model || ':' || offset_ AS path, m.model, a.* FROM act a CROSS JOIN (VALUES ('one'), ('two')) AS m(model)")
part("latch0", "pd want rules", """SELECT x.*, d.stock_code IS NOT NULL AS desired, r.buy_reason, r.sell_reason, CASE WHEN d.stock_code IS NOT NULL AND rebalance AND r.buy_reason IS NULL THEN 1 WHEN d.stock_code IS NULL AND r.sell_reason IS NULL THEN 0 END AS event FROM (
  SELECT pd.path, pd.model, pd.date, pd.pos, pd.rebalance, pd.signal_date, e.stock_code FROM pd JOIN (SELECT DISTINCT path, stock_code FROM pd JOIN want USING (model, signal_date)) e USING (path)) x
  LEFT JOIN want d ON d.model = x.model AND d.signal_date = x.signal_date AND d.stock_code = x.stock_code JOIN rules r ON r.date = x.date AND r.stock_code = x.stock_code""")
part("latch", "latch0", """SELECT *, coalesce(last_value(event IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS held, coalesce(last_value(event IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS was_held FROM latch0
  WINDOW w AS (PARTITION BY path, stock_code ORDER BY pos)""")
part("epi0", "latch", "SELECT *, sum(CASE WHEN held AND NOT was_held THEN 1 ELSE 0 END) OVER (PARTITION BY path, stock_code ORDER BY pos) AS episode FROM latch WHERE held OR was_held")
part("epi", "epi0", "SELECT path, stock_code, CAST(episode AS BIGINT) AS episode, min(date) FILTER (WHERE held) AS entry_date, min(pos) FILTER (WHERE held) AS entry_pos, max(date) FILTER (WHERE NOT held) AS exit_date, max(pos) AS last_pos FROM epi0 GROUP BY ALL")
part("marks", "epi0 epi panel", """SELECT path, date, stock_code, entry_date, held, first_value(price IGNORE NULLS) OVER w AS entry_price, last_value(price IGNORE NULLS) OVER w AS mark FROM (SELECT e.path, e.date, e.pos, e.stock_code, e.episode, x.entry_date, e.held, CASE WHEN has_price_record AND NOT is_suspended AND post_open > 0 THEN post_open END AS price
  FROM epi0 e JOIN epi x USING (path, stock_code, episode) JOIN panel p ON p.date = e.date AND p.stock_code = e.stock_code) WINDOW w AS (PARTITION BY path, stock_code, episode ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")




# -- the ledger as a recursion over days: holdings, marks and cash together, no latch and no episodes -------


def ledger_parts(tag: str, days: str, wants: str) -> None:
    """Parts sim{tag} (a row a path and day), hold{tag} (what is held after a day) and trade{tag}, of path days and desired sets.

    A path's state is lists over the stocks that it ever desires: units, marks, entry dates.
    """
    part(f"list{tag}", f"{days} {wants} rules panel", f"""!SELECT *, row_number() OVER (PARTITION BY path ORDER BY pos) AS k, len(s) AS n FROM (
  SELECT x.path, x.date, x.pos, x.rebalance, list(x.stock_code ORDER BY x.stock_code) AS s, list(d.stock_code IS NOT NULL ORDER BY x.stock_code) AS d, list(r.buy_reason ORDER BY x.stock_code) AS br, list(r.sell_reason ORDER BY x.stock_code) AS sr,
    list(CASE WHEN p.has_price_record AND NOT p.is_suspended AND p.post_open > 0 THEN p.post_open END ORDER BY x.stock_code) AS p
  FROM (SELECT pd.path, pd.model, pd.date, pd.pos, pd.rebalance, pd.signal_date, e.stock_code FROM {days} pd JOIN (SELECT DISTINCT path, stock_code FROM {days} JOIN {wants} USING (model, signal_date)) e USING (path)) x
  LEFT JOIN {wants} d ON d.model = x.model AND d.signal_date = x.signal_date AND d.stock_code = x.stock_code
  JOIN rules r ON r.date = x.date AND r.stock_code = x.stock_code JOIN panel p ON p.date = x.date AND p.stock_code = x.stock_code GROUP BY x.path, x.date, x.pos, x.rebalance)""")
    total = lambda f: f"coalesce(list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN {f} END)), 0.0)"
    each = lambda f: f"list_transform(range(1, n + 1), lambda i: {f})"
    part(f"sim{tag}", f"list{tag}", f"""!
  SELECT path, CAST(0 AS BIGINT) AS k, CAST(NULL AS DATE) AS date, CAST(0 AS BIGINT) AS pos, FALSE AS rebalance, CAST(1 AS DOUBLE) AS pre_nav, CAST(1 AS DOUBLE) AS nav, CAST(1 AS DOUBLE) AS cash, CAST(0 AS DOUBLE) AS sold, CAST(0 AS DOUBLE) AS bought,
    CAST(0 AS DOUBLE) AS sell_cost, CAST(0 AS DOUBLE) AS buy_cost, CAST(0 AS BIGINT) AS n_sells, CAST(0 AS BIGINT) AS n_buys, CAST(0 AS DOUBLE) AS scale, CAST(0 AS DOUBLE) AS notional, FALSE AS cash_blocked,
    {each("CAST(0 AS DOUBLE)")} AS u, {each("CAST(NULL AS DOUBLE)")} AS m, {each("CAST(NULL AS DATE)")} AS e, {each("CAST(0 AS DOUBLE)")} AS before FROM list{tag} WHERE k = 1
  UNION ALL
  SELECT path, k, date, pos, rebalance, pre AS pre_nav, pre - sold * 0.0011 - each * n_buys * 0.0006 AS nav, CASE WHEN cash1 - each * n_buys * 1.0006 <= 1e-12 THEN 0.0 ELSE cash1 - each * n_buys * 1.0006 END AS cash, sold, each * n_buys AS bought,
    sold * 0.0011 AS sell_cost, each * n_buys * 0.0006 AS buy_cost, n_sells, n_buys, scale, each AS notional, blocked AS cash_blocked,
    {each("CASE WHEN sells[i] THEN 0.0 WHEN buys[i] AND NOT blocked THEN each / p[i] ELSE u[i] END")} AS u, {each("CASE WHEN sells[i] OR u[i] > 0 THEN m1[i] WHEN buys[i] AND NOT blocked THEN p[i] END")} AS m,
    {each("CASE WHEN sells[i] OR u[i] > 0 THEN e[i] WHEN buys[i] AND NOT blocked THEN date END")} AS e, u AS before
  FROM (SELECT *, CASE WHEN blocked THEN 0 ELSE want END AS n_buys, CASE WHEN want > 0 AND NOT blocked THEN pre / 10 * scale ELSE 0.0 END AS each FROM (
    SELECT *, want > 0 AND scale <= 0 AS blocked FROM (
      SELECT *, CASE WHEN want > 0 AND pre > 0 THEN least(1.0, cash1 / (want * (pre / 10) * 1.0006)) ELSE 0.0 END AS scale FROM (
        SELECT *, CASE WHEN cash + sold * 0.9989 <= 1e-12 THEN 0.0 ELSE cash + sold * 0.9989 END AS cash1, CAST(len(list_filter(buys, lambda x: x)) AS BIGINT) AS want, CAST(len(list_filter(sells, lambda x: x)) AS BIGINT) AS n_sells FROM (
          SELECT *, cash + {total("u[i] > 0 THEN u[i] * m1[i]")} AS pre, {total("sells[i] THEN u[i] * m1[i]")} AS sold FROM (
            SELECT l.*, t.cash, t.u, t.e, list_transform(range(1, l.n + 1), lambda i: CASE WHEN t.u[i] > 0 THEN coalesce(l.p[i], t.m[i]) END) AS m1,
              list_transform(range(1, l.n + 1), lambda i: t.u[i] > 0 AND NOT l.d[i] AND l.sr[i] IS NULL) AS sells, list_transform(range(1, l.n + 1), lambda i: l.rebalance AND l.d[i] AND l.br[i] IS NULL AND t.u[i] = 0) AS buys
            FROM sim{tag} t JOIN list{tag} l ON l.path = t.path AND l.k = t.k + 1))))))""")
    part(f"hold{tag}", f"sim{tag} list{tag}", f"SELECT path, date, stock_code, e AS entry_date, u AS units, m AS mark, u * m AS value FROM (SELECT t.path, t.date, unnest(l.s) AS stock_code, unnest(t.u) AS u, unnest(t.m) AS m, unnest(t.e) AS e FROM sim{tag} t JOIN list{tag} l USING (path, k)) WHERE u > 0")
    part(f"trade{tag}", f"sim{tag} list{tag}", f"""SELECT path, date, stock_code, side, status, reason, CASE WHEN status = 'filled' THEN u * m END AS gross_notional, CASE WHEN status = 'filled' THEN u * m * CASE side WHEN 'sell' THEN 0.0011 ELSE 0.0006 END END AS cost, CASE WHEN status = 'filled' THEN u END AS units FROM (
  SELECT path, date, stock_code, 'sell' AS side, CASE WHEN sr IS NULL THEN 'filled' ELSE 'blocked' END AS status, sr AS reason, was AS u, m FROM each_stock WHERE was > 0 AND NOT d
  UNION ALL SELECT path, date, stock_code, 'buy', CASE WHEN u > 0 THEN 'filled' ELSE 'blocked' END, CASE WHEN u > 0 THEN NULL ELSE coalesce(br, CASE WHEN cash_blocked THEN 'cash' END) END, u, m FROM each_stock WHERE d AND rebalance AND was = 0)""".replace("each_stock", f"""(SELECT t.path, t.date, t.rebalance, t.cash_blocked, unnest(l.s) AS stock_code, unnest(t.u) AS u, unnest(t.before) AS was, unnest(t.m) AS m, unnest(l.d) AS d, unnest(l.br) AS br, unnest(l.sr) AS sr FROM sim{tag} t JOIN list{tag} l USING (path, k))"""))
    part(f"nav{tag}", f"sim{tag}", f"""SELECT *, pre_nav / nullif(before_nav, 0) - 1 AS gross_return, nav / nullif(before_nav, 0) - 1 AS net_return, cash / nullif(nav, 0) AS cash_ratio, (sold + bought) / nullif(pre_nav, 0) AS turnover, sell_cost + buy_cost AS cost FROM (
  SELECT *, CAST(len(list_filter(u, lambda x: x > 0)) AS BIGINT) AS n_held, coalesce(lag(nav) OVER (PARTITION BY path ORDER BY pos), 1.0) AS before_nav FROM sim{tag} WHERE k > 0)""")
    part(f"summary{tag}", f"nav{tag}", f"""SELECT path, days, first_date, last_date, ending_nav, ending_nav - 1 AS total_return, pow(ending_nav, 252.0 / days) - 1 AS annualized_return, s * sqrt(252.0) AS annualized_volatility, mean_return * 252 / nullif(s * sqrt(252.0), 0) AS sharpe_ratio, -least(0.0, low) AS max_drawdown,
  total_cost, t * 252 AS annualized_turnover, mean_cash_ratio, mean_held, buys, sells, rebalances, win_rate, best_day, worst_day FROM (
  SELECT path, count(*) AS days, min(date) AS first_date, max(date) AS last_date, arg_max(nav, pos) AS ending_nav, avg(net_return) AS mean_return, stddev_samp(net_return) AS s, min(nav / greatest(1.0, top) - 1) AS low, sum(cost) AS total_cost, avg(turnover) AS t, avg(cash_ratio) AS mean_cash_ratio, avg(n_held) AS mean_held,
    CAST(sum(n_buys) AS BIGINT) AS buys, CAST(sum(n_sells) AS BIGINT) AS sells, count(*) FILTER (WHERE rebalance) AS rebalances, avg(CASE WHEN round(net_return, 12) > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, max(net_return) AS best_day, min(net_return) AS worst_day
  FROM (SELECT *, max(nav) OVER (PARTITION BY path ORDER BY pos) AS top FROM nav{tag}) GROUP BY path)""")
    part(f"average{tag}", f"nav{tag}", f"""SELECT model, date, nav, cash, cash / nullif(nav, 0) AS cash_ratio, nav / nullif(lag(nav) OVER (PARTITION BY model ORDER BY date), 0) - 1 AS net_return, paths FROM (
  SELECT model, date, avg(nav) AS nav, avg(cash) AS cash, count(*) AS n FROM (SELECT *, split_part(path, ':', 1) AS model FROM nav{tag}) GROUP BY model, date) JOIN (SELECT split_part(path, ':', 1) AS model, count(DISTINCT path) AS paths FROM nav{tag} GROUP BY 1) USING (model) WHERE n = paths""")


#: The last day of the forward run's calendar, and a day on which it is cut off before.
AS_OF, HALFWAY = "1997-06-30", "1996-03-15"

part("pdaily", "want cal", "SELECT DISTINCT model || ':daily' AS path, model, c.date, c.pos, TRUE AS rebalance, signal_date FROM want JOIN cal c ON c.date = execution_date")
part("calf", "cal", f"SELECT * FROM cal WHERE date <= DATE '{AS_OF}'")
for _name, _needs in (("sched", "calf"), ("act", "schedf calf"), ("pd", "actf"), ("want", "pred calf")):
    _body = PARTS[_name][1]
    for _word in ("FROM cal ", "JOIN cal ", "FROM cal)", "FROM sched ", "JOIN sched ", "FROM act "):
        _body = _body.replace(_word, _word[:-1] + "f" + _word[-1])
    part(f"{_name}f", _needs, _body)
ledger_parts("_p", "pd", "want")
ledger_parts("_daily", "pdaily", "want")
ledger_parts("_f", "pdf", "wantf")
FILLS = """SELECT path, count(*) FILTER (WHERE side = 'buy' AND status = 'filled') / nullif(count(*) FILTER (WHERE side = 'buy'), 0) AS buy_fill_rate, count(*) FILTER (WHERE side = 'sell' AND status = 'filled') / nullif(count(*) FILTER (WHERE side = 'sell'), 0) AS sell_fill_rate,
  count(*) FILTER (WHERE side = 'buy' AND status = 'blocked') AS blocked_buys, count(*) FILTER (WHERE side = 'sell' AND status = 'blocked') AS blocked_sells, count(DISTINCT CASE WHEN side = 'sell' AND status = 'blocked' THEN date END) AS blocked_sale_days, count(*) FILTER (WHERE side = 'buy' AND reason = 'cash') AS cash_blocked_buys FROM trade_p GROUP BY path"""
SUMMARY_OUT = "path days first_date last_date ~ending_nav ~total_return ~annualized_return ~annualized_volatility ~sharpe_ratio ~max_drawdown ~total_cost ~annualized_turnover ~mean_cash_ratio ~mean_held buys sells rebalances ~win_rate ~best_day ~worst_day ~buy_fill_rate ~sell_fill_rate blocked_buys blocked_sells blocked_sale_days cash_blocked_buys"
AVERAGE_OUT = "model date ~nav ~cash ~cash_ratio ~net_return paths"


def scores(spark, sf_dir):
    return predictions(spark, sf_dir).select("model", "date", "stock_code", "score")


def staged(spark, sf_dir):
    """Panel, path days, desired sets and rules of the staggered paths."""
    p = proxy.panel(spark, sf_dir)
    c = calendar_index(p)
    s = scores(spark, sf_dir)
    desired = P.desired_set(s, c, TERMS.k)
    days = P.paths(P.active_desired(P.offset_schedule(c, TERMS.step), c), s.select("model").distinct())
    return p, days, desired, P.trading_rules(p, TERMS.min_listing_days)


def ledger(spark, sf_dir, as_of=None):
    p = proxy.panel(spark, sf_dir)
    return p, forward.staggered(scores(spark, sf_dir), p, calendar_index(p), TERMS, as_of)


@query("p1_desired_set", "want", "SELECT * FROM want", "model signal_date execution_date stock_code cohort_rank")
def _(spark, sf_dir):
    return P.desired_set(scores(spark, sf_dir), calendar_index(proxy.days(spark, sf_dir)), TERMS.k)


@query("p2_trading_rules", "rules", "SELECT * FROM rules", "date stock_code sell_reason buy_reason")
def _(spark, sf_dir):
    return P.trading_rules(proxy.panel(spark, sf_dir), TERMS.min_listing_days)


@query("p3_offset_schedule", "sched", "SELECT * FROM sched", "offset_ signal_date execution_date horizon_date")
def _(spark, sf_dir):
    return P.offset_schedule(calendar_index(proxy.days(spark, sf_dir))).withColumnRenamed("offset", "offset_")


@query("p4_active_desired", "act", "SELECT * FROM act", "offset_ date pos rebalance signal_date")
def _(spark, sf_dir):
    c = calendar_index(proxy.days(spark, sf_dir))
    return P.active_desired(P.offset_schedule(c), c).withColumnRenamed("offset", "offset_")


@query("p5_holding_latch", "latch", "SELECT * FROM latch", "path date stock_code desired rebalance buy_reason sell_reason held was_held")
def _(spark, sf_dir):
    return P.holding_latch(*staged(spark, sf_dir)[1:]).drop("pos")


@query("p6_holding_episodes", "epi", "SELECT * FROM epi", "path stock_code episode entry_date entry_pos exit_date last_pos")
def _(spark, sf_dir):
    _, days, desired, rules = staged(spark, sf_dir)
    return P.holding_episodes(P.turns(days, desired, rules), days)


@query("p7_carried_mark", "marks", "SELECT * FROM marks", "path date stock_code entry_date ~entry_price ~mark held")
def _(spark, sf_dir):
    p, days, desired, rules = staged(spark, sf_dir)
    held, dates = P.intervals(P.turns(days, desired, rules), days), P.path_calendar(days)
    return P.carried_mark(held, P.carried_prices(p, dates), dates).drop("pos", "episode", "entry_pos", "notional")


@query("p8_nav_recurrence", "nav_p", "SELECT * FROM nav_p", "path date pos rebalance ~pre_nav ~nav ~cash ~sold ~bought ~sell_cost ~buy_cost n_sells n_buys ~scale ~notional n_held cash_blocked")
def _(spark, sf_dir):
    return ledger(spark, sf_dir)[1].nav.select(*P.NAV_COLUMNS)


@query("p9_trade_ledger", "trade_p", "SELECT * FROM trade_p", "path date stock_code side status reason ~gross_notional ~cost ~units")
def _(spark, sf_dir):
    return P.trade_ledger(ledger(spark, sf_dir)[1], TERMS)


@query("p10_daily_nav", "nav_p", "SELECT * FROM nav_p", "path date pos rebalance ~pre_nav ~nav ~cash n_buys n_sells n_held ~gross_return ~net_return ~cash_ratio ~turnover ~cost")
def _(spark, sf_dir):
    return P.daily_nav(ledger(spark, sf_dir)[1].nav)


@query("p11_positions", "hold_p", "SELECT * FROM hold_p", "path date stock_code entry_date ~units ~mark ~value")
def _(spark, sf_dir):
    return P.positions(ledger(spark, sf_dir)[1])


@query("p11_ending_positions", "hold_p nav_p", """SELECT h.path, h.date, stock_code, units, value FROM hold_p h JOIN (SELECT path, max(date) AS date FROM nav_p GROUP BY path) l ON l.path = h.path AND l.date = h.date
  UNION ALL SELECT path, max(date), 'CASH', NULL, arg_max(cash, date) FROM nav_p GROUP BY path""", "path date stock_code ~units ~value")
def _(spark, sf_dir):
    return P.ending_positions(ledger(spark, sf_dir)[1])


@query("p12_strategy_summary", "summary_p trade_p", f"SELECT * FROM summary_p LEFT JOIN ({FILLS}) USING (path)", SUMMARY_OUT)
def _(spark, sf_dir):
    x = ledger(spark, sf_dir)[1]
    return P.strategy_summary(P.daily_nav(x.nav), P.trade_ledger(x, TERMS))


@query("p13_offset_summary", "summary_p", " UNION ALL ".join(f"SELECT split_part(path, ':', 1) AS model, '{m}' AS metric, avg({m}) AS mean, median({m}) AS median, stddev_samp({m}) AS std, min({m}) AS min, max({m}) AS max FROM summary_p GROUP BY 1" for m in METRICS), "model metric ~mean ~median ~std ~min ~max")
def _(spark, sf_dir):
    return P.offset_summary(P.strategy_summary(P.daily_nav(ledger(spark, sf_dir)[1].nav)), METRICS)


@query("p14_average_nav", "average_p", "SELECT * FROM average_p", AVERAGE_OUT)
def _(spark, sf_dir):
    return P.average_nav(P.daily_nav(ledger(spark, sf_dir)[1].nav))


@query("p15_strategy_comparison", "summary_p summary_daily", "SELECT model, " + ", ".join(f"d.{m} AS daily_{m}, s.{m} AS staggered_{m}, s.{m} - d.{m} AS difference_{m}" for m in METRICS) + """
  FROM (SELECT split_part(path, ':', 1) AS model, * FROM summary_daily) d FULL JOIN (SELECT split_part(path, ':', 1) AS model, """ + ", ".join(f"avg({m}) AS {m}" for m in METRICS) + " FROM summary_p GROUP BY 1) s USING (model)", "model " + " ".join(f"~daily_{m} ~staggered_{m} ~difference_{m}" for m in METRICS))
def _(spark, sf_dir):
    p = proxy.panel(spark, sf_dir)
    c, s = calendar_index(p), scores(spark, sf_dir)
    model = F.substring_index("path", ":", 1).alias("model")
    every = P.strategy_summary(P.daily_nav(forward.daily(s, p, c, TERMS).nav)).select(model, *METRICS)
    offsets = P.strategy_summary(P.daily_nav(forward.staggered(s, p, c, TERMS).nav)).groupBy(model).agg(*[F.avg(m).alias(m) for m in METRICS])
    return P.strategy_comparison(every, offsets, METRICS)


@query("p16_forward_run", "average_f", "SELECT * FROM average_f", AVERAGE_OUT)
def _(spark, sf_dir):
    p = proxy.panel(spark, sf_dir)
    c, s = calendar_index(p), scores(spark, sf_dir)
    dated = lambda df: lambda first, last: df.where(F.col("date").between(F.lit(first), F.lit(last)))
    run = forward.ForwardRun(spark, new_path(spark, "forward"))
    for day in (HALFWAY, AS_OF):  # cut once and resumed
        run.advance(dated(s), dated(p), c, TERMS, dt.date.fromisoformat(day))
    return P.average_nav(P.daily_nav(run.nav()))


@query("a26_schedule_annotation_check", "act", """SELECT 'schedule' AS "check", offset_ || '|' || date AS "key", 'differs' AS detail FROM act WHERE pos % 50 = 7 AND rebalance UNION ALL SELECT 'schedule', offset_ || '|' || date, 'not published' FROM act WHERE pos % 60 = 11 AND NOT (pos % 50 = 7)""", '"check" "key" detail')
def _(spark, sf_dir):
    c = calendar_index(proxy.days(spark, sf_dir))
    schedule = P.active_desired(P.offset_schedule(c), c).withColumn("path", F.col("offset").cast("string"))
    published = schedule.where("not (pos % 60 = 11 and pos % 50 <> 7)").withColumn("rebalance", F.col("rebalance") & (F.col("pos") % 50 != 7))
    return contracts.schedule_annotation_check(published, schedule)
