"""Rebalance ledgers as sets: all (model, offset) paths in one job.

A path holds the stocks its signals desire: on rebalance days it buys what is desired and may be
bought, every day it sells what isn't desired and may be sold. So a holding turns at few days only:
at rebalances, where a desired stock is bought if it can be, and on the first day from its being
dropped on which it can be sold. Holdings are found from these turns, as intervals (gaps and islands);
no row is made for a day on which nothing happens but to value what is held.

The cash account needs sums only: every buy of a day gets the same amount, so a day's holdings are
worth, for each entry day, that amount times the sum of mark / entry price. These sums are made by
groups in Spark; the account is a fold over a path's days in the JVM (`aggregate`), with cash and one
amount for each entry day still held as its state.

Spent cash may forbid a day's buys. The fold tells the first such day of a path and how long it lasts
(until a sale); the turns of these paths are then worked out again without these buys, until no new
day is found. Such days only move forward.

Columns: path (string), date, pos, stock_code. Markets need the panel's columns (has_price_record,
is_suspended, is_st, listing_days, raw_open, post_open, limit_up, limit_down).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossgrain.functions.columns import by_day, flag, ratio
from crossgrain.operators.calendar import next_trading_date
from crossgrain.operators.cross_section import top_k
from crossgrain.sources.scratch import Temporary, materialize

#: Days of a path that are folded together.
BLOCK_DAYS = 100
#: Tolerance of limits, cash that counts as none.
TOLERANCE, NO_CASH = 1e-8, 1e-12


@dataclass(frozen=True)
class Terms:
    k: int = 100
    min_listing_days: int = 60
    buy_cost: float = 0.0006
    sell_cost: float = 0.0011
    step: int = 10


def desired_set(scores: DataFrame, calendar: DataFrame, k: int) -> DataFrame:
    """model, signal_date, execution_date, stock_code, cohort_rank of the top k of each date."""
    chosen = top_k(scores, "score", k, ["model", "date"])
    days = next_trading_date(calendar)
    return chosen.join(by_day(days), "date", "left").select("model", F.col("date").alias("signal_date"), F.col("next_date").alias("execution_date"), "stock_code", "cohort_rank")


def _first_failure(*checks: tuple[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for reason, ok in reversed(checks):
        out = F.when(~flag(ok, False), reason).otherwise(out)
    return out


def _tradeable() -> list[tuple[str, Column]]:
    return [
        ("no_price_record", flag("has_price_record", False)), ("suspended", ~flag("is_suspended", True)), ("invalid_raw_open", F.col("raw_open") > 0), ("invalid_post_open", F.col("post_open") > 0),
    ]


def sell_rule() -> Column:
    """Why a stock can't be sold today, null if it can."""
    return _first_failure(*_tradeable(), ("invalid_limit_down", F.col("limit_down") > 0), ("at_limit_down", F.col("raw_open") > F.col("limit_down") + TOLERANCE))


def buy_rule(min_listing_days: int) -> Column:
    """Why a stock can't be bought today, null if it can."""
    up, down, price = F.col("limit_up"), F.col("limit_down"), F.col("raw_open")
    return _first_failure(
        *_tradeable(), ("st", ~flag("is_st", True)), ("listed_too_short", F.col("listing_days") >= min_listing_days), ("invalid_limits", (up > 0) & (down > 0) & (up > down)),
        ("at_limit_up", price < up - TOLERANCE), ("at_limit_down", price > down + TOLERANCE),
    )


def trading_rules(panel: DataFrame, min_listing_days: int) -> DataFrame:
    return panel.select("date", "stock_code", sell_rule().alias("sell_reason"), buy_rule(min_listing_days).alias("buy_reason"))


def offset_schedule(calendar: DataFrame, step: int = 10) -> DataFrame:
    """offset, signal_date, execution_date, horizon_date: signals every `step` dates from each offset.

    A signal is complete if its horizon, step + 1 dates on, is on the calendar.
    """
    w = Window.orderBy("pos")
    x = calendar.select("pos", F.col("date").alias("signal_date"), F.lead("date", 1).over(w).alias("execution_date"), F.lead("date", step + 1).over(w).alias("horizon_date"))
    return x.where("horizon_date is not null").select((F.col("pos") % step).cast("int").alias("offset"), "signal_date", "execution_date", "horizon_date")


def active_desired(schedule: DataFrame, calendar: DataFrame) -> DataFrame:
    """offset, date, pos, rebalance, signal_date: each day from a path's first execution to its last horizon.

    signal_date is the path's latest signal executed at or before the day.
    """
    spans = schedule.groupBy("offset").agg(F.min("execution_date").alias("_first"), F.max("horizon_date").alias("_last"))
    grid = spans.join(by_day(calendar), F.col("date").between(F.col("_first"), F.col("_last")))
    marks = schedule.select("offset", F.col("execution_date").alias("date"), "signal_date")
    x = grid.join(marks, ["offset", "date"], "left")
    latest = F.last("signal_date", ignorenulls=True).over(Window.partitionBy("offset").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return x.select("offset", "date", "pos", F.col("signal_date").isNotNull().alias("rebalance"), latest.alias("signal_date"))


def paths(active: DataFrame, models: DataFrame) -> DataFrame:
    """path_days: one row a path and day; a path is model:offset. models: one column, model (a few rows)."""
    return active.crossJoin(F.broadcast(models)).select(F.concat_ws(":", "model", F.col("offset").cast("string")).alias("path"), "model", "offset", "date", "pos", "rebalance", "signal_date")


def daily_paths(desired: DataFrame, calendar: DataFrame) -> DataFrame:
    """path_days of the daily strategy: every signal is executed on the next date; on dates in between without one nothing is bought."""
    marks = desired.select("model", "signal_date", F.col("execution_date").alias("date")).where("date is not null").distinct()
    spans = marks.groupBy("model").agg(F.min("date").alias("_first"), F.max("date").alias("_last"))
    days = spans.join(by_day(calendar), F.col("date").between(F.col("_first"), F.col("_last"))).join(marks, ["model", "date"], "left")
    latest = F.last("signal_date", ignorenulls=True).over(Window.partitionBy("model").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return days.select(F.concat(F.col("model"), F.lit(":daily")).alias("path"), "model", F.lit(0).alias("offset"), "date", "pos", F.col("signal_date").isNotNull().alias("rebalance"), latest.alias("signal_date"))


@dataclass
class Opening:
    """What paths hold and own before their first day: a ledger that goes on from a snapshot.

    cash: path, cash. holdings: path, stock_code, entry_date, entry_pos, entry_price, notional, mark, mark_pos.
    """

    cash: DataFrame
    holdings: DataFrame


def path_calendar(path_days: DataFrame) -> DataFrame:
    """date and pos of all days of the paths: a row a date."""
    return path_days.select("date", "pos").distinct()


def turns(path_days: DataFrame, desired: DataFrame, rules: DataFrame, blocks: DataFrame | None = None, opening: Opening | None = None) -> DataFrame:
    """The days on which a holding may turn: path, stock_code, pos, kind, event, was_held, buy_reason, cash_block, from_pos, to_pos.

    kind `order`: a desired stock on a rebalance day; event 1 if it may be bought. kind `drop`: a stretch
    from from_pos to to_pos on which a stock that was desired before isn't; pos is the first day of it on
    which the stock can be sold (event 0), else from_pos (event null). kind `open`: a holding of `opening`.
    A path's days follow each other without a gap. blocks: (path, pos) on which cash forbids all buys.
    """
    by_path, by_stock = Window.partitionBy("path").orderBy("pos"), Window.partitionBy("path", "stock_code").orderBy("pos")
    span = path_days.groupBy("path").agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))
    rebalances = path_days.where("rebalance").select("path", "model", "signal_date", "date", "pos", F.row_number().over(by_path).alias("_j"), F.lead("pos").over(by_path).alias("_next"))
    orders = rebalances.join(desired.select("model", "signal_date", "stock_code").distinct(), ["model", "signal_date"]).select("path", "stock_code", "date", "pos", "_j", "_next")
    held_before = None
    if opening is not None:
        held_before = opening.holdings.join(span, "path").select("path", "stock_code", F.lit(None).cast("date").alias("date"), F.col("entry_pos").alias("pos"), F.lit(0).alias("_j"), F.col("_first").alias("_next"))
    every = orders if held_before is None else orders.unionByName(held_before)
    # Dropped: there is a next rebalance, and the stock isn't desired there.
    later = every.select("path", "stock_code", "_j", "_next", F.lead("_j").over(by_stock).alias("_again"), F.lead("pos").over(by_stock).alias("_until"))
    drops = later.where("_next is not null and coalesce(_again > _j + 1, true)").join(span, "path")
    drops = drops.select("path", "stock_code", F.col("_next").alias("from_pos"), F.coalesce(F.col("_until") - 1, "_last").alias("to_pos"))
    sellable = rules.where("sell_reason is null").join(by_day(path_calendar(path_days)), "date").select("stock_code", "pos", F.col("pos").alias("_sold"))
    none = F.lit(None).cast("long")
    seen = sellable.select("stock_code", "pos", "_sold", F.lit(None).cast("string").alias("path"), none.alias("from_pos"), none.alias("to_pos")).unionByName(drops.select("stock_code", F.col("from_pos").alias("pos"), none.alias("_sold"), "path", "from_pos", "to_pos"))
    # From the end of time backwards, so that the least so far is the next; a day sees itself.
    ahead = Window.partitionBy("stock_code").orderBy(F.desc("pos")).rangeBetween(Window.unboundedPreceding, 0)
    drops = seen.withColumn("_sale", F.min("_sold").over(ahead)).where("path is not null").withColumn("_sale", F.when(F.col("_sale") <= F.col("to_pos"), F.col("_sale")))
    asked = orders.join(rules.select("date", "stock_code", "buy_reason", F.lit(True).alias("_known")), ["date", "stock_code"], "left")
    asked = asked.withColumn("buy_reason", F.when(F.col("_known"), F.col("buy_reason")).otherwise("no_price_record"))  # what the market doesn't list can't be traded
    if blocks is not None:
        asked = asked.join(blocks.select("path", "pos", F.lit(True).alias("_cash")), ["path", "pos"], "left")
    else:
        asked = asked.withColumn("_cash", F.lit(False))
    asked = asked.withColumn("cash_block", flag("_cash", False))
    columns = ("path", "stock_code", "pos", "kind", "event", "buy_reason", "cash_block", "from_pos", "to_pos")
    x = asked.withColumn("kind", F.lit("order")).withColumn("event", F.when(F.col("buy_reason").isNull() & ~F.col("cash_block"), 1)).withColumn("from_pos", none).withColumn("to_pos", none).select(*columns)
    rest = [drops.select("path", "stock_code", F.coalesce("_sale", "from_pos").alias("pos"), F.lit("drop").alias("kind"), F.when(F.col("_sale").isNotNull(), 0).alias("event"), "from_pos", "to_pos")]
    if held_before is not None:
        rest.append(held_before.select("path", "stock_code", "pos", F.lit("open").alias("kind"), F.lit(1).alias("event"), none.alias("from_pos"), none.alias("to_pos")))
    for more in rest:
        x = x.unionByName(more.withColumn("buy_reason", F.lit(None).cast("string")).withColumn("cash_block", F.lit(False)).select(*columns))
    before = F.last("event", ignorenulls=True).over(by_stock.rowsBetween(Window.unboundedPreceding, -1))
    return x.withColumn("was_held", F.coalesce(before, F.lit(0)) == 1)


def intervals(turned: DataFrame, path_days: DataFrame) -> DataFrame:
    """path, stock_code, episode, entry_pos, exit_pos (null if still held), first_pos, last_pos: what is held, as intervals.

    From first_pos (the entry, or the path's first day) to last_pos (the sale, or the path's last day).
    """
    w = Window.partitionBy("path", "stock_code").orderBy("pos")
    changes = turned.where("event is not null and (event = 1) <> was_held").withColumn("exit_pos", F.lead("pos").over(w)).where("event = 1")
    span = path_days.groupBy("path").agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))
    x = changes.withColumn("episode", F.row_number().over(w).cast("long")).join(span, "path")
    return x.select("path", "stock_code", "episode", F.col("pos").alias("entry_pos"), "exit_pos", F.greatest("pos", "_first").alias("first_pos"), F.coalesce("exit_pos", "_last").alias("last_pos"))


def holding_episodes(turned: DataFrame, path_days: DataFrame) -> DataFrame:
    """path, stock_code, episode, entry_date, entry_pos, exit_date (null if still held), last_pos."""
    days = by_day(path_calendar(path_days))
    x = intervals(turned, path_days).join(days.toDF("entry_date", "entry_pos"), "entry_pos", "left").join(days.toDF("exit_date", "exit_pos"), "exit_pos", "left")
    return x.select("path", "stock_code", "episode", "entry_date", "entry_pos", "exit_date", "last_pos")


def holding_latch(path_days: DataFrame, desired: DataFrame, rules: DataFrame) -> DataFrame:
    """The dense view of the turns: path, date, pos, stock_code, desired, rebalance, reasons, held, was_held for every day and every stock that a path ever desires.

    For inspection; nothing else reads it.
    """
    wanted = desired.select("model", "signal_date", "stock_code").distinct()
    ever = path_days.select("path", "model", "signal_date").distinct().join(wanted, ["model", "signal_date"]).select("path", "stock_code").distinct()
    x = path_days.join(ever, "path").join(wanted.withColumn("_d", F.lit(True)), ["model", "signal_date", "stock_code"], "left")
    x = x.join(rules.withColumn("_known", F.lit(True)), ["date", "stock_code"], "left")
    for c in ("buy_reason", "sell_reason"):
        x = x.withColumn(c, F.when(F.col("_known"), F.col(c)).otherwise("no_price_record"))
    held = intervals(turns(path_days, desired, rules), path_days).select("path", "stock_code", "entry_pos", "exit_pos", F.explode(F.sequence("first_pos", "last_pos")).alias("pos"))
    # A sale and a new entry of one stock are never on one day.
    held = held.select("path", "stock_code", "pos", (~F.col("pos").eqNullSafe(F.col("exit_pos"))).alias("_held"), (F.col("pos") > F.col("entry_pos")).alias("_was"))
    x = x.join(held, ["path", "stock_code", "pos"], "left")
    return x.select("path", "date", "pos", "stock_code", flag("_d", False).alias("desired"), "rebalance", "buy_reason", "sell_reason", flag("_held", False).alias("held"), flag("_was", False).alias("was_held"))


def mark_price() -> Column:
    """The adjusted open where the stock has a record, isn't suspended and has a positive price."""
    return F.when(flag("has_price_record", False) & ~flag("is_suspended", True) & (F.col("post_open") > 0), F.col("post_open"))


def carried_prices(panel: DataFrame, days: DataFrame, opening: Opening | None = None) -> DataFrame:
    """stock_code, pos, mark: each stock's last `mark_price` at or before each of the days (date, pos), worked out once for all paths."""
    prices = panel.select("date", "stock_code", mark_price().alias("mark")).where("mark is not null").join(by_day(days), "date").select("stock_code", "pos", "mark")
    if opening is not None:
        prices = opening.holdings.select("stock_code", F.col("mark_pos").alias("pos"), "mark").unionByName(prices).groupBy("stock_code", "pos").agg(F.max("mark").alias("mark"))
    last = days.agg(F.max("pos").alias("_last"))
    w = Window.partitionBy("stock_code").orderBy("pos")
    until = prices.withColumn("_next", F.lead("pos").over(w)).crossJoin(F.broadcast(last)).withColumn("_next", F.coalesce("_next", F.greatest(F.col("_last"), F.col("pos")) + 1))
    return until.select("stock_code", F.explode(F.sequence("pos", F.col("_next") - 1)).alias("pos"), "mark")


def carried_mark(held: DataFrame, prices: DataFrame, days: DataFrame, opening: Opening | None = None) -> DataFrame:
    """path, date, pos, stock_code, episode, entry_date, entry_pos, entry_price, mark, held, notional: every day of every interval, its last one included.

    prices: `carried_prices`; days: (date, pos). A stock that is bought has a price that day, so a carried
    mark never reaches back before the entry. notional: what an opening holding cost, else null.
    """
    days = by_day(days)
    x = held.join(prices.toDF("stock_code", "entry_pos", "_entry"), ["stock_code", "entry_pos"], "left").join(days.toDF("_entry_date", "entry_pos"), "entry_pos", "left")
    if opening is not None:
        own = opening.holdings.select("path", "stock_code", "entry_pos", "entry_date", "entry_price", "notional")
        x = x.join(own, ["path", "stock_code", "entry_pos"], "left").withColumn("_entry", F.coalesce("entry_price", "_entry")).withColumn("_entry_date", F.coalesce("entry_date", "_entry_date")).drop("entry_date", "entry_price")
    else:
        x = x.withColumn("notional", F.lit(None).cast("double"))
    x = x.withColumn("pos", F.explode(F.sequence("first_pos", "last_pos"))).join(prices, ["stock_code", "pos"], "left").join(days, "pos")
    kept = ~F.col("pos").eqNullSafe(F.col("exit_pos"))
    return x.select("path", "date", "pos", "stock_code", "episode", F.col("_entry_date").alias("entry_date"), "entry_pos", F.col("_entry").alias("entry_price"), "mark", kept.alias("held"), "notional")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def _step(terms: Terms) -> Callable[[Column, Column], Column]:
    """The account after one more day: (account, day) -> account."""
    none_left = lambda c: F.when(c <= NO_CASH, 0.0).otherwise(c)

    def step(a: Column, x: Column) -> Column:
        # What is held before the day's trades is what was held after the day before: both lists have the same entries, in order.
        joined = F.zip_with(x["entries"], a["amounts"], lambda e, s: F.struct(e["entry"].alias("entry"), s["n"].alias("n"), e["worth"].alias("worth"), e["sold"].alias("sold"), e["n_sold"].alias("n_sold"), e["n_left"].alias("n_left")))
        total = lambda rows, c: F.aggregate(rows, F.lit(0.0), lambda t, e: t + e["n"] * e[c])

        def valued(rows: Column) -> Column:
            return _let(F.struct((a["cash"] + total(rows, "worth")).alias("before"), total(rows, "sold").alias("sold")), lambda v: traded(rows, v))

        def traded(rows: Column, v: Column) -> Column:
            cash, ask = none_left(a["cash"] + v["sold"] * (1 - terms.sell_cost)), v["before"] / terms.k
            wanted = F.when(x["blocked"], 0).otherwise(x["wants"])
            scale = lambda c: F.when((wanted > 0) & (ask > 0), F.least(F.lit(1.0), c / (wanted * ask * (1 + terms.buy_cost)))).otherwise(0.0)
            return _let(cash, lambda c: _let(F.struct(c.alias("cash"), scale(c).alias("scale"), wanted.alias("wanted"), ask.alias("ask")), lambda t: settled(rows, v, t)))

        def settled(rows: Column, v: Column, t: Column) -> Column:
            spent = (t["wanted"] > 0) & (t["scale"] <= 0)
            return _let(F.struct(spent.alias("spent"), F.when(spent, 0).otherwise(t["wanted"]).alias("buys"), F.when(spent, 0.0).otherwise(t["ask"] * t["scale"]).alias("each")), lambda u: entered(rows, v, t, u))

        def entered(rows: Column, v: Column, t: Column, u: Column) -> Column:
            bought = u["buys"] * u["each"]
            sell_cost, buy_cost = v["sold"] * terms.sell_cost, bought * terms.buy_cost
            cash = none_left(t["cash"] - bought - buy_cost)
            left = F.transform(F.filter(rows, lambda e: e["n_left"] > 0), lambda e: F.struct(e["entry"].alias("entry"), e["n"].alias("n")))
            # Who wanted but couldn't buy stays in the lists with no amount, until the turns are worked out again.
            amounts = F.when(t["wanted"] > 0, F.concat(left, F.array(F.struct(x["pos"].alias("entry"), u["each"].alias("n"))))).otherwise(left)
            # 0: no such day yet; 1: cash is spent and nothing sold since; 2: later days aren't known.
            state = F.when((a["state"] == 0) & u["spent"], 1).when((a["state"] == 1) & (v["sold"] > 0), 2).otherwise(a["state"])
            count = lambda c: F.aggregate(rows, F.lit(0).cast("long"), lambda n, e: n + e[c])
            row = F.struct(
                x["date"].alias("date"), x["pos"].alias("pos"), x["rebalance"].alias("rebalance"), v["before"].alias("pre_nav"), (v["before"] - sell_cost - buy_cost).alias("nav"), cash.alias("cash"), v["sold"].alias("sold"), bought.alias("bought"),
                sell_cost.alias("sell_cost"), buy_cost.alias("buy_cost"), count("n_sold").alias("n_sells"), u["buys"].alias("n_buys"), F.when(u["spent"], 0.0).otherwise(t["scale"]).alias("scale"), u["each"].alias("notional"), (count("n_left") + u["buys"]).alias("n_held"),
                (x["blocked"] & (x["wants"] > 0)).alias("cash_blocked"), (state == 1).alias("new_block"),
            )
            return F.struct(cash.alias("cash"), amounts.alias("amounts"), state.alias("state"), F.concat(a["out"], F.array(row)).alias("out"))

        return _let(joined, valued)

    return step


NAV_COLUMNS = ["path", "date", "pos", "rebalance", "pre_nav", "nav", "cash", "sold", "bought", "sell_cost", "buy_cost", "n_sells", "n_buys", "scale", "notional", "n_held", "cash_blocked"]
_ROW = "struct<date:date,pos:bigint,rebalance:boolean,pre_nav:double,nav:double,cash:double,sold:double,bought:double,sell_cost:double,buy_cost:double,n_sells:bigint,n_buys:bigint,scale:double,notional:double,n_held:bigint,cash_blocked:boolean,new_block:boolean>"
_ENTRY = "struct<entry:bigint,worth:double,sold:double,n_sold:bigint,n_left:bigint>"


def nav_recurrence(path_days: DataFrame, turned: DataFrame, marks: DataFrame, terms: Terms, blocks: DataFrame | None = None, opening: Opening | None = None) -> DataFrame:
    """The cash account of each path, a row a day: `NAV_COLUMNS` and new_block.

    A fold in the JVM over a row a path that holds its days, each with a sum for every entry day that is
    still held; stocks are summed before. notional is what each buy of a day got. new_block: cash forbids
    the day's buys, and `blocks` (path, pos) didn't know; from the first such day on the path must be worked out again.
    """
    before = marks.where("pos > entry_pos")
    worth = F.col("mark") / F.col("entry_price")
    sums = before.groupBy("path", "pos", F.col("entry_pos").alias("entry")).agg(F.sum(worth).alias("worth"), F.coalesce(F.sum(F.when(~F.col("held"), worth)), F.lit(0.0)).alias("sold"), F.count_if(~F.col("held")).alias("n_sold"), F.count_if("held").alias("n_left"))
    entries = sums.groupBy("path", "pos").agg(F.array_sort(F.collect_list(F.struct("entry", "worth", "sold", "n_sold", "n_left"))).alias("entries"))
    wants = turned.where("kind = 'order' and not was_held and buy_reason is null").groupBy("path", "pos").agg(F.count(F.lit(1)).alias("wants"))
    x = path_days.select("path", "date", "pos", "rebalance").join(entries, ["path", "pos"], "left").join(wants, ["path", "pos"], "left")
    if blocks is not None:
        x = x.join(blocks.select("path", "pos", F.lit(True).alias("_block")), ["path", "pos"], "left")
    else:
        x = x.withColumn("_block", F.lit(False))
    day = F.struct("pos", "date", "rebalance", F.coalesce("entries", F.array().cast(f"array<{_ENTRY}>")).alias("entries"), F.coalesce("wants", F.lit(0)).cast("long").alias("wants"), flag("_block", False).alias("blocked"))
    days = x.groupBy("path").agg(F.array_sort(F.collect_list(day)).alias("days"))
    nothing = F.array().cast("array<struct<entry:bigint,n:double>>")
    if opening is None:
        days = days.withColumn("_cash", F.lit(1.0)).withColumn("_amounts", nothing)
    else:
        # One amount a path and entry day, whatever the stocks.
        one = opening.holdings.groupBy("path", "entry_pos").agg(F.max("notional").alias("n"))
        amounts = one.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(F.col("entry_pos").alias("entry"), "n"))).alias("_held"))
        days = days.join(opening.cash.select("path", F.col("cash").alias("_opening")), "path", "left").join(amounts, "path", "left").withColumn("_cash", F.coalesce("_opening", F.lit(1.0))).withColumn("_amounts", F.coalesce("_held", nothing))
    # Folded in blocks of days, as a step copies what its block has put out so far.
    rows, step = F.array().cast(f"array<{_ROW}>"), _step(terms)
    account = lambda a, out: F.struct(a["cash"].alias("cash"), a["amounts"].alias("amounts"), a["state"].alias("state"), out.alias("out"))

    def block(a: Column, own: Column) -> Column:
        return _let(F.aggregate(own, account(a, rows), step), lambda r: account(r, F.concat(a["out"], F.array(r["out"]))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("days") - 1) / BLOCK_DAYS).cast("int")), lambda b: F.slice("days", b * BLOCK_DAYS + 1, BLOCK_DAYS))
    start = F.struct(F.col("_cash").alias("cash"), F.col("_amounts").alias("amounts"), F.lit(0).alias("state"), F.array().cast(f"array<array<{_ROW}>>").alias("out"))
    return days.select("path", F.inline(F.flatten(F.aggregate(blocks, start, block, lambda a: a["out"])))).select(*NAV_COLUMNS, "new_block")


@dataclass
class Ledger:
    path_days: DataFrame
    turns: DataFrame
    marks: DataFrame
    nav: DataFrame
    rules: DataFrame


def simulate(path_days: DataFrame, desired: DataFrame, panel: DataFrame, terms: Terms, opening: Opening | None = None) -> Ledger:
    """Turns, marks and account of all paths, worked out again for paths on which spent cash forbids buys until no such day is new."""
    with Temporary(panel.sparkSession) as temporary:
        ledger = _simulated(materialize(path_days, "paths"), desired, panel, terms, opening)
        temporary.keep(ledger.path_days, ledger.turns, ledger.marks, ledger.nav, ledger.rules)
    return ledger


MARKET = ("date", "stock_code", "has_price_record", "is_suspended", "is_st", "listing_days", "raw_open", "post_open", "limit_up", "limit_down")


def _simulated(path_days: DataFrame, desired: DataFrame, panel: DataFrame, terms: Terms, opening: Opening | None) -> Ledger:
    desired = materialize(desired.select("model", "signal_date", "stock_code"), "desired")
    named = desired.select("stock_code")
    if opening is not None:
        named = named.unionByName(opening.holdings.select("stock_code"))
    days = path_calendar(path_days)
    market = panel.select(*MARKET).join(by_day(days.select("date")), "date", "left_semi").join(named.distinct(), "stock_code", "left_semi")
    rules = materialize(market.select("date", "stock_code", sell_rule().alias("sell_reason"), buy_rule(terms.min_listing_days).alias("buy_reason"), *[c for c in MARKET if c not in ("date", "stock_code")]), "rules")
    prices = materialize(carried_prices(rules, days, opening), "prices")

    def worked_out(own_days: DataFrame, blocks: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        turned = materialize(turns(own_days, desired, rules, blocks, opening), "turns")
        marks = materialize(carried_mark(intervals(turned, own_days), prices, days, opening), "marks")
        return turned, marks, materialize(nav_recurrence(own_days, turned, marks, terms, blocks, opening), "nav")

    turned, marks, nav = worked_out(path_days, None)
    blocks = None
    while not (found := nav.where("new_block")).isEmpty():
        new = found.select("path", "pos")
        blocks = materialize(new if blocks is None else blocks.unionByName(new), "blocks")
        again = materialize(new.select("path").distinct(), "again")
        anew = worked_out(path_days.join(again, "path", "left_semi"), blocks)
        turned, marks, nav = (materialize(old.join(again, "path", "left_anti").unionByName(x), name) for old, x, name in zip((turned, marks, nav), anew, ("turns", "marks", "nav"), strict=True))
    return Ledger(path_days, turned, marks, nav, rules)


def trade_ledger(ledger: Ledger, terms: Terms) -> DataFrame:
    """Every attempted order: path, date, stock_code, side, status, reason, gross_notional, cost, units.

    A sale is attempted on every day that a held stock isn't desired, a buy on rebalance days for a
    desired stock that isn't held; what is held and desired never trades.
    """
    days = by_day(path_calendar(ledger.path_days))
    drops = ledger.turns.where("kind = 'drop' and was_held").withColumn("_sale", F.when(F.col("event") == 0, F.col("pos"))).drop("pos")
    tried = drops.select("path", "stock_code", "_sale", F.explode(F.sequence("from_pos", F.coalesce("_sale", "to_pos"))).alias("pos")).join(days, "pos")
    tried = tried.join(ledger.rules.select("date", "stock_code", "sell_reason", F.lit(True).alias("_known")), ["date", "stock_code"], "left")
    sell = tried.select("path", "date", "pos", "stock_code", F.lit("sell").alias("side"), F.when(F.col("_known"), F.col("sell_reason")).otherwise("no_price_record").alias("reason"), F.when(F.col("pos").eqNullSafe(F.col("_sale")), "filled").otherwise("blocked").alias("status"))
    why = F.coalesce("buy_reason", F.when(F.col("cash_block"), F.lit("cash")))
    buy = ledger.turns.where("kind = 'order' and not was_held").join(days, "pos").select("path", "date", "pos", "stock_code", F.lit("buy").alias("side"), F.when(F.col("event") == 1, F.lit(None)).otherwise(why).alias("reason"), F.when(F.col("event") == 1, "filled").otherwise("blocked").alias("status"))
    out = sell.unionByName(buy).join(priced(ledger).select("path", "pos", "stock_code", "entry_price", "mark", "notional"), ["path", "pos", "stock_code"], "left")
    filled = F.col("status") == "filled"
    units = F.when(filled, ratio("notional", "entry_price"))
    gross = units * F.when(F.col("side") == "sell", F.col("mark")).otherwise(F.col("entry_price"))
    cost = gross * F.when(F.col("side") == "sell", terms.sell_cost).otherwise(terms.buy_cost)
    return out.select("path", "date", "stock_code", "side", "status", "reason", gross.alias("gross_notional"), cost.alias("cost"), units.alias("units"))


def priced(ledger: Ledger) -> DataFrame:
    """The marks with what each holding cost: an opening holding's own notional, else its entry day's."""
    entry = ledger.nav.select("path", F.col("pos").alias("entry_pos"), F.col("notional").alias("_paid"))
    return ledger.marks.join(entry, ["path", "entry_pos"], "left").withColumn("notional", F.coalesce("notional", "_paid")).drop("_paid")


def daily_nav(nav: DataFrame) -> DataFrame:
    """nav with gross_return, net_return, cash_ratio and turnover of each day."""
    before = F.coalesce(F.lag("nav").over(Window.partitionBy("path").orderBy("pos")), F.lit(1.0))
    return nav.select(
        "path", "date", "pos", "rebalance", "pre_nav", "nav", "cash", "n_buys", "n_sells", "n_held", (ratio("pre_nav", before) - 1).alias("gross_return"), (ratio("nav", before) - 1).alias("net_return"), ratio("cash", "nav").alias("cash_ratio"),
        ratio(F.col("sold") + F.col("bought"), "pre_nav").alias("turnover"), (F.col("sell_cost") + F.col("buy_cost")).alias("cost"),
    )


def positions(ledger: Ledger) -> DataFrame:
    """path, date, stock_code, entry_date, units, mark, value of everything held after each day's trades."""
    units = ratio("notional", "entry_price")
    return priced(ledger).where("held").select("path", "date", "stock_code", "entry_date", units.alias("units"), "mark", (units * F.col("mark")).alias("value"))


def ending_positions(ledger: Ledger) -> DataFrame:
    """The last day's positions of each path and its cash as stock CASH."""
    last = ledger.nav.groupBy("path").agg(F.max("date").alias("date"), F.max_by("cash", "date").alias("value"))
    held = positions(ledger).join(last.select("path", "date"), ["path", "date"]).select("path", "date", "stock_code", "units", "value")
    return held.unionByName(last.select("path", "date", F.lit("CASH").alias("stock_code"), F.lit(None).cast("double").alias("units"), "value"))


def strategy_summary(daily: DataFrame, trades: DataFrame | None = None, year: int = 252) -> DataFrame:
    """One row a path: growth, risk, costs, turnover and fills."""
    w = Window.partitionBy("path").orderBy("pos")
    top = F.greatest(F.lit(1.0), F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = daily.withColumn("_dd", F.col("nav") / top - 1)
    g = x.groupBy("path").agg(
        F.count(F.lit(1)).alias("days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max_by("nav", "pos").alias("ending_nav"), F.avg("net_return").alias("mean_return"), F.stddev_samp("net_return").alias("_s"),
        F.min("_dd").alias("_low"), F.sum("cost").alias("total_cost"), F.avg("turnover").alias("mean_turnover"), F.avg("cash_ratio").alias("mean_cash_ratio"), F.avg("n_held").alias("mean_held"), F.sum("n_buys").alias("buys"), F.sum("n_sells").alias("sells"),
        F.count_if("rebalance").alias("rebalances"), F.avg((F.round("net_return", 12) > 0).cast("double")).alias("win_rate"), F.max("net_return").alias("best_day"), F.min("net_return").alias("worst_day"),
    )
    annual = F.pow("ending_nav", F.lit(float(year)) / F.col("days")) - 1
    vol = F.col("_s") * F.sqrt(F.lit(float(year)))
    out = g.select(
        "path", "days", "first_date", "last_date", "ending_nav", (F.col("ending_nav") - 1).alias("total_return"), annual.alias("annualized_return"), vol.alias("annualized_volatility"), ratio(F.col("mean_return") * year, vol).alias("sharpe_ratio"),
        (-F.least(F.lit(0.0), F.col("_low"))).alias("max_drawdown"), "total_cost", (F.col("mean_turnover") * year).alias("annualized_turnover"), "mean_cash_ratio", "mean_held", "buys", "sells", "rebalances", "win_rate", "best_day", "worst_day",
    )
    if trades is None:
        return out
    side = lambda s, st: F.count_if((F.col("side") == s) & (F.col("status") == st))
    fills = trades.groupBy("path").agg(
        ratio(side("buy", "filled"), F.count_if(F.col("side") == "buy")).alias("buy_fill_rate"), ratio(side("sell", "filled"), F.count_if(F.col("side") == "sell")).alias("sell_fill_rate"), side("buy", "blocked").alias("blocked_buys"), side("sell", "blocked").alias("blocked_sells"),
        F.count_distinct(F.when((F.col("side") == "sell") & (F.col("status") == "blocked"), F.col("date"))).alias("blocked_sale_days"), F.count_if((F.col("side") == "buy") & (F.col("reason") == "cash")).alias("cash_blocked_buys"),
    )
    return out.join(fills, "path", "left")


def offset_summary(metrics: DataFrame, columns: Sequence[str]) -> DataFrame:
    """model, metric, mean, median, std, min, max over a model's offsets; metrics: strategy_summary's rows."""
    long = metrics.select(F.substring_index("path", ":", 1).alias("model"), F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in columns])))
    return long.groupBy("model", "metric").agg(F.avg("x").alias("mean"), F.median("x").alias("median"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))


def average_nav(daily: DataFrame) -> DataFrame:
    """model, date, nav, cash, cash_ratio, net_return, paths: means over a model's paths on dates common to all of them."""
    x = daily.withColumn("model", F.substring_index("path", ":", 1))
    paths_of = x.groupBy("model").agg(F.count_distinct("path").alias("paths"))
    g = x.groupBy("model", "date").agg(F.avg("nav").alias("nav"), F.avg("cash").alias("cash"), F.count(F.lit(1)).alias("_n")).join(paths_of, "model").where("_n = paths")
    before = F.lag("nav").over(Window.partitionBy("model").orderBy("date"))
    return g.select("model", "date", "nav", "cash", ratio("cash", "nav").alias("cash_ratio"), (ratio("nav", before) - 1).alias("net_return"), "paths")


def strategy_comparison(a: DataFrame, b: DataFrame, columns: Sequence[str], names: tuple[str, str] = ("daily", "staggered")) -> DataFrame:
    """model and, for each column, both sides and their difference; a, b: (model, columns)."""
    x = a.select("model", *[F.col(c).alias(f"{names[0]}_{c}") for c in columns]).join(b.select("model", *[F.col(c).alias(f"{names[1]}_{c}") for c in columns]), "model", "full")
    return x.select("*", *[(F.col(f"{names[1]}_{c}") - F.col(f"{names[0]}_{c}")).alias(f"difference_{c}") for c in columns])
