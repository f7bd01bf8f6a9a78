"""Latch, marks and fold against a loop over days, on random markets with blocked and tight trades."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from crossgrain.operators import ledger as P
from crossgrain.operators.calendar import calendar_index

DAYS, STOCKS = 40, 8


def market(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(STOCKS):
        price = 10.0
        for d in range(DAYS):
            price *= float(np.exp(rng.normal(0, 0.08)))
            rows.append((dt.date(2024, 1, 1) + dt.timedelta(d), f"S{s}", bool(rng.random() > 0.05), bool(rng.random() < 0.1), bool(rng.random() < 0.05), 100.0, price, price, price * (1.0 if rng.random() < 0.1 else 1.1), price * (1.0 if rng.random() < 0.1 else 0.9)))
    scores = [("m", dt.date(2024, 1, 1) + dt.timedelta(d), f"S{s}", float(rng.integers(0, 50))) for d in range(DAYS) for s in range(STOCKS)]
    return rows, scores


def naive(rows, scores, terms, offset):
    by = {(r[0], r[1]): r for r in rows}
    dates = sorted({r[0] for r in rows})
    top = {d: [s for _, s in sorted((-x[3], x[2]) for x in scores if x[1] == d)][: terms.k] for d in dates}
    signals = {dates[i + 1]: dates[i] for i in range(offset, len(dates) - terms.step - 1, terms.step)}
    first, last = min(signals), dates[max(dates.index(s) for s in signals.values()) + terms.step + 1]
    cash, held, want, out = 1.0, {}, [], []
    for d in dates:
        if not first <= d <= last:
            continue
        rebalance = d in signals
        want = top[signals[d]] if rebalance else want
        ok = lambda r: r[2] and not r[3]
        for s, h in held.items():
            r = by[d, s]
            h["mark"] = r[7] if ok(r) else h["mark"]
        before = cash + sum(h["units"] * h["mark"] for h in held.values())
        for s in [s for s in held if s not in want]:
            r = by[d, s]
            if ok(r) and r[6] > r[9] + 1e-8:
                cash += held.pop(s)["units"] * r[7] * (1 - terms.sell_cost)
        cash = 0.0 if cash <= 1e-12 else cash
        if rebalance:
            buys = [s for s in want if s not in held and ok(r := by[d, s]) and not r[4] and r[8] > r[9] and r[6] < r[8] - 1e-8 and r[6] > r[9] + 1e-8]
            ask = before / terms.k
            scale = min(1.0, cash / (len(buys) * ask * (1 + terms.buy_cost))) if buys else 0.0
            for s in buys if scale > 0 else []:
                held[s] = {"units": ask * scale / by[d, s][7], "mark": by[d, s][7]}
            if scale > 0:
                cash -= len(buys) * ask * scale * (1 + terms.buy_cost)
            cash = 0.0 if cash <= 1e-12 else cash
        out.append((d, cash + sum(h["units"] * h["mark"] for h in held.values()), frozenset(held)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_ledger_equals_loop(spark, seed):
    rows, scores = market(seed)
    terms = P.Terms(k=3, min_listing_days=5, step=4)
    panel = spark.createDataFrame(rows, "date date, stock_code string, has_price_record boolean, is_suspended boolean, is_st boolean, listing_days double, raw_open double, post_open double, limit_up double, limit_down double").cache()
    s = spark.createDataFrame(scores, "model string, date date, stock_code string, score double").cache()
    c = calendar_index(panel).cache()
    desired = P.desired_set(s, c, terms.k)
    book = P.simulate(P.paths(P.active_desired(P.offset_schedule(c, terms.step), c), s.select("model").distinct()), desired, panel, terms)
    nav = {(r.path, r.date): r.nav for r in book.nav.collect()}
    held: dict = {}
    for r in P.positions(book).collect():
        held.setdefault((r.path, r.date), set()).add(r.stock_code)
    for offset in range(terms.step):
        for d, value, members in naive(rows, scores, terms, offset):
            key = (f"m:{offset}", d)
            assert held.get(key, set()) == members, (key, members)
            assert abs(nav[key] - value) < 1e-9, (key, nav[key], value)
    trades = P.trade_ledger(book, terms)
    assert trades.where("side = 'buy' and status = 'filled'").count() == sum(r.n_buys for r in book.nav.collect())
    summary = P.strategy_summary(P.daily_nav(book.nav), trades).collect()
    assert len(summary) == terms.step and all(0 <= r.max_drawdown < 1 for r in summary)
    average = P.average_nav(P.daily_nav(book.nav))
    assert average.count() > 0 and {r.paths for r in average.collect()} == {terms.step}
    ending = P.ending_positions(book).groupBy("path").sum("value").collect()
    last = {p: v for (p, d), v in sorted(nav.items(), key=lambda x: x[0][1])}
    assert all(abs(r[1] - last[r.path]) < 1e-9 for r in ending)
