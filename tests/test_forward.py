"""A forward run that is cut at any date and resumed equals the whole run, and reads new dates only."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from test_ledger import market

from crossgrain.operators import ledger as P
from crossgrain.operators.calendar import calendar_index
from crossgrain.plans.forward import ForwardRun, staggered

PANEL = "date date, stock_code string, has_price_record boolean, is_suspended boolean, is_st boolean, listing_days double, raw_open double, post_open double, limit_up double, limit_down double"
DAY = dt.date(2024, 1, 1)


def rounded(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize(("seed", "cuts"), [(3, (9, 22, 31, 39)), (4, (17, 18, 39))])
def test_cut_and_resumed_run_equals_the_whole(spark, seed, cuts):
    rows, scores = market(seed)
    terms = P.Terms(k=3, min_listing_days=5, step=4)
    panel = spark.createDataFrame(rows, PANEL).cache()
    s = spark.createDataFrame(scores, "model string, date date, stock_code string, score double").cache()
    c = calendar_index(panel).cache()
    read = []

    def dated(df, what):
        def rows_of(first, last):
            read.append((what, first, last))
            return df.where(F.col("date").between(F.lit(first), F.lit(last)))

        return rows_of

    whole, parts = (ForwardRun(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/run") for _ in range(2))
    last = DAY + dt.timedelta(cuts[-1])
    every = whole.advance(dated(s, "scores"), dated(panel, "market"), c, terms, last)
    assert len(every) == 40 - terms.step - 1 and whole.advance(dated(s, "scores"), dated(panel, "market"), c, terms, last) == []
    read.clear()
    done = []
    for cut in cuts:
        new = parts.advance(dated(s, "scores"), dated(panel, "market"), c, terms, DAY + dt.timedelta(cut))
        assert new == every[len(done) : len(done) + len(new)]
        done += new
    assert done == every
    for name in ("nav", "trades", "snapshot", "scores", "closing"):
        assert rounded(whole.table(name)) == rounded(parts.table(name)), name
    assert rounded(whole.nav()) == rounded(parts.nav()) and whole.table("trades").where("side = 'sell'").count() > 5
    # Scores and market of new signals only: each read begins after the last published signal.
    signals = [first for what, first, _ in read if what == "scores"]
    markets = [first for what, first, _ in read if what == "market"]
    assert signals == [d for d in every if d in signals] and len(set(signals)) == len(signals)
    assert all(m == d + dt.timedelta(1) for m, d in zip(markets, signals, strict=True))
    # The same as one ledger over everything.
    book = staggered(s, panel, c, terms)
    assert rounded(book.nav.select(*P.NAV_COLUMNS)) == rounded(whole.nav())


def test_a_repeated_run_changes_no_file(spark):
    rows, scores = market(5)
    terms = P.Terms(k=2, min_listing_days=3, step=5)
    panel, s = spark.createDataFrame(rows, PANEL), spark.createDataFrame(scores, "model string, date date, stock_code string, score double")
    c = calendar_index(panel)
    dated = lambda df: lambda first, last: df.where(F.col("date").between(F.lit(first), F.lit(last)))
    run = ForwardRun(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/run")
    files = lambda: sorted((os.path.join(d, f), os.path.getmtime(os.path.join(d, f))) for d, _, fs in os.walk(run.folder) for f in fs if "signal_date=" in d)
    assert run.nav().count() == 0 and run.last_signal() is None
    run.advance(dated(s), dated(panel), c, terms, DAY + dt.timedelta(25))
    before = files()
    assert run.advance(dated(s), dated(panel), c, terms, DAY + dt.timedelta(25)) == [] and files() == before
    assert len(run.advance(dated(s), dated(panel), c, terms, DAY + dt.timedelta(27))) == 2
    assert [f for f in files() if f in before] == before  # old periods stay as they are
