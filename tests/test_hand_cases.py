"""Small frames worked out by hand, and cross-checks against numpy on random ones."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from crossgrain.functions.columns import average_rank, by_day, correlation, one_row, rank_percentile
from crossgrain.operators import calendar, contracts, cross_section, evaluation, factor_stats, factors, labels
from crossgrain.sources import tables

D = dt.date(2024, 1, 2)


def day(spark, values, **more):
    rows = [(D, f"S{i}", None if v is None else float(v), *(c[i] for c in more.values())) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "date date, stock_code string, v double" + "".join(f", {k} {'string' if isinstance(c[0], str) else 'double'}" for k, c in more.items()))


def listed(df, column):
    return [r[0] for r in df.orderBy("stock_code").select(column).collect()]


@pytest.mark.parametrize(("values", "want"), [((-0.1, 0.0, 0.2), [0, 0.5, 1]), ((0.0, 0.0, 0.2), [0.25, 0.25, 1]), ((0.0, None, 0.2), [0, None, 1]), ((0.3,), [None])])
def test_rank_percentile(spark, values, want):
    assert listed(day(spark, values).withColumn("r", rank_percentile("v", "date")), "r") == want


def test_mad_of_zero_leaves_values_unchanged(spark):
    assert listed(cross_section.mad_winsorize(day(spark, (1, 1, 1, 9)), "v", "w"), "w") == [1, 1, 1, 9]


def test_zscore_of_constants(spark):
    df = day(spark, (2, 2, 2))
    assert listed(df.withColumn("z", cross_section.zscore("v")), "z") == [None] * 3
    assert listed(df.withColumn("z", cross_section.zscore_population("v")), "z") == [0.0] * 3


def test_quantiles_need_enough_rows(spark):
    assert listed(day(spark, range(9)).withColumn("q", cross_section.assign_quantiles("v", 10)), "q") == [None] * 9


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "x double, y double")
    assert df.agg(correlation("x", "y")).first()[0] is None


def test_neutralize_equals_least_squares(spark):
    rng = np.random.default_rng(3)
    n, names = 60, np.array(["a", "b", "c"])
    industry, cap, y = names[rng.integers(0, 3, n)], np.exp(rng.normal(10, 1, n)), rng.normal(size=n)
    got = cross_section.neutralize(day(spark, y, industry=list(map(str, industry)), market_cap=list(map(float, cap))), "v", "e")
    x = np.column_stack([np.log(cap), *(industry == i for i in names)])
    e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    want = dict(zip([f"S{i}" for i in range(n)], (e - e.mean()) / e.std(ddof=1), strict=True))
    assert all(abs(want[r.stock_code] - r.e) < 1e-9 for r in got.collect())


def test_quantiles_equal_pandas(spark):
    import pandas as pd

    for n in (7, 23, 61):
        v = np.random.default_rng(n).normal(size=n)
        got = {r.stock_code: r.q for r in day(spark, v).withColumn("q", cross_section.assign_quantiles("v", 5)).collect()}
        want = pd.qcut(pd.Series(v).rank(method="first"), 5, labels=False) + 1
        assert [got[f"S{i}"] for i in range(n)] == want.tolist()


def test_hac_equals_formula(spark):
    x, lag = np.random.default_rng(5).normal(0.1, 1, 80), 4
    df = spark.createDataFrame([("m", D + dt.timedelta(i), float(v)) for i, v in enumerate(x)], "model string, date date, v double")
    r = evaluation.hac_mean_test(df, "v", lag).first()
    e = x - x.mean()
    s = e @ e + 2 * sum((1 - j / (lag + 1)) * (e[j:] @ e[:-j]) for j in range(1, lag + 1))
    assert abs(r.se - np.sqrt(s) / len(x)) < 1e-12 and abs(r.mean - x.mean()) < 1e-12


def test_kendall_tau_equals_pairs(spark):
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 9, 40), rng.integers(0, 9, 40)
    df = spark.createDataFrame([("m", D, f"S{i}", float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "model string, date date, stock_code string, score double, rank_target double")
    r = evaluation.pair_counts(df).first()
    pairs = [(i, j) for i in range(40) for j in range(i)]
    assert r.signed == sum(int(np.sign(a[i] - a[j]) * np.sign(b[i] - b[j])) for i, j in pairs)
    assert (r.pairs, r.tied_score, r.tied_target) == (len(pairs), sum(a[i] == a[j] for i, j in pairs), sum(b[i] == b[j] for i, j in pairs))


def panel(spark, closes):
    rows = [(D + dt.timedelta(p), p, s, c) for s, cs in closes.items() for p, c in enumerate(cs)]
    return spark.createDataFrame(rows, "date date, pos long, stock_code string, post_close double")


def test_ivol_of_short_windows_is_zero_or_null(spark):
    p = panel(spark, {"A": [1.0, 2.0, 3.0], "B": [1.0, None, 2.0]})
    market = spark.createDataFrame([(D + dt.timedelta(i), float(v)) for i, v in enumerate((1, 2, 3))], "date date, index_close double")
    assert {r.factor_value for r in factors.ivol_20d(p, market).collect()} == {0.0}
    assert factors.ivol_20d(p, market, compat=False).count() == 0


def test_padded_returns_are_zero_over_gaps(spark):
    got = factors.daily_returns(panel(spark, {"B": [1.0, None, 2.0]})).orderBy("pos").collect()
    assert [r.r for r in got] == [None, 0.0, 1.0]


def test_breadth_is_null_without_any_down_event(spark):
    reports = spark.createDataFrame([(D + dt.timedelta(i), "A", "I", 2024, float(i)) for i in range(4)], "date date, stock_code string, institute string, fiscal_year int, eps double")
    calendar = spark.createDataFrame([(D + dt.timedelta(i), i) for i in range(6)], "date date, pos long")
    assert factors.eps_revision_breadth_60d(reports, calendar).count() == 0


def test_exit_beyond_the_period_has_no_split(spark):
    calendar = spark.createDataFrame([(dt.date(2023, 12, 20) + dt.timedelta(i), i) for i in range(30)], "date date, pos long")
    rows = calendar.select("date", F.lit("A").alias("stock_code"), F.lit(0.1).alias("target_5d"))
    periods = {"train": ("2023-01-01", "2023-12-31"), "validation": ("2024-01-01", "2024-12-31")}
    got = {r.date: r.split_5 for r in labels.sample_index(rows, calendar, periods, [5], ("2023-01-01", "2024-12-31")).collect()}
    assert got[dt.date(2023, 12, 20)] == "train" and got[dt.date(2023, 12, 30)] is None and got[dt.date(2024, 1, 2)] == "validation"


def test_overlapping_periods_are_an_error():
    with pytest.raises(ValueError, match="overlap"):
        labels.base_period("date", {"a": ("2023-01-01", "2023-12-31"), "b": ("2023-06-01", "2024-12-31")})


def test_long_short_nav_with_a_total_loss(spark):
    rows = [(D + dt.timedelta(i), "v", 1, q, r) for i, pair in enumerate([(0.0, 0.5), (0.0, -1.5), (None, 0.2)]) for q, r in zip((1, 2), pair, strict=True) if r is not None]
    daily = spark.createDataFrame(rows, "date date, variant string, window int, quantile int, mean_return double")
    assert [round(r.nav, 9) for r in factor_stats.long_short_nav(daily, 2).orderBy("date").collect()] == [1.5, -0.75, -0.75]


def test_scan_factor_reads_wide_and_long(spark):
    wide = spark.createDataFrame([("2024-01-02", "1.5", "x"), ("2024-01-03", None, "2")], "day string, `1` string, `600000.0` string")
    assert {(str(r.date), r.stock_code, r.factor_value) for r in tables.scan_factor(wide).collect()} == {("2024-01-02", "000001", 1.5), ("2024-01-03", "600000", 2.0)}
    assert tables.scan_factor(tables.scan_factor(wide)).count() == 2


def test_scans_fail_on_a_second_row_of_a_key(spark, tmp_path):
    same = [("2024-01-02", "1", "1.5"), ("2024-01-02", "2", "1.5"), ("2024-01-02", "000001", None)]
    twice = spark.createDataFrame(same, "date string, stock_code string, factor_value string")
    with pytest.raises(Exception, match=r"factor: several rows have the key 2024-01-02\|000001"):
        tables.scan_factor(twice).count()
    assert tables.scan_factor(twice.limit(2)).count() == 2 and tables.scan_factor(twice, unique=False).count() == 2
    assert [tuple(r) for r in contracts.check_unique_keys(tables.scan_factor(twice.fillna("1"), unique=False)).collect()] == [("unique_keys", "2024-01-02|000001", "2")]
    no_key = spark.createDataFrame([(None, "1", "1"), (None, "1", "2")], "date string, stock_code string, factor_value string")
    with pytest.raises(Exception, match="null"):
        tables.scan_factor(no_key).collect()
    panel = spark.createDataFrame([(d, s, *["1"] * 11) for d, s in (("2024-01-02", "a"), ("2024-01-03", "a"), ("2024-01-02", " a"))], ", ".join(f"{f.name} string" for f in tables.PANEL_SCHEMA))
    panel.write.parquet(str(tmp_path / "panel"))
    with pytest.raises(Exception, match=r"market panel: several rows have the key 2024-01-02\|a"):
        tables.scan_market_panel(spark, str(tmp_path / "panel")).count()
    assert tables.scan_market_panel(spark, str(tmp_path / "panel"), unique=False).count() == 3
    window = lambda last: tables.scan_window(tables.conform(panel, tables.PANEL_SCHEMA), ["date", "stock_code", "raw_open"], "date", "2024-01-02", last, ("date", "stock_code"))
    with pytest.raises(Exception, match="window: several rows"):
        window("2024-01-02").count()
    assert tables.scan_window(tables.conform(panel, tables.PANEL_SCHEMA), ["date", "stock_code"], "date", "2024-01-03", "2024-01-03", ("date", "stock_code")).count() == 1


def test_the_check_of_keys_adds_no_shuffle_to_a_window_over_stocks(spark):
    df = day(spark, (1, 2, 3)).select("date", "stock_code", F.col("v").cast("string").alias("factor_value"))
    x = tables.scan_factor(df).withColumn("before", F.lag("factor_value").over(Window.partitionBy("stock_code").orderBy("date")))
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_bad_booleans_and_numbers_are_listed(spark):
    df = spark.createDataFrame([("Yes", "1"), ("perhaps", "1e400"), (None, "abc")], "b string, x string")
    assert {r.value for r in tables.bool_violations(df, "b").collect()} == {"perhaps", None}
    assert {r.value for r in tables.numeric_violations(df, "x").collect()} == {"abc"}


def test_clean_tables_have_no_violations(spark):
    df = day(spark, (1, 2, 3))
    assert contracts.doctor(spark, [contracts.check_unique_keys(df), contracts.check_keys_present(df), contracts.check_daily_size(df, 3), contracts.check_finite_features(df, ["v"])]).count() == 0
    assert contracts.forbidden_feature("target_5d") and contracts.forbidden_feature("is_st_t+1") and not contracts.forbidden_feature("rev_5d")


def test_fingerprint_ignores_row_order(spark):
    df = day(spark, (3, 1, 2))
    one, two = (contracts.table_fingerprint(x, ["stock_code", "v"]).first() for x in (df, df.orderBy(F.desc("v"))))
    assert one == two and one != contracts.table_fingerprint(df.where("v > 1"), ["stock_code", "v"]).first()


def test_fingerprints_tell_rows_and_schemas_apart(spark):
    def one(rows, schema="a string, b string"):
        return tuple(contracts.table_fingerprint(spark.createDataFrame(rows, schema)).first())

    every = [
        one([("a|b", "c")]), one([("a", "b|c")]), one([("ab", "c")]), one([("\\N", "c")]), one([(None, "c")]), one([("n", "c")]), one([("", "c")]), one([("c", None)]), one([("1", "c")]), one([(1, "c")], "a int, b string"), one([(1, "c")], "a long, b string"),
        one([("1", "c")], "x string, b string"), one([("1", "c")] * 2), one([]), one([("1", "d"), ("2", "c")]), one([("1", "c"), ("2", "d")]),
    ]
    assert len(set(every)) == len(every) and len({r[0] for r in every}) == 4 and len({r[2] for r in every}) > 12 < len({r[3] for r in every})
    assert one([(0.0, "x")], "a double, b string") == one([(-0.0, "x")], "a double, b string") != one([(float("nan"), "x")], "a double, b string")


def test_label_fingerprint_sees_labels_alone(spark):
    schema = "date date, stock_code string, x double, y double"
    d = dt.date(2024, 1, 1)
    base, feature, label = ([(d, "a", 1.0, 2.0)], [(d, "a", 9.0, 2.0)], [(d, "a", 1.0, 3.0)])
    one, two, three = (contracts.label_fingerprint(spark.createDataFrame(r, schema), ["y"]).first() for r in (base, feature, label))
    assert one == two != three


@pytest.mark.parametrize("name", ["rank_target_10d", "market_target_10d", "industry_target_10d", "alpha_target_10d", "status_t_2", "Status_T+1", "x_t_plus_1", "entry_x", "date"])
def test_leaks_are_forbidden(name):
    assert contracts.forbidden_feature(name)


@pytest.mark.parametrize("name", ["rank_target", "st_status", "status_t0", "ret_t1", "update"])
def test_others_may_be_features(name):
    assert not contracts.forbidden_feature(name)


def test_vendor_columns_with_nulls(spark):
    df = spark.createDataFrame([(D, None, None, "x"), (D, None, "plain", "y"), (D, None, "000001.XSHE", "z")], "Trading_Date date, none string, id string, note string")
    assert tables.resolve_vendor_columns(df).columns == ["date", "none", "stock_code", "note"]


def test_several_rows_of_a_key_fail(spark):
    two = spark.createDataFrame([(D, 1.0), (D, 2.0)], "date date, index_close double")
    with pytest.raises(Exception, match="several rows of 2024-01-02"):
        one_row(two, ["date"]).collect()
    assert one_row(two.limit(1), ["date"]).collect() == two.limit(1).collect()


def test_events_off_the_calendar_are_dropped(spark):
    days = [D + dt.timedelta(i) for i in range(6)]
    events = spark.createDataFrame([(days[0], "A", "x"), (days[1], "A", "y"), (days[2], "A", "x")], "date date, stock_code string, institute string")
    calendar = spark.createDataFrame([(d, i) for i, d in enumerate(days[::2])], "date date, pos long")
    got = {(r.date, r.n) for r in factors.rolling_distinct_active(events, calendar, 2).collect()}
    assert got == {(days[0], 1), (days[2], 1), (days[4], 1)}


@pytest.mark.parametrize("n", [1, 2, 33])
def test_pair_counts_equal_all_pairs(spark, n):
    rng = np.random.default_rng(n)
    data = [("m", D + dt.timedelta(d), f"S{i}", float(rng.integers(0, 9)), float(rng.integers(0, 7)) if rng.random() < 0.9 else None) for d in range(3) for i in range(n)]
    got = {r.date: tuple(r)[2:] for r in evaluation.pair_counts(spark.createDataFrame(data, "model string, date date, stock_code string, score double, rank_target double")).collect()}
    for d in {r[1] for r in data}:
        own = [(a, b) for _, x, _, a, b in data if x == d and b is not None]
        pairs = [(np.sign(p[0] - q[0]), np.sign(p[1] - q[1])) for i, p in enumerate(own) for q in own[:i]]
        if own:
            assert got[d] == (sum(a * b for a, b in pairs), len(pairs), sum(a == 0 for a, _ in pairs), sum(b == 0 for _, b in pairs))


@pytest.mark.parametrize("width", [1, 3, 16, 1000])
def test_pair_counts_in_blocks_equal_all_pairs(spark, width):
    rng = np.random.default_rng(width)
    scores = {"fine": lambda n: rng.random(n), "ties": lambda n: rng.integers(0, 5, n) * 1.0, "one": lambda n: np.ones(n), "mostly": lambda n: np.where(rng.random(n) < 0.7, 0.5, rng.random(n))}
    data, want = [], {}
    for (m, a), (d, b) in [(x, y) for x in scores.items() for y in enumerate(scores.values())]:
        x, y = a(90), b(90)
        data += [(m, D + dt.timedelta(d), f"S{i}", float(x[i]), float(y[i])) for i in range(90)]
        sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
        off = ~np.eye(90, dtype=bool)
        want[m, D + dt.timedelta(d)] = (int((sx * sy).sum()) // 2, 90 * 89 // 2, int((sx == 0)[off].sum()) // 2, int((sy == 0)[off].sum()) // 2)
        assert evaluation.signed_pairs(x, y) == want[m, D + dt.timedelta(d)][0]
    rows = spark.createDataFrame(data, "model string, date date, stock_code string, score double, rank_target double")
    assert {(r.model, r.date): tuple(r)[2:] for r in evaluation.pair_counts(rows, width).collect()} == want


def test_what_is_broadcast_by_date_has_a_bound(spark):
    days = spark.createDataFrame([(D, 1), (dt.date(2199, 12, 31), 2), (None, 3)], "date date, x int")
    rows = spark.createDataFrame([(D,), (None,)], "date date")
    assert rows.join(by_day(days), "date", "left").select("x").orderBy("x").collect() == [(None,), (1,)]
    with pytest.raises(Exception, match="not a date of a calendar"):
        rows.join(by_day(days.selectExpr("date_add(date, 1) as date", "x")), "date", "left").collect()
    with pytest.raises(Exception, match="not a date of a calendar"):
        rows.join(by_day(days.selectExpr("date_add(date, 1) as listed"), "listed"), rows.date == F.col("listed"), "left").collect()


def test_listing_days_of_dates_far_off_the_calendar(spark):
    days = [D + dt.timedelta(i) for i in (0, 1, 4)]
    listed = {"A": dt.date(3400, 1, 1), "B": dt.date(1500, 1, 1), "C": D, "D": D + dt.timedelta(2), "E": D + dt.timedelta(4), "F": D + dt.timedelta(5), "G": None}
    rows = spark.createDataFrame([(d, s, x) for d in days for s, x in listed.items()], "date date, stock_code string, listed_date date")
    out = calendar.listing_days(rows, calendar.calendar_index(rows))
    got = {}
    for r in out.orderBy("date").collect():
        got.setdefault(r.stock_code, []).append(r.listing_days)
        assert r.listed_date == listed[r.stock_code]
    assert got == {"A": [0, 0, 0], "B": [1, 2, 3], "C": [1, 2, 3], "D": [0, 0, 1], "E": [0, 0, 1], "F": [0, 0, 0], "G": [None, None, None]}


def test_daily_ic_is_one_pass_over_the_sample(spark):
    late = dt.date(2024, 1, 3)
    pairs = [(D, 1.0, 4.0), (D, 2.0, 5.0), (D, 2.0, 6.0), (D, 3.0, None), (D, None, 9.0), (late, 1.0, None), (late, None, 2.0)]
    sample = spark.createDataFrame([(d, f"S{i}", "v", 1, x, y) for i, (d, x, y) in enumerate(pairs)], "date date, stock_code string, variant string, window int, value double, ret double")
    found = factor_stats.daily_ic(sample.repartition(3, "date", "variant", "window"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    rows = {r.date: r for r in found.collect()}
    # Ranks of the three complete pairs: 1, 2.5, 2.5 and 1, 2, 3; a date without pairs stays, with nulls.
    assert abs(rows[D].rank_ic - 0.75**0.5) < 1e-12 and abs(rows[D].ic - 0.75**0.5) < 1e-12 and rows[D].n == 3
    assert (rows[late].ic, rows[late].rank_ic, rows[late].n) == (None, None, 0) and len(rows) == 2


@pytest.mark.parametrize("descending", [False, True])
def test_average_ranks_take_one_sort(spark, descending):
    values = (2.0, None, 2.0, -0.0, 0.0, float("nan"), 5.0)
    ranked = day(spark, values).repartition(2, "date").withColumn("r", average_rank("v", "date", descending=descending))
    assert listed(ranked, "r") == ([3.5, None, 3.5, 5.5, 5.5, 1, 2] if descending else [3.5, None, 3.5, 1.5, 1.5, 6, 5])
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Window [") == 1
