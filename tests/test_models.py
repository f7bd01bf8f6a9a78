from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from crossgrain.operators import boosting, ranking


def rows(spark, n_days=6, n=30, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for d in range(n_days):
        x = rng.normal(size=(n, 2))
        y = 0.7 * x[:, 0] - 0.2 * x[:, 1] + 0.05 * rng.normal(size=n)
        rank = y.argsort().argsort() / (n - 1)
        out += [(dt.date(2024, 1, 1) + dt.timedelta(d), f"S{i:02d}", float(x[i, 0]), float(x[i, 1]), float(y[i]), float(rank[i])) for i in range(n)]
    return spark.createDataFrame(out, "date date, stock_code string, a double, b double, y double, r double"), out


def test_ridge_equals_closed_form(spark):
    df, data = rows(spark)
    got = ranking.ridge_fit(df, ["a", "b"], "r", 0.3)
    x, y = np.array([[r[2], r[3]] for r in data]), np.array([r[5] for r in data])
    w = np.full(len(y), 1 / 30)
    mx, my = (w @ x) / w.sum(), (w @ y) / w.sum()
    beta = np.linalg.solve((x - mx).T @ ((x - mx) * w[:, None]) + 0.3 * w.sum() * np.eye(2), (x - mx).T @ (w * (y - my)))
    assert np.allclose([got["a"], got["b"], got["intercept"]], [*beta, my - beta @ mx])


def test_a_ranker_is_fitted_once_and_applied_later(spark):
    """Scale, vocabulary and weights come from the rows it was fitted on, whatever it is applied to."""
    _, data = rows(spark, seed=4)
    names = ["TECH", "BANK", None, "UNKNOWN", "FOOD"]
    data = [(*x, names[i % 5], 3.0) for i, x in enumerate(data)]
    schema = "date date, stock_code string, a double, b double, y double, r double, industry string, c double"
    fitted = ranking.fit_ranker(spark.createDataFrame(data, schema), ["b", "a", "c"], "r", 0.2)
    assert fitted.industries == ("BANK", "FOOD", "TECH") and ranking.Ranker.from_json(fitted.to_json()) == fitted
    x = np.array([[d[3], d[2], d[7]] for d in data])
    mean, std = x.mean(0), np.where(x.std(0) == 0, 1, x.std(0))
    hot = lambda n: [float(n == v) for v in ("BANK", "FOOD", "TECH")] + [float(n not in ("BANK", "FOOD", "TECH"))]
    full = np.hstack([(x - mean) / std, [hot(d[6]) for d in data]])
    y = np.array([d[5] for d in data])
    centred = full - full.mean(0)  # dates are of one size
    beta = np.linalg.solve(centred.T @ centred / len(y) + 0.2 * np.eye(7), centred.T @ (y - y.mean()) / len(y))
    new = [(dt.date(2025, 1, 1), "X", 0.3, None, None, None, "SHIPS", 9.0), (dt.date(2025, 1, 1), "Y", -1.0, 2.0, None, None, "FOOD", 1.0)]
    got = {r.stock_code: r for r in fitted.scored(spark.createDataFrame(new, schema)).collect()}
    for d in new:
        v = [(v - m) / s if v is not None else 0.0 for v, m, s in zip((d[3], d[2], d[7]), mean, std, strict=True)] + hot(d[6])
        assert abs(got[d[1]].score - (y.mean() + (np.array(v) - full.mean(0)) @ beta)) < 1e-9
    assert sorted(r.pred_rank_pct for r in got.values()) == [0.0, 1.0]
    with np.testing.assert_raises_regex(ValueError, "missing columns"):
        fitted.scored(spark.createDataFrame(new, schema).drop("a"))


def test_expanding_fits_equal_separate_ones(spark):
    """One scan gives what a fit over each fold's own rows gives; labels that reach into the fold's year are left out."""
    rng = np.random.default_rng(2)
    for names in (["a", "b"], [f"f{i}" for i in range(24)]):
        data = []
        for i in range(900):
            date = dt.date(2020, 1, 1) + dt.timedelta(int(rng.integers(0, 1500)))
            data.append((date, f"S{i}", None if rng.random() < 0.05 else date + dt.timedelta(int(rng.integers(1, 60))), *map(float, rng.normal(size=len(names))), float(rng.normal()) if rng.random() > 0.1 else None))
        df = spark.createDataFrame(data, "date date, stock_code string, exit date, " + ", ".join(f"{n} double" for n in names) + ", y double").cache()
        years = (2020, 2021, 2022, 2024)
        # Weights of one row, not of a date's rows: a date may be cut by its rows' exits.
        got = ranking.expanding_ridge(df, names, "y", "exit", years, 0.2, F.lit(1.0))
        assert sorted(got) == [2021, 2022, 2024]
        for fold in got:
            own = df.where((F.year("date") < fold) & (F.year("exit") < fold))
            want = ranking.ridge_fit(own, names, "y", 0.2, F.lit(1.0))
            assert np.allclose([got[fold][k] for k in want], list(want.values()), atol=1e-9)
        scored = ranking.out_of_fold_scores(df, got).collect()
        assert {r.fold for r in scored} <= set(got) and all(r.date.year == r.fold for r in scored) and len(scored) == sum(d[0].year in got for d in data)
        r = scored[0]
        assert abs(r.score - got[r.fold]["intercept"] - sum(got[r.fold][n] * r[n] for n in names)) < 1e-9


def test_empty_pools_fail_or_are_listed(spark):
    d = dt.date(2024, 1, 1)
    data = [(d, "a", 1.0), (d, "b", 0.8), (d, "c", 0.1), (d + dt.timedelta(1), "a", 1.0), (d + dt.timedelta(1), "c", 0.1), (d + dt.timedelta(2), "b", 0.8)]
    df = spark.createDataFrame(data, "date date, stock_code string, r double")
    assert sorted((r.date.day, r.pool) for r in ranking.dates_without_pairs(df, "r").collect()) == [(2, "boundary"), (3, "positive")]
    with np.testing.assert_raises_regex(Exception, "no (boundary|positive) rows on 2024-01-0"):
        ranking.sample_top_pairs(df, "r", 1, 1).collect()
    assert {r.date.day for r in ranking.sample_top_pairs(df, "r", 1, 1, empty="skip").collect()} == {1, 2}
    assert {r.kind for r in ranking.sample_top_pairs(df.where(F.col("date") == d), "r", 1, 1).collect()} >= {"boundary"}


def test_pairwise_fits_find_the_direction(spark):
    df, _ = rows(spark)
    pairs = ranking.sample_date_pairs(df, "y", 4, 2).cache()
    assert pairs.where("anchor = opponent").count() == 0 and pairs.count() == pairs.distinct().count()
    plain = ranking.pairwise_rank_fit(pairs, df, ["a", "b"], "y")
    assert plain["a"] > 0 > plain["b"] and plain["a"] > -plain["b"]


def test_the_pairwise_fit_is_certified_by_its_gradient(spark):
    df, _ = rows(spark)
    pairs = ranking.sample_date_pairs(df, "y", 4, 2)
    directed = ranking.directed_pairs(pairs, df, ["a", "b"], "y").cache()
    fitted = ranking.pairwise_rank_fit(pairs, df, ["a", "b"], "y")
    w = [fitted["a"], fitted["b"]]
    assert np.abs(ranking.pair_loss(directed, w, 1e-3)[1]).max() < 1e-9
    for moved in ([w[0] * 1.01, w[1]], [w[0], w[1] * 1.01]):
        assert np.abs(ranking.pair_loss(directed, moved, 1e-3)[1]).max() > 1e-6
    # The gradient and the Hessian are those of the loss.
    z = np.array([r.z for r in directed.collect()])
    loss = lambda v: np.log1p(np.exp(-z @ v)).mean() + 5e-4 * v @ v
    v, e = np.array([0.3, -0.2]), 1e-5
    got = ranking.pair_loss(directed, v, 1e-3)
    assert abs(got[0] - loss(v)) < 1e-12
    assert np.allclose(got[1], [(loss(v + e * d) - loss(v - e * d)) / (2 * e) for d in np.eye(2)], atol=1e-8)
    assert np.allclose(got[2][0], (ranking.pair_loss(directed, v + [e, 0], 1e-3)[1] - ranking.pair_loss(directed, v - [e, 0], 1e-3)[1]) / (2 * e), atol=1e-7)


def test_many_features_agree_with_newton(spark, monkeypatch):
    df, _ = rows(spark)
    pairs = ranking.sample_date_pairs(df, "y", 4, 2)
    newton = ranking.pairwise_rank_fit(pairs, df, ["a", "b"], "y", strength=0.01)
    monkeypatch.setattr(ranking, "FEW_VALUES", 1)
    other = ranking.pairwise_rank_fit(pairs, df, ["a", "b"], "y", strength=0.01)
    assert all(abs(newton[k] - other[k]) < 1e-3 * abs(newton[k]) for k in newton)


def test_lambda_rounds_never_lower_ndcg(spark):
    df, data = rows(spark)
    pairs = ranking.sample_date_pairs(df, "y", 4, 2)
    fitted, seen = ranking.lambda_rank_fit(pairs, df, ["a", "b"], "y", "r", (-0.1, 0.2), 10, rounds=6)
    ndcg = [s.ndcg for s in seen]
    assert len(seen) > 2 and ndcg == sorted(ndcg) and ndcg[-1] > ndcg[0] + 0.1 and fitted["a"] > 0 > fitted["b"]

    # The first round by hand.
    by_day, target = {}, {}
    for d, s, a, b, y, r in data:
        by_day.setdefault(d, []).append((-(-0.1 * a + 0.2 * b), s, a, b, r))
        target[d, s] = y
    x, place = {}, {}
    for d, own in by_day.items():
        for i, (_, s, a, b, r) in enumerate(sorted(own), 1):
            x[d, s], place[d, s] = np.array([a, b]), (r, 1 / np.log2(i + 1) if i <= 10 else 0.0)
    top = {d: sum(r / np.log2(i + 1) for i, r in enumerate(sorted((place[d, s][0] for _, s, *_ in own), reverse=True)[:10], 1)) for d, own in by_day.items()}
    assert abs(seen[0].ndcg - np.mean([sum(place[d, s][0] * place[d, s][1] for _, s, *_ in own) / top[d] for d, own in by_day.items()])) < 1e-9
    g, n = np.zeros(2), 0.0
    for p in pairs.collect():
        hi, lo = (p.date, p.anchor), (p.date, p.opponent)
        hi, lo = (hi, lo) if target[hi] > target[lo] else (lo, hi)
        z, w = x[hi] - x[lo], abs((place[hi][0] - place[lo][0]) * (place[hi][1] - place[lo][1]))
        g, n = g + w * z / (1 + np.exp(z @ [-0.1, 0.2])), n + w
    assert np.allclose(seen[0].gradient, g / n)


def test_top_pairs_are_disjoint(spark):
    df, _ = rows(spark)
    got = ranking.sample_top_pairs(df, "r", 2, 3).collect()
    assert len({(r.date, r.positive, r.negative) for r in got}) == len(got) and {r.kind for r in got} == {"boundary", "broad"}


def test_boosted_trees_rank(spark):
    df, _ = rows(spark)
    got = ranking.gbt_rank_regression(df, ["a", "b"], "r", max_depth=3, rounds=5)
    assert got.selectExpr("corr(score, r)").first()[0] > 0.6


def test_boosted_trees_equal_a_recursion(spark):
    """Against splits sought row by row; nulls, a feature without spread, unlabelled rows."""
    df, data = rows(spark, n_days=4, n=25, seed=9)
    data = [(d, s, None if i % 11 == 0 else a, b, y, None if i % 7 == 0 else r, 5.0) for i, (d, s, a, b, y, r) in enumerate(data)]
    df = spark.createDataFrame(data, "date date, stock_code string, a double, b double, y double, r double, c double").repartition(4)
    model = boosting.boosted_trees(df, ["a", "b", "c"], "r", depth=2, rounds=12, step=0.5, bins=8, ridge=0.5, least=0.2)
    got = {(x.date, x.stock_code): x.score for x in model.scored(df).collect()}
    known = [x for x in data if x[5] is not None]
    n = {d: sum(x[0] == d for x in known) for d in {x[0] for x in known}}
    low = [min(x[k] for x in known if x[k] is not None) for k in (2, 3)]
    span = [max(x[k] for x in known if x[k] is not None) - m for k, m in zip((2, 3), low, strict=True)]

    def bins(x):
        return [0 if v is None else min(7, max(0, int(np.floor((v - m) / s * 8)))) for v, m, s in zip(x[2:4], low, span, strict=True)] + [0]

    unit = lambda v: np.floor(v * 1e9 + 0.5)
    start = sum(unit(x[5] / n[x[0]]) for x in known) / sum(unit(1 / n[x[0]]) for x in known)
    score = {id(x): start for x in data}

    def grow(own, asked, level):
        g, h = sum(grad[id(x)] for x in own) / 1e9, sum(unit(1 / n[x[0]]) for x in own) / 1e9
        best = (1e-12, None)
        for f in range(3) if level < 2 else ():
            for b in range(7):
                left = [x for x in own if bins(x)[f] <= b]
                lg, lh = sum(grad[id(x)] for x in left) / 1e9, sum(unit(1 / n[x[0]]) for x in left) / 1e9
                if lh >= 0.2 and h - lh >= 0.2 - 1e-12:
                    gain = lg * lg / (lh + 0.5) + (g - lg) ** 2 / (h - lh + 0.5) - g * g / (h + 0.5)
                    best = max(best, (gain, (f, b)), key=lambda t: t[0])
        if best[1] is None:
            for x in asked:
                score[id(x)] += 0.5 * g / (h + 0.5)
            return
        f, b = best[1]
        for side in (True, False):
            grow([x for x in own if (bins(x)[f] <= b) is side], [x for x in asked if (bins(x)[f] <= b) is side], level + 1)

    for _ in range(12):
        grad = {id(x): unit((x[5] - score[id(x)]) / n[x[0]]) for x in known}
        grow(known, data, 0)
    assert len(model.trees) == 12 and len(got) == len(data)
    assert all(abs(got[x[0], x[1]] - score[id(x)]) < 1e-9 for x in data)


def test_boosted_trees_stop_early_and_draw_features(spark):
    df, _ = rows(spark, n_days=8, n=40)
    late = F.col("date") >= dt.date(2024, 1, 7)
    kept = boosting.boosted_trees(df, ["a", "b"], "r", rounds=40, step=0.9, depth=4, least=0.05, ridge=0.01, validation=late, patience=2)
    assert 0 < len(kept.trees) < 40
    # What validation rows hold teaches nothing.
    other = boosting.boosted_trees(df.withColumn("r", F.when(late, 1 - F.col("r")).otherwise(F.col("r"))), ["a", "b"], "r", rounds=1, step=0.9, depth=4, least=0.05, ridge=0.01, validation=late)
    assert other.trees[0] == kept.trees[0] and other.start == kept.start
    one = boosting.boosted_trees(df, ["a", "b"], "r", rounds=6, depth=2, least=0.1, feature_share=0.5)
    assert all(len({f for f, _ in t.splits.values()}) <= 1 for t in one.trees) and {f for t in one.trees for f, _ in t.splits.values()} == {0, 1}
    none = boosting.boosted_trees(df.where("r is null"), ["a", "b"], "r")
    assert none.scored(df).agg(F.max(F.abs("score"))).first()[0] == 0.0


def test_pair_samples_are_full_and_free_of_ties(spark):
    rng = np.random.default_rng(3)
    data = [(dt.date(2024, 1, 1), f"S{i:02d}", float(v)) for i, v in enumerate(rng.integers(0, 6, 40))] + [(dt.date(2024, 1, 2), f"S{i:02d}", 1.0) for i in range(4)] + [(dt.date(2024, 1, 3), f"S{i:02d}", float(i == 2)) for i in range(3)]
    df = spark.createDataFrame(data, "date date, stock_code string, y double")
    target = {(d, s): y for d, s, y in data}
    got = ranking.sample_date_pairs(df, "y", 5, 3).collect()
    assert len({tuple(r) for r in got}) == len(got)
    for (d, s), y in target.items():
        others = [abs(y - v) for (e, _), v in target.items() if e == d and v != y]
        own = {k: [abs(y - target[d, r.opponent]) for r in got if (r.date, r.anchor, r.kind) == (d, s, k)] for k in ("broad", "nearest")}
        assert len(own["broad"]) == min(5, len(others)) and 0 not in own["broad"]
        assert sorted(own["nearest"]) == sorted(others)[:3]


def test_ridge_with_many_features(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 142))
    y = x @ rng.normal(size=142) + rng.normal(size=500)
    names = [f"f{i}" for i in range(142)]
    df = spark.createDataFrame([(dt.date(2024, 1, 1 + i % 5), f"S{i}", *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "date date, stock_code string, " + ", ".join(f"{n} double" for n in names) + ", y double")
    got = ranking.ridge_fit(df, names, "y", 0.2)
    beta = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) / 500 + 0.2 * np.eye(142), (x - x.mean(0)).T @ (y - y.mean()) / 500)
    assert np.allclose([got[n] for n in names], beta)


def test_a_lambda_round_keeps_the_first_places_only(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    from crossgrain.operators import ranking

    rows = [(dt.date(2024, 1, 1 + d), f"S{i:02}", float(i), None if i == 9 else i / 9) for d in range(2) for i in range(10)]
    x = spark.createDataFrame(rows, "date date, stock_code string, a double, r double")
    gains = ranking.top_gains(x, [F.col("a"), -F.col("a")], "r", 3)
    assert gains.groupBy("candidate").count().orderBy("candidate").collect() == [(0, 4), (1, 6)]  # the unlabelled first row keeps its place
    found = ranking.mean_ndcg(gains, ranking.best_gains(x, "r", 3), 2)
    place = [1 / np.log2(i + 1) for i in (1, 2, 3)]
    ideal = sum(g / 9 * d for g, d in zip((8, 7, 6), place, strict=True))
    assert abs(found[0] - (8 / 9 * place[1] + 7 / 9 * place[2]) / ideal) < 1e-12
    assert abs(found[1] - sum(g / 9 * d for g, d in zip((0, 1, 2), place, strict=True)) / ideal) < 1e-12


def test_pairs_that_carry_their_rows_are_made_without_a_shuffle(spark):
    from crossgrain.sources import layout

    df, _ = rows(spark)
    laid = layout.laid_by(df, "laid", "date", 3)
    pairs = ranking.sample_date_pairs(laid, "y", 4, 2, carry=["y", "a", "b"])
    own = ranking.directed_pairs(pairs, laid, ["a", "b"], "y")
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    joined = ranking.directed_pairs(ranking.sample_date_pairs(df, "y", 4, 2), df, ["a", "b"], "y")
    assert sorted(map(repr, own.select(joined.columns).collect())) == sorted(map(repr, joined.collect()))
    layout.forget(spark)


def test_a_lambda_fit_neither_writes_nor_shuffles_all_pairs(spark, monkeypatch):
    """A round needs the pairs of its first rows only; rings and pairs that are given make the same fit, with gaps in labels as well."""
    from crossgrain.sources import layout

    _, data = rows(spark, n_days=5, n=40, seed=6)
    data = [(None if i == 77 else d, s, a, b, None if i % 9 == 0 else y, None if i % 13 == 0 else r) for i, (d, s, a, b, y, r) in enumerate(data)]
    df = spark.createDataFrame(data, "date date, stock_code string, a double, b double, y double, r double")
    table = layout.laid_by(df, "laid", "date", 3)
    rings = ranking.date_rings(table, "y", 4, 2, carry=["y", "r", "a", "b"])
    plan = rings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    written, plans, write, first_pairs = [], [], ranking.materialize, ranking.first_pairs

    def watched(df, label):
        out = write(df, label)
        written.append(out.count())
        return out

    def planned(*args):
        out = first_pairs(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(ranking, "materialize", watched)
    monkeypatch.setattr(ranking, "first_pairs", planned)
    args = (["a", "b"], "y", "r", (-0.1, 0.2), 3, 4)
    known = set(layout._stored[spark.sparkContext.applicationId])
    fitted, seen = ranking.lambda_rank_fit(rings, table, *args, n=3)
    assert set(layout._stored[spark.sparkContext.applicationId]) == known  # the fit's own table is gone
    pairs = ranking.sample_date_pairs(df, "y", 4, 2).collect()
    assert len(seen) > 1 and len(pairs) > 5 * 150 and max(written) <= 4 * 3 * 5  # candidates, places, dates
    # The rows stay in their buckets: what moves to them has a row a date, and only what asks for a place is grouped before.
    assert plans and all("disabled by query planner" not in p and p.count("Bucketed: true") == 2 and p.count("ENSURE_REQUIREMENTS") == 1 for p in plans)
    given, same = ranking.lambda_rank_fit(ranking.sample_date_pairs(df, "y", 4, 2), df, *args)
    assert all(abs(fitted[k] - given[k]) < 1e-9 for k in fitted) and len(same) == len(seen)

    # The first gradient by hand.
    row, place = {(d, s): (np.array([a, b]), y, r) for d, s, a, b, y, r in data if d is not None}, {}
    for d in {d for d, _ in row}:
        for i, (_, s) in enumerate(sorted((-(row[k][0] @ [-0.1, 0.2]), k[1]) for k in row if k[0] == d), 1):
            place[d, s] = 1 / np.log2(i + 1) if i <= 3 else 0.0
    assert any(place[k] and y is None and r is not None for k, (_, y, r) in row.items())  # one of the first that is in no pair
    g, n = np.zeros(2), 0.0
    for p in pairs:
        hi, lo = (p.date, p.anchor), (p.date, p.opponent)
        hi, lo = (hi, lo) if row[hi][1] > row[lo][1] else (lo, hi)
        if row[hi][2] is None or row[lo][2] is None:
            continue
        z, w = row[hi][0] - row[lo][0], abs((row[hi][2] - row[lo][2]) * (place[hi] - place[lo]))
        g, n = g + w * z / (1 + np.exp(z @ [-0.1, 0.2])), n + w
    assert n > 0 and np.allclose(seen[0].gradient, g / n, atol=1e-12)
    layout.forget(spark)
