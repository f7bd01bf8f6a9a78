"""Queries M1 to M8, E1 to E14, D1, D2, D4, D5. Two linear models score the proxy's universe."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossgrain.functions.columns import by_day, rank_percentile
from crossgrain.operators import evaluation as E
from crossgrain.operators import factors, labels
from crossgrain.operators import ranking as M
from crossgrain.operators.calendar import calendar_index, exit_date
from crossgrain.queries.factor_stats import corr_sql, rank_sql
from crossgrain.queries.registry import part, query
from crossgrain.sources import proxy
from crossgrain.sources.layout import parts, stored

K, FEATURES = 10, ["a", "b"]
DAY = "model, date"

part("feat", "panel targets", """SELECT p.date, p.pos, p.stock_code, p.industry, round(coalesce(a, 0), 3) + 0.0 AS a, round(coalesce(b, 0), 3) + 0.0 AS b, target_5d / 50 AS target FROM (
  SELECT *, -(post_close / nullif(max(post_close) OVER (PARTITION BY stock_code ORDER BY pos RANGE BETWEEN 5 PRECEDING AND 5 PRECEDING), 0) - 1) AS a, raw_close / nullif(raw_open, 0) - 1 AS b FROM panel) p
  JOIN targets USING (date, stock_code) WHERE in_universe AND post_close IS NOT NULL""")
part("featr", "feat", f"SELECT *, CASE WHEN target IS NOT NULL AND nt > 1 THEN (rk + (tied - 1) / 2.0 - 1) / (nt - 1) END AS rank_target FROM (SELECT *, count(target) OVER (PARTITION BY date) AS nt, rank() OVER (PARTITION BY date ORDER BY target NULLS LAST) AS rk, count(*) OVER (PARTITION BY date, target) AS tied FROM feat)")
part("pred", "featr", "SELECT date, stock_code, target, rank_target, industry, 'one' AS model, round(0.5 * a - 0.3 * b, 4) + 0.0 AS score FROM featr UNION ALL SELECT date, stock_code, target, rank_target, industry, 'two', round(0.1 * a - 0.9 * b, 4) + 0.0 FROM featr")
part("lab", "pred", "SELECT * FROM pred WHERE rank_target IS NOT NULL")
part("e_ic", "lab", f"SELECT model, date, {corr_sql('x', 'y', 2)} AS rank_ic FROM (SELECT *, {rank_sql('score', DAY)} AS x, {rank_sql('rank_target', DAY)} AS y FROM lab) GROUP BY ALL")
part("e_pairs", "lab", """SELECT a.model, a.date, CAST(sum(sign(a.score - b.score) * sign(a.rank_target - b.rank_target)) AS BIGINT) AS signed, count(b.date) AS pairs, count(*) FILTER (WHERE a.score = b.score) AS tied_score, count(*) FILTER (WHERE a.rank_target = b.rank_target) AS tied_target
  FROM lab a JOIN lab b ON a.model = b.model AND a.date = b.date AND a.stock_code < b.stock_code GROUP BY ALL""")
part("e_err", "pred", f"""SELECT model, date, avg(abs(p - rank_target)) AS rank_mae, sqrt(avg((p - rank_target) * (p - rank_target))) AS rank_rmse FROM (
  SELECT *, CASE WHEN count(*) OVER d > 1 THEN ({rank_sql('score', DAY)} - 1) / (count(*) OVER d - 1) ELSE 0.5 END AS p FROM pred WINDOW d AS (PARTITION BY model, date)) WHERE rank_target IS NOT NULL GROUP BY ALL""")
part("placed", "lab", f"SELECT *, row_number() OVER (PARTITION BY {DAY} ORDER BY score DESC, stock_code) AS r, row_number() OVER (PARTITION BY {DAY} ORDER BY rank_target DESC, stock_code) AS i FROM lab")
part("e_ndcg", "placed", f"""SELECT model, date, CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0.0 END AS ndcg FROM (SELECT model, date, sum(CASE WHEN r <= {K} THEN (pow(2.0, rank_target) - 1) / log2(r + 1) END) AS dcg,
  sum(CASE WHEN i <= {K} THEN (pow(2.0, rank_target) - 1) / log2(i + 1) END) AS ideal FROM placed GROUP BY ALL)""")
part("e_over", "placed", f"SELECT model, date, count(*) FILTER (WHERE r <= {K} AND i <= {K}) / count(*) FILTER (WHERE r <= {K}) AS precision, count(*) FILTER (WHERE r <= {K} AND i <= {K}) / count(*) FILTER (WHERE i <= {K}) AS recall, count(*) FILTER (WHERE r <= {K} AND i <= {K}) / count(*) FILTER (WHERE r <= {K} OR i <= {K}) AS jaccard FROM placed GROUP BY ALL")
part("e_coh", "pred", f"""SELECT *, top_mean - universe_mean AS top_excess, top_mean - bottom_mean AS top_minus_bottom FROM (SELECT model, date, avg(target) FILTER (WHERE t <= {K}) AS top_mean, median(target) FILTER (WHERE t <= {K}) AS top_median, count(target) FILTER (WHERE t <= {K}) AS top_n,
  avg(target) FILTER (WHERE b <= {K}) AS bottom_mean, median(target) FILTER (WHERE b <= {K}) AS bottom_median, count(target) FILTER (WHERE b <= {K}) AS bottom_n, avg(target) AS universe_mean FROM (
  SELECT *, row_number() OVER (PARTITION BY {DAY} ORDER BY score DESC, stock_code) AS t, row_number() OVER (PARTITION BY {DAY} ORDER BY score, stock_code) AS b FROM pred) GROUP BY ALL)""")
part("e_dec", "pred", f"""SELECT model, date, decile, mean, median, coalesce(n, 0) AS n FROM (SELECT DISTINCT model, date FROM pred) CROSS JOIN (SELECT CAST(unnest(generate_series(1, 10)) AS INTEGER) AS decile) LEFT JOIN (
  SELECT model, date, decile, avg(target) AS mean, median(target) AS median, count(target) AS n FROM (SELECT *, CAST((row_number() OVER (PARTITION BY {DAY} ORDER BY score DESC, stock_code) - 1) * 10 // count(*) OVER (PARTITION BY {DAY}) + 1 AS INTEGER) AS decile FROM pred) GROUP BY ALL) USING (model, date, decile)""")
part("e_decs", "e_dec", f"""SELECT model, date, max(CASE WHEN decile = 1 THEN mean END) - max(CASE WHEN decile = 10 THEN mean END) AS decile_spread, {corr_sql('x', 'y', 2)} AS decile_monotonicity FROM (
  SELECT *, {rank_sql('-decile', DAY)} AS x, {rank_sql('mean', DAY)} AS y FROM e_dec WHERE mean IS NOT NULL) GROUP BY ALL""")
TAU = "signed / nullif(sqrt(CAST(pairs - tied_score AS DOUBLE) * (pairs - tied_target)), 0)"
ACC = "least(1.0, greatest(0.0, 0.5 + 0.5 * signed / nullif(pairs - tied_target, 0)))"
part("daily", "e_ic e_pairs e_err e_ndcg e_over e_coh e_decs pred", f"""SELECT * FROM (SELECT model, date, count(*) AS scored, count(rank_target) AS labelled FROM pred GROUP BY ALL) LEFT JOIN e_ic USING (model, date)
  LEFT JOIN (SELECT model, date, {TAU} AS kendall_tau, CASE WHEN pairs > tied_target THEN {ACC} END AS pairwise_accuracy FROM e_pairs) USING (model, date) LEFT JOIN e_err USING (model, date) LEFT JOIN e_ndcg USING (model, date) LEFT JOIN e_over USING (model, date) LEFT JOIN e_coh USING (model, date) LEFT JOIN e_decs USING (model, date)""")
METRICS = ["rank_ic", "ndcg", "precision", "top_excess", "decile_spread"]
COHORT = "~top_mean ~top_median top_n ~bottom_mean ~bottom_median bottom_n ~universe_mean ~top_excess ~top_minus_bottom"


def features(spark, sf_dir):
    """The features and labels of the panel's universe, stored once a session in buckets of dates: cross-sections need no exchange."""
    return stored(spark, "features", proxy.panel_files(sf_dir), lambda: built_features(spark, sf_dir), "date", "stock_code")


def built_features(spark, sf_dir):
    """One pass over a stock's windows, then one shuffle to the buckets of dates, in which ranks are taken."""
    p = proxy.panel(spark, sf_dir)
    a = (F.round(F.coalesce(factors.reversal(5), F.lit(0.0)), 3) + 0.0).alias("a")
    b = (F.round(F.coalesce(F.expr("try_divide(raw_close, raw_open) - 1"), F.lit(0.0)), 3) + 0.0).alias("b")
    t = (labels.open_to_open(5) / 50).alias("target")
    x = p.select("date", "pos", "stock_code", "industry", "in_universe", "post_close", a, b, t).where("in_universe and post_close is not null").drop("in_universe", "post_close")
    return x.repartition(parts(spark, proxy.panel_files(sf_dir)), "date").withColumn("rank_target", rank_percentile("target", "date"))


def predictions(spark, sf_dir):
    x = features(spark, sf_dir)
    models = F.array(F.struct(F.lit("one").alias("model"), (F.round(0.5 * F.col("a") - 0.3 * F.col("b"), 4) + 0.0).alias("score")), F.struct(F.lit("two").alias("model"), (F.round(0.1 * F.col("a") - 0.9 * F.col("b"), 4) + 0.0).alias("score")))
    return x.select("date", "stock_code", "target", "rank_target", "industry", F.inline(models))


@query("e1_rank_ic", "e_ic", "SELECT * FROM e_ic", "model date ~rank_ic")
def _(spark, sf_dir):
    return E.rank_ic(predictions(spark, sf_dir))


@query("e2_kendall_tau", "e_pairs", f"SELECT model, date, signed, pairs, tied_score, tied_target, {TAU} AS kendall_tau FROM e_pairs", "model date signed pairs tied_score tied_target ~kendall_tau")
def _(spark, sf_dir):
    c = E.pair_counts(predictions(spark, sf_dir)).where("pairs > 0")
    return c.join(E.kendall_tau(c), ["model", "date"])


@query("e3_pairwise_accuracy", "e_pairs", f"SELECT model, date, {ACC} AS pairwise_accuracy FROM e_pairs WHERE pairs > tied_target", "model date ~pairwise_accuracy")
def _(spark, sf_dir):
    return E.pairwise_accuracy(E.pair_counts(predictions(spark, sf_dir)).where("pairs > tied_target"))


@query("e4_rank_errors", "e_err", "SELECT * FROM e_err", "model date ~rank_mae ~rank_rmse")
def _(spark, sf_dir):
    return E.rank_errors(predictions(spark, sf_dir))


@query("e5_ndcg", "e_ndcg", "SELECT * FROM e_ndcg", "model date ~ndcg")
def _(spark, sf_dir):
    return E.ndcg(predictions(spark, sf_dir), K)


@query("e6_overlap_at_k", "e_over", "SELECT * FROM e_over", "model date ~precision ~recall ~jaccard")
def _(spark, sf_dir):
    return E.overlap_at_k(predictions(spark, sf_dir), K)


@query("e7_cohort_returns", "e_coh", "SELECT * FROM e_coh", "model date " + COHORT)
def _(spark, sf_dir):
    return E.cohort_returns(predictions(spark, sf_dir), K)


@query("e8_decile_returns", "e_dec e_decs", "SELECT e_dec.*, decile_spread, decile_monotonicity FROM e_dec LEFT JOIN e_decs USING (model, date)", "model date decile ~mean ~median n ~decile_spread ~decile_monotonicity")
def _(spark, sf_dir):
    d = E.decile_returns(predictions(spark, sf_dir))
    return d.join(E.decile_summary(d), ["model", "date"], "left")


@query("e9_top_detail", "pred", f"SELECT model, date, stock_code, score, target, CAST(row_number() OVER (PARTITION BY {DAY} ORDER BY score DESC, stock_code) AS INTEGER) AS cohort_rank FROM pred QUALIFY cohort_rank <= {K}", "model date stock_code ~score ~target cohort_rank")
def _(spark, sf_dir):
    return E.top_detail(predictions(spark, sf_dir), K).select("model", "date", "stock_code", "score", "target", "cohort_rank")


@query("e10_period_metrics", "e_ic", "SELECT model, strftime(date, '%Y-%m') AS period, count(*) AS days, avg(rank_ic) AS rank_ic FROM e_ic GROUP BY ALL UNION ALL SELECT model, strftime(date, '%Y'), count(*), avg(rank_ic) FROM e_ic GROUP BY ALL", "model period days ~rank_ic")
def _(spark, sf_dir):
    d = E.rank_ic(predictions(spark, sf_dir))
    return E.period_metrics(d, ["rank_ic"]).unionByName(E.period_metrics(d, ["rank_ic"], "year"))


QUANTILES = ", ".join(f"quantile_cont(rank_ic, {q}) AS rank_ic_q{int(q * 100)}" for q in (0.05, 0.25, 0.5, 0.75, 0.95))
SUMMARY = f"SELECT model, count(*) AS days, {', '.join(f'avg({m}) AS mean_{m}' for m in METRICS)}, stddev_samp(rank_ic) AS rank_ic_std, {QUANTILES}, avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) AS rank_icir FROM daily GROUP BY model"
SUMMARY_OUT = "model days " + " ".join(f"~mean_{m}" for m in METRICS) + " ~rank_ic_std ~rank_ic_q5 ~rank_ic_q25 ~rank_ic_q50 ~rank_ic_q75 ~rank_ic_q95 ~rank_icir"


@query("e11_metric_summary", "daily", SUMMARY, SUMMARY_OUT)
def _(spark, sf_dir):
    return E.metric_summary(E.daily_metrics(predictions(spark, sf_dir), K, parts(spark, proxy.panel_files(sf_dir))), METRICS)


HAC = """SELECT model, n, mean, sqrt(greatest(s, 0)) / n AS se, mean / nullif(sqrt(greatest(s, 0)) / n, 0) AS t, mean - 1.959964 * sqrt(greatest(s, 0)) / n AS low, mean + 1.959964 * sqrt(greatest(s, 0)) / n AS high FROM (
  SELECT x.model, any_value(n) AS n, any_value(mean) AS mean, sum(x.e * x.e) + 2 * any_value(c) AS s FROM (SELECT *, rank_ic - avg(rank_ic) OVER (PARTITION BY model) AS e, count(*) OVER (PARTITION BY model) AS n, avg(rank_ic) OVER (PARTITION BY model) AS mean FROM e_ic WHERE rank_ic IS NOT NULL) x
  JOIN (SELECT a.model, sum((1 - (a.i - b.i) / 6.0) * a.e * b.e) AS c FROM se a JOIN se b ON a.model = b.model AND a.i - b.i BETWEEN 1 AND 5 GROUP BY a.model) USING (model) GROUP BY x.model)"""
part("se", "e_ic", "SELECT model, row_number() OVER (PARTITION BY model ORDER BY date) AS i, rank_ic - avg(rank_ic) OVER (PARTITION BY model) AS e FROM e_ic WHERE rank_ic IS NOT NULL")


@query("e12_hac_mean_test", "e_ic se", HAC, "model n ~mean ~se ~t ~low ~high")
def _(spark, sf_dir):
    return E.hac_mean_test(E.rank_ic(predictions(spark, sf_dir)), "rank_ic", 5)


part("hac", "e_ic se", HAC)


@query("e13_compare_runs", "daily hac", f"SELECT s.*, se AS rank_ic_se, t AS rank_ic_t FROM ({SUMMARY}) s LEFT JOIN hac USING (model)", SUMMARY_OUT + " ~rank_ic_se ~rank_ic_t")
def _(spark, sf_dir):
    return E.compare_runs(E.daily_metrics(predictions(spark, sf_dir), K, parts(spark, proxy.panel_files(sf_dir))), METRICS, 5)


@query("e14_evaluate_predictions", "daily", "SELECT * FROM daily", "model date scored labelled ~rank_ic ~kendall_tau ~pairwise_accuracy ~rank_mae ~rank_rmse ~ndcg ~precision ~recall ~jaccard " + COHORT + " ~decile_spread ~decile_monotonicity")
def _(spark, sf_dir):
    return E.daily_metrics(predictions(spark, sf_dir), K, parts(spark, proxy.panel_files(sf_dir)))


#: The normal equations of two features in closed form; strength 0.1 times the sum of weights on the diagonal.
part("ridge", "featr", """SELECT (saa * sbt - sab * sat) AS nb, (sbb * sat - sab * sbt) AS na, saa * sbb - sab * sab AS det, ma, mb, mt FROM (
  SELECT sum(w * (a - ma) * (a - ma)) + 0.1 * sum(w) AS saa, sum(w * (b - mb) * (b - mb)) + 0.1 * sum(w) AS sbb, sum(w * (a - ma) * (b - mb)) AS sab, sum(w * (a - ma) * (t - mt)) AS sat, sum(w * (b - mb) * (t - mt)) AS sbt, any_value(ma) AS ma, any_value(mb) AS mb, any_value(mt) AS mt FROM (
    SELECT *, sum(w * a) OVER () / sum(w) OVER () AS ma, sum(w * b) OVER () / sum(w) OVER () AS mb, sum(w * t) OVER () / sum(w) OVER () AS mt FROM (
      SELECT a, b, rank_target AS t, 1.0 / count(*) OVER (PARTITION BY date) AS w FROM featr WHERE rank_target IS NOT NULL)))""")


@query("m1_ridge_fit", "ridge", "SELECT 'a' AS feature, na / det AS coefficient FROM ridge UNION ALL SELECT 'b', nb / det FROM ridge UNION ALL SELECT 'intercept', mt - na / det * ma - nb / det * mb FROM ridge", "feature ~coefficient")
def _(spark, sf_dir):
    x = features(spark, sf_dir)
    return M.coefficients_frame(x, M.ridge_fit(x, FEATURES, "rank_target", 0.1))


#: Boosted trees in SQL: a part for the rows of each level, one for its best splits.
TREES, DEPTH, BINS = 5, 3, 32


def boosting_parts() -> str:
    """Registers the parts and returns the name of the last, which has the scores."""
    cut = lambda c, i: f"CAST(coalesce(least({BINS - 1}, greatest(0, floor(({c} - low{i}) / span{i} * {BINS}))), 0) AS INTEGER) AS bin_{i}"
    unit = lambda x: f"CAST(floor(({x}) * 1000000000 + 0.5) AS BIGINT)"
    part("gb_rows", "featr", "SELECT date, stock_code, a, b, rank_target AS y, CASE WHEN rank_target IS NOT NULL THEN 1.0 / count(rank_target) OVER (PARTITION BY date) END AS w FROM featr")
    part("gb_start", "gb_rows", f"SELECT min(a) AS low0, max(a) - min(a) AS span0, min(b) AS low1, max(b) - min(b) AS span1, CAST(sum({unit('w * y')}) AS DOUBLE) / CAST(sum({unit('w')}) AS DOUBLE) AS f FROM gb_rows WHERE y IS NOT NULL")
    part("gb_f0", "gb_rows gb_start", f"!SELECT date, stock_code, y, w, {cut('a', 0)}, {cut('b', 1)}, f FROM gb_rows CROSS JOIN gb_start")
    for k in range(TREES):
        part(f"gb_r{k}_0", f"gb_f{k}", f"!SELECT *, 0 AS node, {unit('w * (y - f)')} AS g, {unit('w')} AS h FROM gb_f{k}")
        for level in range(DEPTH):
            rows, best = f"gb_r{k}_{level}", f"gb_s{k}_{level}"
            part(best, rows, f"""SELECT node, ft, b FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, ft, b) AS n FROM (
              SELECT *, lg * lg / (lh + 1.0) + rg * rg / (rh + 1.0) - ag * ag / (ah + 1.0) AS gain FROM (
                SELECT node, ft, b, g / 1e9 AS lg, h / 1e9 AS lh, (tg - g) / 1e9 AS rg, (th - h) / 1e9 AS rh, tg / 1e9 AS ag, th / 1e9 AS ah FROM (
                  SELECT node, ft, b, sum(g) OVER (PARTITION BY node, ft ORDER BY b) AS g, sum(h) OVER (PARTITION BY node, ft ORDER BY b) AS h, sum(g) OVER (PARTITION BY node, ft) AS tg, sum(h) OVER (PARTITION BY node, ft) AS th FROM (
                    SELECT node, ft, b, sum(g) AS g, sum(h) AS h FROM (SELECT node, g, h, unnest([0, 1]) AS ft, unnest([bin_0, bin_1]) AS b FROM {rows} WHERE y IS NOT NULL AND node >= {(1 << level) - 1}) GROUP BY ALL))
              ) WHERE lh >= 1 AND rh >= 1 AND b < {BINS - 1}) WHERE gain > 1e-12) WHERE n = 1""")
            part(f"gb_r{k}_{level + 1}", f"{rows} {best}", f"!SELECT r.* EXCLUDE (node), CASE WHEN s.ft IS NULL THEN r.node WHEN CASE s.ft WHEN 0 THEN bin_0 ELSE bin_1 END <= s.b THEN 2 * r.node + 1 ELSE 2 * r.node + 2 END AS node FROM {rows} r LEFT JOIN {best} s USING (node)")
        last = f"gb_r{k}_{DEPTH}"
        part(f"gb_f{k + 1}", last, f"!SELECT date, stock_code, y, w, bin_0, bin_1, f + leaf AS f FROM {last} JOIN (SELECT node, 0.1 * (sum(g) / 1e9) / (sum(h) / 1e9 + 1.0) AS leaf FROM {last} WHERE y IS NOT NULL GROUP BY node) USING (node)")
    return f"gb_f{TREES}"


_scores = boosting_parts()


@query("m2_gbt_rank_regression", _scores, f"SELECT date, stock_code, f AS score FROM {_scores}", "date stock_code ~score")
def _(spark, sf_dir):
    x = features(spark, sf_dir)
    return M.gbt_rank_regression(x, FEATURES, "rank_target", rounds=TREES, max_depth=DEPTH).select("date", "stock_code", "score")


part("ring", "feat", """SELECT *, n - m AS others, j - r AS first, row_number() OVER (PARTITION BY date ORDER BY h, s) - 1 AS i FROM (
  SELECT date, s, t, h, count(*) OVER (PARTITION BY date) AS n, count(*) OVER (PARTITION BY date, t) AS m, row_number() OVER (PARTITION BY date ORDER BY t, h, s) - 1 AS j, row_number() OVER (PARTITION BY date, t ORDER BY h, s) - 1 AS r
  FROM (SELECT date, stock_code AS s, target AS t, md5('7|' || date || '|' || stock_code) AS h FROM feat WHERE target IS NOT NULL))""")


M5 = """SELECT a.date, a.s AS anchor, b.s AS opponent, 'broad' AS kind FROM ring a CROSS JOIN (VALUES (0), (1), (2)) AS o(d)
  JOIN ring b ON b.date = a.date AND b.j = (a.first + a.m + (a.i + o.d * greatest(1, a.others // 3)) % a.others) % a.n WHERE a.others > 0 AND o.d < a.others
  UNION ALL SELECT date, anchor, opponent, 'nearest' FROM (SELECT a.date, a.s AS anchor, b.s AS opponent,
    row_number() OVER (PARTITION BY a.date, a.s ORDER BY abs(a.t - b.t), b.t, (b.r - a.i % b.m + b.m) % b.m) AS k FROM ring a JOIN ring b ON b.date = a.date AND b.t <> a.t) WHERE k <= 2"""
part("m5", "ring", M5)
part("directed", "m5 feat", """!SELECT p.date, anchor, opponent, sign(x.target - y.target) * (x.a - y.a) AS za, sign(x.target - y.target) * (x.b - y.b) AS zb FROM m5 p JOIN feat x ON x.date = p.date AND x.stock_code = p.anchor JOIN feat y ON y.date = p.date AND y.stock_code = p.opponent WHERE x.target <> y.target""")
#: Newton's method on the pairwise loss, a part a step; it stands still long before the last.
NEWTON = 12
part("nt0", "", "SELECT CAST(0 AS DOUBLE) AS wa, CAST(0 AS DOUBLE) AS wb")
for _k in range(NEWTON):
    part(f"nt{_k + 1}", f"nt{_k} directed", f"""!SELECT wa - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS wa, wb - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS wb FROM (
      SELECT wa, wb, 0.001 * wa - avg(p * za) AS ga, 0.001 * wb - avg(p * zb) AS gb, 0.001 + avg(p * (1 - p) * za * za) AS haa, 0.001 + avg(p * (1 - p) * zb * zb) AS hbb, avg(p * (1 - p) * za * zb) AS hab FROM (
        SELECT wa, wb, za, zb, 1 / (1 + exp(za * wa + zb * wb)) AS p FROM directed CROSS JOIN nt{_k}) GROUP BY wa, wb)""")


@query("m3_pairwise_rank_fit", f"nt{NEWTON}", f"SELECT unnest(['a', 'b']) AS feature, unnest([wa, wb]) AS coefficient FROM nt{NEWTON}", "feature ~coefficient")
def _(spark, sf_dir):
    x = features(spark, sf_dir)
    return M.coefficients_frame(x, M.pairwise_rank_fit(M.sample_date_pairs(x, "target", 3, 2, carry=["target", *FEATURES]), x, FEATURES, "target"))


#: Rounds, first score and truncation of the lambda fit; steps tried in each round.
ROUNDS, FIRST, CUT, STEPS = 3, (1.0, -1.0), 40, (1.0, 0.5, 0.25, 0.125)


def lambda_parts() -> str:
    """Registers the parts of all rounds and returns the name of the last weights."""
    gains = lambda of: f"SELECT c, date, stock_code, g, CASE WHEN p <= {CUT} THEN 1 / log2(p + 1) ELSE 0.0 END AS d FROM (SELECT c, date, stock_code, rank_target AS g, row_number() OVER (PARTITION BY c, date ORDER BY 0.0 + a * wa + b * wb DESC, stock_code) AS p FROM feat_l CROSS JOIN {of}) WHERE g IS NOT NULL"
    ndcg = lambda of: f"SELECT c, avg(x / y) AS m FROM (SELECT c, date, sum(g * d) AS x, sum(CASE WHEN i <= {CUT} THEN g / log2(i + 1) END) AS y FROM (SELECT *, row_number() OVER (PARTITION BY c, date ORDER BY g DESC, stock_code) AS i FROM {of}) GROUP BY c, date) WHERE y > 0 GROUP BY c"
    part("feat_l", "featr", "!SELECT date, stock_code, a, b, rank_target FROM featr")
    part("lw0", "", f"SELECT 0 AS c, CAST({FIRST[0]} AS DOUBLE) AS wa, CAST({FIRST[1]} AS DOUBLE) AS wb")
    for k in range(ROUNDS):
        part(f"lg{k}", f"lw{k} feat_l", "!" + gains(f"lw{k}"))
        part(f"ld{k}", f"lg{k} directed lw{k}", f"""!SELECT wa, wb, sum(w * p * za) / sum(w) AS ga, sum(w * p * zb) / sum(w) AS gb FROM (SELECT za, zb, wa, wb, abs((x.g - y.g) * (x.d - y.d)) AS w, 1 / (1 + exp(0.0 + za * wa + zb * wb)) AS p
          FROM directed q JOIN lg{k} x ON x.date = q.date AND x.stock_code = q.anchor JOIN lg{k} y ON y.date = q.date AND y.stock_code = q.opponent CROSS JOIN lw{k}) GROUP BY wa, wb""")
        part(f"lc{k}", f"ld{k}", f"!SELECT CAST(i - 1 AS INTEGER) AS c, wa + t * ga AS wa, wb + t * gb AS wb FROM ld{k} CROSS JOIN (SELECT unnest([{', '.join(map(str, STEPS))}]) AS t, unnest(range(1, {len(STEPS) + 1})) AS i)")
        part(f"lt{k}", f"lc{k} feat_l", "!" + gains(f"lc{k}"))
        part(f"ln{k}", f"lt{k}", "!" + ndcg(f"lt{k}"))
        part(f"lm{k}", f"lg{k}", "!" + ndcg(f"lg{k}"))
        part(f"lw{k + 1}", f"lw{k} lc{k} ln{k} lm{k}", f"""!SELECT 0 AS c, coalesce(n.wa, o.wa) AS wa, coalesce(n.wb, o.wb) AS wb FROM lw{k} o LEFT JOIN (
          SELECT wa, wb FROM lc{k} JOIN ln{k} USING (c) WHERE ln{k}.m >= (SELECT m FROM lm{k}) - 1e-12 ORDER BY c LIMIT 1) n ON TRUE""")
    return f"lw{ROUNDS}"


_weights = lambda_parts()


def lambda_fit(spark, sf_dir, rounds, steps):
    x = features(spark, sf_dir)
    rings = M.date_rings(x, "target", 3, 2, carry=["target", "rank_target", *FEATURES])
    return M.lambda_rank_fit(rings, x, FEATURES, "target", "rank_target", FIRST, CUT, rounds, steps, parts(spark, proxy.panel_files(sf_dir)))


@query("m4_lambda_weighted_rank_fit", _weights, f"SELECT unnest(['a', 'b']) AS feature, unnest([wa, wb]) AS coefficient FROM {_weights}", "feature ~coefficient")
def _(spark, sf_dir):
    x = features(spark, sf_dir)
    fitted, _ = lambda_fit(spark, sf_dir, ROUNDS, STEPS)
    return M.coefficients_frame(x, fitted)


@query("m4_lambda_first_gradient", "ld0", "SELECT unnest(['a', 'b']) AS feature, unnest([ga, gb]) AS gradient FROM ld0", "feature ~gradient")
def _(spark, sf_dir):
    _, seen = lambda_fit(spark, sf_dir, 1, ())
    return spark.createDataFrame(list(zip(FEATURES, seen[0].gradient if seen else [], strict=False)), "feature string, gradient double")


@query("m5_sample_date_pairs", "ring", M5, "date anchor opponent kind")
def _(spark, sf_dir):
    return M.sample_date_pairs(features(spark, sf_dir), "target", 3, 2)


part("tops", "featr", """SELECT *, row_number() OVER (PARTITION BY date, g ORDER BY h, s) - 1 AS i FROM (SELECT date, stock_code AS s, md5('7|' || date || '|' || stock_code) AS h, CASE WHEN rank_target >= 0.9 THEN 1 WHEN rank_target >= 0.7 THEN 2 ELSE 3 END AS g, rank_target AS r FROM featr WHERE rank_target IS NOT NULL)""")
part("tb", "tops", "SELECT date, s, row_number() OVER (PARTITION BY date ORDER BY h, s) - 1 AS i, count(*) OVER (PARTITION BY date) AS n FROM tops WHERE g = 2")
part("tw", "tops", "SELECT date, s, row_number() OVER (PARTITION BY date ORDER BY h, s) - 1 AS i, count(*) OVER (PARTITION BY date) AS n FROM tops WHERE g > 1")
part("close_pairs", "tops tb", "SELECT p.date, p.s AS positive, b.s AS negative, 'boundary' AS kind FROM tops p CROSS JOIN (VALUES (0), (1)) AS o(d) JOIN tb b ON b.date = p.date AND b.i = (p.i * 2 + o.d) % b.n WHERE p.g = 1 AND o.d < b.n")


@query("m6_sample_top_pairs", "close_pairs tw", """SELECT * FROM close_pairs UNION ALL SELECT p.date, p.s, b.s, 'broad' FROM tops p CROSS JOIN (VALUES (0), (1), (2)) AS o(d) JOIN tw b ON b.date = p.date AND b.i = (p.i * 3 + o.d) % b.n
  WHERE p.g = 1 AND o.d < b.n AND NOT EXISTS (SELECT 1 FROM close_pairs c WHERE c.date = p.date AND c.positive = p.s AND c.negative = b.s)""", "date positive negative kind")
def _(spark, sf_dir):
    return M.sample_top_pairs(features(spark, sf_dir), "rank_target", 2, 3, empty="skip")


@query("m6_dates_without_pairs", "tops", """SELECT date, unnest(list_filter([CASE WHEN a = 0 THEN 'positive' END, CASE WHEN b = 0 THEN 'boundary' END, CASE WHEN b + c = 0 THEN 'broad' END], lambda x: x IS NOT NULL)) AS pool FROM (
  SELECT date, count(*) FILTER (WHERE g = 1) AS a, count(*) FILTER (WHERE g = 2) AS b, count(*) FILTER (WHERE g = 3) AS c FROM tops WHERE CAST(substr(s, 2) AS INTEGER) % 3 <> month(date) % 3 GROUP BY date)""", "date pool")
def _(spark, sf_dir):
    # A third of the stocks is missing in turn, so that some pools are empty.
    x = features(spark, sf_dir).where(F.substring("stock_code", 2, 6).cast("int") % 3 != F.month("date") % 3)
    return M.dates_without_pairs(x, "rank_target")


@query("m7_score_frame", "feat", f"""SELECT date, stock_code, score, CASE WHEN count(*) OVER (PARTITION BY date) > 1 THEN ({rank_sql('score', 'date')} - 1) / (count(*) OVER (PARTITION BY date) - 1) ELSE 0.0 END AS pred_rank_pct,
  rank() OVER (PARTITION BY date ORDER BY score DESC) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0 AS pred_rank_position FROM (SELECT *, 0.5 + a * 0.25 + b * -0.5 AS score FROM feat)""", "date stock_code ~score ~pred_rank_pct ~pred_rank_position")
def _(spark, sf_dir):
    scored = M.score_frame(features(spark, sf_dir), M.linear_score({"a": 0.25, "b": -0.5, "intercept": 0.5}))
    return scored.select("date", "stock_code", "score", "pred_rank_pct", "pred_rank_position")


#: A preprocessor and a ridge fitted on the dates before a year, applied to the dates from it on.
SPLIT = 1998
part("rkstat", "featr", f"SELECT avg(a) AS ua, stddev_pop(a) AS sa, avg(b) AS ub, stddev_pop(b) AS sb FROM featr WHERE rank_target IS NOT NULL AND year(date) < {SPLIT}")
part("rkfit", "featr rkstat", f"""SELECT (sbb * sat - sab * sbt) / (saa * sbb - sab * sab) AS wa, (saa * sbt - sab * sat) / (saa * sbb - sab * sab) AS wb, ma, mb, mt FROM (
  SELECT sum(w * (a - ma) * (a - ma)) + 0.1 * sum(w) AS saa, sum(w * (b - mb) * (b - mb)) + 0.1 * sum(w) AS sbb, sum(w * (a - ma) * (b - mb)) AS sab, sum(w * (a - ma) * (t - mt)) AS sat, sum(w * (b - mb) * (t - mt)) AS sbt, any_value(ma) AS ma, any_value(mb) AS mb, any_value(mt) AS mt FROM (
    SELECT *, sum(w * a) OVER () / sum(w) OVER () AS ma, sum(w * b) OVER () / sum(w) OVER () AS mb, sum(w * t) OVER () / sum(w) OVER () AS mt FROM (
      SELECT (a - ua) / sa AS a, (b - ub) / sb AS b, rank_target AS t, 1.0 / count(*) OVER (PARTITION BY date) AS w FROM featr CROSS JOIN rkstat WHERE rank_target IS NOT NULL AND year(date) < {SPLIT})))""")


@query("m7_fitted_ranker", "featr rkstat rkfit", f"""SELECT date, stock_code, score, CASE WHEN count(*) OVER (PARTITION BY date) > 1 THEN ({rank_sql('score', 'date')} - 1) / (count(*) OVER (PARTITION BY date) - 1) ELSE 0.0 END AS pred_rank_pct,
  rank() OVER (PARTITION BY date ORDER BY score DESC) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0 AS pred_rank_position FROM (
    SELECT date, stock_code, mt - wa * ma - wb * mb + (a - ua) / sa * wa + (b - ub) / sb * wb AS score FROM featr CROSS JOIN rkstat CROSS JOIN rkfit WHERE year(date) >= {SPLIT})""", "date stock_code ~score ~pred_rank_pct ~pred_rank_position")
def _(spark, sf_dir):
    x = features(spark, sf_dir)
    fitted = M.fit_ranker(x.where(F.year("date") < SPLIT), FEATURES, "rank_target", 0.1, industries=False)
    kept = M.Ranker.from_json(fitted.to_json())
    return kept.scored(x.where(F.year("date") >= SPLIT)).select("date", "stock_code", "score", "pred_rank_pct", "pred_rank_position")


@query("m8_ranking_layout", "feat", "SELECT date, count(*) AS group_size, CAST(coalesce(sum(count(*)) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_row FROM feat GROUP BY date", "date group_size first_row")
def _(spark, sf_dir):
    return M.ranking_layout(features(spark, sf_dir))


@query("d1_label_decomposition", "feat", """SELECT date, stock_code, market_part, industry_part, target - market_part - industry_part AS alpha_part FROM (SELECT *, CASE WHEN industry = 'UNKNOWN' THEN 0.0 ELSE (im - market_part) * n / (n + 10.0) END AS industry_part FROM (
  SELECT date, stock_code, target, CASE WHEN industry = 'ASIA' THEN 'UNKNOWN' ELSE industry END AS industry, avg(target) OVER (PARTITION BY date) AS market_part, avg(target) OVER (PARTITION BY date, industry) AS im, count(target) OVER (PARTITION BY date, industry) AS n FROM feat))""", "date stock_code ~market_part ~industry_part ~alpha_part")
def _(spark, sf_dir):
    x = features(spark, sf_dir).withColumn("industry", F.when(F.col("industry") == "ASIA", "UNKNOWN").otherwise(F.col("industry")))
    return E.label_decomposition(x, "target").select("date", "stock_code", "market_part", "industry_part", "alpha_part")


@query("d2_expanding_folds", "feat cal", "SELECT CAST(f AS INTEGER) AS fold, CASE WHEN year(date) = f THEN 'predict' ELSE 'train' END AS part, date, stock_code FROM (SELECT x.date, x.stock_code, c.date AS e FROM feat x LEFT JOIN cal c ON c.pos = x.pos + 6) CROSS JOIN (VALUES (1998), (1999)) AS y(f) WHERE year(date) = f OR (year(date) < f AND year(e) < f)", "fold part date stock_code")
def _(spark, sf_dir):
    p = proxy.days(spark, sf_dir)
    x = features(spark, sf_dir).join(by_day(exit_date(calendar_index(p), 5)), "date", "left")
    return E.expanding_folds(x, [1998, 1999], "exit_date")


#: Fold years, and the rows that each may learn from: those whose label has ended before it.
YEARS = (1997, 1998, 1999)
part("oofrows", "featr cal", f"SELECT a, b, rank_target AS t, w, f FROM (SELECT x.a, x.b, x.rank_target, 1.0 / count(*) OVER (PARTITION BY x.date) AS w, year(c.date) AS e FROM featr x JOIN cal c ON c.pos = x.pos + 6 WHERE x.rank_target IS NOT NULL) CROSS JOIN (SELECT unnest([{', '.join(map(str, YEARS))}]) AS f) WHERE e < f")
part("oofmean", "oofrows", "SELECT f, sum(w) AS sw, sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb, sum(w * t) / sum(w) AS mt FROM oofrows GROUP BY f")
part("ooffit", "oofrows oofmean", """SELECT f, na / det AS a, nb / det AS b, mt - na / det * ma - nb / det * mb AS c FROM (SELECT *, saa * sbt - sab * sat AS nb, sbb * sat - sab * sbt AS na, saa * sbb - sab * sab AS det FROM (
  SELECT f, sum(w * (a - ma) * (a - ma)) + 0.1 * any_value(sw) AS saa, sum(w * (b - mb) * (b - mb)) + 0.1 * any_value(sw) AS sbb, sum(w * (a - ma) * (b - mb)) AS sab, sum(w * (a - ma) * (t - mt)) AS sat, sum(w * (b - mb) * (t - mt)) AS sbt,
    any_value(ma) AS ma, any_value(mb) AS mb, any_value(mt) AS mt FROM oofrows JOIN oofmean USING (f) GROUP BY f))""")
part("oof", "featr ooffit", "SELECT x.date, x.stock_code, x.target, f AS fold, p.c + p.a * x.a + p.b * x.b AS score FROM featr x JOIN ooffit p ON year(x.date) = p.f")


def with_exit(spark, sf_dir):
    return features(spark, sf_dir).join(by_day(exit_date(calendar_index(proxy.days(spark, sf_dir)), 5)), "date", "left")


def out_of_fold(spark, sf_dir):
    x = with_exit(spark, sf_dir)
    return M.out_of_fold_scores(x, M.expanding_ridge(x, FEATURES, "rank_target", "exit_date", YEARS, 0.1))


@query("d2_expanding_ridge", "ooffit", "SELECT CAST(f AS INTEGER) AS fold, unnest(['a', 'b', 'intercept']) AS feature, unnest([a, b, c]) AS coefficient FROM ooffit", "fold feature ~coefficient")
def _(spark, sf_dir):
    x = with_exit(spark, sf_dir)
    fits = M.expanding_ridge(x, FEATURES, "rank_target", "exit_date", YEARS, 0.1)
    return spark.createDataFrame([(fold, k, v) for fold, fitted in fits.items() for k, v in fitted.items()], "fold int, feature string, coefficient double")


@query("d2_out_of_fold_scores", "oof", "SELECT date, stock_code, CAST(fold AS INTEGER) AS fold, score FROM oof", "date stock_code fold ~score")
def _(spark, sf_dir):
    return out_of_fold(spark, sf_dir).select("date", "stock_code", "fold", "score")


@query("d4_out_of_fold_calibration", "oof", "SELECT 'ridge' AS model, CASE WHEN s > 0 THEN s ELSE 1.0 END AS slope, CASE WHEN s > 0 THEN mt - s * ms ELSE 0.0 END AS intercept FROM (SELECT covar_samp(score, target) / nullif(var_samp(score), 0) AS s, avg(score) AS ms, avg(target) AS mt FROM oof WHERE target IS NOT NULL)", "model ~slope ~intercept")
def _(spark, sf_dir):
    return E.linear_calibration(out_of_fold(spark, sf_dir).withColumn("model", F.lit("ridge")))


@query("d4_linear_calibration", "pred", "SELECT model, CASE WHEN s > 0 THEN s ELSE 1.0 END AS slope, CASE WHEN s > 0 THEN mt - s * ms ELSE 0.0 END AS intercept FROM (SELECT model, covar_samp(score, target) / nullif(var_samp(score), 0) AS s, avg(score) AS ms, avg(target) AS mt FROM pred WHERE target IS NOT NULL GROUP BY model)", "model ~slope ~intercept")
def _(spark, sf_dir):
    return E.linear_calibration(predictions(spark, sf_dir))


@query("d5_mse_skill", "pred", f"""SELECT date, one AS mse, two AS reference_mse, two - one AS mse_difference, 1 - one / nullif(two, 0) AS skill FROM (SELECT date, avg(e) FILTER (WHERE model = 'one') AS one, avg(e) FILTER (WHERE model = 'two') AS two FROM (
  SELECT date, model, rank_target, pow(p - rank_target, 2) AS e FROM (SELECT *, CASE WHEN count(*) OVER d > 1 THEN ({rank_sql('score', DAY)} - 1) / (count(*) OVER d - 1) ELSE 0.5 END AS p FROM pred WINDOW d AS (PARTITION BY model, date)) WHERE rank_target IS NOT NULL) GROUP BY date)""", "date ~mse ~reference_mse ~mse_difference ~skill")
def _(spark, sf_dir):
    return E.mse_skill(predictions(spark, sf_dir), "one", "two")
