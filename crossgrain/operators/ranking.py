"""Data operations and distributed fits of ranking models.

Pair samples come from rings: a date's rows in an order, of which each anchor takes some that follow
it. Draws are deterministic, the same on any engine, and linear in the rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossgrain.functions.columns import average_rank, rank_percentile
from crossgrain.operators.boosting import boosted_trees
from crossgrain.operators.cross_section import equal_date_weights, fit_industries, fit_scale, industry_one_hot, standard_scale
from crossgrain.sources.layout import laid
from crossgrain.sources.scratch import Temporary, materialize


def ridge_fit(rows: DataFrame, features: Sequence[str], label: str, strength: float, weight: Column | None = None) -> dict[str, float]:
    """Coefficients (and 'intercept') of the weighted ridge with penalty strength * sum of weights.

    Moments are summed in Spark; their sum, one matrix, comes to the driver, which solves the system of a
    few hundred unknowns.
    """
    return solved(moments(weighted_rows(rows, features, label, F.lit(0), weight).select("w", "v"), len(features) + 1), features, strength)


#: Values up to which moments are sums in the JVM; more are sums of matrices in Python.
FEW_VALUES = 20


def few_moments(x: DataFrame, k: int) -> dict[object, np.ndarray]:
    """`moments` by the column `key` (a few values), as one aggregate of sums."""
    v = [F.lit(1.0), *[F.col("v")[i] for i in range(k)]]
    ok = reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in v[1:]])
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    out = {}
    for r in x.where(ok).groupBy("key").agg(*[F.sum(F.col("w") * v[i] * v[j]).alias(f"s{i}_{j}") for i, j in pairs]).collect():  # a row a key
        m = np.zeros((k + 1, k + 1))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        out[r.key] = m
    return out


def moments_by(x: DataFrame, k: int) -> dict[object, np.ndarray]:
    """For each `key`: the sum over rows (key, w, v) of w * (1, v)(1, v)', where v has k values; a null value makes the row count as nothing."""
    if k <= FEW_VALUES:
        return few_moments(x, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[object, np.ndarray] = {}
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            full, key = np.hstack([np.ones((len(v), 1)), v]), np.array(batch.column("key").to_pylist(), dtype=object)
            ok = np.isfinite(full).all(1)
            full, w, key = full[ok], batch.column("w").to_numpy()[ok], key[ok]
            for own in set(key.tolist()):
                rows = full[key == own]
                total[own] = total.get(own, 0.0) + (rows * w[key == own][:, None]).T @ rows
        for own, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([own] * m.size, pa.int64()), pa.array(range(m.size), pa.int32()), pa.array(m.ravel())], names=["key", "at", "s"])

    summed = x.select(F.col("key").cast("long").alias("key"), "w", "v").mapInArrow(run, "key long, at int, s double").groupBy("key", "at").agg(F.sum("s").alias("s")).toPandas()
    return {key: g.sort_values("at")["s"].to_numpy().reshape(k + 1, k + 1) for key, g in summed.groupby("key")}  # a matrix a key


def solved(sums: np.ndarray, features: Sequence[str], strength: float) -> dict[str, float]:
    """The ridge's coefficients from its moments."""
    k = len(features)
    total, mean = sums[0, 0], sums[0, 1:] / sums[0, 0]
    centred = sums[1:, 1:] - total * np.outer(mean, mean)
    beta = np.linalg.solve(centred[:-1, :-1] + strength * total * np.eye(k), centred[:-1, -1])
    return dict(zip(features, beta.tolist(), strict=True)) | {"intercept": float(mean[-1] - beta @ mean[:-1])}


def weighted_rows(rows: DataFrame, features: Sequence[str], label: str, key: Column, weight: Column | None = None) -> DataFrame:
    """key, w and v (features and label) of the labelled rows; each date weighs the same unless a weight is given."""
    values = F.array(*[F.col(c).cast("double") for c in (*features, label)])
    return rows.where(F.col(label).isNotNull()).select(key.alias("key"), (weight if weight is not None else equal_date_weights()).cast("double").alias("w"), values.alias("v"))


def expanding_ridge(rows: DataFrame, features: Sequence[str], label: str, exit_column: str, years: Sequence[int], strength: float, weight: Column | None = None) -> dict[int, dict[str, float]]:
    """For each fold year the ridge over all rows whose labels end before it, all from one scan.

    A row belongs to the year in which its label ends, which is never before its own; moments are summed
    by that year, and a fold's are the sum of those of earlier years, so rows whose label reaches into
    the fold's year are left out. Years without rows to learn from have no fit.
    """
    by_year = moments_by(weighted_rows(rows.where(F.col(exit_column).isNotNull()), features, label, F.year(exit_column), weight), len(features) + 1)
    out = {}
    for fold in years:
        before = [m for year, m in by_year.items() if year < fold]
        if before:
            out[fold] = solved(sum(before), features, strength)
    return out


def out_of_fold_scores(rows: DataFrame, fits: Mapping[int, Mapping[str, float]]) -> DataFrame:
    """rows of the folds' years with fold and `score`, each by the fit that hasn't seen its year."""
    year, score = F.year("date"), F.lit(None).cast("double")
    for fold, fitted in fits.items():
        score = F.when(year == fold, linear_score(fitted)).otherwise(score)
    return rows.where(year.isin(*fits) if fits else F.lit(False)).withColumn("fold", year.cast("int")).withColumn("score", score)


def moments(x: DataFrame, k: int) -> np.ndarray:
    """`moments_by` of rows (w, v) of one key."""
    found = moments_by(x.withColumn("key", F.lit(0)), k)
    return found.get(0, np.zeros((k + 1, k + 1)))


def coefficients_frame(df: DataFrame, fitted: Mapping[str, float]) -> DataFrame:
    return df.sparkSession.createDataFrame([(k, float(v)) for k, v in fitted.items()], "feature string, coefficient double")


def linear_score(fitted: Mapping[str, float]) -> Column:
    """The fitted dot product as an expression."""
    return sum((F.col(f) * F.lit(w) for f, w in fitted.items() if f != "intercept"), F.lit(fitted.get("intercept", 0.0)))


@dataclass(frozen=True)
class Ranker:
    """A fitted preprocessor with a linear model over what it makes: fitted once, kept as text, applied later.

    scale: mean and deviation of each column, in the order that rows must have them; industries: the
    vocabulary whose indicators follow (none: no indicators), UNKNOWN last; weights: by name, and intercept.
    """

    scale: dict[str, tuple[float, float]]
    industries: tuple[str, ...]
    weights: dict[str, float]

    def score(self) -> Column:
        """The score as an expression: a missing value counts as its mean, an unseen industry as UNKNOWN."""
        parts = [F.coalesce((F.col(c) - mean) / deviation, F.lit(0.0)) * F.lit(self.weights[c]) for c, (mean, deviation) in self.scale.items()]
        if self.industries:
            own = F.lit(self.weights["industry_UNKNOWN"])
            for name in self.industries:
                own = F.when(F.col("industry") == name, self.weights[f"industry_{name}"]).otherwise(own)
            parts.append(own)
        return sum(parts, F.lit(self.weights["intercept"]))

    def scored(self, rows: DataFrame) -> DataFrame:
        """`score_frame` of rows, which must have all columns of the fit."""
        missing = [c for c in (*self.scale, *(("industry",) if self.industries else ())) if c not in rows.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        return score_frame(rows, self.score())

    def to_json(self) -> str:
        return json.dumps({"scale": list(self.scale.items()), "industries": self.industries, "weights": self.weights}, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Ranker:
        x = json.loads(text)
        return cls({c: tuple(s) for c, s in x["scale"]}, tuple(x["industries"]), x["weights"])


def fit_ranker(rows: DataFrame, columns: Sequence[str], label: str, strength: float, industries: bool = True) -> Ranker:
    """Means, deviations, vocabulary and ridge of the labelled rows, each date weighing the same."""
    train = rows.where(F.col(label).isNotNull())
    scale = fit_scale(train, columns)
    known = tuple(fit_industries(train)) if industries else ()
    x = standard_scale(train.select("date", label, *(("industry",) if industries else ()), *columns), scale).fillna(0.0, list(columns))
    x = industry_one_hot(x, known) if known else x
    weights = ridge_fit(x, [*columns, *([f"industry_{v}" for v in (*known, "UNKNOWN")] if known else [])], label, strength)
    return Ranker(scale, known, weights)


def score_frame(rows: DataFrame, score: Column, by: Sequence[str] = ("date",)) -> DataFrame:
    """rows with score, pred_rank_pct (1 is best; 0 for a single row) and pred_rank_position (average rank from the top)."""
    x = rows.withColumn("score", score)
    return x.withColumn("pred_rank_pct", rank_percentile("score", *by, single=0.0)).withColumn("pred_rank_position", average_rank("score", *by, descending=True))


def gbt_rank_regression(rows: DataFrame, features: Sequence[str], label: str, max_depth: int = 5, rounds: int = 20, step: float = 0.1, **more: object) -> DataFrame:
    """rows with `score` of boosted trees (`boosted_trees`) on the rank label, each date weighing the same."""
    return boosted_trees(rows, features, label, depth=max_depth, rounds=rounds, step=step, **more).scored(rows)


def _hash(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


#: Columns in which pairs carry the values of their two rows.
CARRIED = ("anchor_row", "opponent_row")


def date_rings(rows: DataFrame, target: str, broad: int, nearest: int, seed: int = 7, carry: Sequence[str] = ()) -> DataFrame:
    """date, stock_code, v, place, asked: where each row stands in its date's ring by target, and the places of its opponents with their kind.

    Opponents are those of `sample_date_pairs`. A row without a target has no place and no opponents. v has the columns
    of `carry`. Rows that lie by date already aren't shuffled.
    """
    x = rows.where(F.col("date").isNotNull()).select("date", F.col("stock_code").alias("s"), F.col(target).alias("t"), F.struct(*carry).alias("v") if carry else F.lit(None).alias("v"), _hash(seed, "date", "stock_code").alias("h"))
    x = x.withColumn("out", F.col("t").isNull())
    day, tie = Window.partitionBy("date", "out"), Window.partitionBy("date", "out", "t")
    x = x.withColumn("i", F.row_number().over(day.orderBy("h", "s")) - 1).withColumn("n", F.count(F.lit(1)).over(day))
    x = x.withColumn("j", F.row_number().over(day.orderBy("t", "h", "s")) - 1).withColumn("m", F.count(F.lit(1)).over(tie)).withColumn("r", F.row_number().over(tie.orderBy("h", "s")) - 1)
    x = x.withColumn("g", F.dense_rank().over(day.orderBy("t"))).withColumn("others", F.col("n") - F.col("m")).withColumn("start", F.col("j") - F.col("r")).drop("h", "n", "r")
    # The next targets on either side, with their numbers of rows; null beyond the ends.
    sides = [k for k in range(-nearest, nearest + 1) if k]
    x = x.select("*", *[F.max(F.struct("m", "t")).over(day.orderBy("g").rangeBetween(k, k)).alias(f"side{k}") for k in sides]).drop("g")
    size = lambda k: F.coalesce(F.col(f"side{k}.m"), F.lit(0))
    count = lambda most, there: F.transform(F.array_repeat(F.lit(0), F.least(F.lit(most), there).cast("int")), lambda _, d: d.cast("long"))

    def among(k: int) -> Column:
        """Up to `nearest` rows of the k-th next target: distance, target, number, place."""
        ahead = sum((size(q) for q in range(1, k)), F.col("start") + F.col("m")) if k > 0 else F.col("start") - sum((size(q) for q in range(k, 0)), F.lit(0))
        other, own = F.col(f"side{k}.t"), F.greatest(size(k), F.lit(1))
        return F.transform(count(nearest, size(k)), lambda d: F.struct(F.abs(F.col("t") - other).alias("far"), other.alias("ot"), d.alias("d"), (ahead + (F.col("i") + d) % own).alias("place")))

    rest = F.greatest(F.col("others"), F.lit(1))
    step = F.greatest(F.lit(1), F.floor(F.col("others") / broad)) if broad else F.lit(1)
    spread = F.transform(count(broad, F.col("others")), lambda d: F.struct(F.lit("broad").alias("kind"), ((F.col("start") + F.col("m") + (F.col("i") + d * step) % rest) % (F.col("others") + F.col("m"))).cast("long").alias("place")))
    near = F.slice(F.array_sort(F.concat(*[among(k) for k in sides])), 1, nearest) if nearest else F.array()
    near = F.transform(near, lambda c: F.struct(F.lit("nearest").alias("kind"), c["place"].cast("long").alias("place"))) if nearest else F.slice(spread, 1, 0)
    return x.select("date", F.col("s").alias("stock_code"), "v", F.when(~F.col("out"), F.col("j").cast("long")).alias("place"), F.concat(spread, near).alias("asked"))


def sample_date_pairs(rows: DataFrame, target: str, broad: int, nearest: int, seed: int = 7, carry: Sequence[str] = ()) -> DataFrame:
    """date, anchor, opponent, kind: for each row `broad` opponents spread over its date, and the `nearest` by target.

    No opponent ties with its anchor, and each anchor gets its full number, or all there are. The
    rows of a date stand in a ring by target, in which those that an anchor ties with are its
    neighbours; broad opponents follow in equal steps on the rest of the ring, from a hashed start.
    Of equally near ones the lower target comes first, then rows in hashed order from a hashed start.

    Each row works out the places of its opponents, and meets them in a window by (date, place), so rows that
    lie by date already aren't shuffled. carry: columns that come along for both rows, in `CARRIED`.
    """
    x = date_rings(rows.where(F.col(target).isNotNull()), target, broad, nearest, seed, carry)
    own = F.array(F.struct(F.lit(None).cast("string").alias("kind"), "place"))
    asked = x.select("date", F.col("stock_code").alias("s"), "v", F.inline(F.concat(own, "asked")))
    # A row without a kind stands at its own place, the others ask for who stands there.
    there = F.max(F.when(F.col("kind").isNull(), F.struct("s", "v"))).over(Window.partitionBy("date", "place"))
    met = asked.withColumn("o", there).where("kind is not null")
    carried = [F.col("v").alias(CARRIED[0]), F.col("o.v").alias(CARRIED[1])] if carry else []
    return met.select("date", F.col("s").alias("anchor"), F.col("o.s").alias("opponent"), "kind", *carried)


def dates_without_pairs(rows: DataFrame, rank: str, top: float = 0.9, edge: float = 0.7) -> DataFrame:
    """date, pool: dates that lack rows of rank >= top (positive), in [edge, top) (boundary) or under top (broad)."""
    r = F.col(rank)
    n = rows.where(r.isNotNull()).groupBy("date").agg(F.count_if(r >= top).alias("positive"), F.count_if((r >= edge) & (r < top)).alias("boundary"), F.count_if(r < top).alias("broad"))
    pools = F.array(*[F.when(F.col(c) == 0, F.lit(c)) for c in ("positive", "boundary", "broad")])
    return n.select("date", F.explode(F.filter(pools, lambda p: p.isNotNull())).alias("pool"))


def sample_top_pairs(rows: DataFrame, rank: str, boundary: int, broad: int, seed: int = 7, top: float = 0.9, edge: float = 0.7, empty: str = "fail") -> DataFrame:
    """date, positive, negative, kind: each row of rank >= top against rows of [edge, top) and of all under top.

    The two draws of a positive are disjoint. A date with an empty pool (`dates_without_pairs`) fails
    whatever reads the pairs, unless `empty` is "skip".
    """
    if empty not in ("fail", "skip"):
        raise ValueError("empty must be fail or skip")
    x = rows.where(F.col(rank).isNotNull()).select("date", F.col("stock_code").alias("s"), F.col(rank).alias("r"), _hash(seed, "date", "stock_code").alias("h"))

    def numbered(part: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("date")
        return part.select("date", F.col("s").alias(name), (F.row_number().over(w.orderBy("h", "s")) - 1).alias(f"_{name}"), F.count(F.lit(1)).over(w).alias(f"_n_{name}"))

    positives = numbered(x.where(F.col("r") >= top), "positive")

    def draw(pool: DataFrame, n: int, kind: str) -> DataFrame:
        sizes = pool.select("date", "_n_negative").distinct()
        asked = positives.join(sizes, "date").withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).where(F.col("d") < F.col("_n_negative"))
        asked = asked.withColumn("_negative", (F.col("_positive") * n + F.col("d")) % F.col("_n_negative")).drop("_n_negative")
        return asked.join(pool, ["date", "_negative"]).select("date", "positive", "negative", F.lit(kind).alias("kind"))

    close = draw(numbered(x.where((F.col("r") >= edge) & (F.col("r") < top)), "negative"), boundary, "boundary")
    wide = draw(numbered(x.where(F.col("r") < top), "negative"), broad, "broad")
    pairs = close.unionByName(wide.join(close.select("date", "positive", "negative"), ["date", "positive", "negative"], "left_anti"))
    if empty == "skip":
        return pairs
    failed = F.raise_error(F.concat_ws(" ", F.lit("no"), "pool", F.lit("rows on"), F.col("date").cast("string")))
    text = F.lit(None).cast("string")
    return pairs.unionByName(dates_without_pairs(rows, rank, top, edge).select("date", text.alias("positive"), text.alias("negative"), failed.cast("string").alias("kind")))


def pair_differences(pairs: DataFrame, rows: DataFrame, features: Sequence[str], better: str, worse: str) -> DataFrame:
    """pairs with x: features of `better` less those of `worse`."""
    values = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    a, b = rows.select("date", F.col("stock_code").alias(better), values.alias("_a")), rows.select("date", F.col("stock_code").alias(worse), values.alias("_b"))
    return pairs.join(a, ["date", better]).join(b, ["date", worse]).withColumn("x", F.zip_with("_a", "_b", lambda p, q: p - q)).drop("_a", "_b")


def directed_pairs(pairs: DataFrame, rows: DataFrame, features: Sequence[str], target: str, weight: Column | None = None, kept: Sequence[str] = ()) -> DataFrame:
    """date, anchor, opponent, w and z, the features of the row of higher target less the other's; ties are left out.

    Pairs that carry target and features of their rows aren't joined with `rows`; `kept` names carried columns that stay.
    """
    if set(CARRIED) <= set(pairs.columns):
        values = lambda row: F.array(*[F.coalesce(F.col(row)[f].cast("double"), F.lit(0.0)) for f in features])
        own = [F.col(row)[c].alias(f"{side}_{c}") for c in kept for row, side in zip(CARRIED, ("anchor", "opponent"), strict=True)]
        x = pairs.withColumns({"_ta": F.col(CARRIED[0])[target], "_to": F.col(CARRIED[1])[target]}).where("_ta <> _to")
        x = x.withColumn("x", F.zip_with(values(CARRIED[0]), values(CARRIED[1]), lambda p, q: p - q)).select("*", *own).drop(*CARRIED)
    else:
        t = rows.select("date", "stock_code", target)
        x = pairs.join(t.toDF("date", "anchor", "_ta"), ["date", "anchor"]).join(t.toDF("date", "opponent", "_to"), ["date", "opponent"]).where("_ta <> _to")
        x = pair_differences(x, rows, features, "anchor", "opponent")
    x = x.withColumn("w", weight if weight is not None else F.lit(1.0))
    return x.withColumn("z", F.when(F.col("_ta") > F.col("_to"), F.col("x")).otherwise(F.transform("x", lambda v: -v))).drop("_ta", "_to", "x")


def pair_margin(weights: Sequence[float]) -> Column:
    """The better row's score less the other's, of directed pairs."""
    return sum((F.col("z")[i] * F.lit(float(w)) for i, w in enumerate(weights)), F.lit(0.0))


def pair_loss(directed: DataFrame, weights: Sequence[float], strength: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of the pairwise logistic loss (a mean by weight) and half `strength` of the squared weights, as one aggregate."""
    k = len(weights)
    m = pair_margin(weights)
    loss = F.when(m > 0, F.log1p(F.exp(-m))).otherwise(F.log1p(F.exp(m)) - m)
    x = directed.select("w", "z", loss.alias("l"), (1 / (1 + F.exp(m))).alias("p"))  # p: how far from right
    curve = F.col("w") * F.col("p") * (1 - F.col("p"))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    r = x.agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("l")).alias("l"), *[F.sum(F.col("w") * F.col("p") * F.col("z")[i]).alias(f"g{i}") for i in range(k)], *[F.sum(curve * F.col("z")[i] * F.col("z")[j]).alias(f"h{i}_{j}") for i, j in pairs]).first()
    w, n = np.asarray(weights, float), r.n or 1.0
    hessian = strength * np.eye(k)
    for i, j in pairs:
        hessian[i, j] += (r[f"h{i}_{j}"] or 0.0) / n
        hessian[j, i] = hessian[i, j]
    return (r.l or 0.0) / n + strength * w @ w / 2, np.array([-(r[f"g{i}"] or 0.0) / n for i in range(k)]) + strength * w, hessian


def pairwise_rank_fit(pairs: DataFrame, rows: DataFrame, features: Sequence[str], target: str, weight: Column | None = None, strength: float = 1e-3, still: float = 1e-10) -> dict[str, float]:
    """Linear scores by pairwise logistic loss: pairs (date, anchor, opponent), the higher target being the better.

    Up to `FEW_VALUES` features by Newton's method, a job a step, until no entry of the gradient is over
    `still`: that gradient certifies the result. More features by quasi-Newton steps of Spark's regression.
    """
    with Temporary(rows.sparkSession):
        directed = materialize(directed_pairs(pairs, rows, features, target, weight).select("w", "z"), "directed")
        if len(features) > FEW_VALUES:
            train = directed.select(array_to_vector("z").alias("v"), F.lit(1.0).alias("y"), "w").unionByName(directed.select(array_to_vector(F.transform("z", lambda v: -v)).alias("v"), F.lit(0.0).alias("y"), "w"))
            model = LogisticRegression(featuresCol="v", labelCol="y", weightCol="w", fitIntercept=False, standardization=False, regParam=strength, maxIter=200, tol=1e-9).fit(train)
            return dict(zip(features, model.coefficients.toArray().tolist(), strict=True))
        w = np.zeros(len(features))
        loss, gradient, hessian = pair_loss(directed, w, strength)
        for _ in range(50):
            if np.abs(gradient).max(initial=0.0) <= still:
                break
            move = np.linalg.solve(hessian, gradient)
            for _ in range(30):  # a whole step, as a rule
                new = pair_loss(directed, w - move, strength)
                if new[0] <= loss + 1e-12:
                    break
                move = move / 2
            w, (loss, gradient, hessian) = w - move, new
    return dict(zip(features, w.tolist(), strict=True))


def lambda_weights(pairs: DataFrame, rows: DataFrame, score: str, rank: str, truncation: int = 100) -> DataFrame:
    """pairs with lambda_weight: |gain difference * discount difference| in the order of a given score.

    Gains are linear in the rank label; places beyond `truncation` have no discount.
    """
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.desc(score), "stock_code"))
    x = rows.where(F.col(rank).isNotNull()).select("date", "stock_code", F.col(rank).alias("g"), F.when(place <= truncation, 1 / F.log2(place + 1)).otherwise(0.0).alias("d"))
    y = pairs.join(x.toDF("date", "anchor", "_ga", "_da"), ["date", "anchor"]).join(x.toDF("date", "opponent", "_go", "_do"), ["date", "opponent"])
    return y.withColumn("lambda_weight", F.abs((F.col("_ga") - F.col("_go")) * (F.col("_da") - F.col("_do")))).drop("_ga", "_da", "_go", "_do")


@dataclass
class LambdaRound:
    """One round: weights it began with, their NDCG, and the mean gradient by pair weight."""

    weights: list[float]
    ndcg: float
    gradient: list[float]


def top_gains(rows: DataFrame, scores: Sequence[Column], rank: str, truncation: int, kept: Sequence[str] = ()) -> DataFrame:
    """candidate, date, stock_code, g (the rank label) and d (the discount of its place) of the first `truncation` places under each score.

    Further places have no discount; places are among all rows, those without a label left out afterwards. `kept` names columns that stay.
    """
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("candidate"), s.alias("s")) for i, s in enumerate(scores)]))
    place = F.row_number().over(Window.partitionBy("candidate", "date").orderBy(F.desc("s"), "stock_code"))
    x = rows.select("date", "stock_code", F.col(rank).alias("g"), *kept, each).withColumn("p", place).where(F.col("p") <= truncation)
    return x.where("g is not null").select("candidate", "date", "stock_code", "g", (1 / F.log2(F.col("p") + 1)).alias("d"), *kept)


def best_gains(rows: DataFrame, rank: str, truncation: int) -> DataFrame:
    """date and b, the discounted gains of the best order, where over 0: the same in every round."""
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.desc(rank), "stock_code"))
    x = rows.select("date", "stock_code", rank).where(F.col(rank).isNotNull()).withColumn("i", place).where(F.col("i") <= truncation)
    return x.groupBy("date").agg(F.sum(F.col(rank) / F.log2(F.col("i") + 1)).alias("b")).where("b > 0")


def mean_ndcg(gains: DataFrame, best: DataFrame, candidates: int) -> dict[int, float]:
    """By candidate: the mean over dates of the discounted gains over the best ones (gains are linear in the rank label)."""
    a = gains.groupBy("candidate", "date").agg(F.sum(F.col("g") * F.col("d")).alias("a"))
    every = best.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))))
    x = every.join(a, ["candidate", "date"], "left")
    return {r.candidate: r.m for r in x.groupBy("candidate").agg(F.avg(F.coalesce("a", F.lit(0.0)) / F.col("b")).alias("m")).collect()}  # a row a candidate


def rings_of(pairs: DataFrame, rows: DataFrame, carry: Sequence[str]) -> DataFrame:
    """As `date_rings`, of pairs (date, anchor, opponent) that are given: the place of a row is its number within the date."""
    number = F.row_number().over(Window.partitionBy("date").orderBy("stock_code"))
    x = rows.where(F.col("date").isNotNull()).select("date", "stock_code", F.struct(*carry).alias("v"), number.alias("place"))
    met = pairs.join(x.select("date", F.col("stock_code").alias("opponent"), "place"), ["date", "opponent"])
    return x.join(met.groupBy("date", F.col("anchor").alias("stock_code")).agg(F.collect_list(F.struct("place")).alias("asked")), ["date", "stock_code"], "left")


def first_pairs(x: DataFrame, first: DataFrame, n: int) -> DataFrame:
    """w and z of the pairs of which a row at least is among the first: two rows that are not weigh nothing.

    x: date, place, asked (places), t (target), g (rank label) and v (values), in `n` buckets of dates; first: date, place and d
    of the rows with a discount, of which those without a place are in no pair. These go to the rows of their dates, a map a date
    from their places, so x stays where it lies and no table of all pairs is made. Joined by date alone: a join by place as well
    would shuffle all pairs.
    """

    def met(rows: DataFrame, some: DataFrame, value: str) -> DataFrame:
        """rows with `there`, a map from place to value of the date's `some`."""
        there = some.where("place is not null").repartition(n, "date").groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("place", value))).alias("there"))
        return rows.join(there.hint("shuffle_hash"), "date")

    row = lambda d: F.struct("t", "g", "v", d.alias("d"))
    labelled, there = x.where("g is not null and place is not null"), F.col("there")
    named = materialize(met(labelled, first, "d").where(there[F.col("place")].isNotNull()).select("date", "place", "asked", row(there[F.col("place")]).alias("row")), "first")
    # Opponents among the first, of any anchor.
    other = met(labelled, named, "row").select("t", "g", "v", there[F.col("place")]["d"].alias("d"), "there", F.explode("asked").alias("other"))
    to_first = other.where(there[F.col("other")].isNotNull()).select(row(F.coalesce("d", F.lit(0.0))).alias("a"), there[F.col("other")].alias("o"))
    # Anchors among the first, of opponents that are not.
    asked = named.select("date", "row", F.explode("asked").alias("place")).join(named.select("date", "place"), ["date", "place"], "left_anti")
    asked = asked.groupBy("date", "place").agg(F.collect_list("row").alias("rows"))
    from_first = met(labelled, asked, "rows").where(there[F.col("place")].isNotNull()).select(F.explode(there[F.col("place")]).alias("a"), row(F.lit(0.0)).alias("o"))
    y = to_first.unionByName(from_first).where("a.t <> o.t")
    z = F.zip_with("a.v", "o.v", lambda p, q: F.when(F.col("a.t") > F.col("o.t"), p - q).otherwise(q - p))
    return y.select((F.abs(F.col("a.g") - F.col("o.g")) * F.abs(F.col("a.d") - F.col("o.d"))).alias("w"), z.alias("z"))


def lambda_rank_fit(pairs: DataFrame, rows: DataFrame, features: Sequence[str], target: str, rank: str, start: Sequence[float], truncation: int = 100, rounds: int = 5, steps: Sequence[float] = (1.0, 0.5, 0.25, 0.125), n: int | None = None) -> tuple[dict[str, float], list[LambdaRound]]:
    """Linear scores by lambda gradients, and what each round saw.

    A round places every date's rows by the present score, weighs each pair by what swapping its two would
    change (|gain difference * discount difference|, nothing beyond `truncation`), and sums over executors
    the gradient of the weighted logistic loss. Of the steps along it the first that doesn't lower the
    mean NDCG is taken, all of them tried in one job; if each would lower it, or `rounds` are over, the fit ends.

    pairs: date, anchor and opponent, or `date_rings` of all rows that carry target, rank and features: those aren't
    joined with `rows`. The rows are written once with the places of their opponents, in `n` buckets of dates (default:
    shuffle partitions); pairs are never written, as a round needs those of its first rows only.
    """
    w, seen, at = [float(c) for c in start], [], 0
    n = n or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = pairs if "asked" in pairs.columns else rings_of(pairs, rows, list(dict.fromkeys([target, rank, *features])))
    own, place = F.col("v"), lambda c: c["place"].cast("int")
    values = F.array(*[F.coalesce(own[f].cast("double"), F.lit(0.0)) for f in features])
    x = x.select("date", "stock_code", F.col("place").cast("int").alias("place"), F.transform("asked", place).alias("asked"), own[target].alias("t"), own[rank].alias("g"), values.alias("v"))
    score = lambda weights: sum((F.col("v")[i] * F.lit(c) for i, c in enumerate(weights)), F.lit(0.0))
    with Temporary(rows.sparkSession) as tables, laid(x, "rows", "date", n) as x:
        best = materialize(best_gains(x, "g", truncation), "best")
        gains = materialize(top_gains(x, [score(w)], "g", truncation, ["place"]), "gains")
        now = mean_ndcg(gains, best, 1).get(0, 0.0)
        for _ in range(rounds):
            y = first_pairs(x, gains.where(F.col("candidate") == at).select("date", "place", "d"), n)
            p = 1 / (1 + F.exp(pair_margin(w)))
            r = y.agg(F.sum("w").alias("n"), *[F.sum(F.col("w") * p * F.col("z")[i]).alias(f"g{i}") for i in range(len(w))]).first()
            if not r.n:
                break
            gradient = [r[f"g{i}"] / r.n for i in range(len(w))]
            seen.append(LambdaRound(w, now, gradient))
            if not steps:
                break
            tried = [[a + t * g for a, g in zip(w, gradient, strict=True)] for t in steps]
            tables.drop(gains)
            gains = materialize(top_gains(x, [score(v) for v in tried], "g", truncation, ["place"]), "gains")
            ndcg = mean_ndcg(gains, best, len(tried))
            better = next((i for i in range(len(tried)) if ndcg.get(i, 0.0) >= now - 1e-12), None)
            if better is None:
                break
            # What the step's order has is what the next round begins with.
            w, at, now = tried[better], better, ndcg.get(better, 0.0)
    return dict(zip(features, w, strict=True)), seen


def ranking_layout(rows: DataFrame) -> DataFrame:
    """date, group_size, first_row: where each date's group stands in the stable (date, stock) order."""
    g = rows.groupBy("date").agg(F.count(F.lit(1)).alias("group_size"))
    return g.withColumn("first_row", F.coalesce(F.sum("group_size").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
