"""Boosted trees on rank labels, grown from histograms.

Every feature is cut into bins of equal width over the rows to learn from. For a level of a tree Spark
sums, by node, feature and bin, what the rows still miss and what they weigh; the driver sees these
sums only and picks each node's split. Both are rounded to whole multiples of 1 / UNIT before they are
summed, so a fit doesn't depend on the order of rows and any engine gets the same trees.

A fitted ensemble is one expression of CASE WHEN over bins (`Boosted.sql`), which Spark and other
engines read alike; scoring is a projection.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossgrain.operators.cross_section import equal_date_weights
from crossgrain.sources.scratch import Temporary, materialize

#: Residuals and weights are whole multiples of 1 / UNIT; trees after which scores are written down.
UNIT, WRITTEN_EVERY = 1_000_000_000, 10


def number(x: float) -> str:
    """A double in SQL, whatever a literal would be."""
    return f"CAST({x!r} AS DOUBLE)"


@dataclass
class Tree:
    """Node i has the children 2i + 1 (bin <= cut) and 2i + 2; splits: node -> (feature, cut), leaves: node -> value."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)

    def sql(self, node: int = 0) -> str:
        if node in self.leaves:
            return number(self.leaves[node])
        f, cut = self.splits[node]
        return f"CASE WHEN bin_{f} <= {cut} THEN {self.sql(2 * node + 1)} ELSE {self.sql(2 * node + 2)} END"

    def node_sql(self, depth: int, node: int = 0) -> str:
        """The node on level `depth` that a row reaches, or the leaf above it, as a number."""
        if depth == 0 or node not in self.splits:
            return str(node)
        f, cut = self.splits[node]
        return f"CASE WHEN bin_{f} <= {cut} THEN {self.node_sql(depth - 1, 2 * node + 1)} ELSE {self.node_sql(depth - 1, 2 * node + 2)} END"


@dataclass
class Boosted:
    features: tuple[str, ...]
    bins: int
    ranges: tuple[tuple[float, float], ...]  # least value and width of all bins of each feature
    start: float
    trees: list[Tree] = field(default_factory=list)

    def bin_sql(self, i: int) -> str:
        """The bin of a feature; null, and what lies under all bins, is in the first."""
        low, span = self.ranges[i]
        if span <= 0:
            return "0"
        return f"CAST(coalesce(least({self.bins - 1}, greatest(0, floor(({self.features[i]} - {number(low)}) / {number(span)} * {self.bins}))), 0) AS INT)"

    def sql(self, first: int = 0) -> str:
        """The score from the bins, trees summed in their order; without the start from tree `first` on."""
        parts = [t.sql() for t in self.trees[first:]]
        return " + ".join(([number(self.start)] if not first else []) + parts) or number(0.0)

    def binned(self, rows: DataFrame) -> DataFrame:
        return rows.select("*", *[F.expr(self.bin_sql(i)).alias(f"bin_{i}") for i in range(len(self.features))])

    def scored(self, rows: DataFrame) -> DataFrame:
        """rows with score."""
        return self.binned(rows).withColumn("score", F.expr(self.sql())).drop(*[f"bin_{i}" for i in range(len(self.features))])


def whole(c: Column) -> Column:
    return F.floor(c * UNIT + 0.5).cast("long")


def best_split(sums: dict[tuple[int, int], tuple[int, int]], chosen: Sequence[int], bins: int, ridge: float, least: float) -> tuple[int, int, tuple[int, int], tuple[int, int]] | None:
    """feature, cut and the (residual, weight) sums of both children, from (feature, bin) -> sums; None if nothing is gained."""
    best, best_gain = None, 1e-12
    for f in chosen:
        every = [sums.get((f, b), (0, 0)) for b in range(bins)]
        all_g, all_h = (sum(x[k] for x in every) for k in (0, 1))
        g = h = 0
        for b in range(bins - 1):
            g, h = g + every[b][0], h + every[b][1]
            lg, lh, rg, rh = g / UNIT, h / UNIT, (all_g - g) / UNIT, (all_h - h) / UNIT
            if lh < least or rh < least:
                continue
            gain = lg * lg / (lh + ridge) + rg * rg / (rh + ridge) - (all_g / UNIT) * (all_g / UNIT) / (all_h / UNIT + ridge)
            if gain > best_gain:  # ties: the first feature, then the first bin
                best, best_gain = (f, b, (g, h), (all_g - g, all_h - h)), gain
    return best


def boosted_trees(
    rows: DataFrame, features: Sequence[str], label: str, depth: int = 3, rounds: int = 20, step: float = 0.1, bins: int = 32, ridge: float = 1.0, least: float = 1.0,
    feature_share: float = 1.0, validation: Column | None = None, patience: int = 3, seed: int = 7, weight: Column | None = None,
) -> Boosted:
    """Fits squared loss on the labelled rows, each date weighing the same unless a weight is given.

    A tree sees `feature_share` of the features, drawn by `seed`. Rows of `validation` (a condition, by
    date as a rule) teach nothing; growing stops once `patience` trees haven't lowered their error, and
    the trees after the best are dropped.
    """
    features = tuple(features)
    with Temporary(rows.sparkSession):
        x = rows.where(F.col(label).isNotNull()).withColumn("_held", F.coalesce(validation, F.lit(False)) if validation is not None else F.lit(False))
        x = x.select(*dict.fromkeys(features), F.col(label).cast("double").alias("_y"), (weight if weight is not None else equal_date_weights()).cast("double").alias("_w"), "_held")
        w = whole(F.col("_w"))
        learn = F.when(~F.col("_held"), 1)
        ends = [g(F.when(~F.col("_held"), F.col(c))).alias(f"{n}{i}") for i, c in enumerate(features) for n, g in (("low", F.min), ("high", F.max))]
        row = x.agg(F.sum(learn * whole(F.col("_w") * F.col("_y"))).alias("g"), F.sum(learn * w).alias("h"), *ends).first()
        if not row.h:
            return Boosted(features, bins, tuple((0.0, 0.0) for _ in features), 0.0)
        ranges = tuple((float(row[f"low{i}"] or 0.0), float((row[f"high{i}"] or 0.0) - (row[f"low{i}"] or 0.0))) for i in range(len(features)))
        model = Boosted(features, bins, ranges, row.g / row.h)
        held = materialize(model.binned(x).select("_y", "_w", "_held", *[f"bin_{i}" for i in range(len(features))], F.lit(model.start).alias("_f")), "binned")
        written, best, errors = 0, None, []
        for k in range(rounds):
            now = held.withColumn("_f", F.expr(" + ".join(["_f", *[t.sql() for t in model.trees[written:]]])))
            chosen = sorted(random.Random(f"{seed} {k}").sample(range(len(features)), max(1, round(feature_share * len(features)))))
            model.trees.append(grown(now.where("not _held"), chosen, depth, bins, step, ridge, least))
            if validation is not None:
                after = F.col("_f") + F.expr(model.trees[-1].sql()) - F.col("_y")
                errors.append(now.where("_held").agg(F.sum(whole(F.col("_w") * after * after))).first()[0] or 0)
                best = min(range(len(errors)), key=errors.__getitem__)
                if len(errors) - 1 - best >= patience:
                    break
            if len(model.trees) - written == WRITTEN_EVERY:
                held = materialize(now.withColumn("_f", F.col("_f") + F.expr(model.trees[-1].sql())), "binned")
                written = len(model.trees)
    if best is not None:
        model.trees = model.trees[: best + 1]
    return model


def grown(rows: DataFrame, chosen: Sequence[int], depth: int, bins: int, step: float, ridge: float, least: float) -> Tree:
    """One tree on what the scores `_f` still miss, a job for each level."""
    tree, leaf = Tree(), lambda g, h: step * (g / UNIT) / (h / UNIT + ridge)
    reached: dict[int, tuple[int, int] | None] = {0: None}
    for level in range(depth):
        if not reached:
            break
        cells = F.inline(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"bin_{f}").alias("b")) for f in chosen]))
        x = rows.select(F.expr(tree.node_sql(level)).alias("node"), whole(F.col("_w") * (F.col("_y") - F.col("_f"))).alias("g"), whole(F.col("_w")).alias("h"), cells)
        by_node: dict[int, dict[tuple[int, int], tuple[int, int]]] = {}
        for r in x.where(F.col("node").isin(*reached)).groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():  # nodes x features x bins
            by_node.setdefault(r.node, {})[r.f, r.b] = (r.g, r.h)
        after: dict[int, tuple[int, int] | None] = {}
        for node, known in reached.items():
            sums = by_node.get(node, {})
            split = best_split(sums, chosen, bins, ridge, least)
            if split is None:
                g, h = known or tuple(sum(v[k] for (f, _), v in sums.items() if f == chosen[0]) for k in (0, 1))
                tree.leaves[node] = leaf(g, h)
                continue
            f, cut, left, right = split
            tree.splits[node] = (f, cut)
            after[2 * node + 1], after[2 * node + 2] = left, right
        reached = after
    for node, (g, h) in reached.items():
        tree.leaves[node] = leaf(g, h)
    return tree
