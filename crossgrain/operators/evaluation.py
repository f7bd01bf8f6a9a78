"""Evaluation of ranking predictions: (model, date, stock_code, score, target, rank_target) rows.

The model is a column, so all models are evaluated by one job, partitioned by (model, date).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossgrain.functions.columns import average_rank, correlation, rank_percentile, ratio
from crossgrain.operators.cross_section import score_deciles, top_k
from crossgrain.sources.layout import laid_by
from crossgrain.sources.scratch import materialize

DAY = ["model", "date"]
#: Fixed value: the two-sided 95 % quantile of the normal distribution.
Z95 = 1.959964


def labelled(p: DataFrame) -> DataFrame:
    return p.where("rank_target is not null")


def days(p: DataFrame) -> DataFrame:
    return p.select(*DAY).distinct()


def rank_ic(p: DataFrame) -> DataFrame:
    """model, date, rank_ic: Spearman of score and rank label; null under two labels or for one distinct score."""
    x = labelled(p).withColumn("_a", average_rank("score", *DAY)).withColumn("_b", average_rank("rank_target", *DAY))
    return x.groupBy(*DAY).agg(correlation("_a", "_b").alias("rank_ic"))


def signed_pairs(x: np.ndarray, y: np.ndarray) -> int:
    """The sum of sign(x_i - x_j) * sign(y_i - y_j) over all pairs, bit by bit of the ranks of x."""
    r, s = np.unique(x, return_inverse=True)[1], np.unique(y, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(s, kind="stable")
    r, s, total = r[order], s[order], 0
    for bit in range(int(r.max(initial=0)).bit_length()):
        # Rows that agree above the bit meet: the upper half of them with the lower, in the order of y.
        above = r >> (bit + 1)
        at = np.argsort(above, kind="stable")
        group, label, low = above[at], s[at], 1 - (r[at] >> bit & 1)
        run = np.concatenate([[0], np.cumsum(low)])
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        cells = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
        sizes, ends = np.diff(starts, append=len(group)), np.append(starts[1:], len(group))
        first, last = np.repeat(run[starts], sizes), np.repeat(run[ends], sizes)
        lengths, cell_ends = np.diff(cells, append=len(group)), np.append(cells[1:], len(group))
        under, over = np.repeat(run[cells], lengths) - first, last - np.repeat(run[cell_ends], lengths)
        total += int(((1 - low) * (under - over)).sum())
    return total


#: Ranks of a block: what a task of pair counts holds in Python.
BLOCK_RANKS = 2048


def _block(rank: Column, tied: Column, width: int) -> Column:
    """Blocks of ranks in order, of under 2 * `width` rows each; more than `width` equal values are a block of their own."""
    return F.floor((rank - 1) / width).cast("long") * 2 + (tied > width).cast("long")


def _within(rows: DataFrame, block: str, x: str, y: str) -> DataFrame:
    """model, date, signed of the pairs inside each block."""
    keys = [*DAY, block]

    def count(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"model": [key[0].as_py()], "date": [key[1].as_py()], "signed": [signed_pairs(table.column(x).to_numpy(), table.column(y).to_numpy())]})

    schema = ", ".join(f"{k} {t}" for k, t in rows.select(*DAY).dtypes) + ", signed long"
    return rows.select(*keys, x, y).groupBy(*keys).applyInArrow(count, schema)


def pair_counts(p: DataFrame, width: int = BLOCK_RANKS) -> DataFrame:
    """model, date, signed, pairs, tied_score, tied_target over all pairs of a date's labelled rows.

    Pairs are counted, never made. A date's rows are cut into blocks of neighbouring scores, and into
    blocks of neighbouring labels. A pair is inside a block of scores, or else inside one of labels, or
    its two stand apart on both sides. The first two kinds are counted block by block, n log `width` in
    bounded memory; the third needs the sizes of the (block, block) tiles only, and is counted bit by bit
    of the score's block: at each bit, tiles that agree above it fall into a lower and an upper half, and
    a running count in the order of the label tells how many pairs between the halves are in order.

    Rows that lie by date already aren't shuffled again.
    """
    day = Window.partitionBy(*DAY)
    x = labelled(p).select(*DAY, F.col("score").alias("a"), F.col("rank_target").alias("b"))
    tied = lambda c: F.count(F.lit(1)).over(Window.partitionBy(*DAY, c))
    x = x.withColumn("r", F.rank().over(day.orderBy("a")).cast("long")).withColumn("ta", tied("a")).withColumn("s", F.rank().over(day.orderBy("b")).cast("long")).withColumn("tb", tied("b"))
    x = x.select(*DAY, "r", "s", "ta", "tb", _block(F.col("r"), F.col("ta"), width).alias("i"), _block(F.col("s"), F.col("tb"), width).alias("j"))
    sizes = x.groupBy(*DAY).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("ta") - 1) / 2).cast("long").alias("tied_score"), (F.sum(F.col("tb") - 1) / 2).cast("long").alias("tied_target"))
    # Equal values make no pair in order: a block of them alone has none inside.
    inside = _within(x.where(F.col("ta") <= width), "i", "r", "s").unionByName(_within(x.where(F.col("tb") <= width), "j", "i", "s"))
    tiles = x.groupBy(*DAY, "i", "j").agg(F.count(F.lit(1)).alias("n")).withColumn("top", F.max("i").over(day))
    tiles = tiles.withColumn("bit", F.explode(F.sequence(F.lit(0), F.length(F.bin("top")).cast("int") - 1)))
    upper = F.expr("shiftright(i, bit) & 1")
    cells = tiles.groupBy(*DAY, "bit", F.expr("shiftright(i, bit + 1)").alias("above"), "j").agg(F.sum((1 - upper) * F.col("n")).alias("low"), F.sum(upper * F.col("n")).alias("high"))
    cell = Window.partitionBy(*DAY, "bit", "above")
    under = F.coalesce(F.sum("low").over(cell.orderBy("j").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = F.sum("low").over(cell) - under - F.col("low")
    apart = cells.withColumn("signed", F.col("high") * (under - over)).groupBy(*DAY).agg(F.sum("signed").alias("signed"))
    signed = apart.unionByName(inside).groupBy(*DAY).agg(F.sum("signed").alias("signed"))
    return sizes.join(signed, DAY).select(*DAY, "signed", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"), "tied_score", "tied_target")


def kendall_tau(counts: DataFrame) -> DataFrame:
    """Tau-b: signed pairs over the root of the pairs that aren't tied on either side."""
    return counts.select(*DAY, ratio("signed", F.sqrt((F.col("pairs") - F.col("tied_score")).cast("double") * (F.col("pairs") - F.col("tied_target")))).alias("kendall_tau"))


def pairwise_accuracy(counts: DataFrame) -> DataFrame:
    """0.5 + 0.5 * signed / pairs with different labels, clipped: a tied score counts half."""
    share = ratio("signed", F.col("pairs") - F.col("tied_target"))
    return counts.select(*DAY, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + 0.5 * share)).alias("pairwise_accuracy"))


def rank_errors(p: DataFrame) -> DataFrame:
    """model, date, rank_mae, rank_rmse of the predicted percentile over all scored rows against the label."""
    x = labelled(p.withColumn("_p", rank_percentile("score", *DAY, single=0.5))).withColumn("_e", F.col("_p") - F.col("rank_target"))
    return x.groupBy(*DAY).agg(F.avg(F.abs("_e")).alias("rank_mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rank_rmse"))


def ndcg(p: DataFrame, k: int) -> DataFrame:
    """model, date, ndcg with gain 2**rank - 1; 0 where the ideal is 0."""
    w = Window.partitionBy(*DAY)
    x = labelled(p).withColumn("_r", F.row_number().over(w.orderBy(F.desc("score"), "stock_code"))).withColumn("_i", F.row_number().over(w.orderBy(F.desc("rank_target"), "stock_code")))
    gain = F.pow(F.lit(2.0), "rank_target") - 1
    part = lambda r: F.sum(F.when(F.col(r) <= k, gain / F.log2(F.col(r) + 1)))
    g = x.groupBy(*DAY).agg(part("_r").alias("_dcg"), part("_i").alias("_ideal"))
    return g.select(*DAY, F.when(F.col("_ideal") > 0, F.col("_dcg") / F.col("_ideal")).otherwise(0.0).alias("ndcg"))


def overlap_at_k(p: DataFrame, k: int) -> DataFrame:
    """model, date, precision, recall, jaccard of the predicted against the realised top k of the labelled rows."""
    w = Window.partitionBy(*DAY)
    x = labelled(p).withColumn("_r", F.row_number().over(w.orderBy(F.desc("score"), "stock_code")) <= k).withColumn("_i", F.row_number().over(w.orderBy(F.desc("rank_target"), "stock_code")) <= k)
    g = x.groupBy(*DAY).agg(F.count_if(F.col("_r") & F.col("_i")).alias("_both"), F.count_if("_r").alias("_p"), F.count_if("_i").alias("_t"), F.count_if(F.col("_r") | F.col("_i")).alias("_any"))
    return g.select(*DAY, ratio("_both", "_p").alias("precision"), ratio("_both", "_t").alias("recall"), ratio("_both", "_any").alias("jaccard"))


def cohort_returns(p: DataFrame, k: int) -> DataFrame:
    """Mean, median and number of targets of the top and bottom k of all scored rows, the universe's mean, excess and spread."""
    w = Window.partitionBy(*DAY)
    x = p.withColumn("_t", F.row_number().over(w.orderBy(F.desc("score"), "stock_code")) <= k).withColumn("_b", F.row_number().over(w.orderBy("score", "stock_code")) <= k)
    top, bottom = F.when(F.col("_t"), F.col("target")), F.when(F.col("_b"), F.col("target"))
    g = x.groupBy(*DAY).agg(
        F.avg(top).alias("top_mean"), F.median(top).alias("top_median"), F.count(top).alias("top_n"), F.avg(bottom).alias("bottom_mean"), F.median(bottom).alias("bottom_median"), F.count(bottom).alias("bottom_n"), F.avg("target").alias("universe_mean"),
    )
    return g.withColumn("top_excess", F.col("top_mean") - F.col("universe_mean")).withColumn("top_minus_bottom", F.col("top_mean") - F.col("bottom_mean"))


def decile_returns(p: DataFrame) -> DataFrame:
    """model, date, decile, mean, median, n for all ten deciles, empty ones as well; 1 holds the best scores."""
    x = p.withColumn("decile", score_deciles("score", *DAY))
    g = x.groupBy(*DAY, "decile").agg(F.avg("target").alias("mean"), F.median("target").alias("median"), F.count("target").alias("n"))
    full = days(p).withColumn("decile", F.explode(F.sequence(F.lit(1), F.lit(10))))
    return full.join(g, [*DAY, "decile"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def decile_summary(deciles: DataFrame) -> DataFrame:
    """model, date, decile_spread (best less worst) and monotonicity (rank correlation of strength and mean)."""
    x = deciles.where("mean is not null").withColumn("_s", average_rank(11 - F.col("decile"), *DAY)).withColumn("_m", average_rank("mean", *DAY))
    spread = F.max(F.when(F.col("decile") == 1, F.col("mean"))) - F.max(F.when(F.col("decile") == 10, F.col("mean")))
    return x.groupBy(*DAY).agg(spread.alias("decile_spread"), correlation("_s", "_m").alias("decile_monotonicity"))


def top_detail(p: DataFrame, k: int) -> DataFrame:
    return top_k(p, "score", k, DAY)


def daily_metrics(p: DataFrame, k: int, n: int | None = None) -> DataFrame:
    """All metrics, a row a (model, date). The predictions are written once, in `n` buckets of dates (default: shuffle
    partitions), and the pair counts: the metrics read them without an exchange."""
    n = n or int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = laid_by(p.select(*DAY, "stock_code", "score", "target", "rank_target"), "predictions", "date", n)
    counts = materialize(pair_counts(p), "pairs")
    size = p.groupBy(*DAY).agg(F.count(F.lit(1)).alias("scored"), F.count("rank_target").alias("labelled"))
    for part in (rank_ic(p), kendall_tau(counts), pairwise_accuracy(counts), rank_errors(p), ndcg(p, k), overlap_at_k(p, k), cohort_returns(p, k), decile_summary(decile_returns(p))):
        size = size.join(part, DAY, "left")
    return size


def period_metrics(daily: DataFrame, metrics: Sequence[str], period: str = "month") -> DataFrame:
    """model, period, days and means of the metrics by month (yyyy-MM) or year (yyyy)."""
    key = F.date_format("date", "yyyy-MM" if period == "month" else "yyyy").alias("period")
    return daily.groupBy("model", key).agg(F.count(F.lit(1)).alias("days"), *[F.avg(m).alias(m) for m in metrics])


def metric_summary(daily: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """model, days, mean_{metric}, and of the rank IC its deviation, ICIR (not annualised) and quantiles."""
    quantiles = [F.percentile("rank_ic", q).alias(f"rank_ic_q{int(q * 100)}") for q in (0.05, 0.25, 0.5, 0.75, 0.95)]
    g = daily.groupBy("model").agg(F.count(F.lit(1)).alias("days"), *[F.avg(m).alias(f"mean_{m}") for m in metrics], F.stddev_samp("rank_ic").alias("rank_ic_std"), F.avg("rank_ic").alias("_m"), *quantiles)
    return g.withColumn("rank_icir", ratio("_m", "rank_ic_std")).drop("_m")


def hac_mean_test(series: DataFrame, value: str, lag: int, by: Sequence[str] = ("model",)) -> DataFrame:
    """n, mean, se, t, low, high of each series: Bartlett weights over autocovariances up to `lag`."""
    w = Window.partitionBy(*by)
    x = series.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy("date"))).withColumn("_e", F.col(value) - F.avg(value).over(w))
    # Each row meets its `lag` predecessors by window, which is a join on the row number without the join.
    over = w.orderBy("_i")
    weighted = sum(((1 - j / (lag + 1)) * F.col("_e") * F.coalesce(F.lag("_e", j).over(over), F.lit(0.0)) for j in range(1, lag + 1)), F.lit(0.0))
    g = x.withColumn("_w", F.col("_e") * F.col("_e") + 2 * weighted).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.sum("_w").alias("_s"))
    g = g.withColumn("se", F.sqrt(F.greatest(F.col("_s"), F.lit(0.0))) / F.col("n"))
    return g.select(*by, "n", "mean", "se", ratio("mean", "se").alias("t"), (F.col("mean") - Z95 * F.col("se")).alias("low"), (F.col("mean") + Z95 * F.col("se")).alias("high"))


def compare_runs(daily: DataFrame, metrics: Sequence[str], lag: int = 10) -> DataFrame:
    """One row a model: the summary and the rank IC's HAC error. Names no winner."""
    hac = hac_mean_test(daily, "rank_ic", lag).select("model", F.col("se").alias("rank_ic_se"), F.col("t").alias("rank_ic_t"))
    return metric_summary(daily, metrics).join(hac, "model", "left")


def mse_skill(p: DataFrame, model: str, reference: str) -> DataFrame:
    """date, mse_difference: daily mean squared rank error of `reference` less that of `model`."""
    e = labelled(p.withColumn("_p", rank_percentile("score", *DAY, single=0.5))).withColumn("_e", F.pow(F.col("_p") - F.col("rank_target"), 2))
    g = e.groupBy("date").agg(F.avg(F.when(F.col("model") == model, F.col("_e"))).alias("mse"), F.avg(F.when(F.col("model") == reference, F.col("_e"))).alias("reference_mse"))
    return g.withColumn("mse_difference", F.col("reference_mse") - F.col("mse")).withColumn("skill", 1 - ratio("mse", "reference_mse"))


def linear_calibration(p: DataFrame) -> DataFrame:
    """model, slope, intercept of target on score over labelled rows; a slope of 0 or less gives the raw score (1, 0)."""
    g = p.where("target is not null").groupBy("model").agg(F.covar_samp("score", "target").alias("_c"), F.var_samp("score").alias("_v"), F.avg("score").alias("_s"), F.avg("target").alias("_t"))
    slope = ratio("_c", "_v")
    ok = F.coalesce(slope > 0, F.lit(False))
    return g.select("model", F.when(ok, slope).otherwise(1.0).alias("slope"), F.when(ok, F.col("_t") - slope * F.col("_s")).otherwise(0.0).alias("intercept"))


def label_decomposition(rows: DataFrame, target: str, shrink: float = 10.0) -> DataFrame:
    """rows with market_part, industry_part and alpha_part of the target.

    The industry's excess over the market's mean shrinks by n / (n + shrink); UNKNOWN has none.
    """
    day, cell = Window.partitionBy("date"), Window.partitionBy("date", "industry")
    n = F.count(target).over(cell)
    x = rows.withColumn("market_part", F.avg(target).over(day)).withColumn("_n", n).withColumn("_m", F.avg(target).over(cell))
    industry = F.when(F.col("industry") == "UNKNOWN", 0.0).otherwise((F.col("_m") - F.col("market_part")) * F.col("_n") / (F.col("_n") + shrink))
    return x.withColumn("industry_part", industry).withColumn("alpha_part", F.col(target) - F.col("market_part") - F.col("industry_part")).drop("_n", "_m")


def expanding_folds(rows: DataFrame, years: Sequence[int], exit_column: str) -> DataFrame:
    """fold, part, date, stock_code: each year predicts itself from all rows that ended before it."""
    year, end = F.year("date"), F.year(exit_column)
    part = lambda fold: F.when(year == fold, "predict").when((year < fold) & (end < fold), "train")
    folds = F.filter(F.array(*[F.struct(F.lit(y).alias("fold"), part(F.lit(y)).alias("part")) for y in years]), lambda f: f["part"].isNotNull())
    return rows.select("date", "stock_code", F.inline(folds)).select("fold", "part", "date", "stock_code")
