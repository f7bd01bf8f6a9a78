"""Quality classifier from positive and unlabelled texts.

Trusted positives are labelled rows of quality 1; the unlabelled texts are a sample of the whole web
text, labels unseen. A linear score over text statistics and over what words and neighbouring pairs of
words say is fitted by minimising the non-negative unbiased risk

    prior * risk(positives as 1) + max(0, risk(unlabelled as 0) - prior * risk(positives as 0))

with logistic loss: where the second part would go under 0, the step climbs back instead. The class
prior is estimated by cross-fitting on the rows that may be learned from: a fit with a high prior on
two thirds of both samples scores the last third, and the prior is the least ratio, over thresholds,
of unlabelled to positive texts above the threshold, averaged over the thirds (the positives' share
can't exceed it). Both samples are bounded (`POSITIVES`, `UNLABELLED` ids in expectation) and drawn
by a 63-bit hash of the id, the least hash always included, so neither is empty where rows exist; an id
counts once, with the least of its texts.

Words and pairs are learned, not listed: for each of `BUCKETS` hashed words and as many hashed pairs, the
log ratio of the shares of positive and of unlabelled texts that hold it, counted in Spark. A text's
features are the means of these over its words and over its pairs, so both which words a text has and
their order count. While the risk is minimised, a text's ratios come from the half of the sample that it
isn't in.

Edge cases: a null text is empty; an empty text has all statistics 0 and gets a score like any
other; with no trusted positive every score is 0.5; labels without text and texts without label are
fine; very long texts are measured whole; repeated rows give repeated result rows; an empty table
gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossgrain.llm.common import Temporary, draw, draw_bar, held_out, materialize, parts, pick

POSITIVES, UNLABELLED, FOLDS, HIGH_PRIOR = 6000, 12000, 3, 0.7
#: Buckets of words, and of pairs; texts that must hold one before it says anything; the most that it may say.
BUCKETS, TEXTS, MOST = 1 << 15, 3, 3.0
NAMES = ("symbols", "upper_words", "exclamations", "same_neighbours", "repeated_windows", "distinct_words", "word_length", "digits", "repeated_lines", "log_words", "bars", "empty")


def statistics(text: str | None) -> list[float]:
    """Shares of a text, each from 0 to about 1."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * (len(NAMES) - 1) + [1.0]
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    windows = n - 2
    return [
        min(1.0, sum(map(text.count, "#*$%&<>")) / n),
        sum(map(str.isupper, words)) / n,
        min(1.0, text.count("!") / n),
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(zip(words, words[1:], words[2:], strict=False))) / windows if windows > 0 else 0.0,
        len(set(words)) / n,
        min(1.0, (len(text) - n) / n / 20),
        min(1.0, sum(map(text.count, "0123456789")) / n),
        1 - len(set(lines)) / len(lines),
        min(1.0, np.log1p(n) / 12),
        min(1.0, 2 * text.count("|") / n),
        0.0,
    ]


class Hashes(dict):
    """word -> a number of 32 bits, filled as words come."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h


def buckets(text: str | None, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's words, in order, and of its neighbouring pairs."""
    words = (text or "").split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xD6E8FEB86659FD93)
    return (h % np.uint64(BUCKETS)).astype(np.int64), (pairs >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def log_ratios(p: np.ndarray, u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """What each bucket says, from the numbers of positive and unlabelled texts that hold it."""
    said = np.clip(np.log((p + 1) / (n_p + 2)) - np.log((u + 1) / (n_u + 2)), -MOST, MOST) / MOST
    return np.where(p + u >= TEXTS, said, 0.0)


def said(text: str | None, ratios: np.ndarray, hashes: Hashes) -> list[float]:
    """Means of the ratios (words, pairs) over the text's words and pairs; 0 where it has none."""
    words, pairs = buckets(text, hashes)
    return [float(ratios[0][words].mean()) if len(words) else 0.0, float(ratios[1][pairs].mean()) if len(pairs) else 0.0]


def counted(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (text, kind, half): texts that hold each bucket, as (kind, half, words or pairs, bucket), and texts, as (kind, half)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = Hashes(), np.zeros((4, 2 * BUCKETS + 1), np.int64)
        for batch in parts(batches, "text"):
            for text, kind, half in zip(*(batch.column(c).to_pylist() for c in ("text", "kind", "half")), strict=True):
                words, pairs = buckets(text, hashes)
                row = total[2 * kind + half]
                row[np.unique(words)] += 1
                row[np.unique(pairs) + BUCKETS] += 1
                row[-1] += 1
        cell, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(at, pa.int32()), pa.array(total[cell, at])], names=["cell", "at", "n"])

    found = sample.select("text", "kind", "half").mapInArrow(run, "cell int, at int, n long").groupBy("cell", "at").agg(F.sum("n").alias("n")).toPandas()  # 8 * BUCKETS rows at most
    out = np.zeros((4, 2 * BUCKETS + 1), np.int64)
    out[found["cell"].to_numpy(int), found["at"].to_numpy(int)] = found["n"].to_numpy()
    return out[:, :-1].reshape(2, 2, 2, BUCKETS), out[:, -1].reshape(2, 2)


def features(text: str | None, ratios: np.ndarray, hashes: Hashes) -> list[float]:
    return statistics(text) + said(text, ratios, hashes)


FEATURES = len(NAMES) + 2


def measured(sample: DataFrame, halves: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, kind and features x of rows (doc_id, text, kind, half), with the ratios of the half that a text isn't in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in parts(batches, "text"):
            x = [features(t, halves[1 - h], hashes) for t, h in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("kind"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "kind", "x"])

    return sample.select("doc_id", "text", "kind", "half").mapInArrow(run, "doc_id long, kind int, x array<double>")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Both parts of the risk, before the second is kept from going under 0, and their gradients; rows end in 1."""
    zp, zu = p @ w, u @ w
    as_one, as_zero = prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    sp, su = sigmoid(zp), sigmoid(zu)
    return as_one, as_zero, prior * ((sp - 1) @ p) / len(p), (su @ u) / len(u) - prior * (sp @ p) / len(p)


def nn_pu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.05, ridge: float = 1e-3) -> np.ndarray:
    """Weights of the linear score, bias last, by Adam on the non-negative risk of all rows."""
    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in (p, u))
    w, m, v = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
    for t in range(1, steps + 1):
        _, as_zero, up, down = risk(w, p, u, prior)
        grad = up + down if as_zero >= 0 else -down
        grad[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def tail_ratios(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Of scores: unlabelled over positives above thresholds that leave out 2 to 30 % of the positives."""
    at = [np.quantile(p, q) for q in np.linspace(0.02, 0.3, 15)]
    return np.array([(u >= c).mean() / max(1e-9, (p >= c).mean()) for c in at])


def estimate_prior(p: np.ndarray, u: np.ndarray, folds: int = FOLDS) -> float:
    """Share of positives among the unlabelled, from statistics of both, in an order that doesn't depend on Spark."""
    ratios = []
    for f in range(folds if min(len(p), len(u)) >= 2 * folds else 0):
        own_p, own_u = (np.arange(len(x)) % folds == f for x in (p, u))
        w = nn_pu(p[~own_p], u[~own_u], HIGH_PRIOR)
        ratios.append(tail_ratios(p[own_p] @ w[:-1], u[own_u] @ w[:-1]))
    return float(np.clip(np.mean(ratios, 0).min(), 0.05, 0.98)) if ratios else HIGH_PRIOR


@dataclass
class Fitted:
    weights: np.ndarray  # of the features, bias last
    prior: float
    ratios: np.ndarray  # of words and pairs, by bucket


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Fitted | None:
    """None if there is no trusted positive."""
    docs = pick(docs, "doc_id", "text").where(~held_out("doc_id"))
    trusted = pick(labels, "doc_id", "quality").where((F.col("quality") == 1) & ~held_out("doc_id")).select("doc_id")
    sizes = [rows.agg(F.count(F.lit(1)), F.min(draw("doc_id", salt))).first() for rows, salt in ((trusted, "positive"), (docs, "unlabelled"))]
    if not all(n for n, _ in sizes):
        return None
    p_bar, u_bar = (draw_bar(most, *own) for most, own in zip((positives, unlabelled), sizes, strict=True))
    chosen = trusted.where(draw("doc_id", "positive") <= p_bar).distinct()  # `positives` ids in expectation
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half")
    drawn = [rows.groupBy("doc_id").agg(F.min("text").alias("text")).select("doc_id", "text", F.lit(kind).alias("kind"), half) for kind, rows in ((1, docs.join(F.broadcast(chosen), "doc_id", "left_semi")), (0, docs.where(draw("doc_id", "unlabelled") <= u_bar)))]
    with Temporary(docs.sparkSession):
        sample = materialize(drawn[0].unionByName(drawn[1]), "sample")
        texts, n = counted(sample)
        ratios = lambda *halves: np.stack([log_ratios(*(sum(texts[kind, h, which] for h in halves) for kind in (1, 0)), *(int(sum(n[kind, h] for h in halves)) for kind in (1, 0))) for which in (0, 1)])
        seen = measured(sample, (ratios(0), ratios(1))).toPandas().sort_values(["kind", "doc_id"], kind="stable")
    p, u = (np.stack(x.to_numpy()) if len(x) else np.zeros((0, FEATURES)) for x in (seen[seen["kind"] == kind]["x"] for kind in (1, 0)))
    if not len(p) or not len(u):
        return None
    prior = estimate_prior(p, u)
    return Fitted(nn_pu(p, u, prior), prior, ratios(0, 1))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of every row of `docs`."""
    fitted = fit(docs, labels)
    weights, ratios = (np.zeros(FEATURES + 1), np.zeros((2, BUCKETS))) if fitted is None else (fitted.weights, fitted.ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in parts(batches, "text"):
            x = np.array([features(t, ratios, hashes) for t in batch.column(1).to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(x @ weights[:-1] + weights[-1]), pa.float64())], names=["doc_id", "score"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")
