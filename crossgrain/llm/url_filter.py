"""URL filter: rules first, gradient-boosted trees over lexical features for the rest.

A rule allows or blocks a host with all its subdomains from a path on; the longest rule that fits
decides. URLs that a rule decides are the labelled ones: they train boosted trees, which judge all
others.

Features: lengths of URL, host and path; depth; labels of the host; hyphens; share of digits; entropy
of the characters; parameters; and for each host suffix of one, two and three labels how often it is
labelled and the log-odds of being blocked. The counts of suffixes cover all labelled URLs. They are
kept in `BUCKETS` hashed counters of a fixed size, so a task can hold them however many hosts there
are. A labelled URL must not see its own label in them: URLs are dealt into `FOLDS` by a hash, and
while the trees grow a URL's counts come from the other folds.

Trees grow by Newton boosting of the logistic loss, level by level, on all labelled URLs: features are
put into `BINS` fixed bins, packed into blocks in the shared folder, and for each level every task
adds up the gradients of its rows by node, feature and bin; Spark sums those, and the driver, which
sees histograms only, picks the splits. Gradients are rounded to whole numbers first, so the sums, and
with them the trees, don't depend on an order. No URL is sampled.

Edge cases: a null URL, or one without ://, has an empty host and path and no rule, and is judged by
the features of an empty URL; without labelled URLs of both kinds the more frequent kind, or `allow`,
is the verdict for all; a URL without a path (nothing before ?, # or the end) starts with no rule's
path; very long URLs are read whole; repeated rows give repeated result rows; an empty table gives an
empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from crossgrain.llm.blocks import packed, total, unpacked
from crossgrain.llm.common import Temporary, materialize, parts, pick

ALLOW, BLOCK = "allow", "block"
#: Hashed counters of suffixes, folds of labelled URLs, labels of the suffixes that are counted.
BUCKETS, FOLDS, SUFFIXES = 1 << 14, 4, (1, 2, 3)
#: Bins of a feature, trees, levels of a tree, shrinkage, ridge on leaves, least weight of a leaf, rows of a block.
BINS, TREES, DEPTH, RATE, RIDGE, LEAST_WEIGHT, BLOCK_ROWS = 32, 24, 3, 0.3, 1.0, 1.0, 4096
#: Gradients are whole multiples of 1 / UNIT.
UNIT = 1 << 16

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_END_OF_HOST, _END_OF_PATH = re.compile("[/?#]"), re.compile("[?#]")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: str, path: str) -> bool:
        return path.startswith(self.path) and (host == self.host or host.endswith("." + self.host))


def rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


def longest_first(rules: Sequence[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r.text), r.text, r.verdict))


def host_and_path(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = _END_OF_HOST.search(rest)
    at = end.start() if end else len(rest)
    stop = _END_OF_PATH.search(rest, at)
    return rest[:at].translate(_LOWER), rest[at : stop.start() if stop else len(rest)]


def matched(rules: list[Rule], host: str, path: str) -> Rule | None:
    """The first of rules in `longest_first` order that fits."""
    return next((r for r in rules if r.fits(host, path)), None)


# -- features ----------------------------------------------------------------------------------------

LEXICAL = ("url_length", "host_length", "path_length", "depth", "host_labels", "hyphens", "digits", "entropy", "parameters")
NAMES = (*LEXICAL, *(f"suffix_{k}_{what}" for k in SUFFIXES for what in ("odds", "count")))


def lexical(url: str | None, host: str, path: str) -> list[float]:
    """Each from 0 to 1, or over 1 where it is larger than any that matters."""
    url = url or ""
    n, counts = len(url), Counter(url)
    size = lambda k: math.log2(1 + k) / 12
    query = url.partition("#")[0].partition("?")[2]
    digits = sum(counts[d] for d in "0123456789")
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0
    return [
        size(n), size(len(host)), size(len(path)), sum(1 for p in path.split("/") if p) / 16, (host.count(".") + 1) / 16 if host else 0.0, host.count("-") / 16,
        digits / n if n else 0.0, entropy / 8, sum(1 for p in query.split("&") if p) / 16,
    ]


def suffix_buckets(host: str) -> list[int]:
    """The counter of each suffix; a host with fewer labels stands for itself."""
    labels = host.split(".")
    return [(zlib.crc32(f"{k} {'.'.join(labels[-k:])}".encode("utf-8", "surrogatepass"))) % BUCKETS for k in SUFFIXES]


def suffix_features(buckets: np.ndarray, counts: np.ndarray, prior: float) -> np.ndarray:
    """Log-odds and counts, each from 0 to 1, of rows of buckets; counts are (bucket, allow or block), or (row, suffix, allow or block)."""
    own = counts[buckets] if counts.ndim == 2 else counts
    odds = np.log((own[..., 1] + 4 * prior) / (own[..., 0] + 4 * (1 - prior))) - math.log(prior / (1 - prior))
    both = np.stack([np.clip(odds / 16 + 0.5, 0, 1), np.log2(1 + own.sum(-1)) / 32], -1)
    return both.reshape(len(buckets), -1)


def binned(features: np.ndarray) -> np.ndarray:
    return np.clip((features * BINS).astype(np.int64), 0, BINS - 1).astype(np.int8)


# -- trees -------------------------------------------------------------------------------------------


@dataclass
class Tree:
    """A complete binary tree: node i has the children 2i+1 (bin <= cut) and 2i+2; a cut of BINS sends all to the left."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray  # of the leaves, from the left

    def leaf(self, bins: np.ndarray, depth: int | None = None) -> np.ndarray:
        """Number of the node on level `depth` (leaves: the last level), from the left, for each row."""
        depth = DEPTH if depth is None else depth
        at = np.zeros(len(bins), np.int64)
        for level in range(depth):
            node = at + (1 << level) - 1
            at = 2 * at + (bins[np.arange(len(bins)), self.feature[node]] > self.cut[node])
        return at


@dataclass
class Model:
    """Score (log-odds of block) of binned rows: start plus the trees' leaves."""

    start: float
    prior: float = 0.5
    counts: np.ndarray | None = None
    trees: list[Tree] = field(default_factory=list)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.start)
        for tree in self.trees:
            out += tree.value[tree.leaf(bins)]
        return out

    def scores(self, urls: Sequence[tuple[str | None, str, str]]) -> np.ndarray:
        """Probability of block."""
        if self.counts is None:
            return np.full(len(urls), 1 / (1 + math.exp(-self.start)))
        plain = np.array([lexical(*u) for u in urls]).reshape(-1, len(LEXICAL))
        buckets = np.array([suffix_buckets(host) for _, host, _ in urls], np.int64).reshape(-1, len(SUFFIXES))
        return 1 / (1 + np.exp(-self.raw(binned(np.hstack([plain, suffix_features(buckets, self.counts, self.prior)])))))


def histogram(tree: Tree, level: int, bins: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums of gradients and weights by node of the level, feature and bin."""
    n_features, nodes = bins.shape[1], 1 << level
    cell = ((tree.leaf(bins, level)[:, None] * n_features + np.arange(n_features)) * BINS + bins).ravel()
    size = nodes * n_features * BINS
    # Doubles hold sums of whole numbers below 2^53; a block is far smaller.
    sums = [np.bincount(cell, np.repeat(x, n_features), size).astype(np.int64) for x in (gradient, weight)]
    return np.concatenate(sums)


def best_splits(tree: Tree, level: int, sums: np.ndarray, n_features: int) -> np.ndarray:
    """Writes the level's splits into the tree; gradient and weight of each child, from the left."""
    nodes = 1 << level
    g, h = sums.reshape(2, nodes, n_features, BINS).astype(float) / UNIT
    left_g, left_h = g.cumsum(-1), h.cumsum(-1)
    all_g, all_h = left_g[..., -1:], left_h[..., -1:]
    gain = left_g**2 / (left_h + RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE) - all_g**2 / (all_h + RIDGE)
    gain[(left_h < LEAST_WEIGHT) | (all_h - left_h < LEAST_WEIGHT)] = 0
    children = np.zeros((2 * nodes, 2))
    for node in range(nodes):
        at = int(gain[node].argmax())  # ties: the first feature, then the first bin
        f, b = divmod(at, BINS)
        if gain[node, f, b] <= 1e-9:
            f, b = 0, BINS
        i = nodes - 1 + node
        tree.feature[i], tree.cut[i] = f, b
        own = (left_g[node, f, b], left_h[node, f, b]) if b < BINS else (all_g[node, 0, 0], all_h[node, 0, 0])
        children[2 * node] = own
        children[2 * node + 1] = all_g[node, 0, 0] - own[0], all_h[node, 0, 0] - own[1]
    return children


def labelled_blocks(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """n, y, fold, plain (binned lexical features) and buckets of the URLs that a rule decides, many a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "url"):
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                urls = [(u, *host_and_path(u)) for u in batch.column("url").slice(start, BLOCK_ROWS).to_pylist()]
                found = [(u, r) for u in urls if (r := matched(rules, u[1], u[2])) is not None]
                if not found:
                    continue
                y = np.array([r.verdict == BLOCK for _, r in found])
                fold = np.array([zlib.crc32(u[0].encode("utf-8", "surrogatepass")) % FOLDS for u, _ in found])
                plain = binned(np.array([lexical(*u) for u, _ in found]))
                buckets = np.array([suffix_buckets(u[1]) for u, _ in found])
                columns = [pa.array([x], pa.binary()) for x in (packed(y)[0], packed(fold)[0], packed(plain)[0], buckets.astype("i4").tobytes())]
                yield pa.RecordBatch.from_arrays([pa.array([len(found)], pa.int64()), *columns], names=["n", "y", "fold", "plain", "buckets"])

    return pick(pages, "url").mapInArrow(run, "n long, y binary, fold binary, plain binary, buckets binary")


def block_arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """y, fold, plain and buckets of each block of a batch."""
    for r in batch.to_pylist():
        yield (unpacked(r["y"], "i1", r["n"])[:, 0], unpacked(r["fold"], "i1", r["n"])[:, 0], unpacked(r["plain"], "i1", r["n"]), unpacked(r["buckets"], "i4", r["n"]).astype(np.int64))


def training_bins(plain: np.ndarray, buckets: np.ndarray, fold: np.ndarray, counts: np.ndarray, prior: float) -> np.ndarray:
    """Bins of labelled rows, whose suffixes are counted in the other folds (counts: fold, bucket, allow or block)."""
    other = counts.sum(0) - counts
    own = other[fold[:, None], buckets]
    return np.hstack([plain, binned(suffix_features(buckets, own, prior))])


def boosted(summed, n_features: int, start: float, trees: int) -> Model:
    """Grows the trees; summed(model, tree, level) is the histogram of a level over all labelled rows."""
    model = Model(start)
    for _ in range(trees):
        inner = (1 << DEPTH) - 1
        tree = Tree(np.zeros(inner, np.int64), np.full(inner, BINS), np.zeros(1 << DEPTH))
        for level in range(DEPTH):
            children = best_splits(tree, level, summed(model, tree, level), n_features)
        tree.value = -RATE * children[:, 0] / (children[:, 1] + RIDGE)
        model.trees.append(tree)
    return model


def gradients(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the logistic loss, in whole multiples of 1 / UNIT."""
    p = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
    return np.rint((p - y) * UNIT), np.rint(p * (1 - p) * UNIT)


def fit(pages: DataFrame, rules: Sequence[Rule]) -> Model:
    rules = longest_first(rules)
    with Temporary(pages.sparkSession):
        blocks = materialize(labelled_blocks(pages, rules), "labelled")

        def counts_of(batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros((FOLDS, BUCKETS, 2), np.int64)
            for y, fold, _, buckets in block_arrays(batch):
                np.add.at(out, (fold[:, None], buckets, y[:, None]), 1)
            return out.ravel()

        counts = total(blocks, counts_of, FOLDS * BUCKETS * 2, whole=True).reshape(FOLDS, BUCKETS, 2)
        n_allow, n_block = (int(c) for c in counts.sum((0, 1)) // len(SUFFIXES))
        if not n_allow or not n_block:
            return Model(20.0 if n_block > n_allow else -20.0)
        prior = n_block / (n_allow + n_block)

        def rebinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for y, fold, plain, buckets in block_arrays(batch):
                    bins = training_bins(plain, buckets, fold, counts, prior)
                    yield pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int64()), pa.array([y.tobytes()], pa.binary()), pa.array([bins.astype("i1").tobytes()], pa.binary())], names=["n", "y", "bins"])

        rows = materialize(blocks.mapInArrow(rebinned, "n long, y binary, bins binary"), "binned")

        def summed(model: Model, tree: Tree, level: int) -> np.ndarray:
            def of_batch(batch: pa.RecordBatch) -> np.ndarray:
                out = np.zeros(2 * (1 << level) * len(NAMES) * BINS, np.int64)
                for r in batch.to_pylist():
                    bins, y = unpacked(r["bins"], "i1", r["n"]), unpacked(r["y"], "i1", r["n"])[:, 0]
                    out += histogram(tree, level, bins, *gradients(model.raw(bins), y))
                return out

            return total(rows, of_batch, 2 * (1 << level) * len(NAMES) * BINS, whole=True)

        model = boosted(summed, len(NAMES), math.log(prior / (1 - prior)), TREES)
    model.prior, model.counts = prior, counts.sum(0)
    return model


def judge(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the trees' probability of block, for every URL) of every row."""
    rules, model = longest_first(rules), fit(pages, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "url"):
            urls = [(u, *host_and_path(u)) for u in batch.column("url").to_pylist()]
            found, score = [matched(rules, h, p) for _, h, p in urls], model.scores(urls)
            verdict = [r.verdict if r else BLOCK if s >= 0.5 else ALLOW for r, s in zip(found, score.tolist(), strict=True)]
            columns = [pa.array([h for _, h, _ in urls], pa.string()), pa.array([p for *_, p in urls], pa.string()), pa.array([r and r.text for r in found], pa.string()), pa.array(verdict, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *columns], names=["page_id", "host", "path", "rule", "verdict", "score"])

    return pick(pages, "page_id", "url").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")
