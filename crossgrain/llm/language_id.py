"""Languages of a text as a mixture, by expectation-maximisation over letter n-grams.

Each language has a smoothed distribution over hashed letter trigrams, counted on a sample of the
rows that may be learned from (about `DOCS_A_LANGUAGE` of each language, by a hash of the id), in
which a text weighs as the root of its length, so that no long text decides for its language. A text
is a mixture of languages: EM estimates the proportions that make its trigrams likeliest, until none
moves by `STILL` any more. Languages enter the set in the order of their proportions, and the set
grows while the likelihood gains more than its penalty, `PENALTY` * log(trigrams) a language. The
prediction is the language of the largest proportion in the final set; the score is that proportion.

A language's sample is drawn by a 63-bit hash of the id up to a bar for about `DOCS_A_LANGUAGE` rows; the
least hash is always in, so no learned language lacks one, however many rows it has.

Edge cases: a null text or one without a letter is `und` with score 0 (every letter is the middle of
a trigram, as a word's ends count as spaces); with nothing to learn from every text is `und`; rows
without lang are never learned from; very long texts are counted whole; repeated rows give repeated
result rows; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossgrain.llm.common import cuts, draw, draw_bar, flat, held_out, parts, pick, unflat

BINS = 1 << 15
DOCS_A_LANGUAGE, PENALTY, STILL = 3000, 4.0, 1e-3
UNKNOWN = "und"
#: Bytes of text whose mixtures are estimated together.
GROUP_BYTES = 300_000

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def trigram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Bins, their counts, and whether there is a letter. A word's ends count as one space each."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = letters()[codes]
    if not kept.any():
        return np.zeros(0, np.int64), np.zeros(0), False
    codes = np.where(kept, codes, 32)
    codes = codes[kept | np.concatenate([[True], kept[:-1]])]
    padded = np.concatenate([[32], codes, [32]]).astype(np.uint64)
    a, b, c = padded[:-2], padded[1:-1], padded[2:]
    bins = (((a * np.uint64(0x1F123BB5) + b) * np.uint64(0x2C9277B5) + c) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
    bins = bins[b != 32].astype(np.int64)
    at, counts = np.unique(bins, return_counts=True)
    return at, counts.astype(np.float64), True


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # languages x BINS


def fit(docs: DataFrame, docs_a_language: int = DOCS_A_LANGUAGE) -> Model:
    """Trigram distributions of all languages of the rows that aren't held out."""
    rows = pick(docs, "doc_id", "text", "lang").where(~held_out("doc_id") & F.col("lang").isNotNull())
    drawn = draw("doc_id", "language")
    counts = {r.lang: draw_bar(docs_a_language, r.n, r.least) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(drawn).alias("least")).collect()}  # a row a language
    if not counts:
        return Model([], np.zeros((0, BINS)))
    bar = F.lit(-1).cast("long")
    for lang, own in counts.items():
        bar = F.when(F.col("lang") == lang, F.lit(own)).otherwise(bar)
    sample = rows.where(drawn <= bar)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in parts(batches, "text"):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                at, n, _ = trigram_counts(text)
                if len(at):
                    total.setdefault(lang, np.zeros(BINS))[at] += n / np.sqrt(n.sum())
        for lang, full in total.items():
            at = np.flatnonzero(full)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(full[at], pa.float64())], names=["lang", "bin", "n"])

    summed = sample.select("text", "lang").mapInArrow(count, "lang string, bin int, n double").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts)
    table = np.full((len(languages), BINS), 0.0)
    index = {x: i for i, x in enumerate(languages)}
    table[summed["lang"].map(index).to_numpy(int), summed["bin"].to_numpy(int)] = summed["n"].to_numpy(float)
    p = (table + 0.05) / (table + 0.05).sum(1, keepdims=True)
    return Model(languages, np.log(p))


def proportions(p: np.ndarray, counts: np.ndarray, start: np.ndarray, allowed: np.ndarray, still: float = STILL) -> tuple[np.ndarray, np.ndarray]:
    """EM for many texts at once; a text leaves when none of its proportions moved by `still` in a step.

    p: languages x cells, counts: cells; text d owns the cells from start[d] to the next start;
    allowed: texts x languages. Returns the proportions, texts x languages, and log likelihoods.
    """
    lengths = np.diff(start, append=len(counts))
    pi = allowed / allowed.sum(1, keepdims=True)
    live = np.flatnonzero(allowed.sum(1) > 1)
    own_p, own_counts = p, counts
    held = np.arange(len(start))
    while len(live):
        if len(live) < len(held):
            cell = np.isin(np.repeat(held, lengths[held]), live)
            own_p, own_counts, held = own_p[:, cell], own_counts[cell], live
        n = lengths[held]
        begin = n.cumsum() - n
        joint = pi[held].T[:, np.repeat(np.arange(len(held)), n)] * own_p
        joint *= own_counts / joint.sum(0)
        new = np.add.reduceat(joint, begin, axis=1).T / np.add.reduceat(own_counts, begin)[:, None]
        live = held[np.abs(new - pi[held]).max(1) >= still]
        pi[held] = new
    like = np.add.reduceat(counts * np.log((pi.T[:, np.repeat(np.arange(len(start)), lengths)] * p).sum(0)), start)
    return pi, like


def infer(texts: list[str | None], model: Model) -> list[tuple[str, float, list[str], list[float]]]:
    """For each text: language, score, the language set and its proportions."""
    cells = [trigram_counts(t) for t in texts]
    out: list = [(UNKNOWN, 0.0, [], [])] * len(texts)
    some = [i for i, (at, _, letter) in enumerate(cells) if letter and len(at)]
    if not some or not model.languages:
        return out
    counts = np.concatenate([cells[i][1] for i in some])
    lengths = np.array([len(cells[i][0]) for i in some])
    start = lengths.cumsum() - lengths
    log_p = model.log_p[:, np.concatenate([cells[i][0] for i in some])]
    top = log_p.max(0)
    p = np.exp(log_p - top)  # scaled by cell, which changes no proportion
    n, k = len(some), len(model.languages)
    pi, _ = proportions(p, counts, start, np.ones((n, k), bool))
    order = np.argsort(-pi, axis=1, kind="stable")
    rows = np.arange(n)
    penalty = PENALTY * np.log(np.add.reduceat(counts, start) + 1)
    allowed = np.zeros((n, k), bool)
    allowed[rows, order[:, 0]] = True
    best_pi = allowed.astype(float)
    best = np.add.reduceat(counts * np.log(np.take_along_axis(p, order[:, 0][None, np.repeat(rows, lengths)], 0)[0] + 1e-300), start)
    growing = np.ones(n, bool)
    for size in range(1, k):
        at = np.flatnonzero(growing)
        if not len(at):
            break
        allowed[at, order[at, size]] = True
        cell = np.repeat(growing, lengths)
        own = lengths[at]
        more, like = proportions(p[:, cell], counts[cell], own.cumsum() - own, allowed[at])
        better = like - size * penalty[at] > best[at] - (size - 1) * penalty[at]
        growing[:] = False
        at, more, like = at[better], more[better], like[better]
        growing[at], best[at], best_pi[at] = True, like, more
    for j, i in enumerate(some):
        found = sorted(((float(best_pi[j, x]), model.languages[x]) for x in np.flatnonzero(best_pi[j])), key=lambda x: (-x[0], x[1]))
        out[i] = (found[0][1], min(1.0, found[0][0]), [x for _, x in found], [v for v, _ in found])
    return out


SCHEMA = "doc_id long, lang_pred string, score double, languages array<string>, proportions array<double>"


def inferred(texts: pa.Array, model: Model) -> Iterator[list[tuple[str, float, list[str], list[float]]]]:
    """`infer` of all texts in order, about `GROUP_BYTES` at a time."""
    for start, length in cuts([texts], GROUP_BYTES) if len(texts) else ():
        yield infer(texts.slice(start, length).to_pylist(), model)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, languages and proportions of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_p.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in parts(batches, "text"):
            found = [x for group in inferred(batch.column("text"), own) for x in group]
            kinds = [pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, map(list, zip(*found, strict=True)), kinds)], names=["doc_id", "lang_pred", "score", "languages", "proportions"])

    return pick(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def keep_known(docs: DataFrame, model: Model, wanted: Sequence[str] | None = None, least: float = 0.5, declared: str | None = None) -> DataFrame:
    """The rows of `docs` of which `wanted` languages (None: all learned ones) make up `least`, in one pass.

    What counts is the sum over the inferred set, so a clean text of several languages stays; `und` goes.
    declared: a column with the language that a row is said to be in. If that is a learned one, only it counts;
    rows without it are judged by `wanted` alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_p.astype(np.float32)))
    known = None if wanted is None else set(wanted)

    @F.arrow_udf("boolean")
    def in_known(texts: pa.Array, said: pa.Array) -> pa.Array:
        own = Model(*shared.value)
        learned, kept = set(own.languages), []
        found = (x for group in inferred(texts, own) for x in group)
        for (lang, _, languages, proportions), label in zip(found, said.to_pylist(), strict=True):
            counts = {label} if label in learned else known
            share = sum(p for x, p in zip(languages, proportions, strict=True) if counts is None or x in counts)
            kept.append(lang != UNKNOWN and (known is None or label not in learned or label in known) and share >= least - 1e-9)
        return pa.array(kept, pa.bool_())

    if declared is None:
        return unflat(flat(docs, text="text").where(in_known("text", F.lit(None).cast("string"))), docs)
    return unflat(flat(docs, text="text", said=declared).where(in_known("text", F.col("said").cast("string"))), docs)
