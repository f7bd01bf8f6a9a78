"""Toxicity by a weighted finite-state grammar over clauses.

Five small weighted transducers read a clause, each the output of the one before it:

- negation marks the insults and threats within its reach as keeping a third of their weight;
- reported speech marks those after a reporting verb as keeping two thirds;
- target marks those near somebody addressed as aimed, and an aimed insult weighs a quarter more;
- threat gives an aimed threat its weight; one that isn't aimed yet waits a few words for a target
  and gets its marked weight then, or none; an insult after a threat weighs more;
- insult gives a matched word its weight, later ones of the clause half more.

Composed, they are one deterministic transducer whose state is the tuple of theirs; a clause's score
is the weight of its path, so words count by their place in a clause and not alone: a threat word
without a target near it scores nothing.

Which words insult is learned: terms (a word's beginnings of 3 to 10 letters, and whole words) that
occur in far more of the toxic texts than of the others, on a bounded sample of labelled rows
(`TOXIC`, `OTHER` ids in expectation, an id with the least of its texts) drawn by a 63-bit hash of the
id, the least hash always included, so no sample of labelled rows is empty.
Counts and the tests of evidence and odds run in Spark; only terms that pass are collected. A word's
weight is the log odds of its longest learned term. Which words threaten is learned too: words that
stand near somebody addressed in far more of the toxic texts with somebody addressed than of the
others. A few words are taken for threats from the start, and no longer if the sample has evidence of the
contrary. Targets, negations and reporting verbs are fixed lists. A logistic regression over the clause scores of a text gives its score; it is
fitted across two halves of the sample, each scored with the words learned from the other.

Edge cases: a null or empty text has no clause and gets the score of a text without matches; with no
labels to learn from only the first threats match and the regression keeps its starting weights; very long
texts are read whole; repeated rows give repeated result rows; an empty table gives an empty result;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossgrain.llm.common import Temporary, draw, draw_bar, held_out, materialize, parts, pick

TOXIC, OTHER = 6000, 12000
#: The evidence (G squared), log odds and toxic texts that a learned term needs, and the letters of a beginning.
EVIDENCE, ODDS, TEXTS, SHORTEST, LONGEST = 15.0, 1.2, 3, 3, 10
#: Terms that a worker counts before it passes its counts on.
_COUNTED = 300_000

#: Words of the classes that aren't learned, in the languages at hand.
THREATS = """kill kills killed killing hurt hurts hurting destroy destroys destroyed destroying beat beats beating shoot shoots shot
shooting stab stabs stabbing murder murders murdering burn burns burning strangle hang crush break smash
töten töte tötet schlagen schlage schlägt umbringen verletzen erschießen erstechen verbrennen zerstören
tuer tue tuerai frapper frappe détruire brûler blesser étrangler écraser
matar mataré mato golpear golpearé destruir quemar herir apuñalar disparar""".split()
TARGETS = """you your yours yourself yourselves they them their he him his she her hers du dich dir dein deine euch euer ihr ihm ihn sie
tu te toi ton ta tes vous votre vos lui leur tú ti usted ustedes él ella ellos ellas le les""".split()
NEGATIONS = "not never no nor neither without nicht kein keine keinen nie niemals ohne pas jamais aucun aucune sans nunca jamás ni sin".split()
REPORTS = """said says say saying wrote writes written quoted quotes claimed claims called calls reported reports
sagte sagt sagen schrieb schreibt zitiert behauptet dit disait écrit cité affirme dijo dice escribió citó afirma""".split()

_TARGETS = frozenset(TARGETS)
#: Before a term: the word near somebody addressed. No word begins with it.
AIMED = "@"
WORD = re.compile(r"[^\W\d_]+")
#: Sentences and parts of them end a clause, and so do blank lines; a line break alone may be inside one.
CLAUSE = re.compile(r"[.!?;]+|\n\s*\n")
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER_WORD = range(6)
CLASSES, THREAT_WEIGHT = 6, 1.0


class Symbol(NamedTuple):
    """A word's class, the share of its weight that it keeps, and whether it is aimed at somebody."""

    kind: int
    kept: float = 1.0
    aimed: bool = False

    @property
    def matched(self) -> bool:
        return self.kind in (INSULT, THREAT)


class Arc(NamedTuple):
    """Where a symbol leads, what it becomes, and its weight: a matched word weighs weight * factor + addend."""

    state: Any
    out: Symbol
    factor: float = 1.0
    addend: float = 0.0


@dataclass(frozen=True)
class Transducer:
    start: Any
    arc: Callable[[Any, Symbol], Arc]


def negations(reach: int = 2) -> Transducer:
    """The `reach` words after a negation keep a third of their weight; a second negation cancels it."""

    def arc(left: int, x: Symbol) -> Arc:
        if x.kind == NEGATION:
            return Arc(0 if left else reach, x)
        if left and x.matched:
            return Arc(left - 1, x._replace(kept=x.kept / 3), 1 / 3)
        return Arc(max(0, left - 1), x)

    return Transducer(0, arc)


def reports() -> Transducer:
    """After a reporting verb the rest of the clause keeps two thirds."""

    def arc(inside: bool, x: Symbol) -> Arc:
        if inside and x.matched:
            return Arc(True, x._replace(kept=x.kept * 2 / 3), 2 / 3)
        return Arc(inside or x.kind == REPORT, x)

    return Transducer(False, arc)


def targets(reach: int = 4) -> Transducer:
    """A match within `reach` words after somebody addressed is aimed and weighs a quarter more."""

    def arc(left: int, x: Symbol) -> Arc:
        if x.kind == TARGET:
            return Arc(reach, x)
        if left and x.matched:
            return Arc(left - 1, x._replace(aimed=True), 1.25)
        return Arc(max(0, left - 1), x)

    return Transducer(0, arc)


def threats(reach: int = 4, more: float = 0.5) -> Transducer:
    """State: whether the clause holds a threat that counts, words left to wait for a target, and what would count then.

    Of several threats that wait for one target the one that keeps most counts.
    """

    def arc(state: tuple[bool, int, float], x: Symbol) -> Arc:
        real, left, kept = state
        if x.kind == THREAT:
            if x.aimed:
                return Arc((True, max(0, left - 1), kept if left > 1 else 0.0), x)
            return Arc((real, reach, max(kept, x.kept)), x, 0.0)
        if x.kind == TARGET and left:
            return Arc((True, 0, 0.0), x, 1.0, THREAT_WEIGHT * kept)
        return Arc((real, max(0, left - 1), kept if left > 1 else 0.0), x, 1.0, more * (real and x.kind == INSULT))

    return Transducer((False, 0, 0.0), arc)


def insults() -> Transducer:
    """A second and later insult of a clause weighs half more."""
    return Transducer(False, lambda seen, x: Arc(True, x, 1.5 if seen else 1.0) if x.kind == INSULT else Arc(seen, x))


#: step[state][class] = (next state, factor, addend); state 0 begins a clause.
Table = list[list[tuple[int, float, float]]]


def compose(chain: list[Transducer]) -> Table:
    """One transducer that hands each word through the `chain`: factors multiply, addends add. Only states that can be reached."""
    start = tuple(t.start for t in chain)
    index, order, table = {start: 0}, [start], []
    for states in order:
        row = []
        for kind in range(CLASSES):
            symbol, factor, addend, after = Symbol(kind), 1.0, 0.0, []
            for t, s in zip(chain, states, strict=True):
                a = t.arc(s, symbol)
                symbol, factor, addend = a.out, factor * a.factor, addend + a.addend
                after.append(a.state)
            to = tuple(after)
            if to not in index:
                index[to] = len(order)
                order.append(to)
            row.append((index[to], factor, addend))
        table.append(row)
    return table


GRAMMAR = compose([negations(), reports(), targets(), threats(), insults()])


class Lexicon(dict):
    """word -> (class, weight), filled as words come; terms: learned beginnings, whole words end in a space."""

    def __init__(self, terms: dict[str, float], most: int = 150_000):
        self.terms, self.most = terms, most
        self.threats = {t[1:]: odds > 0 for t, odds in terms.items() if t.startswith(AIMED)}
        self.fixed = {w: (c, THREAT_WEIGHT if c == THREAT else 0.0) for c, ws in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS)) for w in ws}

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) > self.most:
            self.clear()
        found = self.fixed.get(word)
        if found is not None and found[0] == THREAT and not self.threats.get(word, True):
            found = None
        if found is None:
            keys = (word + " ", *(word[:k] for k in range(min(LONGEST, len(word)), SHORTEST - 1, -1)))
            weight = next((self.terms[k] for k in keys if k in self.terms), None)
            if weight is not None:
                found = (INSULT, weight)
            else:
                found = (THREAT, THREAT_WEIGHT) if self.threats.get(word) else (OTHER_WORD, 0.0)
        self[word] = found
        return found


def clause_scores(text: str, lexicon: Lexicon) -> tuple[list[float], int]:
    """Scores of the clauses with a match, and the number of the text's words."""
    low = text.lower()
    classes = [lexicon[w][0] for w in WORD.findall(low)]
    n = len(classes)
    if INSULT not in classes and THREAT not in classes:
        return [], n
    out = []
    for clause in CLAUSE.split(low):
        state, score = 0, 0.0
        for word in WORD.findall(clause):
            c, weight = lexicon[word]
            state, factor, more = GRAMMAR[state][c]
            score += weight * factor + more  # only matched words have a weight
        if score:
            out.append(score)
    return out, n


FEATURES = 5


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    scores, n = clause_scores(text or "", lexicon)
    if not scores:
        return [0.0] * FEATURES
    total = sum(scores)
    return [np.log1p(total), max(scores) / 5, np.log1p(len(scores)), 10 * total / (n + 20), np.log1p(sum(x >= 3 for x in scores))]


def terms_of(text: str | None) -> set[str]:
    """Whole words, marked by a space, their beginnings, and aimed words."""
    out: set[str] = set()
    for w in set(WORD.findall((text or "").lower())):
        out.add(w + " ")
        out.update(w[:k] for k in range(SHORTEST, min(LONGEST, len(w)) + 1))
    return out | aimed_words(text)


def aimed_words(text: str | None, reach: int = 4) -> set[str]:
    """Words within `reach` words of somebody addressed in their clause, each after `AIMED`; `AIMED` alone if there are any."""
    out: set[str] = set()
    for clause in CLAUSE.split((text or "").lower()):
        words = WORD.findall(clause)
        for i in [i for i, w in enumerate(words) if w in _TARGETS]:
            out.update(AIMED + w for w in words[max(0, i - reach) : i + reach + 1] if w not in _TARGETS)
    return out | {AIMED} if out else out


def evidence_of(a: Column, b: Column, n_toxic: Column, n_other: Column) -> tuple[Column, Column]:
    """Log odds of a term that `a` of n_toxic and `b` of n_other texts hold, and the evidence that they differ (G squared)."""
    a, b, n_toxic, n_other = (c.cast("double") for c in (a, b, n_toxic, n_other))
    rate = (a + b) / (n_toxic + n_other)

    def part(k: Column, n: Column) -> Column:
        has = F.when(k > 0, k * F.log(k / (n * rate))).otherwise(0.0)
        return has + F.when(k < n, (n - k) * F.log((n - k) / (n * (1 - rate)))).otherwise(0.0)

    return F.log((a + 0.5) / (n_toxic + 1)) - F.log((b + 0.5) / (n_other + 1)), 2 * (part(a, n_toxic) + part(b, n_other))


def odds_of(a: Column, b: Column, n_toxic: int, n_other: int, aimed: tuple[int, int] = (0, 0)) -> Column:
    """Log odds of a term that `a` of the toxic and `b` of the other texts hold; null if it fails a test.

    An aimed term is one of the texts with somebody addressed (`aimed`: toxic ones, others). A word that is
    taken for a threat from the start has negative odds if aimed ones are evidently no sign of toxic texts.
    """
    if not n_toxic or not n_other:
        return F.lit(None).cast("double")
    near = F.col("term").startswith(AIMED)
    odds, g = evidence_of(a, b, F.when(near, aimed[0]).otherwise(n_toxic), F.when(near, aimed[1]).otherwise(n_other))
    whole = (F.lit(min(aimed) > 0) | ~near) & (F.col("term") != AIMED) & (g >= EVIDENCE)
    cleared = F.col("term").isin(*[AIMED + w for w in THREATS]) & (odds < 0)
    return F.when(whole & (((a >= TEXTS) & (odds >= ODDS)) | cleared), odds)


def learn_terms(sample: DataFrame) -> tuple[list[dict[str, float]], dict[str, float]]:
    """Weights of the terms of each half of `sample` (text, toxic, half), and of both together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[Counter] = [Counter() for _ in range(4)]

        def rows() -> Iterator[pa.RecordBatch]:
            for cell, terms in enumerate(found):
                if terms:
                    yield pa.RecordBatch.from_arrays([pa.array(list(terms)), pa.array([cell] * len(terms), pa.int32()), pa.array(list(terms.values()), pa.int64())], names=["term", "cell", "n"])
                terms.clear()

        for batch in parts(batches, "text"):
            for text, toxic, half in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "half")), strict=True):
                found[2 * toxic + half].update(terms_of(text))
                if sum(map(len, found)) > _COUNTED:
                    yield from rows()
        yield from rows()

    sizes = {(r.toxic, r.half): r.n for r in sample.groupBy("toxic", "half").agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows
    cell = lambda t, h: F.coalesce(F.sum(F.when(F.col("cell") == 2 * t + h, F.col("n"))), F.lit(0))
    counts = sample.mapInArrow(count, "term string, cell int, n long").groupBy("term").agg(*[cell(t, h).alias(f"n{t}{h}") for t in (0, 1) for h in (0, 1)])
    counts = materialize(counts, "terms")
    near = counts.where(F.col("term") == AIMED).first()
    size = lambda t, *halves: sum(sizes.get((t, h), 0) for h in halves)
    own = lambda *halves: tuple(sum(near[f"n{t}{h}"] for h in halves) if near else 0 for t in (1, 0))
    both = odds_of(F.col("n10") + F.col("n11"), F.col("n00") + F.col("n01"), size(1, 0, 1), size(0, 0, 1), own(0, 1))
    odds = [odds_of(F.col(f"n1{h}"), F.col(f"n0{h}"), size(1, h), size(0, h), own(h)).alias(f"odds{h}") for h in (0, 1)]
    passed = counts.select("term", *odds, both.alias("odds2")).where("coalesce(odds0, odds1, odds2) is not null").collect()
    first, second, full = ({r.term: r[c] for r in passed if r[c] is not None} for c in ("odds0", "odds1", "odds2"))
    return [first, second], full


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights, bias last, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
    return w


#: Weights before anything is learned: a toxic text is unlikely without matches.
START = np.array([1.0, 1.0, 0.0, 0.0, 0.0, -4.0])


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC, other_rows: int = OTHER) -> tuple[dict[str, float], np.ndarray]:
    """Learned terms and the regression's weights."""
    rows = pick(labels, "doc_id", "toxic").where(F.col("toxic").isin(0, 1) & ~held_out("doc_id"))
    drawn = draw("doc_id", "toxicity")
    counts = {r.toxic: (r.n, r.least) for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.min(drawn).alias("least")).collect()}  # two rows
    if len(counts) < 2:
        return {}, START
    (n1, least1), (n0, least0) = counts[1], counts[0]
    wanted = F.when(F.col("toxic") == 1, draw_bar(toxic_rows, n1, least1)).otherwise(draw_bar(other_rows, n0, least0))
    chosen = rows.where(drawn <= wanted).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    with Temporary(docs.sparkSession):
        return fit_sample(materialize(texts.select("text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half")), "sample"), n1 / n0)


def fit_sample(sample: DataFrame, odds: float) -> tuple[dict[str, float], np.ndarray]:
    """Learned terms and weights from rows (text, toxic, half); odds: of toxic labels among all."""
    halves, full = learn_terms(sample)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Lexicon(x) for x in halves]
        for batch in parts(batches, "text"):
            x = [features(t, own[1 - h]) for t, h in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"])

    seen = sample.mapInArrow(measure, "x array<double>, toxic int").toPandas()
    if seen["toxic"].nunique() < 2:
        return full, START
    y = seen["toxic"].to_numpy(float)
    w = logistic(np.stack(seen["x"].to_numpy()), y)
    # The sample holds more toxic texts than the corpus: put the odds of the labels back.
    w[-1] += np.log(odds) - np.log(max(1.0, y.sum()) / max(1.0, len(y) - y.sum()))
    return full, w


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score and the number of matched clauses of every row of `docs`."""
    terms, w = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms)
        for batch in parts(batches, "text"):
            x = np.array([features(t, lexicon) for t in batch.column("text").to_pylist()]).reshape(-1, FEATURES)
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array(np.rint(np.expm1(x[:, 2])).astype(np.int64))], names=["doc_id", "score", "clauses"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double, clauses long")
