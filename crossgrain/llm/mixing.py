"""Mixing sources to target weights by temperature, in DataFrame functions only.

A source's weight is its token share to the power `exponent`, normalised. An exponent under 1
flattens the mix. Bisection finds the largest exponent from 0 to 1 whose weights reach the target
entropy, and the smallest that keeps every source within the repetition limit; the larger of the
two holds, so the limit comes first. Six halvings are decided by each pass over the (source, tokens)
table: one aggregate row with the entropy and the greatest repetition at 63 exponents.

A source's budget is its weight's part of the token budget. It is realised as block permutations:
in each pass over a source its documents are dealt into blocks of about `BLOCK_TOKENS` by a hash of
(seed, pass, id) and ordered by that hash inside a block. Whole passes take every document; the last,
partial pass takes them in the order of the hash while they fit. Where it ends is found digit by
digit: of the 4096 ranges of hashes that a digit makes, those before the budget's edge are taken
whole and the one on the edge is cut by the next digit, so a step never sorts more than 4096 sums a
source; documents are sorted only within the last, tiny range. A plan has one row a source, and each
document knows its draws from its own hash.

Edge cases: a null source counts as the source ''; a null or empty text has no tokens; a source
without tokens is drawn once; documents of one id rank together; very long texts are counted whole
and may leave a budget unspent by as much as one of them; repeated rows are rows of their own; a
table without tokens is returned as it is; an empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossgrain.llm.common import Temporary, flat, materialize, pick, unflat

WORD = r"[^\x20\x09-\x0D]+"
#: Tokens a block is meant to hold, sources whose plan may be broadcast, parts that a hot source is joined in beyond that.
BLOCK_TOKENS, BROADCAST_SOURCES, SALTS = 50_000, 20_000, 32
#: Bits of a document's hash, bits of one digit of it, and digits that narrow the edge: to one document in 16 million.
HASH_BITS, DIGIT_BITS, DIGITS = 53, 12, 2
_LEVELS, _PASSES = 6, 5


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_totals(docs: DataFrame) -> DataFrame:
    """source, tokens and documents of each source of rows (source, tokens)."""
    return docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))


def exponents(totals: DataFrame, target_entropy: float | None, repetition_limit: float | None, budget: float | None) -> tuple[float, float]:
    """The exponent and the token budget; a budget of None is the least that draws every document once."""
    used = totals.where("tokens > 0")
    total, low, high, n = used.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens"), F.count(F.lit(1))).first()
    if not total:
        return 1.0, 0.0
    share = F.col("tokens") / F.lit(float(total))
    log_n = math.log(n)

    def probe(points: list[float]) -> list[tuple[float, float]]:
        cols = []
        for a in points:
            power = F.exp(F.lit(a) * F.log(share))
            cols += [F.sum(power), F.sum(power * F.log(share))]
        row = used.agg(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
        out = []
        for i, a in enumerate(points):
            s, t = row[2 * i], row[2 * i + 1]
            # Repetitions are tokens**(a - 1) up to a factor, so the smallest source repeats most.
            size = float(budget) if budget is not None else float(high) ** (1 - a) * s * float(total) ** a
            out.append((math.log(s) - a * t / s, size * (low / total) ** a / s / low))
        return out

    def bisect(wants_more: dict[str, float]) -> float:
        """The exponent where what is measured crosses the goal, from the side that meets it."""
        (what, goal), lo, hi = next(iter(wants_more.items())), 0.0, 1.0
        for _ in range(_PASSES):
            points = [lo + (hi - lo) * i / 2**_LEVELS for i in range(1, 2**_LEVELS)]
            met = [(h >= goal) if what == "entropy" else (r > goal) for h, r in probe(points)]
            k = next((i for i, x in enumerate(met) if not x), len(met))  # met up to here: both fall with the exponent
            lo, hi = lo if k == 0 else points[k - 1], points[k] if k < len(points) else hi
        return lo if what == "entropy" else hi

    (h1, r1), (h0, r0) = probe([1.0, 1e-12])
    a = 1.0 if target_entropy is None or h1 >= min(target_entropy, log_n) else bisect({"entropy": min(target_entropy, h0)})
    if repetition_limit is not None and r0 > repetition_limit:
        a = max(a, 1.0 if r1 > repetition_limit else bisect({"repetition": repetition_limit}))
    s = used.agg(F.sum(F.exp(F.lit(a) * F.log(share)))).first()[0]
    size = float(budget) if budget is not None else float(high) ** (1 - a) * s * float(total) ** a
    return a, size


def unit_hash(seed: int, epoch: Column) -> Column:
    """53 bits of the hash that orders a document in one pass."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch.cast("long"), F.col("doc_id")), 11)


def plan(docs: DataFrame, target_entropy: float | None, repetition_limit: float | None, budget: float | None, seed: int) -> DataFrame:
    """One row a source of rows (doc_id, source, tokens): weight, budget, passes, cut and blocks.

    `passes` whole passes, then documents whose hash in the next pass is `cut` at most (null or -1: none).
    """
    totals = materialize(source_totals(docs), "sources")
    a, size = exponents(totals, target_entropy, repetition_limit, budget)
    power = F.when(F.col("tokens") > 0, F.exp(F.lit(a) * F.log(F.col("tokens").cast("double")))).otherwise(0.0)
    norm = totals.agg(F.sum(power)).first()[0] or 1.0
    wide = totals.select("*", (power / norm).alias("weight")).withColumn("budget", F.col("weight") * size)
    times = F.when(F.col("tokens") > 0, F.col("budget") / F.col("tokens")).otherwise(1.0)
    wide = wide.withColumn("passes", F.floor(times + 1e-9).cast("long"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("long")
    wide = wide.withColumn("rest", F.greatest(F.lit(0.0), F.col("budget") - F.col("passes") * F.col("tokens"))).withColumn("blocks", blocks)
    wide = materialize(wide, "weights")
    cut = wide.where("rest > 0").select("source", "passes", "rest")
    hashed = join_sources(docs, cut.select("source", "passes"), are_few(cut)).withColumn("h", unit_hash(seed, F.col("passes")))
    out = wide.join(last_hashes(hashed.select("source", "tokens", "h", "doc_id"), cut.select("source", "rest")), "source", "left")
    return materialize(out.select("source", "tokens", "documents", "weight", "budget", "passes", "blocks", "cut"), "plan")


def last_hashes(rows: DataFrame, rests: DataFrame) -> DataFrame:
    """source and cut, the greatest hash up to which the tokens of `rows` (source, tokens, h, doc_id) stay within the source's `rest`.

    Equal hashes go together. A source that not even its least hash fits has a cut that no hash is under.
    """
    few, shift, state = are_few(rests), HASH_BITS, rests
    ends = []
    for digit in range(DIGITS):
        shift -= DIGIT_BITS
        sums = rows.groupBy("source", F.shiftright("h", shift).alias("at")).agg(F.sum("tokens").alias("n"))
        sums = sums.withColumn("run", F.sum("n").over(Window.partitionBy("source").orderBy("at")))
        over = join_sources(sums, state.select("source", "rest"), few, salted=False).where(F.col("run") > F.col("rest"))
        # The range on the edge, and what the ranges before it leave for it.
        edge = over.groupBy("source").agg(F.min(F.struct("at", (F.col("rest") - F.col("run") + F.col("n")).alias("rest"))).alias("e"))
        edge = materialize(edge.select("source", F.col("e.at").alias("prefix"), "e.rest"), "edge")
        if digit == 0:  # a source without an edge fits whole, but for rounding
            ends.append(state.join(edge, "source", "left_anti").select("source", F.lit((1 << HASH_BITS) - 1).alias("cut")))
        rows = join_sources(rows, edge.select("source", "prefix"), few).where(F.shiftright("h", shift) == F.col("prefix"))
        rows, state = materialize(rows.select("source", "tokens", "h", "doc_id"), "inside"), edge
    run = F.sum("tokens").over(Window.partitionBy("source").orderBy("h"))  # equal hashes together
    taken = join_sources(rows.withColumn("run", run), state, few, salted=False).where(F.col("run") <= F.col("rest")).groupBy("source").agg(F.max("h").alias("cut"))
    # Without a document of the edge range, all hashes before it.
    before = F.shiftleft("prefix", shift) - 1
    return ends[0].unionByName(state.join(taken, "source", "left").select("source", F.coalesce("cut", before).alias("cut")))


def block(h: str, blocks: str) -> Column:
    return F.least(F.floor(F.col(h) * F.lit(2.0**-53) * F.col(blocks)).cast("long"), F.col(blocks) - 1)


def are_few(of_source: DataFrame) -> bool:
    """Whether a table of one row a source may be broadcast."""
    return of_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES


def join_sources(rows: DataFrame, of_source: DataFrame, few: bool, salted: bool = True) -> DataFrame:
    """Inner join of rows with a table of one row a source: broadcast if there are few, else a source's rows are spread over `SALTS` keys."""
    if few:
        return rows.join(F.broadcast(of_source), "source")
    if not salted:
        return rows.join(of_source, "source")
    many = of_source.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS).cast("long"))).join(many, ["source", "_salt"]).drop("_salt")


def draw(rows: DataFrame, planned: DataFrame, seed: int) -> DataFrame:
    """`rows` (any with doc_id and source) once for each draw, with epoch, block and draw_at.

    draw_at, from 0 to 1, says how far through its source's budget a draw stands: draws in this order
    keep to the weights all along.
    """
    own = planned.select("source", "passes", "cut", "blocks", F.when(F.col("tokens") > 0, F.col("budget") / F.col("tokens")).otherwise(1.0).alias("times"))
    last = F.coalesce((unit_hash(seed, F.col("passes")) <= F.col("cut")).cast("int"), F.lit(0))
    times = F.col("passes") + last
    many = join_sources(rows, own, are_few(planned)).withColumn("epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1))))
    many = many.withColumn("h", unit_hash(seed, F.col("epoch"))).withColumn("block", block("h", "blocks"))
    at = F.least(F.lit(1.0), (F.col("epoch") + F.col("h") * F.lit(2.0**-53)) / F.col("times"))
    return many.withColumn("draw_at", at).drop("passes", "cut", "blocks", "times", "h")


def mix(docs: DataFrame, target_evenness: float | None = None, repetition_limit: float | None = None, budget: float | None = None, seed: int = 11) -> DataFrame:
    """The draws of a mix: doc_id, source, tokens, epoch, block, draw_at.

    target_evenness is the target entropy as a share of the entropy of equal weights; budget is in
    tokens, None for the least that draws every document.
    """
    rows = counted(docs)
    return draw(rows, planned(rows, target_evenness, repetition_limit, budget, seed), seed)


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, source and tokens of every row, as a table of its own: texts are read once."""
    return materialize(pick(docs, "doc_id", "source", "text").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), tokens(F.col("text")).alias("tokens")), "counted")


def planned(rows: DataFrame, target_evenness: float | None, repetition_limit: float | None, budget: float | None, seed: int) -> DataFrame:
    n = rows.where("tokens > 0").select("source").distinct().count()
    with Temporary(rows.sparkSession) as temporary:
        planned_ = plan(rows, None if target_evenness is None else target_evenness * math.log(max(1, n)), repetition_limit, budget, seed)
        temporary.keep(planned_)
    return planned_


def mixed_rows(docs: DataFrame, target_evenness: float | None = None, repetition_limit: float | None = None, budget: float | None = None, seed: int = 11) -> DataFrame:
    """The rows of `docs`, each as often as the mix draws it, with no further column."""
    ready = planned(counted(docs), target_evenness, repetition_limit, budget, seed)
    rows = flat(docs, doc_id="doc_id", source="source").withColumn("source", F.coalesce("source", F.lit("")))
    return unflat(draw(rows, ready, seed), docs)
