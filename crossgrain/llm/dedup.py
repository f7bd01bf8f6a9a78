"""Near-duplicate classes by DartMinHash signatures and a banded join.

Signatures. A text is a set of weighted elements: its 5-word shingles, each weighing as often as it
occurs. Over each element lies a plane of weight and rank on which a fixed random pattern of darts
has landed, one for each unit of area; the pattern depends on nothing but the element's hash. A text
sees the darts whose weight lies under the element's weight. Each dart belongs to one of `K`
coordinates, and the dart of least rank in a coordinate is the text's sample there: two texts agree
on a coordinate with the probability of their weighted Jaccard similarity (the sum of the lesser
weights over the sum of the greater). Ranks are visited cell by cell, only as far as it takes to
fill all coordinates, so that a text of n shingles costs about n + K log K dart throws, not n K.

Join. Texts with equal words are one node. A node has one key for each band of `ROWS` coordinates.
In each of `ROUNDS` rounds every bucket has one centre, and each member that isn't yet in the
centre's class is compared with it: whole texts, exact weighted Jaccard similarity of their
shingles. So a round makes no more pairs than there are members. The first round's centre is the
bucket's least node, which settles most of a group of copies at once; later rounds draw others, for
buckets with several classes only. Texts that then still share a bucket with another class are
joined exactly (`similar_pairs`). Classes are the connected components of all links, found by star
contraction on tables in the shared folder; between rounds a linked node just takes the lesser root
of its partners, which is enough to tell most of a class apart from the rest.

With 32 bands of 4 coordinates a pair of similarity 0.8 shares no bucket in 1 of 20 million cases.
Only such a pair can stay unseen.

Hot keys. Where a key (a bucket, a centre, a shingle, a class) may hold any share of all rows, keys
with more than a thousandth of them, so a thousand at most, are joined by broadcast or salted.

Edge cases: a text of fewer than five words is one shingle; a null text or one without words is in
no class but its own; rows with one doc_id are one document, and if their texts differ it links
with whatever any of them links with; a row without doc_id has no class (null); very long texts are
compared whole; extra columns are ignored, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossgrain.llm.common import Temporary, flat, materialize, parts, pick, unflat

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 4
K = BANDS * ROWS
#: Comparisons with centres; what these leave open goes to the exact join.
ROUNDS = 2
#: Partners a member that a shingle may bring before the exact join sees it as hot; more on each level.
PARTNERS = 16
#: Rows of a shingle's largest group that meet the others in one task.
BLOCK = 1000
#: Pairs whose ids may be broadcast.
FEW_PAIRS = 20_000
#: A key is hot with more than 1 / HOT_KEYS of all rows, and more than HOT_ROWS: there are HOT_KEYS of them at most.
HOT_KEYS, HOT_ROWS = 1000, 100_000
#: Width of the first cell of ranks; each later level of cells is as wide as all before it.
FIRST_CELL = 0.25
_WORDS_KEPT = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers under which near inputs have unrelated outputs."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all windows of five words; of all words if there are fewer."""
    n, width = len(words), min(SHINGLE, len(words))
    out = np.zeros(max(0, n - width + 1) if n else 0, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(out)])
    return out


def elements_of(text: str | None, hashes: WordHashes, weighting: str = "count") -> np.ndarray:
    """A set whose Jaccard similarity with another text's is the weighted one of their shingles.

    The n-th occurrence of a shingle is an element of its own, unless each shingle weighs 1 ("set").
    """
    words = (text or "").lower().split()
    part = np.sort(shingles(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))))
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    if weighting == "set":
        return part[first]
    nth = np.arange(len(part)) - np.repeat(first, np.diff(first, append=len(part)))
    return np.unique(mix(part + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def element_sets(texts: list[str | None], hashes: WordHashes, weighting: str = "count") -> list[np.ndarray]:
    """`elements_of` each text, sorted, worked out for all of them at once."""
    words = [(t or "").lower().split() for t in texts]
    size = np.array([len(w) for w in words], np.int64)
    # Windows of five words over all texts in a row; those that leave their text are dropped.
    flat = np.fromiter((hashes[w] for ws in words for w in ws), np.uint64, int(size.sum()))
    out = np.zeros(max(0, len(flat) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + flat[k : k + len(out)])
    end = size.cumsum()
    doc = np.repeat(np.arange(len(texts)), size)[: len(out)]
    inside = np.arange(len(out)) + SHINGLE <= end[doc]
    doc, out = doc[inside], out[inside]
    order = np.lexsort((out, doc))
    doc, out = doc[order], out[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    if weighting == "set":
        doc, out = doc[new], out[new]
    else:
        first = np.flatnonzero(new)
        nth = np.arange(len(out)) - np.repeat(first, np.diff(first, append=len(out)))
        out = mix(out + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        out = out[np.lexsort((out, doc))]
    sets = np.split(out, np.bincount(doc, minlength=len(texts)).cumsum()[:-1]) if texts else []
    return [elements_of(t, hashes, weighting) if 0 < n < SHINGLE else x for t, n, x in zip(texts, size, sets, strict=True)]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    if not len(a) or not len(b):
        return 0
    return int((a.take(a.searchsorted(b), mode="clip") == b).sum())


def signatures(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, k: int = K) -> np.ndarray:
    """n_docs x k dart ids. elements[i] with weights[i] > 0 belongs to document doc[i]; each document has one at least."""
    # Unit columns of the plane: the last one of an element is as wide as what is left of its weight.
    columns = np.ceil(weights).astype(np.int64)
    column = np.arange(columns.sum()) - np.repeat(columns.cumsum() - columns, columns)
    wide = np.minimum(1.0, np.repeat(weights, columns) - column)
    doc = np.repeat(doc, columns)
    seed = mix(np.repeat(elements, columns) + column.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    best, ids = np.full(n_docs * k, np.inf), np.zeros(n_docs * k, np.uint64)
    start, width, cell, open_docs = 0.0, FIRST_CELL, 0, np.ones(n_docs, bool)
    while open_docs.any():
        live = np.flatnonzero(open_docs[doc])
        steps = max(1, int(width))
        area = width / steps
        at_once = max(1, 500_000 // len(live))
        for low in range(0, steps, at_once):
            step = np.arange(low, min(steps, low + at_once))
            own = mix(seed[live][:, None] + (np.uint64(0x2545F4914F6CDD1D) * (step + cell + 1).astype(np.uint64))).ravel()
            p, chance, below, n = unit(own), np.exp(-area), np.exp(-area), 0
            at = np.flatnonzero(p > below)
            while len(at):  # the n-th dart of the cell, if it has so many: a Poisson count by its quantiles
                n += 1
                h = mix(own[at] + np.uint64(n))
                i = live[at // len(step)]
                hit = unit(mix(h + np.uint64(1))) < wide[i]
                h, i = h[hit], i[hit]
                slot = doc[i] * k + (h % np.uint64(k)).astype(np.int64)
                rank = start + area * (step[at[hit] % len(step)] + unit(mix(h + np.uint64(2))))
                np.minimum.at(best, slot, rank)
                won = rank == best[slot]
                ids[slot[won]] = h[won]
                chance *= area / n
                below += chance
                at = at[p[at] > below]
        cell += steps
        start, width = start + width, start + width
        open_docs = ~np.isfinite(best).reshape(n_docs, k).all(1)
    return ids.reshape(n_docs, k)


def band_keys(ids: np.ndarray) -> np.ndarray:
    """n x BANDS keys; bands never share a key but by chance."""
    parts = ids.reshape(len(ids), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key


def sign(docs: DataFrame, weighting: str = "count") -> DataFrame:
    """doc_id, hash (of the text), words (fingerprint of its words; null: none) and bands of every row.

    weighting: "count" weighs a shingle as often as it occurs, "set" weighs each distinct one 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in parts(batches, "text"):
            fingers, bands, group, size = [], [], [], 0
            texts = batch.column("text").to_pylist()
            for i, text in enumerate(texts):
                words = (text or "").lower().split()
                fingers.append(blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest() if words else None)
                part = shingles(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
                group.append(np.unique(part, return_counts=True))
                size += len(part)
                if size > 100_000 or i == len(texts) - 1:
                    bands += signed(group)
                    group, size = [], 0
                if len(hashes) > _WORDS_KEPT:
                    hashes.clear()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), pa.array(fingers, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "hash", "words", "bands"])

    def signed(group: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray | None]:
        full = [g for g in group if len(g[0])]
        if not full:
            return [None] * len(group)
        elements, counts = (np.concatenate(x) for x in zip(*full, strict=True))
        doc = np.repeat(np.arange(len(full)), [len(g[0]) for g in full])
        weights = counts.astype(np.float64) if weighting == "count" else np.ones(len(counts))
        keys = iter(band_keys(signatures(elements, weights, doc, len(full))).view(np.int64))
        return [next(keys) if len(g[0]) else None for g in group]

    return hashed_texts(docs).mapInArrow(run, "doc_id long, hash long, words binary, bands array<long>")


def hashed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and hash: by id and hash a text is found again where rows share an id."""
    return pick(docs, "doc_id", "text").withColumn("hash", F.xxhash64("text"))


def similarity(a: str, b: str) -> float:
    """Weighted Jaccard similarity of the shingles of two texts."""
    left, right = (elements_of(t, WordHashes()) for t in (a, b))
    both = common(left, right)
    return both / max(1, len(left) + len(right) - both)


def hot_bar(total: int) -> float:
    return max(HOT_ROWS, total / HOT_KEYS)


def join_hot(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join with a table `right` of one row a key and `n`, the rows that `left` has of it; n goes.

    Hot keys, `HOT_KEYS` at most, are broadcast; the others shuffle without them.
    """
    bar = hot_bar(right.agg(F.sum("n")).first()[0] or 0)
    hot = right.where(F.col("n") > bar).drop("n")
    if hot.isEmpty():
        return left.join(right.drop("n"), key)
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col("n") <= bar).drop("n"), key)
    return left.join(F.broadcast(hot), key).unionByName(cold)


def with_texts(pairs: DataFrame, texts: DataFrame, side: str, many: bool) -> DataFrame:
    """pairs with text_{side}. Where `many` pairs share one node on this side, its text is laid out once for each part of them."""
    named = texts.toDF(side, f"text_{side}")
    if not many:
        return pairs.join(named, side)
    counts = materialize(pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n")), "counts")
    bar = hot_bar(counts.agg(F.sum("n")).first()[0] or 0)
    copies = F.broadcast(counts.where(F.col("n") > bar).select(side, F.ceil(F.col("n") / bar).alias("_copies")))
    other = "b" if side == "a" else "a"
    salted = pairs.join(copies, side, "left").withColumn("_salt", F.pmod(F.xxhash64(other), F.coalesce("_copies", F.lit(1)))).drop("_copies")
    laid = named.join(copies, side, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_copies", F.lit(1)) - 1))).drop("_copies")
    return salted.join(laid, [side, "_salt"]).drop("_salt")


def compare(pairs: DataFrame, texts: DataFrame, threshold: float = SIMILARITY, weighting: str = "count") -> DataFrame:
    """The rows of `pairs` (long columns, a and b among them) whose texts (rows node, text) are as similar as `threshold`."""
    kept = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, left = WordHashes(), None, np.zeros(0, np.uint64)
        for batch in parts(batches, "text_a", "text_b"):
            keep = []
            # A centre's text stands in many rows, one after another.
            for i, (a, right) in enumerate(zip(batch.column("a").to_pylist(), element_sets(batch.column("text_b").to_pylist(), hashes, weighting), strict=True)):
                if a != last:
                    last, left = a, elements_of(batch.column("text_a")[i].as_py(), hashes, weighting)
                both = common(left, right)
                keep.append(both >= threshold * (len(left) + len(right) - both) and both > 0)
            if len(hashes) > _WORDS_KEPT:
                hashes.clear()
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept], names=kept).filter(pa.array(keep, pa.bool_()))

    n = pairs.count()
    if n <= FEW_PAIRS:  # then their texts are few too, and the others needn't move
        ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        texts = texts.join(F.broadcast(ids), "node", "left_semi")
    full = with_texts(with_texts(pairs, texts, "b", n > HOT_ROWS), texts, "a", n > HOT_ROWS)
    return full.mapInArrow(run, ", ".join(f"{c} long" for c in kept))


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node of the edges (a, b), roots included.

    Alternates two contractions until all components are stars: every node points its larger
    neighbours at the least of its neighbourhood, then its smaller ones. No step brings a
    neighbourhood into one row.
    """

    def joined(rows: DataFrame, ends: DataFrame, n_rows: int) -> DataFrame:
        """Few rows have no hot end."""
        return rows.join(ends.drop("n"), "u") if n_rows <= HOT_ROWS else join_hot(rows, materialize(ends, "ends"), "u")

    links = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = joined(both.where("v > u"), least, links.count()).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large")
        small = joined(large, large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), large.count())
        links = materialize(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        # In a star every node but the root has one link, and no root has any.
        ends = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.lit(None).cast("long").alias("v")))
        left = ends.groupBy("u").agg(F.min("v").alias("_low"), F.max("v").alias("_high"), F.max(F.col("v").isNull()).alias("_root"))
        if left.where("_low is not null and (_root or _low <> _high)").isEmpty():
            break
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def bucket_keys(rows: DataFrame, *columns: str) -> DataFrame:
    """`columns` and key of each band of rows with bands."""
    return rows.select(*columns, F.explode("bands").alias("key"))


def shingle_sets(texts: DataFrame, weighting: str = "count") -> DataFrame:
    """node, size and elements of rows node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in parts(batches, "text"):
            sets = [x.view(np.int64) for x in element_sets(batch.column("text").to_pylist(), hashes, weighting)]
            if len(hashes) > _WORDS_KEPT:
                hashes.clear()
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(x) for x in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "size", "elements"])

    return texts.mapInArrow(run, "node long, size long, elements array<long>")


def cross_matches(rows: DataFrame, threshold: float) -> DataFrame:
    """a, b, most: pairs of different groups that may be as similar as `threshold`, by the first element that they share.

    rows: node, group, size, element, left (elements of the node from this one on), n (rows of the
    element), main (whether the group is the element's largest). most bounds what the pair has in common.

    Of a pair, b is the smaller (by size, then node). At the first common element the smaller has at
    least 2t / (1 + t) of its size left and the larger t, so few rows of the smaller side take part.
    Members of an element's largest group don't meet each other, so an element makes no more rows than
    it has pairs of different groups. The largest group's side is split into blocks of `BLOCK` rows, and
    the others' rows are laid out for each of them.
    """
    small = rows.where(F.col("left") >= 2 * threshold / (1 + threshold) * F.col("size") - 1e-9)
    large = rows.where(F.col("left") >= threshold * F.col("size") - 1e-9)
    blocks = F.ceil(F.col("n") / BLOCK)
    split = F.pmod(F.xxhash64("node"), blocks)
    laid = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    columns = ("node", "group", "size", "left")

    def met(x: DataFrame, x_salt: Column, y: DataFrame, y_salt: Column) -> DataFrame:
        sides = [df.select("element", salt.alias("salt"), *[F.col(c).alias(f"{c}_{k}") for c in columns]) for df, salt, k in ((x, x_salt, "a"), (y, y_salt, "b"))]
        both = sides[0].join(sides[1], ["element", "salt"]).where("group_a <> group_b and (size_b < size_a or size_b = size_a and node_b < node_a)")
        most = F.least("left_a", "left_b")
        return both.where(most >= threshold / (1 + threshold) * (F.col("size_a") + F.col("size_b")) - 1e-9).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), most.alias("most"))

    found = met(large.where("not main"), laid, small, split).unionByName(met(large.where("main"), split, small.where("not main"), laid))
    return found.groupBy("a", "b").agg(F.max("most").alias("most"))


def similar_pairs(nodes: DataFrame, texts: DataFrame, threshold: float = SIMILARITY, limit: int = PARTNERS, weighting: str = "count") -> DataFrame:
    """a, b, root_a, root_b: candidates that join all rows of `nodes` (node, root) which pairs as similar as `threshold` join.

    A prefix join: in one order of all shingles, a pair's first common shingle lies in the first part of
    either text (`cross_matches`). Shingles that bring more than `limit` partners a member (hot) come last
    in the order, so a pair either has another shingle in common there, or shares hot ones only.
    In the second case texts with the same hot shingles are alike up to their sizes: whatever links
    with one of them links with the smallest, which stands for all in the next level. A level joins
    the sets of hot shingles the same way, by how many of these sets hold a shingle and with a higher
    limit. Partners of one who stands for others are compared with each of these that is small enough.
    No row holds more than one shingle.
    """
    sets = materialize(shingle_sets(texts.join(nodes.select("node"), "node", "left_semi"), weighting).join(nodes, "node"), "sets")
    sizes = sets.select("node", "size")
    enough = lambda most, *size: F.col(most) >= threshold / (1 + threshold) * (F.col(size[0]) + F.col(size[1])) - 1e-9
    # group: sets of one group need no link.
    info = sets.select("node", "size", F.col("root").alias("group"))
    rows = sets.select("node", F.col("root").alias("group"), F.explode("elements").alias("element"))
    members, pairs = None, []
    while True:
        shared = rows.groupBy("element").agg(F.min("group").alias("_low"), F.max("group").alias("_high"), F.count(F.lit(1)).alias("n"))
        shared = materialize(shared.where("_low <> _high").select("element", "n"), "shared")
        held = materialize(join_hot(rows, shared, "element"), "held")
        of_group = held.groupBy("element", "group").agg(F.count(F.lit(1)).alias("c"))
        spread = of_group.groupBy("element").agg(F.sum("c").alias("n"), F.sum(F.col("c").cast("double") * F.col("c")).alias("_own"), F.max(F.struct("c", "group")).alias("_main"))
        n = F.col("n").cast("double")
        spread = materialize(spread.select("element", "n", F.col("n").alias("among"), F.col("_main.group").alias("largest"), (n * n - F.col("_own") > limit * n).alias("hot")), "spread")
        own = Window.partitionBy("node")
        ranked = join_hot(held, spread, "element").withColumnRenamed("among", "n").withColumn("i", F.row_number().over(own.orderBy("hot", "n", "element"))).withColumn("_held", F.count(F.lit(1)).over(own))
        # Shingles that only one group has come first. `left`: how many follow, with this one.
        ranked = ranked.drop("group").join(info, "node").withColumn("left", F.col("_held") - F.col("i") + 1).where((F.col("left") >= threshold * F.col("size") - 1e-9) | F.col("hot"))
        ranked = materialize(ranked.select("node", "group", "size", "element", "hot", "left", "n", (F.col("group") == F.col("largest")).alias("main")), "ranked")
        near = materialize(cross_matches(ranked.where("not hot"), threshold), "near")
        if members is None:
            pairs.append(near.select("a", "b"))
        else:
            # A member that links with another's member links with the one that stands for it, too.
            both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "most"))
            named = both.join(members.join(sizes.toDF("member", "size_a"), "member").withColumnRenamed("node", "a"), "a").join(sizes.toDF("b", "size_b"), "b")
            pairs.append(named.where(enough("most", "size_a", "size_b")).select(F.col("member").alias("a"), "b"))
        hot = ranked.where("hot").groupBy("node", "size").agg(F.count(F.lit(1)).alias("m"), *[F.bit_xor(F.xxhash64("element", F.lit(k))).alias(f"x{k}") for k in (1, 2)])
        hot = materialize(hot.where(F.col("m") >= threshold * F.col("size") - 1e-9), "hot")
        if hot.where(F.col("m") >= 2 * threshold / (1 + threshold) * F.col("size") - 1e-9).isEmpty():
            break  # the smaller of a pair that shares hot shingles only must have so many
        least = hot.groupBy("m", "x1", "x2").agg(F.min(F.struct("size", "node")).alias("s"))
        stands = materialize(hot.join(least, ["m", "x1", "x2"]).select("node", F.col("s.node").alias("rep"), F.col("s.size").alias("size"), "m"), "stands")
        members = stands.select(F.col("node").alias("member"), "rep", "m") if members is None else members.join(stands, "node").select("member", "rep", "m")
        members = materialize(members.withColumnRenamed("rep", "node"), "members")
        named = members.join(sizes.toDF("member", "size_a"), "member").join(sizes.toDF("node", "size_b"), "node")
        pairs.append(named.where(enough("m", "size_a", "size_b")).select(F.col("member").alias("a"), F.col("node").alias("b")))
        members = members.drop("m")
        # A set that stands for several roots is a group of its own.
        of_rep = members.join(nodes.toDF("member", "root"), "member").groupBy("node").agg(F.min("root").alias("_low"), F.max("root").alias("_high"))
        grouped = of_rep.select("node", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(-1 - F.col("node")).alias("group"))
        info = materialize(stands.where("node = rep").select("node", "size").join(grouped, "node"), "info")
        rows = ranked.where("hot").select("node", "element").join(info.select("node", "group"), "node")
        limit *= 1024
    every = pairs[0]
    for more in pairs[1:]:
        every = every.unionByName(more)
    every = every.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    every = every.join(nodes.toDF("a", "root_a"), "a").join(nodes.toDF("b", "root_b"), "b")
    return materialize(every.where("root_a <> root_b").select("a", "b", "root_a", "root_b"), "every")


def bucket_centres(keyed: DataFrame, centre: Column | None = None) -> DataFrame:
    """key, c (the least `centre`) and n of the buckets of `keyed` (node, root, key) with several classes.

    Without a centre c is the least node, and each node is taken for a class of its own.
    """
    own = "node" if centre is None else "root"
    least = F.min("node").alias("c") if centre is None else F.min(centre).alias("c")
    found = keyed.groupBy("key").agg(least, F.min(own).alias("_low"), F.max(own).alias("_high"), F.count(F.lit(1)).alias("n"))
    return materialize(found.where("_low <> _high").select("key", "c", "n"), "centres")


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, weighting: str = "count") -> DataFrame:
    """doc_id and class_id (the least doc_id of its class) of every row of `docs`."""
    with Temporary(docs.sparkSession) as temporary:
        signed, named = classified(docs, threshold, weighting)
        temporary.keep(signed, named)
    rows = signed.select("doc_id", "words")
    in_class = join_hot(rows.where("doc_id is not null and words is not null"), named, "words").select("doc_id", "class_id")
    return in_class.unionByName(rows.where("doc_id is null or words is null").select("doc_id", F.col("doc_id").alias("class_id")))


def classified(docs: DataFrame, threshold: float, weighting: str) -> tuple[DataFrame, DataFrame]:
    """Two tables: the signed rows of `docs`, and words, n and class_id of every text."""
    signed = materialize(sign(docs, weighting).withColumn("uid", F.monotonically_increasing_id()), "signed")
    known = signed.where("doc_id is not null and words is not null")
    nodes = known.groupBy("words").agg(
        F.min("uid").alias("node"), F.min("doc_id").alias("least_id"), F.min_by(F.struct("doc_id", "hash"), "uid").alias("at"), F.any_value("bands").alias("bands"), F.count(F.lit(1)).alias("n"),
    )
    nodes = materialize(nodes, "nodes")
    links = links_of_ids(known, nodes)
    live = nodes.select("node", "bands", F.col("node").alias("root"))
    texts = None
    for n in range(1, ROUNDS + 1):
        # The first round's centre is the bucket's least node, later ones are drawn.
        if n == 1:
            keyed = bucket_keys(live, "node")
            met = join_hot(keyed, bucket_centres(keyed), "key").select(F.col("c").alias("a"), F.col("node").alias("b")).distinct()
            met = materialize(met.select("a", "b", F.col("a").alias("root_a"), F.col("b").alias("root_b")), "met")
        else:
            keyed = bucket_keys(live, "node", "root")
            centres = bucket_centres(keyed, F.struct(F.xxhash64("node", "key", F.lit(n)).alias("h"), "node", "root"))
            met = join_hot(keyed, centres, "key").select(F.col("c.node").alias("a"), F.col("node").alias("b"), F.col("c.root").alias("root_a"), F.col("root").alias("root_b"))
            met = materialize(met.distinct(), "met")
        # Only members of buckets with several classes go on; a centre meets itself and so stays as well.
        live = materialize(live.join(met.select(F.col("b").alias("node")).distinct(), "node", "left_semi"), "live")
        if texts is None:
            # Shuffled at any size: the ids grow with the documents.
            wanted = nodes.join(live.select("node"), "node", "left_semi").select("at.*", "node")
            texts = materialize(hashed_texts(docs).join(wanted.hint("merge"), ["doc_id", "hash"]).select("node", "text").dropDuplicates(["node"]), "texts")
            unsettled = live
        found = materialize(compare(met.where("root_a <> root_b"), texts, threshold, weighting), "found")
        if found.isEmpty():
            if met.isEmpty():
                break
            continue
        links = found.select("a", "b") if links is None else links.unionByName(found.select("a", "b"))
        # One step towards the components: who was linked takes the lesser root of the two.
        both = F.array(F.struct(F.col("a").alias("node"), F.col("root_b").alias("r")), F.struct(F.col("b").alias("node"), F.col("root_a").alias("r")))
        lower = found.select(F.inline(both)).groupBy("node").agg(F.min("r").alias("r"))
        live = materialize(live.join(lower, "node", "left").select("node", "bands", F.least("root", F.coalesce("r", "root")).alias("root")), "live")
    classes = None if links is None else materialize(components(links), "classes")
    # What shares a bucket with another class by now is settled exactly.
    live = unsettled.select("node", "bands")
    live = live.join(classes, "node", "left").select("node", "bands", F.coalesce("root", "node").alias("root")) if classes is not None else live.withColumn("root", F.col("node"))
    keyed = bucket_keys(live, "node", "root")
    left = materialize(join_hot(keyed, bucket_centres(keyed, F.lit(0).cast("long")), "key").select("node", "root").distinct(), "unsettled")
    if not left.isEmpty():
        found = materialize(compare(similar_pairs(left, texts, threshold, weighting=weighting), texts, threshold, weighting), "found")
        if not found.isEmpty():
            joined = components(found.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))).toDF("root", "_least")
            every = live.select("node", "root")
            if classes is not None:
                every = classes.unionByName(every).distinct()
            classes = materialize(every.join(joined, "root", "left").select("node", F.coalesce("_least", "root").alias("root")), "classes")
    named = nodes.select("words", "n", F.col("least_id").alias("class_id"))
    if classes is not None:
        linked = classes.join(nodes.select("node", "least_id"), "node")
        of_root = materialize(linked.groupBy("root").agg(F.min("least_id").alias("class_id"), F.count(F.lit(1)).alias("n")), "of_root")
        of_node = join_hot(classes, of_root, "root").select("node", "class_id")
        named = nodes.join(of_node, "node", "left").select("words", "n", F.coalesce("class_id", "least_id").alias("class_id"))
    return signed, materialize(named, "named")


def links_of_ids(known: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """a, b: the nodes of each doc_id that occurs with several texts; None if there is none."""
    several = known.groupBy("doc_id").agg(F.min("words").alias("_low"), F.max("words").alias("_high"), F.count(F.lit(1)).alias("n")).where("_low <> _high")
    several = materialize(several.select("doc_id", F.col("_low").alias("low"), "n"), "several")
    if several.isEmpty():
        return None
    pairs = join_hot(known.select("doc_id", "words"), several, "doc_id").where("words <> low").select("words", "low").distinct()
    at = nodes.select("words", "node")
    return materialize(pairs.join(at.toDF("words", "b"), "words").join(at.toDF("low", "a"), "low").select("a", "b"), "links")


def keep_one(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row for each class of `docs`: that of its least doc_id, the least row if several have this id.

    Rows without doc_id stay. Rows of one id are ordered by their columns, as JSON if there are maps among them.
    """
    classes = near_duplicates(docs, threshold)
    first = materialize(classes.where("doc_id = class_id").groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("n")).withColumn("_alone", F.col("n") == 1), "first")
    rows = flat(docs, _id="doc_id")
    kept = join_hot(rows, first, "_id")
    row = F.struct(*[f"_{i}" for i in range(len(docs.columns))])
    least = F.min_by(row, F.to_json(row)) if any("map<" in t for _, t in docs.dtypes) else F.min(row)
    several = kept.where("not _alone").groupBy("_id").agg(least.alias("_row")).select("_row.*", "_id")
    return unflat(kept.where("_alone").drop("_alone").unionByName(several).unionByName(rows.where("_id is null")), docs)
