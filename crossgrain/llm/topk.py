"""Exact top-k inner products by MaxScore over dense vectors.

A query's terms are its dimensions, and a dimension's postings are its values in a shard of
candidates. Less its least contribution in the shard, a term adds nothing negative, and at most its
range: its score bound. From a bound on the k-th score, the terms of smallest bound that together
can't lift a candidate over it are non-essential. The postings of essential terms are traversed for
a block of queries at once (one matrix product; dimensions that no query of the block finds
essential aren't touched); candidates that the non-essential bounds can still lift to the k-th score
are probed in the other terms, largest bound first, a part at a time, and dropped as soon as they
can't compete.

Vectors never move: a task reads its part of the table as shards, one after another, against a
round of queries (`ROUND_BYTES` at most, broadcast), and carries each query's k best and its k-th
score from shard to shard, so the bound rises all along. The first bound comes from a fixed number
of rows (`SEED_ROWS`). Tasks report k rows a query with exact scores, which are merged by score and
id. Queries beyond one round take further rounds: work grows with queries times rows, as it must for
an exact search over a fixed share of rows. Components are floor(scale * x), scores are integers.

Edge cases: vectors that are null or hold a null or non-finite component take no part, neither do
rows without id; rows that share an id, equal or not, are rows of their own (each a candidate of the
others, each a query if its id is one); shorter vectors count as ending in zeros; fewer than k
candidates give fewer rows; an empty table gives an empty result; extra columns are ignored, whatever
their names; a score that 64 bits can't hold raises OverflowError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossgrain.llm.common import Temporary, materialize, new_path, pick

SHARD_ROWS, QUERY_ROWS, SEED_ROWS, PROBES = 8192, 256, 2048, 3
#: Bytes of query vectors in a round, and pairs that are probed at once.
ROUND_BYTES, PAIRS = 32 << 20, 1 << 16
LEAST = -(2**63)


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """uid (a row's own number), vec_id and q array<long> of the rows that take part."""
    x = F.col("embedding")
    whole = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    rows = pick(vectors, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.coalesce(whole, F.lit(False)))
    q = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", q.alias("q"))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of integers as rows; shorter ones end in zeros."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    width = int(size.max(initial=0))
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def widened(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m


def best_of(query: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best, ties to the smaller id, ordered by query."""
    order = np.lexsort((vec_id, -score, query))
    sorted_query = query[order]
    first = np.flatnonzero(np.diff(sorted_query, prepend=-1))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
    return order[rank < k]


class Search:
    """A round of queries and the k best rows that each has met so far."""

    def __init__(self, uids: np.ndarray, vectors: np.ndarray, theta: np.ndarray, k: int):
        self.uids, self.q, self.theta, self.k = uids, vectors, theta.copy(), k
        self.found = [np.zeros(0, np.int64)] * 3  # query, score, vec_id

    def meet(self, rows: np.ndarray, uids: np.ndarray, vec_ids: np.ndarray) -> None:
        """One shard of candidates."""
        width = max(rows.shape[1], self.q.shape[1])
        rows, self.q = widened(rows, width), widened(self.q, width)
        most = int(np.abs(self.q.astype(float)).max(initial=0)) * int(np.abs(rows.astype(float)).max(initial=0)) * max(1, width)
        kind = np.float64 if most < 2**52 else object  # Python's integers where doubles would round
        m = rows.astype(kind)
        low, high = m.min(0), m.max(0)
        new = [self._block(slice(i, i + QUERY_ROWS), m, low, high, uids, kind) for i in range(0, len(self.q), QUERY_ROWS)]
        at, row, score = (np.concatenate(x) for x in zip(*new, strict=True))
        query, score, vec_id = (np.concatenate(x) for x in zip(self.found, (at, score, vec_ids[row]), strict=True))
        best = best_of(query, score, vec_id, self.k)
        self.found = [query[best], score[best], vec_id[best]]
        n = np.bincount(self.found[0], minlength=len(self.q))
        full = np.flatnonzero(n == self.k)
        self.theta[full] = np.maximum(self.theta[full], self.found[1][n.cumsum()[full] - 1])

    def _block(self, part: slice, m: np.ndarray, low: np.ndarray, high: np.ndarray, uids: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and score of all pairs that may be among the k best."""
        q, theta = self.q[part].astype(kind), self.theta[part].astype(kind)
        ends = np.stack([q * low, q * high])
        least, bound = ends.min(0), ends.max(0) - ends.min(0)
        order = np.argsort(bound, 1, kind="stable")  # smallest bound first
        sums = np.take_along_axis(bound, order, 1).cumsum(1)
        # In terms over their least contribution, the k-th score lies this much over the sum of the least.
        n_non = (sums < (theta - least.sum(1))[:, None]).sum(1)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
        essential = rank >= n_non[:, None]
        walked = essential.any(0)
        score = np.where(essential, q, 0)[:, walked].astype(kind) @ m[:, walked].T
        lift = np.where(essential, 0, least + bound).astype(kind).sum(1)
        i, j = np.nonzero(score + lift[:, None] >= theta[:, None])
        other = self.uids[part][i] != uids[j]
        i, j = i[other], j[other]
        score = score[i, j]
        for p in range(PROBES if n_non.any() else 0):
            # The p-th part of each query's non-essential terms, largest bounds first.
            from_end = n_non[:, None] - 1 - rank
            own = (from_end * PROBES // np.maximum(n_non, 1)[:, None] == p) & ~essential
            some, lift = np.where(own, q, 0).astype(kind), lift - np.where(own, least + bound, 0).astype(kind).sum(1)
            if len(i):
                score = score + np.concatenate([(m[j[a : a + PAIRS]] * some[i[a : a + PAIRS]]).sum(1) for a in range(0, len(i), PAIRS)])
            on = score + lift[i] >= theta[i]
            i, j, score = i[on], j[on], score[on]
        return i + part.start, j, np.array(score.tolist() if kind is object else score, dtype=np.int64)


def shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Vectors, uids and ids of `size` rows at most at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            part = batch.slice(i, size)
            yield matrix(part.column(2)), part.column(0).to_numpy(), part.column(1).to_numpy()


def searched(rows: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, Broadcast]:
    """The broadcast round and query_uid, query_id, vec_id and score: each task's k best of a round of queries (uid, vec_id, q, theta), which the driver can hold."""
    held = queries.toArrow().combine_chunks()
    uids, ids, theta = (held.column(c).to_numpy() for c in ("uid", "vec_id", "theta"))
    column = held.column("q")
    shared = rows.sparkSession.sparkContext.broadcast((uids, ids, matrix(column.chunk(0) if column.num_chunks else pa.array([], pa.list_(pa.int64()))), theta))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_uids, query_ids, vectors, start = shared.value
        search = Search(query_uids, vectors, start, k)
        for shard in shards(batches, SHARD_ROWS):
            search.meet(*shard)
        at, score, vec_id = search.found
        for i in range(0, len(at), 10_000):
            part = slice(i, i + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (query_uids[at[part]], query_ids[at[part]], vec_id[part], score[part])], names=["query_uid", "query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_uid long, query_id long, vec_id long, score long"), shared


def with_first_bound(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """`queries` with theta: the k-th score among `SEED_ROWS` rows, or less than any score."""
    seeds = [(r.uid, r.q) for r in rows.select("uid", "q").limit(SEED_ROWS).collect()]
    seed_uids, seed = np.array([u for u, _ in seeds], np.int64), matrix(pa.array([q for _, q in seeds], pa.list_(pa.int64())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            for vectors, uids, _ in shards([batch], QUERY_ROWS):
                search = Search(uids, vectors, np.full(len(uids), LEAST), k)
                search.meet(seed, seed_uids, seed_uids)
                found.append(search.theta)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found))], names=["uid", "vec_id", "q", "theta"])

    return queries.mapInArrow(run, "uid long, vec_id long, q array<long>, theta long")


RESULT = "query_id long, rank int, vec_id long, score long"


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k best among all other rows, ties to the smaller id."""
    spark = vectors.sparkSession
    with Temporary(spark) as temporary:
        rows = materialize(integers(vectors, scale), "vectors")
        asked = rows.where(is_query)
        n, width = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
        if not n:
            return spark.createDataFrame([], RESULT)
        rounds = -(-n * 8 * max(1, width) // ROUND_BYTES)
        # Dealt out evenly, so that a part is a round.
        dealt = with_first_bound(asked.repartition(rounds), rows, k).withColumn("round", F.spark_partition_id())
        dealt = materialize(dealt, "queries")
        rank = F.row_number().over(Window.partitionBy("query_uid").orderBy(F.col("score").desc(), "vec_id"))

        def result(number: int) -> tuple[DataFrame, Broadcast]:
            found, shared = searched(rows, dealt.where(F.col("round") == number).drop("round"), k)
            return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), shared

        if rounds == 1:
            temporary.keep(rows)  # the result reads it; the queries are broadcast
            return result(0)[0]
        path = new_path(spark, "found")
        for number in range(rounds):
            found, shared = result(number)
            found.write.mode("append").parquet(path)
            shared.destroy()
    return spark.read.schema(RESULT).parquet(path)


#: The same in DuckDB's SQL, all pairs.
SQL = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.uid, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.uid <> b.uid WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
