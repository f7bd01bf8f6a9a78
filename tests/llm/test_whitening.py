"""Whitening against an eigendecomposition of the covariance matrix, on odd tables too."""

from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from crossgrain.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, VEC_ID string, Embedding int"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def brute(vectors, scale=64):
    """x, deviations, variances, components and trace of the rows that take part."""
    whole = [v for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(map(len, whole))
    x = [[math.floor(scale * c) + 1_000_000 for c in v] + [1_000_000] * (width - len(v)) for v in whole]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    y = np.array([[(n * c - s) / n for c, s in zip(row, sums, strict=True)] for row in x])
    e, vec = np.linalg.eigh(y.T @ y / n)
    return n, y, deviation, e[::-1], vec[:, ::-1]


def check(rows, vectors, components=32, least=1e-11):
    n, y, deviation, e, vec = brute(vectors)
    trace = e.sum()
    kept = min(components, int((e > least * trace).sum()))
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert len(rows) == n * kept and len(got) == n
    ids = sorted(got)
    assert [got[i][1].deviation for i in ids] == deviation and {r.n for r in rows} == {n}
    z = np.array([[got[i][k + 1].whitened for k in range(kept)] for i in ids])
    assert np.allclose([got[ids[0]][k + 1].explained for k in range(kept)], e[:kept] / trace, rtol=1e-6)
    assert np.abs(z.T @ z / n - np.eye(kept)).max() < 1e-6 and rows[0].identity_error < 1e-6
    # Equal variances leave the basis open: compare the spaces that single variances or ties span.
    start = 0
    while start < kept:
        end = start + 1
        while end < len(e) and e[end - 1] - e[end] < 1e-9 * trace:
            end += 1
        if end <= kept:
            want = y @ vec[:, start:end] / np.sqrt(e[start:end])
            assert np.abs(z[:, start:end] @ z[:, start:end].T - want @ want.T).max() < 1e-5
        start = end


def test_query_equals_eigendecomposition(spark):
    rows = queries.op11_embedding_whitening(spark, SF).collect()
    vectors = [r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    check(rows, vectors)
    assert max(abs(r.identity_error) for r in rows) < 1e-10


@pytest.mark.parametrize("seed", range(6))
def test_random_tables(spark, seed):
    """Tied, small and zero variances; hot vectors; fewer rows than dimensions."""
    rng = np.random.default_rng(seed)
    n, d = [(60, 5), (7, 12), (300, 40), (200, 9), (120, 6), (40, 3)][seed]
    x = rng.normal(0, 1, (n, d)) * 10.0 ** rng.uniform(-1, 3 if seed == 3 else 1, d)
    if seed == 2:
        x[: n // 3] = x[0]
    if seed == 4:
        x[:, 3] = x[:, 1] - x[:, 2]
        x[:, 5] = 7.25
        x = np.floor(64 * x) / 64
    if seed == 5:
        x = np.array([[1.0, 0, 0], [-1.0, 0, 0], [0, 1.0, 0], [0, -1.0, 0]] * 10)
    vectors = [list(map(float, v)) for v in x]
    check(whitening.whiten(frame(spark, vectors).repartition(3)).collect(), vectors)


def test_odd_rows(spark):
    vectors = [None, [1.0, None], [float("nan"), 1.0], [float("inf"), 0.0], [1.0], [], [2.0, 3.0], [0.5, -1.0], [0.5, -1.0], [2.0, 9.0]]
    ids = list(range(8)) + [7, None]
    rows = whitening.whiten(frame(spark, vectors, ids)).collect()
    whole = [v for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, _, deviation, _, _ = brute(vectors)
    assert n == len(whole) == 6 and len(rows) == 12 and sorted(r.deviation for r in rows if r.component == 1) == sorted(deviation)
    assert sum(r.vec_id is None for r in rows) == 2 and sum(r.vec_id == 7 for r in rows) == 4
    one = frame(spark, [[1.0, 2.0]])
    assert whitening.whiten(one).count() == whitening.whiten(one.union(one)).count() == whitening.whiten(one.limit(0)).count() == 0
    assert whitening.whiten(frame(spark, [[], []])).count() == 0
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(frame(spark, [[1e20], [1.0]])).count()


def test_large_deviations_are_exact(spark):
    vectors = [[float(10**9 + i * 12345), float(i % 3)] for i in range(50)]
    check(whitening.whiten(frame(spark, vectors)).collect(), vectors, least=1e-12)
    x = np.array([[2**39, 1], [-(2**39), 5]])
    assert whitening.deviations(x, 1000, np.array([17, 3])).tolist() == [sum((1000 * int(c) - s) ** 2 for c, s in zip(r, (17, 3), strict=True)) for r in x]


def test_rows_are_packed_in_the_narrowest_type(spark):
    kinds = {r.kind for r in whitening.integer_blocks(frame(spark, [[0.5], [300.0]]).repartition(1), 64).collect()}
    assert kinds == {"i2"} and whitening.integer_blocks(frame(spark, [[0.5]]), 64).agg(F.sum("n")).first()[0] == 1
