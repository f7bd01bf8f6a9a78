"""Runs against a comparison of every word with the word a period on, for every period."""

from __future__ import annotations

import random
import re
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest
from conftest import SF

from crossgrain.llm import periodic, queries

SCHEMA = "doc_id long, text string, TEXT string, Doc_Id int"


def brute_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 3 + 1):
        start = 0
        for i in range(n - q + 1):
            if i == n - q or w[i] != w[i + q]:
                if i + q - start >= max(24, 3 * q):
                    out.setdefault((start, i + q), q)  # the least period comes first
                start = i + 1
    return sorted(((s, e, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def fast_runs(w):
    """The same for long texts: equality with the word a period on, in numpy."""
    known, out = {}, {}
    x = np.array([known.setdefault(t, len(known)) for t in w])
    for q in range(1, len(w) // 3 + 1):
        same = np.concatenate([[0], (x[q:] == x[:-q]).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(same))
        for s, e in zip(edge[::2].tolist(), (edge[1::2] + q).tolist(), strict=True):
            if e - s >= max(24, 3 * q):
                out.setdefault((s, e), q)
    return sorted(((s, e, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text, runs_of=fast_runs):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_of(w)
    drop = {i for s, e, q in runs for i in range(s + q, e)}
    top = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    best = (top[0], top[1] - top[0], top[2], 1000 * (top[1] - top[0]) // top[2]) if top else (None,) * 4
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    left = " ".join(t for i, t in enumerate(w) if i not in drop)
    return (doc_id, len(runs), *best, sha256(lines.encode()).hexdigest(), sha256(left.encode()).hexdigest())


def columns(df):
    return [tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in df.collect()]


def grown(rng, m, alphabet, depth=0):
    """Words with repeats in repeats."""
    kind = rng.random()
    if m <= 0 or kind < 0.4 or depth > 4:
        return [rng.randrange(alphabet) for _ in range(m)]
    if kind < 0.8:
        unit = grown(rng, rng.randint(1, max(1, m // 2)), alphabet, depth + 1)
        out = (unit * (m // len(unit) + 1))[:m]
        if rng.random() < 0.3:
            out[rng.randrange(m)] = rng.randrange(alphabet)
        return out
    k = rng.randint(0, m)
    return grown(rng, k, alphabet, depth + 1) + grown(rng, m - k, alphabet, depth + 1)


@pytest.mark.parametrize("seed", range(4))
def test_random_texts_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = [[str(x) for x in grown(rng, rng.randint(0, 160), rng.choice([1, 2, 2, 3, 5, 50]))] for _ in range(rng.randint(1, 8))]
        for text, got in zip(texts, periodic.runs_of(texts), strict=True):
            assert [tuple(r) for r in got.tolist()] == brute_runs(text)


def test_long_periods_and_broken_stretches():
    """Periods whose blocks are themselves periodic, so that only the ends of their stretches tell the period."""
    texts = []
    for run in (10, 40, 90, 200):
        for tail in (1, 2, 7):
            unit = ["a"] * run + [f"b{i}" for i in range(tail)]
            texts += [unit * 5, ["x"] + unit * 3 + ["a"] * (run // 2), (unit + ["a", "b"] * run) * 4, ["a", "b", "c"] * 30 + unit * 4]
    for text, got in zip(texts, periodic.runs_of(texts), strict=True):
        assert [tuple(r) for r in got.tolist()] == fast_runs(text)


def test_wavelet_equals_sorting():
    rng = np.random.default_rng(2)
    values = rng.permutation(500)
    wavelet = periodic.Wavelet(values)
    low = rng.integers(0, 500, 300)
    high = np.minimum(500, low + rng.integers(0, 200, 300))
    x = rng.integers(0, 1200, 300)
    found = wavelet.successors(low, high, x, 3, -1)
    for n in range(300):
        want = sorted(v for v in values[low[n] : high[n]] if v >= x[n])[:3]
        assert [f[n] for f in found] == want + [-1] * (3 - len(want))


def test_query_equals_brute_force(spark):
    got = columns(queries.op13_periodic_runs(spark, SF))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(got) == sorted(expected(r.doc_id, r.text) for r in docs)
    assert sum(r[1] > 0 for r in got) > 10


def test_odd_texts(spark):
    """Null, empty and long texts, odd white space, repeated rows and ids, rows without id."""
    rng = random.Random(9)
    phrase = " ".join(str(rng.randrange(10**6)) for _ in range(700))
    texts = [None, "", " \n\t", "a", "a " * 23, "a " * 24, "a\x1cb c\x85d " * 30, "word " * 40_000, f"{phrase} " * 9, "x " * 500 + phrase, "a b " * 12 + "c", "日本 🙂 " * 20, "l1\nl2\r\nl3\x0bl4\x0c" * 9]
    rows = [(i, t, "clash", 3) for i, t in enumerate(texts)] + [(5, texts[8], "clash", 3), (5, texts[8], "clash", 3), (None, texts[8], None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    got = columns(periodic.digests(periodic.periodic_runs(df, periodic.planted)))
    assert sorted(got, key=repr) == sorted((expected(i, t) for i, t, *_ in rows), key=repr)
    found = {r.doc_id: r for r in periodic.periodic_runs(df).collect()}
    assert [tuple(r) for r in found[8].runs] == [(0, 6300, 700)] and found[8].collapsed == phrase
    assert periodic.digests(periodic.periodic_runs(df.limit(0))).count() == 0


def test_a_text_of_300_000_words(spark):
    rng = random.Random(3)
    words = [str(rng.randrange(10**7)) for _ in range(100_000)]
    text = " ".join(words * 3)
    runs = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in runs.runs] == [(0, 300_000, 100_000)] and runs.collapsed == " ".join(words)
