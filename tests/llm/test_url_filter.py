"""URL filter: hosts and rules against SQL, trees against a plain recursion over the same rows."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
from conftest import SF

from crossgrain.llm import queries, url_filter
from crossgrain.llm.queries import URL_RULES

RULES = [url_filter.rule(*r) for r in URL_RULES]
SCHEMA = "page_id long, url string, html string, URL int, Page_Id string"

#: Host, path and rule in DuckDB's SQL.
SQL = """
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), cut AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest
), rules(verdict, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT c.page_id, r.verdict, r.host || r.path AS rule, row_number() OVER (PARTITION BY c.page_id ORDER BY length(r.host || r.path) DESC) AS n
  FROM cut c JOIN rules r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path)
)
SELECT c.page_id, c.host, c.path, f.rule, f.verdict FROM cut c LEFT JOIN fits f ON f.page_id = c.page_id AND f.n = 1
"""


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "<p>", 1, "clash") for i, u in enumerate(urls)], SCHEMA)


def test_hosts_paths_and_rules_equal_sql(spark, duck):
    got = {r.page_id: r for r in queries.op12_url_filters(spark, SF).collect()}
    want = duck.execute(SQL).fetchall()
    assert len(got) == len(want)
    for page_id, host, path, rule, verdict in want:
        r = got[page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict == ("block" if r.score >= 0.5 else "allow")


def naive_features(url, host, path, counts, prior):
    url = url or ""
    n = len(url)
    share = [c / n for c in Counter(url).values()]
    query = url.split("#")[0].split("?", 1)[1] if "?" in url.split("#")[0] else ""
    out = [math.log2(1 + k) / 12 for k in (n, len(host), len(path))]
    out += [len([p for p in path.split("/") if p]) / 16, len(host.split(".")) / 16 if host else 0, host.count("-") / 16]
    out += [sum(c in "0123456789" for c in url) / n if n else 0, -sum(p * math.log2(p) for p in share) / 8, len([p for p in query.split("&") if p]) / 16]
    for k in (1, 2, 3):
        allow, block = counts.get((k, ".".join(host.split(".")[-k:])), (0, 0))
        odds = math.log((block + 4 * prior) / (allow + 4 * (1 - prior))) - math.log(prior / (1 - prior))
        out += [min(1, max(0, odds / 16 + 0.5)), math.log2(1 + allow + block) / 32]
    return [min(31, int(x * 32)) for x in out]


def naive_scores(urls, rules, trees=url_filter.TREES):
    """The same model by a recursion over lists of rows; no hashed counters, no blocks, no levels."""
    cut = [(u, *url_filter.host_and_path(u)) for u in urls]
    labelled = []
    for u, host, path in cut:
        best = max((r for r in rules if path.startswith(r.path) and ("." + host).endswith("." + r.host)), key=lambda r: len(r.text), default=None)
        if best:
            labelled.append((u, host, path, best.verdict == "block", zlib.crc32(u.encode()) % url_filter.FOLDS))
    prior = sum(y for *_, y, _ in labelled) / len(labelled)

    def counted(rows):
        counts = {}
        for _, host, _, y, _ in rows:
            for k in (1, 2, 3):
                c = counts.setdefault((k, ".".join(host.split(".")[-k:])), [0, 0])
                c[y] += 1
        return counts

    by_fold = {f: counted([r for r in labelled if r[4] != f]) for f in range(url_filter.FOLDS)}
    x = [naive_features(u, h, p, by_fold[f], prior) for u, h, p, _, f in labelled]
    y = [r[3] for r in labelled]
    start = math.log(prior / (1 - prior))
    every = [naive_features(u, h, p, counted(labelled), prior) for u, h, p in cut]
    raw, out = [start] * len(x), [start] * len(every)

    def grow(rows, asked, depth):
        g, h = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
        best = (1e-9, None)
        if depth < url_filter.DEPTH:
            for f in range(len(url_filter.NAMES)):
                for b in range(32):
                    left = [i for i in rows if x[i][f] <= b]
                    gl, hl = sum(grad[i] for i in left), sum(hess[i] for i in left)
                    if hl < 1 or h - hl < 1:
                        continue
                    gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                    if gain > best[0]:
                        best = (gain, (f, b))
        if best[1] is None:
            for i in rows:
                raw[i] -= url_filter.RATE * g / (h + 1)
            for i in asked:
                out[i] -= url_filter.RATE * g / (h + 1)
            return
        f, b = best[1]
        grow([i for i in rows if x[i][f] <= b], [i for i in asked if every[i][f] <= b], depth + 1)
        grow([i for i in rows if x[i][f] > b], [i for i in asked if every[i][f] > b], depth + 1)

    for _ in range(trees):
        p = [1 / (1 + math.exp(-r)) for r in raw]
        grad = [round((a - b) * url_filter.UNIT) / url_filter.UNIT for a, b in zip(p, y, strict=True)]
        hess = [round(a * (1 - a) * url_filter.UNIT) / url_filter.UNIT for a in p]
        grow(list(range(len(x))), list(range(len(every))), 0)
    return [1 / (1 + math.exp(-r)) for r in out]


def test_trees_equal_a_plain_recursion(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "TREES", 5)
    rng = np.random.default_rng(4)
    hosts = ["a.example.com", "www.example.com", "x.net", "spam-farm.example.com", "q.w.e.net", "org.org", "b.org", "com"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.integers(10_000)}{rng.choice(['', '?a=1', '?a=1&b=2', '#x'])}" for _ in range(150)]
    got = [r.score for r in url_filter.judge(pages(spark, urls).repartition(5), RULES).orderBy("page_id").collect()]
    assert np.allclose(got, naive_scores(urls, RULES, 5), atol=1e-6)
    assert len(set(got)) > 3


def test_odd_urls(spark):
    urls = [None, "", "no scheme/en/", "http://", "HTTP://WWW.EXAMPLE.COM/en/x?y#z", "http://example.com", "http://example.com/en", "http://example.com/en/", "http://notexample.com/en/", "http://x.net?/es/",
            "http://x.net/es/", "a://b.net/fr/://c.com/en/", "http://İ.Com/", "http://com/", "http://example.com/x" + "y" * 100_000, "http://org/"]
    df = spark.createDataFrame([(i, u, "<p>", 1, "clash") for i, u in [*enumerate(urls), (7, urls[7]), (99, urls[7])]], SCHEMA)
    rows = url_filter.judge(df, RULES).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == len(urls) + 2 and got[99][1:] == got[7][1:]
    assert [(got[i].host, got[i].path) for i in range(4)] == [("", "")] * 4
    assert [got[i].rule for i in range(14)] == [None, None, None, None, "www.example.com/en/", None, "com/", "example.com/en/", "com/", None, "net/es/", "net/fr/", "com/", "com/"]
    assert got[4].host == "www.example.com" and got[12].host == "İ.com" and got[11].host == "b.net" and got[11].path == "/fr/:" + "//c.com/en/"
    assert got[7].verdict == "block" and got[4].verdict == "allow" and all(r.verdict in ("allow", "block") for r in rows)
    assert len(got[14].path) == 100_002
    assert url_filter.judge(df.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(pages(spark, ["http://b.org/", None]), RULES).collect()} == {"allow"}
    assert {r.verdict for r in url_filter.judge(pages(spark, ["http://b.org/", "http://a.net/es/"]), RULES).collect()} == {"block"}


def test_trees_learn_what_lexical_features_show(spark):
    """Long names with digits under one suffix are blocked by rules; the same under a suffix without rules is judged alike."""
    rng = np.random.default_rng(5)
    good = [f"http://site{i % 30}.good.com/page" for i in range(300)]
    bad = [f"http://x.bad.com/{rng.integers(10**12)}/{rng.integers(10**12)}?a={i}&b=1&c=2" for i in range(300)]
    asked = ["http://site.other.org/page", "http://x.other.org/123456789012/987654321012?a=7&b=1&c=2"]
    rows = url_filter.judge(pages(spark, good + bad + asked), [url_filter.rule("allow", "com/"), url_filter.rule("block", "bad.com/")]).orderBy("page_id").collect()
    assert [r.verdict for r in rows[-2:]] == ["allow", "block"] and [r.rule for r in rows[-2:]] == [None, None]
