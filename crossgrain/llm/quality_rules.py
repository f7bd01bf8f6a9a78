"""Quality rules as a short-circuit cascade.

Every text gets the base counts (words, symbols, repeated lines, repeated 3-word windows), which
decide the base rule. A text that passes it goes through a cascade of further rules and leaves at
the first one that rejects it. The order of the cascade comes from a sample, drawn by a hash of the
id: each rule's seconds per text and share of rejected texts are measured there, where the texts
are, and the rules run by rejections per second, best first. The order changes the cost only: a text
is kept if no rule rejects it, and which rule did is not told.

Edge cases: a null or empty text has no words, all counts 0, fails the base rule and is not kept;
very long texts are counted whole. Repeated rows give repeated result rows; extra columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossgrain.llm.common import cuts, draw, draw_bar, flat, parts, pick, unflat

#: ASCII white space that ends a word, and the symbols that are counted.
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"

#: Rows, in expectation, on which costs and selectivities are measured.
SAMPLE_ROWS = 2048


@dataclass
class Text:
    """One text and the counts that every rule may use."""

    text: str
    words: list[bytes]
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


def _upper_share(t: Text) -> bool:
    upper = sum(map(str.isupper, t.text))
    return 2 * upper > t.word_chars


def _repeated_neighbours(t: Text) -> bool:
    same = sum(map(bytes.__eq__, t.words, t.words[1:]))
    return 4 * same > t.n_words


def _few_letters(t: Text) -> bool:
    return 2 * sum(map(str.isalpha, t.text)) < t.word_chars


def _exclamations(t: Text) -> bool:
    return 2 * t.text.count("!") > t.n_words


RULES = (
    Rule("symbols", lambda t: 5 * t.n_symbols > t.n_words),
    Rule("word_length", lambda t: t.word_chars < 2 * t.n_words or t.word_chars > 20 * t.n_words),
    Rule("exclamations", _exclamations),
    Rule("upper_share", _upper_share),
    Rule("few_letters", _few_letters),
    Rule("repeated_neighbours", _repeated_neighbours),
    Rule("dup_lines", lambda t: 2 * t.n_dup_lines > t.text.count("\n") + 1),
)


def repeated_window_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of `width` words found twice or more in the text."""
    n = len(words)
    if n <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    base, size, key = len(seen), len(seen), ids[: n - width + 1]
    for k in range(1, width):
        if size * base > 2**62:
            key = np.unique(key, return_inverse=True)[1]
            size = int(key.max()) + 1
        key, size = key * base + ids[k : n - width + 1 + k], size * base
    order = np.argsort(key, kind="stable")
    runs = key[order]
    same = runs[1:] == runs[:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(width):
        covered[k : n - width + 1 + k] |= twice
    return int(covered.sum())


def measure(text: str | None) -> Text:
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return Text(
        text=text,
        words=words,
        n_words=len(words),
        word_chars=len(text) - sum(map(text.count, SPACES)),
        n_symbols=sum(map(text.count, SYMBOLS)),
        n_dup_lines=len(lines) - len(set(lines)),
        n_repeat_words=repeated_window_words(words),
    )


def base_failed(t: Text) -> bool:
    return t.n_words < 50 or 100 * t.n_repeat_words > 50 * t.n_words


def cascade_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules, most rejections per second of work first, as measured on about `sample_rows` texts.

    The driver gets a row of sums for each rule and task.
    """
    rows = pick(docs, "doc_id", "text")
    hashed = draw("doc_id", "rules")
    n, least = rows.agg(F.count(F.lit(1)), F.min(hashed)).first()
    drawn = rows.where(hashed <= draw_bar(sample_rows, n, least or 0)).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rejected, spent = 0, [0] * len(rules), [0.0] * len(rules)
        for batch in parts(batches, "text"):
            texts = [t for t in map(measure, batch.column("text").to_pylist()) if not base_failed(t)]
            seen += len(texts)
            for i, rule in enumerate(rules):
                began = time.perf_counter()
                rejected[i] += sum(map(rule.rejects, texts))
                spent[i] += time.perf_counter() - began
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array([seen] * len(rules), pa.int64()), pa.array(rejected, pa.int64()), pa.array(spent)], names=["rule", "seen", "rejected", "spent"])

    sums = drawn.mapInArrow(run, "rule int, seen long, rejected long, spent double").groupBy("rule").agg(F.sum("seen"), F.sum("rejected"), F.sum("spent")).collect()  # a row a rule
    gain = {i: (rejected + 0.5) / (seen + 1) / max(spent, 1e-7) for i, seen, rejected, spent in sums}
    return tuple(rules[i] for i in sorted(range(len(rules)), key=lambda i: -gain.get(i, 0.0)))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed and kept.

    `rules` are run in the order given; None measures the order on a sample first.
    """
    ordered = cascade_order(docs) if rules is None else rules

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            cols: list[list] = [[] for _ in range(7)]
            for text in batch.column("text").to_pylist():
                t = measure(text)
                failed = base_failed(t)
                kept = not failed and not any(r.rejects(t) for r in ordered)
                for col, v in zip(cols, (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, kept), strict=True):
                    col.append(v)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, cols, kinds)], names=OUT)

    return pick(docs, "doc_id", "text").mapInArrow(judge, SCHEMA)


OUT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules keep, in one pass and without a join: a filter on the text."""
    ordered = cascade_order(docs)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        out = []
        for start, length in cuts([texts]) if len(texts) else ():
            for t in map(measure, texts.slice(start, length).to_pylist()):
                out.append(not base_failed(t) and not any(r.rejects(t) for r in ordered))
        return pa.array(out, pa.bool_())

    return unflat(flat(docs, text="text").where(good("text")), docs)


#: The same counts and verdict in DuckDB's SQL.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d
), win AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i+1], ws[i+2]) AS n
  FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) > 2)
), cov AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words
  FROM win, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY rid
), nb AS (
  SELECT rid, count(*) FILTER (WHERE ws[i] = ws[i+1]) AS same
  FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 1) GROUP BY rid
), ln AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), c AS (
  SELECT w.doc_id, w.text, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(w.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(same, 0) AS same
  FROM w LEFT JOIN ln USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN nb USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
            OR 5 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 2 * (length(text) - length(replace(text, '!', ''))) > n_words
            OR 2 * (length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g'))) > word_chars
            OR 2 * (length(text) - length(regexp_replace(text, '\p{L}', '', 'g'))) < word_chars
            OR 4 * same > n_words
            OR 2 * n_dup_lines > length(text) - length(replace(text, chr(10), '')) + 1) AS kept
FROM c
"""
