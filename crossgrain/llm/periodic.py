"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q, at least `LEAST` words and three periods long, that
no neighbouring word extends. Texts of a part are laid one after another, each closed by a word of its
own, so no repeat crosses a text's end. The steps, each over all texts of the part at once:

1. Names: two windows of 2^k words have one name exactly if they are equal. Names come by doubling;
   only windows whose name isn't unique yet are sorted again. The last sort is the suffix array, a name
   is the first place of its windows there, so the windows of a name are an interval of the array.
2. Dyadic blocks: for each B = 2^k the text is cut into blocks of B words. A run of period q with
   B <= q < 2B has a block within its first 2B words, and this block occurs again q words on. (Periods
   under the smallest block are found by the smallest blocks, in a window of their own.)
3. Range successor: a wavelet matrix over the part of the suffix array whose windows repeat gives the
   first occurrences of a block in the window of neighbouring starts, for all blocks of a level at once.
4. Progressions: one or two occurrences give candidate periods as their distances. Three or more form
   a progression, whose difference p is the block's own period; then the stretches of period p around
   the block and around its occurrence are found, and if they differ, the distances of their left and of
   their right ends are the candidates: a period q must carry a break of p onto the next one.
5. A candidate is extended to both sides as far as its period holds, by names from long to short.
   What is long enough is a run; of the periods of one stretch the least counts.

Edge cases: a null text has no words; texts under `LEAST` words have no run; very long texts are
processed whole (memory grows with words times levels, and a level goes only as far as windows
repeat); rows with one id, or equal texts, have results of their own; a row without id isn't turned
into a planted repeat; runs may overlap, ties between exponents go to the smaller start, then period;
an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossgrain.llm.common import parts, pick

#: Least words of a run, least periods of a run, exponent of the smallest block: 2^SMALLEST <= LEAST / 3.
LEAST, PERIODS, SMALLEST = 24, 3, 3
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


#: Arrow type of the runs of a text.
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Names:
    """Names of the windows of 2^k words, level by level, and the suffix array."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        order = np.argsort(words, kind="stable")
        name = np.empty(n, np.int32)
        new = np.ones(n, bool)
        new[1:] = words[order[1:]] != words[order[:-1]]
        name[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        self.levels = [name]
        while True:
            name = self.levels[-1]
            size = np.bincount(name, minlength=n)
            live = np.flatnonzero(size[name] > 1)
            if not len(live):
                break
            # A window that would pass the end holds the last text's own word, so it is unique by now.
            width = 1 << (len(self.levels) - 1)
            key = name[live].astype(np.int64) * (n + 1) + name[live + width]
            by = np.argsort(key, kind="stable")
            key, first = key[by], name[live[by]]
            new, old = np.ones(len(by), bool), np.ones(len(by), bool)
            new[1:], old[1:] = key[1:] != key[:-1], first[1:] != first[:-1]
            at = np.arange(len(by))
            start = np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(old, at, 0))
            name = name.copy()
            name[live[by]] = first + start
            self.levels.append(name)
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[name] = np.arange(n)

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the texts from a on and from b on have in common; a and b aren't equal."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            name, at = self.levels[k], np.arange(len(a))
            while len(at):  # the longest windows may fit more than once
                at = at[np.maximum(a[at], b[at]) < len(name)]
                at = at[name[a[at]] == name[b[at]]]
                for x in (a, b, out):
                    x[at] += 1 << k
                if k < len(self.levels) - 1:
                    break
        return out

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the texts before a and before b have in common; a < b."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            name, width, at = self.levels[k], 1 << k, np.arange(len(a))
            while len(at):
                at = at[a[at] >= width]
                at = at[name[a[at] - width] == name[b[at] - width]]
                a[at] -= width
                b[at] -= width
                out[at] += width
                if k < len(self.levels) - 1:
                    break
        return out


class Bits:
    """Zeros before each place of a row of bits, in one and a half bits of memory a bit."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.ones = np.concatenate([[0], np.bitwise_count(self.words).cumsum(dtype=np.int64)[:-1]])
        self.zeros = len(bits) - int(bits.sum())

    def zeros_before(self, i: np.ndarray) -> np.ndarray:
        word, low = i >> 6, (i & 63).astype(np.uint64)
        return i - self.ones[word] - np.bitwise_count(self.words[word] & ((np.uint64(1) << low) - np.uint64(1)))


class Wavelet:
    """Wavelet matrix of a row of numbers: range successors of many ranges at once."""

    def __init__(self, values: np.ndarray):
        self.n_bits, self.levels = max(1, int(values.max(initial=0)).bit_length()), []
        for k in range(self.n_bits - 1, -1, -1):
            bit = (values >> k) & 1
            self.levels.append(Bits(bit))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many numbers of each range [low, high) are less than x."""
        out, every = np.zeros(len(low), np.int64), high - low
        for k, bits in zip(range(self.n_bits - 1, -1, -1), self.levels, strict=True):
            one = ((x >> k) & 1).astype(bool)
            zl, zh = bits.zeros_before(low), bits.zeros_before(high)
            out += np.where(one, zh - zl, 0)
            low, high = np.where(one, low - zl + bits.zeros, zl), np.where(one, high - zh + bits.zeros, zh)
        return np.where(x >> self.n_bits > 0, every, out)

    def smallest(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The number of each range with `rank` smaller ones in it."""
        out = np.zeros(len(low), np.int64)
        for k, bits in zip(range(self.n_bits - 1, -1, -1), self.levels, strict=True):
            zl, zh = bits.zeros_before(low), bits.zeros_before(high)
            one = rank >= zh - zl
            rank = np.where(one, rank - (zh - zl), rank)
            out += one.astype(np.int64) << k
            low, high = np.where(one, low - zl + bits.zeros, zl), np.where(one, high - zh + bits.zeros, zh)
        return out

    def successors(self, low: np.ndarray, high: np.ndarray, x: np.ndarray, count: int, none: int) -> list[np.ndarray]:
        """The `count` least numbers from x on in each range, `none` where there are fewer."""
        rank, out = self.below(low, high, x), []
        for c in range(count):
            has = np.flatnonzero(rank + c < high - low)
            found = np.full(len(low), none, np.int64)
            found[has] = self.smallest(low[has], high[has], rank[has] + c)
            out.append(found)
        return out


def all_runs(words: np.ndarray, end: np.ndarray, longest: int) -> np.ndarray:
    """start, end (exclusive) and period of every run, by start and period.

    words: numbers of the words of all texts, a number of its own after each text; end: for each word
    the place of that number; longest: words of the longest text.
    """
    names = Names(words)
    n, none = len(words), 2 * len(words)
    if len(names.levels) <= SMALLEST or longest < LEAST:
        return np.zeros((0, 3), np.int64)
    # Only windows of the smallest block's width that occur twice can start a block that recurs.
    name = names.levels[SMALLEST]
    repeated = np.bincount(name, minlength=n)[name[names.suffixes]] > 1
    place = np.concatenate([[0], repeated.cumsum()])  # of the suffix array in the part that is kept
    if not repeated.any():
        return np.zeros((0, 3), np.int64)
    wavelet = Wavelet(names.suffixes[repeated])
    found = []
    for k in range(SMALLEST, len(names.levels)):
        width = 1 << k
        if PERIODS * width > max(longest, LEAST):
            break
        name = names.levels[k]
        size = np.bincount(name, minlength=n)
        i = np.arange(0, n, width)
        i = i[(i + width <= end[i]) & (size[name[i]] > 1)]
        low, high = place[name[i]], place[name[i] + size[name[i]]]
        if k == SMALLEST:  # periods under the smallest block: the first occurrence that overlaps it
            first = wavelet.successors(low, high, i + 1, 1, none)[0]
            near = first < i + width
            found.append(candidates(names, i[near], first[near] - i[near]))
        first, second, third = wavelet.successors(low, high, i + width, 3, none)
        stop = i + 2 * width
        few = third >= stop
        for at in (first, second):
            on = few & (at < stop)
            found.append(candidates(names, i[on], at[on] - i[on]))
        many = ~few
        i, first, p = i[many], first[many], (second - first)[many]
        # The stretches of period p around the block and around its occurrence.
        a, b = (x - names.left(x, x + p) for x in (i, first))
        c, d = (x + p + names.right(x, x + p) for x in (i, first))
        other = a != b
        for q in (b - a, d - c):
            on = other & (q >= width) & (q < 2 * width) & (i + q + width <= end[i])
            found.append(candidates(names, i[on], q[on]))
    runs = np.concatenate(found)
    # By start, end and period; of the periods of a stretch the least counts.
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def candidates(names: Names, i: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The stretches of period q around place i that are long enough, as start, end and period."""
    on = q > 0
    i, q = i[on], q[on]
    start, stop = i - names.left(i, i + q), i + q + names.right(i, i + q)
    on = stop - start >= np.maximum(LEAST, PERIODS * q)
    return np.stack([start[on], stop[on], q[on]], 1)


def runs_of(texts: Sequence[Sequence[str]]) -> list[np.ndarray]:
    """start, end and period of the runs of each list of words; equal lists are worked out once."""
    known: dict[tuple[str, ...], int] = {}
    which = [known.setdefault(tuple(t), len(known)) for t in texts]
    lists = list(known)
    numbers: dict[str, int] = {}
    size = np.array([len(t) for t in lists], np.int64)
    words = np.empty(int(size.sum()) + len(lists), np.int64)
    closes = (size + 1).cumsum() - 1
    inside = np.ones(len(words), bool)
    inside[closes] = False
    words[inside] = np.fromiter((numbers.setdefault(w, len(numbers)) for t in lists for w in t), np.int64, int(size.sum()))
    words[closes] = len(numbers) + np.arange(len(lists))
    starts = closes - size
    runs = all_runs(words, np.repeat(closes, size + 1), int(size.max(initial=0))) if len(lists) else np.zeros((0, 3), np.int64)
    cut = np.searchsorted(runs[:, 0], np.concatenate([starts, [len(words)]]))
    own = [runs[a:b] - [s, s, 0] for a, b, s in zip(cut, cut[1:], starts, strict=False)]
    return [own[i] for i in which]


def collapsed(words: Sequence[str], runs: np.ndarray) -> list[str]:
    """The words that no run contains after its first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 1], -1)
    return [w for w, d in zip(words, drop.cumsum().tolist(), strict=False) if not d]


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    """Of one text in ten by its id, the words from a place on repeat: fixed by the contract of the query."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * (-(-(n - a) // len(cycle))))[: n - a]


def periodic_runs(docs: DataFrame, change: Callable[[int | None, list[str]], list[str]] | None = None) -> DataFrame:
    """doc_id, runs and words left of every row of `docs`; `change` (id, words) may replace a text's words before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            ids = batch.column("doc_id").to_pylist()
            words = [WORDS.findall(t or "") for t in batch.column("text").to_pylist()]
            if change is not None:
                words = [change(i, w) for i, w in zip(ids, words, strict=True)]
            runs = runs_of(words)
            of_run = [[{"start": s, "length": e - s, "period": q} for s, e, q in r.tolist()] for r in runs]
            left = [" ".join(collapsed(w, r)) for w, r in zip(words, runs, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(of_run, _RUNS), pa.array(left, pa.large_string()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """The columns of the query from those of `periodic_runs`."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # Runs stand by start and period, so the first of equal exponents is the one wanted.
    longer = lambda r, top: r["length"] * top["period"] > top["length"] * r["period"]
    top = F.aggregate("runs", none, lambda top, r: F.when(top.isNull() | longer(r, top), r).otherwise(top))
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    counted = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return counted.select("doc_id", "n_runs", "top.*", F.expr("1000 * top.length div top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
