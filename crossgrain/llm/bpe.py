"""Byte-level BPE on length-bucketed numpy matrices.

Distinct pieces of text are encoded together: pieces whose byte lengths share a power of two form
one padded matrix of token ids. In each round every row merges its leftmost pair of minimum rank;
ranks of pairs come from an open-addressing hash table in numpy arrays, the merged row closes up
by one column, and rows without a mergeable pair leave the matrix. Very long pieces are one row
each; there a round merges the occurrences of the minimum-rank pair from the left up to the first
that makes a pair of lower rank, which gives the same ids in fewer rounds.

Pieces of `LONG` bytes or more leave the matrices for this second form, which is exact as well: one
row of a matrix as wide as a megabyte would take as many rounds as it has merges.

A worker turns about `PART_BYTES` of text into strings at once, keeps the ids of `CACHE_PIECES`
fields and yields results part by part, so its memory doesn't grow with a batch.

Edge cases: a null text counts as empty and has no ids. Ids decode to exactly the text's bytes. Very
long texts are encoded whole. Repeated rows give repeated result rows; an empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from crossgrain.llm.common import parts, pick

#: Unicode's White_Space.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
NONE = np.int32(2**31 - 1)
#: Pieces kept with their ids in a worker, the bytes from which a piece is a matrix of its own, and a matrix's cells at most.
CACHE_PIECES, LONG, CELLS = 150_000, 512, 250_000


class PairTable:
    """Rank of a merged pair by (left id, right id): linear probing over a multiplicative hash."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(len(left) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        keys = self.key(left, right)
        slot, todo = self.slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == -1
            at = todo[free]
            self.keys[slot[at]] = keys[at]  # of several for one slot the last stays
            won = self.keys[slot[todo]] == keys[todo]
            self.ranks[slot[todo[won]]] = merged[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 24) | right.astype(np.int64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE where the pair doesn't merge; ids under 0 are padding."""
        shape, left, right = left.shape, left.ravel(), right.ravel()
        out = np.full(len(left), NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = self.key(left[todo], right[todo])
        slot = self.slot(keys)
        while len(todo):
            found = self.keys[slot]
            hit = found == keys
            out[todo[hit]] = self.ranks[slot[hit]]
            on = ~hit & (found != -1)
            todo, keys, slot = todo[on], keys[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.pattern = regex.compile(pattern.replace("\\s\\p", SPACE + "\\p").replace("\\s", f"[{SPACE}]").replace("\\S", f"[^{SPACE}]"))
        self.chunks = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.odd = re.compile(f"[{SPACE}] (?:[{SPACE}]|$)")
        size = max(ranks.values(), default=0) + 1
        self.bytes: list[bytes] = [b""] * size
        for b, r in ranks.items():
            self.bytes[r] = b
        self.first = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        triples = [(ranks[b[:i]], ranks[b[i:]], r) for b, r in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks]
        left, right, merged = (np.array(x, np.int64) for x in zip(*triples, strict=True)) if triples else (np.zeros(0, np.int64),) * 3
        self.pairs = PairTable(left, right, merged.astype(np.int32))
        self.cache: dict[str, bytes] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    # -- pieces ---------------------------------------------------------------------------------

    def merge_rows(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers; all pieces are padded to one width."""
        width = max(map(len, pieces))
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        tok = np.where(np.arange(width) < size[:, None], self.first[raw], -1)
        rank = self.pairs.rank(tok[:, :-1], tok[:, 1:])
        row, out = np.arange(len(pieces)), [None] * len(pieces)
        while len(row):
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(row), np.int64)
            best = rank[np.arange(len(row)), at] if rank.shape[1] else np.full(len(row), NONE)
            done = best == NONE
            if done.any():
                ended = tok[done]
                ids = ended >= 0
                flat, stop = ended[ids].astype("<u4").tobytes(), (4 * ids.sum(1).cumsum()).tolist()
                for i, lo, hi in zip(row[done].tolist(), [0, *stop], stop, strict=False):
                    out[i] = flat[lo:hi]
                live = ~done
                row, tok, rank, at, best = row[live], tok[live], rank[live], at[live], best[live]
                if not len(row):
                    break
            n, r = len(row), np.arange(len(row))
            tok[r, at] = best
            keep = np.ones(tok.shape, bool)
            keep[r, at + 1] = False
            tok = tok[keep].reshape(n, -1)
            keep = np.ones(rank.shape, bool)
            keep[r, at] = False
            rank = rank[keep].reshape(n, -1)
            for near in (at - 1, at):  # only the pairs on either side of the merged token are new
                i = np.flatnonzero((near >= 0) & (near < rank.shape[1]))
                if len(i):
                    rank[i, near[i]] = self.pairs.rank(tok[i, near[i]], tok[i, near[i] + 1])
        return out

    def merge_long(self, piece: bytes) -> bytes:
        tok = self.first[np.frombuffer(piece, np.uint8)]
        rank = self.pairs.rank(tok[:-1], tok[1:])
        while len(rank) and (best := rank.min()) != NONE:
            at = np.flatnonzero(rank == best)
            if len(at) > 1 and (np.diff(at) == 1).any():  # of overlapping pairs every second one, from the left
                start = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            # One after another from the left, up to the first that makes a pair of lower rank.
            new = np.full(len(at), best, np.int32)
            left = np.where(np.diff(at, prepend=-9) == 2, best, np.where(at > 0, tok[at - 1], -1))
            right = np.where(at + 2 < len(tok), tok[np.minimum(at + 2, len(tok) - 1)], -1)
            lower = np.minimum(self.pairs.rank(left, new), self.pairs.rank(new, right)) < best
            if lower.any():
                at = at[: lower.argmax() + 1]
            tok[at] = best
            tok = np.delete(tok, at + 1)
            rank = np.delete(rank, at)
            now = at - np.arange(len(at))
            near = np.unique(np.concatenate([now - 1, now]))
            near = near[(near >= 0) & (near < len(rank))]
            rank[near] = self.pairs.rank(tok[near], tok[near + 1])
        return tok.astype("<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            known = self.ranks.get(p)
            if known is not None:
                out[i] = known.to_bytes(4, "little")
            elif len(p) >= LONG:
                out[i] = self.merge_long(p)
            else:
                buckets.setdefault(len(p).bit_length(), []).append(i)
        for bits, at in buckets.items():
            rows = max(1, CELLS >> bits)
            for lo in range(0, len(at), rows):
                part = at[lo : lo + rows]
                for i, ids in zip(part, self.merge_rows([pieces[j] for j in part]), strict=True):
                    out[i] = ids
        return out

    # -- texts ----------------------------------------------------------------------------------

    def fields(self, text: str) -> list[str]:
        """The text cut where no match of the pattern can cross: a space starts each field but the first."""
        if self.odd.search(text) or "  " in text:
            return self.chunks.findall(text)
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + x for x in rest]

    def learn(self, fields: Iterable[str]) -> None:
        """Put the ids of these fields into the cache, as little-endian 32-bit integers."""
        cut = {f: [p.encode() for p in self.pattern.findall(f)] for f in fields}
        pieces = list({p for ps in cut.values() for p in ps})
        ids = dict(zip(pieces, self.encode_pieces(pieces), strict=True))
        for f, ps in cut.items():
            self.cache[f] = b"".join(map(ids.__getitem__, ps))

    def encode_batch(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        group, chars = [], 0
        for text in texts:
            group.append(text or "")
            chars += len(group[-1])
            if chars > 500_000:
                yield from self._encode_group(group)
                group, chars = [], 0
        yield from self._encode_group(group)

    def _encode_group(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        cut = [self.fields(t) for t in texts]
        missing = {f for fs in cut for f in fs if f not in self.cache}
        if missing:
            self.learn(missing)
        get = self.cache.__getitem__
        for fs in cut:
            yield b"".join(map(get, fs))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def tokenizer(path: str, pattern: str) -> ByteBpe:
    """One tokenizer for each worker process."""
    key = (path, pattern)
    if key not in _LOADED:
        _LOADED[key] = ByteBpe.from_file(path, pattern)
    return _LOADED[key]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def ship(docs: DataFrame, path: str) -> str:
    """Send the vocabulary file to all executors; the name that workers find it by."""
    docs.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>, n_tokens of every text."""
    name = ship(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(SparkFiles.get(name), pattern)
        for batch in parts(batches, "text"):
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in tok.encode_batch(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64())], names=["doc_id", "ids", "n_tokens"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; bytes that aren't UTF-8 become U+FFFD; null ids: empty."""
    name = ship(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(SparkFiles.get(name), pattern)
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            texts = [tok.decode(np.array(x or [], "<u4").tobytes()).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return pick(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode every text, decode the ids, and give both sides' digests: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Whole texts cross to Python once; the ids stay in the worker that made them unless they are
    asked for as a further column.
    """
    name = ship(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(SparkFiles.get(name), pattern)
        for batch in parts(batches, "text"):
            n, ids_sha, text_sha, kept = [], [], [], []
            for ids in tok.encode_batch(batch.column(1).to_pylist()):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(tok.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(np.frombuffer(ids, "<u4").astype(np.int32))
            cols = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
            cols |= {"ids": pa.array(kept, pa.list_(pa.int32()))} if with_ids else {}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return pick(docs, "doc_id", "text").mapInArrow(run, schema)
