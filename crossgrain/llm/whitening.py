"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

X holds one centred row a vector. From a unit vector v_1 the process alternates two products,

    u_k = (X v_k - b_{k-1} u_{k-1}) / a_k        v_{k+1} = (X' u_k - a_k v_k) / b_k,

each followed by full reorthogonalisation against all vectors of its side, until X = U B V' with an
upper bidiagonal B (a on the diagonal, b beside it) as small as a vector is long. The singular values
of B over sqrt(n) are the deviations, its right singular vectors turn V into the components. X is
never multiplied with itself, so small deviations keep their digits.

The left vectors have as many entries as there are rows. They are never stored: u_k = X w_k, where w_k
has a vector's length, so a task makes its part of u_k from its own rows and the driver holds vectors
of a vector's length only. A pass over the rows makes u = X w and X' u together; as U'u = W'(X'u), it
gives the reorthogonalisation of both sides too. A pass is repeated where much had to be taken away
("twice is enough"). When a space is exhausted (b_k or a_k is 0, as with repeated or zero deviations)
the process starts anew orthogonally to all it has, until X is used up: what is left of the sum of
squares, which B must hold in full, tells.

Vectors are packed once into blocks of integers in the shared folder; every pass reads those. Centring
is exact: n * x - S in whole numbers, divided by n in doubles.

Edge cases: vectors that are null or hold a null or non-finite entry are dropped; a shorter vector ends
in zeros; rows without id stay (null id), rows that share an id or are equal are rows of their own; a
component whose variance is under `LEAST` of all variance can't be told from none and isn't returned,
so one row, equal rows or an empty table give an empty result; ties between variances leave the
components of the tied space to rounding, but for their span; extra columns are ignored, whatever their
names; entries beyond 2^40, or so many rows that n * x doesn't fit 64 bits, raise OverflowError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossgrain.llm.blocks import packed, total, unpacked
from crossgrain.llm.common import Temporary, materialize, pick

#: Rows of a block, and rows of the result that a task makes at once.
BLOCK_ROWS, OUT_ROWS = 1024, 256
#: Bits of the entries by the type that holds them.
BITS = {"i1": 8, "i2": 16, "i4": 32, "i8": 41}
#: Least share of all variance that counts as a component's; share of the sum of squares that counts as nothing left.
LEAST, NOTHING = 1e-12, 1e-14
#: Relative size from which a vector counts as 0, and from which what was taken away calls for a second pass.
ZERO, SECOND = 1e-14, 1e-9


@dataclass
class Whitening:
    """Fitted on n rows: sums of x by dimension, components (a column each), variances, variance in all."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ (self.components / np.sqrt(self.variances))


def differences(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S in whole numbers; x may lack the last dimensions, which are 0 then."""
    return np.pad(x.astype(np.int64), ((0, 0), (0, len(sums) - x.shape[1]))) * n - sums


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return differences(x, n, sums) / n


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Sum of squares of n * x - S a row, exact whatever its size (Python's integers where 64 bits are too few)."""
    y = differences(x, n, sums)
    if float(np.abs(y.astype(float)).max(initial=0)) ** 2 * max(1, len(sums)) < 2**62:
        return (y * y).sum(1)
    return (y.astype(object) ** 2).sum(1)


def integer_blocks(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_ids, n, kind and data: floor(scale * c) of the vectors that take part, `BLOCK_ROWS` a row."""
    c = F.col("embedding")
    whole = c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    rows = pick(vectors, "vec_id", "embedding").where(F.coalesce(whole, F.lit(False))).select("vec_id", F.transform(c, lambda v: v.cast("double")).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                size = part.column(1).value_lengths().to_numpy(zero_copy_only=False)
                c = np.zeros((len(size), int(size.max(initial=0))))
                c[np.arange(c.shape[1]) < size[:, None]] = part.column(1).flatten().to_numpy(zero_copy_only=False)
                x = np.floor(scale * c)
                if np.abs(x).max(initial=0) > 2.0**40:
                    raise OverflowError("an entry is too large to be held exactly")
                data, kind = packed(x.astype(np.int64))
                arrays = [pa.array([part.column(0)], pa.list_(pa.int64())), pa.array([len(size)], pa.int64()), pa.array([c.shape[1]], pa.int64()), pa.array([kind]), pa.array([data], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["vec_ids", "n", "width", "kind", "data"])

    return rows.mapInArrow(run, "vec_ids array<long>, n long, width long, kind string, data binary")


def matrices(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The integer matrices of a batch of blocks."""
    columns = (batch.column(c).to_pylist() for c in ("data", "kind", "n", "width"))
    for data, kind, n, width in zip(*columns, strict=True):
        yield unpacked(data, kind, n).reshape(n, width)


class Bidiagonal:
    """The process on rows that only a pass (w -> X w's sum of squares and X' X w) can reach."""

    def __init__(self, product, width: int, squares: float):
        self.product, self.width, self.squares = product, width, squares
        self.v, self.w, self.t = (np.zeros((width, 0)) for _ in range(3))  # t = X' u
        self.a, self.b = [], []
        self.rng = np.random.default_rng(7)

    def against(self, x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - self.v @ (self.v.T @ x)
        return x

    def start(self) -> np.ndarray:
        x = self.against(self.rng.standard_normal(self.width))
        return x / np.linalg.norm(x)

    def left(self, w: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """w, a and X'u of the next left vector u = X w / a, orthogonal to all before it; a is 0 if there is none."""
        size = np.sqrt(self.squares)
        for _ in range(3):
            square, g = self.product(w)
            c = self.w.T @ g
            taken = float(c @ c)
            w, g, square = w - self.w @ c, g - self.t @ c, max(0.0, square - taken)
            if np.sqrt(square) <= ZERO * size:
                return np.zeros_like(w), 0.0, np.zeros_like(g)
            if taken <= SECOND**2 * square:
                break
        a = np.sqrt(square)
        return w / a, a, g / a

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """Right singular vectors, a column each, and singular values of X, largest first."""
        v, before = self.start(), None  # before: b and w of the step before, unless the process starts anew
        while True:
            w, a, t = self.left(v if before is None else v - before[0] * before[1])
            self.v = np.column_stack([self.v, v])
            self.w, self.t = np.column_stack([self.w, w]), np.column_stack([self.t, t])
            self.a.append(a)
            held = float(np.dot(self.a, self.a) + np.dot(self.b, self.b))
            if len(self.a) == self.width:
                break
            x = self.against(t - a * v)
            b = float(np.linalg.norm(x))
            if a and b > ZERO * np.sqrt(self.squares):
                v, before = x / b, (b, w)
                self.b.append(b)
            elif self.squares - held > NOTHING * self.squares:
                v, before = self.start(), None
                self.b.append(0.0)
            else:
                break
        _, s, right = np.linalg.svd(np.diag(self.a) + np.diag(self.b, 1))
        return self.v @ right.T, s


def fit(blocks: DataFrame, components: int) -> Whitening | None:
    """None if no variance is left to whiten."""
    n, width, kind = blocks.agg(F.sum("n"), F.max("width"), F.max("kind")).first()
    if not n or not width:
        return None
    if n * 2.0 ** (1 + BITS[kind]) > 2.0**63:
        raise OverflowError("too many rows with entries of this size")

    def sums_of(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(width, np.int64)
        for x in matrices(batch):
            out[: x.shape[1]] += x.sum(0, dtype=np.int64)
        return out

    sums = total(blocks, sums_of, width, whole=True)
    squares = float(total(blocks, lambda batch: np.array([sum(float((centred(x, n, sums) ** 2).sum()) for x in matrices(batch))]), 1)[0])
    if not squares:
        return None

    def product(w: np.ndarray) -> tuple[float, np.ndarray]:
        def of_batch(batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros(width + 1)
            for x in matrices(batch):
                rows = centred(x, n, sums)
                u = rows @ w
                out[:-1] += u @ rows
                out[-1] += u @ u
            return out

        found = total(blocks, of_batch, width + 1)
        return float(found[-1]), found[:-1]

    right, singular = Bidiagonal(product, width, squares).run()
    variances = singular**2 / n
    kept = min(components, int((variances > LEAST * squares / n).sum()))
    fitted = Whitening(n, sums, right[:, :kept], variances[:kept], squares / n, 0.0)

    def covariance_of(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((kept + 1, kept))
        for x in matrices(batch):
            z = fitted.whitened(x)
            out[:-1] += z.T @ z
            out[-1] += z.sum(0)
        return out.ravel()

    found = total(blocks, covariance_of, (kept + 1) * kept).reshape(kept + 1, kept) / n
    fitted.identity_error = float(np.abs(found[:-1] - np.outer(found[-1], found[-1]) - np.eye(kept)).max())
    return fitted


SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 32, scale: int = 64) -> DataFrame:
    """A row for each vector and component: its whitened coordinate, and what the fit says of both.

    deviation: sum over dimensions of (n * x - S)^2, exact; explained: the component's share of all variance.
    """
    spark = vectors.sparkSession
    with Temporary(spark) as temporary:
        blocks = materialize(integer_blocks(vectors, scale), "blocks")
        temporary.keep(blocks)
        held = blocks.drop("vec_ids").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            fitted = fit(held, components)
        finally:
            held.unpersist()
    if fitted is None:
        return spark.createDataFrame([], SCHEMA)
    shares, kept = fitted.variances / fitted.trace, len(fitted.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, block in zip(batch.column("vec_ids"), matrices(batch), strict=True):
                for start in range(0, len(block), OUT_ROWS):
                    x = block[start : start + OUT_ROWS]
                    m = len(x)
                    own = np.repeat(np.arange(m), kept)
                    deviation = pa.array(deviations(x, fitted.n, fitted.sums).tolist(), pa.decimal128(38, 0))
                    arrays = [
                        ids.values.slice(start, m).take(pa.array(own)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)), pa.array(np.full(m * kept, fitted.n)), deviation.take(pa.array(own)),
                        pa.array(fitted.whitened(x).ravel()), pa.array(np.tile(shares, m)), pa.array(np.full(m * kept, fitted.identity_error)),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return blocks.mapInArrow(run, SCHEMA)
