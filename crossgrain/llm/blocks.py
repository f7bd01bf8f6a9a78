"""Sums over a table of packed blocks: what one pass of an iterative fit costs.

A block is one row that holds many records as one numpy matrix, so that a pass reads bytes and
multiplies matrices. A pass sends each task the small state of the fit (in the closure), adds up one
vector a task and sums the vectors in Spark. Blocks live in the shared folder and are read again
after a lost executor; no pass keeps anything in an executor that can't be worked out again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(matrix: np.ndarray) -> tuple[bytes, str]:
    """A matrix of integers as bytes of the narrowest type that holds it, and this type."""
    low, high = (int(matrix.min()), int(matrix.max())) if matrix.size else (0, 0)
    kind = next(k for k in ("i1", "i2", "i4", "i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return np.ascontiguousarray(matrix, dtype=kind).tobytes(), kind


def unpacked(data: bytes, kind: str, n: int) -> np.ndarray:
    m = np.frombuffer(data, dtype=kind)
    return m.reshape(n, len(m) // n if n else 0)


def total(blocks: DataFrame, of_batch: Callable[[pa.RecordBatch], np.ndarray], size: int, whole: bool = False) -> np.ndarray:
    """The sum of `of_batch` (vectors of `size`) over all Arrow batches of `blocks`; `whole` sums integers of 64 bits."""
    kind, arrow = (np.int64, pa.int64()) if whole else (np.float64, pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size, kind)
        for batch in batches:
            out += of_batch(batch)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(out[at], arrow)], names=["i", "v"])

    rows = blocks.mapInArrow(run, f"i long, v {'long' if whole else 'double'}").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size, kind)
    for r in rows:
        out[r.i] = r.v
    return out
