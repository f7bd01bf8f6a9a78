"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossgrain.sources.scratch import Temporary, materialize, new_path

__all__ = ["Temporary", "cuts", "draw", "draw_bar", "flat", "held_out", "materialize", "new_path", "parts", "pick", "table", "unflat"]

#: Rows of one crc32 remainder are held out from every fit.
HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 4, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, found by exact name.

    Other columns never matter, even where one has the same name but for case (Spark would call
    the plain reference ambiguous).
    """
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_{df.columns.index(n)}").alias(n) for n in names])


def flat(df: DataFrame, **names: str) -> DataFrame:
    """`df` with its columns renamed _0, _1, ..., and copies of some under the names given (name=column).

    toDF(*df.columns) gives the columns their names back, whatever these are.
    """
    numbered = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return numbered.select("*", *[F.col(f"_{df.columns.index(c)}").alias(n) for n, c in names.items()])


def unflat(numbered: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like`, named as there, from a frame made by flat(like)."""
    return numbered.select(*[f"_{i}" for i in range(len(like.columns))]).toDF(*like.columns)


#: Bytes of text that a worker turns into Python's strings at once; a longer text comes alone.
PART_BYTES = 2 << 20


def cuts(texts: Iterable[pa.Array], most: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """Start and length of neighbouring rows whose texts hold about `most` bytes together, one row at least."""
    size = sum(np.nan_to_num(pc.binary_length(t).to_numpy(zero_copy_only=False).astype(float)) for t in texts)
    at = (np.cumsum(size) // most).astype(np.int64)
    start = np.flatnonzero(np.diff(at, prepend=-1))
    return zip(start.tolist(), np.diff(start, append=len(at)).tolist(), strict=True)


def parts(batches: Iterator[pa.RecordBatch], *texts: str, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut by `cuts`, so that what a worker holds doesn't depend on a batch's bytes; freed memory goes back."""
    for batch in batches:
        for start, length in cuts([batch.column(c) for c in texts], most) if batch.num_rows else ():
            yield batch.slice(start, length)
        pa.default_memory_pool().release_unused()


def held_out(doc_id: Column | str) -> Column:
    """True for the rows that no classifier may learn from; a null id is not held out."""
    key = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % HELD_OUT_MODULUS == HELD_OUT_REMAINDER


def draw(key: str, salt: str) -> Column:
    """A number from 0 to 2^63 - 1 that depends on the key and the salt only."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(salt)), 1)


def draw_bar(most: int, n: int, least: int) -> int:
    """Rows with a `draw` up to this number are about `most` of `n` rows, all if there are no more.

    least: the least draw of the rows. It is always in, so a sample of rows is never empty, however many there are.
    """
    return max(least, min(2**63 - 1, most * 2**63 // max(1, n)))
