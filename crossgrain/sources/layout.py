"""Tables that many computations read, written once with a physical layout.

A stored table is bucketed by stock: windows over a stock and joins on it need no exchange, neither do
aggregates by (stock, date). Within a bucket rows are sorted by date, so a range of dates skips row
groups. It is an external table in the shared folder, made on first use in a session and again
whenever the files that it comes from have changed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from crossgrain.sources.scratch import new_path

#: Bytes of the files that a table comes from that make a bucket: what a task holds doesn't grow with the tables.
BUCKET_BYTES = 2 << 20
#: application -> (label, files) -> table; what another session wrote isn't known here.
_stored: dict[str, dict[tuple, str]] = {}


def files_of(spark: SparkSession, paths: Sequence[str]) -> tuple:
    """path, length and time of the files under the paths: they change if the data does."""
    found = []
    for p in paths:
        root = spark._jvm.org.apache.hadoop.fs.Path(p)
        listed = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
        while listed.hasNext():
            s = listed.next()
            found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return tuple(sorted(found))


def parts(spark: SparkSession, paths: Sequence[str]) -> int:
    """Buckets of a table that comes from the files under the paths, and parts of a shuffle of its rows."""
    return max(1, -(-sum(length for _, length, _ in files_of(spark, paths)) // BUCKET_BYTES))


def stored(spark: SparkSession, label: str, paths: Sequence[str], build: Callable[[], DataFrame], bucket: str = "stock_code", sort: str = "date") -> DataFrame:
    """The table that `build` gives, which reads `paths` only: built and written on first use.

    What `build` gives is shuffled unless it has `parts` partitions by `bucket` already.
    """
    own = _stored.setdefault(spark.sparkContext.applicationId, {})
    key = (label, files_of(spark, paths))
    if key not in own or not spark.catalog.tableExists(own[key]):
        name, n = f"{label}_{uuid.uuid4().hex}", parts(spark, paths)
        # The repartition and the buckets have one hash, so a bucket is one file.
        build().repartition(n, bucket).write.bucketBy(n, bucket).sortBy(sort).option("path", new_path(spark, label)).saveAsTable(name)
        own[key] = name
    return spark.table(own[key])


def laid_by(df: DataFrame, label: str, column: str, n: int) -> DataFrame:
    """`df` written once in `n` buckets of a column: aggregates and windows by it and more columns need no exchange.

    Rows that have `n` partitions by the column already aren't shuffled. `forget` drops the table.
    """
    return df.sparkSession.table(_lay(df, label, column, n))


@contextmanager
def laid(df: DataFrame, label: str, column: str, n: int) -> Iterator[DataFrame]:
    """`laid_by` for a with block: the table goes when it ends."""
    spark = df.sparkSession
    name = _lay(df, label, column, n)
    try:
        yield spark.table(name)
    finally:
        if _stored.get(spark.sparkContext.applicationId, {}).pop((name,), None):
            _drop(spark, name)


def _lay(df: DataFrame, label: str, column: str, n: int) -> str:
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    df.repartition(n, column).write.bucketBy(n, column).option("path", new_path(spark, label)).saveAsTable(name)
    _stored.setdefault(spark.sparkContext.applicationId, {})[(name,)] = name
    return name


def forget(spark: SparkSession) -> None:
    """Drops the session's stored tables and their files."""
    for name in _stored.pop(spark.sparkContext.applicationId, {}).values():
        _drop(spark, name)


def _drop(spark: SparkSession, name: str) -> None:
    location = next(r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect() if r.col_name == "Location")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    at = spark._jvm.org.apache.hadoop.fs.Path(location)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
