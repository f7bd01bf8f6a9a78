"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar, Token

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the checkpoint folder already set; a local session gets one of its own."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="crossgrain-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch while a table is written; Spark's own setting, restored afterwards.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def materialize(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: a lost executor costs one reread.

    Arrow batches to and from Python are kept small meanwhile, as an executor holds one for each task on both sides.
    """
    spark = df.sparkSession
    path, before = new_path(spark, label), spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_SETTING, before)
    table = spark.read.schema(df.schema).parquet(path)
    if (own := _open.get()) is not None:
        own.tables.append((table, path))
    return table


class Temporary:
    """Tables that `materialize` writes inside a with block go when it ends, but for those that are kept.

    Kept are the tables that a returned frame still reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self.kept = spark, [], []

    def keep(self, *tables: DataFrame) -> None:
        self.kept += tables

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables of this block now; others are left alone."""
        for table, path in [x for x in self.tables if any(x[0] is t for t in tables)]:
            self.tables = [x for x in self.tables if x[0] is not table]
            self._delete(path)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def __enter__(self) -> Temporary:
        self.outer: Token = _open.set(self)
        return self

    def __exit__(self, *_: object) -> None:
        _open.reset(self.outer)
        outer = _open.get()
        for table, path in self.tables:
            if any(table is k for k in self.kept):
                if outer is not None:
                    outer.tables.append((table, path))
                continue
            self._delete(path)


_open: ContextVar[Temporary | None] = ContextVar("open", default=None)
