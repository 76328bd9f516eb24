"""Tables in the shared folder that cut the lineage of iterative work."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, a local session gets one of its own; a cluster gets an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="terrapath-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder by Spark's file system; a session that has ended leaves it."""
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit
        pass


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, by Spark's file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, removed when the program ends."""
    path = f"{shared_dir(spark)}/terrapath-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def written(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Writes ``df`` to a fresh shared folder and reads it back: a lost executor costs a read, not the work behind it.

    A reader holds thousands of rows of a group at once; where rows are large, ``group_bytes`` bounds a group and so what a reader holds.
    """
    path = new_path(df.sparkSession, name)
    df.write.options(**({"parquet.block.size": group_bytes} if group_bytes else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _at_most(spark: SparkSession, name: str, rows: int) -> Iterator[None]:
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def arrow_batches(spark: SparkSession, rows: int) -> AbstractContextManager[None]:
    """Within it, Arrow batches of jobs hold no more than ``rows`` rows; afterwards the session is as before."""
    return _at_most(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def read_batches(spark: SparkSession, rows: int) -> AbstractContextManager[None]:
    """Within it, jobs read no more than ``rows`` rows of a Parquet file at once; afterwards the session is as before."""
    return _at_most(spark, "spark.sql.parquet.columnarReaderBatchSize", rows)
