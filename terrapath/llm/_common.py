"""Shared helpers: where intermediate tables live, and table access by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the directory of Parquet tables ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders made so far, the latest last.
_MADE: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, removed when the program ends or by ``release``."""
    _MADE.append(shared.new_path(spark, name))
    return _MADE[-1]


def made() -> int:
    """A mark for ``release``."""
    return len(_MADE)


def release(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Removes the folders made since a mark, but for the last ``keep``."""
    end = len(_MADE) - keep
    for path in _MADE[since:end]:
        shared.remove(spark, path)
    del _MADE[since:end]


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a read of the table, not the work behind it.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int) -> None:
    """Lets Arrow batches of this session hold no more than ``rows`` rows; a smaller limit stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def row_key(docs: DataFrame, *others: str) -> Column:
    """A hash of the id, the text and ``others``, which tells rows apart where ids repeat or are null."""
    cols = [docs["doc_id"].cast("long"), *(docs[c].cast("string") for c in ("text", *others))]
    return F.xxhash64(*cols, *(c.isNull() for c in cols))  # a hash alone skips nulls


def wide_key(docs: DataFrame, *others: str) -> Column:
    """As ``row_key``, in 128 bits: the second hash has a seed of its own."""
    cols = [docs["doc_id"].cast("long"), *(docs[c].cast("string") for c in ("text", *others))]
    return F.struct(row_key(docs, *others).alias("a"), F.xxhash64(F.lit(1), *cols, *(c.isNull() for c in cols)).alias("b"))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text of ``docs``, whatever other columns it has."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
