"""From raw documents to token ids: quality rules, near duplicates, decontamination, secrets, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
``documents``, whatever other columns there are. Between stages the rows are written as Parquet in the shared folder
and read again. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapath.llm import byte_bpe, decontam, jaccard, quality, secret_scan
from terrapath.llm._common import made, materialize, release, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only the documents that the base rules and the adaptive cutoffs keep.

    A null or empty text goes. Rows of null or repeated ids are judged each, and equal rows fare alike.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies: the one with the smallest id.

    Of several texts of that id one stays, and of equal rows one; a null id stays only where the group has no other.
    Texts without words have no copies, so all of them stay.
    """
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item; a null text holds none. Rows of one id are told apart by their texts."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked and ``n_chars`` brought up to date; a null text stays null."""
    return secret_scan.mask_secrets(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every row; ids are little-endian 32-bit numbers. A null text has none."""
    return byte_bpe.encode(docs).select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scans", secrets),
    ("token ids", token_ids),
]

#: The last stage encodes with a rank file, which SQL has no access to; the tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the table ``documents``."""
    docs, mark = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, mark)  # what the stage and the one before it wrote, but for these rows
    return STAGES[-1][1](spark, docs, sf_dir)
