"""What several operators share: reading tables, staging, and the word rule."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentweave.session import checkpoint_root

#: What a word is made of once A-Z are lower-cased: digits, a-z and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Rows of whole texts in one Arrow batch; Spark's default of 10,000 suits short rows only."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared checkpoint folder and read it back: lineage ends there, and a lost executor
    costs a re-read of files, not a recomputation."""
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone. A text of one byte per character goes the fast way; both ways give the same result there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a staged table if it was counted to have at most so many rows; beyond that the join shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def hex_digest(text: Column) -> Column:
    return F.sha2(text, 256)
