"""Readers over landed files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentweave.functions.plan import keep_where

CORRUPT = "_corrupt_record"


def read_json(spark: SparkSession, path: str, ddl: str, multi_line: bool = True) -> DataFrame:
    """Landed JSON with an explicit schema: unknown keys are dropped, absent ones are null, and a file or line
    that does not parse keeps its text in ``_corrupt_record``.

    ``file`` and ``position`` give the arrival order inside a landing batch.
    """
    schema = T._parse_datatype_string(ddl).add(CORRUPT, T.StringType())
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return (
        reader.option("multiLine", multi_line)
        .json(path)
        .withColumn("file", F.col("_metadata.file_path"))
        .withColumn("position", F.monotonically_increasing_id())
    )


def split_malformed(rows: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected rows with the ``problem`` found (null means good)."""
    judged = rows.withColumn("problem", problem)
    # Pinned: a plain filter is copied below the parse, which then runs again for the filter and for the rows that are kept.
    return keep_where(judged, F.col("problem").isNull()).drop("problem"), keep_where(judged, F.col("problem").isNotNull())


def failure_log(rejected: DataFrame, plugin: str, occurred_at: Column, listing_id: Column | None = None) -> DataFrame:
    return rejected.select(
        F.lit(plugin).alias("plugin"),
        (listing_id if listing_id is not None else F.lit(None)).cast("string").alias("listing_id"),
        occurred_at.cast("timestamp").alias("occurred_at"),
        F.col("problem").alias("message"),
    )


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """All enabled sources as one input; columns a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
