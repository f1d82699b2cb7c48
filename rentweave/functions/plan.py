"""Plan shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_where(df: DataFrame, flag: Column) -> DataFrame:
    """Filter on an expensive condition that later columns share.

    A plain filter is pushed below the projection that computes its inputs, with those inputs copied into it, so
    regexes and parses would run twice or more. A flag that is formally non-deterministic stays where it is; the
    extra term is always true.
    """
    pinned = F.coalesce(flag, F.lit(False)) & (F.monotonically_increasing_id() >= 0)
    return df.withColumn("_keep", pinned).filter("_keep").drop("_keep")


def with_expressions(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Add a column for each SQL text, null in rows where it throws: division by zero, casts of bad text, missing keys and places.

    Spark settles what a failing expression does when the expression is resolved, so the session is lenient for that moment alone; the rest
    of the query keeps the session's own rules.
    """
    if not texts:
        return df
    conf, name = df.sparkSession.conf, "spark.sql.ansi.enabled"
    own = conf.get(name)
    conf.set(name, "false")
    try:
        return df.withColumns({column: F.expr(text) for column, text in texts.items()})
    finally:
        conf.set(name, own)
