"""Bulk fold of rows kept per source into one row per key, and the tables that point at them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentweave.operators.merge import merge_listings


def collapse_listings(legacy: DataFrame, tie_break: Sequence[str] = ("id",)) -> DataFrame:
    """Fold legacy listings (own ``id``, ``canonical_key`` and ``source_priority``) by falling age.

    Each legacy id is kept under its source in ``external_ids``.
    """
    ids = F.coalesce("enriched.external_ids", F.create_map().cast("MAP<STRING, STRING>"))
    others = F.map_filter(ids, lambda k, _: k != F.col("source"))
    own = F.map_concat(others, F.create_map("source", "id"))
    rows = legacy.withColumns(
        {
            "enriched": F.col("enriched").withField("external_ids", own),
            "seen_on_sources": F.array("source"),
        }
    )
    return merge_listings(rows, ["first_seen_at", *tie_break])


def id_map(legacy: DataFrame) -> DataFrame:
    return legacy.select(F.col("id").alias("listing_id"), F.col("canonical_key").alias("new_id"))


def repoint_scores(scores: DataFrame, ids: DataFrame, order: Sequence[str]) -> DataFrame:
    """Scores under the canonical key; orphans go, and the first row of each (key, time) stays."""
    moved = scores.join(ids, "listing_id").withColumn("listing_id", F.col("new_id")).drop("new_id")
    rest = [c for c in moved.columns if c not in ("listing_id", "scored_at")]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return moved.groupBy("listing_id", "scored_at").agg(first).select("listing_id", "scored_at", "_first.*")


def repoint_notifications(notifications: DataFrame, ids: DataFrame) -> DataFrame:
    return notifications.join(ids, "listing_id").withColumn("listing_id", F.col("new_id")).drop("new_id")


def repoint_failures(failures: DataFrame, ids: DataFrame) -> DataFrame:
    """Failures keep their row; an unknown listing becomes null."""
    return failures.join(ids, "listing_id", "left").withColumn("listing_id", F.col("new_id")).drop("new_id")
