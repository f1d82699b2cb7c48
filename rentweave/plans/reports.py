"""Read side: listings with scores, agency statistics, table counts, exports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentweave.functions.dates import dmy


def latest_score(scores: DataFrame) -> DataFrame:
    """Newest score per listing; of several at one instant, the highest."""
    return scores.groupBy("listing_id").agg(
        F.max(F.struct("scored_at", "final")).alias("s")
    ).select("listing_id", "s.final", "s.scored_at")


def list_listings(
    listings: DataFrame,
    scores: DataFrame,
    limit: int = 20,
    source: str | None = None,
    min_score: int | None = None,
    since: Column | None = None,
) -> DataFrame:
    """Newest listings with their latest score. A minimum score drops unscored listings."""
    if source is not None:
        listings = listings.filter(F.col("source") == source)
    if since is not None:
        listings = listings.filter(F.col("first_seen_at") >= since)
    latest = latest_score(scores).select(F.col("listing_id").alias("canonical_key"), "final")
    joined = listings.join(latest, "canonical_key", "left")
    if min_score is not None:
        joined = joined.filter(F.col("final") >= min_score)
    return joined.orderBy(F.col("first_seen_at").desc(), "canonical_key").limit(limit)


def list_display(listed: DataFrame) -> DataFrame:
    """Columns of the text table: score, term letter, end date, source, id, url, seen."""
    return listed.select(
        F.coalesce(F.col("final").cast("string"), F.lit("-")).alias("score"),
        F.when(F.col("rental_term") == "short", "S").when(F.col("rental_term") == "long", "L").otherwise("?").alias("term"),
        F.coalesce(dmy(F.col("lease_until")), F.lit("")).alias("until"),
        "source",
        F.col("canonical_key").alias("id"),
        "url",
        F.date_format("first_seen_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("seen"),
    )


def export_json(listed: DataFrame) -> DataFrame:
    """One JSON document per row: the listed columns with the whole listing embedded."""
    inside = [c for c in listed.columns if c not in ("final",)]
    return listed.select(
        F.to_json(
            F.struct(
                F.col("canonical_key").alias("id"), "source", "url", "first_seen_at", "final",
                F.struct(*inside).alias("listing"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("value")
    )


def agency_stats(listings: DataFrame) -> DataFrame:
    """Listings and last sighting per agency source, biggest first."""
    agencies = listings.filter(F.col("source").startswith("agency:"))
    counts = agencies.groupBy("source").agg(F.count(F.lit(1)).alias("count"), F.max("last_seen_at").alias("last"))
    return counts.orderBy(F.col("count").desc(), "source")


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = n if out is None else out.unionByName(n)
    return out
