"""Sitemaps and robots files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rentweave.functions.text import trim_space
from rentweave.functions.urls import host_of, score_detail_url


def scan_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """``loc`` and ``lastmod`` of every url element, with its place in the landed files."""
    urls = (
        spark.read.format("xml").option("rowTag", "url").schema("loc STRING, lastmod STRING").load(path)
    )
    return urls.select(
        F.coalesce("loc", F.lit("")).alias("loc"),
        "lastmod",
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("position"),
    )


def extract_locs(xml: Column) -> Column:
    """All ``<loc>`` values of a sitemap text, trimmed, in order."""
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?i)<loc>([^<]+)</loc>"), F.lit(1)), trim_space)


def robots_sitemap(robots: Column) -> Column:
    """First ``Sitemap:`` line of a robots file."""
    return F.nullif(F.regexp_extract(robots, r"(?im)^\s*Sitemap:\s*(\S+)", 1), F.lit(""))


def sitemap_top_n(
    entries: DataFrame, per: Sequence[str], limit: int = 30, pattern: str | None = None, position: str = "position"
) -> DataFrame:
    """Newest entries of each agency. The URL pattern applies before the cap, so that only pages worth a fetch
    use it up; the constant cap is applied per task before the shuffle."""
    if pattern:
        entries = entries.filter(F.col("loc").rlike(pattern))
    newest = Window.partitionBy(*per).orderBy(F.coalesce("lastmod", F.lit("")).desc(), position)
    return entries.withColumn("_turn", F.row_number().over(newest)).filter(F.col("_turn") <= limit).drop("_turn")


def top_detail_urls(locs: DataFrame, site: str = "site", limit: int = 3, position: str = "position") -> DataFrame:
    """The best ``limit`` URLs of each site with a positive score; a site without any gives its first URL.

    Repeats count once. ``locs(site, loc, position)``.
    """
    distinct = locs.groupBy(site, "loc").agg(F.min(position).alias(position))
    scored = distinct.withColumn("score", score_detail_url(F.col("loc")))
    # Positive scores sort ahead of the rest; among the rest only the first by position can be wanted.
    good = F.col("score") > 0
    rank = Window.partitionBy(site).orderBy(
        good.desc(), F.when(good, F.col("score")).otherwise(F.lit(0)).desc(), position
    )
    picked = scored.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= limit)
    return picked.filter(good | (F.col("rank") == 1))


def expand_sitemap_index(starts: DataFrame, sitemaps: DataFrame, levels: int = 2, fan_out: int = 3) -> DataFrame:
    """(site, loc, position): the distinct URLs that each site's sitemap leads to, in order of encounter.

    ``starts(site, url)`` names a sitemap for each site, ``sitemaps(url, xml)`` are landed texts. A sitemap index gives way to its ``fan_out`` best children
    (by `score_detail_url`, ties in order) that are landed and are sitemaps, ``levels`` times at most, so cycles end. Where none of a site's
    indexes has such a child, or an index is left after the last level, its own URLs count. Sites whose first sitemap is not landed have no rows.
    """
    locs = extract_locs(F.col("xml"))
    ranked = F.array_sort(F.transform("locs", lambda u, i: F.struct((-score_detail_url(u)).alias("worse"), i.alias("i"), u.alias("url"))))
    landed = sitemaps.groupBy("url").agg(F.min("xml").alias("xml"))
    facts = landed.select(F.col("url").alias("_url"), F.col("xml").rlike("(?i)<sitemapindex").alias("index"), F.col("xml").rlike("(?i)<urlset|<sitemapindex").alias("valid"), locs.alias("locs"))
    facts = facts.withColumn("best", F.when(F.col("index"), F.transform(F.slice(ranked, 1, fan_out), lambda x: x["url"])))
    place = F.array().cast("ARRAY<INT>")
    now = starts.select("site", F.col("url").alias("_url"), place.alias("place")).join(facts, "_url")
    for _ in range(levels):
        children = now.filter("index").select("site", "place", F.posexplode("best").alias("rank", "_url"))
        children = children.select("site", "_url", F.concat(F.array(F.lit(1)), "place", F.array("rank")).alias("place"))
        fetched = children.join(facts.filter("valid"), "_url")
        # A site none of whose indexes leads on stays as it is.
        moved = fetched.select("site").distinct().withColumn("moved", F.lit(True))
        stay = now.join(moved, "site", "left").filter(~F.col("index") | F.col("moved").isNull()).drop("moved")
        now = stay.withColumn("place", F.concat(F.array(F.lit(0)), "place")).unionByName(fetched)
    found = now.select("site", "place", F.posexplode("locs").alias("at", "loc"))
    return found.groupBy("site", "loc").agg(F.min(F.struct("place", "at")).alias("position"))


def with_site(pages: DataFrame, url: str = "url") -> DataFrame:
    return pages.withColumn("site", host_of(F.col(url)))
