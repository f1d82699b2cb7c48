"""Agency candidates mined from listings and landed pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentweave.functions.names import candidate_domains
from rentweave.functions.numbers import SPACE_CLASS
from rentweave.functions.plan import keep_where
from rentweave.functions.platform import classify_platform
from rentweave.functions.text import dialect
from rentweave.functions.urls import (
    candidate_from_host,
    domain_of,
    host_of,
    is_portal_or_cdn,
    is_seed_blocked,
    normalise_candidate,
)

# New-build phrases in four languages.
NEW_BUILD_PHRASES = [
    "Erstbezug",
    "Neubau",
    "prima occupazione",
    "première occupation",
    "first occupancy",
    "first-time occupancy",
]
# Candidate origins.
LISTER, MINED, RESOLVED = "lister-website", "pdp-url-mined", "ddg-from-legal-name"
URL = dialect(r"""https?:\/\/[^\s"'<>)]+""")
BARE_DOMAIN = rf"(?i)(?:^|{SPACE_CLASS}|[(\[])(www\.[a-z0-9][a-z0-9.\-]+\.(?:ch|com|li|de|fr|it))"


def is_new_build(description: Column) -> Column:
    """A phrase occurs, ignoring ASCII case only."""
    return description.rlike("(?i)" + "|".join(NEW_BUILD_PHRASES))


def distinct_websites(listings: DataFrame) -> DataFrame:
    site = F.nullif(F.try_element_at(F.col("enriched.lister"), F.lit("website")), F.lit(""))
    return listings.select(site.alias("website")).filter("website IS NOT NULL").distinct()


def distinct_legal_names(listings: DataFrame) -> DataFrame:
    name = F.nullif(F.try_element_at(F.col("enriched.lister"), F.lit("legal_name")), F.lit(""))
    return listings.select(name.alias("legal_name")).filter("legal_name IS NOT NULL").distinct()


def _spread(rows: DataFrame, candidate: Column) -> DataFrame:
    spread = rows.withColumn("_c", candidate)
    return keep_where(spread, F.col("_c").isNotNull()).select("*", "_c.*").drop("_c")


def first_per_id(candidates: DataFrame, *order: str) -> DataFrame:
    """One candidate per id, the first in ``order``; combines before the shuffle."""
    rest = F.struct("website", "source", "legal_name", *order)
    return (
        candidates.groupBy("id")
        .agg(F.min(F.struct(*order, rest.alias("c"))).alias("best"))
        .select("id", "best.c.*")
        .select("id", "website", "source", "legal_name", *order)
    )


def lister_candidates(listings: DataFrame) -> DataFrame:
    """Candidates from agency websites; sites that share an id collapse to the smallest URL."""
    sites = distinct_websites(listings).withColumnRenamed("website", "raw")
    found = _spread(sites, normalise_candidate(F.col("raw"), F.lit(LISTER)))
    return first_per_id(found, "raw").drop("raw")


def description_urls(description: Column) -> Column:
    """URLs of a text in order: those with a scheme, end punctuation trimmed, then bare ``www.`` domains."""
    urls = F.transform(
        F.regexp_extract_all(description, F.lit(URL), F.lit(0)),
        lambda u: F.regexp_replace(u, r"[.,;:!?)\]]+\z", ""),
    )
    bare = F.transform(
        F.regexp_extract_all(description, F.lit(BARE_DOMAIN), F.lit(1)),
        lambda d: F.concat(F.lit("https://"), F.regexp_replace(d, r"^www\.", ""), F.lit("/")),
    )
    worth = description.contains("://") | F.lower(description).contains("www.")
    return F.when(worth, F.concat(urls, bare)).otherwise(F.array().cast("ARRAY<STRING>"))


def description_candidates(rows: DataFrame, text: str = "description", keep: tuple[str, ...] = ()) -> DataFrame:
    """Candidates of each text with their place in it (``at``); repeats of an id within a text stay."""
    exploded = rows.select(*keep, F.posexplode(description_urls(F.col(text))).alias("at", "raw"))
    return _spread(exploded, normalise_candidate(F.col("raw"), F.lit(MINED))).drop("raw")


def mined_candidates(listings: DataFrame, order: str = "canonical_key", new_build_only: bool = False) -> DataFrame:
    """One candidate per id over all descriptions, first in (``order``, place)."""
    rows = listings.filter(is_new_build(F.col("description"))) if new_build_only else listings
    return first_per_id(description_candidates(rows, keep=(order,)), order, "at").drop(order, "at")


HREF = r"""(?i)<a[^>]+href=["']([^"']+)["'][^>]*>"""


def outgoing_links(pages: DataFrame) -> DataFrame:
    """Links of ``pages(url, html)`` to other hosts, blocked hosts dropped: ``url``, ``at`` and the candidate.

    A relative link stays on its page's host and would be dropped as a self-link, so only absolute and
    protocol-relative ones are resolved.
    """
    links = pages.select("url", F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("at", "href"))
    scheme = F.try_parse_url(F.col("url"), F.lit("PROTOCOL"))
    href = F.col("href")
    target = F.when(href.rlike("^(?i)https?://"), href).when(
        href.startswith("//"), F.concat(scheme, F.lit(":"), href)
    )
    resolved = links.withColumn("target", target).filter("target IS NOT NULL")
    resolved = resolved.withColumn("host", domain_of(F.col("target"))).filter("host IS NOT NULL")
    away = ~F.col("host").eqNullSafe(domain_of(F.col("url"))) & ~is_seed_blocked(F.col("host"))
    found = _spread(resolved.filter(away), candidate_from_host(F.col("host"), F.lit(MINED)))
    return found.drop("href", "target", "host")


def seed_candidates(pages: DataFrame) -> DataFrame:
    return first_per_id(outgoing_links(pages), "url", "at").drop("url", "at")


def union_candidates(lister: DataFrame, mined: DataFrame, seeded: DataFrame | None = None) -> DataFrame:
    """First per id: lister sites, then description links, then seed links. Keeps ``prio``."""
    parts = [lister, mined] + ([seeded] if seeded is not None else [])
    out = None
    for prio, part in enumerate(parts):
        tagged = part.select("id", "website", "source", "legal_name", F.lit(prio).alias("prio"))
        out = tagged if out is None else out.unionByName(tagged)
    return first_per_id(out, "prio")


def new_candidates(candidates: DataFrame, known: DataFrame) -> DataFrame:
    return candidates.join(known.select("id"), "id", "left_anti")


def probe_cap(candidates: DataFrame, limit: int = 25) -> DataFrame:
    """The first ``limit`` candidates in order of origin, then id (a per-task top-n, no full sort)."""
    return candidates.orderBy("prio", "id").limit(limit)


def resolve_legal_names(names: DataFrame, live_hosts: DataFrame) -> DataFrame:
    """First live host of each name's ladder as a candidate. ``live_hosts(host)`` is a landed table."""
    ladder = names.select("legal_name", F.posexplode(candidate_domains(F.col("legal_name"))).alias("at", "host"))
    live = ladder.filter(~is_portal_or_cdn(F.col("host"))).join(live_hosts.select("host").distinct(), "host", "left_semi")
    best = live.groupBy(F.col("legal_name").alias("name")).agg(F.min_by("host", "at").alias("host"))
    return _spread(best, candidate_from_host(F.col("host"), F.lit(RESOLVED), F.col("name"))).drop("host", "name")


def platform_of_candidate(candidates: DataFrame, pages: DataFrame, detail_pages: DataFrame) -> DataFrame:
    """Add ``platform``: from the homepage, else from the best detail pages in rank order, else ``custom``.

    ``pages(url, html)`` are landed pages; ``detail_pages(site, loc, rank)`` are each site's detail URLs to try.
    Pages shrink to their platform name before any join.
    """
    named = pages.select("url", classify_platform(F.col("html")).alias("platform"))
    named = keep_where(named, F.col("platform").isNotNull())
    host = F.regexp_replace(host_of(F.col("url")), r"^www\.", "")
    root = F.coalesce(F.try_parse_url(F.col("url"), F.lit("PATH")), F.lit("")).isin("", "/") & F.try_parse_url(
        F.col("url"), F.lit("QUERY")
    ).isNull()
    home = named.filter(root).select(host.alias("_host"), "platform", F.lit(0).alias("rank"))
    detail = named.join(detail_pages.select(F.col("loc").alias("url"), "rank"), "url").select(
        host.alias("_host"), "platform", "rank"
    )
    best = home.unionByName(detail).groupBy("_host").agg(F.min_by("platform", F.struct("rank", "platform")).alias("platform"))
    keyed = candidates.withColumn("_host", domain_of(F.col("website")))
    return keyed.join(best, "_host", "left").withColumn("platform", F.coalesce("platform", F.lit("custom"))).drop("_host")
