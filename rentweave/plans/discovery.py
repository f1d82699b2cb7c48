"""Agency discovery: candidates from listings and landed pages to registry rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentweave.functions.urls import domain_of
from rentweave.operators import candidates as C
from rentweave.sources.registry import write_discovered
from rentweave.sources.sitemap import top_detail_urls


@dataclass(frozen=True)
class DiscoveryConfig:
    max_new_probes: int = 25
    mine_descriptions: bool = True
    new_build_only: bool = False
    resolve_legal_names: bool = True
    default_canton: str = "ZH"
    enabled: bool = False


@dataclass(frozen=True)
class Discovery:
    candidates: DataFrame
    probed: DataFrame
    registry: DataFrame
    summary: DataFrame


def all_candidates(listings: DataFrame, cfg: DiscoveryConfig, seed_pages: DataFrame | None = None) -> DataFrame:
    """Lister sites, then description links, then seed-page links; one per id."""
    lister = C.lister_candidates(listings)
    source = listings if cfg.mine_descriptions else listings.filter(F.lit(False))
    mined = C.mined_candidates(source, new_build_only=cfg.new_build_only)
    return C.union_candidates(lister, mined, C.seed_candidates(seed_pages) if seed_pages is not None else None)


def registry_rows(probed: DataFrame, cfg: DiscoveryConfig, day: Column) -> DataFrame:
    """Draft registry rows; a portal iframe counts as a custom site."""
    platform = F.when(F.col("platform") == "iframe-portal", "custom").otherwise(F.col("platform"))
    return probed.select(
        "id",
        F.coalesce("legal_name", "id").alias("name"),
        "website",
        F.lit(cfg.default_canton).alias("canton"),
        platform.alias("platform"),
        F.lit(6).alias("rate_limit_per_min"),
        F.lit(100).alias("priority"),
        F.lit(cfg.enabled).alias("enabled"),
        F.concat(F.lit("discovered via "), "source", F.lit(" on "), day).alias("notes"),
    )


def discover_agencies(
    listings: DataFrame,
    existing: DataFrame,
    landed: DataFrame,
    day: Column,
    cfg: DiscoveryConfig = DiscoveryConfig(),
    seed_pages: DataFrame | None = None,
    live_hosts: DataFrame | None = None,
    sitemap_locs: DataFrame | None = None,
) -> Discovery:
    """One pass. ``landed(url, html)`` are the fetched pages, ``sitemap_locs(site, loc, position)`` the URLs of each
    site's sitemap, ``live_hosts(host)`` the hosts that answered, ``existing`` the registry so far."""
    found = all_candidates(listings, cfg, seed_pages)
    fresh = C.new_candidates(found, existing)
    capped = C.probe_cap(fresh, cfg.max_new_probes)
    names = C.distinct_legal_names(listings) if cfg.resolve_legal_names else listings.select(F.lit("").alias("legal_name")).limit(0)
    resolved = None
    if cfg.resolve_legal_names and live_hosts is not None:
        resolved = C.resolve_legal_names(names, live_hosts).withColumn("prio", F.lit(9))
        # Names come after all sites, and only for ids nobody holds yet.
        late = C.first_per_id(C.new_candidates(resolved, existing).join(capped.select("id"), "id", "left_anti"), "prio")
        capped = C.probe_cap(capped.unionByName(late.select(*capped.columns)), cfg.max_new_probes)
    locs = sitemap_locs if sitemap_locs is not None else landed.select(domain_of(F.col("url")).alias("site"), F.col("url").alias("loc"), F.lit(0).alias("position")).limit(0)
    tried = top_detail_urls(locs)
    probed = C.platform_of_candidate(capped, landed, tried)
    rows = registry_rows(probed, cfg, day)
    return Discovery(found, probed, write_discovered(existing, rows), summarise(found, existing, names, probed, cfg.max_new_probes, resolved))


def summarise(
    found: DataFrame, existing: DataFrame, names: DataFrame, probed: DataFrame, most: int, resolved: DataFrame | None = None
) -> DataFrame:
    """One row per figure: totals, then probes by platform. A pass stops at the first new candidate beyond the cap, so known ones
    after it (by origin, then id) are not counted; every probe adds its row."""
    count = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("figure"), "n")
    place = F.struct("prio", "id")
    ahead = C.probe_cap(C.new_candidates(found, existing), most + 1).agg(F.count(F.lit(1)).alias("ahead"), F.max(place).alias("stop"))
    known = found.join(existing.select("id"), "id", "left_semi").join(F.broadcast(ahead))
    known = known.filter((F.col("ahead") <= most) | (place < F.col("stop")))
    total = found.select("id").unionByName(names.select(F.col("legal_name").alias("id")))
    out = count(total, "total_candidates").unionByName(count(known, "already_known")).unionByName(count(probed, "probed"))
    out = out.unionByName(count(probed, "added"))
    if resolved is not None:
        out = out.unionByName(count(names.join(resolved, "legal_name", "left_anti"), "unresolved"))
    by_platform = probed.groupBy("platform").agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(by_platform.select(F.concat(F.lit("platform "), "platform").alias("figure"), "n"))


def probe_portal(
    listings: DataFrame, landed: DataFrame, day: Column, top: int = 100, cfg: DiscoveryConfig = DiscoveryConfig(max_new_probes=1_000_000), portal: str = "flatfox"
) -> DataFrame:
    """Draft rows for the agencies of the newest ``top`` listings: the agency site first, then description links."""
    newest = listings.orderBy(F.col("first_seen_at").desc(), "canonical_key").limit(top)
    found = C.union_candidates(C.lister_candidates(newest), C.mined_candidates(newest))
    none = landed.select(domain_of(F.col("url")).alias("site"), F.col("url").alias("loc"), F.lit(0).alias("rank")).limit(0)
    probed = C.platform_of_candidate(found, landed, none)
    rows = registry_rows(probed, cfg, day)
    return rows.withColumn("notes", F.concat(F.lit(f"discovered via probe-portal {portal} on "), day))
