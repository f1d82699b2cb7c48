"""Composite jobs: the scan and agency discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.rules import DIMS, NOW
from checks.urls import HOST, PORTAL_RE, SLUG, linked_pages, tagged_pages
from checks.views import ARRIVAL, RANKED_SQL, RAW_SQL, raw_listings, table, with_sql
from rentweave.operators import candidates as C
from rentweave.operators.filters import FieldRule
from rentweave.operators.gate import RentalPolicy
from rentweave.plans import discovery as D
from rentweave.plans.run_scan import ScanConfig, run_scan

SCAN = ScanConfig(
    policy=RentalPolicy("long"),
    rules=[
        FieldRule("price.total", "<=", 2900),
        FieldRule("rooms", ">=", 1.5),
        FieldRule("features.pets_allowed", "!=", False, on_missing="skip"),
        FieldRule("photos.0", "!=", "https://img.example/7/1", on_missing="pass"),
    ],
    dims=[d for d in DIMS if d.name != "commute"],
    threshold=55,
    daily_quota=150,
    notifiers=("telegram", "mail"),
)


def _scan(spark, sf, cfg=SCAN):
    raw = raw_listings(spark, sf).drop("canonical_key", "source_priority", "seen_on_sources")
    return run_scan(raw, ARRIVAL, cfg, F.lit(NOW))


_RANK = "CASE WHEN rec THEN ord ELSE -ord END"


def _v(col: str) -> str:
    return f"max_by({col}, {_RANK}) FILTER (WHERE {col} IS NOT NULL) OVER w"


_FILLS = "rent_net extras deposit_months floor_no built_year address city region agency phone email lease_until lng website term_known".split()
# The head of a version's photos: the newest record that has any, else the earliest row that has any.
_PHOTO_RULE = "coalesce(top_photos[1], any_photos[1]) IS DISTINCT FROM 'https://img.example/7/1'"
SCAN_SQL = f"""
facts AS (
  SELECT *, nullif(rental_term, 'unknown') AS term_known,
    CASE WHEN l_linenumber % 2 = 0 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'true' ELSE 'false' END END AS pets,
    CASE WHEN l_suppkey % 3 = 0 THEN l_linenumber END AS baths, CASE WHEN sid = 2 THEN l_linenumber END AS listed_no
  FROM ranked
),
photo_new AS (
  SELECT canonical_key, min(seq) AS seq FROM (SELECT canonical_key, seq, unnest(photos) AS photo FROM ranked) GROUP BY canonical_key, photo
),
photo_seqs AS (SELECT DISTINCT seq FROM photo_new),
versions AS (
  SELECT canonical_key, seq, ord, {", ".join(ARRIVAL)}, url,
    {_v("price_total")} AS price_total, {_v("rooms")} AS rooms, {_v("area_m2")} AS area_m2, {_v("built_year")} AS built_year,
    coalesce({_v("term_known")}, 'unknown') AS rental_term, {_v("phone")} AS phone, {_v("lease_until")} AS lease_until, {_v("pets")} AS pets,
    max_by(photos, {_RANK}) FILTER (WHERE rec AND len(photos) > 0) OVER w AS top_photos,
    max_by(photos, {_RANK}) FILTER (WHERE len(photos) > 0) OVER w AS any_photos,
    (rec OR coalesce(first_seen_at < old_f, FALSE) OR {" OR ".join(f"({c} IS NOT NULL AND count({c}) OVER w = 1)" for c in _FILLS + ["pets", "baths"])}
      OR (sid = 2 AND count(listed_no) OVER w = 1)
      OR (sid = 2 AND row_number() OVER (PARTITION BY canonical_key, sid, l_linenumber ORDER BY seq) = 1)
      OR row_number() OVER (PARTITION BY canonical_key, source ORDER BY seq) = 1
      OR coalesce(lag(l_orderkey) OVER (PARTITION BY canonical_key, source ORDER BY seq) <> l_orderkey, FALSE)
      OR seq IN (SELECT seq FROM photo_seqs)) AS changed
  FROM facts WINDOW w AS (PARTITION BY canonical_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
scored AS (
  SELECT *, CAST(floor((
      greatest(0.0::DOUBLE, least(1.0::DOUBLE, (price_total - 3000) / (1200.0::DOUBLE - 3000.0::DOUBLE))) * 3.0::DOUBLE
      + (CASE WHEN rooms >= 4 THEN 1.0::DOUBLE WHEN rooms >= 3 AND rooms < 4 THEN 0.7::DOUBLE WHEN rooms = 2.5 THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END) * 2.0::DOUBLE
      + coalesce(1.0::DOUBLE / (1.0::DOUBLE + exp(-0.1::DOUBLE * (area_m2 - 90))), 0) * 1.5::DOUBLE
      + (CASE rental_term WHEN 'long' THEN 1.0::DOUBLE WHEN 'short' THEN 0.2::DOUBLE ELSE 0.4::DOUBLE END) * 1.0::DOUBLE
      + (CASE pets WHEN 'true' THEN 1.0::DOUBLE WHEN 'false' THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) * 0.5::DOUBLE
      + (CASE WHEN phone IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 0.5::DOUBLE
      + (CASE WHEN built_year IS NULL THEN 0.6::DOUBLE ELSE 0.8::DOUBLE END) * 1.0::DOUBLE) / 9.5::DOUBLE * 100 + 0.5) AS INTEGER) AS final
  FROM versions
  WHERE changed AND NOT coalesce(lease_until < TIMESTAMP '1998-06-01', FALSE) AND rental_term <> 'short' AND price_total <= 2900
    AND rooms >= 1.5 AND pets IS DISTINCT FROM 'false' AND {_PHOTO_RULE}
),
admitted AS (SELECT * FROM scored WHERE ord = 1 AND final >= 55 ORDER BY {", ".join(ARRIVAL)} LIMIT 150)"""
_KEYS = ", ".join(ARRIVAL[:5])


def scan_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scan(spark, sf).scores.select("listing_id", "final", *ARRIVAL[:5])


SCAN_SCORES = with_sql(RAW_SQL, RANKED_SQL, SCAN_SQL, select=f"SELECT canonical_key AS listing_id, final, {_KEYS} FROM scored")


def scan_outbox(spark: SparkSession, sf: str) -> DataFrame:
    out = _scan(spark, sf).outbox
    return out.select("listing_id", "url", "notifier", "final", "day", F.size("also_seen_on").alias("also_seen"))


SCAN_OUTBOX = with_sql(
    RAW_SQL,
    RANKED_SQL,
    SCAN_SQL,
    select="""SELECT canonical_key AS listing_id, url, notifier, final, '1998-06-01' AS day, 0 AS also_seen
FROM admitted CROSS JOIN (VALUES ('telegram'), ('mail')) n(notifier)""",
)


def scan_dry_run(spark: SparkSession, sf: str) -> DataFrame:
    """No notifications, but the quota is spent all the same; two sources only."""
    from dataclasses import replace

    cfg = replace(SCAN, dry_run=True, sources=["source-flatfox", "source-homegate"], daily_quota=40)
    result = _scan(spark, sf, cfg)
    sent = result.outbox.agg(F.count(F.lit(1)).alias("sent"))
    spent = result.admitted.agg(F.count(F.lit(1)).alias("spent"), F.max("final").alias("best"))
    return sent.select("sent", F.lit(1).alias("j")).join(spent.withColumn("j", F.lit(1)), "j").drop("j")


SCAN_DRY_RUN = with_sql(
    RAW_SQL.replace("FROM raw2\n)", "FROM raw2 WHERE sid IN (0, 1)\n)"),
    RANKED_SQL,
    SCAN_SQL.replace("LIMIT 150", "LIMIT 40"),
    select="SELECT 0::BIGINT AS sent, count(*) AS spent, max(final) AS best FROM admitted",
)


def top_listings(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: merged canonical listings, scored; the best hundred."""
    from rentweave.operators.merge import merge_listings
    from rentweave.operators.scoring import score_listing

    merged = merge_listings(raw_listings(spark, sf), ARRIVAL)
    scored = score_listing(merged, SCAN.dims)
    return (
        scored.orderBy(F.col("final").desc(), "canonical_key")
        .limit(100)
        .select("canonical_key", "final", "source", "url", F.col("price.total").alias("total"), "rooms", F.size("photos").alias("n_photos"))
    )


TOP_LISTINGS = with_sql(
    RAW_SQL,
    RANKED_SQL,
    """
facts AS (SELECT *, CASE WHEN rec THEN ord ELSE -ord END AS rank, nullif(rental_term, 'unknown') AS term_known,
  CASE WHEN l_linenumber % 2 = 0 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'true' ELSE 'false' END END AS pets FROM ranked),
merged AS (
  SELECT canonical_key, count(*) AS n, max_by(source, rank) AS source, max_by(url, rank) AS url, max_by(price_total, rank) AS price_total,
    max_by(rooms, rank) AS rooms, max_by(area_m2, rank) AS area_m2, max_by(built_year, rank) FILTER (WHERE built_year IS NOT NULL) AS built_year,
    coalesce(max_by(term_known, rank) FILTER (WHERE term_known IS NOT NULL), 'unknown') AS rental_term,
    max_by(phone, rank) FILTER (WHERE phone IS NOT NULL) AS phone, max_by(pets, rank) FILTER (WHERE pets IS NOT NULL) AS pets,
    CAST(len(list_distinct(flatten(list(photos)))) AS INTEGER) AS n_photos
  FROM facts GROUP BY canonical_key
),
scored AS (SELECT *, CAST(floor((
      greatest(0.0::DOUBLE, least(1.0::DOUBLE, (price_total - 3000) / (1200.0::DOUBLE - 3000.0::DOUBLE))) * 3.0::DOUBLE
      + (CASE WHEN rooms >= 4 THEN 1.0::DOUBLE WHEN rooms >= 3 AND rooms < 4 THEN 0.7::DOUBLE WHEN rooms = 2.5 THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END) * 2.0::DOUBLE
      + coalesce(1.0::DOUBLE / (1.0::DOUBLE + exp(-0.1::DOUBLE * (area_m2 - 90))), 0) * 1.5::DOUBLE
      + (CASE rental_term WHEN 'long' THEN 1.0::DOUBLE WHEN 'short' THEN 0.2::DOUBLE ELSE 0.4::DOUBLE END) * 1.0::DOUBLE
      + (CASE pets WHEN 'true' THEN 1.0::DOUBLE WHEN 'false' THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) * 0.5::DOUBLE
      + (CASE WHEN phone IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 0.5::DOUBLE
      + (CASE WHEN built_year IS NULL THEN 0.6::DOUBLE ELSE 0.8::DOUBLE END) * 1.0::DOUBLE) / 9.5::DOUBLE * 100 + 0.5) AS INTEGER) AS final FROM merged)""",
    select="""SELECT canonical_key, final, source, url, price_total AS total, rooms, n_photos FROM scored
ORDER BY final DESC, canonical_key LIMIT 100""",
)

# --- discovery ------------------------------------------------------------------------------------------


def _listings(spark, sf):
    """Raw listings as stored ones: the arrival's URL is its key, so that every description counts."""
    return raw_listings(spark, sf).withColumn("canonical_key", F.col("url"))


def _known(spark, sf):
    s = table(spark, sf, "supplier").filter("s_suppkey % 4 = 0")
    return s.select(
        F.concat(F.lit("agency"), F.col("s_suppkey").cast("string")).alias("id"),
        F.col("s_name").alias("name"),
        F.lit("schemaorg").alias("platform"),
    )


def distinct_sites(spark: SparkSession, sf: str) -> DataFrame:
    rows = _listings(spark, sf)
    a = C.distinct_websites(rows).select(F.lit("website").alias("kind"), F.col("website").alias("value"))
    return a.unionByName(C.distinct_legal_names(rows).select(F.lit("legal_name").alias("kind"), F.col("legal_name").alias("value")))


DISTINCT_SITES = with_sql(
    RAW_SQL,
    select="""SELECT DISTINCT 'website' AS kind, website AS value FROM raw_listings WHERE website IS NOT NULL
UNION ALL SELECT DISTINCT 'legal_name', legal_name FROM raw_listings WHERE legal_name IS NOT NULL""",
)
_CANDS_SQL = rf"""
lister0 AS (SELECT DISTINCT website AS u FROM raw_listings WHERE website IS NOT NULL),
lister1 AS (SELECT u, {HOST.format(u="u")} AS host FROM lister0),
lister AS (SELECT {SLUG.format(h="host")} AS id, 'https://' || host || '/' AS website, 'lister-website' AS source, 0 AS prio FROM lister1),
mined AS (SELECT DISTINCT * FROM (
  SELECT 'nordhaus-living' AS id, 'https://nordhaus-living.ch/' AS website, 'pdp-url-mined' AS source, 1 AS prio FROM raw_listings WHERE contains(description, 'nordhaus')
  UNION ALL SELECT 'seeblick-immo', 'https://seeblick-immo.ch/', 'pdp-url-mined', 1 FROM raw_listings WHERE contains(description, 'seeblick'))),
seeded AS (SELECT DISTINCT * FROM (
  SELECT 'partner' || CAST(page_id % 30 AS VARCHAR) AS id, 'https://partner' || CAST(page_id % 30 AS VARCHAR) || '.ch/' AS website, 'pdp-url-mined' AS source, 2 AS prio FROM pages
  UNION ALL SELECT 'dev' || CAST(page_id % 17 AS VARCHAR), 'https://dev' || CAST(page_id % 17 AS VARCHAR) || '.li/', 'pdp-url-mined', 2 FROM pages)),
pool AS (SELECT * FROM lister UNION ALL SELECT * FROM mined UNION ALL SELECT * FROM seeded),
cands AS (SELECT id, website, source, CAST(prio AS INTEGER) AS prio FROM pool WHERE NOT regexp_matches(website, '{PORTAL_RE}')
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY prio, website) = 1),
known AS (SELECT 'agency' || CAST(s_suppkey AS VARCHAR) AS id FROM supplier WHERE s_suppkey % 4 = 0),
fresh AS (SELECT * FROM cands WHERE id NOT IN (SELECT id FROM known))"""


def union_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return D.all_candidates(_listings(spark, sf), D.DiscoveryConfig(), linked_pages(spark, sf)).drop("legal_name")


def probe_cap(spark: SparkSession, sf: str) -> DataFrame:
    found = D.all_candidates(_listings(spark, sf), D.DiscoveryConfig(), linked_pages(spark, sf))
    return C.probe_cap(C.new_candidates(found, _known(spark, sf)), 25).drop("legal_name")


def _landed(spark, sf):
    """Tagged pages, served also from candidates' homepages."""
    pages = tagged_pages(spark, sf)
    k = F.col("page_id")
    home = F.concat(F.lit("https://www.agency"), k.cast("string"), F.lit(".ch/"))
    detail = F.concat(F.lit("https://partner"), k.cast("string"), F.lit(".ch/objekt/wohnung-"), (k + 100).cast("string"))
    return pages.select(F.explode(F.array("url", home, detail)).alias("url"), "html")


def _site_locs(spark, sf):
    """A sitemap for every page's partner site; the candidates among them are found by their host."""
    pages = table(spark, sf, "pages")
    k = F.col("page_id")
    host = F.concat(F.lit("partner"), k.cast("string"), F.lit(".ch"))
    return pages.select(
        host.alias("site"),
        F.explode(
            F.array(
                F.concat(F.lit("https://"), host, F.lit("/objekt/wohnung-"), (k + 100).cast("string")),
                F.concat(F.lit("https://"), host, F.lit("/news/")),
            )
        ).alias("loc"),
        F.lit(0).alias("position"),
    )


def discover(spark: SparkSession, sf: str) -> DataFrame:
    hosts = table(spark, sf, "supplier").select(F.concat(F.lit("agency-"), (F.col("s_suppkey") % 5).cast("string"), F.lit(".ch")).alias("host"))
    result = D.discover_agencies(
        _listings(spark, sf), _known(spark, sf), _landed(spark, sf), F.lit("2026-01-01"), D.DiscoveryConfig(max_new_probes=40),
        seed_pages=linked_pages(spark, sf), live_hosts=hosts, sitemap_locs=_site_locs(spark, sf),
    )
    return result.probed.select("id", "website", "source", "platform")


_PLATFORM_OF = """CASE {k} % 8 WHEN 0 THEN 'immomig' WHEN 1 THEN 'casasoft' WHEN 2 THEN 'iframe-portal' WHEN 3 THEN 'schemaorg' WHEN 4 THEN 'immomig' ELSE 'custom' END"""
_PROBED_SQL = f"""
names AS (SELECT DISTINCT l_suppkey % 11 AS n FROM lineitem WHERE l_linenumber % 2 = 0),
resolved AS (SELECT 'agency-' || CAST(n AS VARCHAR) AS id, 'https://agency-' || CAST(n AS VARCHAR) || '.ch/' AS website, 'ddg-from-legal-name' AS source, 9 AS prio FROM names WHERE n < 5),
first_cut AS (SELECT * FROM fresh ORDER BY prio, id LIMIT 40),
probed AS (SELECT * FROM (SELECT * FROM first_cut UNION ALL SELECT * FROM resolved WHERE id NOT IN (SELECT id FROM known)) ORDER BY prio, id LIMIT 40),
typed AS (SELECT *, CASE WHEN regexp_matches(website, '^https://agency[0-9]+\\.ch/$') THEN {_PLATFORM_OF.format(k="CAST(regexp_extract(website, 'agency([0-9]+)', 1) AS INTEGER)")}
    WHEN starts_with(id, 'partner') THEN {_PLATFORM_OF.format(k="CAST(substr(id, 8) AS INTEGER)")} ELSE 'custom' END AS platform FROM probed)"""
DISCOVER = with_sql(RAW_SQL, _CANDS_SQL, _PROBED_SQL, select="SELECT id, website, source, platform FROM typed")


def discovery_summary(spark: SparkSession, sf: str) -> DataFrame:
    result = D.discover_agencies(
        _listings(spark, sf), _known(spark, sf), _landed(spark, sf), F.lit("2026-01-01"), D.DiscoveryConfig(max_new_probes=30),
        seed_pages=linked_pages(spark, sf), sitemap_locs=_site_locs(spark, sf),
    )
    return result.summary


DISCOVERY_SUMMARY = with_sql(
    RAW_SQL,
    _CANDS_SQL,
    _PROBED_SQL.replace("LIMIT 40", "LIMIT 30").replace("WHERE n < 5", "WHERE FALSE"),
    select="""SELECT 'total_candidates' AS figure, (SELECT count(*) FROM cands) + (SELECT count(*) FROM names) AS n
UNION ALL SELECT 'already_known', count(*) FROM cands c WHERE id IN (SELECT id FROM known)
  AND NOT EXISTS (SELECT 1 FROM (SELECT prio, id FROM fresh ORDER BY prio, id LIMIT 1 OFFSET 30) s WHERE s.prio < c.prio OR (s.prio = c.prio AND s.id < c.id))
UNION ALL SELECT 'probed', count(*) FROM typed
UNION ALL SELECT 'added', count(*) FROM typed
UNION ALL SELECT 'platform ' || platform, count(*) FROM typed GROUP BY platform""",
)


def probe_portal(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.probe_portal(_listings(spark, sf), _landed(spark, sf), F.lit("2026-01-01"), top=300)
    return rows.select("id", "platform", "enabled", "notes")


PROBE_PORTAL = with_sql(
    RAW_SQL,
    """
newest AS (SELECT * FROM raw_listings ORDER BY first_seen_at DESC, url LIMIT 300),
hits AS (
  SELECT 'agency' || CAST(l_suppkey % 13 AS VARCHAR) AS id FROM newest WHERE l_suppkey % 3 = 1
  UNION SELECT 'nordhaus-living' FROM newest WHERE contains(description, 'nordhaus')
  UNION SELECT 'seeblick-immo' FROM newest WHERE contains(description, 'seeblick'))""",
    select=f"""SELECT id, replace(CASE WHEN starts_with(id, 'agency') THEN {_PLATFORM_OF.format(k="CAST(substr(id, 7) AS INTEGER)")} ELSE 'custom' END,
    'iframe-portal', 'custom') AS platform, FALSE AS enabled, 'discovered via probe-portal flatfox on 2026-01-01' AS notes FROM hits""",
)

QUERIES = {
    "top_listings": (top_listings, TOP_LISTINGS),
    "run_scan_scores": (scan_scores, SCAN_SCORES),
    "run_scan_outbox": (scan_outbox, SCAN_OUTBOX),
    "run_scan_dry_run": (scan_dry_run, SCAN_DRY_RUN),
    "distinct_websites_and_names": (distinct_sites, DISTINCT_SITES),
    "union_candidates": (union_candidates, with_sql(RAW_SQL, _CANDS_SQL, select="SELECT * FROM cands")),
    "probe_cap": (probe_cap, with_sql(RAW_SQL, _CANDS_SQL, select="SELECT * FROM fresh ORDER BY prio, id LIMIT 25")),
    "discover_agencies": (discover, DISCOVER),
    "discovery_summary": (discovery_summary, DISCOVERY_SUMMARY),
    "probe_portal": (probe_portal, PROBE_PORTAL),
}
