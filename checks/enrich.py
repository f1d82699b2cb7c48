"""Commute and geocode joins, detail merges, registry."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import ARRIVAL, RAW_SQL, raw_listings, table, with_sql
from rentweave.functions.text import normalize_address
from rentweave.operators import commute as C
from rentweave.operators import details as D
from rentweave.operators.priority import source_priority, with_priority
from rentweave.operators.search import Region
from rentweave.sources import registry as R
from rentweave.sources.landing import union_sources

TARGETS = [
    C.Target("office", "08:30", "mon", ["transit", "cycling"], coords=(8.54, 47.37)),
    C.Target("school", "07:45", "tue", ["walking"], address=" Strasse  1, 8028, City8 "),
    C.Target("nowhere", "09:00", "wed", ["driving"], address="Nirgends 1"),
]
NOW = datetime(2002, 1, 1)


def located(spark: SparkSession, sf: str) -> DataFrame:
    return raw_listings(spark, sf)


def geocodes(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses 'Strasse n, 80xx, Cityx' of half the parts."""
    p = table(spark, sf, "part").filter("p_partkey % 2 = 1")
    size = F.col("p_size")
    address = F.concat_ws(
        ", ",
        F.concat(F.lit("Strasse "), (F.col("p_partkey") % 97).cast("string")),
        (8000 + size).cast("string"),
        F.concat(F.lit("City"), (size % 10).cast("string")),
    )
    return (
        p.select(normalize_address(address).alias("address_norm"), F.col("p_partkey"))
        .groupBy("address_norm")
        .agg(F.min("p_partkey").alias("k"))
        .select("address_norm", (47.0 + F.col("k") / 10000.0).alias("lat"), (8.0 + F.col("k") / 10000.0).alias("lng"))
    )


GEO_SQL = """
geocodes AS (
  SELECT 'strasse ' || CAST(p_partkey % 97 AS VARCHAR) || ', ' || CAST(8000 + p_size AS VARCHAR) || ', city' || CAST(p_size % 10 AS VARCHAR) AS address_norm,
    47.0::DOUBLE + CAST(min(p_partkey) AS DOUBLE) / 10000.0::DOUBLE AS glat, 8.0::DOUBLE + CAST(min(p_partkey) AS DOUBLE) / 10000.0::DOUBLE AS glng
  FROM part WHERE p_partkey % 2 = 1 GROUP BY 1
),
addressed AS (
  SELECT *, CASE WHEN lng IS NULL THEN lower(concat_ws(', ', address, postal_code, city)) END AS address_norm FROM raw_listings
),
located AS (
  SELECT a.*, coalesce(a.lat, g.glat) AS from_lat, coalesce(a.lng, g.glng) AS from_lng, g.address_norm AS hit
  FROM addressed a LEFT JOIN geocodes g ON a.address_norm = g.address_norm
)"""


def commute_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Cache of routes from the coordinate rule: a cell for part of the places, targets and modes."""
    p = table(spark, sf, "part").select((F.col("p_partkey") % 100).alias("x"), "p_size")
    s = F.explode(F.sequence(F.lit(0), F.lit(99))).alias("y")
    places = p.groupBy("x").agg(F.min("p_size").alias("p_size")).select("x", "p_size", s)
    cells = F.array(
        *[
            F.struct(F.lit(t).alias("target"), F.lit(m).alias("mode"), F.lit(w).alias("weekday"), F.lit(a).alias("arrive_by_min"), F.lit(n).alias("n"))
            for t, m, w, a, n in (("office", "transit", "mon", 510, 0), ("office", "cycling", "mon", 510, 1), ("school", "walking", "tue", 465, 2))
        ]
    )
    return (
        places.select("*", F.explode(cells).alias("c"))
        .filter((F.col("x") + F.col("y") + F.col("c.n")) % 4 != 0)
        .select(
            (47.3 + F.col("y") / 500.0).alias("lat"),
            (8.4 + F.col("x") / 500.0).alias("lng"),
            "c.target",
            "c.mode",
            "c.weekday",
            "c.arrive_by_min",
            (600 + F.col("p_size") * 60 + F.col("y") * 7).cast("int").alias("duration_s"),
            (F.col("y") * 130 + F.col("x")).cast("int").alias("distance_m"),
            F.lit(NOW).alias("computed_at"),
        )
    )


CACHE_SQL = """
places AS (SELECT p_partkey % 100 AS x, min(p_size) AS p_size, unnest(range(0, 100)) AS y FROM part GROUP BY 1),
kinds AS (SELECT * FROM (VALUES ('office','transit','mon',510,0), ('office','cycling','mon',510,1), ('school','walking','tue',465,2))
  AS k(target, mode, weekday, arrive_by_min, n)),
cache AS (
  SELECT CAST(floor((47.3::DOUBLE + CAST(y AS DOUBLE) / 500.0::DOUBLE) * 10000.0::DOUBLE + 0.5) AS BIGINT) AS lat_q,
    CAST(floor((8.4::DOUBLE + CAST(x AS DOUBLE) / 500.0::DOUBLE) * 10000.0::DOUBLE + 0.5) AS BIGINT) AS lng_q,
    target, mode, weekday, arrive_by_min, CAST(600 + p_size * 60 + y * 7 AS INTEGER) AS duration_s, CAST(y * 130 + x AS INTEGER) AS distance_m
  FROM places CROSS JOIN kinds WHERE (x + y + n) % 4 <> 0
),
requests AS (
  SELECT url, canonical_key, CAST(floor(from_lat * 10000.0::DOUBLE + 0.5) AS BIGINT) AS lat_q, CAST(floor(from_lng * 10000.0::DOUBLE + 0.5) AS BIGINT) AS lng_q,
    k.target, k.mode, k.weekday, k.arrive_by_min
  FROM located CROSS JOIN kinds k WHERE from_lat IS NOT NULL
    AND (k.target <> 'school' OR EXISTS (SELECT 1 FROM geocodes g WHERE g.address_norm = 'strasse 1, 8028, city8'))
)"""


def _targets(spark, sf):
    frame = C.target_coords(C.targets_frame(spark, TARGETS), geocodes(spark, sf))
    return frame.withColumnRenamed("id", "target")


def _requests(spark, sf):
    rows = C.geocode_lookup(located(spark, sf), geocodes(spark, sf))
    return C.expand_requests(rows, _targets(spark, sf), key="url")


def geocode_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.geocode_lookup(located(spark, sf), geocodes(spark, sf))
    return rows.select("url", F.round("from_lat", 6).alias("from_lat"), F.round("from_lng", 6).alias("from_lng"))


def geocode_misses(spark: SparkSession, sf: str) -> DataFrame:
    return C.geocode_misses(located(spark, sf), geocodes(spark, sf))


def commute_lookup(spark: SparkSession, sf: str) -> DataFrame:
    cache = C.commute_cache(commute_rows(spark, sf))
    return C.commute_lookup(_requests(spark, sf), cache).select("url", "target", "mode", "duration_s", "distance_m")


def commute_misses(spark: SparkSession, sf: str) -> DataFrame:
    return C.commute_misses(_requests(spark, sf), C.commute_cache(commute_rows(spark, sf)))


def assemble(spark: SparkSession, sf: str) -> DataFrame:
    cells = C.commute_lookup(_requests(spark, sf), C.commute_cache(commute_rows(spark, sf)))
    out = C.assemble_commute(cells, F.lit(NOW), key="url")

    def show(t, m, f):
        cell = F.try_element_at(F.try_element_at("commute", F.lit(t)), F.lit(m))
        return cell.getField(f)

    return out.select(
        "url",
        show("office", "transit", "duration_min").alias("transit_min"),
        show("office", "transit", "distance_km").alias("transit_km"),
        show("office", "cycling", "duration_min").alias("cycling_min"),
        show("school", "walking", "duration_min").alias("walking_min"),
        F.size("commute").alias("targets"),
    )


_J = "FROM requests r LEFT JOIN cache c USING (lat_q, lng_q, target, mode, weekday, arrive_by_min)"
ASSEMBLE = with_sql(
    RAW_SQL,
    GEO_SQL,
    CACHE_SQL,
    select=f"""SELECT url,
  max(CASE WHEN mode = 'transit' THEN CAST(floor(duration_s / 60.0::DOUBLE + 0.5) AS INTEGER) END) AS transit_min,
  max(CASE WHEN mode = 'transit' THEN distance_m / 1000.0::DOUBLE END) AS transit_km,
  max(CASE WHEN mode = 'cycling' THEN CAST(floor(duration_s / 60.0::DOUBLE + 0.5) AS INTEGER) END) AS cycling_min,
  max(CASE WHEN mode = 'walking' THEN CAST(floor(duration_s / 60.0::DOUBLE + 0.5) AS INTEGER) END) AS walking_min,
  CAST(count(DISTINCT target) AS INTEGER) AS targets
{_J} WHERE duration_s IS NOT NULL GROUP BY url""",
)


def routing_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Landed routing answers as JSON text, from order lines: both transit shapes and road routes."""
    line = table(spark, sf, "lineitem")
    d = F.col("l_quantity").cast("int") * 60
    itineraries = F.to_json(F.struct(F.array(F.struct((d + 300).alias("duration")), F.struct(d.alias("duration"))).alias("itineraries")))
    connections = F.to_json(
        F.struct(F.struct(F.array(F.struct((d + 7).alias("duration"))).alias("connections")).alias("content"))
    )
    empty = F.lit('{"itineraries": []}')
    body = F.when(F.col("l_linenumber") % 3 == 0, itineraries).when(F.col("l_linenumber") % 3 == 1, connections).otherwise(empty)
    road = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.struct((F.col("l_extendedprice") / 10).alias("distance"), (F.col("l_quantity") * 30.5).alias("duration")).alias("summary")
                )
            ).alias("routes")
        )
    )
    ddl = (
        "itineraries ARRAY<STRUCT<duration: INT>>, content STRUCT<connections: ARRAY<STRUCT<duration: INT>>>, "
        "routes ARRAY<STRUCT<summary: STRUCT<distance: DOUBLE, duration: DOUBLE>>>"
    )
    parsed = line.select(*ARRIVAL, F.from_json(body, ddl).alias("t"), F.from_json(road, ddl).alias("r"))
    transit = C.fastest_itinerary(parsed.select(*ARRIVAL, "t.*", F.col("r.routes").alias("road")))
    both = C.first_route(
        transit.select(*ARRIVAL, F.col("duration_s").alias("transit_s"), F.col("distance_m").alias("transit_m"), F.col("road").alias("routes"))
    )
    return both.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "transit_s", "transit_m", "duration_s", "distance_m")


ROUTING = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_linenumber % 3 WHEN 0 THEN CAST(l_quantity AS INTEGER) * 60 WHEN 1 THEN CAST(l_quantity AS INTEGER) * 60 + 7 END AS transit_s,
  CASE WHEN l_linenumber % 3 < 2 THEN 0 END AS transit_m, CAST(floor(l_quantity * 30.5::DOUBLE + 0.5) AS INTEGER) AS duration_s,
  CAST(floor(l_extendedprice / 10 + 0.5) AS INTEGER) AS distance_m FROM lineitem"""


# --- cards and details ----------------------------------------------------------------------------------


def dedupe_cards(spark: SparkSession, sf: str) -> DataFrame:
    cards = raw_listings(spark, sf).withColumn("id", F.concat(F.lit("c"), (F.col("l_partkey") * 7 + F.col("l_suppkey") % 3).cast("string")))
    kept = D.dedupe_cards(cards.select("id", "url", "source", *ARRIVAL), ARRIVAL)
    return kept.select("id", "url", "source")


DEDUPE_CARDS = with_sql(
    RAW_SQL,
    select="""SELECT 'c' || CAST(l_partkey * 7 + l_suppkey % 3 AS VARCHAR) AS id, url, source FROM raw_listings
  QUALIFY row_number() OVER (PARTITION BY l_partkey * 7 + l_suppkey % 3 ORDER BY seq) = 1""",
)


def detail_budget(spark: SparkSession, sf: str) -> DataFrame:
    rows = raw_listings(spark, sf)
    return D.detail_budget(rows, ARRIVAL, ["plugin"], 40).select("plugin", "url")


DETAIL_BUDGET = with_sql(
    RAW_SQL,
    select="SELECT plugin, url FROM raw_listings QUALIFY row_number() OVER (PARTITION BY plugin ORDER BY seq) <= 40",
)


def merge_detail(spark: SparkSession, sf: str) -> DataFrame:
    rows = raw_listings(spark, sf)
    sk = F.col("l_suppkey")
    blank = lambda c, n: F.when(F.col("l_orderkey") % n == 0, F.lit("")).otherwise(c)
    details = rows.filter("l_orderkey % 2 = 0").select(
        "url",
        blank(F.concat(F.lit("+49"), sk.cast("string")), 4).alias("phone"),
        F.lit("d@x.example").alias("email"),
        F.when(sk % 5 == 0, F.lit("https://f.example/")).alias("form_url"),
        F.concat(F.lit("Provider "), (sk % 3).cast("string")).alias("provider_name"),
        F.lit("https://p.example/").alias("provider_url"),
        F.when(sk % 2 == 0, F.lit("Anna B")).alias("inquiry_contact"),
        F.lit(None).cast("string").alias("viewing_contact"),
    )
    out = D.merge_detail(rows, details)
    at = lambda k: F.try_element_at("enriched.lister", F.lit(k))
    return out.select(
        "url",
        F.col("contact.phone").alias("phone"),
        F.col("contact.email").alias("email"),
        F.col("contact.form_url").alias("form_url"),
        "agency",
        at("legal_name").alias("legal_name"),
        at("website").alias("website"),
        at("inquiry_contact").alias("inquiry_contact"),
        F.col("price.total").alias("total"),
    )


MERGE_DETAIL = with_sql(
    RAW_SQL,
    select="""SELECT url, CASE WHEN phone IS NOT NULL OR l_orderkey % 2 <> 0 THEN phone WHEN l_orderkey % 4 = 0 THEN NULL
    ELSE '+49' || CAST(l_suppkey AS VARCHAR) END AS phone,
  CASE WHEN l_orderkey % 2 = 0 THEN coalesce(email, 'd@x.example') ELSE email END AS email,
  CASE WHEN l_orderkey % 2 = 0 AND l_suppkey % 5 = 0 THEN 'https://f.example/' END AS form_url,
  CASE WHEN l_orderkey % 2 = 0 THEN coalesce(agency, 'Provider ' || CAST(l_suppkey % 3 AS VARCHAR)) ELSE agency END AS agency,
  CASE WHEN l_orderkey % 2 = 0 THEN coalesce(legal_name, 'Provider ' || CAST(l_suppkey % 3 AS VARCHAR)) ELSE legal_name END AS legal_name,
  CASE WHEN l_orderkey % 2 = 0 THEN coalesce(website, 'https://p.example/') ELSE website END AS website,
  CASE WHEN l_orderkey % 2 = 0 AND l_suppkey % 2 = 0 THEN 'Anna B' END AS inquiry_contact, price_total AS total FROM raw_listings""",
)

# --- registry -------------------------------------------------------------------------------------------


def registry_rows(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    text = k.cast("string")
    pick = lambda values, e: F.get(F.array(*[F.lit(v) for v in values]), e.cast("int"))
    return s.select(
        F.when(k % 13 == 0, F.concat(F.lit("Bad Id "), text)).otherwise(F.concat(F.lit("agency-"), text)).alias("id"),
        F.when(k % 17 != 0, F.col("s_name")).otherwise("").alias("name"),
        F.when(k % 11 == 0, F.lit("no url")).otherwise(F.concat(F.lit("https://a"), text, F.lit(".example/"))).alias("website"),
        pick(["ZH", "BE", "XX", "GE", None], k % 5).alias("canton"),
        pick(["immomig", "casasoft", "schemaorg", "custom"], k % 4).alias("platform"),
        F.when(k % 3 == 0, F.lit("feed")).alias("feed_url"),
        F.when(k % 7 == 0, F.lit(0)).alias("rate_limit_per_min"),
        F.when(k % 19 == 0, F.lit(101)).when(k % 2 == 0, F.lit(60)).alias("priority"),
        F.when(k % 6 != 0, k % 2 == 0).alias("enabled"),
    )


REGISTRY_SQL = """
reg AS (
  SELECT s_suppkey AS k, CASE WHEN s_suppkey % 13 = 0 THEN 'Bad Id ' ELSE 'agency-' END || CAST(s_suppkey AS VARCHAR) AS id,
    CASE WHEN s_suppkey % 17 <> 0 THEN s_name ELSE '' END AS name,
    CASE WHEN s_suppkey % 11 = 0 THEN 'no url' ELSE 'https://a' || CAST(s_suppkey AS VARCHAR) || '.example/' END AS website,
    (['ZH','BE','XX','GE',NULL])[s_suppkey % 5 + 1] AS canton, (['immomig','casasoft','schemaorg','custom'])[s_suppkey % 4 + 1] AS platform,
    CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE 6 END AS rate,
    CASE WHEN s_suppkey % 19 = 0 THEN 101 WHEN s_suppkey % 2 = 0 THEN 60 ELSE 100 END AS priority,
    CASE WHEN s_suppkey % 6 = 0 THEN TRUE ELSE s_suppkey % 2 = 0 END AS enabled
  FROM supplier
)"""


def load_registry(spark: SparkSession, sf: str) -> DataFrame:
    return R.load_registry(registry_rows(spark, sf)).select(
        "id", "platform", "rate_limit_per_min", "priority", "enabled", F.array_join("violations", "; ").alias("violations")
    )


LOAD_REGISTRY = with_sql(
    REGISTRY_SQL,
    select="""SELECT id, platform, rate AS rate_limit_per_min, priority, enabled, concat_ws('; ',
  CASE WHEN k % 13 = 0 THEN 'id must be kebab-case' END, CASE WHEN name = '' THEN 'name is empty' END,
  CASE WHEN k % 11 = 0 THEN 'website is not a URL' END, CASE WHEN canton IS NULL OR canton = 'XX' THEN 'unknown canton' END,
  CASE WHEN k % 3 = 0 THEN 'feed_url is not a URL' END, CASE WHEN rate <= 0 THEN 'rate_limit_per_min must be positive' END,
  CASE WHEN priority > 100 THEN 'priority must be 0-100' END) AS violations FROM reg""",
)


def expand_registry(spark: SparkSession, sf: str) -> DataFrame:
    settings, skipped = R.expand_registry(R.load_registry(registry_rows(spark, sf)), Region(cantons=["ZH"]))
    a = settings.select("agency_id", "name", "plugin", F.array_join("region_filter.cantons", ",").alias("cantons"), F.lit(None).cast("string").alias("reason"))
    b = skipped.select(F.col("id").alias("agency_id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("plugin"),
                       F.lit(None).cast("string").alias("cantons"), "reason")
    return a.unionByName(b)


EXPAND_REGISTRY = with_sql(
    REGISTRY_SQL,
    select="""SELECT id AS agency_id, CASE WHEN platform IN ('casasoft','schemaorg') THEN 'agency:' || platform || ':' || id END AS name,
  CASE WHEN platform IN ('casasoft','schemaorg') THEN 'source-schemaorg' END AS plugin,
  CASE WHEN platform IN ('casasoft','schemaorg') THEN 'ZH' END AS cantons,
  CASE WHEN platform NOT IN ('casasoft','schemaorg') THEN 'platform "' || platform || '" has no bundled adapter' END AS reason
FROM reg WHERE enabled""",
)


def _two_registries(spark, sf):
    """User rows from even suppliers, discovered rows from multiples of three."""
    reg = R.load_registry(registry_rows(spark, sf)).drop("violations").withColumn("k", F.regexp_extract("id", r"(\d+)$", 1).cast("bigint"))
    user = reg.filter("k % 2 = 0").drop("k").withColumn("notes", F.lit("user"))
    found = reg.filter("k % 3 = 0").drop("k").withColumn("notes", F.lit("discovered"))
    return user, found


def union_registries(spark: SparkSession, sf: str) -> DataFrame:
    return R.union_registries(*_two_registries(spark, sf)).select("id", "notes")


def write_discovered(spark: SparkSession, sf: str) -> DataFrame:
    user, found = _two_registries(spark, sf)
    return R.write_discovered(user, found).select("id", "platform", "notes", "is_added")


def priorities(spark: SparkSession, sf: str) -> DataFrame:
    """Every nation's number is a configured priority of some plugin; the rows hold those of the first two."""
    rows = raw_listings(spark, sf).drop("source_priority")
    configured = (
        table(spark, sf, "nation")
        .select(
            F.when(F.col("n_nationkey") == 0, "source-flatfox").when(F.col("n_nationkey") == 1, "source-realadvisor").otherwise(F.col("n_name")).alias("plugin"),
            (10 + F.col("n_nationkey")).alias("priority"),
        )
    )
    unknown = source_priority(F.concat(F.lit("x"), F.col("plugin")))
    return with_priority(rows, configured).select("url", "source_priority", unknown.alias("unknown_priority"))


PRIORITIES = with_sql(
    RAW_SQL,
    select="""SELECT url, CAST(CASE sid WHEN 0 THEN 10 WHEN 4 THEN 11 ELSE 70 END AS INTEGER) AS source_priority,
  50 AS unknown_priority FROM raw_listings""",
)


def unioned(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as separate frames, one of them lacking a column."""
    rows = raw_listings(spark, sf).select("source", "plugin", "url", "rooms")
    parts = [rows.filter(F.col("plugin") == p) for p in ("source-flatfox", "source-homegate", "source-immoscout24", "source-schemaorg")]
    parts.append(rows.filter("plugin = 'source-realadvisor'").drop("rooms"))
    return union_sources(parts)


UNIONED = with_sql(
    RAW_SQL,
    select="SELECT source, plugin, url, CASE WHEN sid <> 4 THEN rooms END AS rooms FROM raw_listings",
)

QUERIES = {
    "geocode_lookup": (
        geocode_lookup,
        with_sql(RAW_SQL, GEO_SQL, select="SELECT url, round(from_lat, 6) AS from_lat, round(from_lng, 6) AS from_lng FROM located"),
    ),
    "geocode_misses": (
        geocode_misses,
        with_sql(RAW_SQL, GEO_SQL, select="SELECT DISTINCT address_norm FROM located WHERE address_norm IS NOT NULL AND hit IS NULL"),
    ),
    "commute_lookup": (
        commute_lookup,
        with_sql(RAW_SQL, GEO_SQL, CACHE_SQL, select=f"SELECT url, target, mode, duration_s, distance_m {_J}"),
    ),
    "commute_misses": (
        commute_misses,
        with_sql(
            RAW_SQL, GEO_SQL, CACHE_SQL,
            select=f"SELECT DISTINCT lat_q, lng_q, target, mode, weekday, arrive_by_min {_J} WHERE duration_s IS NULL",
        ),
    ),
    "assemble_commute": (assemble, ASSEMBLE),
    "routing_responses": (routing_responses, ROUTING),
    "dedupe_cards": (dedupe_cards, DEDUPE_CARDS),
    "detail_budget": (detail_budget, DETAIL_BUDGET),
    "merge_detail": (merge_detail, MERGE_DETAIL),
    "load_registry": (load_registry, LOAD_REGISTRY),
    "expand_registry": (expand_registry, EXPAND_REGISTRY),
    "union_registries": (
        union_registries,
        with_sql(
            REGISTRY_SQL,
            select="SELECT id, CASE WHEN k % 2 = 0 THEN 'user' ELSE 'discovered' END AS notes FROM reg WHERE k % 2 = 0 OR k % 3 = 0",
        ),
    ),
    "write_discovered_registry": (
        write_discovered,
        with_sql(
            REGISTRY_SQL,
            select="""SELECT id, platform, CASE WHEN k % 2 = 0 THEN 'user' ELSE 'discovered' END AS notes, k % 2 <> 0 AS is_added FROM reg
  WHERE k % 2 = 0 OR (k % 3 = 0 AND platform <> 'custom')""",
        ),
    ),
    "source_priority": (priorities, PRIORITIES),
    "union_sources": (unioned, UNIONED),
}
