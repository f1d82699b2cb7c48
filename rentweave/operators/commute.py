"""Commute and geocode enrichment by joins with cached dimensions.

Live routing is outside; what the caches lack comes out as work queues.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentweave.functions.numbers import quantize, round_half_up
from rentweave.functions.text import normalize_address

CELL_KEYS = ["lat_q", "lng_q", "target", "mode", "weekday", "arrive_by_min"]


@dataclass(frozen=True)
class Target:
    id: str
    arrive_by: str
    weekday: str
    modes: Sequence[str]
    address: str | None = None
    coords: tuple[float, float] | None = None  # lng, lat

    def __post_init__(self):
        if self.address is None and self.coords is None:
            raise ValueError(f"target {self.id!r} needs an address or coordinates")


def targets_frame(spark: SparkSession, targets: Sequence[Target]) -> DataFrame:
    """Configured targets as rows (a handful by nature)."""
    rows = [
        (
            t.id,
            t.address,
            t.coords[0] if t.coords else None,
            t.coords[1] if t.coords else None,
            t.weekday,
            int(t.arrive_by[:2]) * 60 + int(t.arrive_by[3:]),
            list(t.modes),
        )
        for t in targets
    ]
    return spark.createDataFrame(
        rows,
        "target STRING, address STRING, lng DOUBLE, lat DOUBLE, weekday STRING, arrive_by_min INT, modes ARRAY<STRING>",
    )


def target_coords(targets: DataFrame, geocodes: DataFrame) -> DataFrame:
    """Own coordinates, else the geocoded address; a target with neither is dropped."""
    known = geocodes.select("address_norm", F.col("lat").alias("_g_lat"), F.col("lng").alias("_g_lng"))
    joined = targets.withColumn("address_norm", normalize_address(F.col("address"))).join(
        known, "address_norm", "left"
    )
    own = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    return (
        joined.withColumns(
            {
                "lat": F.when(own, F.col("lat")).otherwise(F.col("_g_lat")),
                "lng": F.when(own, F.col("lng")).otherwise(F.col("_g_lng")),
            }
        )
        .filter("lat IS NOT NULL")
        .drop("_g_lat", "_g_lng", "address_norm")
    )


def listing_address() -> Column:
    """``address, postal code, city`` of the parts that are present, normalised; null when none is."""
    parts = [F.nullif(F.col(f"location.{p}"), F.lit("")) for p in ("address", "postal_code", "city")]
    return F.nullif(normalize_address(F.concat_ws(", ", *parts)), F.lit(""))


def geocode_lookup(listings: DataFrame, geocodes: DataFrame) -> DataFrame:
    """Add ``from_lat``/``from_lng``: own coordinates, else those cached for the address."""
    known = geocodes.select(
        F.col("address_norm").alias("_address"), F.col("lat").alias("_g_lat"), F.col("lng").alias("_g_lng")
    )
    own = F.col("location.coords").isNotNull()
    # Rows that need no match get keys of their own that nothing equals, so that they spread over all tasks.
    apart = F.concat(F.lit("\u0000"), F.xxhash64("url").cast("string"))
    keyed = listings.withColumn("_address", F.coalesce(F.when(~own, listing_address()), apart))
    return (
        keyed.join(known, "_address", "left")
        .withColumns(
            {
                "from_lat": F.when(own, F.col("location.coords.lat")).otherwise(F.col("_g_lat")),
                "from_lng": F.when(own, F.col("location.coords.lng")).otherwise(F.col("_g_lng")),
            }
        )
        .drop("_address", "_g_lat", "_g_lng")
    )


def geocode_misses(listings: DataFrame, geocodes: DataFrame) -> DataFrame:
    """Distinct addresses that need a live geocode."""
    asked = listings.filter(F.col("location.coords").isNull()).select(listing_address().alias("address_norm"))
    return asked.filter("address_norm IS NOT NULL").distinct().join(geocodes, "address_norm", "left_anti")


def expand_requests(listings: DataFrame, targets: DataFrame, key: str = "canonical_key", decimals: int = 4) -> DataFrame:
    """One row per listing, target and mode. Targets are configuration rows, attached as one literal array."""
    wanted = [
        F.struct(
            F.lit(t["target"]).alias("target"),
            F.lit(t["weekday"]).alias("weekday"),
            F.lit(t["arrive_by_min"]).cast("int").alias("arrive_by_min"),
            F.lit(mode).alias("mode"),
        )
        for t in targets.select("target", "weekday", "arrive_by_min", "modes").orderBy("target").collect()
        for mode in t["modes"]
    ]
    located = listings.filter("from_lat IS NOT NULL AND from_lng IS NOT NULL").select(
        key,
        quantize(F.col("from_lat"), decimals).alias("lat_q"),
        quantize(F.col("from_lng"), decimals).alias("lng_q"),
    )
    if not wanted:
        return located.limit(0).select(key, "lat_q", "lng_q", *[F.lit("").alias(c) for c in CELL_KEYS[2:]])
    return located.withColumn("r", F.explode(F.array(*wanted))).select(key, "lat_q", "lng_q", "r.*")


def commute_cache(raw: DataFrame, decimals: int = 4) -> DataFrame:
    """Cache rows (lat, lng, target, mode, weekday, arrive_by_min, duration_s, distance_m, computed_at) with
    integer coordinate keys; one row per key, the newest."""
    return (
        raw.withColumns({"lat_q": quantize(F.col("lat"), decimals), "lng_q": quantize(F.col("lng"), decimals)})
        .groupBy(*CELL_KEYS)
        .agg(
            F.max(F.struct("computed_at", "duration_s", "distance_m")).alias("c"),
        )
        .select(*CELL_KEYS, "c.duration_s", "c.distance_m", "c.computed_at")
    )


def commute_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Left equi-join on the six key columns.

    Many listings share one quantised place, so requests are not unique; a hot place is split by AQE, and the
    cache side holds one row per key.
    """
    return requests.join(cache.select(*CELL_KEYS, "duration_s", "distance_m"), CELL_KEYS, "left")


def commute_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct cells that need a live route."""
    return requests.select(*CELL_KEYS).distinct().join(cache, CELL_KEYS, "left_anti")


def assemble_commute(cells: DataFrame, computed_at: Column, key: str = "canonical_key") -> DataFrame:
    """Per listing, target -> mode -> minutes and kilometres; cells without a route are left out."""
    cell = F.struct(
        round_half_up(F.col("duration_s") / 60).cast("int").alias("duration_min"),
        (F.col("distance_m") / F.lit(1000.0)).alias("distance_km"),
        computed_at.cast("timestamp").alias("computed_at"),
    )
    # One group by listing: its cells number targets x modes, fixed by configuration.
    found = (
        cells.filter("duration_s IS NOT NULL")
        .groupBy(key)
        .agg(F.collect_set(F.struct("target", "mode", cell.alias("cell"))).alias("cells"))
    )
    names = F.array_sort(F.array_distinct(F.transform("cells", lambda c: c["target"])))
    by_target = F.transform(
        names,
        lambda t: F.struct(
            t.alias("key"),
            F.map_from_entries(
                F.transform(
                    F.filter(F.col("cells"), lambda c: c["target"] == t),
                    lambda c: F.struct(c["mode"].alias("key"), c["cell"].alias("value")),
                )
            ).alias("value"),
        ),
    )
    return found.select(key, F.map_from_entries(by_target).alias("commute"))


def enrich_commute(
    listings: DataFrame, targets: DataFrame, geocodes: DataFrame, cache: DataFrame, computed_at: Column
) -> DataFrame:
    """Replace ``enriched.commute`` of listings that got at least one cell; others stay as they are."""
    located = geocode_lookup(listings, geocodes)
    usable = target_coords(targets, geocodes)
    cells = commute_lookup(expand_requests(located, usable), cache)
    found = assemble_commute(cells, computed_at).withColumnRenamed("commute", "_commute")
    joined = listings.join(found, "canonical_key", "left")
    commute = F.coalesce("_commute", "enriched.commute")
    return joined.withColumn("enriched", F.col("enriched").withField("commute", commute)).drop("_commute")


def fastest_itinerary(responses: DataFrame) -> DataFrame:
    """Transit responses: shortest duration over ``itineraries`` or ``content.connections``; distance is 0."""
    options = F.coalesce("itineraries", "content.connections")
    best = F.array_min(F.transform(options, lambda o: o["duration"]))
    return responses.withColumns({"duration_s": best.cast("int"), "distance_m": F.when(best.isNotNull(), F.lit(0))})


def first_route(responses: DataFrame) -> DataFrame:
    """Road responses: the first route's rounded summary."""
    summary = F.get(F.col("routes"), 0).getField("summary")
    return responses.withColumns(
        {
            "duration_s": round_half_up(summary.getField("duration")).cast("int"),
            "distance_m": round_half_up(summary.getField("distance")).cast("int"),
        }
    )
