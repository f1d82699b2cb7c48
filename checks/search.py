"""Client-side criteria, allow-lists, portal-side search and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import ARRIVAL, RAW_SQL, raw_listings, table, with_sql
from rentweave.functions.geo import haversine_m
from rentweave.operators import search as Q


def api_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Portal rows before mapping, with every null case and an unparseable rooms text."""
    line = table(spark, sf, "lineitem")
    no, q = F.col("l_linenumber"), F.col("l_quantity")
    return line.select(
        *ARRIVAL,
        F.when(no != 1, F.concat(F.lit("City"), (F.col("l_partkey") % 6).cast("string"))).alias("city"),
        F.when(no != 2, (8000 + F.col("l_partkey") % 20).cast("int")).alias("zipcode"),
        F.when(no != 3, 1000 + q * 40).alias("price_display"),
        F.when(no == 4, F.lit("n/a"))
        .when(no == 5, F.lit(None))
        .otherwise(F.concat((F.col("l_suppkey") % 6).cast("string"), F.lit(".5 Zi")))
        .alias("number_of_rooms"),
        F.when(no != 6, 30 + q).alias("surface_living"),
        F.when(no != 7, F.when(F.col("l_suppkey") % 4 == 0, "SALE").otherwise("RENT")).alias("offer_type"),
        F.when(no != 1, F.when(F.col("l_suppkey") % 7 == 0, "HOUSE").otherwise("APARTMENT")).alias("object_category"),
        F.when(no != 2, 47.3 + (F.col("l_suppkey") % 100) / 500.0).alias("latitude"),
        F.when(no != 2, 8.4 + (F.col("l_partkey") % 100) / 500.0).alias("longitude"),
    )


API_SQL = """
api AS (
  SELECT *, CASE WHEN l_linenumber <> 1 THEN 'City' || CAST(l_partkey % 6 AS VARCHAR) END AS city,
    CASE WHEN l_linenumber <> 2 THEN CAST(8000 + l_partkey % 20 AS VARCHAR) END AS zipcode,
    CASE WHEN l_linenumber <> 3 THEN 1000 + l_quantity * 40 END AS price_display,
    CASE WHEN l_linenumber = 5 THEN 0.0::DOUBLE WHEN l_linenumber = 4 THEN NULL
      ELSE CAST(l_suppkey % 6 AS DOUBLE) + 0.5::DOUBLE END AS rooms_or_nan,
    CASE WHEN l_linenumber <> 6 THEN 30 + l_quantity END AS surface_living,
    CASE WHEN l_linenumber <> 7 THEN CASE WHEN l_suppkey % 4 = 0 THEN 'SALE' ELSE 'RENT' END END AS offer_type,
    CASE WHEN l_linenumber <> 1 THEN CASE WHEN l_suppkey % 7 = 0 THEN 'HOUSE' ELSE 'APARTMENT' END END AS object_category,
    CASE WHEN l_linenumber <> 2 THEN 47.3::DOUBLE + CAST(l_suppkey % 100 AS DOUBLE) / 500.0::DOUBLE END AS latitude,
    CASE WHEN l_linenumber <> 2 THEN 8.4::DOUBLE + CAST(l_partkey % 100 AS DOUBLE) / 500.0::DOUBLE END AS longitude
  FROM lineitem
)"""
KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity"
_K = KEYS.split(", ")


def client_filters(spark: SparkSession, sf: str) -> DataFrame:
    c = Q.ClientCriteria(
        cities=["City0", "City1", "City2", "City3"], price_max=2600, price_min=1100, rooms_min=1.5, rooms_max=4.5, surface_min=20
    )
    return Q.client_filters(api_rows(spark, sf), c).select(*_K)


CLIENT_FILTERS = with_sql(
    API_SQL,
    select=f"""SELECT {KEYS} FROM api WHERE (city IS NULL OR city IN ('City0','City1','City2','City3'))
  AND price_display IS NOT NULL AND price_display <= 2600 AND price_display >= 1100
  AND (rooms_or_nan IS NULL OR (rooms_or_nan >= 1.5 AND rooms_or_nan <= 4.5)) AND coalesce(surface_living, 0) >= 20
  AND coalesce(offer_type, 'RENT') = 'RENT' AND coalesce(object_category, 'APARTMENT') = 'APARTMENT'""",
)


def client_filters_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """A null price passes a minimum and a null zip fails an allow-list."""
    c = Q.ClientCriteria(zipcodes=["8001", "8002", "8003"], price_min=1500, offer_type="", category="")
    return Q.client_filters(api_rows(spark, sf), c).select(*_K)


CLIENT_FILTERS_NULLS = with_sql(
    API_SQL,
    select=f"SELECT {KEYS} FROM api WHERE zipcode IN ('8001','8002','8003') AND (price_display IS NULL OR price_display >= 1500)",
)
_HAV = """(2 * 6371000.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(power(sin(radians(latitude - 47.38) / 2), 2)
  + cos(radians(47.38)) * cos(radians(latitude)) * power(sin(radians(longitude - 8.5) / 2), 2)))))"""


def near_radius(spark: SparkSession, sf: str) -> DataFrame:
    c = Q.ClientCriteria(offer_type="", category="", near=(47.38, 8.5, 4000))
    hits = Q.client_filters(api_rows(spark, sf), c)
    metres = F.round(haversine_m(F.col("latitude"), F.col("longitude"), 47.38, 8.5), 3)
    return hits.select(*_K, metres.alias("metres"))


NEAR_RADIUS = with_sql(
    API_SQL, select=f"SELECT {KEYS}, round({_HAV}, 3) AS metres FROM api WHERE latitude IS NOT NULL AND {_HAV} <= 4000"
)


def zip_allowlist(spark: SparkSession, sf: str) -> DataFrame:
    return Q.zip_allowlist(raw_listings(spark, sf), ["8004", "8010", "8032"]).select("url")


def region_filter(spark: SparkSession, sf: str) -> DataFrame:
    region = Q.Region(postal_codes=["8003"], cities=["city7"], cantons=["zg"])
    return Q.region_filter(raw_listings(spark, sf), region).select("url")


def search_page(spark: SparkSession, sf: str) -> DataFrame:
    c = Q.SearchCriteria(
        zipcodes=[str(8000 + i) for i in range(1, 26)],
        price_min=1100,
        price_max=2500,
        rooms_min=2,
        surface_min=50,
        sort_by="price",
        sort_direction="asc",
        page_size=20,
        pages=5,
        first_page=1,
    )
    return Q.search_criteria(raw_listings(spark, sf), c).select("url", F.col("price.total").alias("total"))


SEARCH_PAGE = with_sql(
    RAW_SQL,
    select="""SELECT url, price_total AS total FROM raw_listings WHERE p_size BETWEEN 1 AND 25
  AND price_total BETWEEN 1100 AND 2500 AND rooms >= 2 AND area_m2 >= 50
  ORDER BY price_total, url LIMIT 100 OFFSET 20""",
)


def url_filters(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select(F.col("url").alias("loc"), "page_id")
    kept = Q.url_include(pages, ["/de/", "/fr/"])
    return Q.detail_url_pattern(kept, r"^https?://(www\.|blog\.)").select("page_id", "loc")


URL_FILTERS = r"""SELECT page_id, url AS loc FROM pages
WHERE (contains(url, '/de/') OR contains(url, '/fr/')) AND regexp_matches(url, '^https?://(www\.|blog\.)')"""

QUERIES = {
    "client_filters": (client_filters, CLIENT_FILTERS),
    "client_filters_nulls": (client_filters_nulls, CLIENT_FILTERS_NULLS),
    "near_radius": (near_radius, NEAR_RADIUS),
    "zip_allowlist": (
        zip_allowlist,
        with_sql(RAW_SQL, select="SELECT url FROM raw_listings WHERE postal_code IN ('8004','8010','8032')"),
    ),
    "region_filter": (
        region_filter,
        with_sql(
            RAW_SQL, select="SELECT url FROM raw_listings WHERE postal_code = '8003' OR city = 'City7' OR region = 'ZG'"
        ),
    ),
    "search_criteria": (search_page, SEARCH_PAGE),
    "url_filters": (url_filters, URL_FILTERS),
}
