"""Realadvisor result pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentweave import schema as S
from rentweave.functions.numbers import number_text
from rentweave.functions.text import slugify
from rentweave.sources.landing import CORRUPT, read_json, split_malformed

PLUGIN = "source-realadvisor"
HIT_DDL = (
    "STRUCT<id: STRING, portal: STRING, description: STRING, number_of_rooms: DOUBLE, living_surface: DOUBLE, "
    "usable_surface: DOUBLE, computed_surface: DOUBLE, gross_rent_monthly: DOUBLE, rent_net_monthly: DOUBLE, "
    "rent_extra: DOUBLE, sale_price: DOUBLE, currency: STRING, address: STRING, postcode: STRING, locality: STRING, "
    "sub_locality: STRING, state: STRING, lat: DOUBLE, lng: DOUBLE, construction_year: DOUBLE, "
    "renovation_year: DOUBLE, created_at: STRING, agency_name: STRING, agency_logo_url: STRING, "
    "agency_contact_phone_number: STRING, agency_contact_address: STRING, agency_rating: DOUBLE, "
    "agency_reviews_count: DOUBLE, visit_contact_phone_number: STRING, visit_contact_person: STRING>"
)
PAGE_DDL = f"listings ARRAY<{HIT_DDL}>"
RENT_URL = "https://realadvisor.ch/en/rent/"


def scan(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows of good pages, and the pages that don't parse, with the ``problem``."""
    whole = F.greatest(F.size("listings"), F.lit(0)).cast("string")
    problem = F.when(F.col(CORRUPT).isNotNull(), F.concat(F.lit("malformed page, readable rows: "), whole))
    pages, rejected = split_malformed(read_json(spark, path, PAGE_DDL, multi_line), problem)
    rows = pages.select("file", "position", F.posexplode("listings").alias("item", "h"))
    return rows.select("h.*", "file", "position", "item"), rejected


def map_listings(hits: DataFrame, *keep: str) -> DataFrame:
    """Hits to raw listings. The portal has no stable page per listing: hits of one locality share its URL."""
    postcode, locality = F.nullif("postcode", F.lit("")), F.nullif("locality", F.lit(""))
    place = F.concat(postcode, F.lit("-"), slugify(locality))
    mapped = hits.filter(F.col("id").isNotNull() & (F.col("id") != "")).select(
        F.concat(F.lit("realadvisor:"), "id").alias("id"),
        F.lit("source-realadvisor").alias("source"),
        F.concat(F.lit(RENT_URL), F.coalesce(place, F.lit("canton-zurich")), F.lit("/apartment")).alias("url"),
        S.price_of(
            rent_net=F.col("rent_net_monthly"),
            extras=F.col("rent_extra"),
            total=F.coalesce("gross_rent_monthly", "sale_price"),
            currency=F.coalesce("currency", F.lit("CHF")),
        ).alias("price"),
        F.col("number_of_rooms").alias("rooms"),
        F.coalesce("living_surface", "usable_surface", "computed_surface").alias("area_m2"),
        F.col("construction_year").alias("built_year"),
        F.col("renovation_year").alias("renovated_year"),
        S.location_of(
            coords=S.coords_of(F.col("lat"), F.col("lng")),
            address=F.col("address"),
            postal_code=F.col("postcode"),
            city=F.col("locality"),
            region=F.col("state"),
            neighborhood=F.col("sub_locality"),
        ).alias("location"),
        "description",
        F.col("agency_name").alias("agency"),
        S.contact_of(
            phone=F.nullif(F.coalesce("agency_contact_phone_number", "visit_contact_phone_number"), F.lit(""))
        ).alias("contact"),
        S.enriched_of(
            lister=S.sparse_map(
                legal_name=F.col("agency_name"),
                logo_url=F.col("agency_logo_url"),
                address_locality=F.col("agency_contact_address"),
                viewing_contact=F.col("visit_contact_person"),
                rating=number_text(F.col("agency_rating")),
                reviews_count=number_text(F.col("agency_reviews_count")),
            )
        ).alias("enriched"),
        F.create_map(F.lit("realadvisor_hit_id"), F.col("id"), F.lit("portal"), F.col("portal")).alias("extra"),
        F.lit(PLUGIN).alias("plugin"),
        *keep,
    )
    return S.conform_raw(mapped, "plugin", *keep)
