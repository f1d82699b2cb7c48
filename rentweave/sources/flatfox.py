"""Flatfox API pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentweave import schema as S
from rentweave.functions.dates import parse_instant
from rentweave.functions.numbers import leading_number
from rentweave.functions.rental_term import classify_rental_term
from rentweave.functions.urls import absolutise
from rentweave.sources.landing import CORRUPT, read_json, split_malformed

PLUGIN = "source-flatfox"
HOST = "https://flatfox.ch"
RESULT_DDL = (
    "STRUCT<pk: BIGINT, slug: STRING, city: STRING, zipcode: INT, price_display: DOUBLE, number_of_rooms: STRING, "
    "surface_living: DOUBLE, public_title: STRING, short_title: STRING, description: STRING, latitude: DOUBLE, "
    "longitude: DOUBLE, moving_date: STRING, offer_type: STRING, object_category: STRING, object_type: STRING, "
    "agency: STRUCT<name: STRING, name_2: STRING, street: STRING, zipcode: STRING, city: STRING, country: STRING, "
    "logo: STRUCT<url: STRING>, phone: STRING, email: STRING, website: STRING>, images: ARRAY<VARIANT>, url: STRING>"
)
PAGE_DDL = f"results ARRAY<{RESULT_DDL}>, next STRING"


def scan(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows of good pages, and the pages that don't parse, with the ``problem``."""
    whole = F.greatest(F.size("results"), F.lit(0)).cast("string")
    problem = F.when(F.col(CORRUPT).isNotNull(), F.concat(F.lit("malformed page, readable rows: "), whole))
    pages, rejected = split_malformed(read_json(spark, path, PAGE_DDL, multi_line), problem)
    rows = pages.select("file", "position", F.posexplode("results").alias("item", "r"))
    return rows.select("r.*", "file", "position", "item"), rejected


def map_listings(results: DataFrame, *keep: str) -> DataFrame:
    """API results to raw listings."""
    pk = F.col("pk").cast("string")
    path = F.when(F.col("url").startswith("/"), F.col("url")).otherwise(F.concat(F.lit("/en/flat/"), pk, F.lit("/")))
    agency = lambda name: F.col(f"agency.{name}")
    filled = lambda name: F.nullif(agency(name), F.lit(""))
    # An image is a bare URL or an object with original_url; only integers come from the public API.
    photos = F.transform(
        F.coalesce("images", F.array().cast("ARRAY<VARIANT>")),
        lambda v: F.when(
            F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")
        ).otherwise(F.try_variant_get(v, "$.original_url", "string")),
    )
    logo = F.nullif(agency("logo.url"), F.lit(""))
    placed = filled("city").isNotNull() | filled("zipcode").isNotNull() | filled("street").isNotNull()
    lister = [
        ("legal_name", filled("name"), filled("name").isNotNull()),
        ("legal_name_2", filled("name_2"), filled("name_2").isNotNull()),
        ("logo_url", F.when(logo.startswith("http"), logo).otherwise(F.concat(F.lit(HOST), logo)), logo.isNotNull()),
        ("website", filled("website"), filled("website").isNotNull()),
        # Present, possibly null, as soon as any part of the address is known.
        ("address_locality", agency("city"), placed),
    ]
    entries = F.array_compact(
        F.array(*[F.when(when, F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v, when in lister])
    )
    described = results.withColumns(
        {
            "_description": F.coalesce("description", "public_title", "short_title"),
            "_furnished": F.col("object_type") == "FURNISHED_FLAT",
        }
    )
    termed = classify_rental_term(described, F.col("_description"), is_furnished=F.col("_furnished"))
    mapped = termed.select(
        F.concat(F.lit("flatfox:"), pk).alias("id"),
        F.lit("flatfox").alias("source"),
        F.concat(F.lit(HOST), path).alias("url"),
        S.price_of(total=F.col("price_display")).alias("price"),
        leading_number(F.col("number_of_rooms")).alias("rooms"),
        F.col("surface_living").alias("area_m2"),
        S.location_of(
            coords=S.coords_of(F.col("latitude"), F.col("longitude")),
            postal_code=F.col("zipcode").cast("string"),
            city=F.col("city"),
        ).alias("location"),
        F.col("_description").alias("description"),
        F.filter(photos, lambda u: u.isNotNull() & (u != "")).alias("photos"),
        parse_instant(F.col("moving_date")).alias("available_from"),
        "lease_until",
        "rental_term",
        agency("name").alias("agency"),
        S.contact_of(phone=filled("phone"), email=filled("email")).alias("contact"),
        S.enriched_of(lister=F.when(F.size(entries) > 0, F.map_from_entries(entries))).alias("enriched"),
        F.lit(PLUGIN).alias("plugin"),
        *keep,
    )
    return S.conform_raw(mapped, "plugin", *keep)


def cover_photos(listings: DataFrame, pages: DataFrame) -> DataFrame:
    """Listings without photos get the detail page's og:image, when that is an absolute or rooted URL.

    ``pages(url, html)`` holds one landed page per URL.
    """
    raw = F.regexp_extract("html", r'(?i)<meta\s+property="og:image"\s+content="([^"]+)"', 1)
    cover = absolutise(F.replace(raw, F.lit("&amp;"), F.lit("&")), HOST)
    covers = pages.select("url", cover.alias("_cover")).filter("_cover IS NOT NULL")
    bare = F.size("photos") == 0
    return (
        # Listings with photos keep a key that matches no page, so that they spread over all tasks.
        listings.withColumn("_ask", F.when(bare, F.col("url")).otherwise(F.concat(F.lit("\u0000"), "url")))
        .join(covers.withColumnRenamed("url", "_ask"), "_ask", "left")
        .withColumn("photos", F.when(bare & F.col("_cover").isNotNull(), F.array("_cover")).otherwise(F.col("photos")))
        .drop("_ask", "_cover")
    )
