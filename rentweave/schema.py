"""Canonical listing schema.

A *raw* listing is what a source mapper emits; a *listing* is the merged row keyed by ``canonical_key``.
Open maps hold JSON text. ``enriched`` is split into typed parts so that it can cross a shuffle:

* ``external_ids`` source -> portal id
* ``lister``       agency facts, one text per key
* ``cross_listed_on`` portals named by the source itself
* ``attrs``        any other scalar, keyed by dotted path
* ``commute``      target -> mode -> cell
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE_DDL = "STRUCT<rent_net: DOUBLE, extras: DOUBLE, total: DOUBLE, currency: STRING, deposit_months: DOUBLE>"
LOCATION_DDL = (
    "STRUCT<coords: STRUCT<lng: DOUBLE, lat: DOUBLE>, address: STRING, postal_code: STRING, city: STRING, "
    "region: STRING, country: STRING, neighborhood: STRING>"
)
CONTACT_DDL = "STRUCT<email: STRING, phone: STRING, form_url: STRING>"
COMMUTE_DDL = (
    "MAP<STRING, MAP<STRING, STRUCT<duration_min: INT, distance_km: DOUBLE, computed_at: TIMESTAMP>>>"
)
ENRICHED_DDL = (
    "STRUCT<external_ids: MAP<STRING, STRING>, lister: MAP<STRING, STRING>, cross_listed_on: ARRAY<STRING>, "
    f"attrs: MAP<STRING, STRING>, commute: {COMMUTE_DDL}>"
)

RAW_FIELDS: list[tuple[str, str]] = [
    ("id", "STRING"),
    ("source", "STRING"),
    ("url", "STRING"),
    ("price", PRICE_DDL),
    ("rooms", "DOUBLE"),
    ("area_m2", "DOUBLE"),
    ("floor", "DOUBLE"),
    ("total_floors", "DOUBLE"),
    ("built_year", "DOUBLE"),
    ("renovated_year", "DOUBLE"),
    ("location", LOCATION_DDL),
    ("features", "MAP<STRING, STRING>"),
    ("description", "STRING"),
    ("photos", "ARRAY<STRING>"),
    ("available_from", "TIMESTAMP"),
    ("lease_until", "TIMESTAMP"),
    ("rental_term", "STRING"),
    ("agency", "STRING"),
    ("contact", CONTACT_DDL),
    ("enriched", ENRICHED_DDL),
    ("extra", "MAP<STRING, STRING>"),
]
RAW_DDL = ", ".join(f"{name} {ddl}" for name, ddl in RAW_FIELDS)

# Pipeline columns stamped around a raw listing: who sent it, how much it is trusted, when it was seen.
STAMP_FIELDS: list[tuple[str, str]] = [
    ("plugin", "STRING"),
    ("source_priority", "INT"),
    ("first_seen_at", "TIMESTAMP"),
    ("last_seen_at", "TIMESTAMP"),
    ("canonical_key", "STRING"),
    ("seen_on_sources", "ARRAY<STRING>"),
]
LISTING_FIELDS = RAW_FIELDS + STAMP_FIELDS[1:]
LISTING_DDL = ", ".join(f"{name} {ddl}" for name, ddl in LISTING_FIELDS)


@lru_cache(maxsize=None)
def _type_of(ddl: str) -> T.DataType:
    return T._parse_datatype_string(ddl)


def null_of(ddl: str) -> Column:
    return F.lit(None).cast(ddl)


def struct_of(ddl: str, **fields: Column) -> Column:
    """Build a struct of the given type; fields not named are null."""
    kind = _type_of(ddl)
    return F.struct(
        *[
            fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in kind.fields
        ]
    )


def price_of(**fields: Column) -> Column:
    fields.setdefault("currency", F.lit("CHF"))
    return struct_of(PRICE_DDL, **fields)


def location_of(**fields: Column) -> Column:
    fields.setdefault("country", F.lit("CH"))
    return struct_of(LOCATION_DDL, **fields)


def contact_of(**fields: Column) -> Column:
    return struct_of(CONTACT_DDL, **fields)


def enriched_of(**fields: Column) -> Column:
    return struct_of(ENRICHED_DDL, **fields)


def coords_of(lat: Column, lng: Column) -> Column:
    """Both coordinates or none."""
    return F.when(
        lat.isNotNull() & lng.isNotNull(), F.struct(lng.alias("lng"), lat.alias("lat"))
    )


def sparse_map(**fields: Column) -> Column:
    """Map of the fields that are non-null and non-empty; null when none is (JS truthiness on strings)."""
    entries = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in fields.items()]
    kept = F.filter(F.array(*entries), lambda e: e["value"].isNotNull() & (e["value"] != ""))
    return F.when(F.size(kept) > 0, F.map_from_entries(kept))


def conform_raw(df: DataFrame, *keep: str) -> DataFrame:
    """Project a mapper's output on the canonical raw schema, filling absent columns, keeping ``keep`` as is."""
    have = set(df.columns)
    defaults = {
        "rental_term": F.lit("unknown"),
        "photos": F.array().cast("ARRAY<STRING>"),
        "price": price_of(),
        "location": location_of(),
        "contact": contact_of(),
        "enriched": enriched_of(),
    }
    out = []
    for name, ddl in RAW_FIELDS:
        value = F.col(name) if name in have else F.lit(None)
        if name in defaults:
            value = F.coalesce(value, defaults[name]) if name in have else defaults[name]
        out.append(value.cast(_type_of(ddl)).alias(name))
    return df.select(*out, *keep)
