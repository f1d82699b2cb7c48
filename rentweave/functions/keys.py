"""Canonical key: rows whose facts fall in the same buckets are the same flat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentweave.functions.numbers import round_half_up


def _halves_text(n: Column) -> Column:
    """Text of n/2 for a whole n: buckets are whole or end in .5, so no general number formatting is needed."""
    sign = F.when(n < 0, F.lit("-")).otherwise(F.lit(""))
    whole = F.floor(F.abs(n) / F.lit(2)).cast("string")
    return F.concat(sign, whole, F.when(n % 2 == 0, F.lit("")).otherwise(F.lit(".5")))


def key_material(
    postal_code: Column, rooms: Column, area: Column, price_total: Column, url: Column
) -> Column:
    """Text the key is hashed from. Any missing fact falls back to the URL, so partial rows never collapse."""
    # Concatenation is null as soon as one part is.
    bucketed = F.concat(
        postal_code,
        F.lit("|"),
        _halves_text(round_half_up(rooms * 2)),
        F.lit("|"),
        (round_half_up(area / 5) * 5).cast("string"),
        F.lit("|"),
        (round_half_up(price_total / 50) * 50).cast("string"),
    )
    return F.coalesce(bucketed, F.concat(F.lit("url:"), url))


def canonical_key(
    postal_code: Column, rooms: Column, area: Column, price_total: Column, url: Column
) -> Column:
    return F.sha2(key_material(postal_code, rooms, area, price_total, url), 256)


def listing_key() -> Column:
    """The key of a row in the canonical raw schema."""
    return canonical_key(
        F.col("location.postal_code"),
        F.col("rooms"),
        F.col("area_m2"),
        F.col("price.total"),
        F.col("url"),
    )
