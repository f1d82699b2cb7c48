"""Number helpers with the rounding and text rules listing keys depend on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a portal pattern counts as white space.
SPACE_CLASS = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def round_half_up(x: Column) -> Column:
    """Nearest integer, halves toward +infinity (built-in ``round`` sends halves away from zero)."""
    return F.floor(x + F.lit(0.5))


def round_rooms_bucket(rooms: Column) -> Column:
    return round_half_up(rooms * 2) / F.lit(2.0)


def round_area_bucket(area: Column) -> Column:
    return round_half_up(area / 5) * F.lit(5.0)


def round_price_bucket(price: Column) -> Column:
    return round_half_up(price / 50) * F.lit(50.0)


def number_text(x: Column) -> Column:
    """Shortest decimal text: ``4`` for 4.0, ``4.5`` for 4.5, never exponent form for ordinary magnitudes."""
    x = x.cast("double")
    plain = F.abs(x).between(1e-3, 9999999.0)
    wide = F.regexp_replace(x.cast("decimal(38,12)").cast("string"), r"0+$", "")
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when((x == F.floor(x)) & (F.abs(x) < 1e18), x.cast("bigint").cast("string"))
        .when(plain, x.cast("string"))
        .otherwise(wide)
    )


def to_number(text: Column) -> Column:
    """Finite number or null. Blank text is 0, as in JavaScript's ``Number('')``."""
    trimmed = F.regexp_replace(text.cast("string"), rf"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")
    numeric = F.when(trimmed.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), trimmed.try_cast("double"))
    value = F.when(trimmed == "", F.lit(0.0)).otherwise(numeric)
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def leading_number(text: Column) -> Column:
    """Numeric prefix of a text (``3.5abc`` -> 3.5) or null."""
    head = F.regexp_extract(text, rf"^{SPACE_CLASS}*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.nullif(head, F.lit("")).try_cast("double")


def parse_price_like(text: Column) -> Column:
    """Price text to number: separators dropped; a trailing 1-2 digit group is the decimals."""
    cleaned = F.regexp_replace(text, rf"({SPACE_CLASS}|')", "")
    simple = r"^(\d+)(?:[.,](\d{1,2}))?\z"
    whole = F.regexp_extract(cleaned, simple, 1)
    decimals = F.regexp_extract(cleaned, simple, 2)
    fraction = F.when(decimals == "", F.lit(0.0)).otherwise(
        decimals.try_cast("double") / F.pow(F.lit(10.0), F.length(decimals))
    )
    digits = F.regexp_replace(cleaned, r"[^\d]", "")
    return F.when(whole != "", whole.try_cast("double") + fraction).otherwise(
        F.nullif(digits, F.lit("")).try_cast("double")
    )


def quantize(x: Column, decimals: int = 4) -> Column:
    """Coordinate scaled by 10^decimals as BIGINT, so that it can be an exact join key."""
    return round_half_up(x * F.lit(float(10**decimals))).cast("bigint")
