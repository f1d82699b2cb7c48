"""Fallback extraction from meta tags and visible text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentweave.functions.numbers import SPACE_CLASS, leading_number, parse_price_like
from rentweave.functions.text import dialect, trim_space

_S = SPACE_CLASS[1:-1]
# The patterns facts are read with.
META_NAME_FIRST = r"""(?i)<meta[^>]+(?:property|name)=["']([^"']+)["'][^>]+content=["']([^"']*)["'][^>]*>"""
META_CONTENT_FIRST = r"""(?i)<meta[^>]+content=["']([^"']*)["'][^>]+(?:property|name)=["']([^"']+)["'][^>]*>"""
SCRIPT = r"(?i)<script(?s:.)*?</script>"
STYLE = r"(?i)<style(?s:.)*?</style>"
PRICE = rf"(?i)(?:CHF|Fr\.?){SPACE_CLASS}?(\d[\d'.,{_S}]{{1,12}})"
# A page without this has no price: a script or style between the currency and the number becomes the one space allowed there.
PRICE_HINT = rf"(?i)(?:CHF|Fr\.?)(?:{SPACE_CLASS}?\d|<script|<style)"
ROOMS = dialect(r"(\d[.,]?\d?)\s*(?:Zimmer|pièces|locali|rooms?|stanze|chambres?)")
AREA = dialect(r"(\d{2,4}(?:[.,]\d+)?)\s*m(?:²|\s*2|q)")
POSTAL_CITY = dialect(r"(?:^|[^\d])(\d{4})\s+([A-ZÄÖÜ][A-Za-zÄÖÜäöüéèêàâîô\- ]{1,40})", ignore_case=False)
STREET = dialect(
    r"\b([A-ZÄÖÜ][A-Za-z0-9_äöüéèêàâôîç-]{2,}"
    r"(?:strasse|gasse|weg|platz|allee|hof|str\.|str|chemin|rue|route|via|viale))\s+(\d+[a-z]?)"
)
MIN_PRICE, MAX_PRICE = 200, 5_000_000
IMAGE_TAGS = ["og:image", "og:image:url", "og:image:secure_url"]


def visible_text(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, SCRIPT, " "), STYLE, " ")


def meta_tags(html: Column) -> Column:
    """(name, content) pairs: tags that name first, then tags that put content first."""

    def pairs(pattern: str, name: int, content: int) -> Column:
        return F.transform(
            F.regexp_extract_all(html, F.lit(pattern), F.lit(0)),
            lambda tag: F.struct(
                F.lower(F.regexp_extract(tag, pattern, name)).alias("name"),
                F.regexp_extract(tag, pattern, content).alias("content"),
            ),
        )

    return F.concat(pairs(META_NAME_FIRST, 1, 2), pairs(META_CONTENT_FIRST, 2, 1))


def _decimal(text: Column) -> Column:
    return leading_number(F.regexp_replace(F.nullif(text, F.lit("")), ",", "."))


def extract_opengraph(pages: DataFrame) -> DataFrame:
    """Add ``og_found`` and ``og``: facts of pages with a plausible price and rooms or area.

    Later patterns run only on pages that have a price. ``og`` is a plain struct, so that taking one field of it
    never evaluates the others.
    """
    staged = pages.withColumn("_visible", F.when(F.col("html").rlike(PRICE_HINT), visible_text(F.col("html"))))
    price_text = F.regexp_extract("_visible", PRICE, 1)
    price = parse_price_like(F.nullif(price_text, F.lit("")))
    staged = staged.withColumn("_price", price)
    plausible = F.col("_price").between(MIN_PRICE, MAX_PRICE)
    text = F.when(plausible, F.col("_visible"))
    staged = staged.withColumns(
        {"_rooms": _decimal(F.regexp_extract(text, ROOMS, 1)), "_area": _decimal(F.regexp_extract(text, AREA, 1))}
    )
    keep = F.col("_rooms").isNotNull() | F.col("_area").isNotNull()
    staged = staged.withColumns(
        {
            "_tags": F.when(keep, meta_tags(F.col("html"))),
            "_visible": F.when(keep, F.col("_visible")),
        }
    )

    def tag(*names: str) -> Column:
        return F.get(F.filter("_tags", lambda t: t["name"].isin(list(names))), 0)["content"]

    images = F.transform(
        F.filter("_tags", lambda t: t["name"].isin(IMAGE_TAGS) & (t["content"] != "")), lambda t: t["content"]
    )
    part = lambda pattern, group: F.nullif(F.regexp_extract("_visible", pattern, group), F.lit(""))
    street = F.concat(part(STREET, 1), F.lit(" "), part(STREET, 2))
    facts = F.struct(
        F.lit("opengraph-regex").alias("tier"),
        tag("og:title").alias("title"),
        tag("og:description", "description").alias("description"),
        F.coalesce(tag("og:url"), F.col("url")).alias("url"),
        images.alias("photos"),
        F.col("_price").alias("price_chf"),
        F.lit("CHF").alias("currency"),
        F.col("_rooms").alias("rooms"),
        F.col("_area").alias("area_m2"),
        street.alias("street"),
        part(POSTAL_CITY, 1).alias("postal_code"),
        trim_space(part(POSTAL_CITY, 2)).alias("city"),
        F.lit(None).cast("string").alias("region"),
        F.lit(None).cast("double").alias("lat"),
        F.lit(None).cast("double").alias("lng"),
    )
    return staged.withColumns({"og_found": keep, "og": facts}).drop("_visible", "_price", "_rooms", "_area", "_tags")
