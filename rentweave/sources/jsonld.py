"""Linked-data blocks in HTML pages.

Blocks are cut out and walked by column functions. VARIANT keeps object keys sorted, so it only tells what kind a value is; the order of
encounter, which ties depend on, comes from the members of an object as a map of texts, which stay as written. Every node
has the places on the way to it (`pos`), and sorting by them gives the depth-first order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentweave import schema as S
from rentweave.functions.numbers import to_number
from rentweave.functions.paths import nesting
from rentweave.functions.plan import keep_where
from rentweave.functions.text import html_entity_decode
from rentweave.functions.urls import listing_id_from_url

LD_BLOCK = r"""(?i)<script[^>]+type=["']application/ld\+json["'][^>]*>((?s:.)*?)</script>"""
# Node types a listing can be anchored on, best first, and the auxiliary types.
ANCHOR_TYPES = ["RealEstateListing", "Apartment", "House", "SingleFamilyResidence", "Residence", "Accommodation"]
AUX_TYPES = ["Offer", "UnitPriceSpecification", "PriceSpecification", "PostalAddress", "GeoCoordinates"]
DETAIL_TYPES = ["RealEstateListing", "Apartment", "House", "Residence"]
# Kinds of VARIANT values that are numbers.
NUMBERS = r"^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)"
NODE_DDL = "STRUCT<pos: ARRAY<INT>, text: STRING>"
FOUND_DDL = "STRUCT<pos: ARRAY<INT>, type: STRING, node: STRING>"


def lenient_json(spark: SparkSession) -> None:
    """An object may name a key twice; the last value counts, as in other JSON readers."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def whole_json(text: Column) -> Column:
    """Whether a text is one JSON value with nothing behind it."""
    return F.coalesce(F.size(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "ARRAY<VARIANT>")) == 1, F.lit(False))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def _is_container(v: Column) -> Column:
    return F.schema_of_variant(v).rlike("^(?:OBJECT|ARRAY)")


def _members(node: Column) -> Column:
    """Objects and arrays directly inside an object or array, in order."""

    def place(key: Column, i: Column) -> Column:
        # Keys that are whole numbers come first, by size.
        return F.when(key.rlike("^(?:0|[1-9][0-9]{0,8})$"), key.try_cast("int") - 1_000_000_000).otherwise(i)

    def of_object(parts: Column) -> Column:
        def member(key: Column, i: Column) -> Column:
            same = F.filter(parts["entries"], lambda e: e["key"] == key)
            text = F.element_at(same, -1)["value"]
            held = F.coalesce(_is_container(F.try_element_at(parts["kinds"], key)), F.lit(False))
            return F.when(held, F.struct(F.concat(node["pos"], F.array(place(key, i))).alias("pos"), text.alias("text")))

        return F.transform(F.array_distinct(F.transform(parts["entries"], lambda e: e["key"])), member)

    def of_array(parts: Column) -> Column:
        def member(text: Column, i: Column) -> Column:
            return F.when(_is_container(F.get(parts["kinds"], i)), F.struct(F.concat(node["pos"], F.array(i)).alias("pos"), text.alias("text")))

        return F.transform(parts["texts"], member)

    v = F.try_parse_json(node["text"])
    entries = F.map_entries(F.from_json(node["text"], "MAP<STRING, STRING>"))
    members = F.struct(entries.alias("entries"), F.try_variant_get(v, "$", "MAP<STRING, VARIANT>").alias("kinds"))
    items = F.struct(F.from_json(node["text"], "ARRAY<STRING>").alias("texts"), F.try_variant_get(v, "$", "ARRAY<VARIANT>").alias("kinds"))
    inside = F.when(F.ltrim(node["text"]).startswith("{"), _bound(members, of_object)).otherwise(_bound(items, of_array))
    return F.coalesce(F.array_compact(inside), F.array().cast(f"ARRAY<{NODE_DDL}>"))


def walk_json(texts: Column, label: Callable[[Column], Column]) -> Column:
    """Objects of an array of JSON texts that ``label(text)`` gives a type, as (pos, type, node), depth first; the first
    place in ``pos`` is that of the text. Texts that do not parse are ignored."""
    roots = F.transform(texts, lambda t, i: F.struct(F.array(i).alias("pos"), t.alias("text")))
    roots = F.filter(roots, lambda n: whole_json(n["text"]))
    depth = F.array_max(F.transform(texts, nesting))

    def step(state: Column, _: Column) -> Column:
        hits = F.transform(state["open"], lambda n: F.struct(n["pos"].alias("pos"), label(n["text"]).alias("type"), n["text"].alias("node")))
        found = F.concat(state["found"], F.filter(hits, lambda h: h["type"].isNotNull()))
        return F.struct(F.flatten(F.transform(state["open"], _members)).alias("open"), found.cast(f"ARRAY<{FOUND_DDL}>").alias("found"))

    start = F.struct(roots.cast(f"ARRAY<{NODE_DDL}>").alias("open"), F.array().cast(f"ARRAY<{FOUND_DDL}>").alias("found"))
    rounds = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("ARRAY<INT>"))
    return F.array_sort(F.aggregate(rounds, start, step, lambda s: s["found"]))


def walk_jsonld(blocks: Column, types: list[str]) -> Column:
    """Typed nodes of a page's blocks in order of encounter, as (block, type, node)."""

    def label(text: Column) -> Column:
        # Cheap look at the text first: most nodes have none of the types.
        kind = _bound(F.try_variant_get(F.try_parse_json(text), "$['@type']", "variant"), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
        return F.when(text.contains("@type") & kind.isin(types), kind)

    nodes = walk_json(blocks, label)
    return F.transform(nodes, lambda n: F.struct(F.get(n["pos"], 0).alias("block"), n["type"].alias("type"), n["node"].alias("node")))


def lower_first(text: Column) -> Column:
    """Keys of a JSON text to lower camel case. A key is a string behind ``{`` or ``,`` and before a colon."""
    pieces = F.split(text, r'(?<=[{,]\s{0,64}")(?=\p{Lu}[^"\\]*"\s*:)')
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i > 0, F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))).otherwise(p)), "")


def last_typed_node(nodes: Column) -> Column:
    """Last node of the first block that has one."""
    first = F.get(nodes, 0)["block"]
    inside = F.filter(nodes, lambda n: n["block"] == first)
    return F.get(inside, F.size(inside) - 1)["node"]


def first_shaped_node(root: Column) -> Column:
    """First object that looks like a listing: numeric rooms or price fields."""

    def label(text: Column) -> Column:
        def shaped(v: Column) -> Column:
            number = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")).rlike(NUMBERS), F.lit(False))
            either = number("numberOfRooms") | number("rooms") | number("priceUnformatted")
            return F.when(either | (number("grossPrice") & number("surfaceLiving")), F.lit("listing"))

        names = "[rR]ooms|priceUnformatted|grossPrice"
        return F.when(text.rlike(names), _bound(F.try_parse_json(text), shaped))

    nodes = walk_json(F.when(root.isNotNull(), F.array(root)).otherwise(F.array().cast("ARRAY<STRING>")), label)
    return F.get(nodes, 0)["node"]


def blocks_of(html: Column) -> Column:
    """Linked-data blocks; pages without any give an empty array."""
    cut = F.regexp_extract_all(html, F.lit(LD_BLOCK), F.lit(1))
    return F.when(html.contains("ld+json"), cut).otherwise(F.array().cast("ARRAY<STRING>"))


def with_nodes(pages: DataFrame, types: list[str], out: str = "_nodes") -> DataFrame:
    """Add the typed nodes of ``html``."""
    lenient_json(pages.sparkSession)
    return pages.withColumn(out, walk_jsonld(blocks_of(F.col("html")), types))


def flatten_images(node: Column, path: str = "$.image") -> Column:
    """Absolute http(s) URLs of an ``image`` value: text, {url}, {contentUrl}, or arrays of these."""
    text = F.get_json_object(node, path)
    parsed = F.try_parse_json(text)
    many = F.try_variant_get(parsed, "$", "ARRAY<VARIANT>")
    single = F.when(parsed.isNotNull(), F.array(parsed))
    items = F.coalesce(many, single)
    pick = lambda v: F.coalesce(
        F.try_variant_get(v, "$.url", "string"),
        F.try_variant_get(v, "$.contentUrl", "string"),
        F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")),
    )
    urls = F.when(text.rlike(r"^(?i)https?://"), F.array(text)).otherwise(F.transform(items, pick))
    return F.coalesce(F.filter(urls, lambda u: u.rlike(r"^(?i)https?://")), F.array().cast("ARRAY<STRING>"))


IMMOBILIER_PLUGIN = "source-immobilier-ch"


def scan_product_pages(pages: DataFrame, *keep: str) -> DataFrame:
    """``pages(url, html)`` whose linked data is a Product and a Residence (the last of each) to raw listings.

    Text in the blocks is entity-escaped and keys are in Pascal case; pages without a Product are dropped.
    """
    staged = pages.filter(F.col("html").contains("ld+json")).withColumn("_blocks", blocks_of(F.col("html")))
    # Decode once per block, before parsing, as the escapes sit inside JSON text.
    joined = F.array_join("_blocks", "\u0000")
    staged = staged.withColumn("_blocks", F.split(html_entity_decode(joined), "\u0000"))
    lenient_json(pages.sparkSession)
    lowered = F.transform("_blocks", lower_first)
    staged = staged.withColumn("_nodes", walk_jsonld(lowered, ["Product", "Residence"]))

    def last(kind: str) -> Column:
        hits = F.filter("_nodes", lambda n: n["type"] == kind)
        return F.get(F.transform(hits, lambda n: n["node"]), F.size(hits) - 1)

    staged = staged.withColumns({"_p": last("Product"), "_r": last("Residence")})
    staged = keep_where(staged, F.col("_p").isNotNull())
    product = lambda path: F.get_json_object("_p", path)
    residence = lambda path: F.get_json_object("_r", path)
    mapped = staged.select(
        F.concat(F.lit("immobilier-ch:"), listing_id_from_url(F.col("url"), trailing_segment=False)).alias("id"),
        F.lit(IMMOBILIER_PLUGIN).alias("source"),
        "url",
        S.price_of(
            total=to_number(product("$.offers.price")),
            currency=F.coalesce(product("$.offers.priceCurrency"), F.lit("CHF")),
        ).alias("price"),
        to_number(residence("$.numberOfRooms")).alias("rooms"),
        to_number(residence("$.floorSize.value")).alias("area_m2"),
        S.location_of(
            address=residence("$.address.streetAddress"),
            postal_code=residence("$.address.postalCode"),
            city=residence("$.address.addressLocality"),
        ).alias("location"),
        product("$.description").alias("description"),
        flatten_images(F.col("_p")).alias("photos"),
        F.lit(IMMOBILIER_PLUGIN).alias("plugin"),
        *keep,
    )
    return S.conform_raw(mapped, "plugin", *keep)
