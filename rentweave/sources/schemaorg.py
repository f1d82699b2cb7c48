"""Agency detail pages: linked data first, meta tags and text as the fallback tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentweave import schema as S
from rentweave.functions.numbers import to_number
from rentweave.functions.plan import keep_where
from rentweave.functions.urls import listing_id_from_url
from rentweave.sources.jsonld import ANCHOR_TYPES, AUX_TYPES, with_nodes
from rentweave.sources.opengraph import extract_opengraph

PLUGIN = "source-schemaorg"


def _rank(kind: Column) -> Column:
    table = F.create_map(*[x for i, t in enumerate(ANCHOR_TYPES) for x in (F.lit(t), F.lit(i))])
    return F.try_element_at(table, kind)


def pick_anchor(nodes: Column) -> Column:
    """Best listing node: by type, then by encounter. Gives (rank, at, node) or null."""
    ranked = F.transform(
        nodes, lambda n, i: F.struct(_rank(n["type"]).alias("rank"), i.alias("at"), n["node"].alias("node"))
    )
    return F.array_min(F.filter(ranked, lambda r: r["rank"].isNotNull()))


def _first(nodes: Column, kinds: list[str], skip_at: Column | None = None) -> Column:
    placed = F.transform(
        nodes, lambda n, i: F.struct(n["type"].alias("type"), i.alias("at"), n["node"].alias("node"))
    )
    keep = lambda n: n["type"].isin(kinds) & ((n["at"] != skip_at) if skip_at is not None else F.lit(True))
    return F.get(F.filter(placed, keep), 0)["node"]


def _texts(node: Column, path: str) -> Column:
    """String members of a text or array value."""
    value = F.get_json_object(node, path)
    listed = F.try_variant_get(F.try_parse_json(value), "$", "ARRAY<VARIANT>")
    strings = F.transform(
        F.filter(listed, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string")
    )
    single = F.when(value.isNotNull() & ~value.rlike(r"^\s*[\[{]"), F.array(value))
    return F.coalesce(strings, single, F.array().cast("ARRAY<STRING>"))


def extract_jsonld(pages: DataFrame) -> DataFrame:
    """Add ``ld_found`` and ``ld``: facts of the page's best listing node, filled from the other nodes of its graph."""
    staged = with_nodes(pages, ANCHOR_TYPES + AUX_TYPES)
    staged = staged.withColumn("_anchor", pick_anchor(F.col("_nodes")))
    flat = _first(F.col("_nodes"), ["Apartment"], F.col("_anchor.at"))
    house = _first(F.col("_nodes"), ["House", "SingleFamilyResidence"])
    staged = staged.withColumns({"_l": F.col("_anchor.node"), "_sup": F.coalesce(flat, house)})
    main = lambda path: F.get_json_object("_l", path)
    sup = lambda path: F.get_json_object("_sup", path)

    # A part is taken whole from the supplementary node when it has one.
    def part(name: str, leaf: str) -> Column:
        return F.when(sup(f"$.{name}").isNotNull(), sup(f"$.{name}.{leaf}")).otherwise(main(f"$.{name}.{leaf}"))

    def priced(kinds: list[str], with_spec: bool) -> Column:
        nodes = F.filter("_nodes", lambda n: n["type"].isin(kinds))

        def price_of(n):
            direct = to_number(F.get_json_object(n["node"], "$.price"))
            own = F.get_json_object(n["node"], "$.priceCurrency")
            if not with_spec:
                return F.struct(direct.alias("p"), own.alias("c"))
            spec = to_number(F.get_json_object(n["node"], "$.priceSpecification.price"))
            theirs = F.get_json_object(n["node"], "$.priceSpecification.priceCurrency")
            return F.struct(
                F.coalesce(direct, spec).alias("p"), F.when(direct.isNotNull(), own).otherwise(theirs).alias("c")
            )

        return F.get(F.filter(F.transform(nodes, price_of), lambda x: x["p"].isNotNull()), 0)

    own_price = to_number(main("$.offers.price"))
    offer, spec = priced(["Offer"], True), priced(["UnitPriceSpecification", "PriceSpecification"], False)
    price = F.coalesce(own_price, offer["p"], spec["p"])
    found = F.when(own_price.isNotNull(), F.lit(None)).when(offer["p"].isNotNull(), offer["c"]).otherwise(spec["c"])
    photos = _texts(F.col("_l"), "$.image")
    facts = F.struct(
        F.lit("jsonld").alias("tier"),
        F.coalesce(main("$.name"), sup("$.name")).alias("title"),
        main("$.description").alias("description"),
        F.col("url").alias("url"),
        F.when(F.size(photos) > 0, photos).otherwise(_texts(F.col("_sup"), "$.image")).alias("photos"),
        price.alias("price_chf"),
        F.coalesce(main("$.offers.priceCurrency"), found, F.lit("CHF")).alias("currency"),
        to_number(F.coalesce(sup("$.numberOfRooms"), main("$.numberOfRooms"))).alias("rooms"),
        to_number(part("floorSize", "value")).alias("area_m2"),
        part("address", "streetAddress").alias("street"),
        part("address", "postalCode").alias("postal_code"),
        part("address", "addressLocality").alias("city"),
        part("address", "addressRegion").alias("region"),
        to_number(part("geo", "latitude")).alias("lat"),
        to_number(part("geo", "longitude")).alias("lng"),
    )
    return staged.withColumns({"ld_found": F.col("_l").isNotNull(), "ld": facts}).drop("_nodes", "_anchor", "_l", "_sup")


FACTS = (
    "tier title description url photos price_chf currency rooms area_m2 street postal_code city region lat lng".split()
)


def extract_listing(pages: DataFrame) -> DataFrame:
    """Pages with a listing, as ``listing``: tier 1 when the page has any listing node, else tier 2; never a mix."""
    linked = extract_jsonld(pages)
    # Tier 2 reads the page only when tier 1 found nothing.
    html = F.col("html")
    tiered = extract_opengraph(linked.withColumn("_html", html).withColumn("html", F.when(~F.col("ld_found"), html)))
    first = F.col("ld_found")
    facts = F.struct(*[F.when(first, F.col(f"ld.{n}")).otherwise(F.col(f"og.{n}")).alias(n) for n in FACTS])
    shaped = tiered.withColumns({"html": F.col("_html"), "listing": facts})
    kept = keep_where(shaped, first | F.col("og_found"))
    return kept.drop("ld", "og", "_html", "ld_found", "og_found")


def map_listings(pages: DataFrame, *keep: str) -> DataFrame:
    """``pages(agency_id, url, html)`` to raw listings; pages without a listing are dropped."""
    found = extract_listing(pages)
    at = lambda name: F.col(f"listing.{name}")
    mapped = found.select(
        F.concat(F.lit("agency:"), "agency_id", F.lit(":"), listing_id_from_url(F.col("url"))).alias("id"),
        F.concat(F.lit("agency:schemaorg:"), "agency_id").alias("source"),
        "url",
        S.price_of(total=at("price_chf"), currency=at("currency")).alias("price"),
        at("rooms").alias("rooms"),
        at("area_m2").alias("area_m2"),
        S.location_of(
            coords=S.coords_of(at("lat"), at("lng")),
            address=at("street"),
            postal_code=at("postal_code"),
            city=at("city"),
            region=at("region"),
        ).alias("location"),
        at("description").alias("description"),
        at("photos").alias("photos"),
        F.col("agency_id").alias("agency"),
        S.enriched_of(attrs=F.create_map(F.lit("extraction_tier"), at("tier"))).alias("enriched"),
        F.lit(PLUGIN).alias("plugin"),
        *keep,
    )
    return S.conform_raw(mapped, "plugin", *keep)
