"""Search cards: one per id, then contact gaps filled from detail pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedupe_cards(cards: DataFrame, order: Sequence[str], key: Sequence[str] = ("id",)) -> DataFrame:
    """The first card per key in page order. ``min_by`` combines before the shuffle, so a hot id is cheap."""
    rest = [c for c in cards.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return cards.groupBy(*key).agg(first).select(*key, "_first.*")


def detail_budget(rows: DataFrame, order: Sequence[str], scan: Sequence[str], limit: int = 40) -> DataFrame:
    """Rows that get a detail fetch: the first ``limit`` of each scan in arrival order."""
    turn = Window.partitionBy(*scan).orderBy(*order)
    return rows.withColumn("_turn", F.row_number().over(turn)).filter(F.col("_turn") <= limit).drop("_turn")


def _fill(own: Column, found: Column) -> Column:
    """Own value unless it is absent or empty."""
    return F.when(own.isNull() | (own == ""), F.coalesce(F.nullif(found, F.lit("")), own)).otherwise(own)


LISTER_FILLS = {
    "legal_name": "provider_name",
    "website": "provider_url",
    "inquiry_contact": "inquiry_contact",
    "viewing_contact": "viewing_contact",
}


def merge_detail(rows: DataFrame, details: DataFrame) -> DataFrame:
    """Fill contact, agency and lister gaps from ``details``; nothing else is ever touched.

    ``details`` has one row per ``url`` with phone, email, form_url, provider_name, provider_url,
    inquiry_contact and viewing_contact.
    """
    given = details.select(
        "url",
        F.struct(
            "phone", "email", "form_url", "provider_name", "provider_url", "inquiry_contact", "viewing_contact"
        ).alias("_d"),
    )
    joined = rows.join(given, "url", "left")
    contact = F.col("contact")
    for name in ("phone", "email", "form_url"):
        contact = contact.withField(name, _fill(F.col(f"contact.{name}"), F.col(f"_d.{name}")))
    lister = F.coalesce("enriched.lister", F.create_map().cast("MAP<STRING, STRING>"))
    entries = [
        F.struct(
            F.lit(name).alias("key"),
            _fill(F.try_element_at(lister, F.lit(name)), F.col(f"_d.{found}")).alias("value"),
        )
        for name, found in LISTER_FILLS.items()
    ]
    filled = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
    others = F.filter(F.map_entries(lister), lambda e: ~e["key"].isin(list(LISTER_FILLS)))
    merged = F.concat(others, filled)
    return joined.withColumns(
        {
            "contact": contact,
            "agency": _fill(F.col("agency"), F.col("_d.provider_name")),
            "enriched": F.col("enriched").withField(
                "lister", F.when(F.size(merged) > 0, F.map_from_entries(merged))
            ),
        }
    ).drop("_d")
