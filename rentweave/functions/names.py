"""Guessing a .ch host from an agency's legal name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentweave.functions.text import strip_accents

# Company forms, and trade words that rarely reach the domain.
ENTITY_SUFFIXES = "ag gmbh sa sarl srl gbr kg co company inc llc ltd limited".split()
TRADE_WORDS = (
    "immobilien immobiliare immobilier immobilière immobile real estate group bewirtschaftung verwaltung "
    "verwaltungs verwaltungsag management invest investment investments partners service services consulting "
    "beratung beratungs"
).split()


def name_tokens(name: Column) -> Column:
    text = F.lower(strip_accents(name))
    text = F.regexp_replace(F.replace(text, F.lit("&"), F.lit(" and ")), "['’`]", "")
    return F.filter(F.split(F.regexp_replace(text, "[^a-z0-9]+", " "), " "), lambda t: t != "")


def candidate_domains(name: Column) -> Column:
    """Distinct hosts to try, most specific first; empty when only company forms remain."""
    tokens = F.filter(name_tokens(name), lambda t: ~t.isin(ENTITY_SUFFIXES))
    telling = F.filter(tokens, lambda t: ~t.isin(TRADE_WORDS))
    many = F.size(telling) >= 2
    ladder = F.array(
        F.when(many, F.array_join(telling, "-")),
        F.when(many, F.array_join(F.slice(telling, 1, 2), "-")),
        F.get(telling, 0),
        F.get(tokens, 0),
    )
    return F.transform(F.array_distinct(F.array_compact(ladder)), lambda s: F.concat(s, F.lit(".ch")))
