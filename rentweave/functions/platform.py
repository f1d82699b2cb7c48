"""Site platform from page HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentweave.functions.text import dialect

# Platform fingerprints in the order they are tried.
IMMOMIG = [r"""<meta\s+name=["']generator["']\s+content=["'][^"']*ImmoMig""", r"\/ig\.fcgi"]
CASASOFT = [r"casasoft\.ch", r"\/api\/PropertySearch"]
IFRAME_PORTAL = [r"""<iframe[^>]+src=["'][^"']*(?:homegate|immoscout24)\.ch"""]
SCHEMAORG = [
    r"""<script[^>]+type=["']application\/ld\+json["'][^>]*>[\s\S]*?@type["']?\s*:\s*["']"""
    r"""(?:RealEstateListing|Apartment|House|Residence|SingleFamilyResidence|Accommodation)["']"""
]
HEURISTICS = [
    ("immomig", IMMOMIG, ["generator", "ig.fcgi"]),
    ("casasoft", CASASOFT, ["casasoft.ch", "propertysearch"]),
    ("iframe-portal", IFRAME_PORTAL, ["<iframe"]),
    ("schemaorg", SCHEMAORG, ["ld+json"]),
]


def classify_platform(html: Column) -> Column:
    """Platform name, or null when nothing matches. A byte search spares the regex on most pages."""
    low = F.lower(html)
    chain = None
    for platform, patterns, words in HEURISTICS:
        worth = low.contains(words[0])
        for word in words[1:]:
            worth = worth | low.contains(word)
        hit = html.rlike(dialect(patterns[0]))
        for pattern in patterns[1:]:
            hit = hit | html.rlike(dialect(pattern))
        chain = F.when(worth & hit, platform) if chain is None else chain.when(worth & hit, platform)
    return chain
