"""URL and host helpers for agency discovery."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentweave.functions.text import dialect

# Portals, social sites and asset hosts that are never agency homepages.
PORTAL_OR_CDN_HOSTS = [
    "homegate.ch",
    "immoscout24.ch",
    "flatfox.ch",
    "realadvisor.ch",
    "immobilier.ch",
    "home.ch",
    "comparis.ch",
    "newhome.ch",
    "urbanhome.ch",
    "lookmove.ch",
    "erstbezug.ch",
    "facebook.com",
    "instagram.com",
    "linkedin.com",
    "twitter.com",
    "youtube.com",
    "cloudinary.com",
    "amazonaws.com",
    "googleapis.com",
    "cloudfront.net",
    "akamaihd.net",
]
# News and aggregator sites skipped when mining outgoing links.
SEED_BLOCKED_HOSTS = [
    "nzz.ch",
    "tagesanzeiger.ch",
    "srf.ch",
    "blick.ch",
    "20min.ch",
    "wikipedia.org",
    "github.com",
    "medium.com",
    "bauinserate.ch",
    "baublatt.ch",
    "hochbau.ch",
    "archi-mag.com",
    "e-architect.com",
]


def host_suffix_pattern(hosts: list[str]) -> str:
    return r"(^|\.)(" + "|".join(h.replace(".", r"\.") for h in hosts) + r")\z"


def is_portal_or_cdn(host: Column) -> Column:
    return host.rlike(host_suffix_pattern(PORTAL_OR_CDN_HOSTS))


def is_seed_blocked(host: Column) -> Column:
    return host.rlike(host_suffix_pattern(SEED_BLOCKED_HOSTS))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def domain_of(url: Column) -> Column:
    """Lower-case host without a leading ``www.``; null for text that is no URL."""
    return F.regexp_replace(host_of(url), r"^www\.", "")


def slugify_host(host: Column) -> Column:
    stem = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"(?i)\.[a-z]{2,6}\z", "")
    dashed = F.regexp_replace(stem, r"(?i)[^a-z0-9-]", "-")
    return F.lower(F.regexp_replace(dashed, r"^-+|-+$", ""))


def candidate_from_host(host: Column, source: Column, legal_name: Column | None = None) -> Column:
    """Candidate struct for a bare host, null for portals, asset hosts and empty slugs."""
    slug = slugify_host(host)
    name = legal_name if legal_name is not None else F.lit(None)
    usable = host.isNotNull() & (host != "") & ~is_portal_or_cdn(host) & (slug != "")
    return F.when(
        usable,
        F.struct(
            F.concat(F.lit("https://"), host, F.lit("/")).alias("website"),
            slug.alias("id"),
            source.alias("source"),
            name.cast("string").alias("legal_name"),
        ),
    )


def normalise_candidate(url: Column, source: Column, legal_name: Column | None = None) -> Column:
    return candidate_from_host(domain_of(url), source, legal_name)


# Words that mark detail pages, category pages, pages to avoid, and foreign locales.
STRONG_DETAIL = (
    "(objekt|object|objects|listing|inserat|immobilie|immobilien|wohnung|apartment|haus|exposé|expose|property|"
    "properties|casawp|portfolio|wohnungen)"
)
WEAK_DETAIL = "(mieten|kaufen|verkauf|rent|sale|house|wohnen)"
NEGATIVE_DETAIL = (
    "(\\/(alle|all|alle-mietobjekte|alle-kaufobjekte)-|kategorie|category-sitemap|blog|news|aktuell|news-|"
    "nachrichten|whats-new|impressum|datenschutz|kontakt|contact|about|ueber-|über-|leistung|leistungen|services|"
    "service-|dienstleistung|dienste|team|career|jobs|stelle|stellen|presse|press|insights|markt|preise|prices|"
    "immobilienpreise|immobilien-preise|sitemap-pages|page-sitemap|partner-sitemap|testimonials-sitemap|"
    "category-sitemap|tag-sitemap|author-sitemap|post-sitemap|posts-sitemap|feedback-sitemap|"
    "portfolio-categories-sitemap|comments?-?feed|ferien|ferienimmobilien|vacation|holiday|hotel|bewerten|"
    "bewertung|valuation|verkauf-tipps|kauf-tipps|tipp|guide|magazin)"
)
FOREIGN_LOCALE = r"(?:^|\/)([a-z]{2})-(?!ch\/)([a-z]{2})\/"
ID_SEGMENT = r"\/[a-z0-9-]*\d{2,}(?:[a-z0-9-]*)?\/?\z"


def score_detail_url(url: Column) -> Column:
    """How likely a URL is a single object's page; higher is likelier."""
    # A real parse is needed only for the path; a URL that does not parse keeps its word points.
    path = F.try_parse_url(url, F.lit("PATH"))
    parsed = F.try_parse_url(url, F.lit("HOST")).isNotNull()
    segments = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda s: s != "")
    depth = F.size(segments)
    last = F.coalesce(F.get(segments, depth - 1), F.lit(""))
    words = (
        F.when(url.rlike(dialect(STRONG_DETAIL)), 4).when(url.rlike(dialect(WEAK_DETAIL)), 1).otherwise(0)
        + F.when(url.rlike(dialect(ID_SEGMENT)), 3).otherwise(0)
    )
    shape = (
        F.when(depth >= 3, 1).otherwise(0)
        + F.when((F.length(last) >= 10) & last.contains("-"), 1).otherwise(0)
        - F.when(url.rlike(dialect(NEGATIVE_DETAIL)), 3).otherwise(0)
        - F.when(url.rlike(dialect(FOREIGN_LOCALE)), 8).otherwise(0)
        - F.when(depth == 0, 4).when(depth == 1, 2).otherwise(0)
    )
    return words + F.when(parsed, shape).otherwise(0)


def listing_id_from_url(url: Column, trailing_segment: bool = True) -> Column:
    """Trailing ``-123`` or (agency sites) ``/123``; the URL itself when there is neither."""
    dashed = F.nullif(F.regexp_extract(url, r"-(\d+)(?:\?|\z)", 1), F.lit(""))
    segment = F.nullif(F.regexp_extract(url, r"\/(\d+)(?:\?|\/?\z)", 1), F.lit(""))
    return F.coalesce(dashed, segment, url) if trailing_segment else F.coalesce(dashed, url)


def absolutise(path: Column, host: str) -> Column:
    return (
        F.when(path.rlike(r"^https?://"), path)
        .when(path.startswith("/"), F.concat(F.lit(host), path))
    )
