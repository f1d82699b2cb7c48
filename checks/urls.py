"""URL, host and page functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks.text import TEXT_SQL, listing_text
from checks.views import table
from rentweave.functions import urls as U
from rentweave.functions.platform import classify_platform
from rentweave.operators import candidates as C
from rentweave.sources import sitemap as M


def _in(items: list[str]) -> str:
    return "|".join(i.replace(".", r"\.") for i in items)


PORTAL_RE = rf"(^|\.)({_in(U.PORTAL_OR_CDN_HOSTS)})$"
SEED_RE = rf"(^|\.)({_in(U.SEED_BLOCKED_HOSTS)})$"
# Host, candidate id and usability of a URL column, for CTEs.
HOST = r"nullif(regexp_replace(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)', 1)), '^www\.', ''), '')"
SLUG = (
    r"lower(regexp_replace(regexp_replace(regexp_replace({h}, '(?i)\.[a-z]{{2,6}}$', ''), '(?i)[^a-z0-9-]', '-', 'g'),"
    r" '^-+|-+$', '', 'g'))"
)


def candidates_of_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    # Every ninth host becomes a portal's subdomain, so that the block list is exercised.
    url = F.when(
        F.col("page_id") % 9 == 0, F.regexp_replace("url", r"example\.(com|net|org)", "homegate.ch")
    ).otherwise(F.col("url"))
    c = U.normalise_candidate(F.col("u"), F.lit("lister-website"))
    return pages.select("page_id", url.alias("u")).select(
        "page_id", U.domain_of(F.col("u")).alias("host"), c["website"].alias("website"), c["id"].alias("id")
    )


CANDIDATES_OF_PAGES = rf"""WITH u AS (
  SELECT page_id, CASE WHEN page_id % 9 = 0 THEN regexp_replace(url, 'example\.(com|net|org)', 'homegate.ch') ELSE url END AS u FROM pages
),
h AS (SELECT page_id, {HOST.format(u="u")} AS host FROM u),
s AS (SELECT *, {SLUG.format(h="host")} AS slug, regexp_matches(host, '{PORTAL_RE}') AS portal FROM h)
SELECT page_id, host, CASE WHEN NOT portal AND slug <> '' THEN 'https://' || host || '/' END AS website,
  CASE WHEN NOT portal AND slug <> '' THEN slug END AS id FROM s"""


def blocked_hosts(spark: SparkSession, sf: str) -> DataFrame:
    hosts = U.PORTAL_OR_CDN_HOSTS + U.SEED_BLOCKED_HOSTS + ["myhome.ch", "home.ch.example.com", "agency.ch"]
    pool = F.array(*[F.lit(h) for h in hosts])
    host = F.get(pool, (F.col("o_orderkey") % len(hosts)).cast("int"))
    host = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("a.b."), host)).when(
        F.col("o_custkey") % 3 == 1, F.concat(F.lit("x"), host)
    ).otherwise(host)
    rows = table(spark, sf, "orders").select("o_orderkey", host.alias("host"))
    return rows.select(
        "o_orderkey", "host", U.is_portal_or_cdn(F.col("host")).alias("portal"), U.is_seed_blocked(F.col("host")).alias("seed")
    )


_POOL = U.PORTAL_OR_CDN_HOSTS + U.SEED_BLOCKED_HOSTS + ["myhome.ch", "home.ch.example.com", "agency.ch"]
_POOL_SQL = "[" + ",".join(f"'{h}'" for h in _POOL) + "]"


def _suffix_sql(hosts):
    return " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in hosts)


BLOCKED_HOSTS = f"""WITH h AS (
  SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'a.b.' WHEN 1 THEN 'x' ELSE '' END || ({_POOL_SQL})[o_orderkey % {len(_POOL)} + 1] AS host
  FROM orders)
SELECT o_orderkey, host, ({_suffix_sql(U.PORTAL_OR_CDN_HOSTS)}) AS portal, ({_suffix_sql(U.SEED_BLOCKED_HOSTS)}) AS seed FROM h"""

# URL tails that meet every scoring rule.
TAILS = [
    "",
    "/objekte/wohnung-am-see-4711/",
    "/de/mieten/",
    "/alle-mietobjekte.html",
    "/de-at/immobilien/haus-12",
    "/de-ch/immobilien/haus-am-see-99",
    "/news/2024/",
    "/EXPOSÉ/Ueber-uns",
    "/rent/apartment-12345?x=1",
    "/kontakt",
    "/a/b/c-d",
]
_TAILS_SQL = "[" + ",".join(f"'{t}'" for t in TAILS) + "]"


def _tailed(spark, sf):
    pages = table(spark, sf, "pages")
    tail = F.get(F.array(*[F.lit(t) for t in TAILS]), (F.col("page_id") % len(TAILS)).cast("int"))
    base = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    tailed = F.when(F.col("page_id") % 4 == 0, F.col("url")).otherwise(F.concat(base, tail))
    return pages.select("page_id", tailed.alias("url"))


TAILED_SQL = rf"""
tailed AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN url
  ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || ({_TAILS_SQL})[page_id % {len(TAILS)} + 1] END AS url FROM pages)"""

_NEG = U.NEGATIVE_DETAIL.replace("\\/", "/")
SCORED_SQL = rf"""
parts AS (
  SELECT *, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> '') AS segs,
    string_split(url, '/') AS pieces FROM tailed
),
detail_scores AS (
  SELECT *, CAST(CASE WHEN regexp_matches(url, '(?i){U.STRONG_DETAIL}') THEN 4 WHEN regexp_matches(url, '(?i){U.WEAK_DETAIL}') THEN 1 ELSE 0 END
    + CASE WHEN regexp_matches(url, '(?i)/[a-z0-9-]*[0-9]{{2,}}([a-z0-9-]*)?/?$') THEN 3 ELSE 0 END
    + CASE WHEN len(segs) >= 3 THEN 1 ELSE 0 END
    + CASE WHEN length(coalesce(segs[-1], '')) >= 10 AND contains(segs[-1], '-') THEN 1 ELSE 0 END
    - CASE WHEN regexp_matches(url, '(?i){_NEG}') THEN 3 ELSE 0 END
    - CASE WHEN len(list_filter(pieces[2:-2], lambda p: regexp_matches(p, '(?i)^[a-z]{{2}}-[a-z]{{2}}$')
        AND NOT regexp_matches(p, '(?i)-ch$'))) > 0 THEN 8 ELSE 0 END
    - CASE len(segs) WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 0 END AS INTEGER) AS score FROM parts
)"""


def detail_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _tailed(spark, sf).select("page_id", "url", U.score_detail_url(F.col("url")).alias("score"))


DETAIL_SCORES = f"WITH {TAILED_SQL.strip()},{SCORED_SQL}\nSELECT page_id, url, score FROM detail_scores"


def _site_locs(spark, sf):
    return _tailed(spark, sf).select(
        U.host_of(F.col("url")).alias("site"), F.col("url").alias("loc"), F.col("page_id").alias("position")
    )


def top_detail_urls(spark: SparkSession, sf: str) -> DataFrame:
    return M.top_detail_urls(_site_locs(spark, sf)).select("site", "loc", "score", "rank")


TOP_DETAIL_URLS = rf"""WITH {TAILED_SQL.strip()},{SCORED_SQL},
uniq AS (
  SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS site, url AS loc, min(score) AS score, min(page_id) AS pos
  FROM detail_scores GROUP BY 1, 2
),
good AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, pos) AS rank FROM uniq WHERE score > 0),
poor AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY pos) AS rank FROM uniq WHERE site NOT IN (SELECT site FROM good))
SELECT site, loc, score, CAST(rank AS INTEGER) AS rank FROM good WHERE rank <= 3
UNION ALL SELECT site, loc, score, CAST(rank AS INTEGER) FROM poor WHERE rank = 1"""


def sitemap_top_n(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as sitemap entries: customers' segments are agencies, some entries have no date."""
    o = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 40).alias("agency"),
        F.concat(F.lit("https://a.example/objekt-"), F.col("o_orderkey").cast("string")).alias("loc"),
        F.when(F.col("o_orderkey") % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("lastmod"),
        F.col("o_orderkey").alias("position"),
    )
    return M.sitemap_top_n(o, ["agency"], 30, r"[02468]$")


SITEMAP_TOP_N = """WITH e AS (
  SELECT o_custkey % 40 AS agency, 'https://a.example/objekt-' || CAST(o_orderkey AS VARCHAR) AS loc,
    CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS lastmod, o_orderkey AS position FROM orders
  WHERE o_orderkey % 2 = 0)
SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY agency ORDER BY coalesce(lastmod, '') DESC, position) <= 30"""


def listing_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _tailed(spark, sf).select(
        "page_id",
        U.listing_id_from_url(F.col("url")).alias("agency_id"),
        U.listing_id_from_url(F.col("url"), trailing_segment=False).alias("portal_id"),
    )


LISTING_IDS = rf"""WITH {TAILED_SQL.strip()}
SELECT page_id, coalesce(nullif(regexp_extract(url, '-([0-9]+)(\?|$)', 1), ''), nullif(regexp_extract(url, '/([0-9]+)(\?|/?$)', 1), ''), url) AS agency_id,
  coalesce(nullif(regexp_extract(url, '-([0-9]+)(\?|$)', 1), ''), url) AS portal_id FROM tailed"""


def description_urls(spark: SparkSession, sf: str) -> DataFrame:
    rows = listing_text(spark, sf).withColumn(
        "description",
        F.concat(
            "description",
            F.when(
                F.col("doc_id") % 5 == 0,
                F.concat(F.lit(" siehe (http://www.Projekt"), (F.col("doc_id") % 40).cast("string"), F.lit(".ch/a?b=1),")),
            ).otherwise(" www.homegate.ch"),
        ),
    )
    found = C.description_candidates(rows, keep=("doc_id",))
    return C.first_per_id(found, "doc_id", "at").select("id", "website", "source", "doc_id", F.col("at").cast("bigint").alias("at"))


DESCRIPTION_URLS = rf"""WITH {TEXT_SQL.strip()},
rows AS (SELECT doc_id, description || CASE WHEN doc_id % 5 = 0 THEN ' siehe (http://www.Projekt' || CAST(doc_id % 40 AS VARCHAR) || '.ch/a?b=1),'
    ELSE ' www.homegate.ch' END AS d FROM listing_text),
lists AS (SELECT doc_id, list_concat(
    [regexp_replace(u, '[.,;:!?)\]]+$', '') FOR u IN regexp_extract_all(d, '(?i)https?://[^\s"''<>)]+')],
    [('https://' || regexp_replace(w, '^www\.', '') || '/') FOR w IN regexp_extract_all(d, '(?i)(?:^|[\s(\[])(www\.[a-z0-9][a-z0-9.\-]+\.(?:ch|com|li|de|fr|it))', 1)]
  ) AS us FROM rows),
flat AS (SELECT doc_id, unnest(us) AS u, unnest(range(0, len(us))) AS pos FROM lists),
hosts AS (SELECT *, {HOST.format(u="u")} AS host FROM flat),
cands AS (SELECT *, {SLUG.format(h="host")} AS id FROM hosts WHERE host IS NOT NULL AND NOT regexp_matches(host, '{PORTAL_RE}'))
SELECT id, 'https://' || host || '/' AS website, 'pdp-url-mined' AS source, doc_id, pos AS at FROM cands WHERE id <> ''
QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id, pos) = 1"""


def linked_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with an absolute, a protocol-relative, a blocked and a self link added."""
    p = table(spark, sf, "pages")
    k = F.col("page_id")
    text = k.cast("string")
    added = F.concat(
        F.lit('<a class="x" href="https://www.partner'), (k % 30).cast("string"), F.lit('.ch/p/'), text, F.lit('">p</a>'),
        F.lit("<A HREF='//dev"), (k % 17).cast("string"), F.lit(".li/x'>q</A>"),
        F.lit('<a href="https://www.nzz.ch/a">n</a><a href="https://m.facebook.com/b">f</a><a href="'), F.col("url"), F.lit('">me</a>'),
    )
    return p.select("page_id", "url", F.concat("html", added).alias("html"))


def outgoing_links(spark: SparkSession, sf: str) -> DataFrame:
    found = C.outgoing_links(linked_pages(spark, sf))
    return found.select("url", "id", "website", "source").distinct()


OUTGOING_LINKS = rf"""
SELECT DISTINCT url, id, website, 'pdp-url-mined' AS source FROM (
  SELECT url, 'partner' || CAST(page_id % 30 AS VARCHAR) AS id, 'https://partner' || CAST(page_id % 30 AS VARCHAR) || '.ch/' AS website FROM pages
  UNION ALL
  SELECT url, 'dev' || CAST(page_id % 17 AS VARCHAR), 'https://dev' || CAST(page_id % 17 AS VARCHAR) || '.li/' FROM pages)"""

# Markers a page gets by its number; none for most.
PLATFORM_TAGS = {
    0: '<meta name="generator" content="WP ImmoMig 3">',
    1: '<script src="https://cdn.casasoft.ch/x.js"></script>',
    2: '<iframe width=1 src="https://www.homegate.ch/widget"></iframe>',
    3: '<script type="application/ld+json">{"@type": "House", "name": "x"}</script>',
    4: '<a href="/ig.fcgi">a</a><script src="//casasoft.ch/y.js"></script>',
    5: '<script type="application/ld+json">{"@type": "Organization"}</script>',
}


def tagged_pages(spark: SparkSession, sf: str, every: int = 8) -> DataFrame:
    p = table(spark, sf, "pages")
    tag = F.lit("")
    for i, text in PLATFORM_TAGS.items():
        tag = F.when(F.col("page_id") % every == i, F.lit(text)).otherwise(tag)
    return p.select("page_id", "url", F.concat("html", tag).alias("html"))


PLATFORM_SQL = """CASE page_id % 8 WHEN 0 THEN 'immomig' WHEN 1 THEN 'casasoft' WHEN 2 THEN 'iframe-portal' WHEN 3 THEN 'schemaorg'
  WHEN 4 THEN 'immomig' END"""


def platforms(spark: SparkSession, sf: str) -> DataFrame:
    pages = tagged_pages(spark, sf)
    return pages.select("page_id", F.coalesce(classify_platform(F.col("html")), F.lit("custom")).alias("platform"))


PLATFORMS = f"SELECT page_id, coalesce({PLATFORM_SQL}, 'custom') AS platform FROM pages"


def locs_and_robots(spark: SparkSession, sf: str) -> DataFrame:
    """Sitemap and robots texts, one per host, built from the page URLs and read back."""
    site = U.host_of(F.col("url"))
    per_page = table(spark, sf, "pages").select(
        site.alias("site"),
        "page_id",
        F.concat(F.lit("<urlset><url><LOC> "), "url", F.lit(" </LOC></url></urlset>")).alias("xml"),
        F.concat(F.lit("User-agent: *\n  sitemap: https://"), site, F.lit("/s.xml\nSitemap: /other.xml\n")).alias("robots"),
    )
    return per_page.select(
        "page_id", "site", F.array_join(M.extract_locs(F.col("xml")), " ").alias("locs"), M.robots_sitemap(F.col("robots")).alias("sitemap")
    )


LOCS_AND_ROBOTS = r"""WITH s AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS site FROM pages)
SELECT page_id, site, url AS locs, 'https://' || site || '/s.xml' AS sitemap FROM s"""


def _site_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Ten pages make a site: indexes that nest, point to themselves or to nothing, url sets and a page that is no sitemap."""
    pages = table(spark, sf, "pages").select("page_id")
    k = F.col("page_id") % 10
    near = lambda i: _map_url(F.col("page_id") - k + i)
    locs = (
        F.when(k == 0, F.array(*[near(i) for i in range(1, 7)]))
        .when(k == 2, F.array(near(7), near(2), near(8)))
        .when(k == 6, F.array(near(9), near(9)))
        .when(k == 9, F.array(near(9), near(7), near(3)))
        .otherwise(F.array(*[F.concat(_map_url(F.col("page_id")), F.lit(f"/objekt-1{i}")) for i in range(2)], near(5)))
    )
    kind = F.when(k.isin(0, 2, 6, 9), "sitemapindex").when(k == 4, "html").otherwise("urlset")
    text = F.array_join(F.transform(locs, lambda u: F.concat(F.lit("<url><loc> "), u, F.lit("\n</loc></url>"))), "")
    xml = F.concat(F.lit("<"), kind, F.lit(">"), text, F.lit("</"), kind, F.lit(">"))
    site = F.floor(F.col("page_id") / 10)
    # Every third site has none of the children of its index landed.
    landed = (k != 3) & ((site % 3 != 0) | (k == 0))
    return pages.select(site.alias("site"), k.alias("k"), _map_url(F.col("page_id")).alias("url"), F.when(landed, xml).alias("xml"))


def _map_url(page: Column) -> Column:
    tail = F.get(F.array(*[F.lit(t) for t in TAILS]), (page % len(TAILS)).cast("int"))
    return F.concat(F.lit("https://s"), page.cast("string"), F.lit(".example"), tail)


def expand_sitemap_index(spark: SparkSession, sf: str) -> DataFrame:
    maps = _site_maps(spark, sf)
    found = M.expand_sitemap_index(maps.filter("k = 0").select("site", "url"), maps.filter("xml IS NOT NULL").select("url", "xml"))
    turn = F.row_number().over(Window.partitionBy("site").orderBy("position"))
    return found.select("site", "loc", turn.alias("at"))


def _map_url_sql(page: str) -> str:
    return f"('https://s' || CAST({page} AS VARCHAR) || '.example' || ({_TAILS_SQL})[({page}) % {len(TAILS)} + 1])"


def _near_sql(*places: int) -> str:
    return "[" + ", ".join(_map_url_sql(f"page_id - k + {i}") for i in places) + "]"


def _level_sql(n: int) -> str:
    return f"""
c{n + 1} AS (SELECT n.site, b.child AS url, list_concat([1], n.place, [b.rank]) AS place FROM n{n} n JOIN best b USING (url)),
n{n + 1} AS (SELECT site, url, list_concat([0], place) AS place FROM n{n} n JOIN maps m USING (site, url) WHERE kind <> 'sitemapindex' OR site NOT IN (SELECT site FROM c{n + 1})
  UNION ALL SELECT * FROM c{n + 1})"""


EXPAND_SITEMAP_INDEX = f"""WITH maps AS (SELECT page_id // 10 AS site, page_id, k, {_map_url_sql("page_id")} AS url,
  CASE WHEN k IN (0, 2, 6, 9) THEN 'sitemapindex' WHEN k = 4 THEN 'html' ELSE 'urlset' END AS kind,
  CASE k WHEN 0 THEN {_near_sql(1, 2, 3, 4, 5, 6)} WHEN 2 THEN {_near_sql(7, 2, 8)} WHEN 6 THEN {_near_sql(9, 9)} WHEN 9 THEN {_near_sql(9, 7, 3)}
    ELSE [{_map_url_sql("page_id")} || '/objekt-10', {_map_url_sql("page_id")} || '/objekt-11', {_near_sql(5)}[1]] END AS locs
  FROM (SELECT page_id, page_id % 10 AS k FROM pages) WHERE k <> 3 AND ((page_id // 10) % 3 <> 0 OR k = 0)),
linked AS (SELECT site, url AS owner, unnest(locs) AS url, unnest(range(len(locs))) AS i FROM maps WHERE kind = 'sitemapindex'),
tailed AS (SELECT DISTINCT url, 0 AS page_id FROM linked),{SCORED_SQL},
best AS (SELECT owner AS url, child, rank FROM (SELECT l.site, l.owner, l.url AS child, row_number() OVER (PARTITION BY l.owner ORDER BY s.score DESC, l.i) - 1 AS rank
  FROM linked l JOIN detail_scores s ON s.url = l.url) WHERE rank < 3 AND child IN (SELECT url FROM maps WHERE kind <> 'html')),
n0 AS (SELECT site, url, CAST([] AS BIGINT[]) AS place FROM maps WHERE k = 0),{_level_sql(0)},{_level_sql(1)},
found AS (SELECT n.site, unnest(m.locs) AS loc, n.place, unnest(range(len(m.locs))) AS i FROM n2 n JOIN maps m ON m.url = n.url),
firsts AS (SELECT site, loc, min(row(place, i)) AS position FROM found GROUP BY ALL)
SELECT site, loc, CAST(row_number() OVER (PARTITION BY site ORDER BY position) AS INTEGER) AS at FROM firsts"""

QUERIES = {
    "expand_sitemap_index": (expand_sitemap_index, EXPAND_SITEMAP_INDEX),
    "normalise_candidate": (candidates_of_pages, CANDIDATES_OF_PAGES),
    "blocked_hosts": (blocked_hosts, BLOCKED_HOSTS),
    "score_detail_url": (detail_scores, DETAIL_SCORES),
    "top_detail_urls": (top_detail_urls, TOP_DETAIL_URLS),
    "sitemap_top_n": (sitemap_top_n, SITEMAP_TOP_N),
    "listing_id_from_url": (listing_ids, LISTING_IDS),
    "description_urls": (description_urls, DESCRIPTION_URLS),
    "outgoing_links": (outgoing_links, OUTGOING_LINKS),
    "classify_platform": (platforms, PLATFORMS),
    "extract_locs": (locs_and_robots, LOCS_AND_ROBOTS),
}
