"""Sitemap indexes against a plain walk over the same landed texts."""

import random

from pyspark.sql import functions as F

from rentweave.functions.urls import score_detail_url
from rentweave.sources.sitemap import expand_sitemap_index, top_detail_urls

WORDS = ["objekte", "blog", "sitemap-pages", "wohnung-123-am-see", "a/b/c", "en-us/x", "kontakt", "inserat/99", "x"]


def walk(start, landed, locs, score):
    """Distinct URLs in order, two levels deep."""
    if start not in landed:
        return []
    here = [start]
    for _ in range(2):
        indexes = [u for u in here if "<sitemapindex" in landed[u].lower()]
        fetched = []
        for u in indexes:
            best = sorted(locs[u], key=lambda x: -score[x])[:3]
            fetched += [c for c in best if c in landed and ("<urlset" in landed[c] or "<sitemapindex" in landed[c])]
        if not fetched:
            break
        here = [u for u in here if u not in indexes] + fetched
    return list(dict.fromkeys(x for u in here for x in locs[u]))


def test_equals_a_plain_walk(spark):
    rng = random.Random(3)
    urls = [f"https://s.ch/{rng.choice(WORDS)}/{rng.choice(WORDS)}-{i}.xml" for i in range(120)]
    landed, locs = {}, {}
    for u in urls[:90]:
        kind = rng.choice(["sitemapindex", "sitemapindex", "urlset", "urlset", "html"])
        locs[u] = [rng.choice(urls) if kind == "sitemapindex" else f"https://s.ch/{rng.choice(WORDS)}/{rng.randint(1, 60)}" for _ in range(rng.randint(0, 6))]
        landed[u] = f"<{kind}>" + "".join(f"<url><loc> {x}\n</loc></url>" for x in locs[u]) + f"</{kind}>"
    every = sorted(set(urls) | {x for part in locs.values() for x in part})
    score = {r["u"]: r["s"] for r in spark.createDataFrame([(u,) for u in every], "u string").select("u", score_detail_url(F.col("u")).alias("s")).collect()}
    starts = [(f"site{i}", u) for i, u in enumerate(urls)]
    df = expand_sitemap_index(spark.createDataFrame(starts, "site string, url string"), spark.createDataFrame(list(landed.items()), "url string, xml string"))
    got = {}
    for r in df.orderBy("site", "position").collect():
        got.setdefault(r["site"], []).append(r["loc"])
    want = {site: walk(u, landed, locs, score) for site, u in starts}
    assert got == {site: found for site, found in want.items() if found}
    best = {r["site"]: r["loc"] for r in top_detail_urls(df).filter("rank = 1").collect()}
    for site, found in want.items():
        if found:
            good = [x for x in found if score[x] > 0]
            assert best[site] == (max(good, key=lambda x: score[x]) if good else found[0])


def test_nothing_landed(spark):
    none = spark.createDataFrame([], "url string, xml string")
    assert expand_sitemap_index(spark.createDataFrame([("a", "u")], "site string, url string"), none).collect() == []
