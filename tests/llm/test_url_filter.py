from rentweave.llm.components import connected_components
from rentweave.llm.query_url_filter import RULES
from rentweave.llm.url_filter import judge

PAGES = [
    (1, "http://a.org/x", '<link rel="canonical" href="http://shop.example.com/en/1">'),
    (2, "http://b.org/y?q=1#f", '<META HTTP-EQUIV="refresh" content="0; url=http://a.org/x">'),
    (3, "http://WWW.example.com/en/2", "<link href='http://b.org/y?q=1' rel='canonical'>"),
    (4, "http://c.org", '<link rel=canonical href="/p?a=1&amp;b=2">'),
    (5, "http://c.org/p?a=1&b=2", ""),
    (6, None, "x"),
    (7, "no scheme", '<link rel=canonical href="http://a.org/x">'),
    (8, "http://d.net/fr/z", '<link rel=canonical href="//c.org/p?a=1&b=2">'),
    (9, "http://e.org/d/e.html", '<link rel=canonical href="f.html">'),
    (10, "http://e.org/d/f.html", None),
    (10, "http://e.org/d/f.html", None),
    (None, "http://f.com", None),
    (11, "http://q.net/es/" + "z" * 40_000, None),
    (12, "http://sub.f.com/a", None),
]
SCHEMA = "page_id long, url string, html string"


def test_aliases_are_blocked_unless_allowed(spark):
    pages = spark.createDataFrame([(*p, "rule", "node") for p in PAGES], SCHEMA + ", rule string, node string")
    got = {r["page_id"]: (r["verdict"], r["reason"], r["rule"]) for r in judge(pages, RULES).collect()}
    assert got[1] == got[2] == got[4] == got[5] == ("block", "alias", None)
    assert got[3] == ("allow", "rule", "www.example.com/en/")
    assert got[8] == ("block", "rule", "net/fr/") and got[11] == ("block", "rule", "net/es/")
    assert got[6] == got[7] == got[9] == got[10] == got[None] == ("allow", "none", None)
    assert got[12] == ("allow", "rule", "com/")
    assert judge(pages, RULES).count() == len(PAGES)


def test_a_table_of_redirects_adds_edges(spark):
    pages = spark.createDataFrame([(1, "http://x.org/1", None), (2, "http://y.org/2", None)], SCHEMA)
    moved = spark.createDataFrame([("http://x.org/1", "http://z.net/fr/"), (None, "http://y.org/2"), ("http://y.org/2", "http://y.org/2")], "source string, target string")
    got = {r["page_id"]: r["verdict"] for r in judge(pages, RULES, moved).collect()}
    assert got == {1: "block", 2: "allow"}
    assert judge(spark.createDataFrame([], SCHEMA), RULES).collect() == []


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(100, 130)] + [(500, 500 + i) for i in range(1, 40)] + [(9, 8), (8, 7), (7, 9), (3, 3), (None, 4), (9, 8)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 131)} | {500 + i: 500 for i in range(40)} | {7: 7, 8: 7, 9: 7}
    assert got == want
