"""URL filter with redirect equivalence.

A url is judged by the longest rule that fits its host (or a parent domain) and the start of its path. Urls joined by redirect and
canonical-link edges are aliases: a component that holds a url blocked by rule blocks its other members, but a member that a
rule allows stays allowed (explicit allow precedence). Urls without either are allowed.

Edges come from the pages (canonical links, refresh redirects) and from a table of redirects, if there is one. Components are
found by distributed contraction (`components`); only urls on edges take part, pages meet the blocked ones in one join that is
broadcast only if these are few by count. The rules are a list in the program, compiled to one expression.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and has no alias. Repeated rows are judged alike. Among
fitting rules of equal length an allowing one wins, then the first in the alphabet.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentweave.llm.common import UPPER, small, staged
from rentweave.llm.components import connected_components

FEW_URLS = 500_000
#: Where a page names its canonical address or sends its reader on.
LINK_TAG = r"(?is)<link\b[^>]*>"
CANONICAL = r"(?is)\brel\s*=\s*[\"']?canonical\b"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
META_TAG = r"(?is)<meta\b[^>]*>"
REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"
TARGET = r"(?is)\bcontent\s*=\s*[\"']?\s*[0-9.]*\s*;\s*url\s*=\s*[\"']?([^\"'\s>]+)"


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url))).otherwise("")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Name of the rule that decides, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.verdict, r.name), reverse=True):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(rule.name)).otherwise(found)
    return found


def verdict_of(rule: Column, rules: list[Rule]) -> Column:
    blocking = [r.name for r in rules if r.verdict == "block"]
    return F.when(rule.isin(blocking), "block").when(rule.isNotNull(), "allow")


def node_of(url: Column) -> Column:
    """A url's name in the graph: scheme and host in lower case, no fragment; null where there is no ``://``."""
    cut = F.instr(url, "://")
    rest = F.regexp_extract(after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    scheme = F.translate(F.substring(url, F.lit(1), cut - 1), UPPER, UPPER.lower())
    return F.when(cut > 0, F.concat(scheme, F.lit("://"), host_of(url), rest))


def resolve(base: Column, link: Column) -> Column:
    """A link as seen from a page: absolute, of the same scheme (//host), from the root (/path), or beside the page."""
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    scheme = F.substring(base, F.lit(1), F.instr(base, ":"))
    root = F.concat(scheme, F.lit("//"), host_of(base))
    folder = F.regexp_extract(F.when(path_of(base) == "", "/").otherwise(path_of(base)), r"^(?s).*/", 0)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(root, folder, link))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b): edges from canonical links and refresh redirects of pages (url, html)."""
    html = F.coalesce("html", F.lit(""))
    lower = F.lower(html)

    def links(tag: str, kind: str, target: str) -> Column:
        tags = F.filter(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: t.rlike(kind))
        return F.filter(F.transform(tags, lambda t: F.regexp_extract(t, target, 1)), lambda x: x != "")

    marked = pages.filter(F.instr("url", "://") > 0).filter(F.contains(lower, F.lit("canonical")) | F.contains(lower, F.lit("refresh")))
    found = marked.select("url", F.explode(F.concat(links(LINK_TAG, CANONICAL, HREF), links(META_TAG, REFRESH, TARGET))).alias("link"))
    return found.select(node_of(F.col("url")).alias("a"), node_of(resolve(F.col("url"), F.col("link"))).alias("b"))


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, reason (rule, alias or none). ``redirects`` has (source, target) urls."""
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("source")), node_of(F.col("target"))))
    groups = connected_components(edges)
    ruled = groups.withColumn("rule", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules))
    ruled = ruled.withColumn("verdict", verdict_of(F.col("rule"), rules))
    blocked = ruled.filter("verdict = 'block'").select("component").distinct()
    aliases = staged(ruled.filter("rule IS NULL").join(blocked, "component", "left_semi").select(F.col("node").alias("blocked")), "aliases")

    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.join(small(aliases, FEW_URLS), F.when(F.col("rule").isNull(), F.col("node")) == F.col("blocked"), "left")
    inherited = F.when(F.col("blocked").isNotNull(), "block").otherwise("allow")
    return rows.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce(verdict_of(F.col("rule"), rules), inherited).alias("verdict"),
        F.when(F.col("rule").isNotNull(), "rule").when(F.col("blocked").isNotNull(), "alias").otherwise("none").alias("reason"),
    )
