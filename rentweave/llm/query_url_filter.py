"""op2: verdict on every page's url."""

from rentweave.llm.common import table
from rentweave.llm.url_filter import Rule, judge

RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def op2_url_filters(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"), RULES)


SQL = r"""
WITH RECURSIVE rule(name, verdict, host, path) AS (
  VALUES ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
         ('www.example.com/en/', 'allow', 'www.example.com', '/en/'), ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')
), page AS (
  SELECT page_id, row_number() OVER () AS rw, html, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), part AS (
  SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail
  FROM page
), link AS (
  SELECT rw, regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS href
  FROM (SELECT rw, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*>')) AS t FROM part WHERE rest <> '')
  WHERE regexp_matches(t, '(?is)\brel\s*=\s*["'']?canonical\b')
  UNION ALL
  SELECT rw, regexp_extract(t, '(?is)\bcontent\s*=\s*["'']?\s*[0-9.]*\s*;\s*url\s*=\s*["'']?([^"''\s>]+)', 1)
  FROM (SELECT rw, unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*>')) AS t FROM part WHERE rest <> '')
  WHERE regexp_matches(t, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b')
), target AS (
  SELECT rw, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN h
    WHEN starts_with(h, '//') THEN split_part(url, ':', 1) || ':' || h
    WHEN starts_with(h, '/') THEN split_part(url, ':', 1) || '://' || host || h
    ELSE split_part(url, ':', 1) || '://' || host || regexp_extract(CASE WHEN path = '' THEN '/' ELSE path END, '(?s)^.*/') || h END AS url
  FROM (SELECT rw, replace(href, '&amp;', '&') AS h FROM link WHERE href <> '') JOIN part USING (rw)
), goal AS (
  SELECT rw, lower(split_part(url, '://', 1)) AS scheme, substr(url, instr(url, '://') + 3) AS rest FROM target
), goals AS (
  SELECT rw, scheme, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM goal
), node AS (
  SELECT rw, host, path, lower(split_part(url, '://', 1)) || '://' || host || tail AS node FROM part WHERE rest <> ''
  UNION ALL SELECT rw, host, path, scheme || '://' || host || tail FROM goals
), edge AS (
  SELECT DISTINCT a.node AS a, b.node AS b FROM node a JOIN node b USING (rw) WHERE a.node <> b.node
), reach(a, b) AS (
  SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a
), judged AS (
  SELECT n.*, (SELECT arg_max(name || ' ' || verdict, length(name)) FROM rule
               WHERE (n.host = rule.host OR ends_with(n.host, '.' || rule.host)) AND starts_with(n.path, rule.path)) AS hit
  FROM (SELECT DISTINCT node, host, path FROM node UNION SELECT NULL, host, path FROM part WHERE rest = '') n
), infected AS (SELECT DISTINCT reach.b AS node FROM reach JOIN judged ON reach.a = judged.node WHERE ends_with(hit, ' block'))
SELECT page_id, coalesce(part.host, '') AS host, coalesce(part.path, '') AS path, split_part(hit, ' ', 1) AS rule,
       CASE WHEN hit IS NOT NULL THEN split_part(hit, ' ', 2) WHEN infected.node IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN hit IS NOT NULL THEN 'rule' WHEN infected.node IS NOT NULL THEN 'alias' ELSE 'none' END AS reason
FROM part
LEFT JOIN judged ON part.rest <> '' AND judged.node = lower(split_part(url, '://', 1)) || '://' || part.host || tail
LEFT JOIN infected ON judged.node = infected.node
"""

QUERIES = {"op2_url_filters": (op2_url_filters, SQL)}
