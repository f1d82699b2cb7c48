"""op5: documents without recurring line templates."""

from pyspark.sql import functions as F

from rentweave.llm.common import table
from rentweave.llm.line_templates import drop_templates


def op5_line_dedup(spark, sf_dir):
    out = drop_templates(table(spark, sf_dir, "documents"))
    dropped = F.coalesce(F.size("drops"), F.lit(0)).cast("long")
    return out.select("doc.doc_id", "doc.text", dropped.alias("n_dropped"))


LINES_SQL = r"""
WITH doc AS (SELECT doc_id, text, row_number() OVER () AS rw FROM documents),
line AS (SELECT DISTINCT text, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p FROM doc WHERE text IS NOT NULL),
tok AS (
  SELECT text, p, [CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END FOR t IN regexp_extract_all(line, '[^\x20\x09-\x0D]+')] AS m FROM line
), form AS (
  SELECT text, p, unnest(CASE WHEN len(m) < 8 THEN ['full ' || array_to_string(m, ' ')] ELSE [
    'full ' || array_to_string(m, ' '),
    'even ' || len(m) || ' ' || array_to_string(m[1:2], ' ') || ' | ' || array_to_string([m[i] FOR i IN range(1, len(m) + 1, 2)], ' '),
    'odd ' || len(m) || ' ' || array_to_string(m[1:2], ' ') || ' | ' || array_to_string([m[i] FOR i IN range(2, len(m) + 1, 2)], ' ')] END) AS key
  FROM tok WHERE len(m) >= 3
), owner AS (SELECT text, min(doc_id) AS id FROM doc GROUP BY text),
template AS (
  SELECT key, count(*) AS n, arg_min(text, id) AS first
  FROM (SELECT DISTINCT key, form.text, id FROM form JOIN owner ON form.text = owner.text) GROUP BY key HAVING count(*) >= 3
), gone AS (SELECT DISTINCT form.text, p FROM form JOIN template USING (key) WHERE form.text <> first),
left_over AS (
  SELECT line.text, coalesce(string_agg(line, chr(10) ORDER BY line.p) FILTER (WHERE gone.p IS NULL), '') AS rest, count(gone.p) AS n
  FROM line LEFT JOIN gone ON line.text = gone.text AND line.p = gone.p GROUP BY line.text
)
SELECT doc_id, CASE WHEN doc.text IS NULL THEN NULL ELSE rest END AS text, coalesce(n, 0) AS n_dropped
FROM doc LEFT JOIN left_over ON doc.text = left_over.text
"""

QUERIES = {"op5_line_dedup": (op5_line_dedup, LINES_SQL)}
