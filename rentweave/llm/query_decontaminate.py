"""op3: benchmark passages in documents."""

from rentweave.llm.common import table
from rentweave.llm.decontaminate import contamination_digest


def op3_benchmark_decontamination(spark, sf_dir):
    return contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS rw,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS phrase, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM item WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM win), spot AS (
  SELECT rw, s, n, array_to_string(w[s:s + n - 1], ' ') AS phrase
  FROM (SELECT rw, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc, lens WHERE len(w) >= n)
), hit AS (SELECT spot.rw, spot.s, spot.n, win.item_id FROM spot JOIN win ON spot.phrase = win.phrase AND spot.n = win.n),
words AS (SELECT rw, count(DISTINCT p) AS n_hit FROM (SELECT rw, unnest(range(s, s + n)) AS p FROM hit) GROUP BY rw),
items AS (
  SELECT rw, count(i) AS n_items, string_agg(i, ',' ORDER BY i) AS names
  FROM (SELECT DISTINCT rw, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY rw
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN words USING (rw) LEFT JOIN items USING (rw)
"""

QUERIES = {"op3_benchmark_decontamination": (op3_benchmark_decontamination, SQL)}
