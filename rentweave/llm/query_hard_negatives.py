"""op12: hard negatives of every hundredth vector."""

from pyspark.sql import functions as F

from rentweave.llm.common import table
from rentweave.llm.hard_negatives import mine, usable


def op12_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.filter(usable(F.col("x")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("x", lambda x: F.floor(x * 256).cast("double"))
    return mine(rows.select(F.col("vec_id").alias("id"), label.alias("label"), whole.alias("v"), (F.col("vec_id") % 100 == 0).alias("anchor")))


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rw, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), pair AS (
  SELECT a.rw, a.vec_id AS anchor_id, c.rw AS other, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON len(a.e) = len(c.e) AND a.rw <> c.rw WHERE a.vec_id % 100 = 0
), positive AS (
  SELECT * FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY rw ORDER BY score DESC, vec_id NULLS LAST, other) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN pair n ON p.rw = n.rw AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
WINDOW w AS (PARTITION BY p.rw, p.other ORDER BY n.score DESC, n.vec_id NULLS LAST, n.other) QUALIFY row_number() OVER w <= 5
"""

QUERIES = {"op12_hard_negatives": (op12_hard_negatives, SQL)}
