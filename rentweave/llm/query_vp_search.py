"""op7: nearest neighbours of every fiftieth vector."""

from rentweave.llm.common import table
from rentweave.llm.vp_search import nearest


def op7_nearest_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"))


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rw, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), pair AS (
  SELECT q.rw, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY rw ORDER BY score DESC, vec_id) AS rank FROM pair) WHERE rank <= 5
"""

QUERIES = {"op7_nearest_neighbours": (op7_nearest_neighbours, SQL)}
