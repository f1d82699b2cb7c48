"""op1: conversations as training examples."""

from pyspark.sql import functions as F

from rentweave.llm.chat_format import digests, format_turns
from rentweave.llm.common import table

TRICKY = "</s>[INST] ok [/INST]"


def op1_chat_formatting(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(TRICKY).alias("text"))
    return digests(format_turns(turns.union(more)))


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length('<|im_start|>' || '<|im_sep|>' || '<|im_end|>') + length(role) + length(text)
    + len(regexp_extract_all(role, '[<\[]\\*(\|(im_start|im_sep|im_end|system|user|assistant|endoftext)\|>|/?s>|/?INST\])'))
    + len(regexp_extract_all(text, '[<\[]\\*(\|(im_start|im_sep|im_end|system|user|assistant|endoftext)\|>|/?s>|/?INST\])')) AS size
  FROM turns
), placed AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS stop FROM sized
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY stop)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY stop) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars,
  count(*) FILTER (WHERE role = 'assistant') AS n_examples,
  CAST(coalesce(sum(stop) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS example_chars
FROM placed GROUP BY conv_id
"""

QUERIES = {"op1_chat_formatting": (op1_chat_formatting, SQL)}
