"""Registered queries of the training-data operators: name -> (Spark query, DuckDB SQL or None)."""

from importlib import import_module

import corpus_pipeline

GROUPS = ["chat_format", "url_filter", "byte_bpe", "language_id", "ngram_join", "decontaminate", "line_templates", "vp_search", "secret_scan", "lm_scoring", "token_files", "role_repair", "hard_negatives"]
QUERIES = {"pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)}
for _group in GROUPS:
    QUERIES.update(import_module(f"rentweave.llm.query_{_group}").QUERIES)
