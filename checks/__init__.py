"""Registered queries: name -> (Spark query, DuckDB SQL or None)."""

from importlib import import_module

GROUPS = ["merge", "rules", "search", "text", "urls", "enrich", "stores", "jobs", "portals", "trees", "streams", "failures", "store"]
ALL = {}
for _group in GROUPS:
    _queries = import_module(f"checks.{_group}").QUERIES
    assert not set(ALL) & set(_queries), set(ALL) & set(_queries)
    ALL.update(_queries)
