"""Dotted paths over the listing schema, keeping *missing* apart from *null*.

A path is missing when a parent is null, a map lacks the key, an index is out of range, or the schema has no such
field. A null leaf in a present parent is not missing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Resolved:
    value: Column
    missing: Column
    kind: T.DataType
    json_text: bool = False  # value is JSON text of unknown type (leaf of an open map)


# Open maps whose text values are JSON.
JSON_MAPS = {"features", "extra"}


def resolve_path(schema: T.StructType, path: str) -> Resolved:
    if path == "":
        return Resolved(F.struct(*[F.col(f.name) for f in schema.fields]), F.lit(False), schema)
    value, kind, missing = None, schema, F.lit(False)
    json_text = False
    for depth, part in enumerate(path.split(".")):
        if isinstance(kind, T.StructType):
            if part not in kind.names:
                if depth == 1 and path.startswith("enriched.") and "attrs" in kind.names:
                    # A portal's own facts, kept by dotted path.
                    name = path[len("enriched.") :]
                    held = F.coalesce(F.map_contains_key(value["attrs"], name), F.lit(False))
                    return Resolved(F.try_element_at(value["attrs"], F.lit(name)), ~held, T.StringType())
                return Resolved(F.lit(None), F.lit(True), T.NullType())
            if value is not None:
                missing = missing | value.isNull()
            value = F.col(part) if value is None else value.getField(part)
            kind = kind[part].dataType
        elif isinstance(kind, T.MapType):
            present = F.coalesce(F.map_contains_key(value, part), F.lit(False))
            missing = missing | ~present
            value = F.try_element_at(value, F.lit(part))
            json_text = depth == 1 and path.split(".")[0] in JSON_MAPS
            kind = kind.valueType
        elif isinstance(kind, T.ArrayType) and part.isdigit():
            missing = missing | F.coalesce(F.size(value) <= int(part), F.lit(True))
            value = F.get(value, int(part))
            kind = kind.elementType
        elif json_text:
            # Below an open map: an object's key, or a place in an array.
            held = F.try_parse_json(value)
            quoted = part.replace("\\", "\\\\").replace("'", "\\'")
            found = F.try_variant_get(held, f"$['{quoted}']", "variant")
            if part.isdigit():
                found = F.coalesce(found, F.try_variant_get(held, f"$[{part}]", "variant"))
            missing = missing | found.isNull()
            value = F.nullif(F.to_json(found), F.lit("null"))
        else:
            return Resolved(F.lit(None), F.lit(True), T.NullType())
    return Resolved(value, F.coalesce(missing, F.lit(True)), kind, json_text)


def json_number(text: Column) -> Column:
    """Number held by a JSON text, null for any other value."""
    return F.when(~text.startswith('"'), text.try_cast("double"))


def json_string(text: Column) -> Column:
    """String held by a JSON text, null for any other value."""
    unpacked = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "ARRAY<STRING>")
    return F.when(text.startswith('"'), F.get(unpacked, 0))


def commute_minutes(target: str, mode: str) -> Column:
    """Minutes of the commute cell, null when any level is absent."""
    cell = F.try_element_at(F.try_element_at(F.col("enriched.commute"), F.lit(target)), F.lit(mode))
    return cell.getField("duration_min").cast("double")


def nesting(text: Column) -> Column:
    """Greatest nesting of objects and arrays in a JSON text."""
    bare = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]+", "")

    def step(s: Column, c: Column) -> Column:
        now = s["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(s["top"], now).alias("top"))

    marks = F.filter(F.split(bare, ""), lambda c: c != "")
    return F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")), step, lambda s: s["top"])
