"""Weighted 0-100 scoring."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentweave.functions.normalize import Categorical, Linear, Sigmoid, Step
from rentweave.functions.numbers import round_half_up
from rentweave.functions.paths import commute_minutes, json_number, json_string, resolve_path
from rentweave.functions.plan import with_expressions

Normalizer = Linear | Step | Sigmoid | Categorical


class NotImplementedDim(NotImplementedError):
    """A language-model dimension was configured; none is evaluated."""


@dataclass(frozen=True)
class Commute:
    target: str
    mode: str


@dataclass(frozen=True)
class Dim:
    """``metric`` is a dotted path, a ``=``-prefixed SQL expression, or a commute cell."""

    name: str
    weight: float
    metric: str | Commute
    normalize: Normalizer
    on_missing: str = "zero"
    type: str = "rule"

    def __post_init__(self):
        if self.type != "rule":
            raise NotImplementedDim(f"scoring dim {self.name!r} has type {self.type!r}, which is not evaluated")
        if self.on_missing not in ("zero", "skip_dim", "fail"):
            raise ValueError(f"on_missing of {self.name!r} must be zero, skip_dim or fail")
        if self.weight <= 0:
            raise ValueError(f"weight of {self.name!r} must be positive")


def _held(dim: Dim) -> str:
    return f"_metric_{dim.name}"


def _metric(df: DataFrame, dim: Dim) -> tuple[Column, Column, T.DataType]:
    """Value, whether it is missing, and its type."""
    if isinstance(dim.metric, Commute):
        minutes = commute_minutes(dim.metric.target, dim.metric.mode)
        return minutes, minutes.isNull(), T.DoubleType()
    if dim.metric.startswith("="):
        value = F.col(_held(dim))
        return value, value.isNull(), df.schema[_held(dim)].dataType
    r = resolve_path(df.schema, dim.metric)
    if r.json_text:
        # An open map's value: as text for lookups, as a number for curves.
        lookup = isinstance(dim.normalize, Categorical) or (
            isinstance(dim.normalize, Step) and any(isinstance(b.eq, str) for b in dim.normalize.bands)
        )
        text = F.coalesce(json_string(r.value), r.value)
        return (text, r.missing, T.StringType()) if lookup else (json_number(r.value), r.missing, T.DoubleType())
    return r.value, r.missing, r.kind


def score_listing(df: DataFrame, dims: Sequence[Dim]) -> DataFrame:
    """Add ``final`` (0-100), ``breakdown`` (name -> [0, 1]) and ``score_error``.

    A missing metric of a ``fail`` dimension leaves ``final`` null and names the dimension in ``score_error``;
    the row belongs in the failure log. An expression that throws in a row is missing there, and only there.
    """
    texts = {_held(d): d.metric[1:] for d in dims if isinstance(d.metric, str) and d.metric.startswith("=")}
    df = with_expressions(df, texts)
    total, weight = F.lit(0.0), F.lit(0.0)
    entries, errors = [], []
    for dim in dims:
        value, missing, kind = _metric(df, dim)
        share = dim.normalize.compile(value, kind)
        w = F.lit(float(dim.weight))
        if dim.on_missing == "skip_dim":
            total = total + F.when(missing, F.lit(0.0)).otherwise(share * w)
            weight = weight + F.when(missing, F.lit(0.0)).otherwise(w)
            shown = F.when(~missing, share)
        else:
            total = total + F.when(missing, F.lit(0.0)).otherwise(share * w)
            weight = weight + w
            shown = F.when(missing, F.lit(0.0)).otherwise(share)
        if dim.on_missing == "fail":
            label = dim.metric if isinstance(dim.metric, str) else f"commute({dim.metric.target},{dim.metric.mode})"
            errors.append(F.when(missing, F.lit(f"missing metric {label} for dim {dim.name}")))
        entries.append(F.struct(F.lit(dim.name).alias("key"), shown.alias("value")))
    error = F.coalesce(*errors) if errors else F.lit(None).cast("string")
    kept = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
    staged = df.withColumns({"_total": total, "_weight": weight, "score_error": error})
    final = F.when(F.col("_weight") == 0, F.lit(0)).otherwise(
        round_half_up(F.try_divide(F.col("_total"), F.col("_weight")) * 100)
    )
    return staged.withColumns(
        {
            "final": F.when(F.col("score_error").isNull(), final.cast("int")),
            "breakdown": F.when(F.col("score_error").isNull(), F.map_from_entries(kept)),
        }
    ).drop("_total", "_weight", *texts)


def above_threshold(df: DataFrame, threshold: float = 75) -> DataFrame:
    return df.filter(F.col("final") >= threshold)
