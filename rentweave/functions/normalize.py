"""Scoring normalisers: each maps a metric to [0, 1]."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentweave.functions.numbers import number_text


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


@dataclass(frozen=True)
class Linear:
    """(x - worst) / (best - worst), clamped. ``invert`` is accepted and has no effect."""

    best: float
    worst: float
    invert: bool = False

    def compile(self, raw: Column, kind: T.DataType) -> Column:
        if not _is_number(kind) or self.best == self.worst:
            return F.lit(0.0)
        share = (raw.cast("double") - F.lit(float(self.worst))) / F.lit(float(self.best - self.worst))
        # greatest/least skip nulls, so a null metric has to be caught first.
        known = share.isNotNull() & ~F.isnan(share)
        return F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Band:
    score: float
    gte: float | None = None
    lt: float | None = None
    eq: str | float | None = None
    otherwise: bool = False


@dataclass(frozen=True)
class Step:
    """First band that matches wins; its 0-10 score is divided by ten."""

    bands: Sequence[Band]

    def compile(self, raw: Column, kind: T.DataType) -> Column:
        out = None
        for band in self.bands:
            hit = F.lit(band.otherwise)
            if band.eq is not None and isinstance(band.eq, str) and isinstance(kind, T.StringType):
                hit = hit | raw.eqNullSafe(F.lit(band.eq))
            if band.eq is not None and not isinstance(band.eq, str) and _is_number(kind):
                hit = hit | raw.cast("double").eqNullSafe(F.lit(float(band.eq)))
            if _is_number(kind) and (band.gte is not None or band.lt is not None):
                span = raw.isNotNull()
                if band.gte is not None:
                    span = span & (raw.cast("double") >= F.lit(float(band.gte)))
                if band.lt is not None:
                    span = span & (raw.cast("double") < F.lit(float(band.lt)))
                hit = hit | F.coalesce(span, F.lit(False))
            value = F.lit(band.score / 10)
            out = F.when(hit, value) if out is None else out.when(hit, value)
        return out.otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Sigmoid:
    midpoint: float
    steepness: float
    invert: bool = False

    def compile(self, raw: Column, kind: T.DataType) -> Column:
        if not _is_number(kind):
            return F.lit(0.0)
        s = F.lit(1.0) / (
            F.lit(1.0) + F.exp(F.lit(-float(self.steepness)) * (raw.cast("double") - F.lit(float(self.midpoint))))
        )
        return F.coalesce(F.lit(1.0) - s if self.invert else s, F.lit(0.0))


@dataclass(frozen=True)
class Categorical:
    """Lookup by the value's text (a null looks up ``null``); scores are 0-10."""

    scores: Mapping[str, float]
    default: float = 0.0

    def compile(self, raw: Column, kind: T.DataType) -> Column:
        text = number_text(raw) if _is_number(kind) else raw.cast("string")
        text = F.coalesce(text, F.lit("null"))
        if not self.scores:
            return F.lit(self.default / 10)
        table = F.create_map(*[x for k, v in self.scores.items() for x in (F.lit(k), F.lit(float(v)))])
        return F.coalesce(F.try_element_at(table, text), F.lit(float(self.default))) / F.lit(10.0)
