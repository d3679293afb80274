"""Importance and recency of memories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of kinds, of any other kind, and the half-life of recency (fixed values).
WEIGHTS = {"decision": 1.0, "constraint": 0.9, "preference": 0.7, "fact": 0.6, "code": 0.5, "state": 0.4}
OTHER_WEIGHT = 0.5
HALF_LIFE_MS = 30 * 24 * 60 * 60 * 1000


def kind_weight(kind: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for name, weight in WEIGHTS.items():
        out = F.when(kind == name, weight).otherwise(out)
    return out


def base_importance(kind: Column, seen_count: Column) -> Column:
    return kind_weight(kind) + F.log1p(F.greatest(F.lit(0), seen_count - 1).cast("double"))


def recency(last_seen: Column, now_ms: int) -> Column:
    age = F.greatest(F.lit(0).cast("long"), F.lit(now_ms).cast("long") - last_seen)
    return F.pow(F.lit(0.5), age / HALF_LIFE_MS)


def dynamic_importance(importance: Column, last_seen: Column, now_ms: int) -> Column:
    """Base importance and recency."""
    return importance + recency(last_seen, now_ms)
