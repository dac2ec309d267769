"""Layered settings and the key-value store with deletes.

``settings`` rows are (scope, key, value, priority, seq, op) where op is
``set`` or ``delete``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_layers(settings: DataFrame, keys: tuple[str, ...] = ("scope", "key")) -> DataFrame:
    """Per key: the value of the highest-priority layer that has one; a null
    value never overrides (only null is filled). Keys with no value anywhere
    resolve to null. One aggregation, combined map-side."""
    rank = F.when(F.col("value").isNotNull(), F.col("priority"))
    return settings.groupBy(*keys).agg(F.max_by("value", rank).alias("value"), F.max(rank).alias("priority"))


def kv_current(settings: DataFrame, keys: tuple[str, ...] = ("scope", "key")) -> DataFrame:
    """Current contents of a set/delete log: the last write per key (by seq)
    wins and keys whose last write is a delete are gone."""
    last = settings.groupBy(*keys).agg(F.max_by(F.struct("op", "value"), "seq").alias("__w"))
    return last.filter(F.col("__w.op") != "delete").select(*keys, F.col("__w.value").alias("value"))
