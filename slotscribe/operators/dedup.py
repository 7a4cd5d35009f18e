"""Keep-first and keep-last by key, and the check against rows that are already stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in ``order``.

    Spark trims each map task to one row per key before the shuffle, so a key
    with very many copies costs one row per task, not one large group.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).where(F.col("_rn") == 1).drop("_rn")


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The earliest row of each key (conflict: do nothing)."""
    return _one_per_key(df, keys, [F.col(c).asc() if isinstance(c, str) else c for c in order])


def keep_last(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The latest row of each key (conflict: overwrite)."""
    return _one_per_key(df, keys, [F.col(c).desc() if isinstance(c, str) else c for c in order])


def not_stored(new: DataFrame, stored: DataFrame, keys: list[str], probe: DataFrame | None = None) -> DataFrame:
    """Rows whose key is not stored yet. Stored keys are unique, so neither side has a hot key.

    ``probe`` holds the new rows' values of the first key when they are few
    enough to broadcast (the caller counts them): stored rows are then filtered
    where they are read, and only actual conflicts reach the join.
    """
    stored = stored.select(*keys)
    if probe is not None:
        stored = stored.join(F.broadcast(probe.toDF(keys[0])), keys[0], "left_semi")
    return new.join(stored, keys, "left_anti")


def not_keyed(new: DataFrame, stored: DataFrame, key: str, item: str | None = None, probe: DataFrame | None = None) -> DataFrame:
    """Rows whose key, or key and item, is not among stored (key, item).

    Stored keys are bucketed by key, so only the new rows are dealt anew. With
    ``probe``, the few new keys, stored keys are filtered where they are read
    and at most as many conflicts as there are new keys are broadcast.
    """
    stored = stored.select(F.col("key").alias("_key"), F.col("item").alias("_item"))
    same = F.col(key) == F.col("_key")
    if item is not None:
        # Written so that it is no key of the join: both sides stay dealt by the first key only.
        same = same & (F.col(item) - F.col("_item") == 0)
    if probe is not None:
        stored = F.broadcast(stored.join(F.broadcast(probe.toDF("_key")), "_key", "left_semi"))
    return new.join(stored, same, "left_anti")
