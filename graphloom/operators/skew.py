"""Joins that stay even when one key holds a large part of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it is among the MAX_HOT most frequent ones and holds at least MIN_HOT rows. The
#: number bounds what is collected and broadcast; no other key can hold more than 1 / MAX_HOT of the
#: rows.
MAX_HOT = 500
MIN_HOT = 20_000


def hot_keys(df: DataFrame, on: list[str]) -> list[tuple]:
    """The at most MAX_HOT keys of ``df`` that are hot.

    The count combines on the map side, so a hot key costs one row per task. Keys holding a null are
    never hot: they match nothing in an equi-join.
    """
    counts = df.select(*on).dropna().groupBy(*on).count().where(F.col("count") >= MIN_HOT)
    return [tuple(r[c] for c in on) for r in counts.orderBy(F.desc("count")).limit(MAX_HOT).collect()]


def _is_hot(on: list[str], keys: list[tuple]) -> Column:
    if len(on) == 1:
        return F.coalesce(F.col(on[0]).isin([k[0] for k in keys]), F.lit(False))
    return F.coalesce(reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in zip(on, k, strict=True)]) for k in keys]), F.lit(False))


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", keys: list[tuple] | None = None) -> DataFrame:
    """Equi-join in which the hot keys of ``left`` are joined by broadcast and the rest by shuffle.

    ``right`` must hold each key once, so what is broadcast has at most MAX_HOT rows. ``how`` is inner, left, left_semi or left_anti. Without hot keys it is the
    plain join. Rows of ``left`` whose key holds a null match nothing. An empty side gives the
    ordinary result of the join. ``keys``, from ``hot_keys``, saves looking for them again.
    """
    keys = hot_keys(left, on) if keys is None else keys
    if not keys:
        return left.join(right, on, how)
    hot = _is_hot(on, keys)
    cold = left.where(~hot).join(right.where(~hot), on, how)
    return cold.unionByName(left.where(hot).join(F.broadcast(right.where(hot)), on, how))
