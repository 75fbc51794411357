"""References whose target is missing, deleted or late, for composite keys with partial nulls."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.skew import skew_join

MATCHES = ("simple", "partial", "full")


def orphan_references(refs: DataFrame, targets: DataFrame, keys: list[str], time: str, held: str, gone: str, match: str = "simple") -> DataFrame:
    """References in ``refs`` that dangle, each with its ``reason``.

    ``refs`` has the key columns and a ``time`` column. ``targets`` has the key columns, ``held``
    (from when a row is held) and ``gone`` (from when it is deleted, null if never); a target with
    ``held`` null was deleted without ever being held. The reason is 'missing' if no held target
    matches, else 'deleted' if one is gone at the time of the reference, else 'late' if all are held
    only after it. A null time compares as unknown: such a reference can only be 'missing'.

    References are grouped by the null mask of their key and each group is anti-joined on its
    non-null columns only; targets are first reduced to one row per value of these columns, so a
    target that recurs can't multiply rows, and hot values go by broadcast (``skew_join``).
    ``match`` declares what a partly null key means, as in SQL's MATCH: 'simple' — it is never
    checked; 'partial' — it must match on its non-null columns; 'full' — it is an error and reported
    as 'missing'. A wholly null key is never checked. Extra columns of ``refs`` are kept, those of
    ``targets`` ignored; repeated references are each reported; empty tables give the ordinary
    result (without targets every checked reference is missing).
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    taken = [c for c in ("__held", "__gone") if c in refs.columns]
    if taken:
        raise ValueError(f"reserved column names in refs: {taken}")
    parts = []
    for mask in product((False, True), repeat=len(keys)):
        present = [k for k, null in zip(keys, mask, strict=True) if not null]
        if not present or (any(mask) and match == "simple"):
            continue
        own = refs.where(reduce(lambda a, b: a & b, [F.col(k).isNull() if null else F.col(k).isNotNull() for k, null in zip(keys, mask, strict=True)]))
        if any(mask) and match == "full":
            parts.append(own.withColumn("reason", F.lit("missing")))
            continue
        reduced = targets.groupBy(*present).agg(F.min(held).alias("__held"), F.min(gone).alias("__gone"))
        joined = skew_join(own, reduced.where(F.col("__held").isNotNull()), present, "left")
        reason = F.when(F.col("__held").isNull(), "missing").when(F.col("__gone") <= F.col(time), "deleted").when(F.col("__held") > F.col(time), "late")
        parts.append(joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(*refs.columns, "reason"))
    if not parts:
        return refs.withColumn("reason", F.lit(None).cast("string")).limit(0)
    return reduce(DataFrame.unionByName, parts)


def orphan_report(orphans: DataFrame, table: str = "tbl", period: str = "period") -> DataFrame:
    """Number of dangling references per table, period and reason."""
    return orphans.groupBy(table, period, "reason").agg(F.count(F.lit(1)).alias("n"))
