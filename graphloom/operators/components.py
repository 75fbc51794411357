"""Connected components by star contraction: few rounds, no vertex's neighbours in one place."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut_step as cut

MAX_ROUNDS = 60
#: Up to so many distinct links are joined in one task: rounds of jobs would take longer.
LOCAL_LINKS = 50_000


def _least(pairs: DataFrame) -> DataFrame:
    """(``v``, ``m``): the least of each vertex and its neighbours; combines on the map side."""
    return pairs.groupBy("v").agg(F.min("n").alias("m")).select("v", F.least("v", "m").alias("m"))


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The least vertex connected to each, by disjoint sets whose root is their least vertex."""
    root: dict = {}

    def find(v: object) -> object:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for batch in batches:
        for a, b in zip(batch["v"].tolist(), batch["n"].tolist(), strict=True):
            root.setdefault(a, a)
            root.setdefault(b, b)
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    ids = list(root)
    if ids:
        yield pd.DataFrame({"id": ids, "component": [find(v) for v in ids]})


def component_labels(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(``id``, ``component``): each vertex that has an edge with the least id it is connected to.

    Alternates two contractions until nothing changes: every larger neighbour of a vertex is linked
    to the least of its neighbourhood, then every vertex and its smaller neighbours to the least of
    these. Rounds grow with the logarithm of the longest shortest path. Nulls, self-loops, repeated
    and reversed edges are allowed; self-loops alone make a component of their own; no edges give no
    rows. Ids may be of any ordered type. Up to LOCAL_LINKS links (the number is checked) the same
    labels are found in one task.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).dropna()
    loops = e.where("u = v").select(F.col("u").alias("id"))
    links = cut(e.where("u <> v").select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("n")).distinct())
    if links.count() <= LOCAL_LINKS:
        kind = dict(links.dtypes)["v"]
        found = cut(links.coalesce(1).mapInPandas(_joined, f"id {kind}, component {kind}"))
        alone = loops.distinct().join(found, "id", "left_anti")
        return found.unionByName(alone.select("id", F.col("id").alias("component")))
    vertices = loops.unionByName(links.select(F.col("v").alias("id"))).unionByName(links.select(F.col("n").alias("id"))).distinct()
    before = None
    for _ in range(MAX_ROUNDS):
        both = links.unionByName(links.select(F.col("n").alias("v"), F.col("v").alias("n")))
        large = both.join(_least(both), "v").where("n > v").select(F.col("n").alias("v"), F.col("m").alias("n")).where("v <> n").distinct()
        small = _least(large)
        links = cut(large.join(small, "v").where("n <> m").select(F.col("n").alias("v"), F.col("m").alias("n")).unionByName(small.select("v", F.col("m").alias("n"))).where("v <> n").distinct())
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "n").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixpoint after {MAX_ROUNDS} rounds")
    return vertices.join(links.select(F.col("v").alias("id"), F.col("n").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
