"""Traversal and shortest paths: level-synchronous relaxation over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import LIMITS, AlgorithmError, ResourceLimitError
from graphloom.graphs.model import PropertyGraph
from graphloom.operators import small
from graphloom.session import cut_step as cut


def bfs(arcs: DataFrame, sources: DataFrame, max_depth: int | None = None, target: object = None) -> DataFrame:
    """(``source``, ``id``, ``depth``, ``pred``) of everything reached along ``arcs``.

    ``sources`` has ``source`` (where a walk starts). Each round joins the frontier only; ``pred`` is
    the least predecessor, so paths are unique. Stops at ``max_depth``, or when every walk has met
    ``target``. Null sources are left out; repeated ones count once. Few edges and sources (both are
    counted) are walked in one task.
    """
    steps, kind = cut(arcs.select("src", "dst").where("src <> dst").distinct()), dict(arcs.dtypes)["src"]
    frontier = cut(sources.select("source").dropna().distinct().select("source", F.col("source").alias("id"), F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("pred")))
    if small.fits(steps.count(), frontier.count()):
        return cut(small.in_one_task(steps.withColumn("weight", F.lit(1.0)), frontier.select("id"), small.walks(max_depth), f"source {kind}, id {kind}, depth int, pred {kind}"))
    seen, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = frontier.join(steps, F.col("id") == F.col("src")).groupBy("source", F.col("dst").alias("id")).agg(F.min("src").alias("pred"))
        frontier = cut(reached.join(seen.select("source", "id"), ["source", "id"], "left_anti").select("source", "id", F.lit(depth).alias("depth"), "pred"))
        if not frontier.limit(1).count():
            break
        seen = cut(seen.unionByName(frontier)) if depth % 8 == 0 else seen.unionByName(frontier)
        if target is not None and frontier.where(F.col("id") == F.lit(target)).limit(1).count():
            break
    return seen


def _trace(tree: DataFrame, source: object, target: object) -> list:
    """The path to ``target`` by following predecessors: one lookup a step."""
    known = cut(tree.select("id", "pred"))
    path = [target]
    while path[-1] != source:
        row = known.where(F.col("id") == F.lit(path[-1])).select("pred").first()
        if row is None or row[0] is None or len(path) > LIMITS["nodes_per_call"]:
            raise AlgorithmError(f"no path from {source!r} to {target!r}")
        path.append(row[0])
    return path[::-1]


def _as_rows(spark: SparkSession, path: list, id_type: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(path)), f"step int, id {id_type}")


def shortest_path(graph: PropertyGraph, source: object, target: object) -> DataFrame:
    """(``step``, ``id``) of a path with the fewest edges; ties go to smaller predecessors.

    Unknown ends and unreachable targets are errors.
    """
    graph.require(source, target)
    spark, kind = graph.vertices.sparkSession, dict(graph.vertices.dtypes)["id"]
    tree = bfs(graph.arcs(), spark.createDataFrame([(source,)], f"source {kind}"), target=target)
    return _as_rows(spark, _trace(tree, source, target), kind)


def single_source(graph: PropertyGraph, source: object, weight: str | None = "weight", negative: bool = False) -> DataFrame:
    """(``id``, ``distance``, ``pred``) from ``source`` by weight (missing weights count 1).

    Every round relaxes the edges of vertices whose distance fell. Without ``negative`` a negative
    weight is an error (Dijkstra's condition); with it, distances that still fall after as many
    rounds as there are vertices mean a negative cycle, an error too (Bellman-Ford).
    """
    graph.require(source)
    arcs = cut(PropertyGraph(graph.vertices, graph.weights(weight), graph.directed).arcs())
    if not negative and arcs.where("weight < 0").limit(1).count():
        raise AlgorithmError("negative weight")
    kind = dict(graph.vertices.dtypes)["id"]
    n = graph.vertices.count()
    best = cut(graph.vertices.where(F.col("id") == F.lit(source)).select("id", F.lit(0.0).alias("distance"), F.lit(None).cast(kind).alias("pred")))
    frontier = best
    for round_no in range(n + 1):
        offers = frontier.join(arcs, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min(F.struct(F.col("distance") + F.col("weight"), F.col("src"))).alias("o"))
        offers = offers.select("id", F.col("o.col1").alias("d2"), F.col("o.src").alias("p2"))
        joined = offers.join(best, "id", "left")
        frontier = cut(joined.where(F.col("distance").isNull() | (F.col("d2") < F.col("distance") - 1e-12)).select("id", F.col("d2").alias("distance"), F.col("p2").alias("pred")))
        if not frontier.limit(1).count():
            break
        if round_no >= n:
            raise AlgorithmError("negative cycle")
        best = cut(best.join(frontier.select("id"), "id", "left_anti").unionByName(frontier))
    # among equally short ways the least predecessor
    ties = best.select(F.col("id").alias("src"), F.col("distance").alias("sd")).join(arcs, "src").join(best.select(F.col("id").alias("dst"), F.col("distance").alias("dd")), "dst")
    least = ties.where((F.abs(F.col("sd") + F.col("weight") - F.col("dd")) <= 1e-12) & (F.col("dst") != F.lit(source))).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("least"))
    if negative:
        return best
    return best.join(least, "id", "left").select("id", "distance", F.coalesce(F.when(F.col("pred").isNotNull(), F.col("least")), "pred").alias("pred"))


def weighted_path(graph: PropertyGraph, source: object, target: object, weight: str | None = "weight", negative: bool = False) -> DataFrame:
    """(``step``, ``id``) of a path of least weight between two vertices."""
    graph.require(source, target)
    spark, kind = graph.vertices.sparkSession, dict(graph.vertices.dtypes)["id"]
    return _as_rows(spark, _trace(single_source(graph, source, weight, negative), source, target), kind)


def all_pairs(graph: PropertyGraph, weight: str | None = None) -> DataFrame:
    """(``src``, ``dst``, ``distance``) of all connected pairs, a vertex and itself included.

    The result is quadratic, so the number of vertices is limited (``LIMITS["all_pairs_nodes"]``).
    With a weight, distances are relaxed for all sources at once.
    """
    if graph.vertices.count() > LIMITS["all_pairs_nodes"]:
        raise ResourceLimitError("too many vertices for all pairs")
    return pair_distances(graph, weight)


def pair_distances(graph: PropertyGraph, weight: str | None = None) -> DataFrame:
    """As ``all_pairs`` without the limit."""
    sources = graph.vertices.select(F.col("id").alias("source"))
    if weight is None:
        return bfs(graph.arcs(), sources).select(F.col("source").alias("src"), F.col("id").alias("dst"), F.col("depth").cast("double").alias("distance"))
    arcs = cut(PropertyGraph(graph.vertices, graph.weights(weight), graph.directed).arcs())
    if arcs.where("weight < 0").limit(1).count():
        raise AlgorithmError("negative weight")
    best = cut(sources.select("source", F.col("source").alias("id"), F.lit(0.0).alias("distance")))
    frontier = best
    while True:
        offers = frontier.join(arcs, F.col("id") == F.col("src")).groupBy("source", F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("weight")).alias("d2"))
        joined = offers.join(best, ["source", "id"], "left")
        frontier = cut(joined.where(F.col("distance").isNull() | (F.col("d2") < F.col("distance") - 1e-12)).select("source", "id", F.col("d2").alias("distance")))
        if not frontier.limit(1).count():
            return best.select(F.col("source").alias("src"), F.col("id").alias("dst"), "distance")
        best = cut(best.join(frontier, ["source", "id"], "left_anti").unionByName(frontier))


def eccentricities(graph: PropertyGraph) -> DataFrame:
    """(``id``, ``eccentricity``, ``reached``): greatest distance, and how many vertices are reached."""
    return pair_distances(graph).groupBy(F.col("src").alias("id")).agg(F.max("distance").cast("bigint").alias("eccentricity"), F.count(F.lit(1)).alias("reached"))


def citation_network(references: DataFrame, seeds: DataFrame, max_depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Vertices (``id``, ``level``) and edges (``src``, ``dst``) within ``max_depth`` of the seeds.

    ``references`` has ``src`` (a work whose record is held) and ``dst``. Only works that have a
    record are expanded. Depth is at most 5. Edges that lead back to works already reached are kept.
    """
    depth = min(max_depth, 5)
    arcs = references.select("src", "dst").dropna().distinct()
    start = seeds.select(F.lit(0).alias("source"), F.col("id")).dropna().distinct()
    frontier = cut(start.select("id").distinct().withColumn("level", F.lit(0)))
    seen = frontier
    for level in range(1, depth + 1):
        reached = frontier.join(arcs, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier = cut(reached.join(seen, "id", "left_anti").withColumn("level", F.lit(level)))
        seen = seen.unionByName(frontier)
    edges = arcs.join(seen.where(F.col("level") < depth).select(F.col("id").alias("src")), "src", "left_semi")
    return seen, edges
