"""Centralities of vertices. All are exact; iterative ones cut their lineage every round."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.errors import AlgorithmError
from graphloom.graphs.model import PropertyGraph, ranked
from graphloom.operators import small
from graphloom.operators.paths import pair_distances
from graphloom.session import cut_step as cut

#: Rounds between two looks at the change of the scores.
ROUNDS_A_LOOK = 5


def degrees(graph: PropertyGraph) -> DataFrame:
    """(``id``, ``degree``, ``in_degree``, ``out_degree``) of every vertex; a self-loop counts twice."""
    ends = graph.edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(graph.edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return graph.vertices.select("id").join(sums, "id", "left").select("id", (zero("i") + zero("o")).alias("degree"), zero("i").alias("in_degree"), zero("o").alias("out_degree"))


def degree_centrality(graph: PropertyGraph, top: int | None = None, column: str = "degree") -> DataFrame:
    """(``id``, ``score``): degree over n - 1; 1 in a graph of one vertex."""
    d = degrees(graph)
    n = d.agg(F.count(F.lit(1)).alias("n"))
    score = d.join(F.broadcast(n), F.lit(True)).select("id", F.when(F.col("n") > 1, F.col(column) / (F.col("n") - 1)).otherwise(1.0).alias("score"))
    return ranked(score, "score", "id", top)


def closeness(graph: PropertyGraph, top: int | None = None) -> DataFrame:
    """(``id``, ``score``) by incoming distances, scaled by the share of vertices that reach it."""
    n = graph.vertices.count()
    d = pair_distances(graph).groupBy(F.col("dst").alias("id")).agg(F.sum("distance").alias("s"), F.count(F.lit(1)).alias("r"))
    score = F.when((F.col("s") > 0) & F.lit(n > 1), (F.col("r") - 1) / F.col("s") * (F.col("r") - 1) / max(n - 1, 1)).otherwise(0.0)
    return ranked(d.select("id", score.alias("score")), "score", "id", top)


def betweenness(graph: PropertyGraph, top: int | None = None, normalized: bool = True) -> DataFrame:
    """(``id``, ``score``): exact betweenness of unweighted shortest paths.

    All sources advance level by level; path counts are summed forwards, dependencies backwards. The
    state has a row for each reached pair of vertices and is spread by both. Few edges and vertices
    (both are counted) are walked in one task.
    """
    arcs = cut(graph.arcs().select("src", "dst").where("src <> dst").distinct())
    n = graph.vertices.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if normalized and n > 2 else (1.0 if graph.directed else 0.5)
    if small.fits(arcs.count(), n):
        kind = dict(graph.vertices.dtypes)["id"]
        found = small.in_one_task(arcs.withColumn("weight", F.lit(1.0)), graph.vertices, small.dependencies, f"id {kind}, delta double")
        return ranked(found.select("id", (F.col("delta") * scale).alias("score")), "score", "id", top)
    levels = [cut(graph.vertices.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("sigma")))]
    seen = levels[0].select("s", "id")
    while True:
        step = levels[-1].join(arcs, F.col("id") == F.col("src")).groupBy("s", F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma"))
        new = cut(step.join(seen, ["s", "id"], "left_anti"))
        if not new.limit(1).count():
            break
        levels.append(new)
        seen = seen.unionByName(new.select("s", "id"))
    total = None
    below = None
    for level in reversed(levels[1:]):
        here = level if below is None else level.join(below, ["s", "id"], "left")
        delta = here.select("s", "id", "sigma", (F.lit(0.0) if below is None else F.coalesce("d", F.lit(0.0))).alias("delta"))
        delta = cut(delta)
        total = delta.select("id", "delta") if total is None else total.unionByName(delta.select("id", "delta"))
        above = levels[levels.index(level) - 1].select("s", F.col("id").alias("src"), F.col("sigma").alias("up"))
        below = delta.join(arcs, F.col("id") == F.col("dst")).join(above, ["s", "src"]).groupBy("s", F.col("src").alias("id")).agg(F.sum(F.col("up") / F.col("sigma") * (1 + F.col("delta"))).alias("d"))
    sums = graph.vertices.select("id").withColumn("delta", F.lit(0.0)) if total is None else graph.vertices.select("id", F.lit(0.0).alias("delta")).unionByName(total)
    return ranked(sums.groupBy("id").agg((F.sum("delta") * scale).alias("score")), "score", "id", top)


def eigenvector(graph: PropertyGraph, max_rounds: int = 1000, tolerance: float = 1e-6, fixed_rounds: int | None = None, top: int | None = None) -> DataFrame:
    """(``id``, ``score``) by power iteration on A + I, of length one; incoming edges count.

    Stops when the scores change by less than ``tolerance`` times n in a round, or after
    ``fixed_rounds``; without either it fails to converge, an error. No edges give no rows.
    """
    arcs = cut(graph.arcs().select("src", "dst").unionByName(graph.vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"))))
    n = graph.vertices.count()
    if arcs.limit(n + 1).count() <= n:
        return graph.vertices.select("id", F.lit(0.0).alias("score")).limit(0)
    x, rounds = cut(graph.vertices.select("id", F.lit(1.0 / n).alias("score"))), fixed_rounds or max_rounds
    for done in range(1, rounds + 1):
        # one join and one aggregate a round, on the scores of the round before only
        y = cut(x.join(arcs, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.sum("score").alias("score")))
        if done % ROUNDS_A_LOOK and done != rounds:
            x = y  # lengths matter only where scores are looked at
            continue
        norm = y.agg(F.sqrt(F.sum(F.col("score") * F.col("score")))).first()[0]
        y = y.select("id", (F.col("score") / norm).alias("score"))
        if fixed_rounds is None:
            before = x.agg(F.sqrt(F.sum(F.col("score") * F.col("score")))).first()[0]
            moved = y.join(x.select("id", (F.col("score") / before).alias("was")), "id").agg(F.sum(F.abs(F.col("score") - F.col("was")))).first()[0]
            if moved < n * tolerance:
                return ranked(y, "score", "id", top)
        x = y
    if fixed_rounds is None:
        raise AlgorithmError("Failed to converge")
    return ranked(x, "score", "id", top)


def pagerank(graph: PropertyGraph, alpha: float = 0.85, max_rounds: int = 100, tolerance: float = 1e-6, weight: str | None = "weight", fixed_rounds: int | None = None, top: int | None = None) -> DataFrame:
    """(``id``, ``score``), summing to one; mass of vertices without successors is spread evenly.

    Stops when the scores change by less than ``tolerance`` times n in all, at the latest after
    ``max_rounds``; ``fixed_rounds`` runs so many. Missing weights count 1. Few edges and vertices
    (both are counted) are ranked in one task.
    """
    n = graph.vertices.count()
    if not n:
        return graph.vertices.select("id", F.lit(0.0).alias("score"))
    arcs = PropertyGraph(graph.vertices, graph.weights(weight), graph.directed).arcs()
    out = arcs.groupBy("src").agg(F.sum("weight").alias("total")).where("total > 0")
    share = cut(arcs.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    rounds = fixed_rounds or max_rounds
    if n <= small.LOCAL_ARCS and small.fits(share.count(), 1):
        kind = dict(graph.vertices.dtypes)["id"]
        found = small.in_one_task(share.withColumnRenamed("share", "weight"), graph.vertices, small.ranks(alpha, rounds, tolerance if fixed_rounds is None else None), f"id {kind}, score double")
    else:
        found = _rank_rounds(graph, share, out, n, alpha, rounds, tolerance, fixed_rounds)
    return ranked(found, "score", "id", top)


def _rank_rounds(graph: PropertyGraph, share: DataFrame, out: DataFrame, n: int, alpha: float, rounds: int, tolerance: float, fixed_rounds: int | None) -> DataFrame:
    """PageRank by one job a round."""
    walk = cut(graph.vertices.select("id").join(out.select(F.col("src").alias("id"), F.lit(True).alias("goes")), "id", "left").select("id", F.coalesce("goes", F.lit(False)).alias("goes")))
    goes = walk.where("goes").count()
    x = cut(walk.select("id", "goes", F.lit(1.0 / n).alias("score"), F.lit(0.0).alias("moved")))
    stuck = 1.0 - goes / n
    for done in range(1, rounds + 1):
        # one join and one aggregate a round, on the scores of the round before only; every vertex
        # hands a zero to itself, so that all are there and bring their own score along
        handed = x.join(share, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("score") * F.col("share")).alias("given"), F.lit(None).cast("boolean").alias("goes"), F.lit(None).cast("double").alias("was"))
        own = x.select("id", F.lit(0.0).alias("given"), "goes", F.col("score").alias("was"))
        sums = handed.unionByName(own).groupBy("id").agg(F.max("goes").alias("goes"), F.sum("given").alias("given"), F.max("was").alias("was"))
        score = alpha * (F.col("given") + F.lit(stuck / n)) + (1 - alpha) / n
        x = cut(sums.select("id", "goes", score.alias("score"), F.abs(score - F.col("was")).alias("moved")))
        told = x.agg(F.coalesce(F.sum(F.when(~F.col("goes"), F.col("score"))), F.lit(0.0)), F.sum("moved")).first() if goes < n or fixed_rounds is None else (0.0, 0.0)
        stuck = told[0]
        if fixed_rounds is None and told[1] < n * tolerance:
            break
    return x.select("id", "score")


def centrality_measures(graph: PropertyGraph, measures: Iterable[str] | None = None) -> DataFrame:
    """(``measure``, ``id``, ``score``); unknown names are ignored, PageRank needs directions."""
    known = {
        "degree": lambda: [("degree", degree_centrality(graph))] + ([(f"{k}_degree", degree_centrality(graph, column=f"{k}_degree")) for k in ("in", "out")] if graph.directed else []),
        "betweenness": lambda: [("betweenness", betweenness(graph))],
        "closeness": lambda: [("closeness", closeness(graph))],
        "eigenvector": lambda: [("eigenvector", eigenvector(graph))],
        "pagerank": lambda: [("pagerank", pagerank(graph))] if graph.directed else [],
    }
    out = graph.vertices.select(F.lit("").alias("measure"), "id", F.lit(0.0).alias("score")).limit(0)
    for name in measures if measures is not None else ("degree", "betweenness", "closeness", "eigenvector"):
        for label, scores in known.get(name, list)():
            out = out.unionByName(scores.select(F.lit(label).alias("measure"), "id", "score"))
    return out
