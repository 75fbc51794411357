"""Spanning forests, flow, colouring and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.errors import AlgorithmError, GraphOperationError, ValidationError
from graphloom.graphs.model import PropertyGraph
from graphloom.operators import small
from graphloom.operators.centrality import degrees
from graphloom.operators.kernels import per_component
from graphloom.session import cut_step as cut

STRATEGIES = ("largest_first", "smallest_last", "random_sequential", "independent_set", "connected_sequential", "connected_sequential_bfs", "connected_sequential_dfs", "DSATUR")


def spanning_forest(graph: PropertyGraph, weight: str | None = "weight", algorithm: str = "kruskal") -> DataFrame:
    """(``src``, ``dst``, ``weight``) of the minimum spanning forest of an undirected graph.

    In each round every component takes its lightest edge outwards (ties by the ends, so the forest
    is unique) and components so joined merge; rounds grow with the logarithm of the vertices. The
    names kruskal, prim and boruvka give the same forest. Few edges (they are counted) are done in one
    task.
    """
    if graph.directed:
        raise GraphOperationError("a spanning forest needs an undirected graph")
    if algorithm not in ("kruskal", "prim", "boruvka"):
        raise ValidationError(f"unknown algorithm {algorithm!r}")
    left = cut(graph.weights(weight).where("src <> dst").select("src", "dst", "weight", F.col("src").alias("a"), F.col("dst").alias("b")))
    if small.fits(left.count(), 1):
        kind = dict(graph.vertices.dtypes)["id"]
        one = left.select(F.col("src").alias("id")).limit(1)
        return small.in_one_task(left, one, small.lightest_forest, f"src {kind}, dst {kind}, weight double")
    forest = left.select("src", "dst", "weight").limit(0)
    while left.limit(1).count():
        edge = F.struct("weight", "src", "dst")
        sides = left.select(F.col("a").alias("c"), F.col("b").alias("other"), edge.alias("e")).unionByName(left.select(F.col("b").alias("c"), F.col("a").alias("other"), edge.alias("e")))
        chosen = cut(sides.groupBy("c").agg(F.min(F.struct("e", "other")).alias("m")).select("c", "m.other", "m.e.*"))
        forest = forest.unionByName(chosen.select("src", "dst", "weight").distinct())
        labels = cut(_roots(chosen))
        moved = left.join(labels.select(F.col("id").alias("a"), F.col("root").alias("ca")), "a").join(labels.select(F.col("id").alias("b"), F.col("root").alias("cb")), "b").where("ca <> cb")
        # of the edges between two components only the lightest can be chosen later
        pair = [F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")]
        left = cut(moved.groupBy(*pair).agg(F.min(edge).alias("e")).select("e.src", "e.dst", "e.weight", "a", "b"))
    return forest


def _roots(chosen: DataFrame) -> DataFrame:
    """(``id``, ``root``) from the edge each component has chosen (``c`` its component, ``other`` the
    one at the other end): two components that chose one another are led by the lesser, all others
    follow their choice; pointers then jump until all point to a leader."""
    back = chosen.select(F.col("c").alias("other"), F.col("other").alias("c"), F.lit(True).alias("mutual"))
    p = chosen.join(back, ["c", "other"], "left").select(F.col("c").alias("id"), F.when(F.col("mutual") & (F.col("c") < F.col("other")), F.col("c")).otherwise(F.col("other")).alias("root"))
    while True:
        p = cut(p)
        jump = p.join(p.select(F.col("id").alias("root"), F.col("root").alias("next")), "root")
        if not jump.where("root <> next").limit(1).count():
            return p
        p = jump.select("id", F.col("next").alias("root"))


def maximum_flow(graph: PropertyGraph, source: object, sink: object, capacity: str = "capacity") -> tuple[float, DataFrame]:
    """Flow value and (``src``, ``dst``, ``flow``) of every edge of the component of the source.

    Edges without a capacity are unlimited; an unlimited path is an error.
    """
    if not graph.directed:
        raise GraphOperationError("flow needs directions")
    if source == sink:
        raise ValidationError("source and sink are the same")
    graph.require(source, sink)
    flow = cut(per_component(graph, "maximum_flow", "src {id}, dst {id}, flow double", {"source": source, "sink": sink}, (capacity,)))
    if flow.where("flow IS NULL").limit(1).count():
        raise AlgorithmError("the flow is unbounded")
    net = flow.agg(F.coalesce(F.sum(F.when(F.col("src") == F.lit(source), F.col("flow")).when(F.col("dst") == F.lit(source), -F.col("flow"))), F.lit(0.0)).alias("v")).first()[0]
    return net, flow.select("src", "dst", "flow")


def colouring(graph: PropertyGraph, strategy: str = "largest_first", seed: int = 0) -> DataFrame:
    """(``id``, ``colour``) such that neighbours differ.

    ``largest_first`` colours, in rounds, every vertex whose larger neighbours (by degree, then id)
    are coloured: exactly the sequential greedy colouring. Other strategies run by component.
    """
    if strategy not in STRATEGIES:
        raise ValidationError(f"unknown strategy {strategy!r}")
    if strategy != "largest_first":
        return per_component(graph, "greedy_colouring", "id {id}, colour int", {"strategy": strategy, "seed": seed}).select("id", "colour")
    simple = graph.undirected().edges.where("src <> dst").select("src", "dst")
    d = degrees(PropertyGraph(graph.vertices, simple)).select("id", "degree")
    both = simple.unionByName(simple.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    ranked = both.join(d.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    first = (F.col("ds") > F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    waits = cut(ranked.where(first).select(F.col("dst").alias("id"), F.col("src").alias("after")))
    left = cut(graph.vertices.select("id"))
    done = left.select("id", F.lit(0).alias("colour")).limit(0)
    used = cut(left.select("id", F.lit(0).alias("c")).limit(0))
    while left.limit(1).count():
        ready = left.join(waits.select("id"), "id", "left_anti")
        taken = used.groupBy("id").agg(F.sort_array(F.collect_set("c")).alias("taken"))
        free = F.coalesce(F.array_min(F.array_except(F.sequence(F.lit(0), F.size("taken")), F.col("taken"))), F.lit(0))
        new = cut(ready.join(taken, "id", "left").select("id", F.when(F.col("taken").isNull(), 0).otherwise(free).alias("colour")))
        done = done.unionByName(new)
        told = waits.join(new.select(F.col("id").alias("after"), F.col("colour").alias("c")), "after").select("id", "c")
        left = cut(left.join(new.select("id"), "id", "left_anti"))
        used = cut(used.unionByName(told).distinct().join(left, "id", "left_semi"))
        waits = cut(waits.join(new.select(F.col("id").alias("after")), "after", "left_anti").select("id", "after"))
    return done


def maximum_matching(graph: PropertyGraph, weight: str = "weight") -> DataFrame:
    """(``src``, ``dst``, ``weight``) of a matching of greatest size and then weight, by component."""
    return per_component(graph.undirected(), "maximum_matching", "src {id}, dst {id}, weight double", attributes=(weight,)).select("src", "dst", "weight")


def maximal_matching(graph: PropertyGraph) -> DataFrame:
    """(``src``, ``dst``): the matching that takes edges in the order of their ends while it can.

    In each round every edge that is the least at both its ends is taken, which is the same.
    """
    left = cut(graph.undirected().edges.where("src <> dst").select("src", "dst"))
    taken = left.limit(0)
    while left.limit(1).count():
        edge = F.struct("src", "dst")
        ends = left.select(F.col("src").alias("v"), edge.alias("e")).unionByName(left.select(F.col("dst").alias("v"), edge.alias("e")))
        least = ends.groupBy("v").agg(F.min("e").alias("e"))
        new = cut(least.groupBy("e").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("e.*"))
        taken = taken.unionByName(new)
        gone = new.select(F.col("src").alias("v")).unionByName(new.select(F.col("dst").alias("v")))
        left = cut(left.join(gone.withColumnRenamed("v", "src"), "src", "left_anti").join(gone.withColumnRenamed("v", "dst"), "dst", "left_anti").select("src", "dst"))
    return taken
