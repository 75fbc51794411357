"""Components, clustering, statistics, order and cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.errors import GraphOperationError
from graphloom.graphs.model import PropertyGraph
from graphloom.operators import small
from graphloom.operators.centrality import degrees
from graphloom.operators.components import component_labels
from graphloom.operators.kernels import per_component
from graphloom.operators.paths import bfs, eccentricities
from graphloom.session import cut_step as cut


def components(graph: PropertyGraph) -> DataFrame:
    """(``id``, ``component``): least id of the (weakly) connected component of every vertex."""
    labels = component_labels(graph.edges)
    return graph.vertices.select("id").join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_sizes(labels: DataFrame) -> DataFrame:
    """(``component``, ``size``), to be ordered by size."""
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def strong_components(graph: PropertyGraph) -> DataFrame:
    """(``id``, ``component``): least id of the strongly connected component of every vertex.

    Vertices without predecessors or successors are set aside; the least ids spread along and against
    the edges, and where both meet a component is complete; the rest is taken on. Few edges and
    vertices (both are counted) are done in one task.
    """
    if not graph.directed:
        return components(graph)
    vertices = cut(graph.vertices.select("id"))
    arcs = cut(graph.edges.select("src", "dst").where("src <> dst").distinct())
    if small.fits(arcs.count(), 1) and vertices.count() <= small.LOCAL_ARCS:
        kind = dict(vertices.dtypes)["id"]
        return cut(small.in_one_task(arcs.withColumn("weight", F.lit(1.0)), vertices, small.strong_sets, f"id {kind}, component {kind}"))
    done = vertices.select("id", F.col("id").alias("component")).limit(0)
    while True:
        while True:  # trim
            inner = vertices.join(arcs.select(F.col("src").alias("id")), "id", "left_semi").join(arcs.select(F.col("dst").alias("id")), "id", "left_semi")
            inner = cut(inner)
            gone = cut(vertices.join(inner, "id", "left_anti"))
            if not gone.limit(1).count():
                break
            done = done.unionByName(gone.select("id", F.col("id").alias("component")))
            vertices = inner
            arcs = cut(arcs.join(vertices.withColumnRenamed("id", "src"), "src", "left_semi").join(vertices.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
        if not vertices.limit(1).count():
            return done
        colour = cut(vertices.select("id", F.col("id").alias("colour")))
        while True:  # the least id that reaches each vertex
            offers = colour.join(arcs, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("o"))
            new = cut(colour.join(offers, "id", "left").select("id", F.least("colour", F.coalesce("o", "colour")).alias("colour"), (F.col("o") < F.col("colour")).alias("moved")))
            colour = new.select("id", "colour")
            if not new.where("moved").limit(1).count():
                break
        pairs = arcs.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("cd")), "dst")
        inside = cut(pairs.where("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        roots = colour.where("id = colour").select(F.col("id").alias("source"))
        found = cut(bfs(inside, roots).select("id", F.col("source").alias("component")))
        done = done.unionByName(found)
        vertices = cut(vertices.join(found.select("id"), "id", "left_anti"))
        arcs = cut(arcs.join(vertices.withColumnRenamed("id", "src"), "src", "left_semi").join(vertices.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))


def connectivity(graph: PropertyGraph) -> DataFrame:
    """One row: numbers of components and whether the graph is connected; empty graphs aren't."""
    weak = components(graph).agg(F.countDistinct("component").alias("weak_components"))
    strong = strong_components(graph).agg(F.countDistinct("component").alias("strong_components"))
    return weak.join(F.broadcast(strong), F.lit(True)).select("weak_components", "strong_components", (F.col("weak_components") == 1).alias("is_weakly_connected"), (F.col("strong_components") == 1).alias("is_strongly_connected"))


def triangles(graph: PropertyGraph) -> DataFrame:
    """(``id``, ``triangles``) of every vertex, without directions and self-loops.

    Edges point from the smaller to the larger degree, so no vertex opens more than about
    sqrt(2 * edges) pairs, however many neighbours it has.
    """
    simple = graph.undirected().edges.where("src <> dst").select("src", "dst")
    d = degrees(PropertyGraph(graph.vertices, simple)).select("id", "degree")
    ranked = simple.join(d.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    up = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    oriented = cut(ranked.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b")))
    x, y, z = oriented.alias("x"), oriented.alias("y"), oriented.alias("z")
    found = x.join(y, F.col("x.b") == F.col("y.a")).join(z, (F.col("z.a") == F.col("x.a")) & (F.col("z.b") == F.col("y.b")))
    corners = found.select(F.explode(F.array("x.a", "x.b", "y.b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("t"))
    return graph.vertices.select("id").join(corners, "id", "left").select("id", F.coalesce("t", F.lit(0)).cast("bigint").alias("triangles"))


def clustering(graph: PropertyGraph) -> DataFrame:
    """(``id``, ``coefficient``): closed share of each vertex's pairs of neighbours."""
    simple = PropertyGraph(graph.vertices, graph.undirected().edges.where("src <> dst").select("src", "dst"))
    pairs = triangles(graph).join(degrees(simple).select("id", "degree"), "id")
    return pairs.select("id", F.when(F.col("degree") > 1, 2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0).alias("coefficient"), "triangles", "degree")


def clustering_summary(graph: PropertyGraph) -> DataFrame:
    """One row: ``average`` coefficient (zeros included) and ``transitivity`` (closed share of all
    pairs of neighbours; for directed graphs as without directions); zeros for an empty graph."""
    c = clustering(graph)
    triads = F.sum(F.col("degree") * (F.col("degree") - 1) / 2)
    return c.agg(F.coalesce(F.avg("coefficient"), F.lit(0.0)).alias("average"), F.coalesce(F.try_divide(F.sum("triangles").cast("double"), triads), F.lit(0.0)).alias("transitivity"))


def statistics(graph: PropertyGraph) -> DataFrame:
    """One row: counts, density and degree statistics (population deviation); zeros where empty."""
    d = degrees(graph)
    aggs = [f(c).alias(f"{c}_{name}") for c in ("degree", *(("in_degree", "out_degree") if graph.directed else ())) for name, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    base = graph.info().join(F.broadcast(d.agg(*aggs)), F.lit(True))
    pairs = F.col("nodes") * (F.col("nodes") - 1)
    density = F.when(F.col("nodes") > 1, F.col("edges") * (1.0 if graph.directed else 2.0) / pairs).otherwise(0.0)
    return base.withColumn("density", density).withColumn("is_multigraph", F.lit(False))


def diameter(graph: PropertyGraph) -> DataFrame:
    """One row of ``diameter`` and ``radius``; none unless (strongly) connected."""
    n = graph.vertices.count()
    e = eccentricities(graph).agg(F.max("eccentricity").alias("diameter"), F.min("eccentricity").alias("radius"), F.min("reached").alias("least"))
    return e.where(F.col("least") == n).select("diameter", "radius")


def full_statistics(graph: PropertyGraph, distances: bool = True) -> DataFrame:
    """One row: ``statistics``, the flags of ``connectivity``, and ``diameter`` and ``radius`` (null
    unless strongly connected, or if ``distances`` is off, as they cost a row for each pair)."""
    flags = connectivity(graph)
    flags = flags.select("is_weakly_connected", "is_strongly_connected") if graph.directed else flags.select(F.col("is_weakly_connected").alias("is_connected"))
    one = statistics(graph).join(F.broadcast(flags), F.lit(True))
    nothing = [F.lit(None).cast("bigint").alias(c) for c in ("diameter", "radius")]
    if not distances or not flags.first()[-1]:
        return one.select("*", *nothing)
    return one.join(F.broadcast(diameter(graph)), F.lit(True), "left")


def topological_levels(graph: PropertyGraph) -> DataFrame:
    """(``id``, ``level``): longest path from a root; ordering by (level, id) is a topological order.

    A cycle or an undirected graph is an error.
    """
    if not graph.directed:
        raise GraphOperationError("topological order needs directions")
    levels, left = _peel(graph)
    if left.limit(1).count():
        raise GraphOperationError("the graph has a cycle")
    return levels


def _peel(graph: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """Levels of what can be ordered, and the vertices on or behind cycles."""
    arcs = cut(graph.edges.select("src", "dst"))
    waits = arcs.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("waits"))
    left = cut(graph.vertices.select("id").join(waits, "id", "left").select("id", F.coalesce("waits", F.lit(0)).cast("bigint").alias("waits")))
    out, level = left.select("id", F.lit(0).alias("level")).limit(0), 0
    while True:
        free = cut(left.where("waits = 0").select("id"))
        if not free.limit(1).count():
            return out, left.select("id")
        out = out.unionByName(free.withColumn("level", F.lit(level)))
        # only the edges of what was freed are read: over all rounds each edge counts once
        told = arcs.join(free.withColumnRenamed("id", "src"), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("done"))
        left = cut(left.where("waits > 0").join(told, "id", "left").select("id", (F.col("waits") - F.coalesce("done", F.lit(0))).alias("waits")))
        level += 1


def is_dag(graph: PropertyGraph) -> bool:
    """Whether a directed graph has no cycle."""
    return not _peel(graph)[1].limit(1).count()


def cycle_flags(graph: PropertyGraph) -> DataFrame:
    """One row ``has_cycle``, ``is_dag`` (null for an undirected graph)."""
    if not graph.directed:
        return cycle_count(graph).select("has_cycle", F.lit(None).cast("boolean").alias("is_dag"))
    acyclic = is_dag(graph)
    return graph.vertices.sparkSession.createDataFrame([(not acyclic, acyclic)], "has_cycle boolean, is_dag boolean")


def cycle_count(graph: PropertyGraph) -> DataFrame:
    """One row: independent cycles of an undirected graph, m - n + c."""
    c = components(graph).agg(F.countDistinct("component").alias("c"))
    i = graph.info().join(F.broadcast(c), F.lit(True))
    return i.select((F.col("edges") - F.col("nodes") + F.col("c")).alias("independent_cycles"), (F.col("edges") - F.col("nodes") + F.col("c") > 0).alias("has_cycle"))


def cycles(graph: PropertyGraph, limit: int = 100) -> DataFrame:
    """(``component``, ``cycle``): simple directed cycles, at most ``limit`` a component (a sample by
    design: there can be exponentially many), or a basis of an undirected graph's cycles, whole."""
    if not graph.directed:
        return per_component(graph, "cycle_basis", "cycle array<{id}>")
    strong = strong_components(graph)
    inner = graph.edges.select("src", "dst").join(strong.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(strong.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst").where("a = b").select("src", "dst")
    return per_component(PropertyGraph(graph.vertices, inner, True), "simple_cycles", "cycle array<{id}>", {"limit": limit})
