"""Communities and their modularity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.errors import ResourceLimitError, ValidationError
from graphloom.graphs.model import PropertyGraph
from graphloom.operators.kernels import per_component
from graphloom.operators.optimise import colouring
from graphloom.session import cut_step as cut

METHODS = ("louvain", "label_propagation", "greedy_modularity")


def communities(graph: PropertyGraph, method: str = "louvain", weight: str = "weight", resolution: float = 1.0) -> DataFrame:
    """(``id``, ``community``): the least id of each vertex's community; the same on every run."""
    if method not in METHODS:
        raise ValidationError(f"unknown method {method!r}")
    if method == "label_propagation":
        return label_propagation(graph)
    own = graph.undirected()
    own = PropertyGraph(own.vertices, own.weights(weight if method == "louvain" else None))
    total = own.edges.agg(F.sum("weight")).first()[0]
    if not total:
        return own.vertices.select("id", F.col("id").alias("community"))
    try:
        return per_component(own, method, "id {id}, community {id}", {"total": float(total), "resolution": resolution}, ("weight",)).select("id", "community")
    except ResourceLimitError:
        if method != "louvain":
            raise
        return louvain_rounds(own, float(total), resolution)


def louvain_rounds(graph: PropertyGraph, total: float, resolution: float = 1.0) -> DataFrame:
    """(``id``, ``community``) by Louvain's method over DataFrames, for components too large for one task.

    ``graph`` is undirected with a ``weight``, which sums to ``total``. Vertices are coloured and the
    classes take turns; all vertices of a class move at once to the neighbouring community of
    greatest gain (ties to the least). When a pass over all classes gains no modularity, communities
    become vertices and it starts again; when that gains none either it ends. Each pass is kept only
    if modularity grew, so it ends.
    """
    member = cut(graph.vertices.select("id", F.col("id").alias("community")))
    level = PropertyGraph(graph.vertices.select("id"), cut(graph.edges.select("src", "dst", "weight")))
    while True:
        moved = _local_moves(level, total, resolution)
        if moved is None:
            least = member.groupBy("community").agg(F.min("id").alias("least"))
            return member.join(least, "community").select("id", F.col("least").alias("community"))
        member = cut(member.join(moved.select(F.col("id").alias("community"), F.col("com").alias("next")), "community").select("id", F.col("next").alias("community")))
        sides = level.edges.join(moved.select(F.col("id").alias("src"), F.col("com").alias("a")), "src").join(moved.select(F.col("id").alias("dst"), F.col("com").alias("b")), "dst")
        merged = cut(sides.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("weight").alias("weight")))
        level = PropertyGraph(cut(moved.select(F.col("com").alias("id")).distinct()), merged)


def _local_moves(graph: PropertyGraph, total: float, resolution: float) -> DataFrame | None:
    """(``id``, ``com``) after moves that gain modularity, or None if there are none."""
    arcs = cut(graph.arcs().where("src <> dst").select("src", "dst", "weight"))
    k = graph.edges.select(F.explode(F.array("src", "dst")).alias("id"), "weight").groupBy("id").agg(F.sum("weight").alias("k"))
    state = cut(colouring(graph).join(k, "id", "left").select("id", F.col("id").alias("com"), F.coalesce("k", F.lit(0.0)).alias("k"), "colour"))
    classes = [r[0] for r in state.select("colour").distinct().orderBy("colour").collect()]
    quality = lambda s: modularity(graph, s.select("id", F.col("com").alias("community")), resolution=resolution).first()[0]
    best, kept = quality(state), None
    while True:
        for colour in classes:
            tot = state.groupBy("com").agg(F.sum("k").alias("tot"))
            turn = state.where(F.col("colour") == colour)
            near = arcs.join(turn.select(F.col("id").alias("src")), "src").join(state.select(F.col("id").alias("dst"), "com"), "dst").groupBy(F.col("src").alias("id"), "com").agg(F.sum("weight").alias("w"))
            offers = near.unionByName(turn.select("id", "com", F.lit(0.0).alias("w"))).groupBy("id", "com").agg(F.sum("w").alias("w")).join(tot, "com").join(turn.select("id", F.col("com").alias("own"), "k"), "id")
            stays = (F.col("com") == F.col("own")).cast("int")
            gain = F.round(F.col("w") - resolution * F.col("k") * (F.col("tot") - stays * F.col("k")) / (2 * total), 9)
            chosen = offers.groupBy("id").agg(F.min(F.struct((-gain).alias("g"), (1 - stays).alias("m"), "com")).alias("b")).select("id", F.col("b.com").alias("next"))
            state = cut(state.join(chosen, "id", "left").select("id", F.coalesce("next", "com").alias("com"), "k", "colour"))
        now = quality(state)
        if now <= best + 1e-7:
            return kept
        best, kept = now, state


def label_propagation(graph: PropertyGraph) -> DataFrame:
    """(``id``, ``community``) by majority of neighbours' labels, semi-synchronously.

    The vertices are coloured; the classes take turns, and all vertices of a class move at once to the
    label most of their neighbours have, keeping their own among equals, else the least. As
    neighbours never move together, each move adds edges within communities, so it ends: when no
    vertex wants another label.
    """
    both = cut(graph.undirected().arcs().where("src <> dst").select("src", "dst"))
    colours = cut(colouring(graph))
    classes = [r[0] for r in colours.select("colour").distinct().orderBy("colour").collect()]
    labels = cut(colours.select("id", F.col("id").alias("label"), "colour"))
    settled = 0
    while classes and settled < len(classes):
        for colour in classes:
            turn = labels.where(F.col("colour") == colour)
            votes = both.join(turn.select(F.col("id").alias("dst")), "dst").join(labels.select(F.col("id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("id"), "label").agg(F.count(F.lit(1)).alias("n"))
            judged = votes.join(turn.select("id", F.col("label").alias("own")), "id")
            best = judged.groupBy("id").agg(F.min(F.struct(-F.col("n"), (F.col("label") != F.col("own")).cast("int"), "label")).alias("b")).select("id", F.col("b.label").alias("next"))
            new = cut(labels.join(best, "id", "left").select("id", F.coalesce("next", "label").alias("label"), "colour", F.coalesce(F.col("next") != F.col("label"), F.lit(False)).alias("moved")))
            labels = new.select("id", "label", "colour")
            settled = 0 if new.where("moved").limit(1).count() else settled + 1
            if settled == len(classes):
                break
    least = labels.groupBy("label").agg(F.min("id").alias("community"))
    return labels.join(least, "label").select("id", "community")


def modularity(graph: PropertyGraph, labels: DataFrame, weight: str | None = "weight", resolution: float = 1.0) -> DataFrame:
    """One row ``modularity`` of a partition (``id``, ``community``) of an undirected graph."""
    e = graph.undirected().weights(weight)
    total = e.agg(F.sum("weight").alias("m"))
    side = lambda c, n: labels.select(F.col("id").alias(c), F.col("community").alias(n))
    known = e.join(side("src", "cs"), "src").join(side("dst", "cd"), "dst")
    inner = known.where("cs = cd").groupBy(F.col("cs").alias("c")).agg(F.sum("weight").alias("w"))
    degree = known.select(F.explode(F.array("cs", "cd")).alias("c"), "weight").groupBy("c").agg(F.sum("weight").alias("d"))
    parts = degree.join(inner, "c", "left").join(F.broadcast(total), F.lit(True))
    term = F.coalesce("w", F.lit(0.0)) / F.col("m") - resolution * F.pow(F.col("d") / (2 * F.col("m")), 2)
    return parts.agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("modularity"))
