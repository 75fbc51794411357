"""Property graphs as two DataFrames, with construction, editing and lookup."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import EdgeNotFoundError, GraphOperationError, NodeNotFoundError


def _canonical(edges: DataFrame, directed: bool) -> DataFrame:
    if directed:
        return edges
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *rest)


def _last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the one with the highest ``order``; for each attribute its last non-null value."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    if not rest:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest))


@dataclass(frozen=True)
class PropertyGraph:
    """``vertices`` has ``id`` and attributes, ``edges`` has ``src``, ``dst`` and attributes.

    Edges are unique; those of an undirected graph are unordered pairs kept as src <= dst. Every end
    of an edge is a vertex; vertices may be isolated. All methods return new graphs or DataFrames and
    evaluate nothing, but for those that must refuse unknown vertices.
    """

    vertices: DataFrame
    edges: DataFrame
    directed: bool = False

    @staticmethod
    def empty(spark: SparkSession, directed: bool = False, id_type: str = "string") -> PropertyGraph:
        """A graph without vertices."""
        return PropertyGraph(spark.createDataFrame([], f"id {id_type}"), spark.createDataFrame([], f"src {id_type}, dst {id_type}"), directed)

    @staticmethod
    def of(edges: DataFrame, directed: bool = False, vertices: DataFrame | None = None) -> PropertyGraph:
        """Graph of an edge list: rows with a null end are dropped, repeated edges merged, ends added."""
        e = _canonical(edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()), directed)
        rest = [c for c in e.columns if c not in ("src", "dst")]
        e = e.groupBy("src", "dst").agg(*(F.max(c).alias(c) for c in rest)) if rest else e.distinct()
        ends = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
        if vertices is None:
            return PropertyGraph(ends, e, directed)
        known = vertices.where(F.col("id").isNotNull()).dropDuplicates(["id"])
        return PropertyGraph(known.unionByName(ends.join(known.select("id"), "id", "left_anti"), allowMissingColumns=True), e, directed)

    # editing -----------------------------------------------------------------------------------

    def add_nodes(self, nodes: DataFrame) -> PropertyGraph:
        """With ``nodes`` (``id`` and attributes); attributes of known vertices are overwritten."""
        both = self.vertices.withColumn("__o", F.lit(0)).unionByName(nodes.where(F.col("id").isNotNull()).withColumn("__o", F.lit(1)), allowMissingColumns=True)
        return PropertyGraph(_last(both, ["id"], "__o"), self.edges, self.directed)

    def add_edges(self, edges: DataFrame) -> PropertyGraph:
        """With ``edges``; missing ends are added, attributes of known edges overwritten."""
        new = _canonical(edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()), self.directed).withColumn("__o", F.lit(1))
        both = _last(self.edges.withColumn("__o", F.lit(0)).unionByName(new, allowMissingColumns=True), ["src", "dst"], "__o")
        ends = new.select(F.col("src").alias("id")).unionByName(new.select(F.col("dst").alias("id"))).distinct()
        added = ends.join(self.vertices.select("id"), "id", "left_anti")
        return PropertyGraph(self.vertices.unionByName(added, allowMissingColumns=True), both, self.directed)

    def remove_nodes(self, ids: DataFrame) -> PropertyGraph:
        """Without the vertices in ``ids`` and their edges; unknown ids are ignored."""
        gone = ids.select("id").distinct()
        kept = self.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return PropertyGraph(self.vertices.join(gone, "id", "left_anti"), kept.select(*self.edges.columns), self.directed)

    def remove_edges(self, edges: DataFrame) -> PropertyGraph:
        """Without ``edges``; their ends stay, unknown edges are ignored."""
        gone = _canonical(edges.select("src", "dst"), self.directed).distinct()
        return PropertyGraph(self.vertices, self.edges.join(gone, ["src", "dst"], "left_anti").select(*self.edges.columns), self.directed)

    def set_node_attributes(self, values: DataFrame) -> PropertyGraph:
        """With attributes from ``values`` (``id`` and columns; null leaves a value as it is).

        All or nothing: an unknown vertex is an error and changes nothing.
        """
        if missing := values.join(self.vertices.select("id"), "id", "left_anti").limit(1).collect():
            raise NodeNotFoundError(f"no vertex {missing[0]['id']!r}")
        return self.add_nodes(values)

    def set_edge_attributes(self, values: DataFrame) -> PropertyGraph:
        """With edge attributes from ``values`` (``src``, ``dst`` and columns); all or nothing."""
        if missing := _canonical(values.select("src", "dst"), self.directed).join(self.edges.select("src", "dst"), ["src", "dst"], "left_anti").limit(1).collect():
            raise EdgeNotFoundError(f"no edge {tuple(missing[0])!r}")
        return self.add_edges(values)

    def subgraph(self, ids: DataFrame, strict: bool = True) -> PropertyGraph:
        """The graph induced by ``ids``, with attributes; if ``strict``, unknown ids are an error."""
        chosen = ids.select("id").distinct()
        if strict and (missing := chosen.join(self.vertices.select("id"), "id", "left_anti").limit(1).collect()):
            raise NodeNotFoundError(f"no vertex {missing[0]['id']!r}")
        e = self.edges.join(chosen.withColumnRenamed("id", "src"), "src", "left_semi").join(chosen.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return PropertyGraph(self.vertices.join(chosen, "id", "left_semi"), e.select(*self.edges.columns), self.directed)

    def merge(self, other: PropertyGraph) -> PropertyGraph:
        """Union of vertices and edges; where both hold an attribute, the other's wins."""
        if self.directed != other.directed:
            raise GraphOperationError("graphs to merge must both be directed or both be undirected")
        return self.add_nodes(other.vertices).add_edges(other.edges)

    # lookup ------------------------------------------------------------------------------------

    def info(self) -> DataFrame:
        """One row: ``nodes``, ``edges``, ``directed``."""
        n = self.vertices.agg(F.count(F.lit(1)).alias("nodes"))
        return n.join(F.broadcast(self.edges.agg(F.count(F.lit(1)).alias("edges"))), F.lit(True)).withColumn("directed", F.lit(self.directed))

    def require(self, *ids: object) -> None:
        """Raise unless every id is a vertex."""
        found = {r[0] for r in self.vertices.where(F.col("id").isin(list(ids))).select("id").collect()}
        for i in ids:
            if i not in found:
                raise NodeNotFoundError(f"no vertex {i!r}")

    def neighbors(self, node: object) -> DataFrame:
        """(``id``) of the successors of a vertex, or of its neighbours if undirected."""
        self.require(node)
        return self.arcs().where(F.col("src") == F.lit(node)).select(F.col("dst").alias("id")).distinct()

    def node_attributes(self, node: object) -> DataFrame:
        """The row of one vertex."""
        self.require(node)
        return self.vertices.where(F.col("id") == F.lit(node))

    def edge_attributes(self, src: object, dst: object) -> DataFrame:
        """The row of one edge."""
        a, b = (src, dst) if self.directed else (min(src, dst), max(src, dst))
        row = self.edges.where((F.col("src") == F.lit(a)) & (F.col("dst") == F.lit(b)))
        if not row.limit(1).count():
            raise EdgeNotFoundError(f"no edge {(src, dst)!r}")
        return row

    def arcs(self, reverse: bool = False) -> DataFrame:
        """Edges to walk along: as they are if directed (turned if ``reverse``), else both ways."""
        turned = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in self.edges.columns if c not in ("src", "dst")])
        if self.directed:
            return turned if reverse else self.edges
        return self.edges.unionByName(turned.where("src <> dst"))

    def undirected(self) -> PropertyGraph:
        """The same graph without directions."""
        return PropertyGraph.of(self.edges, False, self.vertices) if self.directed else self

    def weights(self, attribute: str | None = "weight", default: float = 1.0) -> DataFrame:
        """(``src``, ``dst``, ``weight``): the attribute, ``default`` where it is missing."""
        value: Column = F.coalesce(F.col(attribute).cast("double"), F.lit(default)) if attribute in self.edges.columns else F.lit(default)
        return self.edges.select("src", "dst", value.alias("weight"))


def ranked(df: DataFrame, score: str, tie: str, top: int | None) -> DataFrame:
    """The ``top`` rows by score; ties go to the smaller id, so results can be repeated."""
    return df if top is None else df.orderBy(F.desc(score), F.asc(tie)).limit(top)
