"""Named graphs of a session, with the least recently used dropped from memory first."""

from __future__ import annotations

from collections import OrderedDict

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import GraphAlreadyExistsError, GraphNotFoundError, graph_name
from graphloom.graphs.model import PropertyGraph
from graphloom.session import cut


class GraphCatalog:
    """Name to graph. At most ``cached`` graphs are kept in memory or on disk; others are recomputed."""

    def __init__(self, spark: SparkSession, cached: int = 100) -> None:
        self.spark, self.cached = spark, cached
        self._graphs: OrderedDict[str, PropertyGraph] = OrderedDict()
        self._held: OrderedDict[str, None] = OrderedDict()

    def create(self, name: str, graph: PropertyGraph | None = None, directed: bool = False) -> PropertyGraph:
        """Register a new graph, empty unless given."""
        name = graph_name(name)
        if name in self._graphs:
            raise GraphAlreadyExistsError(f"graph {name!r} exists")
        return self.put(name, graph or PropertyGraph.empty(self.spark, directed))

    def settle(self, name: str, graph: PropertyGraph) -> PropertyGraph:
        """``put`` with the tables materialised, so that edit after edit starts from rows, not from a
        growing plan."""
        return self.put(name, PropertyGraph(cut(graph.vertices), cut(graph.edges), graph.directed))

    def put(self, name: str, graph: PropertyGraph) -> PropertyGraph:
        """Register or replace a graph and its views ``<name>__v`` and ``<name>__e`` (in backticks where
        the name holds a hyphen)."""
        name = graph_name(name)
        self._release(name)
        self._graphs[name] = graph
        graph.vertices.createOrReplaceTempView(f"`{name}__v`")
        graph.edges.createOrReplaceTempView(f"`{name}__e`")
        return graph

    def get(self, name: str) -> PropertyGraph:
        """The graph of that name, counted as used."""
        if name not in self._graphs:
            raise GraphNotFoundError(f"no graph {name!r}")
        self._graphs.move_to_end(name)
        if name in self._held:
            self._held.move_to_end(name)
        return self._graphs[name]

    def persist(self, name: str) -> PropertyGraph:
        """Keep a graph's tables, and let go of the least recently used beyond ``cached``."""
        graph = self.get(name)
        for df in (graph.vertices, graph.edges):
            df.persist(StorageLevel.MEMORY_AND_DISK)
        self._held[name] = None
        while len(self._held) > self.cached:
            self._release(next(iter(self._held)))
        return graph

    def _release(self, name: str) -> None:
        if name in self._held:
            del self._held[name]
            for df in (self._graphs[name].vertices, self._graphs[name].edges):
                df.unpersist()

    def delete(self, name: str) -> None:
        """Forget a graph."""
        self.get(name)
        self._release(name)
        del self._graphs[name]
        self.spark.catalog.dropTempView(f"{name}__v")
        self.spark.catalog.dropTempView(f"{name}__e")

    def names(self) -> list[str]:
        """Names in order."""
        return sorted(self._graphs)

    def list(self) -> DataFrame:
        """(``graph``, ``nodes``, ``edges``, ``directed``) of every graph."""
        out = self.spark.createDataFrame([], "graph string, nodes bigint, edges bigint, directed boolean")
        for name in self.names():
            out = out.unionByName(self._graphs[name].info().select(F.lit(name).alias("graph"), "nodes", "edges", "directed"))
        return out
