"""One entry point by tool name over a catalog of graphs."""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import LIMITS, InvalidEdgeError, InvalidParamsError, ResourceLimitError, UnknownToolError
from graphloom.functions.text import doi, once
from graphloom.graphs.catalog import GraphCatalog
from graphloom.graphs.model import PropertyGraph
from graphloom.operators import bibliometrics as bib
from graphloom.operators import centrality, community, delivery, optimise, paths, structure
from graphloom.session import cut
from graphloom.sources import graph_io

TOP = 10
#: Simple cycles of a directed graph that are looked for in all.
MAX_CYCLES = 100
#: Tools that change the graphs of the catalog.
WRITES = frozenset("create_graph delete_graph add_nodes add_edges remove_nodes remove_edges set_node_attributes set_edge_attributes subgraph merge_graphs import_csv build_citation_network".split())


class Engine:
    """``run(tool, **arguments)`` on named graphs; results are DataFrames (or text for documents)."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.catalog = spark, GraphCatalog(spark)
        self.started, self.calls, self.errors = time.time(), 0, 0
        self.tools: dict[str, Callable[..., object]] = {
            "create_graph": self._create, "delete_graph": lambda graph: self.catalog.delete(graph), "list_graphs": lambda: self.catalog.list(), "get_info": lambda graph: self._g(graph).info(),
            "add_nodes": self._add_nodes, "add_edges": self._add_edges, "remove_nodes": self._remove_nodes, "remove_edges": self._remove_edges, "get_neighbors": lambda graph, node: self._g(graph).neighbors(node),
            "set_node_attributes": lambda graph, attributes: self._put(graph, self._g(graph).set_node_attributes(self._rows([{"id": k, **v} for k, v in attributes.items()]))),
            "get_node_attributes": lambda graph, node: self._g(graph).node_attributes(node),
            "set_edge_attributes": lambda graph, attributes: self._put(graph, self._g(graph).set_edge_attributes(self._rows([{"src": a["source"], "dst": a["target"], a["attr"]: a["value"]} for a in attributes]))),
            "get_edge_attributes": lambda graph, source, target: self._g(graph).edge_attributes(source, target),
            "subgraph": lambda graph, nodes, new_graph: self._new(new_graph, self._g(graph).subgraph(self._rows([{"id": n} for n in nodes]))),
            "merge_graphs": lambda graph_a, graph_b, new_graph: self._new(new_graph, self._g(graph_a).merge(self._g(graph_b))),
            "shortest_path": lambda graph, source, target, weight=None: paths.weighted_path(self._g(graph), source, target, weight) if weight else paths.shortest_path(self._g(graph), source, target),
            "all_pairs_shortest_path": lambda graph, weight=None: paths.all_pairs(self._g(graph), weight), "degree_centrality": lambda graph: centrality.degree_centrality(self._g(graph), TOP),
            "betweenness_centrality": lambda graph: centrality.betweenness(self._g(graph), TOP), "pagerank": lambda graph: centrality.pagerank(self._g(graph), top=TOP),
            "centrality_measures": lambda graph, measures=None: centrality.centrality_measures(self._g(graph), measures), "connected_components": lambda graph: structure.component_sizes(structure.components(self._g(graph))).orderBy(F.desc("size"), "component"),
            "strongly_connected_components": lambda graph: structure.strong_components(self._g(graph)), "community_detection": self._communities,
            "clustering_coefficients": lambda graph: structure.clustering(self._g(graph)).select("id", "coefficient"), "graph_statistics": lambda graph, distances=True: structure.full_statistics(self._g(graph), distances),
            "topological_sort": lambda graph: structure.topological_levels(self._g(graph)).orderBy("level", "id"), "cycles_detection": self._cycles,
            "minimum_spanning_tree": lambda graph, weight="weight", algorithm="kruskal": optimise.spanning_forest(self._g(graph), weight, algorithm),
            "maximum_flow": lambda graph, source, sink, capacity="capacity": dict(zip(("flow_value", "flow"), optimise.maximum_flow(self._g(graph), source, sink, capacity), strict=True)),
            "graph_coloring": lambda graph, strategy="largest_first": optimise.colouring(self._g(graph), strategy),
            "matching": lambda graph, max_cardinality=True: optimise.maximum_matching(self._g(graph)) if max_cardinality else optimise.maximal_matching(self._g(graph)),
            "visualize_graph": lambda graph, layout="spring": graph_io.layout(self._g(graph), layout), "export_json": lambda graph: graph_io.export_json(self._g(graph)),
            "import_csv": lambda graph, csv_data, directed=False: self._new(graph, graph_io.import_csv_text(self.spark, csv_data, directed)),
            "resolve_doi": lambda papers, doi: graph_io.resolve(self._rows([{"doi": doi}]), papers), "build_citation_network": self._citation_network,
            "analyze_author_impact": lambda papers, author_name: bib.author_impact(papers, author_name), "find_collaboration_patterns": self._collaboration,
            "detect_research_trends": lambda papers, time_window=5: bib.research_trend(papers, time_window), "export_bibtex": lambda papers: bib.bibtex(papers),
            "recommend_papers": self._recommend,
            "get_dora_metrics": lambda frequency, lead, failure, restore: delivery.report(frequency, lead, failure, restore), "get_workflow_status": self._workflow,
            "analyze_workflow_failures": lambda jobs: delivery.failure_kinds(jobs), "health_status": self._health,
        }

    def run(self, tool: str, **arguments: object) -> object:
        """The result of a tool; unknown tools and missing or unknown arguments are validation errors,
        told before anything runs."""
        self.calls += 1
        try:
            if tool not in self.tools:
                raise UnknownToolError(f"no tool {tool!r}")
            try:
                inspect.signature(self.tools[tool]).bind(**arguments)
            except TypeError as e:
                raise InvalidParamsError(f"{tool}: {e}") from e
            return self.tools[tool](**arguments)
        except Exception:
            self.errors += 1
            raise

    def list_tools(self) -> list[dict]:
        """Every tool with its parameters, those that must be given, and whether it changes graphs."""
        out = []
        for name, f in sorted(self.tools.items()):
            given = inspect.signature(f).parameters.values()
            out.append({"name": name, "parameters": {p.name: None if p.default is p.empty else p.default for p in given}, "required": [p.name for p in given if p.default is p.empty], "writes": name in WRITES})
        return out

    def list_resources(self) -> list[dict]:
        """Every graph as a resource, with its size."""
        return [{"uri": f"graph://{r['graph']}", "description": f"Graph with {r['nodes']} nodes and {r['edges']} edges"} for r in self.catalog.list().collect()]

    def read_resource(self, uri: str) -> str:
        """The node-link document of ``graph://name``."""
        scheme, _, name = uri.partition("://")
        if scheme != "graph" or not name:
            raise InvalidParamsError(f"not a resource: {uri!r}")
        return graph_io.export_json(self._g(name))

    def _g(self, name: str) -> PropertyGraph:
        return self.catalog.get(name)

    def _rows(self, rows: list[dict]) -> DataFrame:
        return self.spark.createDataFrame(rows)

    def _put(self, name: str, graph: PropertyGraph) -> DataFrame:
        return self.catalog.settle(name, graph).info()

    def _new(self, name: str, graph: PropertyGraph) -> DataFrame:
        self.catalog.create(name)
        try:
            return self._put(name, graph)
        except Exception:
            self.catalog.delete(name)
            raise

    def _communities(self, graph: str, method: str = "louvain") -> dict:
        g = self._g(graph)
        found = cut(community.communities(g, method))
        sizes = found.groupBy("community").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "community")
        return {"method": method, "communities": found, "community_sizes": sizes, "num_communities": sizes.count(), "modularity": community.modularity(g, found).first()[0]}

    def _cycles(self, graph: str) -> dict:
        g = self._g(graph)
        if not g.directed:
            basis = structure.cycles(g)
            return {**structure.cycle_count(g).first().asDict(), "cycle_basis": basis}
        flags = structure.cycle_flags(g).first().asDict()
        if not flags["has_cycle"]:
            return flags
        found = cut(structure.cycles(g, MAX_CYCLES + 1))
        n = found.count()
        shown = found.select("cycle").orderBy(F.size("cycle"), "cycle").limit(TOP)
        return {**flags, "cycles": shown, "num_cycles_found": min(n, MAX_CYCLES), "cycles_truncated": n > MAX_CYCLES}

    def _collaboration(self, papers: DataFrame, cites: DataFrame | None = None) -> DataFrame:
        if cites is None or bib.author_rows(papers).limit(1).count():
            return bib.collaboration_patterns(papers)
        return bib.collaboration_clusters(PropertyGraph.of(cites.select("src", "dst"), True))

    def _recommend(self, cites: DataFrame, papers: DataFrame, as_of_year: int, seed_doi: str | None = None, max_recommendations: int | None = None, seed_paper: str | None = None, top_n: int = TOP) -> dict:
        seed = seed_doi or seed_paper
        if not seed:
            raise InvalidParamsError("seed_doi is missing")
        basis = bib.recommendation_basis(cites, seed).first().asDict()
        out = {"seed_paper": seed, "recommendations": bib.recommend(cites, papers, seed, as_of_year, top_n if max_recommendations is None else max_recommendations), "total_found": basis.pop("candidates"), "based_on": basis}
        return out if any(basis.values()) else {**out, "note": f"{seed!r} isn't in the graph"}

    def _workflow(self, runs: DataFrame, run_id: object = None, id_column: str = "run_id") -> dict:
        if run_id is not None:
            return delivery.run_status(runs, run_id, id_column).first().asDict()
        return {**delivery.workflow_status(runs).first().asDict(), "recent_runs": delivery.recent_runs(runs, id_column)}

    def _create(self, graph: str, directed: bool = False) -> DataFrame:
        return self.catalog.create(graph, directed=directed).info()

    def _limited(self, rows: list, limit: str) -> list:
        if len(rows) > LIMITS[limit]:
            raise ResourceLimitError(f"{len(rows)} in one call; the limit is {LIMITS[limit]}")
        return rows

    def _retyped(self, graph: PropertyGraph, kind: str) -> PropertyGraph:
        """An empty graph takes the type of its first ids."""
        if kind == dict(graph.vertices.dtypes)["id"] or graph.vertices.limit(1).count():
            return graph
        return PropertyGraph.empty(self.spark, graph.directed, kind)

    def _add_nodes(self, graph: str, nodes: list) -> DataFrame:
        new = self._rows([n if isinstance(n, dict) else {"id": n} for n in self._limited(nodes, "nodes_per_call")])
        return self._put(graph, self._retyped(self._g(graph), dict(new.dtypes)["id"]).add_nodes(new))

    def _add_edges(self, graph: str, edges: list) -> DataFrame:
        rows = []
        for e in self._limited(edges, "edges_per_call"):
            if not isinstance(e, (list, tuple)) or len(e) < 2 or (len(e) > 2 and not isinstance(e[2], dict)):
                raise InvalidEdgeError(f"not an edge: {e!r}")
            rows.append({"src": e[0], "dst": e[1], **(e[2] if len(e) > 2 else {})})
        new = self._rows(rows)
        return self._put(graph, self._retyped(self._g(graph), dict(new.dtypes)["src"]).add_edges(new))

    def _remove_nodes(self, graph: str, nodes: list) -> DataFrame:
        return self._put(graph, self._g(graph).remove_nodes(self._rows([{"id": n} for n in nodes])))

    def _remove_edges(self, graph: str, edges: list) -> DataFrame:
        return self._put(graph, self._g(graph).remove_edges(self._rows([{"src": e[0], "dst": e[1]} for e in edges])))

    def _citation_network(self, graph: str, references: DataFrame, seed_dois: list[str], max_depth: int = 2) -> DataFrame:
        seeds = self._rows([{"doi": d} for d in seed_dois]).select(once(doi("doi")).alias("id"))
        vertices, edges = paths.citation_network(references, seeds, max_depth)
        return self._new(graph, PropertyGraph.of(edges, True, vertices))

    def _health(self) -> dict:
        return {"uptime_seconds": time.time() - self.started, "calls": self.calls, "errors": self.errors, "graphs": len(self.catalog.names())}
