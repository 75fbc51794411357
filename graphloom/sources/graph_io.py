"""Reading edge lists, writing node-link JSON, layouts, and works by identifier."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.errors import LIMITS, ResourceLimitError, ValidationError
from graphloom.functions.text import doi, once
from graphloom.graphs.model import PropertyGraph
from graphloom.operators.kernels import per_component

HEADERS = (("source", "from"), ("target", "to"))


def import_csv(lines: DataFrame, directed: bool = False, column: str = "value", headers: bool = True) -> PropertyGraph:
    """Graph of CSV lines: the first two columns, trimmed, are the ends of an edge.

    Lines with fewer than two columns are dropped, others ignored beyond the second. ``headers``
    says whether lines that read source/from and target/to are headers, as where each of many files
    has one. Blank ends are dropped.
    """
    cells = F.from_csv(F.col(column), "src string, dst string", {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "mode": "PERMISSIVE"})
    rows = lines.where(F.col(column).isNotNull()).select(F.explode(F.array(cells)).alias("c")).select("c.src", "c.dst").dropna()
    header = F.lower("src").isin(*HEADERS[0]) & F.lower("dst").isin(*HEADERS[1]) & F.lit(headers)
    return PropertyGraph.of(rows.where(~header & (F.col("src") != "") & (F.col("dst") != "")), directed)


def _is_header(line: str) -> bool:
    cells = [c.strip().lower() for c in line.split(",")]
    return len(cells) > 1 and cells[0] in HEADERS[0] and cells[1] in HEADERS[1]


def import_csv_text(spark: object, text: str, directed: bool = False) -> PropertyGraph:
    """``import_csv`` of one string, of limited length and number of lines; only its first line can be
    a header, so an edge from ``source`` to ``target`` further down is kept."""
    if len(text) > LIMITS["csv_chars"]:
        raise ResourceLimitError("the CSV text is too long")
    lines = [x for x in text.splitlines() if x.strip()]
    lines = lines[1:] if lines and _is_header(lines[0]) else lines
    if sum("," in x for x in lines) > LIMITS["csv_edges"]:
        raise ResourceLimitError(f"more than {LIMITS['csv_edges']} edges in one text")
    return import_csv(spark.createDataFrame([(x,) for x in lines], "value string"), directed, headers=False)


def node_link_rows(graph: PropertyGraph) -> DataFrame:
    """(``part``, ``json``): a JSON object for each node and link; scales to any graph as JSON lines."""
    nodes = graph.vertices.select(F.lit("node").alias("part"), F.to_json(F.struct(*graph.vertices.columns)).alias("json"))
    rest = [F.col(c) for c in graph.edges.columns if c not in ("src", "dst")]
    return nodes.unionByName(graph.edges.select(F.lit("link").alias("part"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), *rest)).alias("json")))


def export_json(graph: PropertyGraph) -> str:
    """One node-link document of a graph within the limits of a call."""
    counts = graph.info().first()
    if counts["nodes"] > LIMITS["nodes_per_call"] or counts["edges"] > LIMITS["edges_per_call"]:
        raise ResourceLimitError("too large for one document; write node_link_rows")
    rows = node_link_rows(graph).orderBy("part", "json").collect()
    part = lambda p: ", ".join(r["json"] for r in rows if r["part"] == p)
    return f'{{"directed": {str(graph.directed).lower()}, "multigraph": false, "nodes": [{part("node")}], "links": [{part("link")}]}}'


def resolve(dois: DataFrame, papers: DataFrame, column: str = "doi") -> DataFrame:
    """(``asked``, ``doi``, ``status``, ``title``, ``year``, ``citations``) of every distinct asked text.

    Status is resolved, not_found, or invalid where the text is no DOI. Papers are matched by the
    canonical form of ``doi``; of several rows the one of most citations is taken.
    """
    asked = dois.select(F.col(column).alias("asked")).dropna().distinct().select("asked", once(doi("asked")).alias("doi"))
    known = papers.select(once(doi("doi")).alias("doi"), "title", "year", "citations").where(F.col("doi").isNotNull())
    best = known.groupBy("doi").agg(F.max(F.struct(F.coalesce("citations", F.lit(-1)).alias("c"), "title", "year", "citations")).alias("p"))
    status = F.when(F.col("doi").isNull(), "invalid").when(F.col("p").isNull(), "not_found").otherwise("resolved")
    return asked.join(best, "doi", "left").select("asked", "doi", status.alias("status"), "p.title", "p.year", "p.citations")


def publication_year(message: Column) -> Column:
    """Year of a work: of the print date, else of the online date; null-safe."""
    part = lambda name: F.try_element_at(F.try_element_at(message[name]["date-parts"], F.lit(1)), F.lit(1))
    return F.coalesce(part("published-print"), part("published-online"))


def layout(graph: PropertyGraph, kind: str = "spring", rounds: int = 50, seed: int = 0) -> DataFrame:
    """(``id``, ``x``, ``y``): circular, spring or kamada_kawai positions, the same on every run."""
    n = graph.vertices.count()
    if n > LIMITS["layout_nodes"]:
        raise ResourceLimitError(f"{n} vertices; the limit is {LIMITS['layout_nodes']}")
    if kind == "circular":
        turn = (F.row_number().over(Window.orderBy("id")) - 1) * (2 * math.pi / max(n, 1))
        return graph.vertices.select("id", turn.alias("t")).select("id", F.cos("t").alias("x"), F.sin("t").alias("y"))
    if kind not in ("spring", "kamada_kawai"):
        raise ValidationError(f"unknown layout {kind!r}")
    return per_component(graph, f"{kind}_layout", "id {id}, x double, y double", {"rounds": rounds, "seed": seed}).select("id", "x", "y")
