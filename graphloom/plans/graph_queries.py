"""Queries over graphs, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import doi, once
from graphloom.graphs.catalog import GraphCatalog
from graphloom.graphs.model import PropertyGraph
from graphloom.operators import centrality, community, optimise, paths, structure
from graphloom.plans import views
from graphloom.plans.views import CITES, COPART, DOI_SQL, TRADE
from graphloom.session import cut, read
from graphloom.sources import graph_io

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL if it can be said in SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _r(name: str, digits: int = 6) -> object:
    return F.round(F.col(name), digits).alias(name)


# reading and writing -----------------------------------------------------------------------------


@query("WITH e AS (SELECT DISTINCT trim(src) AS src, trim(dst) AS dst FROM cites WHERE trim(src) <> '' AND trim(dst) <> '') SELECT count(*) AS edges, (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS nodes FROM e")
def import_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the graph read from the citations as CSV lines."""
    lines = read(spark, sf_dir, "cites").select(F.concat_ws(",", F.coalesce("src", F.lit("")), F.coalesce("dst", F.lit("")), F.col("cite_id").cast("string")).alias("value"))
    return graph_io.import_csv(lines, True).info().select("nodes", "edges")


@query(f"WITH {TRADE} SELECT 'node' AS part, '{{\"id\":' || id || ',\"name\":\"' || n_name || '\"}}' AS json FROM v JOIN nation ON id = n_nationkey UNION ALL SELECT 'link', '{{\"source\":' || src || ',\"target\":' || dst || ',\"weight\":' || weight || ',\"capacity\":' || weight || '}}' FROM arcs")
def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node-link JSON of the trade graph, an object a row."""
    return graph_io.node_link_rows(views.trade(spark, sf_dir))


@query(f"WITH p AS (SELECT {DOI_SQL.format('doi')} AS doi, max(citations) AS citations FROM papers GROUP BY 1), a AS (SELECT DISTINCT dst AS asked, {DOI_SQL.format('dst')} AS doi FROM cites WHERE dst IS NOT NULL) SELECT asked, a.doi, CASE WHEN a.doi IS NULL THEN 'invalid' WHEN p.doi IS NULL THEN 'not_found' ELSE 'resolved' END AS status, citations FROM a LEFT JOIN p ON a.doi = p.doi")
def resolve_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cited text looked up among the papers."""
    return graph_io.resolve(read(spark, sf_dir, "cites"), read(spark, sf_dir, "papers"), "dst").select("asked", "doi", "status", "citations")


@query('SELECT record_id, coalesce(message."published-print"."date-parts"[1][1], message."published-online"."date-parts"[1][1]) AS year FROM crossref_works')
def publication_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year of every fetched work."""
    return read(spark, sf_dir, "crossref_works").select("record_id", graph_io.publication_year(F.col("message")).alias("year"))


_REFS = f"refs AS (SELECT DISTINCT src, {DOI_SQL.format('d')} AS dst FROM (SELECT {DOI_SQL.format('message.DOI')} AS src, unnest(message.\"reference\").DOI AS d FROM crossref_works))"


@query(f"WITH RECURSIVE {_REFS}, n(id, level) USING KEY (id) AS (SELECT DISTINCT {DOI_SQL.format('doi')}, 0 FROM withdrawals WHERE {DOI_SQL.format('doi')} IS NOT NULL UNION SELECT r.dst, min(n.level) + 1 FROM n JOIN refs r ON r.src = n.id LEFT JOIN recurring.n k ON k.id = r.dst WHERE r.dst IS NOT NULL AND k.id IS NULL AND n.level < 2 GROUP BY 1) SELECT id, level FROM n")
def build_citation_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works within two citations of a withdrawn one."""
    works = read(spark, sf_dir, "crossref_works").select(once(doi("message.DOI")).alias("src"), F.col("message.reference.DOI").alias("cited"))
    refs = works.select("src", F.explode(F.transform("cited", doi)).alias("dst"))
    return paths.citation_network(refs, read(spark, sf_dir, "withdrawals").select(once(doi("doi")).alias("id")), 2)[0]


@query(f"WITH {TRADE} SELECT id, round(cos(2 * pi() * (row_number() OVER (ORDER BY id) - 1) / (SELECT count(*) FROM v)), 6) + 0.0 AS x, round(sin(2 * pi() * (row_number() OVER (ORDER BY id) - 1) / (SELECT count(*) FROM v)), 6) + 0.0 AS y FROM v")
def layout_circular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations on a circle."""
    return graph_io.layout(views.trade(spark, sf_dir), "circular").select("id", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


@query()
def layout_spring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations where springs along the trade put them."""
    return graph_io.layout(views.trade(spark, sf_dir), "spring").select("id", _r("x"), _r("y"))


@query()
def layout_kamada_kawai(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with distances as in the graph."""
    return graph_io.layout(views.trade(spark, sf_dir), "kamada_kawai").select("id", _r("x"), _r("y"))


# editing -----------------------------------------------------------------------------------------


@query(f"WITH {TRADE}, c AS (SELECT count(*) AS n FROM ({'SELECT DISTINCT src, dst FROM arcs'})) SELECT 'trade' AS graph, (SELECT count(*) FROM v) AS nodes, n AS edges, true AS directed FROM c UNION ALL SELECT 'copart', (SELECT count(*) FROM part), (SELECT count(*) FROM (SELECT 1 FROM (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem) b ON a.o = b.o AND a.p < b.p GROUP BY a.p, b.p HAVING count(*) >= 2)), false")
def list_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of the graphs in a catalog."""
    catalog = GraphCatalog(spark)
    catalog.create("trade", views.trade(spark, sf_dir))
    catalog.create("copart", views.copart(spark, sf_dir))
    return catalog.list()


@query(f"WITH {TRADE} SELECT id FROM v UNION SELECT 1000 + r_regionkey FROM region")
def add_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade with regions as further vertices."""
    return views.trade(spark, sf_dir).add_nodes(read(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).alias("id"))).vertices.select("id")


@query(f"WITH {TRADE} SELECT src, dst, weight FROM arcs UNION ALL SELECT 1000 + n_regionkey, n_nationkey, 1.0 FROM nation")
def add_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade with edges from regions to their nations."""
    new = read(spark, sf_dir, "nation").select((F.col("n_regionkey") + 1000).alias("src"), F.col("n_nationkey").alias("dst"), F.lit(1.0).alias("weight"))
    return views.trade(spark, sf_dir).add_edges(new).edges.select("src", "dst", "weight")


_FIRST = "(SELECT n_nationkey FROM nation WHERE n_regionkey = 0)"


@query(f"WITH {TRADE} SELECT src, dst, weight FROM arcs WHERE src NOT IN {_FIRST} AND dst NOT IN {_FIRST}")
def remove_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade without the nations of the first region."""
    return views.trade(spark, sf_dir).remove_nodes(read(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("id"))).edges.select("src", "dst", "weight")


@query(f"WITH {TRADE} SELECT src, dst, weight FROM arcs a WHERE NOT EXISTS (SELECT 1 FROM arcs b WHERE b.src = a.dst AND b.dst = a.src)")
def remove_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade without the edges that have a counterpart."""
    g = views.trade(spark, sf_dir)
    back = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return g.remove_edges(g.edges.select("src", "dst").intersect(back)).edges.select("src", "dst", "weight")


@query(f"WITH {TRADE} SELECT DISTINCT dst AS id FROM arcs WHERE src = 0")
def get_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successors of nation 0."""
    return views.trade(spark, sf_dir).neighbors(0)


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation")
def set_node_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with their region as a new attribute."""
    values = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region"))
    return views.trade(spark, sf_dir).set_node_attributes(values).vertices.select("id", "name", "region")


@query(f"WITH {TRADE} SELECT src, dst, weight, CASE WHEN src < dst THEN 0.0 END::DOUBLE AS cost FROM arcs")
def set_edge_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade with a cost on the edges to nations of a greater key."""
    g = views.trade(spark, sf_dir)
    return g.set_edge_attributes(g.edges.where("src < dst").select("src", "dst", F.lit(0.0).alias("cost"))).edges.select("src", "dst", "weight", "cost")


@query(f"WITH {COPART}, s AS (SELECT p_partkey AS id FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)) SELECT src, dst, weight FROM edges WHERE src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s)")
def subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between parts of the first brand."""
    g = views.copart(spark, sf_dir)
    first = g.vertices.agg(F.min("brand")).first()[0]
    return g.subgraph(g.vertices.where(F.col("brand") == first)).edges.select("src", "dst", "weight")


@query(f"WITH {COPART} SELECT src, dst, CASE WHEN weight > 2 THEN 2 * weight ELSE weight END AS weight FROM edges")
def merge_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' graph merged with its heavier edges at twice their weight, which win."""
    g = views.copart(spark, sf_dir)
    return g.merge(PropertyGraph(g.vertices.select("id"), g.edges.where("weight > 2").withColumn("weight", F.col("weight") * 2))).edges.select("src", "dst", "weight")


# paths -------------------------------------------------------------------------------------------


def _ends(graph: PropertyGraph) -> tuple[int, int]:
    """The least id with an edge and the greatest that can be reached from it."""
    start = graph.edges.agg(F.min("src").alias("source"))
    first = start.first()[0]
    return first, paths.bfs(graph.arcs(), start).agg(F.max("id")).first()[0]


_BFS = "b(id, d) USING KEY (id) AS (SELECT {start}, 0 UNION SELECT a.dst, min(b.d) + 1 FROM b JOIN arcs a ON a.src = b.id LEFT JOIN recurring.b k ON k.id = a.dst WHERE k.id IS NULL GROUP BY 1)"


@query(f"WITH RECURSIVE {COPART}, {_BFS.format(start='(SELECT min(src) FROM edges)')} SELECT id, d AS depth FROM b WHERE id IS NOT NULL")
def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of parts from the first part that has an edge."""
    g = views.copart(spark, sf_dir)
    return paths.bfs(g.arcs(), g.edges.agg(F.min("src").alias("source"))).select("id", "depth")


@query(f"WITH RECURSIVE {TRADE}, {_BFS.format(start='(SELECT min(src) FROM arcs)')}, w(step, id) AS (SELECT d, id FROM b WHERE id = (SELECT max(id) FROM b) UNION ALL SELECT step - 1, (SELECT min(a.src) FROM arcs a JOIN b ON b.id = a.src WHERE a.dst = w.id AND b.d = step - 1) FROM w WHERE step > 0) SELECT step, id FROM w")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewest edges from the first nation that sells to the last one it reaches."""
    g = views.trade(spark, sf_dir)
    return paths.shortest_path(g, *_ends(g))


_SSSP = "d(id, w) USING KEY (id) AS (SELECT (SELECT min(src) FROM arcs), 0.0::DOUBLE UNION SELECT a.dst, min(d.w + a.weight) FROM d JOIN arcs a ON a.src = d.id LEFT JOIN recurring.d k ON k.id = a.dst WHERE k.id IS NULL OR d.w + a.weight < k.w GROUP BY 1)"


@query(f"WITH RECURSIVE {TRADE}, {_SSSP} SELECT id, w AS distance FROM d")
def dijkstra_single_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least weight from the first nation that sells."""
    g = views.trade(spark, sf_dir)
    return paths.single_source(g, _ends(g)[0]).select("id", "distance")


@query(f"WITH RECURSIVE {TRADE}, {_SSSP}, back(id, n) AS (SELECT (SELECT max(id) FROM d), 0 UNION ALL SELECT (SELECT min(a.src) FROM arcs a JOIN d x ON x.id = a.src JOIN d y ON y.id = a.dst WHERE a.dst = back.id AND abs(x.w + a.weight - y.w) < 1e-9), n + 1 FROM back WHERE id <> (SELECT min(src) FROM arcs)) SELECT ((SELECT max(n) FROM back) - n)::INTEGER AS step, id FROM back")
def dijkstra_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path of least weight from the first nation that sells to the last one it reaches."""
    g = views.trade(spark, sf_dir)
    return paths.weighted_path(g, *_ends(g))


@query(f"WITH RECURSIVE {TRADE}, {_SSSP} SELECT id, w AS distance FROM d")
def bellman_ford_single_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with negative weights allowed."""
    g = views.trade(spark, sf_dir)
    return paths.single_source(g, _ends(g)[0], negative=True).select("id", "distance")


_ALL = "ap(s, v, d) USING KEY (s, v) AS (SELECT id, id, 0 FROM v UNION SELECT ap.s, a.dst, min(ap.d) + 1 FROM ap JOIN arcs a ON a.src = ap.v LEFT JOIN recurring.ap k ON k.s = ap.s AND k.v = a.dst WHERE k.s IS NULL GROUP BY 1, 2)"


@query(f"WITH RECURSIVE {TRADE}, {_ALL} SELECT s AS src, v AS dst, d::DOUBLE AS distance FROM ap")
def all_pairs_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between all nations."""
    return paths.all_pairs(views.trade(spark, sf_dir))


@query(f"WITH RECURSIVE {TRADE}, {_ALL}, e AS (SELECT s, max(d) AS x, count(*) AS n FROM ap GROUP BY 1) SELECT max(x)::BIGINT AS diameter, min(x)::BIGINT AS radius FROM e HAVING min(n) = (SELECT count(*) FROM v)")
def diameter_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest and least eccentricity of trade, if strongly connected."""
    return structure.diameter(views.trade(spark, sf_dir))


@query(f"WITH RECURSIVE {TRADE}, {_ALL.replace('arcs', 'u')}, e AS (SELECT s, max(d) AS x, count(*) AS n FROM ap GROUP BY 1) SELECT max(x)::BIGINT AS diameter, min(x)::BIGINT AS radius FROM e HAVING min(n) = (SELECT count(*) FROM v)".replace("v AS (SELECT n_nationkey", "u AS (SELECT src, dst FROM arcs UNION SELECT dst, src FROM arcs), v AS (SELECT n_nationkey"))
def diameter_radius_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest and least eccentricity of trade without directions."""
    return structure.diameter(views.trade(spark, sf_dir).undirected())


@query(f"WITH RECURSIVE {CITES}, {_BFS.format(start='(SELECT min(src) FROM arcs)')} SELECT id, d::DOUBLE AS distance FROM b WHERE id IS NOT NULL")
def distances_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations to walk along from the first citing work to every work it reaches."""
    g = views.cites(spark, sf_dir)
    return paths.single_source(g, g.edges.agg(F.min("src")).first()[0], None).select("id", "distance")


# centrality --------------------------------------------------------------------------------------


@query(f"WITH {COPART} SELECT id, count(src) / (SELECT count(*) - 1 FROM v)::DOUBLE AS score FROM v LEFT JOIN arcs ON src = id GROUP BY 1")
def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degree centrality of every part."""
    return centrality.degree_centrality(views.copart(spark, sf_dir))


@query(f"WITH {COPART} SELECT id, count(src) / (SELECT count(*) - 1 FROM v)::DOUBLE AS score FROM v LEFT JOIN arcs ON src = id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def degree_centrality_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most central parts."""
    return centrality.degree_centrality(views.copart(spark, sf_dir), top=10)


@query(f"WITH {CITES} SELECT id, (SELECT count(*) FROM arcs WHERE dst = id) AS in_degree, (SELECT count(*) FROM arcs WHERE src = id) AS out_degree FROM v")
def in_out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations received and made by every work."""
    return centrality.degrees(views.cites(spark, sf_dir)).select("id", "in_degree", "out_degree")


_SIGMA = "sg(s, v, d, c) AS (SELECT id, id, 0, 1.0::DOUBLE FROM v UNION ALL SELECT sg.s, a.dst, sg.d + 1, sum(sg.c) FROM sg JOIN arcs a ON a.src = sg.v JOIN ap ON ap.s = sg.s AND ap.v = a.dst AND ap.d = sg.d + 1 GROUP BY 1, 2, 3)"


@query(f"WITH RECURSIVE {TRADE}, {_ALL}, {_SIGMA}, t AS (SELECT x.v AS id, sum(x.c * y.c / z.c) AS b FROM sg x JOIN sg y ON x.v = y.s JOIN sg z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d WHERE x.s <> x.v AND y.v <> x.v AND x.s <> y.v GROUP BY 1), n AS (SELECT count(*) AS n FROM v) SELECT id, round(coalesce(b, 0) / ((n - 1) * (n - 2)), 6) AS score FROM v LEFT JOIN t USING (id) CROSS JOIN n")
def betweenness_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Betweenness of every nation."""
    return centrality.betweenness(views.trade(spark, sf_dir)).select("id", _r("score"))


@query(f"WITH RECURSIVE {TRADE}, {_ALL}, t AS (SELECT v AS id, sum(d) AS s, count(*) AS r FROM ap GROUP BY 1), n AS (SELECT count(*) AS n FROM v) SELECT id, round(CASE WHEN s > 0 THEN (r - 1) / s * (r - 1) / (n - 1) ELSE 0 END, 6) AS score FROM t CROSS JOIN n")
def closeness_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closeness of every nation, by incoming trade."""
    return centrality.closeness(views.trade(spark, sf_dir)).select("id", _r("score"))


@query(f"WITH RECURSIVE {TRADE}, m AS (SELECT src, dst FROM arcs UNION ALL SELECT id, id FROM v), x(it, id, s) AS (SELECT 0, id, 1.0::DOUBLE / (SELECT count(*) FROM v) FROM v UNION ALL SELECT it + 1, id, y / sqrt(sum(y * y) OVER ()) FROM (SELECT it, m.dst AS id, sum(s) AS y FROM x JOIN m ON m.src = x.id WHERE it < 20 GROUP BY 1, 2)) SELECT id, round(s, 6) AS score FROM x WHERE it = 20")
def eigenvector_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eigenvector scores of nations after twenty rounds."""
    return centrality.eigenvector(views.trade(spark, sf_dir), fixed_rounds=20).select("id", _r("score"))


@query(f"WITH RECURSIVE {TRADE}, m AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM arcs), n AS (SELECT count(*) AS n FROM v), x(it, id, s) AS (SELECT 0, id, 1.0::DOUBLE / n FROM v CROSS JOIN n UNION ALL SELECT it + 1, id, 0.85 * sum(g) + 0.15 / any_value(n) FROM (SELECT it, m.dst AS id, s * share AS g FROM x JOIN m ON m.src = x.id WHERE it < 20 UNION ALL SELECT it, id, coalesce(sum(CASE WHEN id NOT IN (SELECT src FROM arcs) THEN s END) OVER (), 0) / (SELECT n FROM n) FROM x WHERE it < 20) CROSS JOIN n GROUP BY it, id) SELECT id, round(s, 6) AS score FROM x WHERE it = 20")
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank of nations after twenty rounds."""
    return centrality.pagerank(views.trade(spark, sf_dir), fixed_rounds=20).select("id", _r("score"))


@query(f"WITH RECURSIVE {CITES}, m AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS share FROM arcs), n AS (SELECT count(*) AS n FROM v), stuck AS (SELECT id FROM v WHERE id NOT IN (SELECT src FROM arcs)), x(it, id, s) AS (SELECT 0, id, 1.0::DOUBLE / n FROM v CROSS JOIN n UNION ALL SELECT it + 1, id, 0.85 * sum(g) + 0.15 / any_value(n) FROM (SELECT it, m.dst AS id, s * share AS g FROM x JOIN m ON m.src = x.id WHERE it < 20 UNION ALL SELECT it, x.id, coalesce(sum(CASE WHEN stuck.id IS NOT NULL THEN s END) OVER (), 0) / (SELECT n FROM n) FROM x LEFT JOIN stuck ON stuck.id = x.id WHERE it < 20) CROSS JOIN n GROUP BY it, id) SELECT id, round(s, 7) AS score FROM x WHERE it = 20")
def pagerank_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank of all works by citations after twenty rounds."""
    return centrality.pagerank(views.cites(spark, sf_dir), weight=None, fixed_rounds=20).select("id", _r("score", 7))


@query()
def pagerank_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank of all works by citations, until it settles."""
    return centrality.pagerank(views.cites(spark, sf_dir), weight=None).select("id", _r("score", 7))


@query(f"WITH RECURSIVE {CITES}, m AS (SELECT src, dst FROM arcs UNION ALL SELECT id, id FROM v), x(it, id, s) AS (SELECT 0, id, 1.0::DOUBLE / (SELECT count(*) FROM v) FROM v UNION ALL SELECT it + 1, id, y / sqrt(sum(y * y) OVER ()) FROM (SELECT it, m.dst AS id, sum(s) AS y FROM x JOIN m ON m.src = x.id WHERE it < 10 GROUP BY 1, 2)) SELECT id, round(s, 6) AS score FROM x WHERE it = 10")
def eigenvector_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eigenvector scores of all works after ten rounds."""
    return centrality.eigenvector(views.cites(spark, sf_dir), fixed_rounds=10).select("id", _r("score"))


_NATIONS = f"WITH RECURSIVE {TRADE}, {_ALL}, {_SIGMA}, n AS (SELECT count(*) AS n FROM v), d AS (SELECT id, (SELECT count(*) FROM arcs WHERE dst = id) AS i, (SELECT count(*) FROM arcs WHERE src = id) AS o FROM v), t AS (SELECT x.v AS id, sum(x.c * y.c / z.c) AS b FROM sg x JOIN sg y ON x.v = y.s JOIN sg z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d WHERE x.s <> x.v AND y.v <> x.v AND x.s <> y.v GROUP BY 1), c AS (SELECT v AS id, sum(d) AS s, count(*) AS r FROM ap GROUP BY 1)"


@query(_NATIONS + " SELECT 'degree' AS measure, id, round((i + o) / (n - 1)::DOUBLE, 6) AS score FROM d CROSS JOIN n UNION ALL SELECT 'in_degree', id, round(i / (n - 1)::DOUBLE, 6) FROM d CROSS JOIN n UNION ALL SELECT 'out_degree', id, round(o / (n - 1)::DOUBLE, 6) FROM d CROSS JOIN n UNION ALL SELECT 'betweenness', id, round(coalesce(b, 0) / ((n - 1) * (n - 2)), 6) FROM v LEFT JOIN t USING (id) CROSS JOIN n UNION ALL SELECT 'closeness', id, round(CASE WHEN s > 0 THEN (r - 1) / s * (r - 1) / (n - 1) ELSE 0 END, 6) FROM c CROSS JOIN n")
def centrality_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of nations that have one value however they are computed."""
    return centrality.centrality_measures(views.trade(spark, sf_dir), ("degree", "betweenness", "closeness")).select("measure", "id", _r("score"))


@query()
def centrality_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of nations that are iterated until they settle."""
    return centrality.centrality_measures(views.trade(spark, sf_dir), ("eigenvector", "pagerank")).select("measure", "id", _r("score"))


# structure ---------------------------------------------------------------------------------------

_CC = "cc(id, c) USING KEY (id) AS (SELECT id, id FROM v UNION SELECT a.dst, min(cc.c) FROM cc JOIN arcs a ON a.src = cc.id JOIN recurring.cc k ON k.id = a.dst WHERE cc.c < k.c GROUP BY 1)"


@query(f"WITH RECURSIVE {COPART}, {_CC} SELECT id, c AS component FROM cc")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every part."""
    return structure.components(views.copart(spark, sf_dir))


@query(f"WITH RECURSIVE {COPART}, {_CC} SELECT c AS component, count(*) AS size FROM cc GROUP BY 1")
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the components of parts."""
    return structure.component_sizes(structure.components(views.copart(spark, sf_dir)))


@query(f"WITH RECURSIVE {TRADE}, {_ALL} SELECT x.s AS id, min(x.v) AS component FROM ap x JOIN ap y ON x.s = y.v AND x.v = y.s GROUP BY 1")
def strongly_connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong component of every nation."""
    return structure.strong_components(views.trade(spark, sf_dir))


@query(f"WITH RECURSIVE {CITES}, {_ALL} SELECT x.s AS id, min(x.v) AS component FROM ap x JOIN ap y ON x.s = y.v AND x.v = y.s GROUP BY 1")
def strong_components_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong component of every work."""
    return structure.strong_components(views.cites(spark, sf_dir))


@query(f"WITH RECURSIVE {TRADE}, {_ALL}, u AS (SELECT src, dst FROM arcs UNION ALL SELECT dst, src FROM arcs), cc(id, c) USING KEY (id) AS (SELECT id, id FROM v UNION SELECT a.dst, min(cc.c) FROM cc JOIN u a ON a.src = cc.id JOIN recurring.cc k ON k.id = a.dst WHERE cc.c < k.c GROUP BY 1), sc AS (SELECT count(DISTINCT component) AS n FROM (SELECT x.s AS id, min(x.v) AS component FROM ap x JOIN ap y ON x.s = y.v AND x.v = y.s GROUP BY 1)), wc AS (SELECT count(DISTINCT c) AS n FROM cc) SELECT wc.n AS weak_components, sc.n AS strong_components, wc.n = 1 AS is_weakly_connected, sc.n = 1 AS is_strongly_connected FROM wc CROSS JOIN sc")
def connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether trade is connected."""
    return structure.connectivity(views.trade(spark, sf_dir))


_TRI = "deg AS (SELECT id, count(src) AS k FROM v LEFT JOIN arcs ON src = id GROUP BY 1), tri AS (SELECT a.src AS id, count(*) / 2 AS t FROM arcs a JOIN arcs b ON a.dst = b.src JOIN arcs c ON b.dst = c.src AND c.dst = a.src GROUP BY 1)"


@query(f"WITH {COPART}, {_TRI} SELECT id, round(CASE WHEN k > 1 THEN 2.0::DOUBLE * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END, 6) AS coefficient FROM deg LEFT JOIN tri USING (id)")
def clustering_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clustering coefficient of every part."""
    return structure.clustering(views.copart(spark, sf_dir)).select("id", _r("coefficient"))


@query(f"WITH {COPART}, {_TRI} SELECT round(avg(CASE WHEN k > 1 THEN 2.0::DOUBLE * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END), 6) AS average, round(sum(coalesce(t, 0)) / sum(k * (k - 1) / 2.0::DOUBLE), 6) AS transitivity FROM deg LEFT JOIN tri USING (id)")
def clustering_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average coefficient and transitivity of parts."""
    return structure.clustering_summary(views.copart(spark, sf_dir)).select(_r("average"), _r("transitivity"))


@query(f"WITH {COPART}, deg AS (SELECT id, count(src) AS k FROM v LEFT JOIN arcs ON src = id GROUP BY 1) SELECT count(*) AS nodes, (SELECT count(*) FROM edges) AS edges, false AS directed, round(avg(k), 6) AS degree_mean, round(stddev_pop(k), 6) AS degree_std, min(k) AS degree_min, max(k) AS degree_max, round((SELECT count(*) FROM edges) * 2.0::DOUBLE / (count(*) * (count(*) - 1)), 9) AS density, false AS is_multigraph FROM deg")
def graph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, density and degrees of the graph of parts."""
    s = structure.statistics(views.copart(spark, sf_dir))
    return s.withColumns({"degree_mean": F.round("degree_mean", 6), "degree_std": F.round("degree_std", 6), "density": F.round("density", 9)})


_GEO = "arcs AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders), v AS (SELECT src AS id FROM arcs UNION SELECT dst FROM arcs)"


@query(f"WITH RECURSIVE {_GEO}, l(id, level) USING KEY (id) AS (SELECT id, 0 FROM v WHERE id NOT IN (SELECT dst FROM arcs) UNION SELECT a.dst, max(l.level) + 1 FROM l JOIN arcs a ON a.src = l.id LEFT JOIN recurring.l k ON k.id = a.dst WHERE k.id IS NULL OR l.level + 1 > k.level GROUP BY 1) SELECT id, level FROM l")
def topological_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level of everything from regions down to orders."""
    return structure.topological_levels(views.geography(spark, sf_dir))


@query(f"WITH RECURSIVE {COPART}, {_CC}, x AS (SELECT (SELECT count(*) FROM edges) - (SELECT count(*) FROM v) + (SELECT count(DISTINCT c) FROM cc) AS n) SELECT n AS independent_cycles, n > 0 AS has_cycle FROM x")
def cycle_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of independent cycles of parts."""
    return structure.cycle_count(views.copart(spark, sf_dir))


@query(f"WITH RECURSIVE {COPART}, {_CC} SELECT (SELECT count(*) FROM edges) - (SELECT count(*) FROM v) + (SELECT count(DISTINCT c) FROM cc) AS cycles")
def cycle_basis_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cycles the basis of parts' cycles holds."""
    return structure.cycles(views.copart(spark, sf_dir)).agg(F.count(F.lit(1)).alias("cycles"))


@query()
def cycles_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred simple cycles of trade."""
    return structure.cycles(views.trade(spark, sf_dir))


@query(f"WITH RECURSIVE {TRADE}, {_ALL}, x AS (SELECT count(*) > 0 AS c FROM ap x JOIN ap y ON x.s = y.v AND x.v = y.s WHERE x.s <> x.v) SELECT 'trade' AS graph, c AS has_cycle, NOT c AS is_dag FROM x UNION ALL SELECT 'geography', false, true")
def cycle_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether trade and geography have cycles."""
    flags = [(name, structure.cycle_flags(g)) for name, g in (("trade", views.trade(spark, sf_dir)), ("geography", views.geography(spark, sf_dir)))]
    parts = [f.select(F.lit(name).alias("graph"), "has_cycle", "is_dag") for name, f in flags]
    return parts[0].unionByName(parts[1])


# optimisation ------------------------------------------------------------------------------------


@query()
def minimum_spanning_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lightest forest over parts."""
    return optimise.spanning_forest(views.copart(spark, sf_dir))


@query(f"WITH RECURSIVE {COPART}, t AS (SELECT DISTINCT weight AS t FROM edges UNION SELECT 0), cc(t, id, c) USING KEY (t, id) AS (SELECT t, id, id FROM t CROSS JOIN v UNION SELECT cc.t, a.dst, min(cc.c) FROM cc JOIN arcs a ON a.src = cc.id AND a.weight <= cc.t JOIN recurring.cc k ON k.t = cc.t AND k.id = a.dst WHERE cc.c < k.c GROUP BY 1, 2), n AS (SELECT t, count(DISTINCT c) AS c FROM cc GROUP BY 1), s AS (SELECT t, lag(c) OVER (ORDER BY t) - c AS taken FROM n) SELECT sum(taken)::BIGINT AS edges, sum(t * taken)::DOUBLE AS weight FROM s")
def spanning_forest_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges and weight of the lightest forest over parts; in SQL from the components below each weight."""
    return optimise.spanning_forest(views.copart(spark, sf_dir)).agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight"))


_FLAT = "e AS (SELECT src, dst, weight, row_number() OVER (ORDER BY weight, src, dst) AS k FROM (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(weight) AS weight FROM arcs GROUP BY 1, 2))"


@query(f"WITH RECURSIVE {TRADE}, {_FLAT}, u AS (SELECT src, dst, k FROM e UNION ALL SELECT dst, src, k FROM e), r AS (SELECT k, src AS id FROM e UNION SELECT r.k, u.dst FROM r JOIN u ON u.src = r.id AND u.k < r.k) SELECT src, dst, weight FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k = e.k AND r.id = e.dst)")
def spanning_tree_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lightest tree over nations; in SQL the edges whose ends no lighter edges join."""
    return optimise.spanning_forest(views.trade(spark, sf_dir).undirected()).select("src", "dst", "weight")


@query()
def maximum_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow from the first nation that sells to the last one it reaches, edge by edge."""
    g = views.trade(spark, sf_dir)
    return optimise.maximum_flow(g, *_ends(g))[1]


_REGIONS = f"WITH {TRADE}, ra AS (SELECT a.n_regionkey AS src, b.n_regionkey AS dst, sum(weight) AS c FROM arcs JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey WHERE a.n_regionkey <> b.n_regionkey GROUP BY 1, 2), ends AS (SELECT min(r_regionkey) AS s, max(r_regionkey) AS t FROM region)"


@query(_REGIONS + ", cuts AS (SELECT m FROM generate_series(0, 31) g(m) CROSS JOIN ends WHERE (m >> s::INTEGER) & 1 = 1 AND (m >> t::INTEGER) & 1 = 0) SELECT min(c)::DOUBLE AS flow_value FROM (SELECT m, coalesce(sum(c) FILTER ((m >> src::INTEGER) & 1 = 1 AND (m >> dst::INTEGER) & 1 = 0), 0) AS c FROM cuts CROSS JOIN ra GROUP BY 1)")
def maximum_flow_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow from the first region to the last through trade; in SQL the least cut."""
    g = views.regions(spark, sf_dir)
    ends = g.vertices.agg(F.min("id"), F.max("id")).first()
    return spark.createDataFrame([(float(optimise.maximum_flow(g, ends[0], ends[1])[0]),)], "flow_value double")


@query(_REGIONS + ", e AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(c) AS w FROM ra GROUP BY 1, 2), m AS (SELECT 1 AS size, w AS weight FROM e UNION ALL SELECT 2, x.w + y.w FROM e x JOIN e y ON x.a < y.a AND x.b NOT IN (y.a, y.b) AND x.a <> y.b) SELECT size::BIGINT AS size, weight::DOUBLE AS weight FROM m ORDER BY size DESC, weight DESC LIMIT 1")
def maximum_matching_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and weight of the best matching of regions; in SQL over all matchings."""
    return optimise.maximum_matching(views.regions(spark, sf_dir)).agg(F.count(F.lit(1)).alias("size"), F.sum("weight").alias("weight"))


_ORDER = "o AS (SELECT id, row_number() OVER (ORDER BY count(src) DESC, id) AS k FROM v LEFT JOIN arcs ON src = id GROUP BY id), w AS (SELECT x.k, y.k AS before FROM arcs JOIN o x ON x.id = src JOIN o y ON y.id = dst WHERE y.k < x.k)"


@query(f"WITH RECURSIVE {COPART}, {_ORDER}, c(k, colour) USING KEY (k) AS (SELECT 1::BIGINT, 0::BIGINT UNION SELECT n.k, coalesce(min(f.free), 0) FROM (SELECT c.k + 1 AS k FROM c WHERE c.k < (SELECT max(k) FROM o)) n LEFT JOIN (SELECT w.k, q.f AS free FROM (SELECT k + 1 AS k FROM c) p JOIN (SELECT DISTINCT k FROM w) w ON w.k = p.k CROSS JOIN generate_series(0, 60) q(f) WHERE NOT EXISTS (SELECT 1 FROM recurring.c r JOIN w x ON x.before = r.k WHERE x.k = w.k AND r.colour = q.f)) f ON f.k = n.k GROUP BY 1) SELECT id, colour::INTEGER AS colour FROM c JOIN o ON o.k = c.k")
def graph_coloring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy colouring of parts, largest degree first."""
    return optimise.colouring(views.copart(spark, sf_dir))


@query(f"WITH {COPART} SELECT count(*) AS coloured, 0::BIGINT AS conflicts FROM v")
def coloring_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coloured parts (by saturation) and neighbours of the same colour, of which there are none."""
    g = views.copart(spark, sf_dir)
    c = cut(optimise.colouring(g, "DSATUR"))
    sides = g.edges.join(c.select(F.col("id").alias("src"), F.col("colour").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("colour").alias("b")), "dst")
    return c.agg(F.count(F.lit(1)).alias("coloured")).join(F.broadcast(sides.agg(F.count_if(F.col("a") == F.col("b")).alias("conflicts"))), F.lit(True))


@query()
def maximum_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching of greatest size, then weight, among nations."""
    return optimise.maximum_matching(views.trade(spark, sf_dir))


@query(f"WITH RECURSIVE {COPART}, e AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS k FROM edges), m(k, src, dst, taken) USING KEY (k) AS (SELECT k, src, dst, true FROM e WHERE k = 1 UNION SELECT e.k, any_value(e.src), any_value(e.dst), count(r.k) = 0 FROM m JOIN e ON e.k = m.k + 1 LEFT JOIN recurring.m r ON r.taken AND (r.src IN (e.src, e.dst) OR r.dst IN (e.src, e.dst)) GROUP BY e.k) SELECT src, dst FROM m WHERE taken")
def maximal_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy matching of parts."""
    return optimise.maximal_matching(views.copart(spark, sf_dir))


# communities -------------------------------------------------------------------------------------


@query()
def community_louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of parts by modularity."""
    return community.communities(views.copart(spark, sf_dir))


@query()
def community_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of parts by majority."""
    return community.communities(views.copart(spark, sf_dir), "label_propagation")


@query()
def community_greedy_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of nations by merging."""
    return community.communities(views.trade(spark, sf_dir), "greedy_modularity")


@query(f"WITH {COPART}, c AS (SELECT p_partkey AS id, p_brand AS c FROM part), m AS (SELECT sum(weight) AS m FROM edges), w AS (SELECT x.c, sum(weight) AS w FROM edges JOIN c x ON src = x.id JOIN c y ON dst = y.id WHERE x.c = y.c GROUP BY 1), d AS (SELECT c, sum(weight) AS d FROM arcs JOIN c ON src = id GROUP BY 1) SELECT round(sum(coalesce(w, 0) / m - pow(d / (2 * m), 2)), 6) AS modularity FROM d LEFT JOIN w USING (c) CROSS JOIN m")
def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modularity of parts grouped by brand."""
    g = views.copart(spark, sf_dir)
    return community.modularity(g, g.vertices.select("id", F.col("brand").alias("community"))).select(_r("modularity"))
