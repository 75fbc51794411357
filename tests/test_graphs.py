"""Graph operators on small graphs with known results."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.errors import AlgorithmError, GraphAlreadyExistsError, GraphNotFoundError, GraphOperationError, NodeNotFoundError, ValidationError, graph_name
from graphloom.graphs.model import PropertyGraph
from graphloom.operators import centrality, community, kernels, optimise, paths, structure
from graphloom.operators.matching import heaviest_matching
from graphloom.sources import graph_io


def graph(spark, edges, directed=False, nodes=None, names="src long, dst long, weight double"):
    rows = [(*e, None) if len(e) == 2 else e for e in edges]
    extra = spark.createDataFrame([(n,) for n in nodes], "id long") if nodes else None
    return PropertyGraph.of(spark.createDataFrame(rows, names), directed, extra)


def as_dict(df, key="id", value="score"):
    return {r[key]: r[value] for r in df.collect()}


PATH5 = [(0, 1), (1, 2), (2, 3), (3, 4)]
K5 = list(itertools.combinations(range(5), 2))
TWO_TRIANGLES = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)]


def test_path5(spark):
    g = graph(spark, PATH5)
    assert [r["id"] for r in paths.shortest_path(g, 0, 4).orderBy("step").collect()] == [0, 1, 2, 3, 4]
    b = as_dict(centrality.betweenness(g))
    assert b[0] == b[4] == 0 and b[2] == max(b.values())
    assert structure.diameter(g).first()[:] == (4, 2)
    assert optimise.maximum_matching(g).count() == 2
    assert structure.cycle_count(g).first()["independent_cycles"] == 0


def test_k5(spark):
    g = graph(spark, K5)
    assert set(as_dict(centrality.degree_centrality(g)).values()) == {1.0}
    assert all(abs(s - 1 / math.sqrt(5)) < 1e-4 for s in as_dict(centrality.eigenvector(g)).values())
    s = structure.statistics(g).first()
    assert (s["density"], s["degree_mean"], s["degree_std"]) == (1.0, 4.0, 0.0)
    assert structure.clustering_summary(g).first()[:] == (1.0, 1.0)
    assert optimise.spanning_forest(g).count() == 4
    assert len(set(as_dict(optimise.colouring(g), value="colour").values())) == 5
    assert structure.cycles(g).count() == structure.cycle_count(g).first()["independent_cycles"] == 6


def test_two_triangles(spark):
    g = graph(spark, TWO_TRIANGLES, nodes=[9])
    assert as_dict(structure.components(g), value="component") == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 9: 9}
    assert structure.diameter(g).count() == 0
    for method in community.METHODS:
        c = community.communities(g, method)
        assert len(set(as_dict(c, value="community").values())) >= 2
        assert community.modularity(g, c).first()[0] > 0


@pytest.mark.parametrize("local", [0, 50_000])
def test_components_by_rounds_and_in_one_task(spark, monkeypatch, local):
    from graphloom.operators import components as c

    monkeypatch.setattr(c, "LOCAL_LINKS", local)
    rnd = random.Random(9)
    edges = [(f"v{rnd.randrange(60)}", f"v{rnd.randrange(60)}") for _ in range(40)] + [("z", "z"), (None, "q"), ("v1", "v1")]
    group = {v: {v} for e in edges if None not in e for v in e}
    for a, b in edges:
        if a and b and group[a] is not group[b]:
            group[a] |= group[b]
            for v in group[b]:
                group[v] = group[a]
    got = as_dict(c.component_labels(spark.createDataFrame(edges, "src string, dst string")), value="component")
    assert got == {v: min(g) for v, g in group.items()}
    assert c.component_labels(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("directed", [True, False])
def test_rounds_and_one_task_agree(spark, monkeypatch, directed):
    from graphloom.operators import small

    rnd = random.Random(13)
    edges = sorted({(rnd.randrange(18), rnd.randrange(18)) for _ in range(34)})
    g = graph(spark, [(a, b, float(rnd.randrange(1, 5))) for a, b in edges if directed or a <= b], directed, nodes=range(20))
    sources = spark.createDataFrame([(0,), (3,), (3,), (None,)], "source long")
    got = []
    for arcs in (50_000, 0):
        monkeypatch.setattr(small, "LOCAL_ARCS", arcs)
        walk = sorted(map(tuple, paths.bfs(g.arcs(), sources).collect()), key=repr)
        near = sorted(map(tuple, paths.bfs(g.arcs(), sources, 2).collect()), key=repr)
        scores = [{k: round(v, 9) for k, v in as_dict(f).items()} for f in (centrality.betweenness(g), centrality.pagerank(g), centrality.pagerank(g, fixed_rounds=7), centrality.closeness(g))]
        strong = as_dict(structure.strong_components(g), value="component")
        forest = sorted(map(tuple, optimise.spanning_forest(g.undirected()).select("src", "dst", "weight").collect()))
        got.append((walk, near, scores, strong, forest))
    assert got[0] == got[1] and len(got[0][2][0]) == 20 and abs(sum(got[0][2][1].values()) - 1) < 1e-6


def test_weighted_square(spark):
    g = graph(spark, [(0, 1, 1.0), (1, 2, 2.0), (2, 3, 3.0), (0, 3, 4.0)])
    assert [r["id"] for r in paths.weighted_path(g, 0, 2).orderBy("step").collect()] == [0, 1, 2]
    for name in ("kruskal", "prim"):
        assert optimise.spanning_forest(g, algorithm=name).agg(F.sum("weight")).first()[0] == 6
    with pytest.raises(ValidationError):
        optimise.spanning_forest(g, algorithm="other")


def test_directed(spark):
    dag = graph(spark, [(0, 1), (1, 2), (2, 3)], True)
    assert as_dict(structure.topological_levels(dag), value="level") == {0: 0, 1: 1, 2: 2, 3: 3}
    assert structure.connectivity(dag).first()[:] == (1, 4, True, False)
    ring = graph(spark, [(0, 1), (1, 2), (2, 0)], True)
    assert set(as_dict(structure.strong_components(ring), value="component").values()) == {0}
    assert all(abs(s - 1 / 3) < 1e-4 for s in as_dict(centrality.pagerank(ring)).values())
    assert [r["cycle"] for r in structure.cycles(ring).collect()] == [[0, 1, 2]]
    assert structure.is_dag(dag) and not structure.is_dag(ring)
    with pytest.raises(GraphOperationError):
        structure.topological_levels(ring)


def test_flow(spark):
    g = graph(spark, [(0, 1, 10.0), (0, 2, 15.0), (1, 3, 5.0), (2, 3, 10.0)], True)
    value, flow = optimise.maximum_flow(g, 0, 3, "weight")
    assert value == 15
    into = flow.where("dst = 1").agg(F.sum("flow")).first()[0]
    assert into == flow.where("src = 1").agg(F.sum("flow")).first()[0]
    line = graph(spark, [(0, 1, 10.0), (1, 2, 3.0), (2, 3, 7.0)], True)
    assert optimise.maximum_flow(line, 0, 3, "weight")[0] == 3
    with pytest.raises(AlgorithmError):
        optimise.maximum_flow(graph(spark, [(0, 1), (1, 2)], True), 0, 2, "weight")


def test_negative_weights(spark):
    g = graph(spark, [(0, 1, 4.0), (0, 2, 5.0), (2, 1, -3.0)], True)
    assert as_dict(paths.single_source(g, 0, negative=True), value="distance") == {0: 0.0, 1: 2.0, 2: 5.0}
    with pytest.raises(AlgorithmError):
        paths.single_source(g, 0)
    with pytest.raises(AlgorithmError):
        paths.single_source(graph(spark, [(0, 1, 1.0), (1, 0, -2.0)], True), 0, negative=True)


def test_pagerank_with_dangling_against_plain_iteration(spark):
    arcs = [(1, 0), (2, 0), (3, 0), (0, 1), (3, 4)]
    n = 5
    x = [1 / n] * n
    for _ in range(100):
        out = {i: [b for a, b in arcs if a == i] for i in range(n)}
        y = [0.15 / n + 0.85 * sum(x[i] for i in range(n) if not out[i]) / n] * n
        for i in range(n):
            for b in out[i]:
                y[b] += 0.85 * x[i] / len(out[i])
        x = y
    got = as_dict(centrality.pagerank(graph(spark, arcs, True), fixed_rounds=100))
    assert all(abs(got[i] - x[i]) < 1e-9 for i in range(n))


def test_random_graphs_against_brute_force(spark):
    rnd = random.Random(5)
    edges = sorted({(min(a, b), max(a, b)) for a, b in ((rnd.randrange(9), rnd.randrange(9)) for _ in range(16)) if a != b})
    g = graph(spark, [(a, b, float(rnd.randrange(1, 9))) for a, b in edges], nodes=range(9))
    degree = {v: sum(v in e for e in edges) for v in range(9)}
    colour = {}
    for v in sorted(range(9), key=lambda v: (-degree[v], v)):
        used = {colour[u] for e in edges if v in e for u in e if u in colour}
        colour[v] = next(c for c in range(9) if c not in used)
    assert as_dict(optimise.colouring(g), value="colour") == colour
    for strategy in optimise.STRATEGIES[1:]:
        c = as_dict(optimise.colouring(g, strategy), value="colour")
        assert all(c[a] != c[b] for a, b in edges)
    taken, busy = [], set()
    for a, b in edges:
        if a not in busy and b not in busy:
            taken.append((a, b))
            busy |= {a, b}
    assert sorted((r["src"], r["dst"]) for r in optimise.maximal_matching(g).collect()) == taken


def test_matching_against_enumeration():
    rnd = random.Random(2)
    for _ in range(400):
        n = rnd.randrange(2, 9)
        edges = {(a, b): rnd.randrange(1, 10) for a, b in itertools.combinations(range(n), 2) if rnd.random() < rnd.choice((0.35, 0.6))}
        best = {0: (0, 0)}  # by the set of taken vertices
        for (a, b), w in edges.items():
            for taken, (size, weight) in list(best.items()):
                if not taken >> a & 1 and not taken >> b & 1:
                    key = taken | 1 << a | 1 << b
                    best[key] = max(best.get(key, (0, 0)), (size + 1, weight + w))
        for bonus, value in ((0, max(w for _, w in best.values())), (1 + sum(edges.values()), None)):
            mate = heaviest_matching(n, {e: w + bonus for e, w in edges.items()})
            assert all(m < 0 or mate[m] == v for v, m in enumerate(mate))
            got = [w for (a, b), w in edges.items() if mate[a] == b]
            assert (sum(got) == value) if value is not None else ((len(got), sum(got)) == max(best.values()))


def test_editing_and_catalog(spark):
    e = Engine(spark)
    e.run("create_graph", graph="g")
    with pytest.raises(GraphAlreadyExistsError):
        e.run("create_graph", graph="g")
    e.run("add_edges", graph="g", edges=[["a", "b", {"weight": 2.0}], ["b", "c", {"weight": 1.0}], ["b", "a", {"weight": 5.0}]])
    assert e.run("get_info", graph="g").first()[:] == (3, 2, False)
    assert e.run("get_edge_attributes", graph="g", source="b", target="a").first()["weight"] == 5.0
    e.run("set_node_attributes", graph="g", attributes={"a": {"kind": "x"}})
    assert e.run("get_node_attributes", graph="g", node="a").first()["kind"] == "x"
    with pytest.raises(NodeNotFoundError):
        e.run("set_node_attributes", graph="g", attributes={"zz": {"kind": "x"}})
    assert e.run("subgraph", graph="g", nodes=["a", "b"], new_graph="h").first()[:] == (2, 1, False)
    assert {r["id"] for r in e.run("get_neighbors", graph="g", node="b").collect()} == {"a", "c"}
    e.run("remove_nodes", graph="g", nodes=["b", "nothing"])
    assert e.run("get_info", graph="g").first()[:] == (2, 0, False)
    e.run("merge_graphs", graph_a="g", graph_b="h", new_graph="m")
    assert e.run("list_graphs").count() == 3
    e.run("delete_graph", graph="h")
    with pytest.raises(GraphNotFoundError):
        e.run("get_info", graph="h")
    for bad in ("", "a b", "x" * 101, None):
        with pytest.raises(ValidationError):
            graph_name(bad)
    with pytest.raises(ValidationError):
        e.run("no_such_tool")


def test_errors_have_the_codes_of_a_remote_call():
    from graphloom import errors

    want = {"GraphNotFoundError": -32001, "NodeNotFoundError": -32002, "EdgeNotFoundError": -32003, "GraphAlreadyExistsError": -32004, "InvalidGraphIdError": -32005, "InvalidNodeIdError": -32006, "InvalidEdgeError": -32007}
    want |= {"GraphOperationError": -32008, "AlgorithmError": -32009, "ValidationError": -32010, "ResourceLimitError": -32011, "NotInitializedError": -32012}
    want |= {"ParseError": -32700, "InvalidRequestError": -32600, "UnknownToolError": -32601, "InvalidParamsError": -32602, "GraphError": -32603}
    assert {n: getattr(errors, n).code for n in want} == want and sorted(want.values()) == sorted(errors.CODES.values())
    assert errors.GraphNotFoundError("x").as_dict() == {"code": -32001, "message": "x"}


def test_views_of_similar_names_stay_apart(spark):
    e = Engine(spark)
    for name, nodes in (("a-b", [1]), ("a_b", [1, 2])):
        e.run("create_graph", graph=name)
        e.run("add_nodes", graph=name, nodes=nodes)
    assert spark.sql("SELECT count(*) FROM `a-b__v`").first()[0] == 1 and spark.sql("SELECT count(*) FROM a_b__v").first()[0] == 2
    e.run("delete_graph", graph="a-b")
    assert spark.sql("SELECT count(*) FROM a_b__v").first()[0] == 2


def test_engine_results(spark):
    from graphloom.errors import InvalidEdgeError, InvalidParamsError, UnknownToolError

    e = Engine(spark)
    e.run("import_csv", graph="two", csv_data="0,1\n1,2\n0,2\n3,4\n4,5\n3,5")
    found = e.run("community_detection", graph="two")
    assert found["num_communities"] == 2 and found["modularity"] > 0 and [r["size"] for r in found["community_sizes"].collect()] == [3, 3]
    s = e.run("graph_statistics", graph="two").first()
    assert s["is_connected"] is False and s["diameter"] is None
    e.run("import_csv", graph="ring", csv_data="0,1\n1,2\n2,0", directed=True)
    s = e.run("graph_statistics", graph="ring").first()
    assert (s["is_strongly_connected"], s["diameter"], s["radius"]) == (True, 2, 2)
    c = e.run("cycles_detection", graph="ring")
    assert (c["has_cycle"], c["is_dag"], c["num_cycles_found"], c["cycles_truncated"], c["cycles"].first()[0]) == (True, False, 1, False, ["0", "1", "2"])
    assert e.run("cycles_detection", graph="two")["independent_cycles"] == 2
    e.run("create_graph", graph="f", directed=True)
    e.run("add_edges", graph="f", edges=[["s", "a", {"capacity": 10.0}], ["a", "t", {"capacity": 10.0}], ["s", "t", {"capacity": 10.0}]])
    assert e.run("maximum_flow", graph="f", source="s", sink="t")["flow_value"] == 20
    papers = spark.createDataFrame([("a", None, 1, 2020)], "id string, authors array<string>, citations long, year int")
    cites = spark.createDataFrame([("a", "b"), ("c", "d")], "src string, dst string")
    assert e.run("find_collaboration_patterns", papers=papers, cites=cites).count() == 2
    r = e.run("recommend_papers", cites=spark.createDataFrame([("seed", "B"), ("C", "B")], "src string, dst string"), papers=papers, as_of_year=2024, seed_paper="seed", top_n=5)
    assert (r["total_found"], r["based_on"], [x["id"] for x in r["recommendations"].collect()]) == (1, {"cited_papers": 1, "citing_papers": 0}, ["C"])
    assert "note" in e.run("recommend_papers", cites=cites, papers=papers, as_of_year=2024, seed_doi="zz")
    runs = spark.createDataFrame([(1, "j", "failure", "2024-01-01", "2024-01-02")], "run_id long, name string, conclusion string, created_at string, updated_at string")
    assert e.run("get_workflow_status", runs=runs, run_id=1)["failed_jobs"] == ["j"] and e.run("get_workflow_status", runs=runs)["failure_rate"] == "100.0%"
    assert [r["uri"] for r in e.list_resources()] == ["graph://f", "graph://ring", "graph://two"] and '"source":"0"' in e.read_resource("graph://two")
    tools = {t["name"]: t for t in e.list_tools()}
    assert tools["add_nodes"]["writes"] and not tools["pagerank"]["writes"] and tools["maximum_flow"]["required"] == ["graph", "source", "sink"]
    for error, tool, arguments in ((UnknownToolError, "x", {}), (InvalidParamsError, "pagerank", {}), (InvalidParamsError, "pagerank", {"graph": "f", "y": 1}), (InvalidEdgeError, "add_edges", {"graph": "f", "edges": [["a"]]})):
        with pytest.raises(error):
            e.run(tool, **arguments)


def test_louvain_by_rounds_is_as_good_as_in_one_task(spark, monkeypatch):
    from graphloom.errors import LIMITS

    rnd = random.Random(8)
    edges = {(min(a, b), max(a, b)) for a, b in ((rnd.randrange(30), rnd.randrange(30)) for _ in range(20)) if a != b}
    edges |= {e for c in range(3) for e in itertools.combinations(range(10 * c, 10 * c + 10), 2) if rnd.random() < 0.6}
    g = graph(spark, [(a, b, float(rnd.randrange(1, 4))) for a, b in sorted(edges)])
    one = community.modularity(g, community.communities(g)).first()[0]
    monkeypatch.setitem(LIMITS, "component_nodes", 5)
    many = community.communities(g)
    assert community.modularity(g, many).first()[0] >= 0.95 * one and 2 <= many.select("community").distinct().count() <= 6


def test_label_propagation_leaves_no_vertex_that_wants_to_move(spark):
    rnd = random.Random(4)
    edges = sorted({(min(a, b), max(a, b)) for a, b in ((rnd.randrange(30), rnd.randrange(30)) for _ in range(60)) if a != b})
    label = as_dict(community.label_propagation(graph(spark, edges, nodes=range(31))), value="community")
    assert label[30] == 30 and len(label) == 31
    for v in range(30):
        near = [label[b if a == v else a] for a, b in edges if v in (a, b)]
        assert not near or near.count(label[v]) == max(near.count(x) for x in near)


def test_empty_and_single(spark):
    empty = PropertyGraph.empty(spark)
    assert structure.components(empty).count() == 0
    assert structure.connectivity(empty).first()["is_weakly_connected"] is False
    assert structure.clustering_summary(empty).first()[:] == (0.0, 0.0)
    assert structure.statistics(empty).first()["density"] == 0
    assert optimise.colouring(empty).count() == optimise.maximal_matching(empty).count() == centrality.eigenvector(empty).count() == centrality.pagerank(empty).count() == 0
    single = graph(spark, [], nodes=[7])
    assert structure.components(single).count() == 1 and centrality.degree_centrality(single).first()["score"] == 1.0


def test_csv_and_json(spark):
    g = graph_io.import_csv_text(spark, "source,target\n A , B ,x\nB,C\n\nlonely\nA,B\n", True)
    assert g.info().first()[:] == (3, 2, True)
    kept = graph_io.import_csv_text(spark, "a,b\nsource,target\nfrom,to", True)
    assert kept.info().first()[:] == (6, 3, True)
    text = graph_io.export_json(g)
    assert '"source":"A","target":"B"' in text and text.startswith('{"directed": true')
    for kind in ("circular", "spring", "kamada_kawai"):
        assert graph_io.layout(g, kind).count() == 3
    line = graph(spark, [(i, i + 1) for i in range(6)])
    at = {r["id"]: r["x"] + 1j * r["y"] for r in graph_io.layout(line, "kamada_kawai").collect()}
    assert abs(at[0] - at[6]) > 4 * abs(at[0] - at[1])
    at = {r["id"]: r["x"] + 1j * r["y"] for r in graph_io.layout(line, "spring").collect()}
    assert abs(at[0] - at[6]) > abs(at[0] - at[1])


def test_single_vertices_are_handed_to_python_together(spark, monkeypatch):
    edges = [(10 * k + i, 10 * k + j) for k in range(40) for i, j in ((1, 2), (2, 3), (1, 3), (3, 4))]
    vertices = spark.range(1_000).withColumn("name", F.col("id").cast("string"))
    pairs = spark.createDataFrame(edges, "src long, dst long")
    named = PropertyGraph(vertices.select(F.col("name").alias("id")), pairs.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")))
    for graph, number in ((PropertyGraph(vertices.select("id"), pairs), int), (named, str)):
        found = {}
        for size in (3, 10**6):
            monkeypatch.setattr(kernels, "GROUP_NODES", size)
            found[size] = {r["id"]: r["colour"] for r in optimise.colouring(graph, "DSATUR").collect()}
        assert found[3] == found[10**6] and len(found[3]) == 1_000
        assert all(found[3][number(a)] != found[3][number(b)] for a, b in edges)
