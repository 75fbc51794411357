"""Nested records, orphan references, skewed joins, identifiers, bibliometrics and delivery metrics."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions.text import doi
from graphloom.operators import bibliometrics as bib
from graphloom.operators import delivery, skew
from graphloom.operators.nested import WORK, FlatTables, emit
from graphloom.operators.orphans import orphan_references
from graphloom.streaming import deliveries


def test_doi_forms(spark):
    same = ["10.1/ab", " 10.1/AB ", "doi:10.1/ab", "DOI: 10.1/aB.", "https://doi.org/10.1/ab", "http://dx.doi.org/10.1%2Fab"]
    none = [None, "", "  ", "10.", "10.1/", "see 10.1/ab", "no doi", "10.1/a b"]
    rows = spark.createDataFrame([(x,) for x in same + none], "d string").select("d", doi("d").alias("k")).collect()
    assert [r["k"] for r in rows] == ["10.1/ab"] * len(same) + [None] * len(none)


def test_flattening(spark):
    work = {
        "DOI": "d", "author": [{"given": "A", "affiliation": [{"name": "x"}, None, {}, {"name": "y"}]}, None, "Lone Name", {}, {"family": "B", "affiliation": {"name": "z"}}],
        "reference": {"key": "1"}, "container-title": ["t", " ", None, "u"], "published-print": {"date-parts": [[2001, None, 3], None, [None]]},
    }
    rows = [(1, json.dumps(work), "k"), (2, json.dumps({"message": work}), "k"), (3, "{broken", "k"), (4, None, "k"), (None, "[]", "k"), (5, "{}", "k"), (6, '{"a": NaN}', "k")]
    tables = FlatTables(spark.createDataFrame(rows, "rid long, js string, tag string"), WORK, "rid", "js")
    for rid in (1, 2):
        got = sorted((r["tag"], r["pos"], r["sub_pos"]) for r in tables.places("author", "affiliation", "reference", "container_title", "date_part").where(F.col("record_id") == rid).collect())
        assert got == [("affiliation", 0, 0), ("affiliation", 0, 3), ("affiliation", 4, 0), ("author", 0, 0), ("author", 2, 0), ("author", 4, 0), ("container_title", 0, 0), ("container_title", 3, 0), ("date_part", 0, 0), ("date_part", 0, 2), ("reference", 0, 0)]
    assert tables.places("rejected").count() == 4 and tables.places("work").count() == 3
    authors = {r["pos"]: r for r in tables.table("author", "given string, family string").where("record_id = 1").collect()}
    assert authors[0]["given"] == "A" and authors[2]["value"] == "Lone Name" and authors[4]["parent_pk"] == "1"
    assert emit(spark.createDataFrame([], "rid long, js string"), WORK, "rid", "js").count() == 0


def test_orphans(spark):
    t = lambda d: f"2024-01-{d:02d} 00:00:00"
    refs = spark.createDataFrame([(1, "a", "1", t(5)), (2, "a", "2", t(5)), (3, "b", "1", t(5)), (4, "a", None, t(5)), (5, None, None, t(5)), (6, "c", "1", t(5)), (6, "c", "1", t(5)), (7, "d", None, t(5)), (8, "a", "1", None)], "n int, x string, y string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    targets = spark.createDataFrame([("a", "1", t(1), None), ("a", "1", t(9), None), ("b", "1", t(8), None), ("a", "2", t(1), None), ("a", "2", None, t(4)), ("c", "1", None, t(1))], "x string, y string, held string, gone string")
    targets = targets.select("x", "y", F.col("held").cast("timestamp_ntz").alias("held"), F.col("gone").cast("timestamp_ntz").alias("gone"), F.lit(1).alias("n"))
    got = lambda m: sorted((r["n"], r["reason"]) for r in orphan_references(refs, targets, ["x", "y"], "at", "held", "gone", m).collect())
    simple = [(2, "deleted"), (3, "late"), (6, "missing"), (6, "missing")]
    assert got("simple") == simple
    assert got("partial") == sorted([*simple, (4, "deleted"), (7, "missing")])
    assert got("full") == sorted([*simple, (4, "missing"), (7, "missing")])
    none = orphan_references(refs, targets.limit(0), ["x", "y"], "at", "held", "gone")
    assert none.count() == 6 and orphan_references(refs.limit(0), targets, ["x", "y"], "at", "held", "gone").count() == 0
    with pytest.raises(ValueError):
        orphan_references(refs, targets, ["x", "y"], "at", "held", "gone", "other")


def test_skew_join_is_the_plain_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "MIN_HOT", 10)
    left = spark.range(300).select(F.when(F.col("id") < 200, 7).when(F.col("id") < 210, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.range(0, 250).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    assert skew.hot_keys(left, ["k"]) == [(7,)]
    for how in ("inner", "left", "left_semi", "left_anti"):
        cols = ["v"] if how in ("left_semi", "left_anti") else ["v", "w"]
        assert sorted(map(str, skew.skew_join(left, right, ["k"], how).select(*cols).collect())) == sorted(map(str, left.join(right, ["k"], how).select(*cols).collect()))


def papers(spark, rows):
    return spark.createDataFrame(rows, "id long, authors array<string>, year int, citations long")


def test_bibliometrics(spark):
    p = papers(spark, [(1, ["Alice", "Bob"], 2020, 20), (2, ["Alice", "Charlie"], 2020, 15), (3, [" Alice ", "Alice", "", None], 2021, 5), (4, ["Bob"], None, 3), (5, ["Charlie", "Dave"], 2021, None), (6, None, None, None)])
    h = {r["author"]: (r["papers"], r["h_index"], r["total_citations"]) for r in bib.h_index(p).collect()}
    assert h == {"Alice": (3, 3, 40), "Bob": (2, 2, 23), "Charlie": (2, 1, 15), "Dave": (1, 0, 0)}
    a = bib.author_impact(p, "alice").first()
    assert (a["papers_found"], a["h_index"], a["total_citations"], a["papers"]) == (3, 3, 40, [1, 2, 3])
    assert bib.author_impact(p, "Zara").first()[:4] == (0, 0, 0, 0.0)
    top = {(r["author_a"], r["author_b"]): r["n"] for r in bib.coauthor_pairs(p).collect()}
    assert top == {("Alice", "Bob"): 1, ("Alice", "Charlie"): 1, ("Charlie", "Dave"): 1}
    years = [(y * 100 + k, [], y, 0) for y in range(2010, 2020) for k in range(1 if y < 2015 else 5)]
    assert bib.research_trend(papers(spark, years)).first()["trend"] == "increasing"
    assert bib.research_trend(papers(spark, [(1, [], 2020, 0), (2, [], 2020, 0)])).first()["trend"] == "no_temporal_data"
    assert bib.research_trend(papers(spark, years), 1).first()["trend"] == "insufficient_data"
    cites = spark.createDataFrame([("seed", "B"), ("C", "B"), ("B", "X"), ("D", "X")], "src string, dst string")
    known = spark.createDataFrame([("C", 250, 2024)], "id string, citations long, year int")
    assert [tuple(r) for r in bib.recommend(cites, known, "seed", 2024).collect()] == [("C", 4.0)]
    assert bib.recommend(cites, known, "seed", 2024, 0).count() == 0
    b = papers(spark, [(1, ["Alice Smith", "B"], 2020, 1)]).select(F.lit("10.1/a.b").alias("id"), F.lit(None).cast("string").alias("doi"), F.lit("T").alias("title"), F.lit(None).cast("string").alias("journal"), "authors", "year", "citations")
    assert bib.bibtex(b).first()["entry"] == "@article{10_1_a_b,\n  title = {T},\n  author = {Alice Smith and B},\n  year = {2020},\n  note = {Citations: 1}\n}"


def test_delivery(spark):
    at = lambda h, m: f"2024-01-01 {h:02d}:{m:02d}:00"
    rows = [(at(0, 0), at(0, 10), "failure"), (at(0, 5), at(0, 6), "failure"), (at(0, 30), at(0, 31), "success"), (at(1, 0), at(1, 0), "cancelled"), (at(2, 0), at(2, 0), "success")]
    runs = spark.createDataFrame(rows, "c string, u string, conclusion string").select(F.col("c").cast("timestamp_ntz").alias("created_at"), F.col("u").cast("timestamp_ntz").alias("updated_at"), "conclusion")
    assert delivery.mean_time_to_restore(runs).first()[0] == 24.0
    assert delivery.mean_time_to_restore(runs.withColumn("p", F.lit(1)), by="p").first()[0] == 24.0
    assert delivery.mean_time_to_restore(runs.limit(0)).first()[0] == 30.0
    assert delivery.change_failure_rate(runs).first()[0] == 60.0
    assert delivery.workflow_status(runs).first()[:] == (5, 2, "40.0%")
    level = lambda *v: spark.range(1).select(delivery.performance_level(*map(F.lit, v))).first()[0]
    assert [level(2, 12, 5, 30), level(0.5, 100, 20, 600), level(0.05, 500, 40, 5000), level(0.01, 1000, 60, 20000)] == ["Elite", "High", "Medium", "Low"]


def test_streaming_counts_match_the_batch(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", i % 4, "view", 1.0, "{}") for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = deliveries.tumbling_counts(deliveries.event_stream(spark, str(tmp_path / "in")), late="10 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = deliveries.tumbling_counts(df.withColumn("at", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, batch.collect()))


def test_what_stands_beside_a_child_stays(spark):
    work = {"DOI": "d", "published-print": {"date-parts": [[2019]], "date-time": "t"}, "author": [{"given": "A", "affiliation": []}]}
    tables = FlatTables(spark.createDataFrame([(1, json.dumps(work)), (2, json.dumps({"published-print": {"date-parts": [[1]]}}))], "rid long, js string"), WORK, "rid", "js")
    kept = {r["record_id"]: json.loads(r["payload"]) for r in tables.places("work").collect()}
    assert kept == {1: {"DOI": "d", "published-print": {"date-time": "t"}}, 2: {}}


def test_latest_runs_do_not_depend_on_the_order_of_ties(spark):
    rows = [(i, "2024-01-01", "failure" if i % 2 else "success") for i in range(6)] + [(6, "2023-01-01", "failure")]
    runs = spark.createDataFrame(rows, "run_id long, created_at string, conclusion string").withColumn("updated_at", F.col("created_at")).withColumn("name", F.concat(F.lit("job "), "run_id"))
    for order in (runs, runs.orderBy(F.desc("run_id"))):
        assert delivery.change_failure_rate(order, last=3).first()[0] == 100.0
        assert [r["run_id"] for r in delivery.recent_runs(order, "run_id", show=3).collect()] == [0, 1, 2]
    assert delivery.run_status(runs, 1).first()[:3] == (1, ["job 1"], "failure")
    assert delivery.run_status(runs, 99).first()[:3] == (0, [], None)


def test_scratch_tables_are_removed(spark):
    from graphloom.session import clear_scratch

    clear_scratch(spark)
    tables = FlatTables(spark.createDataFrame([(1, "{}")], "rid long, js string"), WORK, "rid", "js")
    assert tables.places("work").count() == 1 and clear_scratch(spark) == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        spark.read.parquet(tables.path).count()
