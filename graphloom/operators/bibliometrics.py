"""Bibliometric queries over papers (``id``, ``authors``, ``year``, ``citations``) and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import strip
from graphloom.graphs.model import PropertyGraph
from graphloom.operators.centrality import degree_centrality
from graphloom.operators.structure import component_sizes, components
from graphloom.session import cut

TREND_UP, TREND_DOWN = 1.2, 0.8


def author_rows(papers: DataFrame) -> DataFrame:
    """(``id``, ``author``, ``pos``, ``citations``, ``year``): every author of every paper once."""
    listed = papers.select("id", F.coalesce("citations", F.lit(0)).cast("bigint").alias("citations"), "year", F.posexplode("authors").alias("pos", "author"))
    named = listed.withColumn("author", strip(F.col("author"))).where(F.col("author") != "")
    return named.groupBy("id", "author").agg(F.min("pos").alias("pos"), F.max("citations").alias("citations"), F.max("year").alias("year"))


def h_index(papers: DataFrame) -> DataFrame:
    """(``author``, ``papers``, ``h_index``, ``total_citations``, ``mean_citations``).

    Papers are first counted by their citations, with the map side's help, so an author of a million
    papers has as many rows as distinct counts (the square root of their sum at most).
    """
    counted = author_rows(papers).groupBy("author", "citations").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("author").orderBy(F.desc("citations")))
    ranked = counted.withColumn("upto", upto)
    reach = F.least("citations", "upto")
    sums = ranked.groupBy("author").agg(F.sum("n").alias("papers"), F.max(reach).alias("h_index"), F.sum(F.col("n") * F.col("citations")).alias("total_citations"))
    return sums.withColumn("mean_citations", F.col("total_citations") / F.col("papers"))


def author_impact(papers: DataFrame, name: str, show: int = 10) -> DataFrame:
    """One row about the papers of which an author's name contains ``name``, without regard to case:
    ``papers_found``, ``h_index``, ``total_citations``, ``mean_citations`` and the ``show`` most cited
    ids. Zeros if there are none."""
    hit = papers.where(F.exists("authors", lambda a: F.contains(F.lower(a), F.lit(name.lower())))).select("id", F.coalesce("citations", F.lit(0)).cast("bigint").alias("citations"))
    counted = hit.groupBy("citations").agg(F.count(F.lit(1)).alias("n"))
    upto = counted.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("citations"))))  # a row for each distinct count
    total = upto.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("papers_found"), F.coalesce(F.max(F.least("citations", "upto")), F.lit(0)).cast("bigint").alias("h_index"), F.coalesce(F.sum(F.col("n") * F.col("citations")), F.lit(0)).cast("bigint").alias("total_citations"))
    first = hit.orderBy(F.desc("citations"), "id").limit(show).agg(F.array_sort(F.collect_list(F.struct((-F.col("citations")).alias("c"), "id"))).alias("p"))
    mean = F.coalesce(F.try_divide(F.col("total_citations"), F.col("papers_found")), F.lit(0.0))
    return total.join(F.broadcast(first), F.lit(True)).select("papers_found", "h_index", "total_citations", mean.alias("mean_citations"), F.transform("p", lambda x: x["id"]).alias("papers"))


def coauthor_pairs(papers: DataFrame, ordered: bool = False) -> DataFrame:
    """(``author_a``, ``author_b``, ``n``): papers shared by two authors.

    ``ordered`` counts (A, B) and (B, A) apart, as they stand in the lists; otherwise A < B.
    """
    rows = author_rows(papers).select("id", "author", "pos")
    lists = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("pos") if ordered else F.lit(0).alias("pos"), "author"))).alias("l"))
    each = lists.select("l", F.posexplode("l").alias("i", "a")).select(F.col("a.author").alias("author_a"), F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("b"))
    return each.select("author_a", F.col("b.author").alias("author_b")).groupBy("author_a", "author_b").agg(F.count(F.lit(1)).alias("n"))


def coauthor_graph(papers: DataFrame) -> PropertyGraph:
    """Authors as vertices, shared papers as weights of edges."""
    pairs = coauthor_pairs(papers).select(F.col("author_a").alias("src"), F.col("author_b").alias("dst"), F.col("n").cast("double").alias("weight"))
    return PropertyGraph(author_rows(papers).select(F.col("author").alias("id")).distinct(), pairs)


def collaboration_patterns(papers: DataFrame, top: int = 10) -> DataFrame:
    """(``kind``, ``rank``, ``a``, ``b``, ``value``): the top pairs and the most central authors."""
    graph = coauthor_graph(papers)
    pairs = graph.edges.orderBy(F.desc("weight"), "src", "dst").limit(top).select(F.lit("pair").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("value"))
    central = degree_centrality(graph, top).select(F.lit("central").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), F.col("score").alias("value"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("value"), "a", "b")).alias("rank")  # over the 2 * top rows only
    return pairs.unionByName(central).select("kind", rank, "a", "b", "value")


def collaboration_clusters(graph: PropertyGraph, top: int = 10, show: int = 10) -> DataFrame:
    """(``component``, ``size``, ``members``) of the ``top`` largest clusters of works that cite one
    another, with the first ``show`` members: what is known of collaboration where authors aren't."""
    labels = cut(components(graph))
    largest = component_sizes(labels).orderBy(F.desc("size"), "component").limit(top)
    held = labels.join(F.broadcast(largest), "component")
    first = held.withColumn("k", F.row_number().over(Window.partitionBy("component").orderBy("id"))).where(F.col("k") <= show)
    return first.groupBy("component", "size").agg(F.array_sort(F.collect_list("id")).alias("members"))


def yearly(papers: DataFrame) -> DataFrame:
    """(``year``, ``publications``, ``citations``, ``mean_citations``) of papers with a year."""
    c = F.coalesce("citations", F.lit(0))
    return papers.where(F.col("year").isNotNull()).groupBy("year").agg(F.count(F.lit(1)).alias("publications"), F.sum(c).alias("citations"), F.avg(c).alias("mean_citations"))


def research_trend(papers: DataFrame, window: int = 5) -> DataFrame:
    """One row: ``trend`` of publications a year, the last ``window`` years that occur against the
    first; ``years``, ``first_mean`` and ``last_mean``. A slice of one year is too little data."""
    per_year = yearly(papers)  # one row a year
    numbered = per_year.select("publications", F.row_number().over(Window.orderBy("year")).alias("up"), F.row_number().over(Window.orderBy(F.desc("year"))).alias("down"))
    mean = lambda c: F.avg(F.when(F.col(c) <= window, F.col("publications")))
    s = numbered.agg(F.count(F.lit(1)).alias("years"), mean("up").alias("first_mean"), mean("down").alias("last_mean"))
    trend = F.when(F.col("years") < 2, "no_temporal_data").when(F.lit(window) < 2, "insufficient_data").when(F.col("last_mean") > TREND_UP * F.col("first_mean"), "increasing").when(F.col("last_mean") < TREND_DOWN * F.col("first_mean"), "decreasing").otherwise("stable")
    return s.select(trend.alias("trend"), "years", "first_mean", "last_mean")


def recommend(cites: DataFrame, papers: DataFrame, seed: str, as_of_year: int, top: int = 10) -> DataFrame:
    """(``id``, ``score``): papers that cite something the seed cites, neither the seed nor cited by it.

    Score: 1, plus up to 2 for citations (one for each hundred), plus what the year is above ten years
    before ``as_of_year``, over ten. Ties go to the smaller id; ``top`` 0 gives none.
    """
    arcs = cites.select("src", "dst").dropna().distinct()
    own = arcs.where(F.col("src") == F.lit(seed)).select("dst")
    found = arcs.join(own, "dst", "left_semi").where(F.col("src") != F.lit(seed)).select(F.col("src").alias("id")).distinct().join(own.withColumnRenamed("dst", "id"), "id", "left_anti")
    known = papers.groupBy("id").agg(F.max("citations").alias("citations"), F.max("year").alias("year"))
    scored = found.join(known, "id", "left").select("id", paper_score(F.col("citations"), F.col("year"), as_of_year).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(top)


def recommendation_basis(cites: DataFrame, seed: str) -> DataFrame:
    """One row: ``cited_papers`` and ``citing_papers`` of the seed and the ``candidates`` that cite
    something it cites; zeros for an unknown seed."""
    arcs = cites.select("src", "dst").dropna().distinct()
    own = arcs.where(F.col("src") == F.lit(seed)).select("dst")
    found = arcs.join(own, "dst", "left_semi").where(F.col("src") != F.lit(seed)).select(F.col("src").alias("id")).distinct().join(own.withColumnRenamed("dst", "id"), "id", "left_anti")
    counts = arcs.agg(F.count_if(F.col("src") == F.lit(seed)).alias("cited_papers"), F.count_if(F.col("dst") == F.lit(seed)).alias("citing_papers"))
    return counts.join(F.broadcast(found.agg(F.count(F.lit(1)).alias("candidates"))), F.lit(True))


def paper_score(citations: Column, year: Column, as_of_year: int) -> Column:
    """The score of ``recommend``."""
    recent = F.greatest(F.lit(0.0), (F.coalesce(year, F.lit(0)) - (as_of_year - 10)) / 10)
    return 1 + F.least(F.coalesce(citations, F.lit(0)) / 100, F.lit(2.0)) + recent


def bibtex(papers: DataFrame) -> DataFrame:
    """(``key``, ``entry``): one BibTeX entry for each distinct id."""
    one = papers.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("title", F.array_join("authors", " and ").alias("author"), "journal", F.col("year").cast("string").alias("year"), "doi", F.coalesce("citations", F.lit(0)).cast("string").alias("n"))).alias("p"))
    key = F.translate("id", "/.", "__")
    line = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"  {name} = {{"), c, F.lit("}")))
    fields = [line(n, F.col(f"p.{n}")) for n in ("title", "author", "journal", "year", "doi")] + [line("note", F.concat(F.lit("Citations: "), F.col("p.n")))]
    return one.select(key.alias("key"), F.concat(F.lit("@article{"), key, F.lit(",\n"), F.concat_ws(",\n", *fields), F.lit("\n}")).alias("entry"))
