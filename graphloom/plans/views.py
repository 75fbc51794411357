"""Graphs and record tables over the provided tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import doi, once
from graphloom.graphs.model import PropertyGraph
from graphloom.session import cut, read


def trade(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Nations; an edge from a supplier's to a customer's nation whose number of lines is above the
    average of the supplier's nation."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    order = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    pairs = (
        line.join(read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src")), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(order, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dst")), F.col("o_custkey") == F.col("c_custkey"))
    )
    flow = pairs.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    above = flow.withColumn("mean", F.avg("weight").over(Window.partitionBy("src"))).where("weight > mean").drop("mean")
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return PropertyGraph(nations, cut(above.withColumn("capacity", F.col("weight"))), True)


def regions(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions; an edge from one to another with the trade of their nations as weight and capacity."""
    key = lambda a, b: read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias(a), F.col("n_regionkey").alias(b))
    arcs = trade(spark, sf_dir).edges.select(F.col("src").alias("f"), F.col("dst").alias("t"), "weight").join(key("f", "src"), "f").join(key("t", "dst"), "t").where("src <> dst")
    sums = arcs.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return PropertyGraph(read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id")), cut(sums.withColumn("capacity", F.col("weight"))), True)


def copart(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Parts; an edge between parts that share at least two orders, weighted by their number."""
    held = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p")).distinct()
    baskets = held.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    pairs = baskets.select("ps", F.posexplode("ps").alias("i", "src")).select("src", F.explode(F.slice("ps", F.col("i") + 2, F.size("ps"))).alias("dst"))
    often = pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")).where("weight >= 2")
    return PropertyGraph(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand")), cut(often))


def cites(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Works by DOI; an edge from the citing to the cited one."""
    arcs = read(spark, sf_dir, "cites").select(once(doi("src")).alias("src"), "dst").select("src", once(doi("dst")).alias("dst"))
    return PropertyGraph.of(cut(arcs.where("src <> dst").distinct()), True)


def geography(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions, nations, customers, suppliers and orders, each below what it belongs to."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    arcs = read(spark, sf_dir, "nation").select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst"))
    for table, a, b, c, d in (("customer", "n", "c_nationkey", "c", "c_custkey"), ("supplier", "n", "s_nationkey", "s", "s_suppkey"), ("orders", "c", "o_custkey", "o", "o_orderkey")):
        arcs = arcs.unionByName(read(spark, sf_dir, table).select(key(a, b).alias("src"), key(c, d).alias("dst")))
    return PropertyGraph.of(arcs, True)


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct papers by their number, with ``id`` for it."""
    return read(spark, sf_dir, "papers").select(F.col("paper_no").alias("id"), F.col("id").alias("key"), "doi", "title", "journal", "authors", "year", "citations").dropDuplicates(["id"])


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs: errors failed, purchases succeeded, clicks were cancelled."""
    conclusion = F.create_map(*(F.lit(x) for x in ("error", "failure", "purchase", "success", "click", "cancelled")))[F.col("event_type")]
    kind = F.element_at(F.array(F.lit("unit test"), F.lit("build image"), F.lit("deploy")), (F.col("user_id") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", conclusion.alias("conclusion"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), kind.alias("name"), "user_id")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as changes, merged when their last line is shipped."""
    shipped = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("merged_at"))
    return read(spark, sf_dir, "orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.col("o_orderdate").alias("created_at"), "merged_at")


_DOI = r"nullif(regexp_extract(replace(lower({}), '%2f', '/'), '^[\s]*(?:https?://(?:www\.)?(?:dx\.)?doi\.org/|doi:\s*)?(10\.\d[\d.]*/\S*[^\s.,;:])[\s.,;:]*$', 1), '')"

TRADE = """flow AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*)::DOUBLE AS weight FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2),
arcs AS (SELECT src, dst, weight FROM (SELECT *, avg(weight) OVER (PARTITION BY src) AS mean FROM flow) WHERE weight > mean),
v AS (SELECT n_nationkey AS id FROM nation)"""
COPART = """op AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
edges AS (SELECT a.p AS src, b.p AS dst, count(*)::DOUBLE AS weight FROM op a JOIN op b ON a.o = b.o AND a.p < b.p GROUP BY 1, 2 HAVING count(*) >= 2),
arcs AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges),
v AS (SELECT p_partkey AS id FROM part)"""
CITES = f"""arcs AS (SELECT DISTINCT src, dst FROM (SELECT {_DOI.format("src")} AS src, {_DOI.format("dst")} AS dst FROM cites) WHERE src <> dst),
v AS (SELECT src AS id FROM arcs UNION SELECT dst FROM arcs)"""
PAPERS = "p AS (SELECT DISTINCT ON (paper_no) paper_no AS id, id AS key, doi, title, journal, authors, year, citations FROM papers)"
DOI_SQL = _DOI
