"""Bibliometric and delivery queries, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import bibliometrics as bib
from graphloom.operators import delivery
from graphloom.operators.structure import component_sizes, components
from graphloom.plans import views
from graphloom.plans.views import CITES, DOI_SQL, PAPERS
from graphloom.functions.text import doi, once
from graphloom.session import read
from graphloom.streaming import deliveries

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


_ROWS = PAPERS + ", o AS (SELECT id, trim(a, E' \\t\\r\\n') AS author, min(pos) AS pos, any_value(c) AS c FROM (SELECT id, unnest(authors) AS a, generate_subscripts(authors, 1) - 1 AS pos, coalesce(citations, 0) AS c FROM p) WHERE trim(a, E' \\t\\r\\n') <> '' GROUP BY 1, 2)"
_AUTHOR = "harkwell"


@query(f"WITH {_ROWS}, r AS (SELECT author, c, row_number() OVER (PARTITION BY author ORDER BY c DESC) AS k FROM o) SELECT author, count(*) AS papers, count(*) FILTER (c >= k) AS h_index, sum(c)::BIGINT AS total_citations, round(avg(c), 6) AS mean_citations FROM r GROUP BY 1")
def h_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """h-index and citations of every author."""
    return bib.h_index(views.papers(spark, sf_dir)).withColumn("mean_citations", F.round("mean_citations", 6))


@query(f"WITH {PAPERS}, h AS (SELECT id, coalesce(citations, 0) AS c, row_number() OVER (ORDER BY coalesce(citations, 0) DESC) AS k FROM p WHERE len(list_filter(authors, lambda a: contains(lower(a), '{_AUTHOR}'))) > 0) SELECT count(*) AS papers_found, count(*) FILTER (c >= k) AS h_index, coalesce(sum(c), 0)::BIGINT AS total_citations, round(coalesce(avg(c), 0), 6) AS mean_citations FROM h")
def author_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact of authors by part of a name."""
    found = bib.author_impact(views.papers(spark, sf_dir), _AUTHOR)
    return found.select("papers_found", "h_index", "total_citations", F.round("mean_citations", 6).alias("mean_citations"))


@query(f"WITH {_ROWS} SELECT a.author AS author_a, b.author AS author_b, count(*) AS n FROM o a JOIN o b ON a.id = b.id AND a.author < b.author GROUP BY 1, 2")
def coauthors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers shared by each pair of authors."""
    return bib.coauthor_pairs(views.papers(spark, sf_dir))


@query(f"WITH {_ROWS} SELECT a.author AS author_a, b.author AS author_b, count(*) AS n FROM o a JOIN o b ON a.id = b.id AND a.pos < b.pos GROUP BY 1, 2")
def coauthors_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, first author of a list first."""
    return bib.coauthor_pairs(views.papers(spark, sf_dir), ordered=True)


@query(f"WITH {_ROWS}, e AS (SELECT a.author AS a, b.author AS b, count(*) AS n FROM o a JOIN o b ON a.id = b.id AND a.author < b.author GROUP BY 1, 2), d AS (SELECT author, (SELECT count(*) FROM e WHERE a = author OR b = author) / ((SELECT count(DISTINCT author) FROM o) - 1)::DOUBLE AS s FROM (SELECT DISTINCT author FROM o)), x AS (SELECT 'pair' AS kind, a, b, n::DOUBLE AS value FROM (SELECT * FROM e ORDER BY n DESC, a, b LIMIT 10) UNION ALL SELECT 'central', author, NULL, s FROM (SELECT * FROM d ORDER BY s DESC, author LIMIT 10)) SELECT kind, (row_number() OVER (PARTITION BY kind ORDER BY value DESC, a, b))::INTEGER AS rank, a, b, round(value, 9) AS value FROM x")
def collaboration_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closest pairs and most central authors."""
    return bib.collaboration_patterns(views.papers(spark, sf_dir)).withColumn("value", F.round("value", 9))


@query(f"WITH RECURSIVE {CITES}, u AS (SELECT src, dst FROM arcs UNION ALL SELECT dst, src FROM arcs), cc(id, c) USING KEY (id) AS (SELECT id, id FROM v UNION SELECT a.dst, min(cc.c) FROM cc JOIN u a ON a.src = cc.id JOIN recurring.cc k ON k.id = a.dst WHERE cc.c < k.c GROUP BY 1) SELECT c AS component, count(*) AS size FROM cc GROUP BY 1")
def citation_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of works, for graphs without authors."""
    return component_sizes(components(views.cites(spark, sf_dir)))


@query(f"WITH {PAPERS} SELECT year, count(*) AS publications, sum(coalesce(citations, 0))::BIGINT AS citations, round(avg(coalesce(citations, 0)), 6) AS mean_citations FROM p WHERE year IS NOT NULL GROUP BY 1")
def publications_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publications and citations a year."""
    return bib.yearly(views.papers(spark, sf_dir)).withColumn("mean_citations", F.round("mean_citations", 6))


@query(f"WITH {PAPERS}, y AS (SELECT year, count(*) AS n FROM p WHERE year IS NOT NULL GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY year) AS u, row_number() OVER (ORDER BY year DESC) AS d FROM y), s AS (SELECT count(*) AS years, avg(n) FILTER (u <= 5) AS f, avg(n) FILTER (d <= 5) AS l FROM r) SELECT CASE WHEN years < 2 THEN 'no_temporal_data' WHEN l > 1.2 * f THEN 'increasing' WHEN l < 0.8 * f THEN 'decreasing' ELSE 'stable' END AS trend, years, round(f, 6) AS first_mean, round(l, 6) AS last_mean FROM s")
def research_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend of publications."""
    return bib.research_trend(views.papers(spark, sf_dir)).select("trend", "years", F.round("first_mean", 6).alias("first_mean"), F.round("last_mean", 6).alias("last_mean"))


_SEED = "(SELECT src FROM arcs GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 1)"


@query(f"WITH {CITES}, own AS (SELECT dst FROM arcs WHERE src = {_SEED}), f AS (SELECT DISTINCT src AS id FROM arcs WHERE dst IN (SELECT dst FROM own) AND src <> {_SEED} AND src NOT IN (SELECT dst FROM own)), k AS (SELECT {DOI_SQL.format('doi')} AS id, max(citations) AS c, max(year) AS y FROM papers GROUP BY 1), s AS (SELECT f.id, 1 + least(coalesce(c, 0) / 100::DOUBLE, 2) + greatest(0, (coalesce(y, 0) - 2014) / 10::DOUBLE) AS score FROM f LEFT JOIN k ON f.id = k.id) SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 10")
def recommend_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten works to read after the one that cites most."""
    g = views.cites(spark, sf_dir)
    seed = g.edges.groupBy("src").count().orderBy(F.desc("count"), "src").first()[0]
    papers = read(spark, sf_dir, "papers").select(once(doi("doi")).alias("id"), "citations", "year")
    return bib.recommend(g.edges, papers, seed, 2024).withColumn("score", F.round("score", 6))


@query("WITH q AS (SELECT id, min({'title': title, 'author': array_to_string(authors, ' and '), 'journal': journal, 'year': year::VARCHAR, 'doi': doi, 'n': coalesce(citations, 0)::VARCHAR}) AS p FROM papers WHERE id IS NOT NULL GROUP BY 1) SELECT translate(id, '/.', '__') AS key, count(*) AS n FROM q GROUP BY 1")
def export_bibtex_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the BibTeX entries of all papers."""
    return bib.bibtex(read(spark, sf_dir, "papers")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


_BIB = " || ".join(f"CASE WHEN {c} <> '' THEN ',\n  {n} = {{{{' || {c} || '}}}}' ELSE '' END" for n, c in (("title", "title"), ("author", "author"), ("journal", "journal"), ("year", "year"), ("doi", "doi")))


@query(f"WITH q AS (SELECT id, title, array_to_string(authors, ' and ') AS author, journal, year::VARCHAR AS year, doi, coalesce(citations, 0)::VARCHAR AS n FROM papers WHERE id IS NOT NULL), p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY title NULLS FIRST, author NULLS FIRST, journal NULLS FIRST, year NULLS FIRST, doi NULLS FIRST, n) AS k FROM q) SELECT translate(id, '/.', '__') AS key, '@article{{' || translate(id, '/.', '__') || {_BIB.format()} || ',\n  note = {{Citations: ' || n || '}}\n}}' AS entry FROM p WHERE k = 1")
def export_bibtex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BibTeX entries of all papers."""
    return bib.bibtex(read(spark, sf_dir, "papers"))


# delivery ----------------------------------------------------------------------------------------

_RUNS = "r AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'success' WHEN 'click' THEN 'cancelled' END AS c, ts AS t, ['unit test', 'build image', 'deploy'][user_id % 3 + 1] AS name, user_id FROM events)"
_FREQ = "SELECT count(*) FILTER (c = 'success' AND t >= '2024-01-01' AND t < '2025-01-01') / 366.0::DOUBLE AS per_day FROM r"
_LEAD = "SELECT avg(epoch_us(m) - epoch_us(o_orderdate)) / 3.6e9::DOUBLE AS hours FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS m FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"
_RATE = "SELECT 100.0::DOUBLE * count(*) FILTER (c IN ('failure', 'cancelled')) / count(*) AS percent FROM r"
_MTTR = "w AS (SELECT *, last_value(CASE WHEN c = 'failure' THEN t END IGNORE NULLS) OVER (ORDER BY t, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f, last_value(CASE WHEN c = 'success' THEN t END IGNORE NULLS) OVER (ORDER BY t, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM r WHERE c IN ('failure', 'success')), d AS (SELECT (epoch_us(t) - epoch_us(f)) / 6e7::DOUBLE AS minutes FROM w WHERE c = 'success' AND f IS NOT NULL AND (s IS NULL OR f >= s) AND t > f)"


def _frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.deployment_frequency(views.runs(spark, sf_dir).where("conclusion = 'success'"), "created_at", "2024-01-01", "2025-01-01")


@query(f"WITH {_RUNS} SELECT round(per_day, 6) AS per_day FROM ({_FREQ})")
def deployment_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successful runs a day over the year."""
    return _frequency(spark, sf_dir).select(F.round("per_day", 6).alias("per_day"))


@query(f"SELECT round(hours, 4) AS hours FROM ({_LEAD})")
def lead_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean hours from order to last shipment."""
    return delivery.lead_time(views.changes(spark, sf_dir), last=None).select(F.round("hours", 4).alias("hours"))


@query(f"WITH {_RUNS} SELECT round(percent, 6) AS percent FROM ({_RATE})")
def change_failure_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of runs that failed or were cancelled."""
    return delivery.change_failure_rate(views.runs(spark, sf_dir), last=None).select(F.round("percent", 6).alias("percent"))


@query(f"WITH {_RUNS}, {_MTTR} SELECT round(coalesce(avg(minutes), 30.0), 4) AS minutes FROM d")
def mean_time_to_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean minutes from a failure to the next success."""
    return delivery.mean_time_to_restore(views.runs(spark, sf_dir)).select(F.round("minutes", 4).alias("minutes"))


@query(f"WITH {_RUNS}, {_MTTR}, m AS (SELECT *, (SELECT coalesce(avg(minutes), 30.0) FROM d) AS minutes FROM ({_FREQ}) CROSS JOIN ({_LEAD}) CROSS JOIN ({_RATE})) SELECT round(per_day, 6) AS per_day, round(hours, 4) AS hours, round(percent, 6) AS percent, round(minutes, 4) AS minutes, CASE WHEN per_day >= 1 AND hours <= 24 AND percent <= 15 AND minutes <= 60 THEN 'Elite' WHEN per_day >= 0.14 AND hours <= 168 AND percent <= 30 AND minutes <= 1440 THEN 'High' WHEN per_day >= 0.03 AND hours <= 720 AND percent <= 45 AND minutes <= 10080 THEN 'Medium' ELSE 'Low' END AS level FROM m")
def dora_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four metrics and the level."""
    runs = views.runs(spark, sf_dir)
    full = delivery.report(_frequency(spark, sf_dir), delivery.lead_time(views.changes(spark, sf_dir), last=None), delivery.change_failure_rate(runs, last=None), delivery.mean_time_to_restore(runs))
    return full.select(F.round("per_day", 6).alias("per_day"), F.round("hours", 4).alias("hours"), F.round("percent", 6).alias("percent"), F.round("minutes", 4).alias("minutes"), "level")


@query(f"WITH {_RUNS} SELECT count(*) AS runs, count(*) FILTER (c = 'failure') AS failures, printf('%.1f%%', 100.0::DOUBLE * count(*) FILTER (c = 'failure') / count(*)) AS failure_rate FROM r")
def workflow_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, failures and their rate."""
    return delivery.workflow_status(views.runs(spark, sf_dir), last=None)


@query(f"WITH {_RUNS} SELECT CASE WHEN contains(name, 'test') THEN 'assertion' WHEN contains(name, 'build') THEN 'import' ELSE 'unknown' END AS kind, count(*) AS n FROM r WHERE c = 'failure' GROUP BY 1")
def workflow_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed jobs by kind."""
    return delivery.failure_kinds(views.runs(spark, sf_dir))


@query("SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a day and type: the batch form of the streaming counts."""
    events = read(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return deliveries.tumbling_counts(events).select(F.to_date("start").alias("day"), "event_type", "n")


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS n FROM s GROUP BY user_id, k")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users: the batch form of the streaming windows."""
    found = deliveries.sessions(read(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp")))
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT date_trunc('hour', ts) + INTERVAL 15 MINUTE * q AS start, count(*) AS n FROM (SELECT ts, unnest(generate_series(-3, 3)) AS q FROM events) WHERE ts >= date_trunc('hour', ts) + INTERVAL 15 MINUTE * q AND ts < date_trunc('hour', ts) + INTERVAL 15 MINUTE * q + INTERVAL 1 HOUR GROUP BY 1")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of every hour that begins at a quarter: the batch form of the sliding windows."""
    found = deliveries.sliding_counts(read(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp")))
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(f"WITH {_RUNS} SELECT event_id, c AS conclusion, t AS created_at FROM r ORDER BY t DESC, event_id LIMIT 5")
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five latest runs."""
    return delivery.recent_runs(views.runs(spark, sf_dir), "event_id").select("event_id", "conclusion", "created_at")


@query(f"WITH {_RUNS}, o AS (SELECT user_id, c, name, t FROM r WHERE user_id = (SELECT min(user_id) FROM events)) SELECT count(*) AS total_jobs, count(*) FILTER (c = 'failure') AS failed_jobs, CASE WHEN count(*) FILTER (c = 'failure') > 0 THEN 'failure' WHEN count(*) FILTER (c = 'cancelled') > 0 THEN 'cancelled' WHEN count(c) > 0 THEN 'success' END AS conclusion, min(t) AS created_at, max(t) AS updated_at FROM o")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of one run: the events of the first user as its jobs."""
    runs = views.runs(spark, sf_dir)
    return delivery.run_status(runs, runs.agg(F.min("user_id")).first()[0], "user_id").withColumn("failed_jobs", F.size("failed_jobs").cast("bigint"))


@query(f"WITH {_RUNS}, l AS (SELECT * FROM r ORDER BY t DESC, c NULLS FIRST LIMIT 20) SELECT 100.0::DOUBLE * count(*) FILTER (c IN ('failure', 'cancelled')) / count(*) AS percent FROM l")
def change_failure_rate_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the last twenty runs that failed or were cancelled."""
    return delivery.change_failure_rate(views.runs(spark, sf_dir))


@query("SELECT round(avg(s) / 3600, 4) AS hours FROM (SELECT (epoch_us(m) - epoch_us(o_orderdate)) / 1e6::DOUBLE AS s FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS m FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey ORDER BY m DESC, o_orderdate DESC LIMIT 20)")
def lead_time_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean hours to the last shipment of the twenty orders shipped last."""
    return delivery.lead_time(views.changes(spark, sf_dir)).select(F.round("hours", 4).alias("hours"))
