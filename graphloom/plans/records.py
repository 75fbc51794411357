"""Queries over nested records and their references (problems 1 and 4), with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import DOI_PATTERN, doi, doi_registrant, doi_suffix, once
from graphloom.operators.nested import WORK, WORK_CHILDREN, FlatTables
from graphloom.operators.orphans import orphan_references, orphan_report
from graphloom.session import read
from graphloom.sources.graph_io import publication_year


def _flat(spark: SparkSession, sf_dir: str) -> FlatTables:
    return FlatTables(read(spark, sf_dir, "raw_works"), WORK, "record_id", "payload")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every child row of every payload that parses, with its place."""
    return _flat(spark, sf_dir).places(*WORK_CHILDREN).select("record_id", F.col("tag").alias("child"), "pos", "sub_pos")


def p1_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root table."""
    return _flat(spark, sf_dir).table("work", "DOI string, type string, `is-referenced-by-count` bigint").select("record_id", "DOI", "type", F.col("is-referenced-by-count").alias("citations"))


def p1_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors, tied to their work."""
    return _flat(spark, sf_dir).table("author", "given string, family string, sequence string").select("record_id", "pos", "given", "family", "sequence")


def p1_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited works, tied to the citing one."""
    return _flat(spark, sf_dir).table("reference", "key string, DOI string, year string").select("record_id", "pos", "key", F.col("DOI").alias("cited_doi"), "year")


def p1_affiliations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affiliations, tied to their author."""
    return _flat(spark, sf_dir).table("affiliation", "name string").select("record_id", "parent_pk", "pos", "sub_pos", F.coalesce("name", "value").alias("name"))


def p1_container_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal titles, tied to their work."""
    return _flat(spark, sf_dir).table("container_title", "name string").select("record_id", "parent_pk", "pos", "value")


def p1_date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the print dates, tied to their work."""
    return _flat(spark, sf_dir).table("date_part", "name string").select("record_id", "parent_pk", "pos", "sub_pos", F.col("value").cast("bigint").alias("value"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cited DOI of both tables, with a composite key of registrant and suffix."""
    works = read(spark, sf_dir, "crossref_works").select("record_id", "fetched_at", F.col("message.reference.DOI").alias("cited"))
    refs = works.select(F.lit("crossref_works").alias("tbl"), F.col("record_id").alias("row_id"), F.posexplode(F.transform("cited", doi)).alias("pos", "doi"), F.col("fetched_at").alias("time"))
    cites = read(spark, sf_dir, "cites").select(F.lit("cites").alias("tbl"), F.col("cite_id").alias("row_id"), F.lit(0).alias("pos"), once(doi("dst")).alias("doi"), F.col("seen_at").alias("time"))
    both = refs.select("tbl", "row_id", "pos", "doi", "time").unionByName(cites)
    return both.select("tbl", "row_id", "pos", "time", doi_registrant(F.col("doi")).alias("registrant"), doi_suffix(F.col("doi")).alias("suffix"))


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From when each DOI is held and from when it is withdrawn."""
    nothing = F.lit(None).cast("timestamp_ntz")
    held = read(spark, sf_dir, "crossref_works").select(once(doi("message.DOI")).alias("doi"), F.col("fetched_at").alias("held"), nothing.alias("gone"))
    seed = read(spark, sf_dir, "seed_works").select(once(doi("doi")).alias("doi"), F.col("added_at").alias("held"), nothing.alias("gone"))
    gone = read(spark, sf_dir, "withdrawals").select(once(doi("doi")).alias("doi"), nothing.alias("held"), F.col("withdrawn_at").alias("gone"))
    every = held.unionByName(seed).unionByName(gone).where(F.col("doi").isNotNull())
    return every.select(doi_registrant(F.col("doi")).alias("registrant"), doi_suffix(F.col("doi")).alias("suffix"), "held", "gone")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each citation of a work that isn't held, is withdrawn or comes later, once."""
    orphans = orphan_references(citations(spark, sf_dir), holdings(spark, sf_dir), ["registrant", "suffix"], "time", "held", "gone", match="simple")
    found = orphans.select("tbl", "row_id", "pos", "reason", F.date_format("time", "yyyy-MM").alias("period"))
    return found.dropDuplicates(["tbl", "row_id", "pos"])  # whole rows recur; only what dangles is shuffled for that


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dangling citations per table, month and reason."""
    return orphan_report(p4_found(spark, sf_dir))


def p4_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited works by DOI and year, either of which may be null, that no held work matches on what is
    given."""
    works = read(spark, sf_dir, "crossref_works").select("record_id", "fetched_at", F.transform("message.reference", lambda r: F.named_struct(F.lit("doi"), doi(r["DOI"]), F.lit("year"), r["year"].try_cast("int"))).alias("cited"), once(doi("message.DOI")).alias("own"), publication_year(F.col("message")).alias("own_year"))
    refs = works.select("record_id", F.posexplode("cited").alias("pos", "c"), F.col("fetched_at").alias("time")).select("record_id", "pos", "c.doi", "c.year", "time")
    held = works.select(F.col("own").alias("doi"), F.col("own_year").alias("year"), F.col("fetched_at").alias("held"), F.lit(None).cast("timestamp_ntz").alias("gone"))
    return orphan_references(refs, held, ["doi", "year"], "time", "held", "gone", match="partial").select("record_id", "pos", "doi", "year", "reason")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_works, p1_authors, p1_references, p1_affiliations, p1_container_titles, p1_date_parts, p4_found, p4_report, p4_partial)}

_WORKS = """
WITH parsed AS (SELECT record_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM raw_works),
m AS (SELECT record_id, CASE WHEN json_type(j, '$.message') = 'OBJECT' THEN j->'$.message' ELSE j END AS w FROM parsed WHERE json_type(j) = 'OBJECT')"""


def _each(of: str, value: str, keep: str, source: str = "m", up: str = "") -> str:
    """SQL for the elements of an array or of a lone element standing for one."""
    items = f"CASE json_type({value}) WHEN 'ARRAY' THEN from_json({value}, '[\"JSON\"]') WHEN 'NULL' THEN [] ELSE [{value}] END"
    return f"{of} AS (SELECT * FROM (SELECT record_id{up}, unnest({items}) AS e, generate_subscripts({items}, 1) - 1 AS i FROM {source} WHERE {value} IS NOT NULL) WHERE {keep})"


_ROW = "json_type(e) NOT IN ('NULL') AND e::VARCHAR NOT IN ('{}', '[]') AND NOT (json_type(e) = 'VARCHAR' AND trim(e->>'$', ' \t\n\r') = '')"

_CHILDREN = (
    _WORKS
    + ",\n"
    + ",\n".join(
        [
            _each("a", "(w->'$.author')", _ROW),
            _each("f", "(a_e->'$.affiliation')", _ROW, "(SELECT record_id, i AS a_i, e AS a_e FROM a WHERE json_type(e) = 'OBJECT')", ", a_i"),
            _each("r", "(w->'$.reference')", _ROW),
            _each("t", "(w->'$.\"container-title\"')", _ROW),
            _each("d0", "(w->'$.\"published-print\".\"date-parts\"')", "json_type(e) <> 'NULL'"),
            _each("d", "d_e", "json_type(e) IN ('UBIGINT', 'BIGINT', 'DOUBLE')", "(SELECT record_id, i AS d_i, e AS d_e FROM d0)", ", d_i"),
        ]
    )
)

_DOI = f"nullif(regexp_extract(replace(lower({{0}}), '%2f', '/'), '{DOI_PATTERN.replace(chr(92) + 'u00a0', '')}', 1), '')"

_P4 = f"""
WITH refs AS (
  SELECT DISTINCT 'crossref_works' AS tbl, record_id AS row_id, (generate_subscripts(message."reference", 1) - 1)::INTEGER AS pos, unnest(message."reference").DOI AS cited, fetched_at AS t FROM crossref_works
  UNION ALL SELECT DISTINCT 'cites', cite_id, 0, dst, seen_at FROM cites),
keyed AS (SELECT *, {_DOI.format("cited")} AS doi FROM refs),
held AS (SELECT doi, min(t) AS t FROM (SELECT {_DOI.format("message.DOI")} AS doi, fetched_at AS t FROM crossref_works UNION ALL SELECT {_DOI.format("doi")}, added_at FROM seed_works) GROUP BY 1),
gone AS (SELECT {_DOI.format("doi")} AS doi, min(withdrawn_at) AS t FROM withdrawals GROUP BY 1),
p4 AS (SELECT tbl, row_id, pos, CASE WHEN held.t IS NULL THEN 'missing' WHEN gone.t <= keyed.t THEN 'deleted' WHEN held.t > keyed.t THEN 'late' END AS reason, strftime(keyed.t, '%Y-%m') AS period
  FROM keyed LEFT JOIN held USING (doi) LEFT JOIN gone USING (doi) WHERE keyed.doi IS NOT NULL)
"""

ORACLE: dict[str, str] = {
    "p1_found": _CHILDREN
    + """
SELECT record_id, 'author' AS child, i::INTEGER AS pos, 0::INTEGER AS sub_pos FROM a
UNION ALL SELECT record_id, 'affiliation', a_i::INTEGER, i::INTEGER FROM f
UNION ALL SELECT record_id, 'reference', i::INTEGER, 0 FROM r
UNION ALL SELECT record_id, 'container_title', i::INTEGER, 0 FROM t
UNION ALL SELECT record_id, 'date_part', d_i::INTEGER, i::INTEGER FROM d""",
    "p1_works": _WORKS + " SELECT record_id, w->>'$.DOI' AS \"DOI\", w->>'$.type' AS type, (w->>'$.\"is-referenced-by-count\"')::BIGINT AS citations FROM m",
    "p1_authors": _CHILDREN + " SELECT record_id, i::INTEGER AS pos, e->>'$.given' AS given, e->>'$.family' AS family, e->>'$.sequence' AS sequence FROM a",
    "p1_references": _CHILDREN + " SELECT record_id, i::INTEGER AS pos, e->>'$.key' AS key, e->>'$.DOI' AS cited_doi, e->>'$.year' AS year FROM r",
    "p1_affiliations": _CHILDREN + " SELECT record_id, record_id || '/author/' || a_i AS parent_pk, a_i::INTEGER AS pos, i::INTEGER AS sub_pos, CASE json_type(e) WHEN 'VARCHAR' THEN e->>'$' ELSE e->>'$.name' END AS name FROM f",
    "p1_container_titles": _CHILDREN + " SELECT record_id, record_id::VARCHAR AS parent_pk, i::INTEGER AS pos, e->>'$' AS value FROM t",
    "p1_date_parts": _CHILDREN + " SELECT record_id, record_id::VARCHAR AS parent_pk, d_i::INTEGER AS pos, i::INTEGER AS sub_pos, (e->>'$')::BIGINT AS value FROM d",
    "p4_partial": f"""
WITH c AS (SELECT record_id, (generate_subscripts(message."reference", 1) - 1)::INTEGER AS pos, unnest(message."reference") AS r, fetched_at AS t FROM crossref_works),
k AS (SELECT record_id, pos, {_DOI.format("r.DOI")} AS doi, try_cast(r.year AS INTEGER) AS year, t FROM c),
h AS (SELECT {_DOI.format("message.DOI")} AS doi, coalesce(message."published-print"."date-parts"[1][1], message."published-online"."date-parts"[1][1]) AS year, fetched_at AS t FROM crossref_works),
m AS (SELECT k.record_id, k.pos, k.doi, k.year, k.t, CASE WHEN k.doi IS NOT NULL AND k.year IS NOT NULL THEN (SELECT min(t) FROM h WHERE h.doi = k.doi AND h.year = k.year) WHEN k.doi IS NOT NULL THEN (SELECT min(t) FROM h WHERE h.doi = k.doi) ELSE (SELECT min(t) FROM h WHERE h.year = k.year) END AS held FROM k WHERE k.doi IS NOT NULL OR k.year IS NOT NULL)
SELECT record_id, pos, doi, year, CASE WHEN held IS NULL THEN 'missing' ELSE 'late' END AS reason FROM m WHERE held IS NULL OR held > t""",
    "p4_found": _P4 + "SELECT * FROM p4 WHERE reason IS NOT NULL",
    "p4_report": _P4 + "SELECT tbl, period, reason, count(*) AS n FROM p4 WHERE reason IS NOT NULL GROUP BY ALL",
}
