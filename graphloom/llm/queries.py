"""Queries of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import leaks, lookalike, merkle, names, packing, pairs, spam
from graphloom.session import read

CONTAINER_TOKENS = 4096
MIN_SHARED = 5
MIN_LIFT = 3
SOLE = "sole author"


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and lists of authors; those of one author have a field of their own, SOLE."""
    works = read(spark, sf_dir, "crossref_works").select(F.col("record_id").alias("id"), F.col("message.title").alias("title"), F.col("message.author").alias("author"))
    titles = works.where(F.size("title") > 0).select("id", F.lit("title").alias("field"), lookalike.joined(F.col("title")).alias("raw"))
    people = works.where(F.size("author") > 0)
    names = F.flatten(F.transform("author", lambda a: F.array(a["given"], a["family"])))
    return titles.unionByName(people.select("id", F.when(F.size("author") > 1, "author").otherwise(SOLE).alias("field"), lookalike.joined(names).alias("raw")))


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = lookalike.consistent_forms(_shown(spark, sf_dir))
    return forms.withColumn("field", F.when(F.col("field") == SOLE, "author").otherwise(F.col("field")))


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every title and author list; parts are set apart by bars."""
    forms = _forms(spark, sf_dir)
    return forms.select(F.col("id").alias("record_id"), "field", F.translate("form", lookalike.SEPARATOR + lookalike.MISSING, "|").alias("form"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose titles or lists of several authors look the same but differ in their characters.

    The words of sole authors are read too, as words that exist, though their records are no case.
    """
    return lookalike.visually_equal(lookalike.consistent_forms(_shown(spark, sf_dir)).where(F.col("field") != SOLE))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = F.struct("id", "doi", "title", "journal", "authors", "year", "citations")
    papers = read(spark, sf_dir, "papers").select(F.lit("papers").alias("tbl"), F.col("paper_no").alias("id"), F.to_json(described, {"ignoreNullFields": "false"}).alias("json"))
    works = read(spark, sf_dir, "raw_works").select(F.lit("raw_works").alias("tbl"), F.col("record_id").alias("id"), F.col("payload").alias("json"))
    return papers.unionByName(works)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of papers and works in another formatting."""
    return merkle.formatting_copies(_records(spark, sf_dir), "message")


def p3_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record of each class with the number of its copies."""
    return merkle.collapsed(_records(spark, sf_dir), "message")


def p3_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among the papers, whose fields are columns, so that SQL can find them too."""
    return merkle.formatting_copies(_records(spark, sf_dir).where("tbl = 'papers'"), "message")


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose form is shared by texts of other characters, a row each, with the size of the class."""
    return lookalike.look_alike_classes(_forms(spark, sf_dir)).select(F.col("record").alias("record_id"), "field", "class", "texts", "records")


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the author index with the entity that they mean."""
    return names.entities(read(spark, sf_dir, "author_index"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows of the author index that mean the same person or organisation."""
    return names.same_entity_pairs(p5_entities(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of authors that share papers more often than by chance."""
    found = pairs.associations(read(spark, sf_dir, "papers"), "paper_no", "authors", MIN_SHARED)
    return found.where(F.col("n") * F.col("total") >= MIN_LIFT * F.col("n_a") * F.col("n_b")).select(F.col("item_a").alias("author_a"), F.col("item_b").alias("author_b"))


def p6_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of authors with its counts, lift and corrected odds ratio."""
    found = pairs.associations(read(spark, sf_dir, "papers"), "paper_no", "authors")
    return found.select(F.col("item_a").alias("author_a"), F.col("item_b").alias("author_b"), "n", "n_a", "n_b", F.round("lift", 6).alias("lift"), F.round("odds_ratio", 6).alias("odds_ratio"))


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document or piece."""
    return packing.pack(read(spark, sf_dir, "documents"), "doc_id", "n_tokens", CONTAINER_TOKENS)


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing.packing_report(p7_pack(spark, sf_dir), CONTAINER_TOKENS)


def p7_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What packing must keep: pieces, tokens, documents split, and the least number of containers."""
    packed = p7_pack(spark, sf_dir)
    split = packed.where("piece > 0").agg(F.countDistinct("doc_id").alias("split"))
    report = packing.packing_report(packed, CONTAINER_TOKENS)
    return report.join(F.broadcast(split), F.lit(True)).select("pieces", "tokens", "split", "least_containers", (F.col("fullest") <= CONTAINER_TOKENS).alias("kept"), (F.col("containers") <= 1.01 * F.col("least_containers") + 1).alias("tight"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that leak test items."""
    return leaks.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of repeated keywords, links or tags."""
    return spam.spam_pages(read(spark, sf_dir, "documents")).select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_forms, p2_classes, p3_found, p3_papers, p3_collapsed, p5_found, p5_entities, p6_found, p6_pairs, p7_pack, p7_report, p7_volume, p8_found, p9_found)}
