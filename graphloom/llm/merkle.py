"""Copies hidden by formatting: bottom-up digests of nested records, confirmed structurally."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import DOI_PATTERN
from graphloom.operators.nested import parse_record
from graphloom.operators.skew import skew_join
from graphloom.session import cut, scratch_path

_DOI = re.compile(DOI_PATTERN)
#: Marks and blanks; symbols ("C++", "p < 0.05") mean something and stay.
_FORMATTING = regex.compile(r"[\p{P}\p{Z}\p{Cf}\s]+")
DIGESTS = "tbl string, id bigint, digest binary, form string"


def leaf(value: object) -> object:
    """A leaf without formatting: DOIs in one form, other text without case, blanks and marks."""
    if isinstance(value, str):
        text = value.lower().replace("%2f", "/")
        if "10." in text and (m := _DOI.match(text)):
            return m.group(1)
        return _FORMATTING.sub("", value.casefold())
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value


def normal(value: object) -> object:
    """``value`` with normalised leaves; objects, whose fields have no order, in the order of names."""
    if isinstance(value, dict):
        return {k: normal(value[k]) for k in sorted(value)}
    if isinstance(value, list):
        return [normal(x) for x in value]
    return leaf(value)


def digest(value: object) -> bytes:
    """Digest of a normalised value from those of its children.

    At an object the children are sorted by name and digest, as its fields have no order; at an
    array their order counts.
    """
    if isinstance(value, dict):
        parts = [b"o", *(hashlib.blake2b(k.encode(), digest_size=16).digest() + digest(v) for k, v in value.items())]
        parts[1:] = sorted(parts[1:])
    elif isinstance(value, list):
        parts = [b"a", *map(digest, value)]
    else:
        parts = [b"s" if isinstance(value, str) else b"v", str(value).encode("utf-8", "surrogatepass")]
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def _digester(envelope: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for tbl, rid, text in zip(batch["tbl"], batch["id"], batch["json"], strict=True):
                if (record := parse_record(text, envelope)) is not None:
                    value = normal(record)
                    out.append((tbl, rid, digest(value), json.dumps(value, ensure_ascii=True)))
            yield pd.DataFrame(out, columns=["tbl", "id", "digest", "form"])

    return run


def record_digests(df: DataFrame, envelope: str | None = None) -> DataFrame:
    """(``tbl``, ``id``, ``digest``, ``form``) of records given as (``tbl``, ``id``, ``json``).

    Texts that don't parse as an object give no row.
    """
    return df.select("tbl", F.col("id").cast("bigint").alias("id"), "json").where(F.col("id").isNotNull()).mapInPandas(_digester(envelope), DIGESTS)


def formatting_copies(records: DataFrame, envelope: str | None = None) -> DataFrame:
    """(``tbl``, ``keep_id``, ``copy_id``): every id whose record equals that of a smaller id but for
    formatting; ``keep_id`` is the smallest id of its class.

    ``records`` holds (``tbl``, ``id``, ``json``); classes never span two ``tbl``. Rows with a null
    id and texts that don't parse are no case; a row repeated with its own id is no copy; null and
    a missing field differ, as do an empty text and null. Empty tables give no rows.

    Digests and canonical forms are written once; grouping reads only the digests and combines on
    the map side, so a class of a third of all rows costs one row a task, and its members meet its
    smallest id by broadcast. Members are then compared with the canonical form of their smallest
    id; what differs in spite of an equal digest is grouped anew by the form itself.
    """
    spark = records.sparkSession
    path = scratch_path(spark, "digests")
    record_digests(records, envelope).write.parquet(path)
    rows = spark.read.schema(DIGESTS).parquet(path)
    key = ["tbl", "digest"]
    classes = rows.groupBy(*key).agg(F.min("id").alias("keep_id"), F.max("id").alias("last")).where("keep_id < last").drop("last")
    members = cut(skew_join(rows, classes, key))
    kept = members.where("id = keep_id").groupBy("tbl", "keep_id").agg(F.first("form").alias("kept_form"))
    compared = skew_join(members, kept, ["tbl", "keep_id"])
    same = compared.where("form = kept_form").select("tbl", "keep_id", "id")
    rest = compared.where("form <> kept_form").select("tbl", "digest", "form", "id")
    regrouped = rest.join(rest.groupBy("tbl", "digest", "form").agg(F.min("id").alias("keep_id")), ["tbl", "digest", "form"])
    return same.unionByName(regrouped.select("tbl", "keep_id", "id")).where("keep_id <> id").select("tbl", "keep_id", F.col("id").alias("copy_id")).distinct()


def collapsed(records: DataFrame, envelope: str | None = None) -> DataFrame:
    """One row for each distinct record: (``tbl``, ``keep_id``, ``n_copies``), copies besides it counted.

    Records that don't parse are kept, each as its own.
    """
    ids = records.where(F.col("id").isNotNull()).select("tbl", F.col("id").cast("bigint").alias("id")).distinct()
    copies = formatting_copies(records, envelope)
    kept = ids.join(copies.select("tbl", F.col("copy_id").alias("id")), ["tbl", "id"], "left_anti")
    counts = copies.groupBy("tbl", F.col("keep_id").alias("id")).agg(F.count(F.lit(1)).alias("n_copies"))
    return kept.join(counts, ["tbl", "id"], "left").select("tbl", F.col("id").alias("keep_id"), F.coalesce("n_copies", F.lit(0)).cast("bigint").alias("n_copies"))
