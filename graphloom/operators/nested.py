"""Deeply nested JSON records into related flat tables, in one pass.

A depth-first visitor walks each record once and emits a row for every element it meets: the tag of
the table, the element's primary key, the key of its parent, its places, and the element itself as
JSON without the parts that become rows of their own. The emission is written once, partitioned by
tag; each table is then one partition of it with its schema applied. Work per record is linear in
its size and no shuffle is needed, whatever the depth.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import scratch_path

EMITTED = "tag string, pk string, parent_pk string, record_id bigint, pos int, sub_pos int, payload string"
REJECTED = "rejected"


@dataclass(frozen=True)
class Node:
    """A table to cut out of a record.

    ``path`` leads from the parent object to the array. ``depth`` 2 stands for an array of arrays,
    whose inner elements become the rows. ``numbers`` keeps only numbers. A lone element stands for
    an array of one; null, ``{}``, ``[]`` and blank strings give no row but keep their place.
    """

    tag: str
    path: tuple[str, ...]
    children: tuple[Node, ...] = ()
    depth: int = 1
    numbers: bool = False


@dataclass(frozen=True)
class Record:
    """The root table, its children, and the field under which an envelope keeps the record."""

    tag: str
    children: tuple[Node, ...]
    envelope: str | None = None


def _reject_constant(text: str) -> None:
    raise ValueError(text)


def parse_record(text: str | None, envelope: str | None) -> dict | None:
    """The record in ``text``, or None if it doesn't parse as a JSON object."""
    if not text:
        return None
    try:
        value = json.loads(text, parse_constant=_reject_constant)
    except (ValueError, RecursionError):
        return None
    if not isinstance(value, dict):
        return None
    inner = value.get(envelope) if envelope else None
    return inner if isinstance(inner, dict) else value


def _at(value: object, path: tuple[str, ...]) -> object:
    for key in path:
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _elements(value: object) -> list:
    return value if isinstance(value, list) else [value]


def _is_row(value: object, numbers: bool) -> bool:
    if numbers:
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if isinstance(value, str):
        return bool(value.strip())
    return value is not None and value != {} and value != []


def _without(value: object, path: tuple[str, ...]) -> object:
    """``value`` without the field at the end of ``path``; what stands beside it stays, and an object
    that held nothing else goes."""
    if not isinstance(value, dict) or path[0] not in value:
        return value
    rest = {k: v for k, v in value.items() if k != path[0]}
    if len(path) > 1 and (inner := _without(value[path[0]], path[1:])) != {}:
        return value | {path[0]: inner}
    return rest


def _own(value: object, children: tuple[Node, ...]) -> str:
    for child in children:
        value = _without(value, child.path)
    return json.dumps(value, ensure_ascii=False)


def visit(record: object, children: tuple[Node, ...], pk: str, above: int | None) -> Iterator[tuple]:
    """Depth-first (tag, pk, parent_pk, pos, sub_pos, payload) of everything below ``record``."""
    for node in children:
        value = _at(record, node.path)
        if value is None:
            continue
        for i, element in enumerate(_elements(value)):
            if node.depth == 2:
                for j, inner in enumerate(_elements(element)):
                    if _is_row(inner, node.numbers):
                        yield node.tag, f"{pk}/{node.tag}/{i}/{j}", pk, i, j, _own(inner, ())
            elif _is_row(element, node.numbers):
                key = f"{pk}/{node.tag}/{i}"
                yield node.tag, key, pk, i if above is None else above, 0 if above is None else i, _own(element, node.children)
                if isinstance(element, dict):
                    yield from visit(element, node.children, key, i)


def emitter(spec: Record) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The visitor as a function for ``mapInPandas``."""
    columns = [c.split()[0] for c in EMITTED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for rid, text in zip(batch["record_id"], batch["payload"], strict=True):
                rid = None if pd.isna(rid) else int(rid)
                pk = f"{'' if rid is None else rid}"
                record = parse_record(text, spec.envelope)
                if record is None:
                    out.append((REJECTED, pk, None, rid, 0, 0, text))
                    continue
                out.append((spec.tag, pk, None, rid, 0, 0, _own(record, spec.children)))
                out.extend((tag, key, up, rid, pos, sub, payload) for tag, key, up, pos, sub, payload in visit(record, spec.children, pk, None))
            frame = pd.DataFrame(out, columns=columns)
            frame["record_id"] = frame["record_id"].astype("Int64")
            yield frame

    return run


def emit(df: DataFrame, spec: Record, id_col: str, json_col: str) -> DataFrame:
    """All rows of all tables of ``spec``, tagged, in one pass over ``df``.

    Repeated rows of ``df`` are visited each. A null or unparsable text gives one row tagged
    ``rejected``, so nothing is lost; a null id gives keys without a number; other columns of ``df``
    are ignored, whatever their names; an empty ``df`` gives no rows.
    """
    return df.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(json_col).cast("string").alias("payload")).mapInPandas(emitter(spec), EMITTED)


class FlatTables:
    """The written emission; each table reads its own partition only."""

    def __init__(self, df: DataFrame, spec: Record, id_col: str, json_col: str) -> None:
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, spec.tag)
        emit(df, spec, id_col, json_col).write.partitionBy("tag").parquet(self.path)

    def places(self, *tags: str) -> DataFrame:
        """Keys and places of the rows of ``tags``, without their payloads."""
        schema = "pk string, parent_pk string, record_id bigint, pos int, sub_pos int, payload string, tag string"
        return self.spark.read.schema(schema).parquet(self.path).where(F.col("tag").isin(list(tags)))

    def table(self, tag: str, schema: str) -> DataFrame:
        """The rows of one table; ``schema`` names the typed fields taken from the payload.

        An element that isn't an object (a lone string) gives null fields and keeps its text in
        ``value``.
        """
        value = F.from_json("payload", schema)
        plain = F.when(~F.col("payload").startswith("{"), F.from_json(F.concat(F.lit('{"v":'), F.col("payload"), F.lit("}")), "v string")["v"])
        return self.places(tag).select("record_id", "pk", "parent_pk", "pos", "sub_pos", value.alias("f"), plain.alias("value")).select("record_id", "pk", "parent_pk", "pos", "sub_pos", "value", "f.*")


#: A bibliographic work as services deliver it.
WORK = Record(
    "work",
    (
        Node("author", ("author",), (Node("affiliation", ("affiliation",)),)),
        Node("reference", ("reference",)),
        Node("container_title", ("container-title",)),
        Node("date_part", ("published-print", "date-parts"), depth=2, numbers=True),
    ),
    envelope="message",
)

WORK_CHILDREN = ("author", "affiliation", "reference", "container_title", "date_part")
