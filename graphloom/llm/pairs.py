"""Items that appear together: exact pair counts by external sorting of packed pair codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import strip
from graphloom.operators.skew import skew_join
from graphloom.session import cut

#: Items of a basket that meet in one task; larger baskets are split into pieces of about so many.
PIECE = 2_000
RUN_SCHEMA = pa.schema([("code", pa.int64()), ("n", pa.int64())])


def run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal codes in a sorted stream, with the sum of their counts.

    Only the last run of a batch is held back, so memory doesn't depend on the length of the stream.
    """
    last, total = None, 0
    for batch in batches:
        codes, counts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(codes):
            continue
        starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        keys, sums = codes[starts], np.add.reduceat(counts, starts)
        if last is not None:
            if keys[0] == last:
                sums[0] += total
            else:
                keys, sums = np.concatenate(([last], keys)), np.concatenate(([total], sums))
        last, total = int(keys[-1]), int(sums[-1])
        if len(keys) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(keys[:-1], pa.int64()), pa.array(sums[:-1], pa.int64())], schema=RUN_SCHEMA)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([total], pa.int64())], schema=RUN_SCHEMA)


def dense_ids(items: DataFrame, key: str) -> DataFrame:
    """``items`` with ``id``: 0, 1, … in the order of ``key``, across all partitions.

    One count a partition reaches the driver.
    """
    placed = cut(items.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("__part", F.spark_partition_id()))
    sizes = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offset, offsets = 0, []
    for part in sorted(sizes):
        offsets += [F.lit(part), F.lit(offset)]
        offset += sizes[part]
    if offset >= 2**31:
        raise ValueError("more than 2**31 items: pair codes of 64 bits hold two ids of 31")
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    start = F.create_map(*offsets)[F.col("__part")] if offsets else F.lit(0)
    return placed.withColumn("id", start + within).drop("__part")


def pair_counts(baskets: DataFrame, basket: str, items: str, min_count: int = 1) -> tuple[DataFrame, DataFrame, int]:
    """How many baskets each pair of items shares, in all rows of ``baskets``.

    ``items`` is an array of strings; outer blanks are removed, blank and null items left out, each
    item counts once a basket, a basket whose rows recur counts once, and rows with a null basket
    are left out. Returns the pairs (``code``, ``n``) with ``n`` >= ``min_count``, the dictionary
    (``item``, ``n_item``, ``id``; ids follow code point order) and the number of baskets. Extra
    columns are ignored; an empty table gives no pairs.

    Items become dense ids, a pair one 64-bit code. Each task sorts its codes (Spark's external sort
    spills sorted runs and merges them) and shortens them to run lengths before anything is
    shuffled, so a pair that holds a third of all rows costs one row a task; a second sort merges
    the runs. Items are joined with the dictionary by ``skew_join``, so a hot item is broadcast. A basket of
    more than PIECE items is split, and every two of its pieces meet in a group of their own.
    """
    rows = baskets.where(F.col(basket).isNotNull()).select(F.col(basket).alias("basket"), F.col(items).alias("items"))
    total = rows.select("basket").distinct().count()
    held = rows.select("basket", F.explode("items").alias("item")).select("basket", strip(F.col("item")).alias("item")).where(F.col("item") != "").distinct()
    held = cut(held)
    dictionary = cut(dense_ids(held.groupBy("item").agg(F.count(F.lit(1)).alias("n_item")), "item"))
    numbered = skew_join(held, dictionary.select("item", "id"), ["item"]).select("basket", "id")
    # a piece of a basket holds about PIECE items, chosen by a hash; each pair of pieces meets once
    sizes = held.groupBy("basket").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"))
    dealt = numbered.join(sizes, "basket").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    small = dealt.where("pieces = 1").groupBy("basket").agg(F.collect_list("id").alias("ids")).where(F.size("ids") > 1).select(F.col("ids").alias("one"), F.col("ids").alias("other"), F.lit(True).alias("same"))
    cells = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda k: F.struct(F.least("piece", k).alias("p"), F.greatest("piece", k).alias("q")))
    placed = dealt.where("pieces > 1").select("basket", "id", "piece", F.explode(cells).alias("cell"))
    held_by = lambda k: F.collect_list(F.when(F.col("piece") == F.col(f"cell.{k}"), F.col("id"))).alias({"p": "one", "q": "other"}[k])
    large = placed.groupBy("basket", "cell").agg(held_by("p"), held_by("q")).select("one", "other", (F.col("cell.p") == F.col("cell.q")).alias("same"))
    firsts = small.unionByName(large).select(F.explode("one").alias("x"), "other", "same")
    met = firsts.select("x", F.explode("other").alias("y"), "same").where(~F.col("same") | (F.col("x") < F.col("y")))
    codes = met.select(F.shiftleft(F.least("x", "y"), 32).bitwiseOR(F.greatest("x", "y")).alias("code"), F.lit(1).cast("bigint").alias("n"))
    runs = codes.sortWithinPartitions("code").mapInArrow(run_lengths, "code bigint, n bigint")
    merged = runs.repartition("code").sortWithinPartitions("code").mapInArrow(run_lengths, "code bigint, n bigint")
    return merged.where(F.col("n") >= min_count), dictionary, total


def associations(baskets: DataFrame, basket: str, items: str, min_count: int = 1) -> DataFrame:
    """Pairs (``item_a`` < ``item_b`` by code point) with ``n``, ``n_a``, ``n_b``, ``total``, ``lift``
    and ``odds_ratio``.

    ``lift`` is how many times more often than by chance the pair occurs. ``odds_ratio`` adds one
    half to each cell of the two-by-two table (continuity correction), so it is finite where a cell
    is empty.
    """
    pairs, dictionary, total = pair_counts(baskets, basket, items, min_count)
    named = pairs.select(F.shiftright("code", 32).alias("id_a"), F.col("code").bitwiseAND(F.lit((1 << 32) - 1)).alias("id_b"), "n")
    for side in "ab":
        named = skew_join(named, dictionary.select(F.col("id").alias(f"id_{side}"), F.col("item").alias(f"item_{side}"), F.col("n_item").alias(f"n_{side}")), [f"id_{side}"])
    n, a, b = (F.col(c).cast("double") for c in ("n", "n_a", "n_b"))
    odds = ((n + 0.5) * (total - a - b + n + 0.5)) / ((a - n + 0.5) * (b - n + 0.5))
    return named.select("item_a", "item_b", "n", "n_a", "n_b", F.lit(total).cast("bigint").alias("total"), (n * total / (a * b)).alias("lift"), odds.alias("odds_ratio"))
