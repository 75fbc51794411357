"""Exact radius joins of texts under an edit metric, in the cells of pivots."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.skew import hot_keys, skew_join
from graphloom.session import cut_step as cut
from graphloom.session import release

#: Blocks of up to so many names have one pivot, larger ones about PIVOTS times the square root of
#: their names.
ONE_CELL = 2_000
PIVOTS = 2
#: Further names of a block whose distances filter what meets in a cell.
FILTERS = 4
#: Bits of a pivot's place in its block's list, and of each packed distance to a filter, which is cut there.
#: So are distances to pivots, at _FAR: what is left is still a metric.
_PLACE_BITS, _E_BITS, _FAR = 20, 12, 2_047
_LEAST = "spark.sql.adaptive.coalescePartitions.minPartitionSize"


@contextmanager
def spread(spark: SparkSession) -> Iterator[None]:
    """Let small shuffle partitions be as many as there are cores: their work is large, not their bytes."""
    before = spark.conf.get(_LEAST)
    spark.conf.set(_LEAST, "64k")
    try:
        yield
    finally:
        spark.conf.set(_LEAST, before)


def _pivots(points: DataFrame, hot: list[tuple]) -> DataFrame:
    """(``block``, ``pivots``, ``filters``): names of each block chosen by hashes, at least one pivot."""
    spread_ = F.pmod(F.xxhash64("name"), F.lit(1 << 30)) / (1 << 30)
    by = lambda k: F.struct(F.xxhash64("name", F.lit(k)), "name")
    chosen = [F.min_by("name", by(k)) for k in range(FILTERS + 1)]
    sizes = points.groupBy("block").agg(F.count(F.lit(1)).alias("n"), chosen[0].alias("first"), F.array(*chosen[1:]).alias("filters"))
    share = F.when(F.col("n") > ONE_CELL, PIVOTS / F.sqrt("n")).otherwise(0.0)
    kept = skew_join(points, sizes, ["block"], keys=hot).where((spread_ < share) | (F.col("name") == F.col("first")))
    return kept.groupBy("block").agg(F.collect_list("name").alias("pivots"), F.first("filters").alias("filters"))


def _placed(names: DataFrame, pivots: DataFrame, hot: list[tuple]) -> DataFrame:
    """Names with ``home``, the nearest pivot of the block and its distance ``d``, ``reach``, the pivots
    a name moves to (distance and place in the block's list, packed), and ``e``, the distances to the
    filters and to the empty name, packed; distances to other pivots are never stored."""
    near = F.transform("pivots", lambda p, i: F.shiftleft(F.least(F.levenshtein("name", p), F.lit(_FAR)), _PLACE_BITS) + i)
    filters = [F.length("name"), *(F.levenshtein("name", F.col("filters")[k]) for k in range(FILTERS))]
    packed = reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(F.least(f, F.lit((1 << _E_BITS) - 1)).cast("bigint"), _E_BITS * k) for k, f in enumerate(filters)])
    told = skew_join(names, pivots, ["block"], keys=hot).select(*names.columns, F.explode(F.array(near)).alias("near"), packed.alias("e"))
    most = lambda home: F.shiftright(home, _PLACE_BITS) + F.col("radius") + F.when(F.col("asks"), 0).otherwise(-1)
    reach = F.flatten(F.transform(F.array(F.array_min("near")), lambda home: F.filter("near", lambda q: F.shiftright(q, _PLACE_BITS) <= most(home))))
    home = F.array_min("near")
    return told.select(*names.columns, "e", _pivot(home).alias("home"), F.shiftright(home, _PLACE_BITS).alias("d"), reach.alias("reach"))


def _pivot(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))


def _cell(pivot: Column, ring: Column, asked: int | Column) -> Column:
    """A number for the ring of a pivot, where all names sit (0) or those that ask (1)."""
    return F.shiftleft(pivot.cast("bigint"), 32) + ring * 2 + asked


def _letters(name: str) -> Column:
    """A negative number for the letters of a name in any order; cells have others."""
    return F.xxhash64(F.array_sort(F.split(name, ""))).bitwiseOR(F.lit(-(1 << 63)))


def _apart(a: str, b: str, most: Column) -> Column:
    """Whether no packed distance tells that names are more than ``most`` edits apart."""
    part = lambda c, k: F.shiftright(c, _E_BITS * k).bitwiseAND(F.lit((1 << _E_BITS) - 1))
    return reduce(lambda x, y: x & y, [F.abs(part(a, k) - part(b, k)) <= most for k in range(FILTERS + 1)])


def one_exchange(a: Column, b: Column) -> Column:
    """Whether ``b`` is ``a`` with two letters next to each other exchanged."""
    return F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: _exchanged(a, i) == b)


def _exchanged(a: Column, i: Column) -> Column:
    return F.concat(F.left(a, i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2))


def radius_pairs(points: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(``block``, ``a``, ``b``, ``d``): every name ``a`` of ``queries`` and ``b`` of ``points`` of one
    block within its ``radius`` of edits, a name and itself included, once.

    Both sides are (``block``, ``name``, ``radius``), repeated rows allowed; the radius is one of the
    block, up to 2. An exchange of neighbouring letters counts as one edit.

    The method is metric-space partitioning under the Levenshtein metric. Every block has pivots; a
    name sits at its nearest pivot, its home. Of two names within the radius the one x farther from
    its home (if equal, the query) moves to the home p of the other, y: d(x, p) <= d(y, p) + radius <=
    d(x, home of x) + radius by the triangle inequality, so replication to the pivots that near loses
    no pair (names that don't ask move only where they are strictly farther, so one edit less).
    Inside a cell names meet only on the rings d(y, p) from d(x, p) - radius to d(x, home of x), an
    equi-join, and if the distances to FILTERS further names and the lengths agree as well; the
    distance itself decides. An exchange is two Levenshtein edits: at radius 1 names of the same
    letters meet too, at radius 2 they lie within it.

    All joins are equi-joins over distinct names: one on the block, one on block and ring. Beyond
    ONE_CELL names in a block, distances to pivots grow as n ** 1.5; of them only those within reach
    are written. Pairs met inside cells grow faster than n (family names have a high dimension, so a
    name lies near many pivots' borders). Rows are few and short, the work on each is large, so
    partitions are coalesced to as many as there are cores only. The result is materialised. Null
    names and blocks match nothing; an empty side gives no rows.
    """
    flags = lambda df, holds, asks: df.dropna().select("block", "name", "radius", F.lit(holds).alias("holds"), F.lit(asks).alias("asks"))
    each = flags(points, True, True) if queries is None else flags(points, True, False).unionByName(flags(queries, False, True))
    with spread(points.sparkSession):
        names = cut(each.groupBy("block", "name", "radius").agg(F.max("holds").alias("holds"), F.max("asks").alias("asks")))
        hot = hot_keys(names, ["block"])
        pivots = cut(_pivots(names.where("holds").select("block", "name"), hot))
        placed = cut(_placed(names, pivots, hot))
        release(points.sparkSession)
        top = F.col("d") - F.when(F.col("asks"), 0).otherwise(1)
        rings = lambda q: F.sequence(F.greatest(F.shiftright(q, _PLACE_BITS) - F.col("radius"), F.lit(0)), top)
        moves = F.flatten(F.transform("reach", lambda q: F.transform(rings(q), lambda ring: _cell(_pivot(q), ring, F.when(F.col("asks"), 0).otherwise(1)))))
        none = F.array().cast("array<bigint>")
        turned = lambda role: F.when(F.col(role) & (F.col("radius") == 1), F.array(_letters("name"))).otherwise(none)
        own = F.array(_cell(F.col("home"), F.col("d"), 0), _cell(F.col("home"), F.col("d"), 1))
        sits = F.when(F.col("asks"), own).otherwise(F.slice(own, 1, 1))
        tell = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("name", "e", "d", "holds", "asks")]
        moving = placed.where("d > 0 OR asks").select("block", "radius", *tell("x"), F.explode(F.concat(moves, turned("asks"))).alias("cell"))
        sitting = placed.select("block", *tell("y"), F.explode(F.concat(sits, turned("holds"))).alias("cell"))
        exchange = F.col("cell") < 0
        met = moving.join(sitting, ["block", "cell"]).where(_apart("e_x", "e_y", F.when(exchange, 2).otherwise(F.col("radius"))) & ((F.col("asks_x") & F.col("holds_y")) | (F.col("asks_y") & F.col("holds_x"))))
        near = met.withColumn("edits", F.levenshtein("name_x", "name_y", 2)).where(F.when(exchange, F.col("edits") == 2).otherwise((F.col("edits") >= 0) & (F.col("edits") <= F.col("radius"))))
        near = near.withColumn("edits", F.when((F.col("edits") == 2) & (F.length("name_x") == F.length("name_y")) & one_exchange(F.col("name_x"), F.col("name_y")), 1).otherwise(F.col("edits"))).where(~exchange | (F.col("edits") == 1))
        pair = lambda a, b, x: F.when(x, F.struct(F.col(f"name_{a}").alias("a"), F.col(f"name_{b}").alias("b")))
        there = pair("x", "y", F.col("asks_x") & F.col("holds_y"))
        back = pair("y", "x", F.col("asks_y") & F.col("holds_x") & (F.col("d_y") < F.col("d_x")) & ~exchange)
        return cut(near.select("block", F.explode(F.array_compact(F.array(there, back))).alias("pair"), F.col("edits").alias("d")).select("block", "pair.a", "pair.b", "d"))
