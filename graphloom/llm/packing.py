"""Best-fit-decreasing packing of documents into containers of fixed capacity."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut

#: Documents packed together in one task, about.
BLOCK_ROWS = 50_000
#: Rounds of packing anew what the least filled containers hold.
REPACKS = 6
PACKED = "doc_id bigint, lost boolean, piece int, size bigint, container bigint, room bigint"


class SegmentTree:
    """Numbers of open bins by remaining capacity; finds the tightest that fits in log time."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << max(1, capacity).bit_length()
        self.count = [0] * (2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, remaining: int, which: int) -> None:
        """Open a bin with so much room, or put it back with less."""
        self.bins[remaining].append(which)
        self._change(remaining, 1)

    def _change(self, at: int, by: int) -> None:
        at += self.width
        while at:
            self.count[at] += by
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the (room, bin) with the least room of at least ``size``."""
        node = size + self.width
        count = self.count
        if not count[node]:
            while node > 1 and not (node % 2 == 0 and count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.width
        self._change(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size, all of which are at most ``capacity``; ties by position."""
    tree, bins, out = SegmentTree(capacity), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        room, which = tree.take(sizes[i]) or (capacity, bins)
        bins += which == bins
        out[i] = which
        tree.add(room - sizes[i], which)
    return out


def _pieces(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """The rows of a block with documents beyond the capacity split into full pieces and a rest, in an
    order of their own, so that packing doesn't depend on how rows arrive."""
    rows = rows.sort_values(["lost", "doc_id", "piece", "size"], kind="stable", ignore_index=True)
    size = rows["size"].to_numpy(dtype=np.int64)
    full = size // capacity
    rest = size - full * capacity
    times = full + ((rest > 0) | (full == 0))
    out = rows.loc[rows.index.repeat(times)].reset_index(drop=True)
    nth = np.arange(len(out)) - np.repeat(np.cumsum(times) - times, times)
    out["size"] = np.where(nth == np.repeat(full, times), np.repeat(rest, times), capacity)
    out["piece"] += nth
    return out


def _packer(capacity: int, level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(block: pd.DataFrame) -> pd.DataFrame:
        frame = _pieces(block, capacity)
        bins = np.array(best_fit_decreasing(frame["size"].tolist(), capacity), dtype=np.int64)
        used = np.bincount(bins, frame["size"]).astype(np.int64)
        frame["container"] = (level << 58) + (int(frame["block"].iloc[0]) << 34) + bins
        frame["room"] = capacity - used[bins]
        return frame[["doc_id", "lost", "piece", "size", "container", "room"]]

    return run


def pack(documents: DataFrame, id_col: str, size_col: str, capacity: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(``doc_id``, ``piece``, ``size``, ``container``) of every row of ``documents``.

    A document is split only if it exceeds ``capacity``: into full pieces and a rest. Rows are dealt
    by a hash over blocks, as many as hold ``block_rows`` each, and every block is packed best-fit
    decreasing by itself, in one task; a retried task finds the same rows. The place of a row in its
    file adds to the hash, so that a row repeated a million times is spread too. Packing by blocks
    leaves each block some containers with room where packing all at once would leave a few in all.
    So what the containers hold that aren't full to within 1/256 of the capacity is packed anew, over
    at most half as many blocks, until one is left or REPACKS rounds are done; each round keeps what
    it filled. A null or negative size counts as 0; a null id is packed like any other; repeated rows
    are packed each; an empty table gives no rows; other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    number = F.col(id_col).cast("bigint")
    size = F.greatest(F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)), F.lit(0))
    rows = documents.select(F.coalesce(number, F.lit(0)).alias("doc_id"), number.isNull().alias("lost"), F.lit(0).alias("piece"), size.alias("size"))
    blocks, done, enough = max(1, math.ceil(documents.count() / block_rows)), None, capacity // 256
    for level in range(REPACKS + 1):
        deal = F.pmod(F.xxhash64("doc_id", "piece", "size", F.monotonically_increasing_id().bitwiseAND(F.lit(63))), F.lit(blocks))
        dealt = rows.withColumn("block", deal).repartition(blocks, "block")
        packed = dealt.groupBy("block").applyInPandas(_packer(capacity, level), PACKED)
        last = blocks == 1 or level == REPACKS
        packed = packed if last else cut(packed)
        kept = packed if last else packed.where(F.col("room") <= enough)
        done = kept if done is None else done.unionByName(kept)
        if last:
            break
        rows = packed.where(F.col("room") > enough).drop("container", "room")
        blocks = max(1, min(math.ceil(rows.count() / block_rows), blocks // 2))
    return done.select(F.when(~F.col("lost"), F.col("doc_id")).alias("doc_id"), "piece", "size", "container")


def packing_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: pieces, tokens, containers, the least number possible by volume, and the fill."""
    bins = packed.groupBy("container").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("pieces"))
    total = bins.agg(F.sum("pieces").alias("pieces"), F.sum("used").alias("tokens"), F.count(F.lit(1)).alias("containers"), F.max("used").alias("fullest"))
    return total.withColumn("least_containers", F.ceil(F.col("tokens") / capacity)).withColumn("fill", F.col("tokens") / (F.col("containers") * capacity))
