"""Small graphs in one task: for some ten thousand edges rounds of jobs cost far more than the work.

Callers count first and go on by rounds beyond the limits; results are the same.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges of a graph that one task walks along, and steps (edges times starts) it may take.
LOCAL_ARCS = 50_000
LOCAL_STEPS = 2_000_000


def fits(arcs: int, times: int) -> bool:
    """Whether so many walks over so many edges are for one task."""
    return arcs <= LOCAL_ARCS and arcs * times <= LOCAL_STEPS


def in_one_task(arcs: DataFrame, points: DataFrame, f: Callable[[pd.DataFrame, list], pd.DataFrame], schema: str) -> DataFrame:
    """``f`` of all ``arcs`` (``src``, ``dst``, ``weight``) and the sorted ids in ``points`` (``id``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(batches) or [pd.DataFrame(columns=["arc", "src", "dst", "weight"])], ignore_index=True)
        own = frame["arc"].astype(bool)
        ids = sorted(frame.loc[~own, "src"].tolist())
        if ids:
            yield f(frame.loc[own, ["src", "dst", "weight"]], ids)

    rows = arcs.select(F.lit(True).alias("arc"), "src", "dst", F.col("weight").cast("double").alias("weight"))
    marks = points.select(F.lit(False).alias("arc"), F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("weight"))
    return rows.unionByName(marks).coalesce(1).mapInPandas(run, schema)


def _after(arcs: pd.DataFrame) -> dict[object, list]:
    out: dict[object, list] = defaultdict(list)
    for a, b in zip(arcs["src"].tolist(), arcs["dst"].tolist(), strict=True):
        out[a].append(b)
    return out


def walks(max_depth: int | None) -> Callable[[pd.DataFrame, list], pd.DataFrame]:
    """(``source``, ``id``, ``depth``, ``pred``) of breadth-first walks; the least predecessor counts."""

    def run(arcs: pd.DataFrame, sources: list) -> pd.DataFrame:
        after, rows = _after(arcs), []
        for s in sources:
            seen, level, depth = {s}, {s: None}, 0
            while level:
                rows += [(s, v, depth, p) for v, p in level.items()]
                depth += 1
                if max_depth is not None and depth > max_depth:
                    break
                new: dict = {}
                for u in level:
                    for v in after.get(u, ()):
                        if v not in seen and (v not in new or u < new[v]):
                            new[v] = u
                seen.update(new)
                level = new
        columns = list(zip(*rows, strict=True))
        return pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(("source", "id", "depth", "pred"), columns, strict=True)})

    return run


def dependencies(arcs: pd.DataFrame, ids: list) -> pd.DataFrame:
    """(``id``, ``delta``): how much each vertex lies between all others (Brandes 2001)."""
    after, total = _after(arcs), dict.fromkeys(ids, 0.0)
    for s in ids:
        order, sigma, depth, before = [s], {s: 1.0}, {s: 0}, defaultdict(list)
        for u in order:
            for v in after.get(u, ()):
                if v not in depth:
                    depth[v], sigma[v] = depth[u] + 1, 0.0
                    order.append(v)
                if depth[v] == depth[u] + 1:
                    sigma[v] += sigma[u]
                    before[v].append(u)
        delta = dict.fromkeys(order, 0.0)
        for v in reversed(order[1:]):
            for u in before[v]:
                delta[u] += sigma[u] / sigma[v] * (1 + delta[v])
            total[v] += delta[v]
    return pd.DataFrame({"id": list(total), "delta": list(total.values())})


def _numbered(arcs: pd.DataFrame, ids: list) -> tuple[np.ndarray, np.ndarray]:
    at = {v: i for i, v in enumerate(ids)}
    return tuple(np.fromiter((at[v] for v in arcs[c].tolist()), np.int64, len(arcs)) for c in ("src", "dst"))


def ranks(alpha: float, rounds: int, tolerance: float | None) -> Callable[[pd.DataFrame, list], pd.DataFrame]:
    """(``id``, ``score``) of PageRank; ``weight`` is each edge's share of its source."""

    def run(arcs: pd.DataFrame, ids: list) -> pd.DataFrame:
        n = len(ids)
        src, dst = _numbered(arcs, ids)
        share = arcs["weight"].to_numpy(float)
        stuck = np.ones(n, bool)
        stuck[src] = False
        x = np.full(n, 1.0 / n)
        for _ in range(rounds):
            y = alpha * (np.bincount(dst, x[src] * share, n) + x[stuck].sum() / n) + (1 - alpha) / n
            moved, x = np.abs(y - x).sum(), y
            if tolerance is not None and moved < n * tolerance:
                break
        return pd.DataFrame({"id": ids, "score": x})

    return run


def strong_sets(arcs: pd.DataFrame, ids: list) -> pd.DataFrame:
    """(``id``, ``component``): the least vertex of each one's strong component (Tarjan 1972)."""
    after, found, low, label, stack, path = _after(arcs), {}, {}, {}, [], []
    for start in ids:
        if start in found:
            continue
        path.append((start, iter(after.get(start, ()))))
        found[start] = low[start] = len(found)
        stack.append(start)
        while path:
            v, rest = path[-1]
            for u in rest:
                if u not in found:
                    found[u] = low[u] = len(found)
                    stack.append(u)
                    path.append((u, iter(after.get(u, ()))))
                    break
                if u not in label:
                    low[v] = min(low[v], found[u])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[v])
                if low[v] == found[v]:
                    own = [stack.pop()]
                    while own[-1] != v:
                        own.append(stack.pop())
                    label.update(dict.fromkeys(own, min(own)))
    return pd.DataFrame({"id": ids, "component": [label[v] for v in ids]})


def lightest_forest(arcs: pd.DataFrame, ids: list) -> pd.DataFrame:
    """(``src``, ``dst``, ``weight``) of the edges that join what lighter ones don't (Kruskal 1956)."""
    root, taken = {}, []

    def find(v: object) -> object:
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for w, a, b in sorted(zip(arcs["weight"].tolist(), arcs["src"].tolist(), arcs["dst"].tolist(), strict=True)):
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            taken.append((a, b, w))
    columns = list(zip(*taken, strict=True)) or [[], [], []]
    return pd.DataFrame(dict(zip(("src", "dst", "weight"), columns, strict=True)))
