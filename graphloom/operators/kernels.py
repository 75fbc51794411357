"""Sequential algorithms, one connected component at a time, as pandas functions.

They serve problems whose algorithms are inherently sequential (flow, matching, cycles, modularity).
Components run in parallel; one of more vertices than ``LIMITS["component_nodes"]`` is refused
before anything is collected into a task.
"""

from __future__ import annotations

import heapq
import math
import random
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.errors import LIMITS, ResourceLimitError
from graphloom.graphs.model import PropertyGraph
from graphloom.operators.matching import heaviest_matching
from graphloom.operators.components import component_labels
from graphloom.session import cut

#: Vertices, about, that are handed to Python at once, in whole components.
GROUP_NODES = 1_000

Graph = dict
KERNELS: dict[str, Callable[..., Iterator[tuple]]] = {}


def kernel(f: Callable[..., Iterator[tuple]]) -> Callable[..., Iterator[tuple]]:
    """Register a function of (vertices, edges with attributes, directed, **options)."""
    KERNELS[f.__name__] = f
    return f


def per_component(graph: PropertyGraph, name: str, columns: str, options: dict | None = None, attributes: tuple[str, ...] = ()) -> DataFrame:
    """Rows of kernel ``name`` on every weakly connected component, with its ``component``.

    ``columns`` is the schema of a row; ``{id}`` stands for the type of ids. Components are handed to
    Python by hash, about GROUP_NODES vertices at once, as most may be single vertices.
    """
    kind = dict(graph.vertices.dtypes)["id"]
    values = [F.col(a).cast("double").alias(a) if a in graph.edges.columns else F.lit(None).cast("double").alias(a) for a in attributes]
    labels = cut(graph.vertices.select("id").join(component_labels(graph.edges), "id", "left").select("id", F.coalesce("component", "id").alias("component")))
    sizes = labels.groupBy("component").count()
    largest, every = sizes.agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first()
    if largest > LIMITS["component_nodes"]:
        raise ResourceLimitError(f"a component of {largest} vertices; the limit is {LIMITS['component_nodes']}")
    vertices = labels.select("component", F.col("id").alias("src"), F.lit(None).cast(kind).alias("dst"), *(F.lit(None).cast("double").alias(a) for a in attributes))
    edges = graph.edges.select("src", "dst", *values).join(labels.select(F.col("id").alias("src"), "component"), "src").select("component", "src", "dst", *attributes)
    run, directed, opts = KERNELS[name], graph.directed, options or {}
    fields = columns.format(id=kind)
    names = ["component", *(c.strip().split()[0] for c in _split(fields))]

    def apply(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame["dst"].isna()
        nodes, links = defaultdict(list), defaultdict(list)
        for label, v in zip(frame.loc[own, "component"].tolist(), frame.loc[own, "src"].tolist(), strict=True):
            nodes[label].append(v)
        for label, *link in frame.loc[~own, ["component", "src", "dst", *attributes]].itertuples(index=False, name=None):
            links[label].append(tuple(link))
        out = []
        for label in sorted(nodes):
            each, edges = sorted(nodes[label]), sorted(links[label])
            if not isinstance(each[0], str):
                edges = [(int(a), int(b), *rest) for a, b, *rest in edges]
            out += [(label, *row) for row in run(each, edges, directed, **opts)]
        return pd.DataFrame(out, columns=names)

    # a group for each component would cost a call of Python for every vertex without edges
    bucket = F.pmod(F.xxhash64("component"), F.lit(-(-every // GROUP_NODES) or 1))
    return vertices.unionByName(edges).groupBy(bucket.alias("bucket")).applyInPandas(apply, f"component {kind}, {fields}")


def _split(fields: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, ch in enumerate(fields):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(fields[start:i])
            start = i + 1
    return [*out, fields[start:]]


def _adjacency(nodes: list, links: list) -> Graph:
    adj: Graph = {v: {} for v in nodes}
    for a, b, *rest in links:
        w = rest[0] if rest and rest[0] is not None and rest[0] == rest[0] else 1.0
        adj[a][b] = w
        adj[b][a] = w
    return adj


@kernel
def cycle_basis(nodes: list, links: list, directed: bool) -> Iterator[tuple]:
    """Fundamental cycles of a breadth-first tree: each edge outside it closes one."""
    adj = _adjacency(nodes, links)
    parent: dict = {}
    depth: dict = {}
    for root in nodes:
        if root in parent:
            continue
        parent[root], depth[root] = None, 0
        queue = deque([root])
        while queue:
            v = queue.popleft()
            for u in sorted(adj[v]):
                if u not in parent:
                    parent[u], depth[u] = v, depth[v] + 1
                    queue.append(u)
    for a, b, *_ in links:
        if a == b:
            yield ([a],)
        elif parent.get(a) != b and parent.get(b) != a:
            left, right = [a], [b]
            while left[-1] != right[-1]:
                if depth[left[-1]] >= depth[right[-1]]:
                    left.append(parent[left[-1]])
                else:
                    right.append(parent[right[-1]])
            yield (left + right[-2::-1],)


@kernel
def simple_cycles(nodes: list, links: list, directed: bool, limit: int) -> Iterator[tuple]:
    """Simple cycles by depth-first search from their least vertex, with blocking of dead ends."""
    after: Graph = {v: set() for v in nodes}
    for a, b, *_ in links:
        after[a].add(b)
    found = 0
    for start in nodes:
        blocked: set = set()
        waiting: dict = defaultdict(set)
        path = [start]
        closed: set = set()
        blocked.add(start)
        stack = [(start, iter(sorted(x for x in after[start] if x >= start)))]
        while stack:
            v, rest = stack[-1]
            step = next(rest, None)
            if step is not None:
                if step == start:
                    yield (list(path),)
                    found += 1
                    if found >= limit:
                        return
                    closed.update(path)
                elif step not in blocked:
                    path.append(step)
                    blocked.add(step)
                    closed.discard(step)
                    stack.append((step, iter(sorted(x for x in after[step] if x >= start))))
                continue
            if v in closed:
                free = [v]
                while free:
                    u = free.pop()
                    if u in blocked:
                        blocked.discard(u)
                        free.extend(waiting.pop(u, ()))
            else:
                for u in after[v]:
                    if u >= start:
                        waiting[u].add(v)
            stack.pop()
            path.pop()


@kernel
def maximum_flow(nodes: list, links: list, directed: bool, source: object, sink: object) -> Iterator[tuple]:
    """(src, dst, flow) of every edge, by shortest augmenting paths; a null capacity is unlimited.

    A row with a null flow says that an unlimited path exists.
    """
    if source not in set(nodes) or sink not in set(nodes):
        return
    room: Graph = {v: defaultdict(float) for v in nodes}
    for a, b, cap in links:
        if a != b:
            room[a][b] += math.inf if cap is None or cap != cap else cap
            room[b][a] += 0.0
    given = {v: dict(r) for v, r in room.items()}
    while True:
        before = {source: None}
        queue = deque([source])
        while queue and sink not in before:
            v = queue.popleft()
            for u in sorted(room[v]):
                if room[v][u] > 1e-12 and u not in before:
                    before[u] = v
                    queue.append(u)
        if sink not in before:
            break
        path, v = [], sink
        while before[v] is not None:
            path.append((before[v], v))
            v = before[v]
        least = min(room[a][b] for a, b in path)
        if math.isinf(least):
            yield source, sink, None
            return
        for a, b in path:
            room[a][b] -= least
            room[b][a] += least
    for a, b, _ in links:
        if a == b:
            yield a, b, 0.0
        elif math.isinf(given[a][b]):
            yield a, b, max(0.0, room[b][a] - given[b].get(a, 0.0))
        else:
            yield a, b, max(0.0, given[a][b] - room[a][b])


@kernel
def greedy_colouring(nodes: list, links: list, directed: bool, strategy: str, seed: int) -> Iterator[tuple]:
    """(id, colour): vertices in the order of a strategy take the least colour no neighbour has."""
    adj = {v: {u for u in row if u != v} for v, row in _adjacency(nodes, links).items()}
    colour: dict = {}

    def least(v: object) -> int:
        used = {colour[u] for u in adj[v] if u in colour}
        return next(c for c in range(len(used) + 1) if c not in used)

    if strategy == "DSATUR":
        seen: dict = {v: set() for v in nodes}
        heap = [(0, -len(adj[v]), v) for v in nodes]
        heapq.heapify(heap)
        while heap:
            sat, _, v = heapq.heappop(heap)
            if v in colour or -sat != len(seen[v]):
                continue
            colour[v] = least(v)
            for u in adj[v]:
                if u not in colour:
                    seen[u].add(colour[v])
                    heapq.heappush(heap, (-len(seen[u]), -len(adj[u]), u))
    elif strategy == "independent_set":
        left, c = set(nodes), 0
        while left:
            free = set(left)
            while free:
                v = min(free, key=lambda x: (len(adj[x] & free), x))
                colour[v] = c
                left.discard(v)
                free -= adj[v] | {v}
            c += 1
    else:
        if strategy == "smallest_last":
            degree = {v: len(adj[v]) for v in nodes}
            heap = [(d, v) for v, d in degree.items()]
            heapq.heapify(heap)
            order, gone = [], set()
            while heap:
                d, v = heapq.heappop(heap)
                if v in gone or d != degree[v]:
                    continue
                gone.add(v)
                order.append(v)
                for u in adj[v] - gone:
                    degree[u] -= 1
                    heapq.heappush(heap, (degree[u], u))
            order.reverse()
        elif strategy in ("connected_sequential_bfs", "connected_sequential_dfs", "connected_sequential"):
            order, seen_v = [], set()
            for root in nodes:
                open_v = deque([root])
                while open_v:
                    v = open_v.pop() if strategy.endswith("dfs") else open_v.popleft()
                    if v not in seen_v:
                        seen_v.add(v)
                        order.append(v)
                        open_v.extend(sorted(adj[v] - seen_v))
        elif strategy == "random_sequential":
            order = list(nodes)
            random.Random(seed).shuffle(order)
        else:
            order = sorted(nodes, key=lambda v: (-len(adj[v]), v))
        for v in order:
            colour[v] = least(v)
    yield from sorted(colour.items())


@kernel
def maximum_matching(nodes: list, links: list, directed: bool) -> Iterator[tuple]:
    """(src, dst, weight) of a matching of greatest size and, among these, of greatest weight.

    Weights are made dominated by the size: each edge gets a bonus larger than all weights together.
    """
    index = {v: i for i, v in enumerate(nodes)}
    seen: dict = {}
    for a, b, w in links:
        if a != b:
            seen[min(index[a], index[b]), max(index[a], index[b])] = 1.0 if w is None or w != w else float(w)
    if not seen:
        return
    bonus = 1 + sum(abs(w) for w in seen.values())
    mate = heaviest_matching(len(nodes), {e: w + bonus for e, w in seen.items()})
    for (i, j), w in sorted(seen.items()):
        if mate[i] == j:
            yield nodes[i], nodes[j], w


@kernel
def louvain(nodes: list, links: list, directed: bool, total: float, resolution: float) -> Iterator[tuple]:
    """(id, community): vertices move, in order, to the neighbouring community of greatest gain;
    communities then become vertices. ``total`` is the weight of the whole graph."""
    adj = _adjacency(nodes, links)
    member = {v: v for v in nodes}
    loops: dict = {v: 0.0 for v in nodes}
    for a, b, *rest in links:
        if a == b:
            loops[a] += rest[0] if rest and rest[0] == rest[0] and rest[0] is not None else 1.0
    work = {v: {u: w for u, w in row.items() if u != v} for v, row in adj.items()}
    while True:
        degree = {v: sum(row.values()) + 2 * loops[v] for v, row in work.items()}
        com = {v: v for v in work}
        sums = dict(degree)
        moved_any, moved = False, True
        while moved:
            moved = False
            for v in sorted(work):
                near: dict = defaultdict(float)
                for u, w in work[v].items():
                    near[com[u]] += w
                old = com[v]
                sums[old] -= degree[v]
                gain = lambda c, v=v, near=near: near.get(c, 0.0) - resolution * sums[c] * degree[v] / (2 * total)
                best = old
                for c in sorted(near):
                    if gain(c) > gain(best) + 1e-12:
                        best = c
                sums[best] += degree[v]
                if best != old:
                    com[v] = best
                    moved = moved_any = True
        if not moved_any:
            break
        member = {v: com[c] for v, c in member.items()}
        new_loops: dict = defaultdict(float)
        new: dict = {c: defaultdict(float) for c in set(com.values())}
        for v, row in work.items():
            new_loops[com[v]] += loops[v]
            for u, w in row.items():
                if com[u] == com[v]:
                    new_loops[com[v]] += w / 2
                else:
                    new[com[v]][com[u]] += w
        work, loops = {c: dict(r) for c, r in new.items()}, {c: new_loops[c] for c in new}
    yield from _named(member)


def _named(member: dict) -> Iterator[tuple]:
    least: dict = {}
    for v in sorted(member):
        least.setdefault(member[v], v)
    for v in sorted(member):
        yield v, least[member[v]]


@kernel
def greedy_modularity(nodes: list, links: list, directed: bool, total: float, resolution: float) -> Iterator[tuple]:
    """(id, community): communities merge in the order of greatest gain while there is any."""
    adj = _adjacency(nodes, links)
    degree = {v: sum(w * (2 if u == v else 1) for u, w in row.items()) / (2 * total) for v, row in adj.items()}
    gain = {v: {u: 2 * (w / (2 * total) - resolution * degree[v] * degree[u]) for u, w in row.items() if u != v} for v, row in adj.items()}
    heap = [(-g, min(v, u), max(v, u)) for v, row in gain.items() for u, g in row.items() if v < u]
    heapq.heapify(heap)
    member = {v: [v] for v in nodes}
    while heap:
        g, a, b = heapq.heappop(heap)
        if a not in member or b not in member or gain[a].get(b) != -g:
            continue
        if -g <= 1e-15:
            break
        for c in set(gain[a]) | set(gain[b]):
            if c in (a, b):
                continue
            ga, gb = gain[a].get(c), gain[b].get(c)
            if ga is None:
                value = gb - 2 * resolution * degree[a] * degree[c]
            elif gb is None:
                value = ga - 2 * resolution * degree[b] * degree[c]
            else:
                value = ga + gb
            gain[a][c] = gain[c][a] = value
            gain[c].pop(b, None)
            heapq.heappush(heap, (-value, min(a, c), max(a, c)))
        gain[a].pop(b, None)
        del gain[b]
        degree[a] += degree[b]
        member[a] += member.pop(b)
    yield from _named({v: c for c, own in member.items() for v in own})


#: Rows of the table of distances between vertices that a layout holds at once.
LAYOUT_ROWS = 512


@kernel
def spring_layout(nodes: list, links: list, directed: bool, rounds: int, seed: int) -> Iterator[tuple]:
    """(id, x, y) after ``rounds`` of repelling all and drawing neighbours together, cooling down."""
    import numpy as np

    n = len(nodes)
    index = {v: i for i, v in enumerate(nodes)}
    ends = sorted({(min(index[s], index[d]), max(index[s], index[d])) for s, d, *_ in links if s != d})
    a, b = (np.array([e[k] for e in ends], dtype=np.int64) for k in (0, 1))
    pos = np.random.default_rng(seed).random((n, 2))
    k, heat = math.sqrt(1.0 / max(n, 1)), 0.1
    for _ in range(rounds if n > 1 else 0):
        move = np.zeros((n, 2))
        for at in range(0, n, LAYOUT_ROWS):
            delta = pos[at : at + LAYOUT_ROWS, None, :] - pos[None, :, :]
            dist = np.maximum((delta**2).sum(-1), 1e-4)
            move[at : at + LAYOUT_ROWS] = (delta * (k * k / dist)[..., None]).sum(1)
        if len(ends):
            delta = pos[a] - pos[b]
            pull = delta * (np.maximum(np.sqrt((delta**2).sum(-1)), 0.01) / k)[:, None]
            np.add.at(move, a, -pull)
            np.add.at(move, b, pull)
        length = np.maximum(np.sqrt((move**2).sum(-1)), 0.01)
        pos += move * (heat / length)[:, None]
        heat -= 0.1 / (rounds + 1)
    pos -= pos.mean(0)
    pos /= max(abs(pos).max(), 1e-9)
    for v, (x, y) in zip(nodes, pos.tolist(), strict=True):
        yield v, x, y


@kernel
def kamada_kawai_layout(nodes: list, links: list, directed: bool, rounds: int, seed: int) -> Iterator[tuple]:
    """(id, x, y): distances in the plane fitted to those in the graph, by stress majorisation.

    Distances in the graph take two bytes a pair of vertices, all else LAYOUT_ROWS rows at a time.
    """
    import numpy as np

    n = len(nodes)
    adj = _adjacency(nodes, links)
    index = {v: i for i, v in enumerate(nodes)}
    goal = np.full((n, n), min(n, 32767), dtype=np.int16)
    for v in nodes:
        depth, queue = {v: 0}, deque([v])
        while queue:
            x = queue.popleft()
            for u in adj[x]:
                if u not in depth:
                    depth[u] = depth[x] + 1
                    queue.append(u)
        goal[index[v], [index[u] for u in depth]] = list(depth.values())
    turn = 2 * np.pi * np.arange(n) / max(n, 1)
    pos = np.stack([np.cos(turn), np.sin(turn)], 1) * n / 4
    for _ in range(rounds if n > 1 else 0):
        new = np.empty_like(pos)
        for at in range(0, n, LAYOUT_ROWS):
            rows = goal[at : at + LAYOUT_ROWS].astype(float)
            w = 1.0 / np.where(rows > 0, rows, np.inf) ** 2
            delta = pos[at : at + LAYOUT_ROWS, None, :] - pos[None, :, :]
            dist = np.maximum(np.sqrt((delta**2).sum(-1)), 1e-9)
            new[at : at + LAYOUT_ROWS] = (w[..., None] * (pos[None, :, :] + delta * (rows / dist)[..., None])).sum(1) / w.sum(1)[:, None]
        pos = new
    pos -= pos.mean(0) if n else 0
    pos /= max(abs(pos).max(), 1e-9) if n else 1
    for v, (x, y) in zip(nodes, pos.tolist(), strict=True):
        yield v, x, y
