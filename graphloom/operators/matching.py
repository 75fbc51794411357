"""Matchings of greatest weight in general graphs (Edmonds 1965; duals as in Galil 1986).

The linear program of matching gives every vertex a price and every shrunken odd cycle a bonus. A
search grows alternating trees from the single vertices over edges whose price is exactly paid; where
two trees meet the matching grows by one, where a tree meets itself the odd cycle is shrunk into a
shell. When no paid edge is left, prices move by the largest step that keeps every edge affordable.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

EPS = 1e-9
OUTER, INNER = 1, 2


class Shell:
    """A vertex, or an odd cycle of shells: ``parts`` in order and ``joints``, the edges (vertex of
    this part, vertex of the next) between them.

    ``root`` is the vertex by which the shell is matched outwards, or would be. ``door`` is the edge
    (vertex outside, vertex inside) by which a tree came in.
    """

    __slots__ = ("bonus", "door", "joints", "mark", "parts", "root", "up")

    def __init__(self, root: int, parts: list[Shell] | None = None, joints: list[tuple[int, int]] | None = None) -> None:
        self.root, self.parts, self.joints = root, parts or [], joints or []
        self.bonus, self.mark, self.door, self.up = 0.0, 0, None, None

    def vertices(self) -> Iterator[int]:
        """All vertices inside."""
        if not self.parts:
            yield self.root
        for part in self.parts:
            yield from part.vertices()

    def walk(self, start: int, end: int) -> list[tuple[int, int, int]]:
        """(part, vertex there, vertex of the part before) of every step from part ``start`` to part
        ``end`` around the cycle in the direction that takes an even number of steps."""
        k, out = len(self.parts), []
        forward = (end - start) % k % 2 == 0
        while start != end:
            if forward:
                here, there = self.joints[start]
                start = (start + 1) % k
            else:
                start = (start - 1) % k
                there, here = self.joints[start]
            out.append((start, there, here))
        return out


class Matcher:
    """The state of the search: prices, mates and outermost shells."""

    def __init__(self, n: int, weights: dict[tuple[int, int], float]) -> None:
        self.near: list[dict[int, float]] = [{} for _ in range(n)]
        for (a, b), w in weights.items():
            self.near[a][b] = self.near[b][a] = w
        self.price = [max(weights.values(), default=0.0)] * n  # an edge is paid when prices sum to twice its weight
        self.mate = [-1] * n
        self.leaf = [Shell(v) for v in range(n)]
        self.outermost: set[Shell] = set(self.leaf)

    def top(self, v: int) -> Shell:
        """The outermost shell of a vertex."""
        shell = self.leaf[v]
        while shell.up is not None:
            shell = shell.up
        return shell

    def part_of(self, shell: Shell, v: int) -> int:
        """Which part of ``shell`` holds a vertex."""
        inner = self.leaf[v]
        while inner.up is not shell:
            inner = inner.up
        return shell.parts.index(inner)

    def turn(self, shell: Shell, v: int) -> None:
        """Match ``shell`` inside so that ``v`` is left to be matched outwards."""
        if shell.parts:
            entry = self.part_of(shell, v)
            steps = shell.walk(entry, self.part_of(shell, shell.root))
            for at in range(1, len(steps), 2):
                part, there, here = steps[at]
                self.turn(shell.parts[steps[at - 1][0]], here)
                self.turn(shell.parts[part], there)
                self.mate[here], self.mate[there] = there, here
            self.turn(shell.parts[entry], v)
        shell.root = v

    def ancestors(self, shell: Shell) -> Iterator[tuple[Shell, tuple[int, int] | None]]:
        """The shells from an outer one to the root of its tree, each with the edge (vertex in it,
        vertex in the next) that leads on."""
        while True:
            edge = shell.door and (shell.door[1], shell.door[0])
            yield shell, edge
            if edge is None:
                return
            shell = self.top(edge[1])

    def meet(self, u: int, v: int) -> bool:
        """Take in a paid edge between two outer shells; true if the matching grew."""
        left, right = list(self.ancestors(self.top(u))), list(self.ancestors(self.top(v)))
        if left[-1][0] is not right[-1][0]:
            self.flip(u, v)
            self.flip(v, u)
            return True
        while len(left) > 1 and len(right) > 1 and left[-2][0] is right[-2][0]:
            left.pop()
            right.pop()
        base = left[-1][0]
        parts = [s for s, _ in reversed(left)] + [s for s, _ in right[:-1]]
        joints = [(b, a) for _, (a, b) in reversed(left[:-1])] + [(u, v)] + [e for _, e in right[:-1]]
        shell = Shell(base.root, parts, joints)
        shell.mark, shell.door = OUTER, base.door
        for part in parts:
            part.up = shell
        self.outermost -= set(parts)
        self.outermost.add(shell)
        return False

    def flip(self, u: int, v: int) -> None:
        """Match ``u`` to ``v`` and exchange matched and free edges from there to the tree's root."""
        while True:
            shell = self.top(u)
            door = shell.door
            self.turn(shell, u)
            self.mate[u] = v
            if door is None:
                return
            inner = self.top(door[0])
            u, v = inner.door
            self.turn(inner, v)
            self.mate[v] = u

    def open(self, shell: Shell) -> None:
        """Undo an inner shell without bonus; its parts between the door and the root stay in the tree."""
        self.outermost.remove(shell)
        entry, root = self.part_of(shell, shell.door[1]), self.part_of(shell, shell.root)
        steps = shell.walk(entry, root)
        for part in shell.parts:
            part.up, part.mark, part.door = None, 0, None
            self.outermost.add(part)
        shell.parts[entry].mark, shell.parts[entry].door = INNER, shell.door
        for k, (part, there, here) in enumerate(steps):
            shell.parts[part].mark, shell.parts[part].door = (INNER if k % 2 else OUTER), (here, there)

    def enter(self, u: int, v: int) -> None:
        """Let a tree take a matched shell outside all trees, and its mate."""
        shell = self.top(v)
        shell.mark, shell.door = INNER, (u, v)
        mate = self.mate[shell.root]
        other = self.top(mate)
        other.mark, other.door = OUTER, (shell.root, mate)

    def grow(self) -> bool:
        """One search; true if the matching grew, false if it can't any more."""
        for shell in self.outermost:
            shell.mark, shell.door = (OUTER if self.mate[shell.root] < 0 else 0), None
        while True:
            step, what = math.inf, None
            tops = [self.top(v) for v in range(len(self.leaf))]
            for u, own in enumerate(tops):
                if own.mark != OUTER:
                    continue
                if self.price[u] < step:
                    step, what = self.price[u], None
                for v, w in self.near[u].items():
                    other = tops[v]
                    if other is own or other.mark == INNER:
                        continue
                    slack = self.price[u] + self.price[v] - 2 * w
                    slack = slack / 2 if other.mark == OUTER else slack
                    if slack < step - EPS or (slack < step + EPS and what is None):
                        step, what = slack, (u, v)
            for shell in self.outermost:
                if shell.mark == INNER and shell.parts and shell.bonus / 2 < step - EPS:
                    step, what = shell.bonus / 2, shell
            if what is None:
                return False
            self.move(step)
            if isinstance(what, Shell):
                self.open(what)
            elif self.top(what[1]).mark != OUTER:
                self.enter(*what)
            elif self.meet(*what):
                return True

    def move(self, step: float) -> None:
        """Lower the prices of outer vertices and raise those of inner ones; bonuses make up for it."""
        for shell in self.outermost:
            sign = {OUTER: -1, INNER: 1}.get(shell.mark, 0)
            if sign and step:
                for v in shell.vertices():
                    self.price[v] += sign * step
                shell.bonus -= 2 * sign * step


def heaviest_matching(n: int, weights: dict[tuple[int, int], float]) -> list[int]:
    """The mate of each of ``n`` vertices (-1 without) in a matching of greatest weight; ``weights``
    has every edge once. Up to n searches of up to n steps, each over all edges."""
    search = Matcher(n, weights)
    while search.grow():
        pass
    return search.mate
