"""Prefix tree of sets whose elements have one global order, searched for sets that may be similar."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from math import inf

from .clusters import Joined

#: Elements of a run that are compared at once, between two looks at the bound.
RUN = 16


class Member:
    """A set, or as much of it as is known: ``known`` are all its elements below ``limit``, rising; ``size`` is that of the whole set."""

    __slots__ = ("item", "size", "known", "own", "limit")

    def __init__(self, item, size: int, known: list, limit=inf) -> None:
        self.item, self.size, self.known, self.own, self.limit = item, size, known, frozenset(known), limit


class Node:
    __slots__ = ("run", "below", "ends", "least", "most", "same")

    def __init__(self, run: list) -> None:
        self.run = run
        self.below: dict = {}
        self.ends: list[int] = []
        #: sizes of the sets below, and a member that all below are joined with (-1: none)
        self.least, self.most, self.same = inf, 0, -1


class PrefixTree:
    """Sets are paths of their elements in order; those with equal beginnings share them. A search carries the overlap with the path so far, and leaves a
    subtree where even all of what remains of both sets would not reach ``num / den``, or where all sets are joined with the one sought."""

    def __init__(self, members: list[Member], joined: Joined, num: int, den: int) -> None:
        self.members, self.joined, self.num, self.den = members, joined, num, den
        self.root = Node([])
        self.visited = 0

    def add(self, i: int) -> None:
        known, node, at, root = self.members[i].known, self.root, 0, self.joined.root(i)
        self._pass(node, i, root)
        while at < len(known):
            child = node.below.get(known[at])
            if child is None:
                new = Node(known[at:])
                node.below[known[at]] = new
                node = new
                self._pass(node, i, root)
                break
            run, n = child.run, 1
            while n < len(run) and at + n < len(known) and run[n] == known[at + n]:
                n += 1
            if n < len(run):
                upper = Node(run[:n])
                upper.least, upper.most, upper.same = child.least, child.most, child.same
                child.run = run[n:]
                upper.below[run[n]] = child
                node.below[run[0]] = child = upper
            node, at = child, at + n
            self._pass(node, i, root)
        node.ends.append(i)

    def _pass(self, node: Node, i: int, root: int) -> None:
        size = self.members[i].size
        if not node.most:
            node.same = i
        elif node.same >= 0 and self.joined.root(node.same) != root:
            node.same = -1
        node.least, node.most = min(node.least, size), max(node.most, size)

    def near(self, q: Member, own: int):
        """Members not joined with member ``own`` (whose set is ``q``), with the overlap of what both know, that may be (or, with whole sets, are) similar."""
        known, mine, limit, size, root = q.known, q.own, q.limit, q.size, self.joined.root
        num, both = self.num, self.num + self.den
        todo, mine_root = [(self.root, 0, 0)], root(own)
        while todo:
            node, overlap, depth = todo.pop()
            if node.same >= 0 and root(node.same) == mine_root:
                continue
            run, fits = node.run, True
            for start in range(0, len(run), RUN):
                self.visited += 1
                part = run[start : start + RUN]
                overlap += len(mine.intersection(part))
                ended = part[-1] >= limit
                depth += bisect_left(part, limit) if ended else len(part)
                rest = size - (len(known) if ended else bisect_right(known, part[-1]))
                fits = both * (overlap + min(rest, node.most - depth)) >= num * (size + node.least)
                if ended or not fits:
                    break
            if not fits:
                continue
            for j in node.ends:
                if root(j) != mine_root:
                    other = self.members[j]
                    ends = min(limit, other.limit)
                    left = min(size - bisect_left(known, ends), other.size - (depth if other.limit <= limit else bisect_left(other.known, ends)))
                    if both * (overlap + left) >= num * (size + other.size):
                        yield j, overlap
                        # who asks may have joined the two
                        mine_root = root(own)
            for first, below in node.below.items():
                # some subtrees fail by their first element, before their run is looked at
                left = min(size - bisect_right(known, first), below.most - depth - 1) if first < limit else below.most
                if both * (overlap + (first in mine) + left) >= num * (size + below.least):
                    todo.append((below, overlap, depth))


def similar(members: list[Member], num: int, den: int) -> list[tuple]:
    """Links (item, first item of its component) of whole sets with a Jaccard similarity of ``num / den`` at least."""
    members = sorted(members, key=lambda m: m.item)
    joined = Joined(len(members))
    tree = PrefixTree(members, joined, num, den)
    for i, m in enumerate(members):
        for j, _ in tree.near(m, i):
            joined.join(i, j)
        tree.add(i)
    return [(m.item, members[r].item) for i, m in enumerate(members) if (r := joined.root(i)) != i]


def candidates(members: list[Member], roots: list, num: int, den: int) -> list[tuple]:
    """Pairs of items with different ``roots`` whose known elements leave room for ``num / den``."""
    joined, first = Joined(len(members)), {}
    for i, r in enumerate(roots):
        joined.join(i, first.setdefault(r, i))
    tree, out = PrefixTree(members, joined, num, den), []
    for i, m in enumerate(members):
        out += [(m.item, members[j].item) for j, _ in tree.near(m, i)]
        tree.add(i)
    return out
