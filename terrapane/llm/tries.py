"""A trie over bytes, packed into arrays that a worker gets ready-made."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


def trie(pieces: Iterable[bytes]) -> tuple[list[dict[int, int]], list[int]]:
    """Children of each node, the root first and parents before children; and the number of the piece that ends there, -1 for none."""
    children: list[dict[int, int]] = [{}]
    ends: list[int] = [-1]
    for i, p in enumerate(pieces):
        at = 0
        for b in p:
            to = children[at].get(b)
            if to is None:
                to = children[at][b] = len(children)
                children.append({})
                ends.append(-1)
            at = to
        ends[at] = i
    return children, ends


class Packed:
    """Node v goes on by byte b to v' = base[v] + b if owner[v'] is v.  The root is node 0; place[i] is where node i of the trie went."""

    def __init__(self, children: list[dict[int, int]]):
        # nodes with many children first, each at one of the first bases that are free for all its children, or else behind all others
        taken = bytearray(512 * (1 + sum(len(c) > 1 for c in children)) + 2 * len(children))
        taken[0] = 1
        kids = {v: sorted(c) for v, c in enumerate(children) if c}
        base_of: dict[int, int] = {}
        free, last = 1, 0
        for v in sorted(kids, key=lambda v: -len(kids[v])):
            while taken[free]:
                free += 1
            low = max(1, free - kids[v][0])
            if len(kids[v]) == 1:
                while taken[low + kids[v][0]]:
                    low += 1
            else:
                fits = (x for x in range(low, low + 30) if not any(taken[x + b] for b in kids[v]))
                low = next(fits, max(1, last + 1 - kids[v][0]))
            base_of[v] = low
            for b in kids[v]:
                taken[low + b] = 1
            last = max(last, low + kids[v][-1])
        self.base, self.owner = (np.full(last + 512, -1, np.int32) for _ in range(2))
        self.place = np.zeros(len(children), np.int64)
        for v, c in enumerate(children):
            if v in base_of:
                self.base[self.place[v]] = base_of[v]
                for b, k in c.items():
                    self.place[k] = base_of[v] + b
                    self.owner[self.place[k]] = self.place[v]

    def spread(self, values: Iterable[int], empty: int = -1) -> np.ndarray:
        """Values of the trie's nodes, in order, at their places."""
        out = np.full(len(self.base), empty, np.int32)
        out[self.place] = np.fromiter(values, np.int32, len(self.place))
        return out

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next nodes, -1 where there is none."""
        base = self.base[node]
        to = np.maximum(base, 0) + byte
        return np.where((base >= 0) & (self.owner[to] == node), to, -1)
