"""A signature tree over sets, and the dual traversal that joins it with itself.

Every set has a bitmap of hashed members. A node holds the OR of its bitmaps, the range
of its set sizes, and the largest number of members that fell on a bit already set.
Two sets of nodes A and B share at most popcount(A & B) members on different bits, and
on a common bit at most that excess more; node pairs that can't reach the overlap which
the similarity asks for are pruned, and so are pairs already in one component.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

LEAF, FAN = 16, 8


@dataclass
class Node:
    low: int  # its sets are low..high - 1 in tree order
    high: int
    bits: np.ndarray
    least: int
    most: int
    excess: int
    children: list["Node"] = field(default_factory=list)


class SignatureTree:
    """Sets as sorted distinct 64-bit hashes, linked when den * overlap >= num * union."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den = num, den
        sizes = np.array([len(s) for s in sets], np.int64)
        first = np.array([s[0] if len(s) else 0 for s in sets], np.uint64)
        self.order = np.lexsort((first, sizes))
        self.sets = [sets[i] for i in self.order]
        self.sizes = sizes[self.order]
        most = int(self.sizes.max(initial=1))
        self.m = min(1 << 16, max(256, 1 << (8 * most - 1).bit_length()))
        self.bits = np.zeros((len(sets), self.m // 8), np.uint8)
        for row, s in zip(self.bits, self.sets):
            place = (s & np.uint64(self.m - 1)).astype(np.int64)
            full = np.zeros(self.m, bool)
            full[place] = True
            row[:] = np.packbits(full)
        self.bits = self.bits.view(np.uint64)
        self.excess = self.sizes - np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        self.comp = np.arange(len(sets))
        self.verified = 0
        level = [self._node(a, min(a + LEAF, len(sets)), []) for a in range(0, len(sets), LEAF)]
        while len(level) > 1:
            level = [self._node(level[i].low, level[min(i + FAN, len(level)) - 1].high, level[i:i + FAN])
                     for i in range(0, len(level), FAN)]
        self.root = level[0] if level else None

    def _node(self, low: int, high: int, children: list[Node]) -> Node:
        bits = (np.bitwise_or.reduce([c.bits for c in children]) if children
                else np.bitwise_or.reduce(self.bits[low:high], axis=0))
        return Node(low, high, bits, int(self.sizes[low:high].min()), int(self.sizes[low:high].max()),
                    int(self.excess[low:high].max()), children)

    def _may_link(self, a: Node, b: Node) -> bool:
        if a.most * self.den < self.num * b.least or b.most * self.den < self.num * a.least:
            return False
        shared = int(np.bitwise_count(a.bits & b.bits).sum()) + min(a.excess, b.excess)
        shared = min(shared, a.most, b.most)
        return shared * (self.num + self.den) >= self.num * (a.least + b.least)

    def _one_component(self, a: Node, b: Node) -> bool:
        root = self.comp[a.low]
        return bool((self.comp[a.low:a.high] == root).all() and (self.comp[b.low:b.high] == root).all())

    def join(self) -> np.ndarray:
        """The component of each given set, as the place of one of its sets."""
        stack = [(self.root, self.root)] if self.root else []
        while stack:
            a, b = stack.pop()
            if a is b:
                if a.children:
                    c = a.children
                    # Pushed first, done last: by then near pairs have become one component.
                    stack += [(c[i], c[j]) for i in range(len(c)) for j in range(len(c) - 1, i, -1)]
                    stack += [(x, x) for x in c]
                else:
                    self._leaves(a, a)
            elif not self._one_component(a, b) and self._may_link(a, b):
                if a.children and (not b.children or a.high - a.low >= b.high - b.low):
                    stack += [(c, b) for c in a.children]
                elif b.children:
                    stack += [(a, c) for c in b.children]
                else:
                    self._leaves(a, b)
        out = np.empty(len(self.order), np.int64)
        out[self.order] = self.order[self.comp]
        return out

    def _leaves(self, a: Node, b: Node) -> None:
        shared = np.bitwise_count(self.bits[a.low:a.high, None, :] & self.bits[None, b.low:b.high, :]).sum(axis=2, dtype=np.int64)
        sa, sb = self.sizes[a.low:a.high, None], self.sizes[None, b.low:b.high]
        shared = np.minimum(shared + np.minimum(self.excess[a.low:a.high, None], self.excess[None, b.low:b.high]), np.minimum(sa, sb))
        for i, j in np.argwhere(shared * (self.num + self.den) >= self.num * (sa + sb)):
            x, y = a.low + i, b.low + j
            if (a is not b or x < y) and self.comp[x] != self.comp[y] and self._linked(x, y):
                self.comp[self.comp == self.comp[y]] = self.comp[x]

    def _linked(self, x: int, y: int) -> bool:
        """Exact: counts the common members."""
        self.verified += 1
        both = len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True))
        return self.den * both >= self.num * (self.sizes[x] + self.sizes[y] - both) and both > 0
