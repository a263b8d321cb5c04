"""Vector best-fit packing of token runs into sequences.

An item is a run of ids of one document; its demand is a vector (tokens, documents, attention cost). Bins have a
capacity in each dimension. Items are taken in falling token order; of all bins that fit in every dimension, the one
with the smallest weighted norm of what remains (or the largest weighted dot product of demand and residual) gets the
item. Of equal bins, the one with fewer residual tokens and then the older one does.

Bins that have the same residual vector are interchangeable but for their age: they are one state. States are kept by
residual tokens; as the token term alone bounds a state's score, the levels are looked at from the best one on until
no later level can win. No bin is left out of the choice.

At cluster scale, items are dealt into shards of a bounded number of items and each shard is packed alone; a shard
wastes at most about one sequence.
"""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np


@dataclass(frozen=True)
class Capacity:
    """documents and attention (the sum of squared lengths) default to what a full sequence can reach, where they don't bind."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    rule: str = "norm"  # or "dot"


class _Bins:
    """Open bins by state (residual tokens, documents, attention)."""

    def __init__(self, capacity: Capacity):
        self.c = capacity
        self.levels: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(capacity.tokens + 1)]
        self.occupied = 0  # bit r: levels[r] has bins
        w, full = capacity.weights, (capacity.tokens, capacity.documents, capacity.attention)
        self.scale = [a / f / f for a, f in zip(w, full, strict=True)]

    def score(self, r: int, documents: int, attention: int, size: int) -> float:
        """Of a bin with these residuals: lower is better."""
        a, b, c = self.scale
        if self.c.rule == "dot":
            return -(a * r * size + b * documents + c * attention * size * size)
        return a * (r - size) ** 2 + b * (documents - 1) ** 2 + c * (attention - size * size) ** 2

    def best(self, size: int) -> tuple[int, tuple[int, int]] | None:
        """The level and state that an item of `size` tokens goes to."""
        cost, found, score = size * size, None, 0.0
        dot, (a, b, c), full = self.c.rule == "dot", self.scale, self.c
        left = self.occupied >> size << size
        while left:
            r = left.bit_length() - 1 if dot else (left & -left).bit_length() - 1
            left ^= 1 << r
            bound = -(a * r * size + b * full.documents + c * full.attention * cost) if dot else a * (r - size) ** 2
            if found is not None and bound > score:
                break
            for state in self.levels[r]:
                if state[0] >= 1 and state[1] >= cost:
                    got = self.score(r, *state, size)
                    if found is None or (got, r, self.levels[r][state][0]) < (score, found[0], self.levels[found[0]][found[1]][0]):
                        found, score = (r, state), got
        return found

    def take(self, r: int, state: tuple[int, int]) -> int:
        heap = self.levels[r][state]
        b = heappop(heap)
        if not heap:
            del self.levels[r][state]
            if not self.levels[r]:
                self.occupied ^= 1 << r
        return b

    def put(self, b: int, r: int, state: tuple[int, int]) -> None:
        heappush(self.levels[r].setdefault(state, []), b)
        self.occupied |= 1 << r


def pack(lengths: np.ndarray, capacity: Capacity = Capacity()) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. Items must fit an empty bin; items of equal length go by position. No items: no bins."""
    lengths = np.asarray(lengths, np.int64)
    if len(lengths) and (lengths.max() > capacity.tokens or lengths.max() ** 2 > capacity.attention or capacity.documents < 1):
        raise ValueError("an item is larger than a bin")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins, n = _Bins(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        found = open_bins.best(size)
        if found is None:
            b, r, state = n, capacity.tokens, (capacity.documents, capacity.attention)
            n += 1
        else:
            r, state = found
            b = open_bins.take(r, state)
        bins[i], offsets[i] = b, capacity.tokens - r
        if r > size:
            open_bins.put(b, r - size, (state[0] - 1, state[1] - size * size))
    return bins, offsets
