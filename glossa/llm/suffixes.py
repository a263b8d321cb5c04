"""Content-chosen suffixes of byte strings, and what decides which 200-byte strings repeat.

A string W of `length` bytes is named by the suffix that starts at its designated place: the least (hash of the next
eight bytes, leftmost) of its first `window` places. The place depends on W alone, so equal strings have the same one.
A document's starts fall into runs [low, high] with one place each, a suffix entry:

    near   fingerprint of the bytes from the place on that every string named there has (length - window + 1)
    whole  fingerprint of [low, high + length) and of the place in it: everything that names a string there

Strings can repeat only where near repeats, and all strings of a run repeat where whole does. What is left, runs whose
near repeats and whose whole doesn't, is compared string by string. Fingerprints are 64-bit polynomials over mixed
eight-byte words; entries are only equal if near and whole both are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

LENGTH, WINDOW, GRAM = 200, 160, 8
BASE = 0x9E3779B97F4A7C15 | 1
MIX = np.uint64(0xD6E8FEB86659FD93)
SECOND = np.uint64(0xA24BAED4963EE407)


@lru_cache(maxsize=4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, 2**bits of each."""
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for b in (BASE, inverse):
        p = np.full(1 << bits, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(18, int(n).bit_length()))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * SECOND
    return x ^ (x >> np.uint64(32))


class Hashed:
    """Rolling fingerprints of one byte string."""

    def __init__(self, data: bytes):
        n = len(data) - GRAM + 1
        words = np.ndarray((n,), "<u8", data, strides=(1,))
        self.words = mixed(words.astype(np.uint64))
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.words * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprints of [start, end), at least eight bytes each."""
        return mixed((self.sums[end - GRAM + 1] - self.sums[start]) * self.down[start])


@dataclass
class Entries:
    low: np.ndarray
    high: np.ndarray
    near: np.ndarray
    whole: np.ndarray


def entries(data: bytes, length: int = LENGTH, window: int = WINDOW) -> Entries:
    """The suffix entries of one document, by place. Fewer than `length` bytes: none."""
    starts = len(data) - length + 1
    if starts <= 0:
        none = np.zeros(0, np.int64)
        return Entries(none, none, none, none)
    hashed = Hashed(data)
    n = starts + window - 1
    least = (hashed.words[:n] & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    span = 1
    while 2 * span <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if window > span:
        least = np.minimum(least[: span - window], least[window - span :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    low = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    high = np.append(low[1:], starts) - 1
    place = place[low]
    near = hashed.of(place, place + (length - window + 1))
    shape = ((place - low) * 1024 + (high - low)).astype(np.uint64)
    return Entries(low, high, near.view(np.int64), mixed(hashed.of(low, high + length) ^ mixed(shape)).view(np.int64))


def repeated_starts(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each context, a mask of its starts whose string of `length` bytes also starts elsewhere in these contexts. Contexts of equal bytes must be one."""
    if not contexts:
        return []
    sizes = np.array([len(c) for c in contexts])
    hashed = Hashed(b"".join(contexts))
    counts = sizes - length + 1
    offsets = np.cumsum(sizes) - sizes
    before = np.cumsum(counts) - counts
    starts = np.repeat(offsets - before, counts) + np.arange(counts.sum())
    order = np.argsort(hashes := hashed.of(starts, starts + length), kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    found = np.zeros(len(starts), bool)
    found[order[1:]] |= same
    found[order[:-1]] |= same
    return np.split(found, np.cumsum(counts)[:-1])


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
