"""SimHash fingerprints of 64 bits, and links between those a few bits apart by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(text: str, size: int = 3) -> int:
    """Bits set in over half of the hashes of the text's shingles, repeats included; 0 for a text of no words."""
    words = text.encode().lower().split()  # bytes: A-Z and the six ASCII blanks only
    n = len(words)
    if n == 0:
        return 0
    if n <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[: n - size + 1].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of these 64-bit hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounds the unpacked bits of very long texts
        ones += np.unpackbits(hashes[i : i + (1 << 16)].byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def masks(radius: int) -> list[int]:
    """All signed 64-bit masks of at most `radius` bits."""
    found = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) between different fingerprints (fp) that connect all those at most `radius` bits apart (radius even).

    Every fingerprint emits the variants within half the radius: two fingerprints are within the radius exactly if
    they share one. What shares a variant is within the radius of each other, so the smallest fingerprint of a variant
    stands for all: an edge to it from each of the others loses no connection. A variant has at most as many
    fingerprints as there are masks, whatever the number of copies: copies have one fingerprint. Rows are dealt anew
    before they are multiplied, as the table may be a few files.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    variants = distinct.select("fp").repartition(tasks, "fp").select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m).cast("long")) for m in masks(radius // 2)])).alias("variant"))
    met = variants.groupBy("variant").agg(F.collect_set("fp").alias("met")).where(F.size("met") > 1)
    edges = met.select(F.array_min("met").alias("b"), F.explode("met").alias("a")).where(F.col("a") != F.col("b"))
    return edges.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
