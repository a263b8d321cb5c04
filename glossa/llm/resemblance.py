"""Near copies by resemblance: texts whose sets of word shingles have a Jaccard similarity of at least 4/5.

Ball hashing comes first: SimHash fingerprints of the sets within two bits give candidates (op05_simhash.links). Sets of
similarity 4/5 may well differ in ten bits, though, beyond any ball that could be emitted. So sets also meet in buckets:
BANDS hashes, each of DEPTH least values of the set under as many functions. Two sets of similarity 4/5 share none of
their buckets with a probability of 0.00003, more similar ones with less. Every candidate is settled by its whole sets:
nothing is linked by an estimate.

A bucket of a large group of near copies would make pairs by the square of its size. So each bucket first links its sets
to two leaders, other ones in each bucket; candidates are at most two a row, whatever the buckets' sizes. Buckets that
still hold several groups do so once more with other leaders. All pairs of different groups of those that then still hold
several are looked at, in cells of bounded size that are dealt over the cluster: no link between sets that share a bucket
is lost, whatever the input's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import discard, hot_join, materialise, release
from glossa.llm.components import components
from glossa.llm.simhash import links, majority

#: Buckets of a set, and least values that one is made of.
BANDS, DEPTH = 20, 4
#: All pairs of a bucket are looked at in cells of at most about 512 * PAIRS rows on a side (1 at least).
PAIRS = 4
NONE = -(1 << 63)
FACTORS = np.random.RandomState(1).randint(0, 1 << 63, BANDS * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, size: int = 5) -> np.ndarray:
    """The sorted different hashes of the text's runs of `size` words; a shorter text is one run, one of no words has none."""
    words = text.encode().lower().split()  # bytes, as for op5's fingerprints
    n = len(words)
    if n <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if n else [], np.uint64).view(np.int64)
    numbers = {w: xxhash.xxh64_intdigest(w, 42) for w in set(words)}
    w = np.fromiter(map(numbers.__getitem__, words), np.uint64, n)
    h = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        h = (h ^ w[i : n - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return np.unique(h.view(np.int64))


def buckets(found: np.ndarray) -> np.ndarray:
    """BANDS hashes of a set: of each DEPTH of its least values under multiplications by odd numbers. An empty set has none."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    h = found.view(np.uint64)
    for i in range(0, len(h), 4096):  # bounds the products of very long texts
        least = np.minimum(least, (h[i : i + 4096, None] * FACTORS).min(axis=0))
    bands = least.reshape(BANDS, DEPTH)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(bands)], np.uint64).view(np.int64)


def parities(found: np.ndarray) -> np.ndarray:
    """16 words of bits: in how many shingles of each remainder a set has, odd or even. Two sets differ in as many shingles, at least, as their bits do."""
    return np.packbits((np.bincount(found & 1023, minlength=1024) & 1).astype(np.uint8)).view(np.int64)


def _hashed(docs: DataFrame) -> DataFrame:
    """Texts with what names a row without shuffling its text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("at"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))


def near_copies(docs: DataFrame, size: int = 5, radius: int = 2) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable by pairs of similarity 4/5 (the module says which may be lost): a row for each row of docs.

    Null texts are empty; texts without words are copies of each other. A row without an id is no group's name unless
    there is no other (then the name is null). Rows of one id and different texts are different texts. No rows: no rows.
    """
    return classes(docs, size, radius).select(F.when(F.col("at") != NONE, F.col("at")).alias("doc_id"), "component_id")


def classes(docs: DataFrame, size: int = 5, radius: int = 2) -> DataFrame:
    """(at, hash, component_id, component_hash) of each row: the id (NONE for a null one) and text hash of itself and of its group's first row."""
    texts = _hashed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), size) for t in batch.column("text")]
            keys = np.array([xxhash.xxh64_intdigest(s.tobytes(), 1) for s in sets], np.uint64).view(np.int64)
            prints = np.array([majority(s.view(np.uint64)) for s in sets], np.uint64).view(np.int64)
            bands = pa.array([buckets(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("hash"), pa.array(keys), pa.array(prints), pa.array(list(map(len, sets)), pa.int64()), bands], ["at", "hash", "key", "fp", "size", "bands"])
        release()

    found = materialise(texts.mapInArrow(run, "at long, hash long, key long, fp long, size long, bands array<long>"), "sets")
    rows = found.select("at", "hash", "key")
    # One row for each different set; its other columns are the set's own, whichever row they are of.
    own = materialise(found.groupBy("key").agg(F.min(F.struct("at", "hash")).alias("own"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands")).select("key", "own.*", "fp", "size", "bands"), "own")

    # The ball: the first set of each fingerprint with the others, and with that of each fingerprint it is linked to.
    heads = materialise(own.groupBy("fp").agg(F.min("key").alias("head"), F.count("*").alias("n")), "heads")
    total = own.count()
    same = hot_join(own.select("fp", "key"), heads, ["fp"], "n", total).select(F.col("key").alias("a"), F.col("head").alias("b"))
    near = links(heads, radius).join(heads.select(F.col("fp").alias("a"), F.col("head").alias("h1")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("h2")), "b")
    ball = same.union(near.select(F.col("h1").alias("a"), F.col("h2").alias("b")))

    # Buckets that several sets share.
    spread = own.select("key", F.explode("bands").alias("band"))
    met = materialise(_led(spread, total * BANDS, 0), "met")
    candidates = materialise(ball.union(_pairs(met, "lead")).union(_pairs(met, "trail")).where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                held = [shingles(t.as_py(), size) for t in part.column("text")]
                # 32 bits of each hash are enough to count with: a set's equal ones are told apart by how often they stand there.
                narrow = [np.sort(h.view(np.uint64).astype(np.uint32).view(np.int32)) for h in held]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([len(h) for h in held], pa.int64()), pa.array([n.tobytes() for n in narrow], pa.binary()), pa.array([parities(h) for h in held], pa.list_(pa.int64()))], ["key", "size", "held", "bits"])
        release()

    keys = candidates.select(F.col("a").alias("key")).union(candidates.select("b")).union(met.select("key")).distinct()
    needed = own.join(keys, "key", "left_semi").select("key", "at", "hash")
    once = texts.join(needed, ["at", "hash"]).dropDuplicates(["at", "hash"])
    sets = materialise(once.select("key", "text").mapInArrow(whole, "key long, size long, held binary, bits array<long>"), "held")

    def settled(pairs: DataFrame) -> DataFrame:
        """Of pairs of sets a and b, those of similarity 4/5. Whole sets are read only for pairs that an upper bound lets through."""
        for side in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("key").alias(side), F.col("bits").alias(f"bits_{side}"), F.col("size").alias(f"size_{side}")), side)
        pairs = materialise(pairs.where(_maybe("_a", "_b")).select("a", "b", "size_a", "size_b"), "pairs")
        for side in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("key").alias(side), F.col("held").alias(f"held_{side}")), side)
        return pairs.select("a", "b", "size_a", "size_b", "held_a", "held_b").mapInArrow(_alike, "a long, b long")

    def grouped(named: DataFrame, edges: DataFrame) -> DataFrame:
        """Groups after these links between groups."""
        if edges.isEmpty():
            return named
        joined = components(edges).select(F.col("node").alias("group"), "component")
        return materialise(named.join(joined, "group", "left").select("key", F.coalesce("component", "group").alias("group")), "groups")

    named = materialise(keys.select("key", F.col("key").alias("group")), "groups")
    named = grouped(named, materialise(settled(candidates), "alike"))
    def mixed(named: DataFrame) -> DataFrame | None:
        """(band, rows, key, group) of buckets that hold several groups; rows: how many the bucket has."""
        each = met.select("band", "key").join(named, "key")
        ends = each.groupBy("band").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("n")).where("low <> high")
        ends = materialise(ends.select("band", "n", F.col("n").alias("rows")), "mixed-bands")
        return None if ends.isEmpty() else materialise(hot_join(each, ends, ["band"], "n", total * BANDS), "mixed")

    def closer(named: DataFrame, pairs: DataFrame) -> DataFrame:
        """Groups after these pairs, of which those of different groups are settled."""
        group = lambda side: named.select(F.col("key").alias(side), F.col("group").alias(f"group_{side}"))
        more = pairs.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(candidates, ["a", "b"], "left_anti")
        more = materialise(more.join(group("a"), "a").join(group("b"), "b").where("group_a <> group_b").select("a", "b"), "more")
        edges = settled(more).join(group("a"), "a").join(group("b"), "b").select(F.col("group_a").alias("a"), F.col("group_b").alias("b"))
        return grouped(named, materialise(edges.distinct(), "alike"))

    # Once more for buckets that hold several groups, then all pairs of those that still do.
    several = mixed(named)
    if several is not None:
        again = materialise(_led(several.select("key", "band"), total * BANDS, 1), "met")
        named = closer(named, _pairs(again, "lead").union(_pairs(again, "trail")))
        several = mixed(named)
    if several is not None:
        named = closer(named, every_pair(several.join(sets.select("key", "size", "bits"), "key")))
    discard(sets, met)
    every = rows.join(own.select("key").join(named, "key", "left").select("key", F.coalesce("group", "key").alias("group")), "key")
    every = materialise(every, "every")
    leaders = every.where(F.col("at") != NONE).groupBy("group").agg(F.min(F.struct("at", "hash")).alias("leader"), F.count("*").alias("n"))
    nameless = every.select("group").distinct().join(leaders, "group", "left_anti").select("group", F.lit(None).cast("struct<at:long,hash:long>").alias("leader"), F.lit(0).cast("long").alias("n"))
    told = hot_join(every, leaders.select("group", "leader", "n").union(nameless), ["group"], "n", every.count())
    return told.select("at", "hash", F.col("leader.at").alias("component_id"), F.col("leader.hash").alias("component_hash"))


def _led(spread: DataFrame, total: int, salt: int) -> DataFrame:
    """(key, band) rows of buckets with several rows, with the two leaders of each bucket: those of the least and the greatest hash of key, bucket and salt."""
    mark = F.struct(F.xxhash64("key", "band", F.lit(salt)).alias("_"), F.col("key").alias("key"))
    leaders = spread.groupBy("band").agg(F.min(mark).alias("lead"), F.max(mark).alias("trail"), F.count("*").alias("n")).where("n > 1")
    leaders = materialise(leaders.select("band", F.col("lead.key").alias("lead"), F.col("trail.key").alias("trail"), "n"), "leaders")
    return hot_join(spread, leaders, ["band"], "n", total).select("key", "band", "lead", "trail")


def _pairs(met: DataFrame, leader: str) -> DataFrame:
    return met.select(F.col("key").alias("a"), F.col(leader).alias("b"))


def _maybe(a: str, b: str) -> Column:
    """Whether two sets, whose columns end with a and b, may have a similarity of 4/5 by the shingles that one alone has, as far as parities tell."""
    unlike = sum((F.bit_count(F.col(f"bits{a}")[i].bitwiseXOR(F.col(f"bits{b}")[i])) for i in range(16)), F.lit(0))
    return 9 * unlike <= F.col(f"size{a}") + F.col(f"size{b}")


def every_pair(rows: DataFrame) -> DataFrame:
    """(a, b) of all rows (band, rows, key, group, size, bits) of a band that have different groups and may be of similarity 4/5, each once.

    A band of many rows is a square of cells; a row goes to the cells of its line on one side and of its column on the other.
    """
    cells = F.ceil(F.col("rows") / max(1, 512 * PAIRS)).cast("int")
    own, all_ = F.pmod(F.xxhash64("key"), cells).cast("int"), F.explode(F.sequence(F.lit(0), cells - 1))
    side = lambda x: [F.col(c).alias(f"{c}{x}") for c in ("key", "group", "size", "bits")]
    low = rows.select("band", own.alias("i"), all_.alias("j"), *side("_a"))
    high = rows.select("band", all_.alias("i"), own.alias("j"), *side("_b"))
    sizes = (5 * F.col("size_a") >= 4 * F.col("size_b")) & (5 * F.col("size_b") >= 4 * F.col("size_a"))
    met = (low["band"] == high["band"]) & (low["i"] == high["i"]) & (low["j"] == high["j"]) & (F.col("group_a") < F.col("group_b")) & sizes & _maybe("_a", "_b")
    return low.join(high, met).select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays share, repeats counted as often as both have them."""
    if len(a) > len(b):
        a, b = b, a
    _, first, times = np.unique(a, return_index=True, return_counts=True)
    values = a[first]
    there = np.searchsorted(b, values, "right") - np.searchsorted(b, values, "left")
    return int(np.minimum(times, there).sum())


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, size_a, size_b, held_a, held_b) to those whose sets have a similarity of 4/5."""
    for batch in batches:
        kept = []
        columns = (batch.column(c) for c in ("size_a", "size_b", "held_a", "held_b"))
        for i, (n, m, x, y) in enumerate(zip(*columns, strict=True)):
            both = common(np.frombuffer(x.as_py(), "<i4"), np.frombuffer(y.as_py(), "<i4"))
            if 9 * both >= 4 * (n.as_py() + m.as_py()):
                kept.append(i)
        yield batch.take(pa.array(kept, pa.int64())).select(["a", "b"])
