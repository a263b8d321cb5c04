"""Query op3: every byte of a 200-byte string that also starts elsewhere is removed, by a logarithmic index family.

Suffix entries (suffixes.py) of a batch of documents are sorted into a run: the batch's suffix array, cut at the depth
that decides about long matches and ordered by that prefix's fingerprint. A run holds one row for each key with its
count, so copies cost no more than their keys. Each new run is merge-scanned against the existing levels, which gives
the keys of its long matches with earlier batches; those within the batch are the run's own repeated keys. Then the run
joins the family, where levels of equal size merge, so that n batches make at most log2(n) + 1 levels and each key is
written that often. Runs and levels are bucketed and sorted by key: scans and merges shuffle nothing.

The entries of matched keys are then settled by whole strings. Keys that a large share of all entries have are joined by
broadcast (hot_join), so that no task gets all copies of one passage.

Defined results: null texts are empty; texts under 200 bytes lose nothing; rows of equal id and text are different
places (each repeats the other) and get the same result; null ids are kept; other columns are left out; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.common import bucketed, discard, documents, hot_join, materialise
from glossa.llm.suffixes import LENGTH, Entries, entries, repeated_starts, runs

KEY = ["doc_id", "text_hash"]
#: Least number of batches that the index family is fed, and most entries of one: the number of batches follows the input.
BATCHES, BATCH_ENTRIES = 8, 1 << 34
#: Groups of more undecided entries than this are compared by strings dealt over the cluster, not in one task.
CROWD = 5_000
#: Bytes of contexts that one task compares at a time.
AT_ONCE = 1 << 20


def suffix_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, entry, near, whole) of each document of (doc_id, text_hash, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [entries(t.as_buffer().to_pybytes()) for t in batch.column("text").cast(pa.binary())]
            sizes = np.array([len(e.low) for e in found], np.int64)
            if not sizes.sum():
                continue
            which = pa.array(np.repeat(np.arange(len(found)), sizes))
            entry = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
            near, whole = (np.concatenate([getattr(e, k) for e in found]) for k in ("near", "whole"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(which), batch.column("text_hash").take(which), *map(pa.array, (entry, near, whole))], [*KEY, "entry", "near", "whole"])

    return docs.select(*KEY, "text").mapInArrow(run, "doc_id long, text_hash long, entry int, near long, whole long")


class IndexFamily:
    """Levels of (near, n, least, most): a key, how many suffixes have it, and the range of their wholes."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []

    @staticmethod
    def run(suffixes: DataFrame) -> DataFrame:
        """A batch's suffixes as a sorted run."""
        return bucketed(suffixes.groupBy("near").agg(F.count("*").alias("n"), F.min("whole").alias("least"), F.max("whole").alias("most")), "run", "near")

    @staticmethod
    def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.join(b.toDF("near", "n2", "least2", "most2"), "near", "full_outer")
        n = F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))
        return both.select("near", n.alias("n"), F.least("least", "least2").alias("least"), F.greatest("most", "most2").alias("most"))

    def scan(self, run: DataFrame) -> DataFrame:
        """(near) of the run's keys that an existing level holds: its long matches with earlier batches."""
        found = run.select("near").limit(0)
        for _, level in self.levels:
            found = found.union(run.join(level, "near", "left_semi").select("near"))
        return found

    def add(self, run: DataFrame) -> None:
        """Take in a run and merge levels of equal size."""
        self.levels.append((0, run))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (_, a), (level, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((level + 1, bucketed(self._merged(b, a), "level", "near")))
            discard(a, b)

    def entries(self) -> DataFrame | None:
        """One row for each key of all levels."""
        if not self.levels:
            return None
        rows = self.levels[0][1]
        for _, more in self.levels[1:]:
            rows = self._merged(rows, more)
        return rows


def matched_keys(rows: DataFrame, batches: int) -> DataFrame:
    """(near, n, several) of the keys that several of the entries (batch, near, whole) have: several is whether their wholes differ. Batches come one after another."""
    family, matched = IndexFamily(), None
    for i in range(batches):
        run = family.run(rows.where(F.col("batch") == i))
        found = materialise(family.scan(run).union(run.where(F.col("n") > 1).select("near")), "matched")
        matched = found if matched is None else matched.union(found)
        family.add(run)
    keys = family.entries().join(matched.distinct(), "near", "left_semi").select("near", "n", (F.col("least") != F.col("most")).alias("several"))
    keys = materialise(keys, "keys")
    discard(matched, *(level for _, level in family.levels))
    return keys


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, text, wanted) to a row for each wanted entry: near, single, crowded, its low start and its bytes."""
    for batch in batches:
        out: list[tuple] = []
        for doc_id, key, text, wanted in zip(*(batch.column(c) for c in (*KEY, "text", "wanted")), strict=True):
            data = text.cast(pa.binary()).as_buffer().to_pybytes()
            e = entries(data)
            out += [(doc_id.as_py(), key.as_py(), w["near"], w["single"], w["crowded"], int(e.low[w["entry"]]), data[e.low[w["entry"]] : e.high[w["entry"]] + LENGTH]) for w in wanted.as_py()]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 7, kinds, strict=True)], [*KEY, "near", "single", "crowded", "low", "context"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by near to intervals (doc_id, text_hash, start, end) of the single entries' repeated strings. Whole groups are compared at a time."""
    held: list[tuple] = []
    size = 0

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        out = []
        for row, mask in zip(rows, repeated_starts([r[5] for r in rows]), strict=True):
            if row[3] and mask.any():
                out += [(row[0], row[1], row[4] + a, row[4] + b - 1 + LENGTH) for a, b in zip(*(x.tolist() for x in runs(mask)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], [*KEY, "start", "end"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in (*KEY, "near", "single", "low", "context")), strict=True):
            if size > AT_ONCE and row[2] != held[-1][2]:
                yield from flush(held)
                held, size = [], 0
            held.append(row)
            size += len(row[5])
    yield from flush(held)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each string of each context: two digests, and its place."""
    for batch in batches:
        out: list[tuple] = []
        for doc_id, key, single, low, context in zip(*(batch.column(c).to_pylist() for c in (*KEY, "single", "low", "context")), strict=True):
            for i in range(len(context) - LENGTH + 1):
                d = hashlib.blake2b(context[i : i + LENGTH], digest_size=16).digest()
                out.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), doc_id, key, low + i, single))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], ["d1", "d2", *KEY, "start", "single"])


def repeats(docs: DataFrame, batches: int | None = None, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, text_hash, text): the entries all of whose strings repeat (doc_id, text_hash, entry), and the intervals of other repeated strings (doc_id, text_hash, start, end). Repeated rows may give repeated rows."""
    rows = suffix_rows(docs).withColumn("draw", F.pmod(F.hash(*KEY), F.lit(1 << 16)))
    rows = materialise(rows, "suffixes")
    total = rows.count()
    batches = batches or max(BATCHES, -(-total // BATCH_ENTRIES))
    keys = matched_keys(rows.withColumn("batch", F.col("draw") % batches), batches)
    hits = materialise(hot_join(rows.drop("draw"), keys, ["near"], "n", total), "hits")
    discard(rows, keys)
    wholes = materialise(hits.where("several").groupBy("near", "whole").agg(F.count("*").alias("copies"), F.min(F.struct(*KEY, "entry")).alias("one")), "wholes")
    again = hot_join(hits.where("several"), wholes.where(F.col("copies") > 1).select("near", "whole", "copies"), ["near", "whole"], "copies", total)
    full = hits.where(~F.col("several")).select(*KEY, "entry").union(again.select(*KEY, "entry"))
    crowds = wholes.groupBy("near").agg(F.count("*").alias("n")).select("near", (F.col("n") > crowd).alias("crowded"))
    wanted = wholes.join(crowds.where("crowded"), "near", "left").select("one.*", "near", (F.col("copies") == 1).alias("single"), F.coalesce("crowded", F.lit(False)).alias("crowded"))
    by_doc = wanted.groupBy(*KEY).agg(F.collect_set(F.struct("entry", "near", "single", "crowded")).alias("wanted"))
    contexts = materialise(_with(docs.select(*KEY, "text").distinct(), by_doc, ["wanted"], "inner").mapInArrow(_contexts, "doc_id long, text_hash long, near long, single boolean, crowded boolean, low int, context binary"), "contexts")
    few = contexts.where("NOT crowded").drop("crowded").repartition("near").sortWithinPartitions("near").mapInArrow(_compared, "doc_id long, text_hash long, start int, end int")
    strings = materialise(contexts.where("crowded").mapInArrow(_strings, "d1 long, d2 long, doc_id long, text_hash long, start int, single boolean"), "strings")
    twice = strings.groupBy("d1", "d2").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    many = hot_join(strings.where("single"), twice, ["d1", "d2"], "n", total).select(*KEY, "start", (F.col("start") + LENGTH).alias("end"))
    return full, few.union(many)


def _with(docs: DataFrame, other: DataFrame, columns: list[str], how: str) -> DataFrame:
    same = docs["doc_id"].eqNullSafe(other["doc_id"]) & (docs["text_hash"] == other["text_hash"])
    return docs.join(other, same, how).select(*[docs[c] for c in docs.columns], *[other[c] for c in columns])


def covered(data: bytes, full: list[int], starts: list[tuple[int, int]]) -> np.ndarray:
    """A mask of the removed bytes."""
    change = np.zeros(len(data) + 1, np.int32)
    if full:
        e: Entries = entries(data)
        np.add.at(change, e.low[full], 1)
        np.add.at(change, e.high[full] + LENGTH, -1)
    if starts:
        pairs = np.array(starts)
        np.add.at(change, pairs[:, 0], 1)
        np.add.at(change, pairs[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, full, parts in zip(batch.column("text").cast(pa.binary()), batch.column("full").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            data = text.as_buffer().to_pybytes()
            if not full and not parts:
                out.append((len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                continue
            mask = covered(data, full or [], [(p["start"], p["end"]) for p in parts or []])
            kept = np.frombuffer(data, np.uint8)[~mask].tobytes()
            out.append((len(data), len(data) - len(kept), len(runs(mask)[0]), hashlib.sha256(kept).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, batches: int | None = None, crowd: int = CROWD) -> DataFrame:
    """A row for each row of (doc_id, text): sizes, spans and the digest of what is kept."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    full, parts = repeats(docs, batches, crowd)
    found = full.select(*KEY, "entry", F.lit(None).cast("struct<start:int,end:int>").alias("part")).union(parts.select(*KEY, F.lit(None).cast("int"), F.struct("start", "end")))
    by_doc = found.groupBy(*KEY).agg(F.collect_set("entry").alias("full"), F.collect_set("part").alias("parts"))
    return _with(docs, by_doc, ["full", "parts"], "left").select("doc_id", "text", "full", "parts").mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents; the cases are those of this module."""
    return remove_repeats(documents(spark, sf_dir))
