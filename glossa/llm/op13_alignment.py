"""Query op13: tokens of two tokenizers aligned over the same bytes, with corpus-wide counts of linked ids.

Each document is cut and aligned once (alignment.py) and written with its different pairs of linked ids and how often
each occurs. Pairs are counted in each task, then over the corpus. There are no more pairs than the two vocabularies
allow, but that bound is large: so the counts are sent to the tasks in slices of a checked number of pairs, one after
another, and every slice adds its part to a document's sums.

Defined results: a row for each row, repeats and null ids included, and each of them counts as a document; null and empty
texts, and those whose tokens don't give the bytes back, have zeros and an empty groups_sha256; other columns are left
out; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.llm.alignment import Aligner, PieceTokens, packed, packed_rising, unpacked, unpacked_rising, vocabularies
from glossa.llm.common import documents, materialise

#: Pairs in a slice of the counts: 13 bytes each in every task.
SLICE = 4_000_000
#: Pairs that a task holds counts of before it gives them out, and that it takes in at a time.
HELD = 1_000_000
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def linked(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(row, doc_id, COUNTS, groups_sha256, pairs, times) of each text: pairs holds its different pairs of ids, a * width + b, and times how often each is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(paths)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = aligner.documents([t or "" for t in part.column("text").to_pylist()])
                columns = [pa.array([d.counts[i] for d in found], pa.int64()) for i in range(4)]
                columns += [pa.array([d.groups for d in found], pa.string()), pa.array([packed_rising(d.pairs) for d in found], pa.binary()), pa.array([packed(d.times) for d in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *columns], ["row", "doc_id", *COUNTS, "groups_sha256", "pairs", "times"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, f"row long, doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, pairs binary, times binary")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pairs) of documents to (pair, n), the documents that hold each pair; sums so far are given out when they are many."""
    held, n, wait, waiting = np.zeros(0, np.uint32), np.zeros(0, np.int64), [], 0

    def settle() -> None:
        nonlocal held, n, wait, waiting
        keys, times = np.unique(np.concatenate([np.zeros(0, np.uint32), *wait]), return_counts=True)
        both, inverse = np.unique(np.concatenate([held, keys]), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate([n, times]), minlength=len(both)).astype(np.int64)
        held, wait, waiting = both, [], 0

    def given() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.astype(np.int64)), pa.array(n)], ["pair", "n"])

    for batch in batches:
        for data in batch.column("pairs"):
            wait.append(unpacked_rising(data.as_py()))
            waiting += len(wait[-1])
            if waiting > HELD:
                settle()
                if len(held) > HELD:
                    yield given()
                    held, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    settle()
    yield given()


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(pair, n, best) of linked() rows (a pair is a * width + b): how many documents hold a pair, and whether no other pair of its A id is in more."""
    found = rows.select("pairs").mapInArrow(_count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # One A id has no more pairs than B has ids.
    own = Window.partitionBy((F.col("pair") / width).cast("long"))
    return found.select("pair", "n", (F.col("n") == F.max("n").over(own)).alias("best"))


def _slice(counts: DataFrame, i: int, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = (counts if slices == 1 else counts.where(F.pmod(F.xxhash64("pair"), F.lit(slices)) == i)).toArrow()
    pair, n, best = (found.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    return pair[order].astype(np.uint32), n[order], best[order].astype(bool)


def _sums(table: tuple[np.ndarray, np.ndarray, np.ndarray]):
    pair, n, best = table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_best, total = [], []
            for pairs, times in zip(batch.column("pairs"), batch.column("times"), strict=True):
                own, often = unpacked_rising(pairs.as_py()), unpacked(times.as_py()).astype(np.int64)
                at = np.minimum(np.searchsorted(pair, own), max(0, len(pair) - 1))
                known = pair[at] == own if len(pair) else np.zeros(len(own), bool)
                at, often = at[known], often[known]
                n_best.append(int(often[best[at]].sum()))
                total.append(int((often * n[at]).sum()))
            kept = [c for c in batch.schema.names if c not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n_best, pa.int64()), pa.array(total, pa.int64())], [*kept, "n_best", "count_sum"])

    return run


def align_texts(docs: DataFrame, paths: tuple[str, str] | None = None, slice_pairs: int = SLICE) -> DataFrame:
    """(doc_id, COUNTS, n_best, count_sum, groups_sha256) of each text; the cases are those of this module. slice_pairs: counts that a task may hold."""
    paths = paths or vocabularies()
    rows = materialise(linked(docs, paths), "linked")
    counts = materialise(pair_counts(rows, len(PieceTokens(paths[1]).spelt)), "pair-counts")
    slices = max(1, -(-counts.count() // slice_pairs))
    out = ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"]
    if slices == 1:
        whole = rows.select("doc_id", *COUNTS, "groups_sha256", "pairs", "times")
        return whole.mapInArrow(_sums(_slice(counts, 0, 1)), f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, n_best long, count_sum long").select(*out)
    parts = [rows.select("row", "pairs", "times").mapInArrow(_sums(_slice(counts, i, slices)), "row long, n_best long, count_sum long") for i in range(slices)]
    sums = parts[0]
    for part in parts[1:]:
        sums = sums.unionByName(part)
    sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.join(sums, "row").select(*out)


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents; the cases are those of this module."""
    return align_texts(documents(spark, sf_dir))
