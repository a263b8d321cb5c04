"""Query op1: quality by positive-unlabelled learning.

Statistics of every document are written once; trusted positives are a bounded sample of labelled rows, and the
unlabelled risk, the class prior and the calibration are sums over every unlabelled row. Labelled negatives aren't used.

Defined results: null texts are empty and are scored as any other; rows that repeat an id score alike and count each as
unlabelled rows; a text that repeats counts once as a positive; of several labels of one id the highest counts; null ids
are in no sample; without positives or unlabelled rows the score is 0.5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.llm import quality
from glossa.llm.common import discard, documents, labelled_sample, materialise, remainder, table

#: Most trusted positives to learn from.
SAMPLE_LABELLED = 6_000


def _rows(batch: pa.RecordBatch, at: int | str) -> np.ndarray:
    """The statistics of a batch's texts."""
    return np.array([quality.features(t.as_py() or "") for t in batch.column(at)]).reshape(-1, quality.SIZE)


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each row's whole text, as 32-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [r.tobytes() for r in _rows(batch, "text").astype("<f4")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.binary())], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, quality.SIZE).astype(np.float64)


def sums_over(rows: DataFrame) -> quality.Sums:
    """Totals over all rows of (x): a partition gives one vector, and these are added up by place before the driver sees them."""

    def sums(f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = f(np.zeros((0, quality.SIZE)))
            for batch in batches:
                total = total + f(_matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "value"])

        found = rows.select("x").mapInArrow(run, "i long, value double").groupBy("i").agg(F.sum("value").alias("value")).toPandas()
        out = np.zeros(max(len(found), len(f(np.zeros((0, quality.SIZE))))))
        out[found["i"].to_numpy(int)] = found["value"].to_numpy()
        return out

    return sums


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, labelled: int = SAMPLE_LABELLED, known: DataFrame | None = None) -> quality.Model:
    """A model of docs (doc_id, text) and labels (doc_id, quality). `known`: the statistics of docs, where they are there already.

    Unlabelled rows are all documents without a label; held-out rows are among neither. At most `labelled` positives are used.
    """
    learnt = F.col("doc_id").isNotNull() & (remainder("doc_id", modulus) != held_out)
    named = labels.where(F.col("quality").isNotNull()).select("doc_id").distinct()
    rows = statistics(docs) if known is None else known
    unlabelled = materialise(rows.where(learnt).join(named, "doc_id", "left_anti").select("x"), "unlabelled")
    positives = labelled_sample(docs, labels.where(F.col("quality") == 1), "quality", modulus, held_out, labelled)
    x = _matrix(pa.array(statistics(positives).toPandas()["x"], pa.binary()))
    model = quality.fit(x, sums_over(unlabelled))
    discard(unlabelled)
    return model


def score(docs: DataFrame, model: quality.Model, name: str = "score") -> DataFrame:
    """docs with the score, 0 to 1, as column `name` (replaced, if there is one); all rows and other columns stay. Null texts count as empty."""
    kept = docs.drop(name)
    order = kept.columns
    at = order.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(_rows(batch, at)))], [*order, name])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())]))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents, from their statistics, which are written once."""
    docs = documents(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = materialise(statistics(docs), "statistics")
    model = fit(docs, table(spark, sf_dir, "labels"), known=rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch.column("x"))))], ["doc_id", "score"])

    found = rows.mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
