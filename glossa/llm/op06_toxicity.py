"""Query op6: toxicity by class-conditional Kneser-Ney models with shared backoff counts.

Class counts come from a bounded sample of labelled rows, the shared counts they back off to from every word of every
document. The driver gets a row for each word of the sample, and there are no more than it holds.

Nothing but learning rows decides anything: the discount and the calibration's ridge are those that foretell them best,
each row scored by models that its own words are taken out of (ngrams.left_out). Rows weigh as many as their class has
for each one sampled.

Defined results: null texts are empty and score as no words do; rows that repeat an id with one text are learnt from
once, and score alike; of several labels of one id the highest counts; null ids aren't learnt from; without documents
or labels of both classes the score is one constant. Samples and sums don't depend on the order of rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.llm import logistic, ngrams
from glossa.llm.common import discard, documents, labelled_sample, materialise, release, remainder, table

#: Labelled rows of each class that the class counts and the calibration may use; the shared counts take every document.
SAMPLE = 4_000
#: Discounts to choose from, beside the one that the counts of counts give: what so many documents of a class say is left to the shared counts.
WHOLE = (1.0, 2.0, 3.0)
RIDGES = (0.1, 1.0, 10.0)


@dataclass
class Model:
    ratios: ngrams.Ratios
    calibration: logistic.Logistic
    discounts: tuple[float, float]


class _Words:
    """Numbers of words, remembered by the worker up to a bound."""

    def __init__(self, most: int = 200_000):
        self.most, self.at, self.words = most, {}, []

    def places(self, words: list[str]) -> list[int]:
        if len(self.at) > self.most:
            self.at, self.words = {}, []
        at = self.at
        out = []
        for w in words:
            i = at.get(w)
            if i is None:
                i = at[w] = len(at)
                self.words.append(w)
            out.append(i)
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label; -1: none) to the documents of a partition, by label, that hold each word; sums so far are given out when they are many."""
    release()
    counts: dict[int, Counter] = {-1: Counter(), 0: Counter(), 1: Counter()}

    def flush() -> Iterator[pa.RecordBatch]:
        words = list(dict.fromkeys([*counts[-1], *counts[0], *counts[1]]))
        if words:
            hashes = [[h(w) for w in words] for h in (ngrams.stem_hash, ngrams.word_hash)]
            n = [[counts[c].get(w, 0) for w in words] for c in (0, 1, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*hashes, *n)], ["stem", "word", "n0", "n1", "n"])
        for c in counts.values():
            c.clear()

    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
            counts[label].update(set(ngrams.words_of(text.as_py())))
        if sum(map(len, counts.values())) > 150_000:
            yield from flush()
    yield from flush()
    release()


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, sample: int = SAMPLE) -> Model:
    """The model of docs (doc_id, text without nulls) and labels (doc_id, toxic). What is counted is shuffled as (word, counts) sums of each partition."""
    learn = materialise(labelled_sample(docs, labels, "toxic", modulus, held_out, sample).select("text", "label", "place"), "learn")
    known = count_words(docs, learn)
    choices = [(ngrams.estimated(known.n[0]), ngrams.estimated(known.n[1])), *((d, d) for d in WHOLE)]
    rows = _columns(learn.mapInArrow(_left_out(known, choices), "label int, place int, choice int, " + FEATURES))
    weight = _class_weights(labels, learn, modulus, held_out)
    order = np.lexsort((rows["label"], rows["place"], rows["choice"]))
    rows = {k: v[order] for k, v in rows.items()}

    def learnt_from(i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, labels and weights at choice i."""
        own = rows["choice"] == i
        y = rows["label"][own].astype(float)
        return np.column_stack([rows[c][own] for c in NAMES]).astype(float), y, np.where(y == 1, weight[1], weight[0])

    def loss(i: int, ridge: float) -> float:
        x, y, w = learnt_from(i)
        return logistic.held_out_loss(x, y, ridge, w)

    best, ridge = min(((i, ridge) for i in range(len(choices)) for ridge in RIDGES), key=lambda c: loss(*c))
    x, y, w = learnt_from(best)
    model = Model(ngrams.fit(known, choices[best]), logistic.fit(x, y, ridge, weight=w), choices[best])
    discard(learn)
    release()
    return model


def count_words(docs: DataFrame, learn: DataFrame) -> ngrams.Counts:
    """Documents that hold each word, by class of the learning rows (text, label) and over all of docs (text)."""
    every = docs.select("text", F.lit(-1).alias("label")).unionByName(learn.select("text", "label"))
    counted = every.mapInArrow(_count, "stem long, word long, n0 long, n1 long, n long")
    words = materialise(counted.groupBy("word").agg(F.min("stem").alias("stem"), *(F.sum(c).alias(c) for c in ("n0", "n1", "n"))), "words")
    stems = words.groupBy("stem").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.max((F.col("n0") + F.col("n1") > 0)).alias("said"))
    stems = materialise(stems, "stems")
    kinds = stems.agg(F.sum("kinds")).first()[0] or 0
    narrow = [F.col(c).cast("int").alias(c) for c in ("n0", "n1")]
    s = _columns(stems.where("said").select("stem", "n", "kinds"))
    w = _columns(words.where("n0 + n1 > 0").select("word", "stem", *narrow, F.col("n").cast("float").alias("n")))
    discard(words, stems)
    found = ngrams.counts(s, w, float(kinds))
    del s, w
    release()
    return found


def _columns(rows: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a bounded table, one after another: nothing is held twice."""
    table = rows.toArrow()
    out = {}
    for name in table.column_names:
        out[name] = table.column(name).to_numpy()
        table = table.drop_columns([name])
    return out


def _class_weights(labels: DataFrame, learn: DataFrame, modulus: int, held_out: int) -> dict[int, float]:
    """How many labelled learning rows each sampled one stands for, by class; 1 at least for the rarer class."""
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (remainder("doc_id", modulus) != held_out))
    every = {int(r[0] > 0): int(r[1]) for r in rows.groupBy("doc_id").agg(F.max("label").alias("label")).groupBy("label").count().collect()}
    taken = {int(r[0]): int(r[1]) for r in learn.groupBy("label").count().collect()}
    share = {c: every.get(c, 0) / max(1, taken.get(c, 0)) for c in (0, 1)}
    least = min((v for v in share.values() if v > 0), default=1.0)
    return {c: (v or least) / least for c, v in share.items()}


NAMES = ["mean", "window", "top", "evidence", "share"]
FEATURES = ", ".join(f"{n} double" for n in NAMES)


def _vectors(ratios: ngrams.Ratios):
    release()
    seen, known = _Words(), [np.zeros(0)]

    def of(text: str) -> np.ndarray:
        places = np.array(seen.places(ngrams.words_of(text)), np.int64)
        if len(seen.words) < len(known[0]):
            known[0] = np.zeros(0)
        if len(seen.words) > len(known[0]):
            known[0] = np.concatenate([known[0], ratios.of(seen.words[len(known[0]) :])])
        return ngrams.features(known[0][places])

    return of


def _left_out(known: ngrams.Counts, choices: list[tuple[float, float]]):
    """Learning rows (text, label, place) to their features for each choice of discounts, without their own words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        every = [(ngrams.sums(known, 0, d[0]), ngrams.sums(known, 1, d[1])) for d in choices]
        for batch in batches:
            rows, x = [], []
            for text, label, place in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "place")), strict=True):
                words = ngrams.words_of(text)
                different = list(dict.fromkeys(words))
                at = {w: i for i, w in enumerate(different)}
                order = np.array([at[w] for w in words], np.int64)
                places = known.places(different)
                for i, both in enumerate(every):
                    rows.append((label, place, i))
                    x.append(ngrams.features(ngrams.left_out(known, both, places, label)[order]))
            keys = [pa.array(c, pa.int32()) for c in (zip(*rows, strict=True) if rows else [()] * 3)]
            yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, np.array(x).reshape(-1, len(NAMES)).T)], ["label", "place", "choice", *NAMES])
        release()

    return run


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with the score, 0 to 1, as column `name` (replaced, if there is one); all rows and other columns stay."""
    kept = docs.drop(name)
    order = kept.columns
    at = order.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _vectors(model.ratios)
        for batch in batches:
            x = np.array([of(t.as_py() or "") for t in batch.column(at)]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.calibration.score(x))], [*order, name])
        release()

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())]))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents; the cases are those of this module."""
    docs = documents(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("long"))
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
