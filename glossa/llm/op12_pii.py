"""Query op12: personal data in texts, by anchor expansion (pii.py)."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import pii
from glossa.llm.common import documents

COUNTS = [f"n_{kind}" for kind in pii.BASE]


def scan_texts(docs: DataFrame) -> DataFrame:
    """doc_id with the counts by base kind, the digest of the base spans and all spans of each whole text.

    A row for each row, repeats and null ids included; null and empty texts have no spans; other columns are left out;
    no rows give no rows. Row-local: no shuffle, one text at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for text in batch.column("text"):
                base, every = pii.scan(text.as_py() or "")
                n = Counter(s[2] for s in base)
                counts.append([n[kind] for kind in pii.BASE])
                digests.append(hashlib.sha256(pii.listed(base).encode()).hexdigest())
                spans.append(pii.listed(every))
            columns = [pa.array(c, pa.int64()) for c in (zip(*counts, strict=True) if counts else [()] * len(COUNTS))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", *COUNTS, "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_sha256 string, spans string")


def mask_texts(docs: DataFrame) -> DataFrame:
    """All rows and columns with the spans in `text` masked by their kinds: null stays null; other columns, of any name, and repeated rows stay as they are."""
    order = docs.columns
    at = order.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x and pii.mask(x, pii.scan(x)[1]) for x in (t.as_py() for t in batch.column(at))]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(order))], order)

    return docs.mapInArrow(run, docs.schema)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents; the cases are those of scan_texts."""
    return scan_texts(documents(spark, sf_dir))
