"""Query op9: secrets in texts, with linked parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import secrets
from glossa.llm.common import documents

SPANS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_texts(docs: DataFrame) -> DataFrame:
    """doc_id with the counts, the digest of the base spans and all spans of each text; null texts count as empty; other columns are left out. Row-local: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, every = secrets.scan(text or "", secrets.WHOLE)
                kinds = [s[2] for s in base]
                rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(secrets.listed(base).encode()).hexdigest(), secrets.listed(every)))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {SPANS}")


def redact_texts(docs: DataFrame) -> DataFrame:
    """All rows and columns with the spans in `text` masked: null stays null, other columns (of any name) and repeated rows stay as they are."""
    order, schema = docs.columns, docs.schema
    at = order.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x and secrets.redact(x, secrets.scan(x, secrets.WHOLE)[1]) for x in batch.column(at).to_pylist()]
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(order))]
            yield pa.RecordBatch.from_arrays(columns, order)

    return docs.mapInArrow(run, schema)


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row, repeats and null ids included; null texts are empty and have no spans; no rows give none. Scopes are whole."""
    return scan_texts(documents(spark, sf_dir))
