"""Query op7: texts to SentencePiece ids and back.

Defined results: a row for each row, repeats and null ids included; null and empty texts have no ids; other columns, of
any name, are left out; no rows give no rows; texts of any length are encoded whole, a bounded window at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.common import documents
from glossa.llm.pieces import PieceIds, vocabulary

COLUMNS = {"n_bytes": pa.int64(), "n_ids": pa.int64(), "ids_crc32": pa.int64(), "decoded_sha256": pa.string(), "lossless": pa.bool_()}


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, the text's bytes, its ids' number and crc32 (little-endian unsigned 32-bit), the digest of what they decode to, and whether that is the text. Null texts count as empty: no ids. Row-local; the worker remembers the ids of units, up to a bound."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceIds.of(path)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                ids, data = coder.encode(text), text.encode()
                back = coder.v.decode(ids.tolist())
                rows.append((len(data), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(back).hexdigest(), back == data))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, COLUMNS.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *COLUMNS])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_ids long, ids_crc32 long, decoded_sha256 string, lossless boolean")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents; the cases are those of this module."""
    return encode_decode(documents(spark, sf_dir))
