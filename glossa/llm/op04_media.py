"""Query op4: texts as media columns.

Defined results: null texts are empty, one block of zeros; a row for each row, repeats and null ids included; other
columns are left out; equal texts give equal values; no rows give no rows; a broken stream raises ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import media
from glossa.llm.common import documents

def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        stored = [media.pack_payload(x.as_buffer().to_pybytes()) if x.is_valid else media.pack_payload(b"") for x in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(stored, pa.binary())], ["doc_id", "media"])


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id and the progressive stream that holds the whole text's UTF-8 bytes; null: empty."""
    return docs.select("doc_id", "text").mapInArrow(_store, "doc_id long, media binary")


TENSOR = {"height": pa.int32(), "width": pa.int32(), "rgb": pa.binary()}
FIGURES = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
#: Bytes of tensors in one batch.
AT_ONCE = 1 << 24


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["doc_id", *TENSOR, *FIGURES], [pa.int64(), *TENSOR.values(), *FIGURES.values()]
    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for doc_id, stored in zip(batch.column("doc_id").to_pylist(), batch.column("media"), strict=True):
            data = stored.as_buffer().to_pybytes()
            picture = media.decode(data)
            length, payload = media.unpack_payload(picture)
            rgb = media.to_rgb(picture)
            figures = (length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), media.feature(rgb))
            rows.append((doc_id, picture.height, picture.width, rgb.tobytes(), *figures))
            size += rgb.nbytes
            if size > AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_media(stored: DataFrame) -> DataFrame:
    """Decode each stored stream (doc_id, media): the full-resolution RGB tensor (height, width and rgb, its bytes by row, column and channel), the payload's sizes and digests, and the tensor's feature."""
    schema = "doc_id long, height int, width int, rgb binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("doc_id", "media").mapInArrow(_read, schema)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No shuffle: rows are stored and read back where they are scanned. The tensors are made and left out of the rows, three bytes a pixel being many times the text."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long"), "text")
    return read_media(store_texts(docs)).drop(*TENSOR)
