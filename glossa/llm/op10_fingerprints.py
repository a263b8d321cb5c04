"""Query op10: document fingerprints as bottom-k sketches, each held against an edited text and the next document.

The next document of a row is that of the next lower doc_id, after the last one the first. Rows of equal id go by text
hash, equal rows one after another in any order; null ids come last. Other columns are left out. Equal texts have equal
fingerprints; a text without words has an empty one, which is like another empty one. A document that is alone is its
own next one. No rows give no rows. All steps are built-in expressions.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.llm.common import documents
from glossa.llm.sketches import K, containment, distinct_shingles, listed, resemblance, with_sketch


def _key() -> Column:
    """What rows are ordered by, as a string: the id as 16 hexadecimal digits that sort as it does (a null one sorts first), the text's hash, and the row's place, which parts equal rows."""

    def digits(value: Column) -> Column:
        return F.lpad(F.hex(value.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0")

    return F.concat(F.coalesce(digits(F.col("doc_id")), F.lit("")), F.lit(":"), digits(F.xxhash64("text")), digits(F.monotonically_increasing_id()))


def _ranges(docs: DataFrame, buckets: int) -> list[str]:
    """The highest key of each of about `buckets` ranges of even row counts, from the highest range on. Keys alone are shuffled; a string a range reaches the driver."""
    keys = docs.select(_key().alias("_key")).repartitionByRange(buckets, F.desc("_key"))
    return sorted((r[1] for r in keys.groupBy(F.spark_partition_id()).agg(F.max("_key")).collect()), reverse=True)


def _bucket(tops: list[str]) -> Column:
    """The range that `_key` falls into. Ranges are looked up by blocks, so that a row costs the square root of their number."""
    size = isqrt(len(tops)) + 1
    blocks = [tops[i : i + size] for i in range(0, len(tops), size)]
    firsts = F.array(*[F.lit(b[0]) for b in blocks])
    block = F.greatest(F.size(F.filter(firsts, lambda t: t >= F.col("_key"))), F.lit(1))
    within = F.element_at(F.array(*[F.array(*[F.lit(t) for t in b]) for b in blocks]), block)
    return (block - 1) * size + F.greatest(F.size(F.filter(within, lambda t: t >= F.col("_key"))), F.lit(1)) - 1


def dealt_in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) dealt into buckets (_bucket) so that each row's next one is in its own bucket: the next by (_copy, _key falling). Rows with _copy are there only to be a next one.

    Buckets are ranges of keys with about even row counts, whatever the ids are: dense, far apart, or one for all
    rows. Each bucket is a window partition; the row that follows its last is brought in by copying the first row of
    the next range. Texts are shuffled once.
    """
    tops = _ranges(docs, 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = docs.select("doc_id", "text", _key().alias("_key"))
    if not tops:
        return keyed.withColumns({"_bucket": F.lit(0), "_copy": F.lit(False)})
    # The first row of a range may be any of equal rows: their texts are equal.
    heads = [(t[:-16], (i - 1) % len(tops)) for i, t in enumerate(tops)]
    head = docs.sparkSession.createDataFrame(heads, "_head string, _bucket int")
    copies = keyed.withColumn("_head", F.expr("left(_key, length(_key) - 16)")).join(F.broadcast(head), "_head").groupBy("_bucket").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.max("_key").alias("_key"))
    own = keyed.select("*", _bucket(tops).cast("int").alias("_bucket"), F.lit(False).alias("_copy"))
    return own.unionByName(copies.withColumn("_copy", F.lit(True)))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents; null texts are empty."""
    return fingerprint_rows(documents(spark, sf_dir))


def fingerprint_rows(docs: DataFrame, size: int = 5, k: int = K) -> DataFrame:
    """Sketches of each row's text and edited text, and the likeness of the former to the latter and to the next row's."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("_bucket").orderBy("_copy", F.desc("_key"))
    both = with_sketch(dealt_in_order(docs), "text", "sketch", size, k)
    rows = both.select("doc_id", "text", "sketch", "_copy", F.lead("text").over(order).alias("next_text"), F.lead("sketch").over(order).alias("next_sketch")).where(~F.col("_copy"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = with_sketch(rows.drop("text", "next_text", "_copy"), "edited", "edited_sketch", size, k)
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), listed("sketch").alias("fingerprint"), listed("edited_sketch").alias("edited_fingerprint"),
        resemblance("sketch", "edited_sketch", k).alias("near_edited"), resemblance("sketch", "next_sketch", k).alias("near_next"),
        containment("sketch", "edited_sketch", k).alias("contained_edited"), distinct_shingles("sketch", k).alias("distinct_shingles"),
    )
