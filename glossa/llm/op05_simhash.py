"""Query op5: SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.llm.common import discard, documents, materialise
from glossa.llm.components import components
from glossa.llm.resemblance import classes
from glossa.llm.simhash import fingerprint, links


ID, HASH = "_row_id", "_row_hash"


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and its fingerprint as a signed long; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t or "", size) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable by links: a row for each row of docs, repeats included.

    Null texts are empty: texts of no words have fingerprint 0. Null doc_ids are never a component's name, unless it has
    no other; then it is null. Other columns are left out. Empty table: no rows.
    """
    found = materialise(fingerprints(docs, size), "fingerprints")
    distinct = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    groups = components(links(distinct, radius))
    named = distinct.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    leaders = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = materialise(named.join(leaders, "component").select("fp", "component_id"), "named")
    discard(distinct)
    return found.join(by_print, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, size: int = 5, radius: int = 2) -> DataFrame:
    """All columns of one row of each group of near copies (near_copies): the row of the smallest doc_id, then text hash; of rows equal in both, the one whose columns have the least hash. Rows without an id are kept."""
    named = docs.withColumns({ID: F.col("doc_id").cast("long"), HASH: F.xxhash64(F.coalesce("text", F.lit("")))})
    groups = classes(docs, size, radius)
    leaders = groups.where((F.col("at") == F.col("component_id")) & (F.col("hash") == F.col("component_hash"))).distinct()
    kept = named.join(leaders.select(F.col("at").alias(ID), F.col("hash").alias(HASH)), [ID, HASH], "left_semi")
    again = materialise(named.select(ID, HASH).where(F.col(ID).isNotNull()).groupBy(ID, HASH).count().where("count > 1").drop("count"), "again")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = kept.join(again, [ID, HASH], "left_anti").select(*columns)
    chosen = kept.join(again, [ID, HASH], "left_semi").groupBy(ID, HASH).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("_row")).select("_row.*")
    return once.union(chosen).union(docs.where(F.col("doc_id").isNull()))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents; the cases are those of near_duplicates."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component_id").cast(T.LongType()))
