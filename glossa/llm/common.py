"""What the operators of this subpackage share: reading tables, the shared folder, bounded samples."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the path may be any that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and whole text; a null text counts as empty."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where it is unset, a local master (tests) gets a fresh one; any other raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="glossa-shared-"))
    return base.rstrip("/")


#: Folders made for local sessions that name none, by application.
_own: dict[str, str] = {}

_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession, *kept: str) -> Iterator[list[str]]:
    """Tables that materialise() writes within are deleted on success, but for those whose names are in `kept`."""
    made: list[str] = []
    _scratch.append(made)
    try:
        yield made
        gone = {p for p in made if p.rpartition("/")[2].rpartition("-")[0] not in kept}
        _delete(spark, gone)
        if len(_scratch) > 1:
            _scratch[-2].extend(p for p in made if p not in gone)
    finally:
        _scratch.pop()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage with files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As materialise(), with the rows bucketed and sorted by `key`: joins of such tables on it shuffle nothing. The rows come from an aggregation by `key`, so each bucket is one file."""
    spark = df.sparkSession
    unique = f"{name}-{uuid.uuid4().hex}"
    path, view = f"{shared_dir(spark)}/{unique}", unique.replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", path).saveAsTable(view)
    if _scratch:
        _scratch[-1].append(path)
    _views[path] = view
    return spark.table(view)


_views: dict[str, str] = {}


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    gateway, conf = spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        for known in [p for p in _views if path.endswith(p.rpartition("/")[2])]:
            spark.sql(f"DROP TABLE IF EXISTS {_views.pop(known)}")
        where = gateway.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise() wrote and that nothing reads any more, and let go of finished shuffles' files."""
    for df in tables:
        _delete(df.sparkSession, {f.rpartition("/")[0] for f in df.inputFiles()})
    tables[0].sparkSession.sparkContext._jvm.System.gc()


#: A key with more than one in so many of all rows is hot: there are at most so many hot keys, whatever the input.
HOT_SHARE = 2_048


def hot_join(rows: DataFrame, small: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """rows joined to `small`, which has one row for each key and the key's number of rows in `count`.

    Keys of more than total / HOT_SHARE rows, at most HOT_SHARE of them, are broadcast, so that no task gets a hot key's rows; all others
    are joined by shuffles.
    """
    hot = F.col(count) > max(1, total // HOT_SHARE)
    warm = small.where(~hot).drop(count)
    frequent = F.broadcast(small.where(hot).drop(count))
    return rows.join(frequent, on).unionByName(rows.join(F.broadcast(small.where(hot).select(*on)), on, "left_anti").join(warm, on))


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n: the split into learning and held-out rows."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: int) -> DataFrame:
    """(doc_id, text, label, place): at most per_class learning rows of each class, the first in hash order, numbered from 0.

    Copies of one text count once for each class, so a large group of copies can't outweigh the rest; rows that repeat
    a doc_id with the same text are one, and of several labels of one id the highest counts. Only ids and text hashes
    are shuffled before the sample is cut. Null ids or labels are never sampled.
    """
    hashed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"))
    rows = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (remainder("doc_id", modulus) != held_out))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .join(hashed, "doc_id")
        .groupBy("_text", "label")
        .agg(F.min("doc_id").alias("doc_id"))
    )
    picked: list[tuple[int, int, int, int]] = []
    for value in (0, 1):
        first = rows.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id", "_text").limit(per_class)
        picked += [(int(r[0]), int(r[1]), value, i) for i, r in enumerate(first.select("doc_id", "_text").toLocalIterator())]
    wanted = docs.sparkSession.createDataFrame(picked, "doc_id long, _text long, label int, place int")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_text", F.xxhash64("text"))
    # One row for each (id, text): what repeats is cut where it is scanned.
    return texts.join(F.broadcast(wanted), ["doc_id", "_text"]).dropDuplicates(["doc_id", "_text"]).select("doc_id", "text", "label", "place")


_cache: dict[object, object] = {}


def worker_cache(name: object, build: Callable[[], T]) -> T:
    """What a Python worker remembers between tasks, for one purpose at a time: asking for another one lets the last go, so that stages that share workers don't add up."""
    if name not in _cache:
        _cache.clear()
        _cache[name] = build()
    return _cache[name]


def release() -> None:
    """Let go of what the worker remembers and give freed memory back, before or after a step that needs much."""
    _cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def release_others(name: object) -> None:
    """release(), unless what the worker remembers is `name`: a step begins without what others left."""
    if name not in _cache:
        release()
