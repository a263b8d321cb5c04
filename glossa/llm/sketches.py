"""Bottom-k sketches of shingle hashes, as columns: arrays of the k smallest different hashes, in rising order.

All functions are built-in expressions. A sketch of a union is the sketch of its parts' sketches, so sketches merge
across parts in any order. Null or blank texts have an empty sketch; texts of fewer words than a shingle have the hash
of all their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 128


def with_sketch(df: DataFrame, text: str, out: str, size: int = 5, k: int = K) -> DataFrame:
    """df with the sketch of column `text` as column `out`. The steps are separate projections: a lambda may refer to an array only as a column, else it is built again for each element."""
    words, hashes = f"_{out}_words", f"_{out}_hashes"
    df = df.withColumn(words, F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    n = F.size(words)
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, size)))
    df = df.withColumn(hashes, F.when(n == 0, F.array().cast("array<long>")).when(n < size, F.array(F.xxhash64(words))).otherwise(shingles))
    return df.withColumn(out, bottom(hashes, k)).drop(words, hashes)


def bottom(hashes: str | Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: str | Column, b: str | Column, k: int = K) -> Column:
    """The sketch of the union of two texts' shingles."""
    return bottom(F.concat(a, b), k)


def resemblance(a: str, b: str, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both hold. Two empty sketches: 1."""
    union = merged(a, b, k)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(F.col(a), F.col(b)), union)) / F.greatest(F.size(union), F.lit(1)))


def distinct_shingles(sketch: str | Column, k: int = K) -> Column:
    """Estimated number of different shingles: exact below k, else (k - 1) over the k-th smallest hash as a share of all."""
    top = F.element_at(sketch, -1).cast("double") / 2.0**64 + 0.5
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / top)


def containment(a: str, b: str, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds, from the resemblance and the three counts. An empty a: 1."""
    union = distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_shingles(a, k)))


def merge_groups(df: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch for each group: hashes are made distinct and cut to the k least of a group before they are shuffled, so a hot group costs each task k rows. Groups of empty sketches alone are kept."""
    rows = df.select(*keys, F.explode_outer(sketch).alias("_hash")).distinct()
    least = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_hash").asc_nulls_last()))).where(F.col("_rank") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias(sketch))


def listed(sketch: str | Column) -> Column:
    """A sketch as text: hexadecimal hashes joined by dots."""
    return F.array_join(F.transform(sketch, lambda v: F.lower(F.hex(v))), ".")
