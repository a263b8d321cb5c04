"""One table for each figure: what it draws, in drawing order by its own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators.stats import top_of
from glossa.operators.tagging import LABELS_RU, PERSPECTIVES


def bars(df: DataFrame, key: str, n: int = 15) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("count")).orderBy(F.desc("count"), key).limit(n)


def marker_bars(df: DataFrame, n: int = 15) -> DataFrame:
    out = df.groupBy("marker_id").agg(F.count("*").alias("count"), F.coalesce(F.max("marker_label"), F.max("marker_id")).alias("marker_label"))
    return out.orderBy(F.desc("count"), "marker_id").limit(n)


def pie(df: DataFrame, n: int = 5, rest: str = "others") -> DataFrame:
    """Top n markers and the rest as one slice, with the label that a slice of 3 % or more shows."""
    counts = df.groupBy("marker_id").agg(F.count("*").alias("count"), F.max("marker_label").alias("label"))
    top = counts.orderBy(F.desc("count"), "marker_id").limit(n).select("label", "count")
    others = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("all")).join(top.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("shown")), F.lit(True)).select(F.lit(rest).alias("label"), (F.col("all") - F.col("shown")).alias("count")).where("count > 0")
    slices = top.union(others)
    pct = F.col("count") / F.sum("count").over(Window.partitionBy()) * 100
    return slices.withColumn("is_labelled", pct >= 3)


def perspective_bars(df: DataFrame) -> DataFrame:
    """All perspectives in their fixed order, 0 where there is none."""
    order = df.sparkSession.createDataFrame([(i, p, LABELS_RU[p]) for i, p in enumerate(PERSPECTIVES)], "ord int, perspective string, label string")
    n = df.groupBy("perspective").agg(F.count("*").alias("count"))
    return order.join(n, "perspective", "left").fillna(0, ["count"])


def heatmap(df: DataFrame, index: str, column: str, n: int = 14) -> DataFrame:
    """Long form (index, column, count) of the n most active columns; all cells are there."""
    found = df.groupBy(index, column).agg(F.count("*").alias("count"))  # rows are counted once; the rest is of these counts
    rows = found.groupBy(index).agg(F.sum("count").alias("_all")).where("_all > 0").select(index)  # by the sum, so that all that reads the counts is alike
    cells = rows.join(F.broadcast(top_of(found, n, column)), F.lit(True))  # n columns for each row label
    return _counted(cells, found, index, column)


def _counted(cells: DataFrame, found: DataFrame, a: str, b: str) -> DataFrame:
    """cells with their count in `found`, 0 where there is none. The join is null-safe, so that no keys are filtered at the scan and Spark reads the counts' one shuffle again; null keys meet nothing all the same."""
    met = found.select(F.col(a).alias("_a"), F.col(b).alias("_b"), F.col("count").alias("_n"))
    joined = cells.join(met, F.col(a).eqNullSafe(F.col("_a")) & F.col(b).eqNullSafe(F.col("_b")), "left")
    count = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col("_n"))
    return joined.select(a, b, *[c for c in cells.columns if c not in (a, b)], F.coalesce(count, F.lit(0)).alias("count"))


def corpus_vs_hero(clean: DataFrame, mode: str) -> DataFrame:
    in_mode = F.col("hero_link").isin(*(["YES"] if (mode or "WIDE").upper() == "STRICT" else ["YES", "PROBABLE"]))
    return clean.groupBy("microtheme").agg(F.count("*").alias("corpus_count"), F.count_if(in_mode).alias("hero_count")).withColumn("difference_abs", F.col("hero_count") - F.col("corpus_count"))


def share_by_part(df: DataFrame, perspectives: list[str]) -> DataFrame:
    n = df.groupBy("part").agg(F.count("*").alias("all_hits"), F.count_if(F.col("perspective").isin(*perspectives)).alias("hits"))
    return n.withColumn("share_pct", T.share(F.col("hits"), F.col("all_hits")))


def dynamics_lines(df: DataFrame, segments: DataFrame, kind: str, n: int = 6) -> DataFrame:
    """Counts of the n top markers in each segment of the table, in its order, 0 where there is none."""
    found = df.groupBy(kind, "marker_id").agg(F.count("*").alias("count"))
    top = top_of(found, n)
    grid = segments.select(F.col(f"{kind}_id").alias("ord"), F.col(f"{kind}_name").alias(kind)).distinct().join(F.broadcast(top), F.lit(True))
    return _counted(grid, found, kind, "marker_id")
