"""Connected components by alternating large-star and small-star steps.

Every node ends linked to the smallest node of its component. Each step is one aggregation and one join of edges: a
node's neighbours are only reduced to their minimum, and the edges of nodes with very many are joined by broadcast
(hot_join), so a hub's edges don't gather in a task. Rounds are written to the shared folder, each deleted once the
next one stands, and the driver sees counts alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import discard, hot_join, materialise


#: Edges that one task may well hold.
FEW = 1 << 16


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    # So few edges are no burden for one task, whatever they share: the plainer plan has half the stages.
    joined = hot_join(both, least, ["a"], "n", total) if total > FEW else both.join(least.drop("n"), "a")
    if large:
        kept = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        kept = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return kept.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), in any direction, repeats and loops allowed: a row (node, component) for each node with a link to another; component is its smallest node. No edges: no rows."""
    now = materialise(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = (now.count(),)
    while mark[0]:
        before, now = now, materialise(_star(now, large=True, total=2 * mark[0]), "stars")
        discard(before)
        before, now = now, materialise(_star(now, large=False, total=2 * mark[0]), "stars")
        discard(before)
        was, mark = mark, tuple(now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first())
        if was == mark:
            break
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
