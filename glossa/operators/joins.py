"""Joins that stay even when keys aren't: by frequency of the key, and of points with intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many of all rows is frequent: there are at most so many such keys, whatever the input.
FREQUENT = 2_048


def by_frequency(rows: DataFrame, table: DataFrame, on: str, count: str) -> DataFrame:
    """rows joined to `table`, which has one row for each key and in `count` the key's number of rows; rows without one get nulls.

    Keys of more than total / FREQUENT rows, at most FREQUENT of them, are broadcast, so that no task gathers a frequent
    key's rows; all others are joined by shuffles.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    frequent = F.col(count) > max(1, total // FREQUENT)
    hot = F.broadcast(table.where(frequent).drop(count))
    rest = rows.join(F.broadcast(table.where(frequent).select(on)), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.join(table.where(~frequent).drop(count), on, "left"))


#: Points of one bin of the finest grid, and bins of a grid that an interval may cover; a longer interval goes to the next grid, which is so many times coarser.
BIN, COVERED = 64, 1_024


def in_intervals(rows: DataFrame, point: str, intervals: DataFrame, low: str, high: str, key: str | None = None) -> DataFrame:
    """rows with the columns of the interval of `intervals` whose closed range low to high holds their `point` (and that has their `key`), else nulls.

    The intervals of a key don't overlap. They are cut into bins of a grid and joined by (key, bin) as equals; the exact
    range is a further condition of that join. A row has one bin in a grid, so it meets an interval once. Long intervals
    lie on coarser grids (each joined in turn), so none is cut into more than COVERED + 1 bins. Rows with a null point or
    key, and intervals that end before they begin, meet nothing. `key` and `point` may not be names of `intervals` other
    than the key; low and high don't come back.
    """
    length = F.col(high) - F.col(low)
    whole = intervals.where(length >= 0)
    longest = whole.agg(F.max(length)).first()[0]
    values = [c for c in intervals.columns if c not in (low, high, key)]
    out, width, first = rows, BIN, True
    while True:
        own = length < width * COVERED
        grid = whole.where(own if first else own & (length >= width))
        bins = F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
        cut = grid.select(*([F.col(key).alias("_key")] if key else []), bins.alias("_bin"), F.col(low).alias("_low"), F.col(high).alias("_high"), *[F.col(c).alias(f"_{c}") for c in values])
        met: Column = (F.floor(F.col(point) / width) == F.col("_bin")) & F.col(point).between(F.col("_low"), F.col("_high"))
        if key:
            met = met & (F.col(key) == F.col("_key"))
        joined = out.join(cut, met, "left")
        out = joined.select(*rows.columns, *[(F.col(f"_{c}") if first else F.coalesce(F.col(c), F.col(f"_{c}"))).alias(c) for c in values])
        if longest is None or longest < width * COVERED:
            return out
        width, first = width * COVERED, False
