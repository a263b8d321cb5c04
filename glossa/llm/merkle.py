"""Merkle trees over ordered rows: combining by parent, and proofs along reverse links.

A tree's rows are numbered from 0; eight consecutive nodes of a level (the last run may be shorter) become their
parent, until one node remains. Two kinds of tasks do the work, both over sorted rows and with bounded state:

* climb() combines by key: a partial parent gathers the digests of its children by slot. As soon as it holds as many as
  the tree's size says it has, it emits its digest, which is an event for the partial parent above it. Children whose
  parent isn't complete when the task ends are the frontier. Frontiers are dealt anew by the ancestor SPAN levels up,
  round by round, until each tree has one node.
* descend() goes back: a parent's children are its reverse links. The path of a node (its slot and siblings at each level
  up to the root) is the paths within a block of ARITY ** SPAN nodes before the path of the block's ancestor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import materialise, release

ARITY = 8
#: Levels that one round of either direction covers: a block has at most ARITY ** SPAN nodes of its lowest level.
SPAN = 3
#: Rows whose paths a task holds at a time.
ROWS = 1_000
NODE = "tree string, n long, level int, at long, digest string"
#: A path from a node upwards: for each level, "slot:siblings", joined by ";".
LEVEL, PART = ";", ":"


def size_at(n: int, level: int) -> int:
    """Nodes of a level of a tree over n rows."""
    return -(-n // ARITY**level)


def height(n: int) -> int:
    level = 0
    while size_at(n, level) > 1:
        level += 1
    return level


def digest_of(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with `at`, their place from 0 in their `tree` by `order`, and `n`, the tree's rows. `order` must tell all rows of a tree apart.

    Rows are dealt by ranges of (tree, order), however large a tree is, and sorted; the place in a range is the row's own
    number there. What is joined to them is a row for each (range, tree).
    """
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    placed = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    placed = materialise(placed, name).withColumn("_range", F.shiftright("_place", 33))
    parts = placed.groupBy("_range", "tree").agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("tree").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_range", "tree", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(Window.partitionBy("tree")).alias("n"))
    return placed.join(starts, ["_range", "tree"]).withColumn("at", F.col("_place") + F.col("_shift")).drop("_range", "_place", "_shift")


def climb(nodes: DataFrame) -> DataFrame:
    """NODE rows to NODE rows with `children`: parents that are complete within a partition, and, with null children, nodes whose parent isn't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partial: dict[tuple[str, int, int], tuple[int, dict[int, str]]] = {}  # combiners by parent: the tree's rows, digests by slot
        out: list[tuple] = []

        def add(tree: str, n: int, level: int, at: int, digest: str) -> None:
            while True:
                width = size_at(n, level)
                if width == 1:
                    return
                up, slot = divmod(at, ARITY)
                held = partial.setdefault((tree, level + 1, up), (n, {}))[1]
                held[slot] = digest
                if len(held) < min(ARITY, width - up * ARITY):
                    return
                del partial[tree, level + 1, up]
                children = [held[i] for i in range(len(held))]
                level, at, digest = level + 1, up, digest_of(children)
                out.append((tree, n, level, at, digest, children))

        def given() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()))
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["tree", "n", "level", "at", "digest", "children"])
            out.clear()
            return made

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("tree", "n", "level", "at", "digest")), strict=True):
                add(*row)
            yield given()
        for (tree, level, up), (n, held) in partial.items():
            out += [(tree, n, level - 1, up * ARITY + slot, digest, None) for slot, digest in held.items()]
            if len(out) > 10_000:
                yield given()
        yield given()

    return nodes.select("tree", "n", "level", "at", "digest").mapInArrow(run, f"{NODE}, children array<string>")


def ancestor(level: int) -> Column:
    """The place of a node's ancestor at `level`."""
    return F.expr(f"shiftright(at, 3 * ({level} - level))")


def build(leaves: DataFrame, name: str) -> tuple[DataFrame, int]:
    """(all parents with their children, the levels of the tallest tree) of leaves (tree, n, at, digest)."""
    tallest = height(leaves.agg(F.max("n")).first()[0] or 0)
    made, now, top = [], leaves.select("tree", "n", F.lit(0).alias("level"), "at", "digest"), 0
    while True:
        found = materialise(climb(now), f"{name}-{top}")
        made.append(found.where(F.col("children").isNotNull()))
        frontier = found.where(F.col("children").isNull())
        if top >= tallest or frontier.isEmpty():
            return reduce(DataFrame.unionByName, made), tallest
        top += SPAN
        under = ancestor(top)
        now = frontier.repartition(F.col("tree"), under).sortWithinPartitions("tree", under, "level", "at")


def roots(leaves: DataFrame, parents: DataFrame) -> DataFrame:
    """(tree, n, root): a tree of one row is its own root."""
    one = leaves.where("n = 1").select("tree", "n", F.col("digest").alias("root"))
    return one.unionByName(parents.where(f"shiftleft(1L, 3 * level) >= n AND shiftleft(1L, 3 * (level - 1)) < n").select("tree", "n", F.col("digest").alias("root")))


#: What a leaf's key and path are turned into, many at a time, with its type's name.
Finish = tuple[Callable[[list[dict], list[str]], pa.Array], str]
PATHS: Finish = (lambda keys, paths: pa.array(paths, pa.string()), "string")


def descend(leaves: DataFrame, parents: DataFrame, tops: DataFrame, tallest: int, name: str, finish: Finish = PATHS) -> DataFrame:
    """(key, above, path) of each leaf (tree, n, at, digest, key): the path up to the tree's root and then on along `path` of its row of tops (tree, n, path, above), whose `above` is handed down.

    key is any struct of the leaf. Each round deals blocks of SPAN levels: anchors (paths of the blocks' ancestors),
    links (parents within) and the nodes that want a path. `finish` makes the last column of leaves' paths where they
    are found: long paths needn't leave the task.
    """
    kind = leaves.schema["key"].dataType
    nothing = F.lit(None).cast(kind)
    anchors = None
    for low in range(max(0, (tallest - 1) // SPAN * SPAN), -1, -SPAN):
        high = low + SPAN
        # A tree whose root is within these levels hangs from its own top; of the others, this round's blocks hang from the last one's nodes.
        reach = lambda level: F.shiftleft(F.lit(1).cast("long"), 3 * level)
        tall = F.col("n") > reach(low) if low else F.lit(True)
        own = tops.where(tall & (F.col("n") <= reach(high))).select("tree", "n", F.lit(0).cast("long").alias("block"), "path", "above")
        anchor = own if anchors is None else own.unionByName(anchors)
        links = parents.where(tall & F.col("level").between(low + 1, high)).select("tree", "n", ancestor(high).alias("block"), "level", "at", "children")
        wanted = leaves if low == 0 else parents.where(tall & (F.col("level") == low)).withColumn("key", nothing)
        wanted = wanted.select("tree", "n", F.shiftright("at", 3 * SPAN).alias("block"), F.lit(low).alias("level"), "at", "key")
        empty = {"level": F.lit(0), "at": F.lit(0).cast("long"), "children": F.lit(None).cast("array<string>"), "path": F.lit(None).cast("string"), "above": F.lit(None).cast(tops.schema["above"].dataType), "key": nothing}
        rows = [df.withColumn("rank", F.lit(i)).select("tree", "n", "block", "rank", *[F.col(c) if c in df.columns else v.alias(c) for c, v in empty.items()]) for i, df in enumerate((anchor, links, wanted))]
        dealt = reduce(DataFrame.unionByName, rows).repartition("tree", "block").sortWithinPartitions("tree", "block", "rank")
        schema = dealt.select("tree", "n", F.col("at").alias("block"), F.lit(None).cast("string" if low else finish[1]).alias("path"), "above", "key").schema
        found = dealt.select("tree", "n", "block", "rank", "level", "at", "children", "path", "above", "key").mapInArrow(_paths(low, high, PATHS[0] if low else finish[0]), schema)
        if low == 0:
            return found.select("key", "above", "path")
        anchors = materialise(found.drop("key"), f"{name}-{low}")
    raise AssertionError("the last round is at level 0")


def _paths(low: int, high: int, finish: Callable[[list[dict], list[str]], pa.Array]):
    """Rows sorted by (tree, block, rank) to those of rank 2, with paths. Holds the links of one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, links, path, memo = None, {}, "", {}
        above = None

        def up(level: int, at: int, n: int) -> str:
            """The path of a node, up to its block's ancestor and on."""
            if level == high or size_at(n, level) == 1:
                return path
            known = memo.get((level, at))
            if known is None:
                parent, slot = divmod(at, ARITY)
                children = links[level + 1, parent]
                step = f"{slot}{PART}{''.join(children[:slot] + children[slot + 1 :])}"
                rest = up(level + 1, parent, n)
                known = f"{step}{LEVEL}{rest}" if rest else step
                if level > low:
                    memo[level, at] = known
            return known

        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, len(b), ROWS)):
            kept, paths, tops = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("tree", "n", "block", "rank", "level", "at", "children", "path"))
            for i, (tree, n, block, rank, level, at, children, given) in enumerate(zip(*columns, strict=True)):
                if now != (tree, block):
                    now, links, path, memo, above = (tree, block), {}, "", {}, None
                if rank == 0:
                    path, above = given, batch.column("above").slice(i, 1)
                elif rank == 1:
                    links[level, at] = children
                else:
                    kept.append(i)
                    paths.append(up(level, at, n))
                    tops.append(above)
            chosen = batch.take(pa.array(kept, pa.int64()))
            handed = pa.concat_arrays(tops) if tops else chosen.column("above")
            yield pa.RecordBatch.from_arrays([chosen.column("tree"), chosen.column("n"), chosen.column("at"), finish(chosen.column("key").to_pylist(), paths), handed, chosen.column("key")], ["tree", "n", "block", "path", "above", "key"])
        release()

    return run


def fold(digest: str, path: str) -> str:
    """The root that a leaf and its path give."""
    for step in path.split(LEVEL) if path else ():
        slot, _, siblings = step.partition(PART)
        at = 64 * int(slot)
        digest = digest_of([siblings[:at], digest, siblings[at:]])
    return digest


def siblings_of(path: str) -> str:
    """All siblings of a path, level by level."""
    return "".join(step.partition(PART)[2] for step in path.split(LEVEL)) if path else ""
