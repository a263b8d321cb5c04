"""Interval and frequency joins against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from glossa.operators import joins, tagging


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def apart(rng, top, n, longest):
    """Closed intervals that don't overlap."""
    out, at = [], rng.randrange(5)
    for i in range(n):
        end = at + rng.randrange(longest)
        if end > top:
            break
        out.append((i, f"s{i}", at, end))
        at = end + 1 + rng.randrange(6)
    return out


@pytest.mark.parametrize(("width", "covered"), [(64, 1024), (4, 3), (1, 2), (16, 1)])
def test_points_meet_their_interval_once(spark, monkeypatch, width, covered):
    monkeypatch.setattr(joins, "BIN", width)
    monkeypatch.setattr(joins, "COVERED", max(2, covered))
    rng = random.Random(width)
    intervals = [(d, *x) for d in range(6) for x in apart(rng, 3_000, 40, rng.choice((2, 30, 900)))] + [(7, 0, "back", 9, 3), (7, 1, "null", None, 3), (None, 2, "keyless", 0, 99), (8, 3, "huge", 0, 2_900), (9, 4, "one", 5, 5)]
    points = [(i, rng.choice((0, 1, 2, 3, 4, 5, 6, 7, 8, 9, None)), rng.choice((rng.randrange(-2, 3_100), rng.randrange(12), None))) for i in range(900)]
    rows = spark.createDataFrame(points, "id long, doc_id long, sent_id int")
    table = spark.createDataFrame(intervals, "doc_id long, part_id int, name string, a int, b int")
    joined = joins.in_intervals(rows, "sent_id", table, "a", "b", "doc_id")
    assert joined.columns == ["id", "doc_id", "sent_id", "part_id", "name"]
    want = {i: next(((k, n) for key, k, n, a, b in intervals if None not in (d, s, key, a, b) and key == d and a <= s <= b), (None, None)) for i, d, s in points}
    got = joined.collect()
    assert len(got) == len(points) and {r.id: (r.part_id, r.name) for r in got} == want
    assert "NestedLoop" not in plan(joined) and "Cartesian" not in plan(joined)


def test_intervals_of_all_documents(spark):
    rows = spark.createDataFrame([(1, 5), (2, 5), (2, 70), (3, 200), (3, None)], "doc_id long, sent_id int")
    parts = spark.createDataFrame([(1, "a", 0, 63), (2, "b", 64, 180)], "part_id int, part_name string, start_sent int, end_sent int")
    got = tagging.assign_segments(rows, parts, "part")
    assert sorted((r.doc_id, r.sent_id or -1, r.part_id, r.part) for r in got.collect()) == [(1, 5, 1, "a"), (2, 5, 1, "a"), (2, 70, 2, "b"), (3, -1, -1, "UNKNOWN"), (3, 200, -1, "UNKNOWN")]
    assert "NestedLoop" not in plan(got)
    assert tagging.assign_segments(rows.limit(0), parts, "part").collect() == [] and tagging.assign_segments(rows, parts.limit(0), "part").count() == 5


def test_frequent_keys_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(joins, "FREQUENT", 3)
    keys = ["hot"] * 60 + ["warm"] * 9 + ["cold", "none", None]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, k string")
    table = spark.createDataFrame([("hot", 60, "H"), ("warm", 9, "W"), ("cold", 1, "C"), ("more", 2, "M")], "k string, n long, v string")
    got = joins.by_frequency(rows, table, "k", "n")
    assert {r.id: r.v for r in got.collect()} == {i: {"hot": "H", "warm": "W", "cold": "C"}.get(k) for i, k in enumerate(keys)} and got.count() == len(keys)
    assert joins.by_frequency(rows, table.limit(0), "k", "n").where(F.col("v").isNull()).count() == len(keys)
