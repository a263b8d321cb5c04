"""Operators over whole corpora, against brute force on small ones."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glossa.llm import components as components_module
from glossa.llm import op02_lines, op03_suffix, op05_simhash, op10_fingerprints, sketches
from glossa.llm.components import components
from glossa.llm.suffixes import entries

DOCS = "doc_id long, text string"


def corpus(seed, n=60):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("abcdefgh \n") for _ in range(k))
    passages = [text(260), text(700), "x" * 300, "ab" * 150]
    rows = [(i, text(rng.randint(0, 400)) + (rng.choice(passages)[rng.randint(0, 60) :] if rng.random() < 0.5 else "") + text(rng.randint(0, 100))) for i in range(n)]
    rows += [(n + i, rows[i][1]) for i in range(5)] + [(n + 10, None), (n + 11, ""), (n + 12, "é" * 150), (n + 13, "z" + "é" * 150), (None, passages[1]), (3, rows[3][1]), (4, passages[0])]
    return rows


# ------------------------------------------------------------------ op3


@pytest.mark.parametrize(("batches", "crowd"), [(1, 5_000), (4, 2)])
def test_repeated_bytes_by_definition(spark, batches, crowd):
    rows = corpus(batches)
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    got = sorted(repr(tuple(r)) for r in op03_suffix.remove_repeats(spark.createDataFrame(rows, DOCS), batches, crowd).collect())
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append(repr((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())))
    assert got == sorted(want) and any("0," not in w for w in want)


def test_entries_cover_all_starts():
    data = bytes(random.Random(0).choice(b"ab") for _ in range(3000))
    e = entries(data)
    assert e.low[0] == 0 and e.high[-1] == len(data) - 200 and (e.low[1:] == e.high[:-1] + 1).all() and (e.high - e.low < 160).all()
    assert len(entries(b"a" * 199).low) == 0 and len(entries(b"a" * 200).low) == 1


def test_levels_merge_geometrically(spark):
    family = op03_suffix.IndexFamily()
    sizes = []
    for k in range(5):
        run = family.run(spark.createDataFrame([(1, 2), (1, 3), (5, 5), (10 + k, 0)], "near long, whole long"))
        assert sorted(r.near for r in family.scan(run).distinct().collect()) == ([1, 5] if k else [])
        family.add(run)
        sizes.append([level for level, _ in family.levels])
    assert sizes == [[0], [1], [1, 0], [2], [2, 0]]
    assert {r.near: (r.n, r.least, r.most) for r in family.entries().collect() if r.near < 10} == {1: (10, 2, 3), 5: (5, 5, 5)}
    assert op03_suffix.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_scans_shuffle_nothing(spark):
    family = op03_suffix.IndexFamily()
    runs = [family.run(spark.range(k, 4000 + k).selectExpr("id AS near", "id AS whole")) for k in range(2)]
    family.add(runs[0])
    plan = family.scan(runs[1])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan or "Exchange hashpartitioning" not in plan


def test_matches_come_from_scans(spark, monkeypatch):
    text = "".join(random.Random(1).choices("abcdef", k=400))
    docs = spark.createDataFrame([(i, text) for i in range(8)], DOCS).withColumn("text_hash", F.xxhash64("text"))
    first = docs.withColumn("batch", F.pmod(F.pmod(F.hash(*op03_suffix.KEY), F.lit(1 << 16)), F.lit(4))).groupBy("batch").agg(F.min("doc_id")).collect()
    assert len(first) > 1
    two = docs.where(F.col("doc_id").isin([r[1] for r in first[:2]])).select("doc_id", "text")
    assert {r.n_removed for r in op03_suffix.remove_repeats(two, batches=4).collect()} == {400}
    monkeypatch.setattr(op03_suffix.IndexFamily, "scan", lambda self, run: run.select("near").limit(0))
    assert {r.n_removed for r in op03_suffix.remove_repeats(two, batches=4).collect()} == {0}


def test_repeated_rows_gather_their_entries_once(spark):
    text = "".join(random.Random(2).choices("abcdef", k=900))
    docs = spark.createDataFrame([(1, text)] * 500 + [(2, text[:450]), (3, "q" * 199)], DOCS)
    rows = op03_suffix.remove_repeats(docs).collect()
    assert len(rows) == 502 and {(r.doc_id, r.n_removed) for r in rows} == {(1, 900), (2, 450), (3, 0)}


# ------------------------------------------------------------------ op2


def lines_by_definition(rows, min_lines, min_chars):
    """Plain first-occurrence sets over distinct (id, text) in corpus order."""
    order = sorted({(i is not None, i or 0, t or "") for i, t in rows}, key=lambda r: (r[0], r[1], np.int64(np.uint64(xxhash.xxh64_intdigest(r[2].encode(), 42)).view(np.int64))))
    seen, out = set(), {}
    for some, i, t in order:
        lines = t.split("\n")
        at = [k for k, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for s in range(len(at)):
            one = (lines[at[s]],)
            run = tuple(lines[k] for k in at[s : s + min_lines])
            if one in seen and len(one[0]) >= min_chars:
                gone.add(at[s])
            if len(run) == min_lines and run in seen:
                gone |= set(at[s : s + min_lines])
            seen |= {one, run}
        out[(i if some else None), t] = [x for k, x in enumerate(lines) if k not in gone], len(gone)
    return out


@pytest.mark.parametrize("min_lines", [2, 4])
def test_lines_by_definition(spark, min_lines):
    rng = random.Random(min_lines)
    pool = ["a", "b", "long line " * 5, "c d", "", "  ", "other long line " * 4]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"own {i} {k}" for k in range(rng.randint(0, 12)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, rows[0][1]), (None, rows[1][1]), (5, rows[5][1]), (7, "a\nb\na\nb\na\nb\na\nb")]
    docs = spark.createDataFrame([(*r, "x", 9) for r in rows], DOCS + ", source string, n_lines int")
    got = op02_lines.dedup_lines(docs, min_lines, 40).collect()
    want = lines_by_definition(rows, min_lines, 40)
    assert len(got) == len(rows)
    for r in got:
        match = [(k, v) for k, v in want.items() if k[0] == r.doc_id and "\n".join(v[0]) == (r.text or "") and v[1] == r.n_removed]
        assert match, r
    assert next(r for r in got if r.doc_id == 50).text is None
    assert op02_lines.dedup_lines(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        op02_lines.repeated_runs(docs, min_lines=3)


def test_suffix_ranks_are_ordered(spark):
    rows = [(i, "\n".join("ab"[(i >> k) & 1] for k in range(6))) for i in range(20)]
    levels = op02_lines.suffix_levels(op02_lines.line_table(spark.createDataFrame(rows, DOCS)))
    assert [d for d, _ in levels][:3] == [1, 2, 4] and levels[-1][1].count() == 0
    texts = {i: t.split("\n") for i, t in rows}
    for depth, level in levels[:-1]:
        by_rank = {}
        for r in level.collect():
            by_rank.setdefault(r["rank"], set()).add(tuple(texts[r._doc][r.seq - 1 : r.seq - 1 + depth]))
        assert all(len(v) == 1 for v in by_rank.values()) and len({next(iter(v)) for v in by_rank.values()}) == len(by_rank)


# ------------------------------------------------------------------ op5


def fingerprint_by_definition(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice(("One", "two", "three", "four", "É")) for _ in range(rng.randint(0, 40))) for _ in range(30)]
    long = " ".join(f"w{i}" for i in range(400))
    rows = list(enumerate([*base, *base[:6], long, long + " x", long.replace("w7 ", "w8 "), None, "", "a", "a\x0bb\x85c d"])) + [(None, long), (2, base[2])]
    for _, t in rows:
        assert op05_simhash.fingerprint(t or "") == fingerprint_by_definition(t)
    got = op05_simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    prints = [fingerprint_by_definition(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min(r[0] for r, x in zip(rows, group, strict=True) if x == g and r[0] is not None) for g in group}
    want = sorted(repr((r[0], least[g])) for r, g in zip(rows, group, strict=True))
    assert sorted(repr((r.doc_id, r.component_id)) for r in got) == want
    assert op05_simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_links_meet_in_the_middle(spark):
    rng = random.Random(6)
    prints = [rng.getrandbits(64) for _ in range(30)]
    prints += [p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in prints] + [prints[0] ^ 7, 0, 1 << 63]
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    edges = op05_simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    assert all(((e.a ^ e.b) & (2**64 - 1)).bit_count() <= 2 for e in edges)
    reach = {p: p for p in signed}

    def root(x):
        while reach[x] != x:
            x = reach[x]
        return x

    for e in edges:
        reach[max(root(e.a), root(e.b))] = min(root(e.a), root(e.b))
    for a in signed:
        for b in signed:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                assert root(a) == root(b)


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_components_of_chains_and_stars(spark, monkeypatch, few):
    monkeypatch.setattr(components_module, "FEW", few)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ op10


def test_fingerprint_rows_by_definition(spark):
    rng = random.Random(10)
    rows = [(i * 7 - 20, " ".join(rng.choice("abcdefg") + "é" * (i % 2) for _ in range(rng.randint(0, 60)))) for i in range(30)]
    rows += [(500, ""), (10**12, "far away text of some words"), (501, rows[3][1])]
    got = {r.doc_id: r for r in op10_fingerprints.fingerprint_rows(spark.createDataFrame(rows, DOCS)).collect()}
    order = sorted(rows, reverse=True)

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    for k, (i, t) in enumerate(order):
        follow = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + follow[: len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(like(shingles(t), shingles(edited))) and r.near_next == pytest.approx(like(shingles(t), shingles(follow)))
        assert r.distinct_shingles == len(shingles(t))
    assert got[501].fingerprint == got[rows[3][0]].fingerprint
    odd = spark.createDataFrame([(None, "a b"), (None, "c"), (1, "x"), (1, "x"), (1, "y")], DOCS)
    assert op10_fingerprints.fingerprint_rows(odd).count() == 5
    alone = op10_fingerprints.fingerprint_rows(spark.createDataFrame([(4, "abcd")], DOCS)).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and alone.near_next == 1.0
    assert op10_fingerprints.fingerprint_rows(spark.createDataFrame([], DOCS)).count() == 0


def test_order_holds_for_any_ids_and_equal_rows(spark):
    """Ids of the whole range of longs, one far id, and 100,000 equal rows: as many rows, and no range with much more than its share."""
    far = [(-(1 << 63), "a b c"), (5, "b c d"), ((1 << 63) - 1, "c d e")]
    got = {r.doc_id: r.edited_sha256 for r in op10_fingerprints.fingerprint_rows(spark.createDataFrame(far, DOCS)).collect()}
    follows = {(1 << 63) - 1: "b c d", 5: "a b c", -(1 << 63): "c d e"}
    assert got == {i: hashlib.sha256((t[:3] + follows[i][:2]).encode()).hexdigest() for i, t in far}
    dense = spark.range(2000).selectExpr("id AS doc_id", "'x' AS text").union(spark.createDataFrame([(10**15, "z")], DOCS))
    equal = spark.range(100_000).selectExpr("CAST(1 AS LONG) AS doc_id", "'a b' AS text").union(spark.createDataFrame([(2, "c")], DOCS))
    for docs, n in ((dense, 2001), (equal, 100_001)):
        dealt = op10_fingerprints.dealt_in_order(docs).where("NOT _copy").groupBy("_bucket").count().collect()
        assert sum(r["count"] for r in dealt) == n and max(r["count"] for r in dealt) < n / 8
    ends = {r.n: r["count"] for r in op10_fingerprints.fingerprint_rows(equal).groupBy(F.col("near_next").alias("n")).count().collect()}
    assert ends == {1.0: 99_999, 0.0: 2}


def test_sketches_estimate_and_merge(spark):
    words = [f"w{i}" for i in range(4000)]
    rows = [(0, " ".join(words[:3000])), (0, " ".join(words[2996:])), (1, " ".join(words)), (2, ""), (3, None)]
    base = sketches.with_sketch(spark.createDataFrame(rows, "g long, text string"), "text", "s")
    merged = {r.g: r.s for r in sketches.merge_groups(base, ["g"], "s").collect()}
    assert merged[0] == merged[1] and len(merged[1]) == sketches.K and merged[2] == [] and merged[3] == []
    n = base.where("g = 1").select(sketches.distinct_shingles("s")).first()[0]
    assert n == pytest.approx(3996, rel=0.3)
    pair = base.limit(1).select("s").crossJoin(base.where("g = 1").select(base.s.alias("t")))
    a, b = pair.select(sketches.containment("s", "t"), sketches.resemblance("s", "t")).first()
    assert a > 0.75 and b == pytest.approx(0.75, abs=0.15)
