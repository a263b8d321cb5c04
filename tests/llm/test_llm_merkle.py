"""op11 against trees built by plain code."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from glossa.llm import merkle, op11_merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def spelt(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text):
    doc_id, source, lang, n, _ = row
    return h("".join(map(spelt, (doc_id, source, lang, n, text))))


def tree(digests):
    """All levels of a tree."""
    levels = [digests]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h("".join(now[i : i + 8])) for i in range(0, len(now), 8)])
    return levels


def walk(levels, at):
    """[(slot, siblings)] from a leaf up."""
    out = []
    for level in levels[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        out.append((at % 8, run[: at % 8] + run[at % 8 + 1 :]))
        at //= 8
    return out


def expected(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[lang] = own, tree([leaf(r, r[4]) for r in own])
    crown = tree([trees[x][1][-1][0] for x in langs])
    out = []
    for i, lang in enumerate(langs):
        own, levels = trees[lang]
        for at, r in enumerate(own):
            path = walk(levels, at) + walk(crown, i)
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            now = leaf(r, text)
            for slot, others in path:
                now = h("".join([*others[:slot], now, *others[slot:]]))
            out.append((r[0], levels[0][at], levels[-1][0], crown[-1][0], h("".join(x for _, s in path for x in s)), now, now == crown[-1][0]))
    return out


def of(spark, rows):
    return op11_merkle.verified(spark.createDataFrame(rows, SCHEMA))


def key(r):
    return tuple(map(str, r))


def made(sizes, seed=1):
    rng = random.Random(seed)
    rows = []
    for lang, n in sizes.items():
        rows += [(rng.randrange(10 * n + 10) - 5, rng.choice(["web", "ß", None]), lang, rng.choice([None, 7]), rng.choice(["Ab C", "abc", "", None, "Éa\n"])) for _ in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 9}, {None: 1, "": 2, "de": 8}, {"en": 700, "de": 64, None: 65, "é": 1, "z": 513}, {f"l{i:03}": 1 + i % 10 for i in range(70)}])
def test_against_plain_trees(spark, sizes):
    rows = made(sizes)
    assert sorted(map(key, of(spark, rows).collect())) == sorted(map(key, expected(rows)))


def test_tall_trees_over_small_blocks(spark, monkeypatch):
    """More rounds in both directions: a round covers one level."""
    monkeypatch.setattr(merkle, "SPAN", 1)
    rows = made({"en": 600, "de": 70, "x": 3})
    assert sorted(map(key, of(spark, rows).collect())) == sorted(map(key, expected(rows)))


def test_null_ids_equal_rows_and_clashing_names(spark, tmp_path):
    rows = [(None, "s", "en", 3, "Abc")] * 3 + [(5, "s", "en", 3, "ABC")] * 20 + [(5, None, None, None, None)]
    want = sorted(map(key, expected(rows)))
    assert sorted(map(key, of(spark, rows).collect())) == want
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"tree": F.lit("x"), "at": F.lit(1), "n": F.lit(2), "root": F.lit("y"), "digest": F.lit("z")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(key, op11_merkle.op11_merkle_manifest(spark, str(tmp_path)).collect())) == want


def test_paths_prove_leaves(spark):
    rows = made({"en": 90, "de": 2})
    for r in op11_merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect():
        assert merkle.fold(r.leaf, r.path) == r.root and h(merkle.siblings_of(r.path)) in {e[4] for e in expected(rows) if e[1] == r.leaf}


def test_no_rows(spark):
    found = of(spark, [])
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and found.collect() == []


def test_sql_gives_the_same_rows(spark, tmp_path):
    rows = [(i, *r[1:]) for i, r in enumerate(made({"en": 300, None: 70, "de": 8, "fr": 1}, 3))]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = con.execute(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({op11_merkle.ORACLE})").fetchall()
    assert sorted(map(key, got)) == sorted(map(key, expected(rows)))


def test_a_changed_sibling_is_found():
    levels = tree([h(str(i)) for i in range(100)])
    path = merkle.LEVEL.join(f"{slot}{merkle.PART}{''.join(others)}" for slot, others in walk(levels, 42))
    assert merkle.fold(levels[0][42], path) == levels[-1][0] != merkle.fold(levels[0][41], path)
    assert merkle.fold("leaf", "") == "leaf" and merkle.siblings_of("") == ""
