import os
import random
import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from glossa.llm import common, op02_lines, op06_toxicity, op08_packing, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(docs.count())
        if i < 4:
            assert docs.columns == columns, name
            assert docs.join(before, "doc_id", "left_anti").count() == 0 and docs.select("doc_id").distinct().count() == counts[-1]
            assert docs.where("n_chars <> length(text)").count() == 0
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2] and counts[4] == counts[3]
    used = docs.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in used) <= 2048
    assert corpus_pipeline.run(spark, FOLDER).count() == counts[5]


CLASH = "score int, n_lines int, n_removed int, n_runs int, component_id int, key int, at int, hash int, label int, place int, size int, fp int, piece int, length int, ids_crc32 int"


def odd_rows(rng):
    prose = [" ".join(rng.choices(["the", "river", "runs", "over", "old", "stones", "and", "grass", "slowly"], k=60)) for _ in range(6)]
    texts = [None, "", " \r\n\t", *prose, prose[0] + " tail", prose[1], "long line " * 6 + "\nb\nc", "x\n" + "long line " * 6 + "\nb\nc", "w " * 30_000, f"AKIA{'B' * 16} password=abcdefgh99", "漢字 é"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, prose[0]), (3, prose[0]), (3, "another text of the same id"), (None, prose[2]), (None, None), (None, prose[2])]
    return [(*r, *range(i, i + 15)) for i, r in enumerate(rows)]


def shingled(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def test_each_stage_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, clashing names; then an empty table."""
    rows = odd_rows(random.Random(3))
    schema = f"doc_id long, text string, {CLASH}"
    spark.createDataFrame([(i, int(i % 5 == 0), i % 2) for i in range(12)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, schema)
    stages = dict(corpus_pipeline.STAGES)
    others = lambda found: sorted(tuple(r)[2:] for r in found)
    got = stages["toxicity"](spark, docs, str(tmp_path))
    assert got.columns == docs.columns and not set(others(got.collect())) - set(others(docs.collect()))
    got = stages["line_dedup"](spark, docs, str(tmp_path))
    found = {tuple(r)[2:]: r.text for r in got.collect()}
    assert got.columns == docs.columns and sorted(found) == others(docs.collect())
    assert found[rows[12][2:]] == "x" and found[rows[11][2:]] == rows[11][1] and found[rows[0][2:]] is None and found[rows[2][2:]] == rows[2][1]
    got = stages["secret_scans"](spark, docs, str(tmp_path))
    found = {tuple(r)[2:]: r.text for r in got.collect()}
    assert got.columns == docs.columns and found[rows[14][2:]] == "[ACCESS] [ASSIGN]" and [r[1] for r in rows if found[r[2:]] != r[1]] == [rows[14][1]]
    got = stages["simhash_near_dedup"](spark, docs, str(tmp_path))
    kept = [(r.doc_id, r.text) for r in got.collect()]
    named = {(i, t or "") for i, t, *_ in rows if i is not None}
    group = {r: r for r in named}
    for a in named:
        for b in named:
            x, y = shingled(a[1]), shingled(b[1])
            if group[a] != group[b] and (x == y or 5 * len(x & y) >= 4 * len(x | y)):
                group = {k: group[a] if v == group[b] else v for k, v in group.items()}
    nulls = [t for i, t in kept if i is None]
    assert got.columns == docs.columns and len(nulls) == 3
    assert sorted({group[i, t or ""] for i, t in kept if i is not None}) == sorted(set(group.values())) and len(kept) - 3 == len(set(group.values()))
    assert all(i == min(k[0] for k, v in group.items() if v == group[i, t or ""]) for i, t in kept if i is not None)
    again = stages["simhash_near_dedup"](spark, docs.repartition(5), str(tmp_path))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, got.collect()))
    got = stages["best_fit_packing"](spark, docs, str(tmp_path)).collect()
    assert sum(r.piece == 0 for r in got) == len(rows) and max(r.piece for r in got) >= 14
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0 and (name == "best_fit_packing" or none.columns == docs.columns)


def test_run_is_its_stages_by_definition(spark, tmp_path):
    """run() against plain code: the model's scores, first lines, similar pairs, masked spans, one shard packed by looking at every bin."""
    rng = random.Random(9)
    prose = lambda: " ".join(rng.choices(["the", "river", "runs", "over", "old", "stones", "and", "grass"], k=40))
    texts = [prose() + (" you gloomfart" if i % 5 == 0 else "") for i in range(80)]
    texts += [texts[1] + " end", texts[2], "own line\n" + "shared long line of some words " * 2, "other\n" + "shared long line of some words " * 2, f"AKIA{'C' * 16}"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0), 1) for i in range(80)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scores = op06_toxicity.score(docs, op06_toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")))
    left = {r.doc_id: r.text for r in scores.where("score < 0.7").collect()}
    assert 60 <= len(left) < 80 and not [t for t in left.values() if "gloomfart" in t]
    seen = set()
    for i in sorted(left):
        lines = left[i].split("\n")
        pairs = list(zip(lines, lines[1:], strict=False))
        gone = {k for k, x in enumerate(lines) if x in seen and len(x) >= 40}
        for k, pair in enumerate(pairs):
            gone |= {k, k + 1} if pair in seen else set()
        seen |= {*lines, *pairs}
        left[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    sets = {i: shingled(t) for i, t in left.items()}
    group = {i: i for i in left}
    for a in left:
        for b in left:
            if group[a] != group[b] and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                low, high = sorted((group[a], group[b]))
                group = {k: low if v == high else v for k, v in group.items()}
    left = {i: re.sub("AKIA[A-Z0-9]{12,}", "[ACCESS]", left[i]) for i in sorted(set(group.values()))}
    tokenizer = Tokenizer.from_file(op08_packing.vocabulary())
    sizes = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: r.length for i, r in got.items()} == sizes
    order = sorted(sizes, key=lambda i: (-sizes[i], i))
    free, want = [], {}
    for i in order:
        fits = [(f, b) for b, f in enumerate(free) if f >= sizes[i]]
        b = min(fits)[1] if fits else len(free)
        free += [] if fits else [2048]
        want[i], free[b] = b, free[b] - sizes[i]
    assert {i: r.sequence_id for i, r in got.items()} == want
    assert sum(r.length for r in got.values()) == sum(2048 - f for f in free)


def test_run_leaves_nothing_but_what_its_rows_need(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    corpus_pipeline.run(spark, FOLDER).count()
    assert [p.name.rpartition("-")[0] for p in tmp_path.iterdir()] == ["items"]


def test_line_query_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    columns = ["doc_id", "n_lines", "n_removed", "n_runs", "kept_sha256"]
    got = sorted(tuple(r[c] for c in columns) for r in op02_lines.op2_line_dedup(spark, FOLDER).collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL['op2_line_dedup']})").fetchall())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_each_query_has_a_row_for_each_document(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert df.select("doc_id").distinct().count() == documents.count()
