"""op13 against whole texts cut by the libraries, and links by their ranges."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.llm import alignment, op13_alignment

ODD = [
    None, "", " ", "  ", "\n", "\r", " \r\n", "a", "a ", " a", "a\r", "x;\r\ny {\r\n\t}\r\n", "a\tb\t\tc", "a  b   c", "a \n b", "\n\na", "é" * 70, "x" * 3000, "Hello  world\tnaïve 漢字 \x00 <|endoftext|> <s> </s> <unk>", "a▁b", "▁", "a ▁ b",
    "퟿｡ ́e", "a\x0bc\x85d\xa0e f　g​h", "I'm they'll\n'tis we'd", "1234 5,678.90", "\x1ca\x1d b", "🙂🙃 👩‍👩‍👧", "<0x0A> <|endoftext|>", "…..., !!! ??? ;;", "ſ ǆ ɏ ʰ", "a᠎b ᠎ c", "﻿a", "a\n\n\nb\n c",
]


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(alignment.vocabularies())


@pytest.fixture(scope="module")
def spelt():
    """The bytes of each id, from other files than the operator's."""
    import base64

    import public_tokenizers
    import sentencepiece

    ranks = [line.split() for line in open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")]
    a = {int(i): base64.b64decode(x) for x, i in ranks} | {50256: b"<|endoftext|>"}
    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, [bytes.fromhex(m.id_to_piece(i)[3:5]) if m.is_byte(i) else m.id_to_piece(i).replace("\u2581", " ").encode() for i in range(m.vocab_size())]


def test_bytes_of_ids(aligner, spelt):
    assert dict(enumerate(aligner.a.spelt)) == spelt[0] and aligner.b.spelt == spelt[1] and aligner.a.quick is not None


def spans(sizes):
    ends = np.cumsum(sizes).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def brute(aligner, text):
    """(ids of A, ids of B, [(group's ids of A, of B)], [(a, b) of each link]) or None."""
    if not text:
        return None
    a = aligner.a.library.encode(" " + text, add_special_tokens=False).ids
    b = aligner.b.library.encode(text)
    spelt_a, spelt_b = [aligner.a.spelt[i] for i in a], [aligner.b.spelt[i] for i in b]
    if not b"".join(spelt_a) == b"".join(spelt_b) == (" " + text).encode():
        return None
    sa, sb = spans([len(x) for x in spelt_a]), spans([len(x) for x in spelt_b])
    cuts = sorted({e for _, e in sa} & {e for _, e in sb})
    groups = [([], []) for _ in cuts]
    for side, ids, where in ((0, a, sa), (1, b, sb)):
        g = 0
        for i, (_, end) in zip(ids, where, strict=True):
            while end > cuts[g]:
                g += 1
            groups[g][side].append(i)
    links, j = [], 0
    for i, (s, e) in zip(a, sa, strict=True):
        while sb[j][1] <= s:
            j += 1
        k = j
        while k < len(sb) and sb[k][0] < e:
            links.append((i, b[k]))
            k += 1
    return a, b, groups, links


def listed(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def expected(aligner, rows):
    found = [(i, brute(aligner, t)) for i, t in rows]
    count = Counter(p for _, f in found if f for p in set(f[3]))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links = f
            out.append((i, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(listed(groups).encode()).hexdigest()))
    return out


def check(aligner, texts, least):
    """At least this share of the texts has tokens."""
    assert sum(brute(aligner, t) is not None for t in texts) >= least * len(texts)
    for text, got in zip(texts, aligner.documents([t or "" for t in texts]), strict=True):
        want = brute(aligner, text)
        if want is None:
            assert got.counts == (0, 0, 0, 0) and got.groups == "" and not len(got.pairs), repr(text)
            continue
        a, b, groups, links = want
        assert got.counts == (len(a), len(b), len(groups), len(links)), repr(text)
        assert got.groups == hashlib.sha256(listed(groups).encode()).hexdigest(), repr(text)
        times = Counter(x * aligner.width + y for x, y in links)
        assert dict(zip(got.pairs.tolist(), got.times.tolist(), strict=True)) == times and (np.diff(got.pairs.astype(np.int64)) > 0).all()


def test_odd_texts(aligner):
    check(aligner, ODD, 0.6)


def test_random_texts(aligner):
    rng = random.Random(2)
    for letters in ("ab \n", "the and\r\t ;{}", " \t\r\n\x0b\xa0　x", "aé漢▁ 🙂́'", "'sdmtrel v 0", "".join(map(chr, range(32, 0x250)))):
        check(aligner, ["".join(rng.choices(letters, k=rng.randrange(80))) for _ in range(300)], 0.05)


def test_documents(aligner):
    texts = [r[0] for r in duckdb.connect().execute("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id").fetchall()]
    check(aligner, texts, 1.0)


def test_memory_starts_afresh(monkeypatch, aligner):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdé", k=rng.randrange(1, 6))) for _ in range(40)) for _ in range(60)]
    monkeypatch.setattr(alignment, "MOST", 50)
    monkeypatch.setattr(alignment, "STEP", 500)
    check(aligner, texts, 1.0)


def test_union_find():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(1, 40)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(50))]
        want = list(range(n))
        for _ in range(n):
            for a, b in edges:
                want[a] = want[b] = min(want[a], want[b])
        got = alignment.union_find(n, np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int64))
        assert got.tolist() == want
    path = np.random.RandomState(0).permutation(100_000)
    assert not alignment.union_find(100_000, path[:-1], path[1:]).any()


def test_numbers_come_back():
    rng = np.random.RandomState(1)
    for n in (0, 1, 5, 70_000):
        values = np.sort(rng.randint(0, 1 << 32, n, np.uint64).astype(np.uint32))
        assert (alignment.unpacked_rising(alignment.packed_rising(values)) == values).all() and (alignment.unpacked(alignment.packed(values)) == values).all()


@pytest.mark.parametrize("size", [op13_alignment.SLICE, 40])
def test_rows(spark, aligner, monkeypatch, size):
    rng = random.Random(6)
    words = ["".join(rng.choices("abet", k=rng.randrange(1, 7))) for _ in range(30)]
    texts = [*ODD, *(" ".join(rng.choices(words, k=rng.randrange(30))) for _ in range(60)), *ODD[:9], "the same", "the same"]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("x"), "pairs": F.lit("y"), "n_a": F.lit(1)}).repartition(3)
    found = op13_alignment.align_texts(docs, slice_pairs=size)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    key = lambda r: tuple(map(str, r))
    want = expected(aligner, rows)
    assert sorted(map(key, found.collect())) == sorted(map(key, want)) and sum(w[1] > 0 for w in want) > 80


def test_counts_are_given_out_in_parts(spark, monkeypatch, aligner):
    monkeypatch.setattr(op13_alignment, "HELD", 20)
    packs = [alignment.packed_rising(np.array(x, np.uint32)) for x in ([1, 2, 70], list(range(50)), [], [2], list(range(30, 60)))]
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(packs[:2], pa.binary())], ["pairs"]), pa.RecordBatch.from_arrays([pa.array(packs[2:], pa.binary())], ["pairs"])]
    total = Counter()
    for b in op13_alignment._count(iter(batches)):
        total.update(dict(zip(b.column("pair").to_pylist(), b.column("n").to_pylist(), strict=True)))
    assert total == Counter([1, 2, 70, *range(50), 2, *range(30, 60)])


def test_no_rows(spark):
    assert op13_alignment.align_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
