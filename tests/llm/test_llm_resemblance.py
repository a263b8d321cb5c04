"""Near copies of the pipeline's stage, against brute force."""

import random

from glossa.llm import op05_simhash, resemblance


def words(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def edited(rng, text, k):
    w = text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = f"new{rng.randrange(999)}"
    return " ".join(w)


def test_keep_one_by_definition(spark, monkeypatch):
    rng = random.Random(5)
    bases = [" ".join(f"w{rng.randrange(400)}" for _ in range(n)) for n in (3, 4, 6, 12, 40, 90, 150, 300)]
    rows = [(i, edited(rng, b := rng.choice(bases), rng.randint(0, max(1, len(b.split()) // 25)))) for i in range(120)]
    rows += [(200 + i, bases[6] + f" tail{i} more{i} words{i}") for i in range(30)]
    rows += [(300, None), (301, ""), (302, bases[4]), (None, bases[4]), (None, "one without id"), (7, rows[7][1])]
    sets = [words(t) for _, t in rows]
    of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if of[i] != of[j] and alike(sets[i], sets[j]):
                of = [of[j] if x == of[i] else x for x in of]
    least = {}
    for (i, _), g in zip(rows, of, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((i, least.get(g)) for (i, _), g in zip(rows, of, strict=True) if i is not None)
    for pairs in (resemblance.PAIRS, 0):
        monkeypatch.setattr(resemblance, "PAIRS", pairs)
        assert sorted(tuple(r) for r in resemblance.near_copies(docs).where("doc_id is not null").collect()) == want
    kept = op05_simhash.keep_one(docs)
    assert sorted(r[0] for r in kept.where("doc_id is not null").collect()) == sorted(set(least.values()))
    assert kept.where("doc_id is null").count() == 2
    assert len(set(least.values())) > 5


def test_every_pair_of_large_buckets(spark, monkeypatch):
    """All pairs of different groups in a bucket of 40 rows, whatever the cells and however many other rows there are."""
    rows = [(1, 40, i, i // 2, 10, [0] * 16) for i in range(40)] + [(2, 3, 100 + i, i, 10 + 4 * i, [0] * 16) for i in range(3)] + [(3, 2, 200 + i, i, 10, [-i] * 16) for i in range(2)]
    table = spark.createDataFrame(rows, "band long, rows long, key long, `group` long, size long, bits array<long>")
    want = sorted((i, j) for i in range(40) for j in range(40) if i // 2 < j // 2)
    for pairs in (resemblance.PAIRS, 0):
        monkeypatch.setattr(resemblance, "PAIRS", pairs)
        assert sorted(tuple(r) for r in resemblance.every_pair(table).collect()) == want


def test_a_chain_in_one_large_bucket_is_one_group(spark, monkeypatch):
    """Sets that meet in one bucket of over 16 rows alone, of which only neighbours are alike: leaders see few of the links."""
    import numpy as np

    words = [f"w{i}" for i in range(260)]
    docs = spark.createDataFrame([(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(40)], "doc_id long, text string")
    monkeypatch.setattr(resemblance, "buckets", lambda found: np.array([7], np.int64))
    assert {r.component_id for r in resemblance.near_copies(docs).collect()} == {0}


def test_sets_of_similarity_four_fifths_meet():
    """Recall of the buckets: of pairs just above 4/5, nearly all share one."""
    import numpy as np

    rng = np.random.RandomState(3)
    met = 0
    for i in range(400):
        n = int(rng.randint(30, 900))
        shared, own = -(-8 * n // 9), n - -(-8 * n // 9)
        values = rng.randint(-(1 << 63), (1 << 63) - 1, shared + 2 * own, np.int64)
        a, b = np.unique(values[: shared + own]), np.unique(np.concatenate([values[:shared], values[shared + own :]]))
        both = len(np.intersect1d(a, b))
        assert 5 * both >= 4 * len(np.union1d(a, b)) and resemblance.common(np.sort(a.astype(np.int32)), np.sort(b.astype(np.int32))) == both
        met += bool(set(resemblance.buckets(a).tolist()) & set(resemblance.buckets(b).tolist()))
    assert met >= 396
    assert len(resemblance.buckets(np.zeros(0, np.int64))) == 0 and len(resemblance.buckets(np.array([5]))) == resemblance.BANDS
    far = [len(set(resemblance.buckets(rng.randint(0, 1 << 60, 300)).tolist()) & set(resemblance.buckets(rng.randint(0, 1 << 60, 300)).tolist())) for _ in range(50)]
    assert not any(far)


def test_values_in_common():
    import numpy as np

    assert resemblance.common(np.array([1, 1, 2, 3], np.int32), np.array([1, 1, 1, 3], np.int32)) == 3
    assert resemblance.common(np.array([], np.int32), np.array([1], np.int32)) == 0
