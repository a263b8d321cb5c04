"""The phrase index and the size of what matching keeps."""

import random
from dataclasses import replace

from pyspark.sql import functions as F

from glossa.operators import matching
from glossa.plans.analysis import Analysis, latin_sources
from glossa.plans.profile import LATIN
from test_operators import reference_match


def markers_of(spark, patterns):
    return spark.createDataFrame([(f"M{i}", "PHRASE", p, i) for i, p in enumerate(patterns)], "marker_id string, unit_type string, unit_norm string, marker_ord int")


def test_phrases_lie_under_their_rarest_lemma(spark):
    sents = spark.createDataFrame([(0, i, ["the"] * 3 + (["old"] if i % 3 == 0 else []) + (["man"] if i % 5 == 0 else [])) for i in range(30)], "doc_id long, sent_id int, lemmas array<string>")
    markers = markers_of(spark, ["the old man", "the the", "man old", "the never seen", "  ", "old"])
    got = {r.marker_id: (r.anchor, r.place) for r in matching.phrase_index(sents, markers).collect()}
    assert got == {"M0": ("man", 3), "M1": ("the", 1), "M2": ("man", 1), "M3": ("never", 2), "M5": ("old", 1)}
    # A sentence is asked for phrases whose anchor it holds, however common their first lemma is.
    asked = matching.asked_phrases(sents, matching.phrase_index(sents, markers.where("marker_id IN ('M0', 'M3')")))
    assert sorted(r.sent_id for r in asked.collect()) == [i for i in range(30) if i % 5 == 0]


def test_many_phrases_random(spark):
    """Hundreds of phrases with common first lemmas, against plain matching from every place."""
    rng = random.Random(4)
    weights = [40, 20, 10, 5, 3, 2, 1, 1]
    sents = [(0, i, rng.choices("abcdefgh", weights, k=rng.randrange(40))) for i in range(40)] + [(1, 0, []), (1, 1, ["z"])]
    patterns = sorted({" ".join(rng.choices("abcdefgh", weights, k=rng.randrange(1, 6))) for _ in range(300)})
    frame = spark.createDataFrame(sents, "doc_id long, sent_id int, lemmas array<string>")
    p = replace(LATIN, phrase_gap=2)
    got = sorted((r.doc_id, r.sent_id, r.marker_id, r.start, r.stop) for r in matching.phrase_candidates(frame, markers_of(spark, patterns), p).collect())
    assert got == sorted((d, s, f"M{i}", a, b) for d, s, lemmas in sents for i, pat in enumerate(patterns) for a, b in reference_match(lemmas, pat.split(), 2))


def kept_bytes(spark, tokens):
    """What an analysis of one sentence of so many tokens, all of them markers, keeps."""
    docs = spark.createDataFrame([(0, " ".join(["the", "of", "that", "on"][i % 4] for i in range(tokens)))], "doc_id long, text string")
    a = Analysis(latin_sources(spark, docs), LATIN)
    assert a.narrow.count() > tokens / 2
    size = sum(x.memSize() + x.diskSize() for x in spark.sparkContext._jsc.sc().getRDDStorageInfo())
    a.release()
    return size


def test_what_is_kept_grows_with_the_tokens(spark):
    spark.catalog.clearCache()
    small, large = kept_bytes(spark, 500), kept_bytes(spark, 2_000)
    assert large < 6 * small


def test_hits_are_narrow(spark):
    docs = spark.createDataFrame([(0, "The of the. On that.")], "doc_id long, text string")
    a = Analysis(latin_sources(spark, docs), LATIN, keep=False)
    assert not {"sent_text", "context_window", "tokens", "lemmas"} & set(a.hits.columns)
    assert {r.sent_text for r in a.tagged.where(F.col("sent_id") == 1).collect()} == {"On that."}
