import hashlib
from dataclasses import replace

import pytest
from sample import HITS, LEMMAS, NESTED, SENTENCES, SHA256, TEXT, sample

from glossa.plans.profile import RUSSIAN


@pytest.fixture(scope="module")
def analysis(spark):
    return sample(spark)


def test_text_is_the_sample():
    assert hashlib.sha256(TEXT.encode()).hexdigest() == SHA256


def test_headings_and_sentences(analysis):
    found = [(r.heading_id, r.line_no, r.char_pos_approx, r.heading_type, r.heading_text) for r in analysis.headings.orderBy("heading_id").collect()]
    assert found == [(1, 1, 0, "book", "Книга первая"), (2, 6, 256, "book", "Книга вторая")]
    rows = analysis.sentences.orderBy("sent_id").collect()
    assert tuple(r.sent_text for r in rows) == SENTENCES
    assert [r.word_count for r in rows] == [7, 8, 15, 6, 5]


def test_hits_and_tags(analysis):
    rows = analysis.tagged.orderBy("hit_id").collect()
    assert tuple((r.hit_id, r.hit_type, r.marker_id, r.sent_id, r.token_idx, r.token_end_idx, r.is_noise, r.phrase_overlap_ids, r.count_in_main_stats, r.hero_link, r.perspective, r.perspective_confidence) for r in rows) == HITS
    assert {r.part for r in rows} == {"Часть 1"} and {r.book_id for r in rows} == {-1}
    assert rows[3].noise_reason == "PARTICLE_PODUMAYESH"
    assert rows[12].perspective_evidence == "direct_speech+inner_marker;speech_verb_after_name:Гришка"
    assert rows[0].context_window == " ".join(SENTENCES[:2]) and rows[0].prev_sent_text == ""
    assert analysis.counted.count() == 8


def test_nested(analysis):
    rows = analysis.nested.orderBy("candidate_id").collect()
    assert tuple((r.marker_id, r.sent_id, r.token_idx, r.token_end_idx, r.nested_overlap_with, r.candidate_id) for r in rows) == NESTED


def test_keep_all_keeps_nested_and_empty_corpus_is_typed(spark):
    p = replace(RUSSIAN, lemmas=LEMMAS, overlap_mode="keep_all")
    every = sample(spark, profile=p)
    assert every.hits.where("hit_type = 'PHRASE'").count() == 8 and every.nested.count() == 0
    empty = sample(spark, docs=spark.createDataFrame([], "doc_id long, text string"))
    assert empty.tagged.count() == 0 and "perspective" in empty.tagged.columns
    blank = sample(spark, docs=spark.createDataFrame([(1, None), (2, ""), (3, " \n ")], "doc_id long, text string"))
    assert blank.tagged.count() == 0 and blank.sentences.count() == 0


def test_the_profile_has_its_own_lemmas(spark):
    rows = sample(spark, profile=RUSSIAN).tagged.orderBy("hit_id").collect()
    assert len(rows) >= 14 and {r.target_lemma for r in rows if r.hit_type == "WORD"} >= {"думать"}
    assert len(RUSSIAN.verbs) == len(set(RUSSIAN.verbs)) == 41


def test_plug_ins(spark):
    from pyspark.sql import functions as F

    p = replace(RUSSIAN, lemmatizer=lambda t: F.when(t.startswith("вспом"), "вспомнить").otherwise(F.lower(t)), tokenizer=lambda s: F.split(s, " "), sentence_splitter=lambda s: F.split(s, r"\|"))
    docs = spark.createDataFrame([(1, "Он вспомнила всё|а потом")], "doc_id long, text string")
    rows = sample(spark, docs=docs, profile=p).sentences.orderBy("sent_id").collect()
    assert [(r.tokens, r.lemmas) for r in rows] == [(["Он", "вспомнила", "всё"], ["он", "вспомнить", "всё"]), (["а", "потом"], ["а", "потом"])]


def test_segments_of_several_documents(spark):
    from glossa.operators import segments, stats, tagging

    docs = spark.createDataFrame([(i, TEXT) for i in range(3)], "doc_id long, text string")
    books, parts = segments.build_segments(docs, RUSSIAN)
    a = sample(spark, docs=docs)
    a.sources = replace(a.sources, books=books, parts=parts)
    assert a.tagged.count() == a.hits.count() == 3 * len(HITS)
    rates = stats.segment_rates(a.linked, a.sentences, parts, "part")
    assert rates.count() == parts.count() and rates.agg({"sentences": "sum"}).first()[0] <= 15
    assert stats.analytical_indices(a.linked, rates).count() == a.linked.select("part").distinct().count()
    assert tagging.with_labels(a.tagged).where("perspective_label = perspective").count() == 0
