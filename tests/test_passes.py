"""Tables of an analysis that keeps nothing: one pass over the texts, without shuffles of sentences."""

import hashlib
from dataclasses import replace

from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import matching, stats, tagging
from glossa.plans.analysis import Analysis, bench_profile, latin_sources
from sample import sample


def bench(spark) -> Analysis:
    docs = spark.createDataFrame([(i, "Orre is on the place of the road. And that is it! In that place to the and with the. Thon on.") for i in range(5)], "doc_id long, text string")
    return Analysis(latin_sources(spark, docs), bench_profile(), keep=False)


def test_counts_need_no_shuffle_of_sentences(spark):
    a = bench(spark)
    found = a.scopes.counted.select("hero_link", "perspective", "marker_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "") and "InMemoryTableScan" not in plan and "Window" not in plan
    assert stats.group_count(a.scopes.counted, "hero_link").count() > 0 and not a._held


def test_names_beside_are_those_of_the_window(spark):
    a = sample(spark)
    key = ["doc_id", "sent_id"]
    wanted = tagging.with_links(a.sentences.select(*key, "hero_name_variant", "has_hero_pronoun"), a.p).select(*key, "hero_link", "hero_evidence")
    assert sorted(wanted.collect()) == sorted(a.sentences.select(*key, "hero_link", "hero_evidence").collect())


def test_phrases_in_row_are_those_of_the_join(spark):
    a = sample(spark)
    sents = a.sentences.select("doc_id", "sent_id", "lemmas")
    joined = matching.with_spans(sents, matching.phrase_index(sents, a.markers), a.p).select("doc_id", "sent_id", F.explode("found").alias("x")).select("doc_id", "sent_id", "x.*")
    assert sorted(joined.collect()) == sorted(matching.phrase_candidates(sents, a.markers, a.p).collect())


def test_no_text_for_few_hits_is_lost(spark):
    a = sample(spark)
    assert sorted(a.with_texts_of_few(a.narrow).select("hit_id", "sent_text", "context_window").collect()) == sorted(a.tagged.select("hit_id", "sent_text", "context_window").collect())


def test_numbering_finds_hits_once(spark):
    found = bench(spark).hits.select("hit_id", "doc_id", "marker_id")
    assert [r.hit_id for r in sorted(found.collect())] == list(range(1, found.count() + 1))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Scan ExistingRDD") == 1


def test_hits_of_a_document_without_id_are_numbered(spark):
    rows = spark.createDataFrame([(None, 0), (None, 1), (3, 0)], "doc_id long, sent_id int")
    assert sorted(r.n for r in matching.numbered(rows, ["sent_id"], "n").collect()) == [1, 2, 3]


def test_openings_change_no_match(spark):
    """First letters are looked for with all that is alike where case is ignored."""
    patterns = ["it|sah|kö", r"is\s+(?:a|the)", "ёж|им", "K", r"to\s+|that"]
    texts = [x + y for x in ("", " ", "x", "\n") for y in ("it", "İT", "ıt", "IT", "ſah", "SAH", "Kö", "kÖ", "K", "Is  the", "ıS a", "Ёж", "ИМ", "ᲂим", "tO that", "Tha", "t", "")]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    assert all(T.opening(p) for p in patterns) and not any(map(T.opening, ["(?:it|is)", "i?t", "it|", "a*b", r"\s+it", "[i]t", "x{0}y", ""]))
    for p in patterns:
        got = rows.select("text", T.matches("text", p).alias("a"), T.matches("text", T.word(p, "a-z"), first=T.opening(p)).alias("b"), F.col("text").rlike("(?iud)" + p).alias("c"), F.col("text").rlike("(?iud)" + T.word(p, "a-z")).alias("d")).collect()
        assert [r for r in got if r.a != r.c or r.b != r.d] == []


def test_blanks_at_the_ends_go(spark):
    blanks = [chr(i) for i in range(0x3001) if spark.sparkContext._jvm.java.util.regex.Pattern.matches("(?U)\\s", chr(i))]
    assert sorted(blanks) == sorted(T.SPACE)
    assert spark.createDataFrame([(T.SPACE + "a b" + T.SPACE,)], "x string").select(T.strip("x")).first()[0] == "a b"


def test_rule_sentences_are_found_once(spark, tmp_path):
    from glossa import language_queries

    text = "﻿The first one. Second, by Mr. X. of the place!  \n\n 3. Third? " * 3
    spark.createDataFrame([(1, text), (2, ""), (3, None), (4, " . ")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = language_queries.rule_sentences(spark, str(tmp_path))
    rows = found.collect()
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Scan parquet") == 1
    assert {r.digest for r in rows if r.doc_id == 1} == {hashlib.md5(text[r.start : r.stop].encode()).hexdigest() for r in rows if r.doc_id == 1} and all(text[r.start : r.stop].strip() == text[r.start : r.stop] for r in rows if r.doc_id == 1)
    assert [r.sent_id for r in sorted(rows, key=lambda r: (r.doc_id, r.start)) if r.doc_id == 1] == list(range(sum(r.doc_id == 1 for r in rows)))


def _logical(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_phrases_are_looked_for_once(spark):
    """No filter on the size of what is found, which would be found again below the projections."""
    from glossa import queries

    a = bench(spark)
    for found in (queries._candidates(a), queries._apart(a), a.dropped):
        assert "(size(" not in "\n".join(x for x in _logical(found).splitlines() if "Filter" in x) and found.count() > 0


def test_texts_are_split_once(spark):
    a = bench(spark)
    assert "Filter" not in _logical(a.plain) and a.plain.count() == 20


def test_counts_are_found_once_for_their_top(spark):
    from glossa.operators import plotdata

    a = bench(spark)
    for found in (stats.dynamics(a.scopes.wide, "book", 2), plotdata.heatmap(a.scopes.wide, "part", "microtheme"), plotdata.dynamics_lines(a.scopes.wide, a.sources.parts, "part")):
        assert found.collect()
        assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Scan ExistingRDD") == 1


def test_no_filter_by_a_confidence_that_all_hits_have(spark):
    assert "perspective_confidence" not in str(stats.is_counted(bench_profile()))


def test_examples_without_numbering_all_hits(spark):
    """The same as from all hits with their ids, whatever the order of documents; documents without id come first."""
    from glossa.operators import quality

    lines = ["Orre is on the place of the road. And that is it! In that place to the and with the. Thon on.", "No marker here.", "That of the, in that on. He is with the."]
    docs = spark.createDataFrame([(None if i == 4 else (i * 7) % 11 - 3, lines[i % 3] * (1 + i % 2)) for i in range(9)], "doc_id long, text string")
    a = Analysis(latin_sources(spark, docs), bench_profile(), keep=False)
    blank = lambda df: df.withColumns({c: F.lit("") for c in ("sent_text", "context_window")})
    for topic in ("strict", "core", "inner", "doubt"):
        met, title = quality.choices(a.p)[topic]
        first, whole = (quality.examples(df, title, 3, 2, texts=blank) for df in (a.first_of(stats.is_clean() & met, 3, 2), quality.selections(a.clean, a.p)[topic][0]))
        assert sorted(map(str, first.collect())) == sorted(map(str, whole.collect()))
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_tagged_hits_carry_their_texts(spark):
    """The same as texts joined to the hits, in one pass and without putting sentences in order."""
    lines = ["Orre is on the place of the road. And that is it! In that place to the and with the. Thon on.", "That of the.", "No marker. That of the, in that on! None? He is with the."]
    docs = spark.createDataFrame([(None if i == 4 else i, lines[i % 3]) for i in range(7)], "doc_id long, text string")
    for radius, most in ((1, None), (2, None), (0, None), (2, 3)):
        a = Analysis(latin_sources(spark, docs), replace(bench_profile(), context_window_sentences=radius), max_sents=most, keep=False)
        columns = ["hit_id", "doc_id", "sent_id", "marker_id", "perspective", "hero_evidence", "part", "sent_text", "prev_sent_text", "next_sent_text", "context_window"]
        found = a.tagged.select(*columns)
        got = found.collect()
        joined = a.with_texts(a.narrow.where("doc_id IS NOT NULL")).select(*columns).collect()
        assert got and sorted(map(str, (r for r in got if r.doc_id is not None))) == sorted(map(str, joined))
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("Scan ExistingRDD") == 1 and "lag(" not in plan
