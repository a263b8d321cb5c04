import itertools
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import lexicon, matching, plotdata, quality, segments, stats, tagging, texts
from glossa.plans.analysis import CURATED, PHRASES, THEMES
from glossa.plans.profile import LATIN, RUSSIAN, load_config, unique


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def docs(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


# ------------------------------------------------------------------ text


def test_lines_and_headings(spark):
    text = "﻿Книга I.\r\nглава вторая\n в середине Часть первая слова\nЧасть 2 —\x0bТом пятый"
    rows = texts.headings(docs(spark, text), RUSSIAN).orderBy("heading_id").collect()
    assert [(r.line_no, r.heading_type, r.heading_text) for r in rows] == [(1, "book", "Книга I."), (2, "heading", "глава вторая"), (4, "part", "Часть 2 —"), (5, "heading", "Том пятый")]
    assert texts.without_headings(docs(spark, "Книга I\nтекст"), RUSSIAN).first().text == "\nтекст"
    kept = texts.headings(docs(spark, "Книга I"), replace(RUSSIAN, remove_headings_from_analysis=False)).first()
    assert kept.removed_from_analysis is False


def test_sentences_and_tokens(spark):
    got = one(spark, T.sentences(F.lit("Раз… Два?!  Три\n без конца"), RUSSIAN))
    assert got == ["Раз…", "Два?!", "Три\n без конца"]
    assert one(spark, T.tokens(F.lit("из-за 2-х слов, ё_ж"), RUSSIAN)) == ["из-за", "2-х", "слов", "ё", "ж"]
    assert one(spark, T.lemmas(F.array(F.lit("Ёж"), F.lit("Стало")), replace(RUSSIAN, lemmas={"стало": "стать"}))) == ["еж", "стать"]


def test_helpers(spark):
    assert one(spark, T.looks_like_direct_speech(F.lit("«а» б"), RUSSIAN)) and one(spark, T.looks_like_direct_speech(F.lit("— а"), RUSSIAN)) and not one(spark, T.looks_like_direct_speech(F.lit("а - б"), RUSSIAN))
    assert one(spark, T.proper_names(F.lit("Иван видел Петра"), RUSSIAN)) == ["Петра"] and one(spark, T.proper_names(F.lit("Петров видел Анну"), RUSSIAN)) == ["Петров", "Анну"]
    assert one(spark, T.find_name(F.lit("мелеховский МЕЛЕХОВ"), RUSSIAN)) == "Мелехов" and one(spark, T.find_name(F.lit("мелеховский"), RUSSIAN)) == ""
    assert [one(spark, T.half_even(F.lit(x), 2)) for x in (0.125, 0.135)] == [0.12, 0.14]
    assert one(spark, T.contains_any(F.lit("abc"), ["x", "bc"])) is True


# ------------------------------------------------------------------ lexicon


def test_registry(spark):
    curated = spark.createDataFrame([("A1", "X/Y", "Слово", "word", ""), ("A2", "", "другое", "WORD", "")], CURATED)
    units = spark.createDataFrame([(0, "# c"), (1, " слово "), (2, ""), (3, "мысль")], "ord int, value string")
    phrases = spark.createDataFrame([("7", "a b", "", "x / y", "", "", "m", "yes", "", ""), ("8", "c", "c", "навязчивая мысль", "F", "extended", "m", "0", "", "")], PHRASES)
    themes = spark.createDataFrame([("Тема", "x / y; ёж"), ("Ещё", "еж"), ("", "нет")], THEMES)
    rows = {r.marker_id: r for r in lexicon.registry(curated, units, phrases, themes, RUSSIAN).collect()}
    assert set(rows) == {"A1", "A2", "PHR_007", "ALEX_002"}  # the listed `слово` is the curated one's copy
    assert rows["A1"].microtheme == "Тема" and rows["A1"].marker_label == "слово [Тема]" and rows["A2"].microtheme == RUSSIAN.default_theme
    assert rows["PHR_007"].unit_norm == "a b" and rows["PHR_007"].phrase_family == "PHRASE_GENERAL" and rows["PHR_007"].precision_level == "CORE"
    assert rows["ALEX_002"].microtheme == "инициация мысли"
    aliases = dict(lexicon.theme_aliases(themes).collect())
    assert aliases["еж"] == "Ещё" and aliases["тема"] == "Тема"
    bare = phrases.drop("precision_level", "source_type", "comment").withColumn("microtheme", F.lit("навязчивая мысль"))
    assert lexicon.phrases(bare, lexicon.theme_aliases(themes), RUSSIAN).first().precision_level == "EXTENDED"


# ------------------------------------------------------------------ matching


def reference_match(lemmas, pattern, gap):
    """Greedy spans by definition, for comparison."""
    found = []
    for i, first in enumerate(lemmas):
        at = i if first == pattern[0] else None
        for want in pattern[1:]:
            if at is not None:
                near = [k for k in range(at + 1, min(len(lemmas), at + gap + 2)) if lemmas[k] == want]
                at = near[0] if near else None
        if at is not None:
            found.append((i, at))
    return found


@pytest.mark.parametrize("gap", [0, 2])
def test_gap_match_random(spark, gap):
    rng = random.Random(gap)
    sents = [(0, i, [rng.choice("abc") for _ in range(rng.randint(0, 9))]) for i in range(60)] + [(0, 60, list("abbxxc")), (0, 61, list("axxb")), (0, 62, list("axxxb"))]
    patterns = ["a", "a b", "a b c", "a a", "c b a a b c a b c a"]
    markers = spark.createDataFrame([(f"M{i}", "PHRASE", p, i) for i, p in enumerate(patterns)], "marker_id string, unit_type string, unit_norm string, marker_ord int")
    frame = spark.createDataFrame(sents, "doc_id long, sent_id int, lemmas array<string>")
    p = replace(LATIN, phrase_gap=gap)
    got = sorted((r.sent_id, r.marker_id, r.start, r.stop) for r in matching.phrase_candidates(frame, markers, p).collect())
    want = sorted((s, f"M{i}", a, b) for _, s, lemmas in sents for i, pat in enumerate(patterns) for a, b in reference_match(lemmas, pat.split(), gap))
    assert got == want
    if gap == 2:
        assert not [x for x in got if x[0] == 60 and x[1] == "M2"]  # no second try
    # resolution: kept spans never overlap, each dropped one overlaps a kept one, each candidate that is apart is one of them
    resolved = matching.resolve(matching.phrase_candidates(frame, markers, p), p).collect()
    for r in resolved:
        spans = [(k.start, k.stop) for k in r.kept]
        assert all(b[0] > a[1] or a[0] > b[1] for a, b in itertools.combinations(spans, 2))
        for d in r.dropped:
            over = d.over.split(";")
            assert over and all(any(k.marker_id == m and k.start <= d.stop and d.start <= k.stop for k in r.kept) for m in over)


def test_resolution_ties(spark):
    rows = [(0, 0, "B", 0, 1), (0, 0, "A", 0, 1), (0, 0, "C", 1, 2), (0, 0, "D", 2, 3), (0, 0, "A", 1, 2)]
    frame = spark.createDataFrame(rows, "doc_id long, sent_id int, marker_id string, start long, stop long")
    r = matching.resolve(frame, LATIN).first()
    assert [(k.marker_id, k.start) for k in r.kept] == [("A", 0), ("D", 2)]
    assert sorted((d.marker_id, d.over) for d in r.dropped) == [("B", "A"), ("C", "A")]  # the second A starts within the first


def test_noise_rules(spark):
    rows = [("2", "x", "", "", "second", "1"), ("1", "", "X", "", "", "yes"), ("3", "", "", "(", "broken", "1"), ("4", "", "", "", "off", "0"), ("5", "", "", "^END", "by text", "true")]
    rules = matching.enabled_exclusions(spark.createDataFrame(rows, "id string, lemma string, surface string, regex string, reason string, enabled string"))
    assert [r["reason"] for r in rules] == ["EXCLUSION_TABLE", "second", "by text"]
    reason = lambda lem, s, t: one(spark, matching.noise_reason(F.lit(lem), F.lit(s), F.lit(t), rules, RUSSIAN))
    assert reason("x", "x", "") == "EXCLUSION_TABLE" and reason("x", "y", "") == "second" and reason("y", "y", "end") == "by text" and reason("y", "y", "no end") is None
    assert reason("подумать", "Подумаешь", "end") == "PARTICLE_PODUMAYESH"


def test_ids_are_dense(spark):
    rows = [(d, s) for d in (0, 1, 4095, 4096, 9000, 20000) for s in range(d % 3 + 1)]
    got = matching.numbered(spark.createDataFrame(rows, "doc_id long, sent_id int"), [F.col("sent_id")], "n").orderBy("doc_id", "sent_id").collect()
    assert [r.n for r in got] == list(range(1, len(rows) + 1))


# ------------------------------------------------------------------ tagging


VIEWS = [
    ("— Иду, — сказал Григорий.", ("HERO_DIRECT_SPEECH", "HIGH", "Григорий", "")),
    ("— Иду, — мысленно сказал Григорий.", ("HERO_INNER_SPEECH", "HIGH", "Григорий", "")),
    ("— Иди, — сказал Петр Григорию.", ("OTHERS_TO_HERO", "HIGH", "Петр", "Григорию")),
    ("— Григорий, подумай, — сказал Петр.", ("OTHERS_TO_HERO", "HIGH", "Петр", "Григорий")),
    ("— Ну, — сказал Петр.", ("UNKNOWN", "LOW", "Петр", "")),
    ("— Григорий!", ("OTHERS_TO_HERO", "LOW", "UNKNOWN", "Григорий")),
    ("Петр сказал: Григорий, подумай.", ("OTHERS_TO_HERO", "HIGH", "Петр", "Григорий")),
    ("Петр сказал Григорию: подумай.", ("NARRATOR_ABOUT_HERO", "HIGH", "NARRATOR", "")),  # any name after the verb speaks
    ("Григорий мысленно спорил.", ("HERO_INNER_SPEECH", "HIGH", "HERO_PROBABLE", "")),
    ("Дождь.", ("UNKNOWN", "LOW", "UNKNOWN", "")),
]


def test_perspectives_and_proximity(spark):
    lone = [(i, 0, s) for i, (s, _) in enumerate(VIEWS)]
    near = [(100, i, s) for i, s in enumerate(("Григорий шел.", "Он молчал.", "Дождь.", "Снег.", "Аксинья и Гриша."))]
    frame = spark.createDataFrame(lone + near, "doc_id long, sent_id int, sent_text string")
    rows = {(r.doc_id, r.sent_id): r for r in tagging.tagged_sentences(frame, RUSSIAN).collect()}
    for i, (sentence, expected) in enumerate(VIEWS):
        r = rows[i, 0]
        assert (r.perspective, r.perspective_confidence, r.speaker_detected, r.addressee_detected) == expected, sentence
    assert "OTHERS_ABOUT_HERO" not in {r.perspective for r in rows.values()}  # never reached: a name in the sentence makes an addressee
    assert [rows[100, i].hero_link for i in range(5)] == ["YES", "PROBABLE", "NO", "PROBABLE", "YES"]
    assert rows[100, 1].hero_evidence == "prev_sentence:Григорий+pronoun" and rows[100, 3].hero_evidence == "next_sentence:Гриша"
    assert rows[100, 1].perspective_evidence == "narrative_context;hero_near+pronoun" and rows[100, 1].perspective_confidence == "MEDIUM"


@pytest.mark.parametrize(("window", "expected"), [(0, ["NO", "NO", "YES"]), (2, ["PROBABLE", "PROBABLE", "YES"])])
def test_link_window(spark, window, expected):
    frame = spark.createDataFrame([(0, 0, "", False), (0, 1, "", False), (0, 2, "Гриша", False)], "doc_id long, sent_id int, hero_name_variant string, has_hero_pronoun boolean")
    assert [r.hero_link for r in tagging.with_links(frame, replace(RUSSIAN, window_sentences=window)).orderBy("sent_id").collect()] == expected


def test_speech_acts(spark):
    acts = [one(spark, tagging.speech_act(F.lit(s), RUSSIAN)) for s in ("Не думает он.", "Пойми.", "Дурной день.", "Так.")]
    assert acts == ["EVALUATE", "PROMPT", "EVALUATE", "STATEMENT"]
    assert one(spark, tagging.speech_act(F.lit("Так."), RUSSIAN, imperative=F.lit(True))) == "PROMPT"


def test_segments_by_interval(spark):
    hits = spark.createDataFrame([(i,) for i in range(6)], "sent_id int")
    seg = spark.createDataFrame([(1, "A", 1, 2), (2, "B", 4, 4)], "part_id int, part string, start_sent int, end_sent int")
    got = tagging.assign_segments(tagging.assign_segments(hits, seg, "part"), None, "book").orderBy("sent_id").collect()
    assert [(r.part_id, r.part) for r in got] == [(-1, "UNKNOWN"), (1, "A"), (1, "A"), (-1, "UNKNOWN"), (2, "B"), (-1, "UNKNOWN")] and got[0].book == "UNKNOWN"


def test_build_segments(spark):
    text = "Пролог.\nКнига первая\nЭпиграф.\nЧасть первая\nА. Б.\nЧасть вторая\nВ.\nКнига вторая\nЧасть третья\nГ. Д."
    books, parts = segments.build_segments(docs(spark, text, "Раз. Два. Три. Четыре. Пять."), RUSSIAN)
    b = [(r.book_id, r.book_name) for r in books.where("doc_id = 0").orderBy("book_id").collect()]
    assert b == [(1, "Книга первая"), (2, "Книга вторая")]
    q = [(r.part_id, r.part_name, r.book_id) for r in parts.where("doc_id = 0").orderBy("part_id").collect()]
    assert q == [(1, "Часть первая", 1), (2, "Часть вторая", 1), (3, "Часть третья", 2)]
    equal = [(r.book_id, r.book_name, r.start_sent, r.end_sent) for r in books.where("doc_id = 1").orderBy("book_id").collect()]
    assert equal == [(1, "Book 1", 0, 1), (2, "Book 2", 2, 2), (3, "Book 3", 3, 3), (4, "Book 4", 4, 4)]
    assert parts.where("doc_id = 1").count() == 5
    offsets = texts.sentence_offsets(docs(spark, "  Аб. Вг!  Д"), RUSSIAN).orderBy("sent_id").collect()
    assert [(r.sent_id, r.start, r.stop) for r in offsets] == [(0, 2, 5), (1, 6, 9), (2, 11, 12)]


# ------------------------------------------------------------------ scopes and tables

HIT = "hit_id long, marker_id string, marker_label string, unit_type string, microtheme string, phrase_family string, marker_source string, precision_level string, is_noise boolean, count_in_main_stats boolean, hit_type string, overlaps_phrase boolean, hero_link string, perspective string, perspective_confidence string, part string, doc_id long, sent_id int, token_idx long"


def hit(i, marker="A", level="CORE", noise=False, main=True, link="YES", view="UNKNOWN", conf="LOW", part="P", theme="t", sent=0, kind="WORD", inside=False):
    return (i, marker, marker.lower(), kind, theme, "F", "S", level, noise, main, kind, inside, link, view, conf, part, 0, sent, 0)


@pytest.fixture(scope="module")
def hits(spark):
    rows = [hit(1), hit(2, noise=None, main=None), hit(3, noise=True), hit(4, main=False), hit(5, "B", "EXTENDED", link="PROBABLE", view="HERO_INNER_SPEECH", conf="HIGH", part="Q"), hit(6, "C", "EXPERIMENTAL", link="NO"), hit(7, "B", "EXTENDED", conf=None, theme="u", sent=5)]
    return spark.createDataFrame(rows, HIT)


def test_scopes_nest(hits):
    p = LATIN
    ids = lambda df: {r.hit_id for r in df.collect()}
    counted = ids(stats.counted(hits, p))
    assert counted == {1, 2, 5, 7} and ids(stats.clean(hits)) == {1, 2, 5, 6, 7}
    assert ids(stats.linked(stats.counted(hits, p), "STRICT")) == {1, 2, 7} and ids(stats.linked(stats.counted(hits, p), "wide")) == {1, 2, 5, 7}
    assert ids(stats.counted(hits, replace(p, include_noise_in_counts=True))) == {1, 2, 3, 5, 7}
    assert ids(stats.counted(hits, replace(p, min_perspective_confidence_main="HIGH"))) == {5}
    assert ids(stats.counted(hits, replace(p, enabled_precision_levels=("CORE", "EXPERIMENTAL")))) == {1, 2}


def test_tables(spark, hits):
    p = LATIN
    main = stats.counted(hits, p)
    sents = spark.createDataFrame([(0, i, 10) for i in range(8)], "doc_id long, sent_id int, word_count int")
    top = {r.marker_id: r for r in stats.by_marker(main, sents).collect()}
    assert (top["A"]["count"], top["A"].share_pct, top["A"].per_1000_sentences, top["A"].per_10000_words) == (2, 50.0, 250.0, 250.0)
    seg = spark.createDataFrame([(1, "P", 0, 3), (2, "Q", 4, 7), (3, "R", 50, 60)], "part_id int, part_name string, start_sent int, end_sent int")
    rates = {r.part: r for r in stats.segment_rates(main, sents, seg, "part").collect()}
    assert (rates["P"].hits, rates["Q"].hits, rates["R"].hits, rates["R"].hits_per_1000_sentences) == (3, 1, 0, 0.0)
    idx = {r.part: r for r in stats.analytical_indices(main, stats.segment_rates(main, sents, seg, "part")).collect()}
    assert idx["Q"].inner_speech_index_pct == 100.0 and idx["P"].extended_cognition_index_pct == 33.33
    assert {r["count"] for r in stats.strict_vs_wide(main, "STRICT").collect()} == {3, 4}
    assert stats.pivot_matrix(main, "part", "precision_level").orderBy("part").collect()[0].asDict() == {"part": "P", "CORE": 2, "EXTENDED": 1}
    shares = [r.share_pct for r in stats.hero_vs_corpus(main).where("scope = 'CORPUS_COUNTED'").collect()]
    assert sum(shares) == pytest.approx(100, abs=0.05)
    empty = main.limit(0)
    assert stats.by_marker(empty, sents).count() == 0 and stats.overview(hits.limit(0), hits.limit(0).withColumn("unit_norm", F.lit("")), sents, p).count() == 18
    assert quality.manual_required(main).count() == 4
    assert plotdata.perspective_bars(main).count() == 7 and plotdata.pie(main, 1).orderBy(F.desc("count")).first()["count"] == 2
    assert plotdata.dynamics_lines(main, seg, "part", 2).count() == 6
    assert stats.reflag_overlaps(hits.withColumn("overlaps_phrase", F.lit(True)), p).where("count_in_main_stats").count() == 0


def test_config(spark):
    p, rest = load_config('{"name_variants": [" Иван ", "Гриша"], "melekhov_link_mode": "wide", "enabled_precision_levels": ["core"], "phrase_gap": 1, "corpus_path": "x", "noise_filters": {"a": false}}', RUSSIAN)
    assert p.names[:2] == ("Иван", "Гриша") and p.names.count("Гриша") == 1 and p.link_mode == "WIDE" and p.enabled_precision_levels == ("CORE",) and p.phrase_gap == 1 and p.builtin_noise == ()
    assert rest["corpus_path"] == "x" and unique(["a", " a", ""]) == ("a",)
