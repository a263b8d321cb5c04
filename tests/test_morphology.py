"""The morphological dictionary against plain code, and analyses with one."""

import random
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from glossa.operators import joins, morphology
from glossa.plans.profile import RUSSIAN
from glossa.sources import files
from sample import HITS, LEMMAS, NESTED, sample

ROWS = [
    ("Стали", "стать", "VERB,past", 9), ("стали", "сталь", "NOUN,gent", 4), ("СТАЛИ", "сталь", "NOUN,gent", 3), ("пойми", "понять", "VERB,impr", 2), ("ёж", "ёж", "NOUN", None), ("", "x", "A", 1), ("x", None, "A", 1), ("дом", "дом", None, 1),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "form string, lemma string, tags string, weight long")


def found(spark, words):
    return spark.createDataFrame([(w, n) for w, n in Counter(words).items()], "word string, n long")


def test_a_dictionary_adds_up_its_parses(spark):
    got = {(r.form, r.lemma, r.tags): r.weight for r in morphology.dictionary(frame(spark, ROWS)).collect()}
    assert got == {("стали", "стать", "VERB,past"): 9, ("стали", "сталь", "NOUN,gent"): 7, ("пойми", "понять", "VERB,impr"): 2, ("еж", "еж", "NOUN"): 1, ("дом", "дом", "UNK"): 1}
    bare = morphology.dictionary(spark.createDataFrame([("a", "b"), ("a", "b")], "form string, lemma string")).collect()
    assert [tuple(r) for r in bare] == [("a", "b", "UNK", 2)]
    assert morphology.dictionary(frame(spark, [])).collect() == []


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def plain_rules(parses, longest, seen):
    count = Counter()
    for form, lemma, tags, _ in parses:
        same = common(form, lemma)
        for size in range(max(len(form) - same, 1), min(longest, len(form) - 1) + 1):
            count[form[-size:], len(form) - same, lemma[same:], tags] += 1
    best = {}
    for (ending, cut, added, tags), n in count.items():
        if n >= seen:
            best[ending] = min(best.get(ending, (0, 99, "", "")), (-n, cut, added, tags))
    return {e: (cut, added, tags, -n) for e, (n, cut, added, tags) in best.items()}


def plain_analysis(word, parses, rules, longest):
    own = sorted((-w, lemma, tags) for form, lemma, tags, w in parses if form == word)
    if own:
        return own[0][1], own[0][2], " ".join(dict.fromkeys(t for _, _, t in own)), "dictionary"
    for size in range(min(longest, len(word) - 1), 0, -1):
        if word[-size:] in rules:
            cut, added, tags, _ = rules[word[-size:]]
            return word[: len(word) - cut] + added, tags, tags, "ending"
    return word, "UNK", "UNK", "itself"


@pytest.mark.parametrize("seed", range(3))
def test_rules_and_analyses(spark, seed):
    rng = random.Random(seed)
    letters = lambda n: "".join(rng.choices("абё" if seed else "ab", k=n))
    parses = {}
    for _ in range(150):
        stem, (a, b, t) = letters(rng.randrange(5)), rng.choice([("ал", "ать", "V"), ("а", "", "N"), ("", "", "B"), ("ая", "ый", "A"), ("аб", "ба", "V,impr")])
        if stem + a and stem + b:
            key = (stem + a).replace("ё", "е"), (stem + b).replace("ё", "е"), t
            parses[key] = parses.get(key, 0) + rng.randrange(1, 4)
    flat = [(*k, w) for k, w in parses.items()]
    forms = morphology.dictionary(frame(spark, flat))
    rules = plain_rules(flat, 3, 2)
    got = morphology.ending_rules(forms, 3, 2)
    assert {r.ending: (r.cut, r.added, r.tags, r.n) for r in got.collect()} == rules
    asked = [*(letters(rng.randrange(1, 8)).replace("ё", "е") for _ in range(80)), "а", "щ", "z" * 300, *(k[0] for k in list(parses)[:20])]
    rows = morphology.analyse(found(spark, asked), forms, got, 3).collect()
    assert len(rows) == len(set(asked)) and {r.how for r in rows} == {"dictionary", "ending", "itself"}
    for r in rows:
        assert (r.lemma, r.tags, r.all_tags, r.how) == plain_analysis(r.word, flat, rules, 3) and r.n == asked.count(r.word)


def test_lemmas_come_back_in_order(spark, monkeypatch):
    """Frequent words by broadcast, others by shuffles; repeats, sentences without tokens and words without an analysis."""
    monkeypatch.setattr(joins, "FREQUENT", 4)
    rng = random.Random(9)
    sents = [(d, s, rng.choices(["Стали", "пойми", "ой", "дом", "Ёж"], [9, 1, 1, 1, 1], k=rng.randrange(12))) for d in range(4) for s in range(5)]
    df = spark.createDataFrame(sents, "doc_id long, sent_id int, tokens array<string>").withColumns({"lemmas": F.lit(1), "word": F.lit("x")})
    forms = morphology.dictionary(frame(spark, ROWS))
    analyses = morphology.analyse(morphology.words(df), forms, morphology.ending_rules(forms)).where("word <> 'ой'")
    got = {(r.doc_id, r.sent_id): r for r in morphology.lemmatised(df, analyses).collect()}
    lemma = {"Стали": "стать", "пойми": "понять", "ой": "ой", "дом": "дом", "Ёж": "еж"}
    tags = {"Стали": "VERB,past NOUN,gent", "пойми": "VERB,impr", "ой": "UNK", "дом": "UNK", "Ёж": "NOUN"}
    assert len(got) == len(sents)
    for d, s, tokens in sents:
        assert got[d, s].lemmas == [lemma[t] for t in tokens] and got[d, s].tags == [tags[t] for t in tokens]


def test_has_tag(spark):
    df = spark.createDataFrame([(["VERB,impr NOUN"],), (["NOUN", "X impr"],), (["imprx", "VERB,past"],), ([],)], "tags array<string>")
    assert [r[0] for r in df.select(morphology.has_tag("tags", "impr")).collect()] == [True, True, False, False]


def test_an_analysis_with_a_dictionary(spark):
    """The sample's lemmas from a table of forms instead of the profile; an imperative makes its own hit a prompt."""
    rows = [(form, lemma, {"пойми": "VERB,impr", "пораскинь": "VERB,impr"}.get(form, "X"), 1) for form, lemma in LEMMAS.items()]
    filler = [(f"слово{i}", f"слово{i}", "NOUN", 1) for i in range(500)]
    a = sample(spark, profile=replace(RUSSIAN, lemmas={}))
    a.sources.forms, a.keep = frame(spark, rows + filler), True
    plain = {r.hit_id: r for r in sample(spark).tagged.collect()}
    got = {r.hit_id: r for r in a.tagged.collect()}
    assert len(got) == len(HITS) and len(NESTED) == a.nested.count()
    assert set(a.tagged.columns) == set(sample(spark).tagged.columns)
    for i, r in got.items():
        same = ("marker_id", "hit_type", "sent_id", "token_idx", "token_end_idx", "is_noise", "phrase_overlap_ids", "hero_link", "unit_norm")
        assert [r[c] for c in same] == [plain[i][c] for c in same]
        imperative = r.hit_type == "WORD" and r.target_surface.lower() in ("пойми", "пораскинь")
        assert r.others_speech_act == ("PROMPT" if imperative and r.others_speech_act else plain[i].others_speech_act)


def test_forms_from_files(spark, tmp_path):
    (tmp_path / "forms.tsv").write_text('form\tlemma\ttags\nстали\tстать\tVERB\n"х\tх\tNOUN\n', encoding="utf-8")
    got = {tuple(r) for r in morphology.dictionary(files.read_forms(spark, f"{tmp_path}/forms.tsv")).collect()}
    assert got == {("стали", "стать", "VERB", 1), ('"х', "х", "NOUN", 1)}
    morphology.dictionary(frame(spark, ROWS)).write.parquet(f"{tmp_path}/forms.parquet")
    assert files.read_forms(spark, f"{tmp_path}/forms.parquet").count() == 5


def test_many_forms_leave_the_plan_small(spark):
    """No form is a literal of a plan."""
    many = spark.range(300_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("form"), F.lit("w").alias("lemma"))
    forms = morphology.dictionary(many)
    df = spark.createDataFrame([(0, 0, ["w17", "w299999", "nope"])], "doc_id long, sent_id int, tokens array<string>")
    told = morphology.lemmatised(df, morphology.analyse(morphology.words(df), forms, morphology.ending_rules(forms)))
    assert told.first().lemmas[:2] == ["w", "w"]
    assert len(told._jdf.queryExecution().optimizedPlan().toString()) < 60_000


def test_words_are_found_once(spark, tmp_path):
    """Known and unknown words come from one pass over the texts."""
    spark.createDataFrame([(w,) for w in "walking talking baking the sings".split()], "text string").write.parquet(str(tmp_path / "t"))
    found = morphology.words(spark.read.parquet(str(tmp_path / "t")).select(F.split("text", " ").alias("tokens")))
    forms = spark.createDataFrame([("walking", "walk", "V", 1), ("talking", "talk", "V", 1), ("baking", "bak", "V", 1)], morphology.FORMS)
    told = morphology.analyse(found, forms, spark.createDataFrame([("s", 1, "", "N", 3)], "ending string, cut int, added string, tags string, n long"))
    assert {(r.word, r.lemma, r.all_tags, r.how) for r in told.collect()} == {("walking", "walk", "V", "dictionary"), ("talking", "talk", "V", "dictionary"), ("baking", "bak", "V", "dictionary"), ("the", "the", "UNK", "itself"), ("sings", "sing", "N", "ending")}
    assert told._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Scan parquet") == 1


def _tables(spark, path):
    said = ["walk walks walked walking mation station sing sings singing the on onon", "talk talks talked talking baker bake baking of that"]
    text = "The walks of that station. Baked on the place, unwalked onon! Is it?  1-2 ... That on, of the Talk"
    spark.createDataFrame([(1, text), (2, ""), (3, None), (None, text), (5, text * 3)], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(x,) for x in said * 3], "text string").write.parquet(f"{path}/conversations.parquet")


def test_tokens_are_dealt_out_once_as_sentences(spark, tmp_path, monkeypatch):
    """Only rare words' tokens are shuffled as rows; however few words are common, the answers are the same."""
    from glossa import language_queries

    _tables(spark, tmp_path)
    got = {}
    for common in (2**16, 4, 0):
        monkeypatch.setattr(morphology, "COMMON", common)
        told = language_queries.dictionary_lemmas(spark, str(tmp_path))
        got[common] = sorted(map(str, told.collect()))
        plan = told._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("Scan parquet [doc_id") == 1
    assert got[2**16] == got[4] == got[0]
    rows = [r for r in told.collect() if r.doc_id == 1]
    assert [r.lemmas for r in sorted(rows, key=lambda r: r.sent_id)][0] == "the walk of that station" and {r.lemmas for r in told.collect() if r.doc_id is None} == {""}


def test_repeated_sentences_are_told_together(spark):
    sents = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 0, ["a", "b"]), (None, 0, ["a"]), (2, 0, [])], "doc_id long, sent_id int, tokens array<string>")
    found = morphology.words(sents)
    answer = lambda w: w.select("word", "n", F.upper("word").alias("lemma"), F.lit("X").alias("all_tags"))
    got = {(r.doc_id, r.sent_id): ([x.lemma for x in r.told], r.rows) for r in morphology.told(sents, found, answer).collect()}
    assert got == {(1, 0): (["A", "A", "B", "B"], 2), (None, 0): ([], 1), (2, 0): ([], 1)}


def test_imperatives_of_hits_need_no_tokens(spark, tmp_path):
    """Only the words that hits can be are looked up; texts are read once and no sentence is shuffled."""
    from glossa import language_queries
    from glossa.plans.analysis import bench_analysis

    _tables(spark, tmp_path)
    acts = language_queries.speech_act_imperative(spark, str(tmp_path))
    got = {r.hit_id: r.act for r in acts.collect()}
    plan = acts._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Scan parquet [doc_id") == 1 and "Generate posexplode(tokens" not in plan
    a = bench_analysis(spark, str(tmp_path))
    hits = {r.hit_id: r for r in a.hits.where("doc_id IS NOT NULL").collect()}
    plain = {(r.doc_id, r.sent_id): r.speech_act for r in a.sentences.select("doc_id", "sent_id", "speech_act").collect()}
    impr = {r.word for r in language_queries.analyses(spark, str(tmp_path)).where(morphology.has_tag(F.array("all_tags"), "impr")).collect()}
    assert "onon" in impr and got == {i: "PROMPT" if h.token_idx == h.token_end_idx and h.target_surface.lower() in impr else plain[h.doc_id, h.sent_id] for i, h in hits.items()}


def test_rules_are_not_tried_on_tokens(spark):
    """What rules ask of forms isn't pushed below the counts that forms come from."""
    found = morphology.words(spark.createDataFrame([(["walks"],)], "tokens array<string>"))
    rules = morphology.ending_rules(morphology.dictionary(morphology.derived(found, (("s", "", "N"),))))
    assert not [x for x in rules._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x and "aggregate(" in x]
