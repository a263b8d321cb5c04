"""The rule splitter against plain code and examples."""

import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from glossa.functions import splitter
from glossa.operators import texts
from glossa.plans.profile import LATIN, RUSSIAN

B = splitter.BLANKS


def plain_split(text, p):
    """Sentences with all blanks, piece by piece."""
    pieces = re.findall(r"[^.!?…]*[.!?…]+[»\"”’)\]]*[ \t\r\n\f\x0b ]*|[^.!?…]+\Z", text)
    out, now = [], ""
    lower = lambda c: re.fullmatch(f"[{p.lower}]", c) is not None
    upper = lambda c: re.fullmatch(f"[{p.upper}]", c) is not None
    letter = lambda c: re.fullmatch(f"[{p.letters}]", c) is not None
    for i, piece in enumerate(pieces):
        now += piece
        body = piece.rstrip(B)
        gap = piece[len(body) :]
        end = True
        if i + 1 < len(pieces):
            after = pieces[i + 1]
            core = after.lstrip("«\"“„‘([—–-" + B)
            word = ""
            while len(word) + 1 < len(body) and letter(body[-2 - len(word)]):
                word = body[-2 - len(word)] + word
            before = body[-2 - len(word) : -1 - len(word)]
            lone = body.lstrip(B)[:-1] if body.endswith(".") else ""
            if gap == "":
                end = False
            elif "\n" in gap and re.search("\n[^\n]*\n", gap):
                end = True
            elif core and lower(core[0]) or after[0] in ",;:»”’)]":
                end = False
            elif lone and (re.fullmatch("[0-9]{1,3}|[IVXLCDM]{1,6}", lone) or len(lone) == 1 and (lower(lone) or upper(lone))):
                end = False
            elif body.endswith(".") and any(word.lower() == a for a in p.abbreviations):
                end = False
            elif body.endswith(".") and len(word) == 1 and upper(word) and upper(after[0]):
                end = False
        if end:
            out.append(now)
            now = ""
    return out


def split(spark, all_texts, p):
    df = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string").repartition(4)
    return {r.doc_id: r.raw for r in df.select("doc_id", splitter.raw_sentences(F.col("text"), p).alias("raw")).collect()}


@pytest.mark.parametrize(("p", "parts"), [
    (RUSSIAN, ["Он", "он", "г", "ул", "А", "С", "Пушкин", "10", "I", ".", ".", "!", "?", "…", " ", " ", "\n", "\n\n", "»", "«", "—", "-", ",", "(", ")", " ", "и"]),
    (LATIN, ["The", "the", "of", "on", "Mr", "É", "é", "A", "7", "123", "XIV", ".", ".", ".", "!", " ", "  ", "\n", "\n \n", "\"", "”", "[", "]", ";", "\t"]),
])
def test_random_texts(spark, p, parts):
    rng = random.Random(len(parts))
    asked = ["", " ", ".", "...", " . ", *("".join(rng.choices(parts, k=rng.randrange(1, 30))) for _ in range(700))]
    got = split(spark, asked, p)
    for i, text in enumerate(asked):
        assert got[i] == plain_split(text, p) and "".join(got[i]) == text, repr(text)


def test_examples(spark):
    cases = {
        "А. С. Пушкин родился в 1799 г. в Москве. Он писал.": ["А. С. Пушкин родился в 1799 г. в Москве.", "Он писал."],
        "«Иди!» — сказал он. «Иду…» И пошел.": ["«Иди!» — сказал он.", "«Иду…»", "И пошел."],
        "1. Первое. 2. Второе.": ["1. Первое.", "2. Второе."],
        "Цена 3.14 руб. за штуку. Да?! Нет.": ["Цена 3.14 руб. за штуку.", "Да?!", "Нет."],
        "Жил на ул. Ленина. Потом": ["Жил на ул. Ленина.", "Потом"],
        "Конец г.\n\nНовая глава": ["Конец г.", "Новая глава"],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r.s for r in df.select("doc_id", splitter.rule_sentences(RUSSIAN)(F.col("text")).alias("s")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_places_and_nulls(spark):
    asked = [None, "", "  A b. C d!  \n\n e f", "Of. The. x  ", "..."]
    p = replace(LATIN, split_by_rules=True, remove_headings_from_analysis=False)
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    places = {(r.doc_id, r.sent_id): (r.start, r.stop) for r in texts.sentence_offsets(docs, p).collect()}
    rows = texts.sentences(docs, p).collect()
    assert len(rows) == len(places) > 4
    for r in rows:
        start, stop = places[r.doc_id, r.sent_id]
        assert asked[r.doc_id][start:stop] == r.sent_text


def test_a_long_text_costs_its_length(spark):
    text = "The end of it. " * 30_000 + "of. " * 30_000
    got = split(spark, [text], LATIN)[0]
    assert len(got) == 30_000 and "".join(got) == text


def test_ends_are_judged_as_by_the_whole_piece(spark):
    """Abbreviations and initials are looked for in a piece's end: cut-off words are none."""
    from glossa.functions.splitter import ends_after

    p = replace(LATIN, abbreviations=("mr", "prof"))
    bodies = ["mr.", "Mr.", "xmr.", "x mr.", "the prof.", "prof.", "aprof.", "X.", " X.", "aX.", "a X.", "the end.", "the end!", "mr!", "prof.)", "\U0001f600mr.", "ab\U0001f600X."]
    got = {r.body: r.ends for r in spark.createDataFrame([(b,) for b in bodies], "body string").select("body", ends_after(F.concat("body", F.lit(" ")), F.lit("Next."), p).alias("ends")).collect()}
    assert {b for b, e in got.items() if not e} == {"mr.", "Mr.", "x mr.", "the prof.", "prof.", "X.", " X.", "a X.", "\U0001f600mr.", "ab\U0001f600X."}
