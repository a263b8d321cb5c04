"""Documents to lines, headings, sentences and their contexts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.functions.splitter import raw_sentences, trimmed
from glossa.plans.profile import Profile

def by_line():
    return Window.partitionBy("doc_id").orderBy("line_no")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no from 1, line, char_pos: code points before it, an end of line counted as one). A byte order mark is no part of the text."""
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), "^﻿", "")
    rows = docs.select("doc_id", F.posexplode(F.split(clean, T.LINE_END)).alias("at", "line")).select("doc_id", (F.col("at") + 1).alias("line_no"), "line")
    before = F.sum(F.length("line") + 1).over(by_line().rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("char_pos", F.coalesce(before, F.lit(0)))


def headings(docs: DataFrame, p: Profile) -> DataFrame:
    """Heading lines: (doc_id, heading_id, line_no, char_pos_approx, heading_type, heading_text, removed_from_analysis)."""
    found = lines(docs).where(T.is_heading("line", p))
    return found.select(
        "doc_id", F.row_number().over(by_line()).alias("heading_id"), "line_no", F.col("char_pos").alias("char_pos_approx"), T.heading_kind("line", p).alias("heading_type"),
        T.strip("line").alias("heading_text"), F.lit(p.remove_headings_from_analysis).alias("removed_from_analysis"),
    )


def without_headings(docs: DataFrame, p: Profile) -> DataFrame:
    """docs whose heading lines are blank. Row-local: the lines are an array."""
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), "^﻿", "")
    if not p.remove_headings_from_analysis:
        return docs.withColumn("text", clean)
    kept = F.transform(F.split(clean, T.LINE_END), lambda x: F.when(T.is_heading(x, p), F.lit("")).otherwise(x))
    return docs.withColumn("text", F.array_join(kept, "\n"))


def sentences(docs: DataFrame, p: Profile, max_sents: int | None = None, beside: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, sent_id from 0, sent_text, tokens, lemmas, word_count), headings taken out first.

    beside: given documents with their sentences as the array `all_sents`, adds arrays that are as long; their elements become
    columns of the sentences. What depends on neighbours is found there within the document's row, without a shuffle.
    """
    found = T.sentences("text", p)
    if beside is None:
        # Not by way of a column: its size would be filtered by first, and texts be split twice.
        rows = without_headings(docs, p).select("doc_id", F.posexplode(found).alias("sent_id", "sent_text"))
    else:
        rows = beside(without_headings(docs, p).select("doc_id", found.alias("all_sents")))
        more = [c for c in rows.columns if c not in ("doc_id", "all_sents")]
        rows = rows.select("doc_id", F.posexplode(F.arrays_zip("all_sents", *more)).alias("sent_id", "x")).select("doc_id", "sent_id", F.col("x.all_sents").alias("sent_text"), *[F.col(f"x.{c}").alias(c) for c in more])
    if max_sents is not None:
        rows = rows.where(F.col("sent_id") < max_sents)
    rows = rows.withColumn("tokens", T.tokens("sent_text", p))
    return rows.withColumn("lemmas", T.lemmas("tokens", p)).withColumn("word_count", F.size("tokens"))


def contexts(sents: DataFrame, radius: int = 1) -> DataFrame:
    """sents with prev_sent_text, next_sent_text (always the neighbours) and context_window (radius sentences each way)."""
    w = Window.partitionBy("doc_id").orderBy("sent_id")
    return sents.withColumns(
        {
            "prev_sent_text": F.coalesce(F.lag("sent_text").over(w), F.lit("")),
            "next_sent_text": F.coalesce(F.lead("sent_text").over(w), F.lit("")),
            "context_window": F.array_join(F.collect_list("sent_text").over(w.rowsBetween(-radius, radius)), " "),
        }
    )


NEIGHBOURS = ["_prev", "_next"]


def neighbours(docs: DataFrame, radius: int = 1, max_sents: int | None = None) -> DataFrame:
    """docs (doc_id, all_sents) with arrays of each sentence's neighbours, null where there is none, and, for another radius than 1, of its context: what told_contexts() makes contexts() of, found in the document's row."""
    most = "all_sents" if max_sents is None else F.slice("all_sents", 1, max_sents)
    near = lambda by: F.transform(F.col("all_sents"), lambda _, i: F.get(most, i + by))
    out = docs.withColumns({"_prev": near(-1), "_next": near(1)})
    if radius == 1:
        return out
    around = lambda i: F.slice(most, F.greatest(i - radius, F.lit(0)) + 1, F.least(i, F.lit(radius)) + radius + 1)
    return out.withColumn("context_window", F.transform(F.col("all_sents"), lambda _, i: F.array_join(around(i), " ")))


def told_contexts(rows: DataFrame) -> DataFrame:
    """rows that carry a sentence and what neighbours() found, with the columns of contexts()."""
    known = {} if "context_window" in rows.columns else {"context_window": F.concat_ws(" ", "_prev", "sent_text", "_next")}
    return rows.withColumns({"prev_sent_text": F.coalesce("_prev", F.lit("")), "next_sent_text": F.coalesce("_next", F.lit("")), **known}).drop(*NEIGHBOURS)


def sentence_offsets(docs: DataFrame, p: Profile, of: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """(doc_id, sent_id, start, stop) in code points of the text as it is, headings included; from running lengths of the raw pieces and what lies between them.

    of: further columns by name, each from the sentence. Lengths and these columns are found in the document's row, so what is
    shuffled to be put in order holds no texts.
    """
    text = F.coalesce("text", F.lit(""))
    if p.split_by_rules:
        pieces, whole, strip = raw_sentences(text, p), F.lit(True), trimmed
    else:
        piece = r"(?s)[^.!?…]+(?:[.!?…]+|$)|[.!?…]+" if p.sentence == Profile.sentence else p.sentence
        pieces, whole, strip = F.regexp_extract_all(text, F.lit(piece), F.lit(0)), F.col("piece").rlike(r"^[^.!?…]"), T.strip
    of = of or {}
    raw = docs.select("doc_id", F.posexplode(pieces).alias("at", "piece")).withColumn("text", strip(F.col("piece")))
    own = raw.select("doc_id", "at", F.length("piece").alias("size"), (whole & (F.col("text") != "")).alias("kept"), (F.expr("instr(piece, text)") - 1).alias("lead"), F.length("text").alias("length"), *[f(F.col("text")).alias(k) for k, f in of.items()])
    w = Window.partitionBy("doc_id").orderBy("at")
    placed = own.withColumn("start", F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("lead")).where("kept")
    return placed.select("doc_id", (F.row_number().over(w) - 1).alias("sent_id"), "start", (F.col("start") + F.col("length")).alias("stop"), *of)
