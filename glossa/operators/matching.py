"""Markers to hits: word and gapped phrase matches, overlap resolution, noise, ids.

A phrase is looked up by a rare lemma: a sentence is asked for the phrases whose anchor it holds, around which their
first lemma is looked for as far as gaps reach, and the rest of a pattern is a fold over the lemmas. All of a sentence
is found and resolved within its row, whose arrays are never copied to candidates or hits: these hold places and ids
and what they are told to carry. Nothing is shuffled but hits that are to be numbered, once, and, where a registry has
more than IN_ROW phrases, what sentences are asked for.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators.morphology import IMPERATIVE, has_tag
from glossa.plans.profile import Profile

SENT = ["doc_id", "sent_id"]
SPAN = "struct<marker_id:string,start:bigint,stop:bigint>"


def match_end(lemmas: str | Column, pattern: str | Column, start: Column, gap: int) -> Column:
    """1-based place of the last lemma of the pattern matched from `start` on, or null. Each lemma binds to its first place among the next gap + 1; there is no second try."""
    nearest = lambda at, want: at + F.nullif(F.array_position(F.slice(lemmas, (at + 1).cast("int"), gap + 1), want), F.lit(0))
    return F.aggregate(F.slice(pattern, F.lit(2), F.greatest(F.size(pattern) - 1, F.lit(0))), start.cast("bigint"), nearest)


def phrase_index(sents: DataFrame, markers: DataFrame) -> DataFrame:
    """(marker_id, pattern, anchor, place): each phrase under its rarest lemma, the one that fewest sentences hold (of equal ones the first); place: the anchor's in the pattern, from 1."""
    rows = markers.where((F.col("unit_type") == "PHRASE") & (F.trim("unit_norm") != "")).select("marker_id", F.split(F.trim("unit_norm"), r"\s+").alias("pattern"))
    each = rows.select("marker_id", "pattern", F.posexplode("pattern").alias("at", "lemma"))
    held = sents.select(F.explode(F.array_distinct("lemmas")).alias("lemma")).join(each.select("lemma").distinct(), "lemma", "left_semi").groupBy("lemma").agg(F.count("*").alias("n"))
    rarest = each.join(held, "lemma", "left").groupBy("marker_id", "pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), (F.col("at") + 1).alias("place"))).alias("least"))
    return rarest.select("marker_id", "pattern", F.element_at("pattern", F.col("least.place")).alias("anchor"), F.col("least.place").alias("place"))


def _starts(lemmas: str, asked: Column, gap: int) -> Column:
    """Places of the pattern's first lemma from which its anchor is in reach."""
    back = asked["place"] - 1
    anchors = F.filter(F.sequence(F.lit(1), F.size(lemmas)), lambda i: F.element_at(lemmas, i) == F.element_at(asked["pattern"], asked["place"]))
    reach = lambda q: F.when(q > back, F.sequence(F.greatest(F.lit(1), q - back * (gap + 1)), q - back)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.array_distinct(F.flatten(F.transform(anchors, reach))), lambda s: F.element_at(lemmas, s) == F.element_at(asked["pattern"], 1))


def asked_phrases(sents: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, sent_id, asked): the phrases whose anchor a sentence holds, for sentences with any."""
    pairs = sents.select(*SENT, F.explode(F.array_distinct("lemmas")).alias("anchor")).join(index, "anchor")
    return pairs.groupBy(*SENT).agg(F.collect_list(F.struct("marker_id", "pattern", "place")).alias("asked"))


def with_spans(sents: DataFrame, index: DataFrame, p: Profile) -> DataFrame:
    """sents with `found`: all matches of all phrases by (marker_id, start), tokens from 0, stop included; null where there is none."""
    return spans_of(sents.join(asked_phrases(sents, index), SENT, "left"), p)


def spans_of(rows: DataFrame, p: Profile) -> DataFrame:
    """rows with `found` in place of `asked`."""

    def spans(asked: Column) -> Column:
        ends = F.transform(_starts("lemmas", asked, p.phrase_gap), lambda s: F.struct(asked["marker_id"].alias("marker_id"), (s - 1).cast("bigint").alias("start"), (match_end("lemmas", asked["pattern"], s, p.phrase_gap) - 1).alias("stop")))
        return F.filter(ends, lambda x: x["stop"].isNotNull())

    found = F.array_sort(F.flatten(F.transform("asked", spans)))
    return rows.withColumn("found", found).drop("asked").withColumn("found", F.when(F.size("found") > 0, F.col("found")))


def phrase_candidates(sents: DataFrame, markers: DataFrame, p: Profile) -> DataFrame:
    """(doc_id, sent_id, marker_id, start, stop), tokens from 0, stop included: all matches of all phrases."""
    own, index = sents.select(*SENT, "lemmas"), phrases_in_row(markers)
    found = with_spans(own, phrase_index(sents, markers), p) if index is None else spans_of(own.withColumn("asked", asked_in_row(index)), p)
    return found.select(*SENT, exploded("found", f"array<{SPAN}>").alias("x")).select(*SENT, "x.*")


def exploded(name: str, kind: str) -> Column:
    """The array's elements as rows. Of a bare column Spark would derive a filter (size > 0), push it below all projections and find there whatever the array is made of again, for each element of what it loops over."""
    return F.explode(F.coalesce(name, F.array().cast(kind)))


def _apart(found: Column) -> Column:
    """Of spans sorted by marker and start: those that start after the marker's last kept one ends."""

    def keep(kept: Column, x: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        clash = F.coalesce((last["marker_id"] == x["marker_id"]) & (x["start"] <= last["stop"]), F.lit(False))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(found, F.array().cast(f"array<{SPAN}>"), keep)


def _ranked(found: Column) -> Column:
    """Spans in the order of the greedy choice: longer, earlier, smaller id."""
    keyed = F.transform(found, lambda x: F.struct((x["start"] - x["stop"]).alias("less"), x["start"].alias("start"), x["marker_id"].alias("marker_id"), x["stop"].alias("stop")))
    return F.array_sort(keyed)


RANKED = "struct<less:bigint,start:bigint,marker_id:string,stop:bigint>"


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] <= b["stop"]) & (b["start"] <= a["stop"])


def resolve(candidates: DataFrame, p: Profile) -> DataFrame:
    """A row for each sentence with candidates: `kept` spans by (start, marker_id), and `dropped` ones with the ids of the kept spans that were in the way."""
    return resolved(candidates.groupBy(*SENT).agg(F.array_sort(F.collect_list(F.struct("marker_id", "start", "stop"))).alias("found")), p)


def resolved(rows: DataFrame, p: Profile) -> DataFrame:
    """rows with `kept` and `dropped` in place of `found`, both null where that is."""
    others = [c for c in rows.columns if c != "found"]
    apart = rows.withColumn("found", _apart(F.col("found")))
    if p.overlap_mode.lower().strip() in ("keep_all", "all"):
        nothing = F.array().cast("array<struct<start:bigint,marker_id:string,stop:bigint,over:string>>")
        return apart.select(*others, F.col("found").alias("kept"), F.when(F.col("found").isNotNull(), nothing).alias("dropped"))
    ranked = apart.select(*others, _ranked(F.col("found")).alias("ranked"))
    choose = F.aggregate("ranked", F.array().cast(f"array<{RANKED}>"), lambda kept, x: F.when(F.exists(kept, lambda k: _overlap(k, x)), kept).otherwise(F.concat(kept, F.array(x))))
    chosen = ranked.withColumn("chosen", choose)
    place = lambda x: F.struct(x["start"].alias("start"), x["marker_id"].alias("marker_id"), x["stop"].alias("stop"))
    kept = F.array_sort(F.transform("chosen", place))
    in_way = lambda x: F.array_join(F.transform(F.filter("chosen", lambda k: (k < x) & _overlap(k, x)), lambda k: k["marker_id"]), ";")
    dropped = F.array_sort(F.transform(F.filter("ranked", lambda x: ~F.array_contains(F.col("chosen"), x)), lambda x: F.struct(x["start"].alias("start"), x["marker_id"].alias("marker_id"), x["stop"].alias("stop"), in_way(x).alias("over"))))
    return chosen.select(*others, F.transform(kept, lambda x: F.struct(x["marker_id"].alias("marker_id"), x["start"].alias("start"), x["stop"].alias("stop"))).alias("kept"), dropped.alias("dropped"))


def enabled_exclusions(rows: DataFrame) -> list[dict[str, str]]:
    """The exclusion rules in order: a configuration table, read by the driver. Rows whose pattern no engine compiles are left out; a blank reason has a name."""
    jvm = rows.sparkSession.sparkContext._jvm
    out = []
    for r in rows.fillna("").orderBy("id").collect():
        if str(r["enabled"]).lower() not in ("1", "true", "yes", "да"):
            continue
        rule = {k: str(r[k]).strip() for k in ("lemma", "surface", "regex", "reason")}
        try:
            re.compile(rule["regex"])
            jvm.java.util.regex.Pattern.compile(rule["regex"])
        except Exception:  # a broken pattern never matches
            continue
        out.append(rule | {"lemma": rule["lemma"].lower(), "surface": rule["surface"].lower(), "reason": rule["reason"] or "EXCLUSION_TABLE"})
    return out


def text_flags(sentence: Column, rules: list[dict[str, str]]) -> Column:
    """Whether each rule's pattern is found in the sentence, in the rules' order; true where it has none."""
    return F.array(*[T.matches(sentence, r["regex"]) if r["regex"] else F.lit(True) for r in rules]) if rules else F.array().cast("array<boolean>")


def noise_reason(lemma: Column, surface: Column, sentence: Column, rules: list[dict[str, str]], p: Profile, flags: Column | None = None) -> Column:
    """The first rule that matches: built-in ones, then the table's; empty parts match anything. Null: no noise. flags: text_flags() of the sentence, where they are there already."""
    lemma, surface = F.lower(T.strip(lemma)), F.lower(T.strip(surface))
    found = [F.when((lemma == m) & (surface == s.lower()), F.lit(reason)) for m, s, reason in p.builtin_noise]
    for i, r in enumerate(rules):
        said = (T.matches(sentence, r["regex"]) if flags is None else flags[i]) if r["regex"] else None
        parts = [lemma == r["lemma"]] * bool(r["lemma"]) + [surface == r["surface"]] * bool(r["surface"]) + [said] * (said is not None)
        met = F.lit(True)
        for x in parts:
            met = met & x
        found.append(F.when(met, F.lit(r["reason"])))
    return F.coalesce(*found, F.lit(None).cast("string"))


#: Most phrases that are looked up within a sentence's row; a larger registry's are joined to the sentences.
IN_ROW = 2_000


def phrases_in_row(markers: DataFrame) -> dict[str, list[tuple[str, list[str], int]]] | None:
    """Anchor to (marker_id, pattern, place from 1) of a registry of at most IN_ROW phrases, else None. Without a pass over the corpus, an anchor is the lemma that fewest phrases hold; of these the longest, then the first. Which lemma it is changes no match."""
    rows = markers.where((F.col("unit_type") == "PHRASE") & (F.trim("unit_norm") != "")).select("marker_id", F.split(F.trim("unit_norm"), r"\s+").alias("pattern")).limit(IN_ROW + 1).collect()
    if len(rows) > IN_ROW:
        return None
    held = Counter(x for r in rows for x in set(r.pattern))
    out: dict[str, list[tuple[str, list[str], int]]] = {}
    for r in sorted(rows):
        at = min(range(len(r.pattern)), key=lambda i: (held[r.pattern[i]], -len(r.pattern[i]), i))
        out.setdefault(r.pattern[at], []).append((r.marker_id, r.pattern, at + 1))
    return out


def asked_in_row(index: dict[str, list[tuple[str, list[str], int]]]) -> Column:
    """The phrases whose anchor a sentence holds, as asked_phrases() has them, by its lemmas alone."""
    if not index:
        return F.array().cast("array<struct<marker_id:string,pattern:array<string>,place:int>>")
    entry = lambda m, pattern, place: F.struct(F.lit(m).alias("marker_id"), F.array(*map(F.lit, pattern)).alias("pattern"), F.lit(place).alias("place"))
    table = F.create_map(*[x for anchor, found in index.items() for x in (F.lit(anchor), F.array(*[entry(*f) for f in found]))])
    return F.flatten(F.transform(F.array_intersect("lemmas", F.array(*map(F.lit, index))), lambda anchor: F.try_element_at(table, anchor)))


def matched(sents: DataFrame, markers: DataFrame, rules: list[dict[str, str]], p: Profile, hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """sents (doc_id, sent_id, sent_text, tokens, lemmas, and what hits are to carry) with the rules' `flags` in place of the text, and the spans `kept` and `dropped`. Row-local, unless the registry is very large."""
    own = sents.select(*[c for c in sents.columns if c != "sent_text"], text_flags(F.col("sent_text"), rules).alias("flags"))
    index = phrases_in_row(markers)
    if index is None:
        return hold(resolved(with_spans(own, hold(phrase_index(own, markers)), p), p))
    return resolved(spans_of(own.withColumn("asked", asked_in_row(index)), p), p)


def hit_rows(rows: DataFrame, markers: DataFrame, rules: list[dict[str, str]], p: Profile) -> DataFrame:
    """Hits of matched() rows without ids, narrow, with marker_ord and what the rows carry; with `tags`, hits have `imperative`. Tokens and kept spans are taken out of a sentence in one pass and meet the markers as equals."""
    tagged = "tags" in rows.columns
    carried = [c for c in rows.columns if c not in (*SENT, "tokens", "lemmas", "tags", "flags", "kept", "dropped")]
    place = lambda kind, key, start, stop: F.struct(F.lit(kind).alias("hit_type"), key.alias("key"), start.alias("token_idx"), stop.alias("token_end_idx"))
    words = F.transform("lemmas", lambda w, i: place("WORD", w, i.cast("bigint"), i.cast("bigint")))
    phrases = F.transform(F.coalesce("kept", F.array().cast(f"array<{SPAN}>")), lambda k: place("PHRASE", k["marker_id"], k["start"], k["stop"]))
    is_word = F.col("unit_type") == "WORD"
    keys = markers.where(F.col("unit_type").isin("WORD", "PHRASE")).select(F.col("unit_type").alias("hit_type"), F.when(is_word, F.col("unit_norm")).otherwise(F.col("marker_id")).alias("key"), "marker_id", F.when(is_word, F.col("unit_norm")).otherwise(F.trim("unit_norm")).alias("target_lemma"), "marker_ord")
    held = [*SENT, *carried, "tokens", *(["tags"] if tagged else []), "flags", "kept"]
    each = rows.select(*held, F.explode(F.concat(words, phrases)).alias("x")).select(*held, "x.*").join(keys, ["hit_type", "key"])
    word, start, stop = F.col("hit_type") == "WORD", F.col("token_idx"), F.col("token_end_idx")
    each = each.withColumn("target_surface", F.array_join(F.slice("tokens", (start + 1).cast("int"), (stop - start + 1).cast("int")), " "))
    over = F.when(word, F.filter("kept", lambda k: start.between(k["start"], k["stop"])))
    each = each.withColumn("over", F.coalesce(over, F.array().cast(f"array<{SPAN}>"))).withColumn("reason", F.when(word, noise_reason(F.col("target_lemma"), F.col("target_surface"), F.lit(None), rules, p, F.col("flags"))))
    inside = F.size("over") > 0
    alone = F.when(start == stop, F.try_element_at("tags", (start + 1).cast("int"))) if tagged else None
    return each.select(
        *SENT, "hit_type", "marker_id", "token_idx", "token_end_idx", "target_lemma", "target_surface", inside.alias("overlaps_phrase"), F.array_join(F.transform("over", lambda k: k["marker_id"]), ";").alias("phrase_overlap_ids"),
        F.col("reason").isNotNull().alias("is_noise"), F.coalesce("reason", F.lit("")).alias("noise_reason"), (~inside | F.lit(p.count_overlapping_word_hits)).alias("count_in_main_stats"),
        *([F.coalesce(has_tag(F.array(alone), IMPERATIVE), F.lit(False)).alias("imperative")] if tagged else []), "marker_ord", *carried,
    )


def order_of(p: Profile) -> list[Column]:
    """The order of a document's hits, by which they are numbered."""
    phrase = F.col("hit_type") == "PHRASE"
    by_marker = p.overlap_mode.lower().strip() in ("keep_all", "all")
    return [F.col("sent_id"), F.col("hit_type") == "WORD", *([F.when(phrase, F.col("marker_ord"))] if by_marker else []), F.col("token_idx"), F.when(phrase, F.col("marker_id")), F.col("marker_ord")]


def dropped_rows(rows: DataFrame, markers: DataFrame, p: Profile) -> DataFrame:
    """Dropped phrase candidates of matched() rows, without ids and texts."""
    norm = markers.where(F.col("unit_type") == "PHRASE").select("marker_id", F.trim("unit_norm").alias("target_lemma"))
    surface = lambda x: F.array_join(F.slice("tokens", (x["start"] + 1).cast("int"), (x["stop"] - x["start"] + 1).cast("int")), " ")
    each = rows.select(*SENT, F.explode(F.transform("dropped", lambda x: F.struct(x.alias("span"), surface(x).alias("surface")))).alias("x")).select(*SENT, "x.*")
    each = each.select(
        *SENT, F.lit("PHRASE").alias("hit_type"), F.col("span.marker_id").alias("marker_id"), F.col("span.start").alias("token_idx"), F.col("span.stop").alias("token_end_idx"), F.col("surface").alias("target_surface"),
        F.lit(False).alias("overlaps_phrase"), F.lit("").alias("phrase_overlap_ids"), F.lit(False).alias("is_noise"), F.lit("").alias("noise_reason"), F.lit(True).alias("count_in_main_stats"),
        F.col("span.over").alias("nested_overlap_with"), F.lit(f"phrase_overlap_mode={p.overlap_mode}").alias("drop_reason"),
    )
    return each.join(norm, "marker_id")


NESTED_ORDER = ["sent_id", "token_idx", "marker_id"]


def numbered(rows: DataFrame, order: list, name: str, bits: int = 21) -> DataFrame:
    """Dense ids from 1 by doc_id and `order`: places within documents, plus what the documents before them hold.

    Rows are shuffled once, to their documents; both the documents' sizes and the numbered rows come from there, so what is
    numbered is found once. The joins are null-safe for that: others would have each side of them filter its own keys down
    at the scan, and Spark reads a shuffle again only where all below it is alike. Sums before a document are taken by blocks of ids that share their upper bits, and by blocks of
    blocks: no task orders more than 2**22 narrow rows, however far apart the ids are.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    own = [c for c in rows.columns if c != "doc_id"]
    keyed = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.struct(*own).alias("row"))
    docs = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(keyed)).alias("_rows"))
    doc = F.col("doc_id").cast("bigint")
    counts = docs.select("doc_id", F.size("_rows").cast("bigint").alias("n"), F.shiftright(doc, bits).alias("b1"), F.shiftright(doc, 2 * bits).alias("b2"))
    one = counts.groupBy("b1", "b2").agg(F.sum("n").alias("n"))
    two = one.groupBy("b2").agg(F.sum("n").alias("n"))

    def before(by: list[str], at: str) -> Column:
        return F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    each = counts.select("doc_id", "b1", before(["b1"], "doc_id").alias("s0"))
    ones = one.select(F.col("b1").alias("_b1"), "b2", before(["b2"], "b1").alias("s1"))
    twos = two.select(F.col("b2").alias("_b2"), before([], "b2").alias("s2"))
    starts = each.join(ones, F.col("b1").eqNullSafe(F.col("_b1"))).join(twos, F.col("b2").eqNullSafe(F.col("_b2")))
    starts = starts.select(F.col("doc_id").alias("_doc"), (F.col("s0") + F.col("s1") + F.col("s2")).alias("_before"))
    placed = docs.join(starts.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_doc"))).select("doc_id", "_before", F.posexplode("_rows").alias("_at", "_x"))
    return placed.select("doc_id", *[F.col(f"_x.row.{c}").alias(c) for c in own], (F.col("_before") + F.col("_at") + 1).cast("bigint").alias(name))


def hits(sents: DataFrame, markers: DataFrame, rules: list[dict[str, str]], p: Profile, hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Hits and dropped phrase candidates of sents (doc_id, sent_id, sent_text, tokens, lemmas), with ids. Both are narrow: a sentence's text is joined by those who want it. `hold` is given what is read more than once."""
    rows = matched(sents, markers, rules, p, hold)
    return numbered(hit_rows(rows, markers, rules, p), order_of(p), "hit_id").drop("marker_ord"), numbered(dropped_rows(rows, markers, p), NESTED_ORDER, "candidate_id")
