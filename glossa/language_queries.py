"""Queries of the morphological dictionary, the rule splitter and the phrase index, with the same in SQL over the same tables.

The bench's dictionary is derived from the words of the conversations; the words that it is asked for are those of the documents.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import matching, morphology, texts
from glossa.plans import profile as P
from glossa.plans.analysis import Analysis, bench_analysis, rows, spread
from glossa.plans.oracle import plain_lower, quoted, sql, values

Query = Callable[[SparkSession, str], DataFrame]
L = P.LATIN


# ------------------------------------------------------------------ dictionary
def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(T.tokens(F.coalesce("text", F.lit("")), L).alias("tokens"))
    return morphology.dictionary(morphology.derived(morphology.words(said), P.LATIN_ENDINGS))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = forms(spark, sf_dir)
    return morphology.analyse(morphology.words(bench_analysis(spark, sf_dir).plain), own, morphology.ending_rules(own))


def dictionary_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, sents = forms(spark, sf_dir), bench_analysis(spark, sf_dir).plain
    rules = morphology.ending_rules(own)
    told = morphology.told(sents, morphology.words(sents), lambda found: morphology.analyse(found, own, rules))
    joined = told.select("doc_id", "sent_id", "rows", F.array_join("told.lemma", " ").alias("lemmas"), F.md5(F.array_join("told.tags", ";")).alias("tags"))
    return joined.select("doc_id", "sent_id", "lemmas", "tags", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("row")).drop("row")


def hit_words(a: Analysis) -> DataFrame:
    """(word, n): all words, in plain lower case, that a hit of one token can be: lemmas of units and what the profile's table gives these lemmas. Known without the corpus; the profile has no plug-in for lemmas."""
    units = a.markers.select(F.trim("unit_norm").alias("lemma")).where(~F.col("lemma").contains(" ")).distinct()
    table = rows(a.markers.sparkSession, tuple(a.p.lemmas.items()), "word string, lemma string")
    return units.select(F.col("lemma").alias("word")).unionByName(table.join(units, "lemma").select("word")).distinct().withColumn("n", F.lit(1).cast("long"))


def speech_act_imperative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech acts of hits whose token any parse of the dictionary has as an imperative, else of their sentences. Only the words that hits can be are looked up, so no sentence is shuffled."""
    a, told = bench_analysis(spark, sf_dir), forms(spark, sf_dir)
    asked = morphology.analyse(hit_words(a), told, morphology.ending_rules(told)).select("word", morphology.has_tag(F.array("all_tags"), morphology.IMPERATIVE).alias("imperative"))
    word = F.when(F.col("token_idx") == F.col("token_end_idx"), T.plain_lower("target_surface"))
    acts = a.found_with("speech_act").withColumn("word", word).join(F.broadcast(asked), "word", "left")
    acts = acts.withColumn("act", F.when(F.coalesce("imperative", F.lit(False)), "PROMPT").otherwise(F.col("speech_act")))
    # Documents without an id go by a column of the hits: a filter of doc_id would be pushed to one side of the numbering, which then found hits twice.
    own = acts.select("doc_id", "sent_id", "hit_type", "token_idx", "marker_id", "marker_ord", "act", F.col("doc_id").isNotNull().alias("known"))
    return matching.numbered(own, matching.order_of(a.p), "hit_id").where("known").select("hit_id", "act")


# ------------------------------------------------------------------ sentences by rules
def rule_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences by rules with their places in the documents' whole texts, in one pass."""
    p = replace(L, split_by_rules=True, remove_headings_from_analysis=False)
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    of = {"digest": F.md5, "word_count": lambda sent: F.size(T.tokens(sent, p))}
    return texts.sentence_offsets(docs, p, of).select("doc_id", "sent_id", "start", "stop", "digest", "word_count")


QUERIES: dict[str, Query] = {
    "rule_sentences": rule_sentences,
    "dictionary_forms": forms,
    "dictionary_ending_rules": lambda spark, sf_dir: morphology.ending_rules(forms(spark, sf_dir)),
    "dictionary_analyses": analyses,
    "dictionary_lemmas": dictionary_lemmas,
    "speech_act_imperative": speech_act_imperative,
}

DICTIONARY = f"""conv AS MATERIALIZED (SELECT {plain_lower('t')} AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), {quoted(L.token)})) AS t FROM conversations) GROUP BY 1),
endings AS ({values(P.LATIN_ENDINGS, 'ending, added, tags')}),
forms AS MATERIALIZED (SELECT form, lemma, tags, sum(weight)::BIGINT AS weight FROM (SELECT form, lemma, tags, b.n AS weight FROM (SELECT word AS form, left(word, length(word) - length(ending)) || added AS lemma, tags
    FROM conv JOIN endings ON ends_with(word, ending) AND length(word) > length(ending) + 1) JOIN conv b ON b.word = lemma UNION ALL SELECT word, word, 'BASE', n FROM conv) GROUP BY ALL)"""
RULES = f"""{DICTIONARY},
placed AS (SELECT *, coalesce(list_max(list_filter(range(1, least(length(form), length(lemma)) + 1), lambda i: left(form, i) = left(lemma, i))), 0) AS same FROM forms),
ends AS (SELECT form, length(form) - same AS cut, lemma[same + 1:] AS added, tags, unnest(range(greatest(length(form) - same, 1), least({morphology.ENDING}, length(form) - 1) + 1)) AS size FROM placed),
ruled AS (SELECT right(form, size) AS ending, cut::INT AS cut, added, tags, count(*) AS n FROM ends GROUP BY 1, 2, 3, 4 HAVING count(*) >= {morphology.SEEN}),
rules AS MATERIALIZED (SELECT * FROM ruled QUALIFY row_number() OVER (PARTITION BY ending ORDER BY n DESC, cut, added, tags) = 1)"""
ANALYSES = f"""{RULES},
vocabulary AS MATERIALIZED (SELECT {plain_lower('t')} AS word, count(*) AS n FROM (SELECT unnest(tokens) AS t FROM words) GROUP BY 1),
parses AS (SELECT form, list({{'lemma': lemma, 'tags': tags}} ORDER BY weight DESC, lemma, tags) AS ps FROM forms GROUP BY 1),
guesses AS (SELECT word, arg_max({{'cut': cut, 'added': added, 'tags': tags}}, size) AS rule FROM (SELECT word, unnest(range(1, least({morphology.ENDING}, length(word) - 1) + 1)) AS size FROM vocabulary WHERE word NOT IN (SELECT form FROM forms)) JOIN rules ON ending = right(word, size) GROUP BY 1),
analyses AS MATERIALIZED (SELECT word, n, CASE WHEN ps IS NOT NULL THEN ps[1].lemma WHEN rule IS NOT NULL THEN left(word, length(word) - rule.cut) || rule.added ELSE word END AS lemma, coalesce(ps[1].tags, rule.tags, 'UNK') AS tags,
    CASE WHEN ps IS NOT NULL THEN array_to_string(list_filter(list_transform(ps, lambda x: x.tags), lambda x, i: list_position(list_transform(ps, lambda y: y.tags), x) = i), ' ') ELSE coalesce(rule.tags, 'UNK') END AS all_tags,
    CASE WHEN ps IS NOT NULL THEN 'dictionary' WHEN rule IS NOT NULL THEN 'ending' ELSE 'itself' END AS how FROM vocabulary LEFT JOIN parses ON form = word LEFT JOIN guesses USING (word)),
told AS MATERIALIZED (SELECT doc_id, sent_id, list(lemma ORDER BY k) AS lemmas, list(all_tags ORDER BY k) AS tags FROM (SELECT doc_id, sent_id, {plain_lower('t')} AS word, k FROM (SELECT doc_id, sent_id, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS k FROM words)) JOIN analyses USING (word) GROUP BY ALL)"""


def _over(chain: str, select: str, *steps: str) -> str:
    """A select over a chain of steps that itself reads these steps of the bench analysis."""
    base = sql("".join(f"SELECT 1 FROM {s} " for s in steps)) if steps else ""
    before = base[: base.rindex(")\nSELECT 1 FROM") + 1].removeprefix("WITH ") + ",\n" if base else ""
    return f"WITH {before}{chain}\n{select}"


#: The rules of the splitter, written out. E: end marks, B: blanks.
E, B = ".!?…", " \t\r\n\f\x0b\u00a0"
SPLIT = f"""pieces AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{E}]*[{E}]+[»"”’)\\]]*[{B}]*|[^{E}]+$') AS ps FROM documents),
judged AS (SELECT doc_id, ps, list_filter(range(1, len(ps) + 1), lambda i: CASE WHEN i = len(ps) THEN true
    WHEN NOT regexp_matches(ps[i], '[{B}]\\z') THEN false
    WHEN regexp_matches(ps[i], '\n[{B}]*\n[{B}]*\\z') THEN true
    WHEN regexp_matches(ps[i + 1], '^[«"“„‘(\\[—–{B}-]*[a-zß-öø-ÿ]') THEN false
    WHEN regexp_matches(ps[i + 1], '^[,;:»”’)\\]]') THEN false
    WHEN regexp_matches(ps[i], '^[{B}]*([0-9]|[0-9][0-9]|[0-9][0-9][0-9]|[IVXLCDM]{{1,6}}|[a-zß-öø-ÿA-ZÀ-ÖØ-Þ])[.][{B}]*\\z') THEN false
    WHEN regexp_matches(ps[i], '(?i)(^|[^0-9A-Za-z_À-ÿ])(of|on|to|and|mr|dr)[.][{B}]*\\z') THEN false
    WHEN regexp_matches(ps[i], '(^|[^0-9A-Za-z_À-ÿ])[A-ZÀ-ÖØ-Þ][.][{B}]*\\z') AND regexp_matches(ps[i + 1], '^[A-ZÀ-ÖØ-Þ]') THEN false ELSE true END) AS es FROM pieces),
raws AS (SELECT doc_id, unnest(list_transform(es, lambda e, k: array_to_string(ps[CASE WHEN k = 1 THEN 1 ELSE es[k - 1] + 1 END:e], ''))) AS raw, generate_subscripts(es, 1) AS k FROM judged),
set_down AS (SELECT *, coalesce(sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, regexp_replace(raw, '^[{B}]+|[{B}]+\\z', '', 'g') AS sent FROM raws)"""

ORACLE_SQL: dict[str, str] = {
    "rule_sentences": f"WITH {SPLIT}\nSELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS sent_id, (before + length(raw) - length(regexp_replace(raw, '^[{B}]+', '')))::BIGINT AS start, (before + length(raw) - length(regexp_replace(raw, '^[{B}]+', '')) + length(sent))::BIGINT AS stop, md5(sent) AS digest, len(regexp_extract_all(sent, {quoted(L.token)}))::INT AS word_count FROM set_down WHERE sent <> ''",
    "dictionary_forms": f"WITH {DICTIONARY}\nSELECT form, lemma, tags, weight FROM forms",
    "dictionary_ending_rules": f"WITH {RULES}\nSELECT ending, cut, added, tags, n FROM rules",
    "dictionary_analyses": _over(ANALYSES, "SELECT word, n, lemma, tags, all_tags, how FROM analyses", "words"),
    "dictionary_lemmas": _over(ANALYSES, "SELECT doc_id, sent_id, coalesce(array_to_string(t.lemmas, ' '), '') AS lemmas, md5(coalesce(array_to_string(t.tags, ';'), '')) AS tags FROM words LEFT JOIN told t USING (doc_id, sent_id)", "words"),
    "speech_act_imperative": _over(
        ANALYSES, r"SELECT hit_id, CASE WHEN token_idx = token_end_idx AND regexp_matches(t.tags[token_idx + 1], '(?:^|[ ,])impr(?:$|[ ,])') THEN 'PROMPT' ELSE speech_act END AS act FROM hits h JOIN told t USING (doc_id, sent_id) JOIN roles r USING (doc_id, sent_id)", "words", "hits", "roles",
    ),
}
