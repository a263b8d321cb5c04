"""The library's queries by name, each with its SQL over the same tables.

All but the last few run over the bench analysis: the Latin profile's lexicon over the whole documents table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import lexicon, plotdata, quality, segments, stats, texts
from glossa.operators.tagging import ACT_LABELS_RU, LABELS_RU, OTHERS, PERSPECTIVES, TAG_LABELS_RU, with_labels
from glossa.plans.analysis import Analysis, Scopes, bench_analysis
from glossa.plans.oracle import quoted, rate, share, sql
from glossa.plans.profile import LATIN

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

KEYS = "marker_id, marker_label, unit_type, microtheme, phrase_family, marker_source, precision_level"
HIT = ["doc_id", "sent_id", "hit_id", "hit_type", "marker_id", "token_idx", "token_end_idx", "target_lemma", "target_surface"]
EXAMPLE = ["hit_id", "marker_id", "sent_text", "hero_link", "perspective"]


def add(name: str, of: Callable[[Analysis], DataFrame], select: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: of(bench_analysis(spark, sf_dir))
    if select:
        ORACLE_SQL[name] = sql(select)


def names(columns: list[str]) -> str:
    return ", ".join(columns)


def grouped(table: str, key: str, n: str = "count(*)") -> str:
    return f"SELECT {key}, {n} AS count, {share(n, f'sum({n}) OVER ()')} AS share_pct FROM {table} GROUP BY {key}"


def by_marker(table: str) -> str:
    return f"SELECT {KEYS}, count(*) AS count, {share('count(*)', 'sum(count(*)) OVER ()')} AS share_pct, {rate('count(*)', 'max(ns)', 1000)} AS per_1000_sentences, {rate('count(*)', 'max(nw)', 10000)} AS per_10000_words FROM {table} CROSS JOIN totals GROUP BY {KEYS}"


# the flagship: words alone, straight from the scan
def word_hits_by_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-word markers over all documents: one join of exploded lemmas with the lexicon, one aggregation."""
    a = bench_analysis(spark, sf_dir)
    sents = texts.sentences(a.sources.docs, a.p)
    words = a.markers.where(F.col("unit_type") == "WORD").select(*stats.MARKER_KEYS, "unit_norm")
    hits = sents.select(F.explode("lemmas").alias("unit_norm")).join(words, "unit_norm")
    return stats.by_marker(hits, sents)


QUERIES["word_hits_by_marker"] = word_hits_by_marker
ORACLE_SQL["word_hits_by_marker"] = sql(by_marker("(SELECT m.* FROM tokens t JOIN markers m ON m.unit_type = 'WORD' AND m.unit_norm = t.lemma)"))

# ------------------------------------------------------------------ texts
add("heading_lines", lambda a: a.headings, "SELECT * FROM headings")
add("heading_removal", lambda a: texts.without_headings(a.sources.docs, a.p).select("doc_id", F.md5("text").alias("digest")), "SELECT doc_id, md5(text) AS digest FROM cleaned")
add("sentences", lambda a: a.plain.select("doc_id", "sent_id", "sent_text", "word_count"), "SELECT doc_id, sent_id, sent_text, word_count FROM sents")
add("first_sentences", lambda a: texts.sentences(a.sources.docs, a.p, 3).select("doc_id", "sent_id", "word_count"), "SELECT doc_id, sent_id, word_count FROM sents WHERE sent_id < 3")
add("tokens_and_lemmas", lambda a: a.plain.select("doc_id", "sent_id", F.array_join("tokens", " ").alias("tokens"), F.array_join("lemmas", " ").alias("lemmas")), "SELECT doc_id, sent_id, array_to_string(tokens, ' ') AS tokens, array_to_string(lemmas, ' ') AS lemmas FROM sents")
add("lemma_counts", lambda a: a.plain.select(F.explode("lemmas").alias("lemma")).groupBy("lemma").agg(F.count("*").alias("n")), "SELECT lemma, count(*) AS n FROM tokens GROUP BY lemma")
add("corpus_totals", lambda a: stats.totals(a.plain), "SELECT ns AS sentences_total, nw::BIGINT AS words_total FROM totals")
add("context_window", lambda a: texts.contexts(a.plain, a.p.context_window_sentences).select("doc_id", "sent_id", "prev_sent_text", "next_sent_text", "context_window"), "SELECT doc_id, sent_id, prev_sent_text, next_sent_text, context_window FROM sents")
add("direct_speech_helper", lambda a: a.plain.select("doc_id", "sent_id", T.looks_like_direct_speech("sent_text", a.p).alias("direct")), r"""SELECT doc_id, sent_id, contains(sent_text, '"') OR regexp_matches(sent_text, '^\s*[—-]\s+\S') AS direct FROM sents""")
add("contains_any_name", lambda a: a.plain.where(T.contains_any("sent_text", list(a.p.names))).groupBy("doc_id").agg(F.count("*").alias("n")), "SELECT doc_id, count(*) AS n FROM sents WHERE contains(sent_text, 'Orre') OR contains(sent_text, 'That') OR contains(sent_text, 'Eriner') OR contains(sent_text, 'Thon') OR contains(sent_text, 'With') GROUP BY doc_id")
add(
    "proper_names", lambda a: a.plain.select("doc_id", "sent_id", F.array_join(T.proper_names("sent_text", a.p), ";").alias("found")),
    "SELECT doc_id, sent_id, array_to_string(list_filter(regexp_extract_all(sent_text, '[A-Z][a-z]+'), lambda w, i: i > 1 OR regexp_matches(w, '(?:er|on|ed)$') OR contains(w, 'Y')), ';') AS found FROM sents",
)

# ------------------------------------------------------------------ lexicon
MARKER = ["marker_id", "marker_source", "microtheme", "phrase_family", "unit_type", "unit_raw", "unit_norm", "marker_label", "precision_level", "source_type", "enabled", "risk_comment", "comment"]
add("marker_registry", lambda a: a.markers.select(*MARKER, F.col("marker_ord").cast("long").alias("marker_ord")), f"SELECT {names(MARKER)}, marker_ord FROM markers")
add("registry_levels", lambda a: lexicon.registry(a.sources.curated, a.sources.listed, a.sources.phrases, a.sources.themes, a.p, ("EXTENDED",)).select(*MARKER), f"SELECT {names(MARKER)} FROM markers WHERE precision_level = 'EXTENDED'")
add("microtheme_aliases", lambda a: lexicon.theme_aliases(a.sources.themes), "SELECT alias, canonical FROM aliases")
add("microtheme_normalised", lambda a: lexicon.normalise_themes(a.sources.curated, lexicon.theme_aliases(a.sources.themes), a.p).select("id", "microtheme"), "SELECT marker_id AS id, microtheme FROM curated")
add("listed_units", lambda a: lexicon.listed(a.sources.listed, lexicon.theme_aliases(a.sources.themes), a.p).select("marker_id", "microtheme", "unit_raw", "unit_norm", "marker_label"), "SELECT marker_id, microtheme, unit_raw, unit_norm, unit_norm || ' [' || microtheme || ']' AS marker_label FROM listed")
add("lexicon_union", lambda a: lexicon.phrases(a.sources.phrases, lexicon.theme_aliases(a.sources.themes), a.p).unionByName(lexicon.curated(a.sources.curated, lexicon.theme_aliases(a.sources.themes), a.p)).unionByName(lexicon.listed(a.sources.listed, lexicon.theme_aliases(a.sources.themes), a.p)).groupBy("marker_source", "unit_type", "precision_level").agg(F.count("*").alias("n")), "SELECT marker_source, unit_type, precision_level, count(*) AS n FROM sourced GROUP BY ALL")

# ------------------------------------------------------------------ matching
add("phrase_gap_match", lambda a: _candidates(a), "SELECT doc_id, sent_id, marker_id, s AS start, e AS stop FROM candidates")
add("phrase_overlap_suppressed", lambda a: _apart(a), "SELECT doc_id, sent_id, len(found)::INT AS n, array_to_string(list_transform(found, lambda x: x.marker_id || ':' || x.s || '-' || x.e), ';') AS spans FROM apart")
add("phrase_prefer_longest", lambda a: a.found.where("hit_type = 'PHRASE'").select(*[c for c in HIT if c != "hit_id"]), f"SELECT {names([c for c in HIT if c != 'hit_id'])} FROM phrase_hits")
NESTED = ["doc_id", "sent_id", "marker_id", "token_idx", "token_end_idx", "nested_overlap_with", "candidate_id", "drop_reason"]
add("phrase_nested_dropped", lambda a: a.nested.select(*NESTED), f"SELECT {names(NESTED)} FROM nested")
add("phrase_keep_all", lambda a: _keep_all(a), "SELECT doc_id, sent_id, x.marker_id AS marker_id, x.s AS token_idx, x.e AS token_end_idx FROM (SELECT doc_id, sent_id, unnest(found) AS x FROM apart)")
add("word_in_phrase_flag", lambda a: a.found.where("hit_type = 'WORD'").select("doc_id", "sent_id", "token_idx", "marker_id", "overlaps_phrase", "phrase_overlap_ids", "count_in_main_stats"), "SELECT doc_id, sent_id, token_idx, marker_id, overlaps_phrase, phrase_overlap_ids, count_in_main_stats FROM word_hits")
add("noise_first_rule", lambda a: a.found.where("is_noise").select("doc_id", "sent_id", "token_idx", "marker_id", "noise_reason"), "SELECT doc_id, sent_id, token_idx, marker_id, noise_reason FROM word_hits WHERE is_noise")
add("hit_ids_dense", lambda a: a.hits.select(*HIT), f"SELECT {names(HIT)} FROM hits")
add("hits_sample", lambda a: a.hits.orderBy("hit_id").limit(a.p.max_hits_sample).select(*HIT), f"SELECT {names(HIT)} FROM hits ORDER BY hit_id LIMIT 500")

# ------------------------------------------------------------------ tagging
FLAGS = ["is_direct_speech", "has_inner_speech", "has_hero_pronoun", "hero_name_variant"]
add("sentence_flags", lambda a: a.sentences.select("doc_id", "sent_id", *FLAGS), f"SELECT doc_id, sent_id, {names(FLAGS)} FROM flags")
add("hero_proximity", lambda a: a.sentences.select("doc_id", "sent_id", "hero_link", "hero_evidence"), "SELECT doc_id, sent_id, hero_link, hero_evidence FROM linked_sents")
ROLES = ["speaker", "speaker_evidence", "speaker_name", "addressee", "addressee_evidence", "addressee_name", "speech_act"]
add("speaker_attribution", lambda a: a.sentences.select("doc_id", "sent_id", *ROLES[:3]), f"SELECT doc_id, sent_id, {names(ROLES[:3])} FROM roles")
add("addressee_attribution", lambda a: a.sentences.select("doc_id", "sent_id", *ROLES[3:6]), f"SELECT doc_id, sent_id, {names(ROLES[3:6])} FROM roles")
add("speech_act", lambda a: a.sentences.select("doc_id", "sent_id", "speech_act"), "SELECT doc_id, sent_id, speech_act FROM roles")
VIEW = ["perspective", "perspective_evidence", "perspective_confidence", "speaker_detected", "addressee_detected", "others_speech_act"]
add("perspective_case", lambda a: a.sentences.select("doc_id", "sent_id", *VIEW), f"SELECT doc_id, sent_id, {names(VIEW)} FROM tagged_sents")
META = ["marker_label", "microtheme", "unit_type", "marker_source", "precision_level", "source_type", "risk_comment", "unit_raw", "unit_norm", "phrase_family"]
add("marker_meta_join", lambda a: a.placed(a.hits).select("hit_id", "marker_id", *META), f"SELECT hit_id, marker_id, {names(META)} FROM tagged")
add("segment_range_join", lambda a: a.placed(a.hits).select("hit_id", "sent_id", "book_id", "book", "part_id", "part"), "SELECT hit_id, sent_id, book_id, book, part_id, part FROM tagged")
TAGGED = [*HIT, "sent_text", "prev_sent_text", "next_sent_text", "context_window", "overlaps_phrase", "phrase_overlap_ids", "is_noise", "noise_reason", "count_in_main_stats", *META, "hero_link", "hero_evidence", *VIEW, "book_id", "book", "part_id", "part"]
add("tagged_hits", lambda a: a.tagged.select(*TAGGED), f"SELECT {names(TAGGED)} FROM tagged")
LINK = "CASE hero_link WHEN 'YES' THEN 0 WHEN 'PROBABLE' THEN 1 ELSE 2 END"
PLACE = "doc_id, sent_id, token_idx, hit_id"
add("priority_sample", lambda a: quality.priority_sample(a.numbered("hero_link"), a.p.max_hits_sample).select(*HIT, "hero_link"), f"SELECT {names(HIT)}, hero_link FROM tagged ORDER BY {LINK}, {PLACE} LIMIT 500")
LABELS = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in LABELS_RU.items())
add("perspective_labels", lambda a: _labels(a), f"SELECT CASE perspective {LABELS} ELSE perspective END AS label, count(*) AS n FROM tagged GROUP BY 1")

TAGS_RU, ACTS_RU = (" ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in t.items()) for t in (TAG_LABELS_RU, ACT_LABELS_RU))
add("tag_labels", lambda a: with_labels(a.scopes.narrow).groupBy("perspective_label", "speech_act_label").agg(F.count("*").alias("n")), f"SELECT CASE perspective {TAGS_RU} ELSE perspective END AS perspective_label, CASE others_speech_act {ACTS_RU} ELSE others_speech_act END AS speech_act_label, count(*) AS n FROM tagged GROUP BY 1, 2")

# ------------------------------------------------------------------ segments
add("segments_ntile", lambda a: segments.equal_segments(a.plain, 8, "part"), "SELECT doc_id, part_id, 'Part ' || part_id AS part_name, min(sent_id) AS start_sent, max(sent_id) AS end_sent FROM (SELECT doc_id, sent_id, ntile(8) OVER (PARTITION BY doc_id ORDER BY sent_id)::INT AS part_id FROM sents) GROUP BY ALL")
add(
    "asof_heading_to_sentence", lambda a: segments.char_to_sentence(texts.headings(a.sources.docs, a.p).select("doc_id", "heading_id", F.col("char_pos_approx").alias("char_pos")), texts.sentence_offsets(a.sources.docs, a.p)),
    r"""SELECT h.doc_id, h.heading_id, h.char_pos_approx AS char_pos, coalesce(o.sent_id, 0) AS sid FROM headings h ASOF LEFT JOIN (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS sent_id,
        before + length(piece) - length(regexp_replace(piece, '^\s+', '')) AS start FROM (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?…]+(?:[.!?…]+|$)|[.!?…]+') AS ps FROM raw)))
        WHERE regexp_matches(piece, '^[^.!?…]') AND regexp_matches(piece, '\S')) o ON h.doc_id = o.doc_id AND h.char_pos_approx >= o.start""",
)

# ------------------------------------------------------------------ scopes and counts
add("scope_sizes", lambda a: _scopes(a), "SELECT (SELECT count(*) FROM tagged) AS raw, (SELECT count(*) FROM clean) AS clean, (SELECT count(*) FROM counted) AS counted, (SELECT count(*) FROM wide) AS wide, (SELECT count(*) FROM strict) AS strict")
add("counted_filter", lambda a: _scopes_of(a, "perspective_confidence").counted.select("hit_id"), "SELECT hit_id FROM counted")
add("counted_high_confidence", lambda a: _high(a), "SELECT hit_id FROM counted WHERE perspective_confidence = 'HIGH'")
for scope, table in (("all", "counted"), ("strict", "strict"), ("wide", "wide")):
    add(f"marker_{scope}", lambda a, t=table: stats.by_marker(getattr(a.scopes, t), a.plain), by_marker(table))
for lv in ("CORE", "EXTENDED"):
    add(f"marker_{lv.lower()}", lambda a, lv=lv: stats.by_marker(a.scopes.counted.where(stats.level(lv)), a.plain), by_marker(f"(SELECT * FROM counted WHERE precision_level = '{lv}')"))
add("marker_experimental", lambda a: stats.by_marker(a.scopes.narrow.where(stats.level("EXPERIMENTAL")), a.plain), by_marker("(SELECT * FROM tagged WHERE precision_level = 'EXPERIMENTAL')"))
for name, table, key in (
    ("by_link", "counted", "hero_link"), ("perspective_linked", "wide", "perspective"), ("perspective_strict", "strict", "perspective"), ("perspective_conf", "wide", "perspective_confidence"), ("microtheme_all", "counted", "microtheme"),
    ("microtheme_linked", "wide", "microtheme"), ("precision_layers", "counted", "precision_level"),
):
    add(name, lambda a, t=table, k=key: stats.group_count(getattr(a.scopes, t), k), grouped(table, key))
add("phrase_family_coverage", lambda a: stats.group_count(a.scopes.wide.where("unit_type = 'PHRASE'"), "phrase_family"), grouped("(SELECT * FROM wide WHERE unit_type = 'PHRASE')", "phrase_family"))
IN_OTHERS = "perspective IN ('OTHERS_TO_HERO', 'OTHERS_ABOUT_HERO', 'OTHERS_NEAR_HERO')"
add("others_speechact", lambda a: stats.group_count(a.scopes.wide.where(F.col("perspective").isin(*OTHERS)), "others_speech_act"), grouped(f"(SELECT * FROM wide WHERE {IN_OTHERS})", "others_speech_act"))
COVERAGE = ["marker_id", "marker_source", "microtheme", "phrase_family", "unit_type", "unit_raw", "unit_norm", "marker_label", "precision_level", "source_type", "risk_comment"]
add(
    "coverage", lambda a: stats.coverage(a.markers, a.scopes.counted),
    f"SELECT {', '.join('m.' + c for c in COVERAGE)}, count(c.hit_id) AS count_all, count(c.hit_id) FILTER (c.hero_link = 'YES') AS count_strict, count(c.hit_id) FILTER (c.hero_link IN ('YES', 'PROBABLE')) AS count_wide, count(c.hit_id) > 0 AS appears_in_corpus, count(c.hit_id) FILTER (c.hero_link = 'YES') > 0 AS appears_in_strict_hero FROM markers m LEFT JOIN counted c ON c.marker_id = m.marker_id GROUP BY ALL",
)


def rates(kind: str) -> str:
    return f"""SELECT g.{kind}_name AS {kind}, g.start_sent, g.end_sent, coalesce(n, 0)::BIGINT AS sentences, coalesce(w, 0)::BIGINT AS words, coalesce(h, 0)::BIGINT AS hits, {rate('coalesce(h, 0)', 'n', 1000)} AS hits_per_1000_sentences, {rate('coalesce(h, 0)', 'w', 10000)} AS hits_per_10000_words
        FROM {kind}s g LEFT JOIN (SELECT {kind}_id, count(*) AS n, sum(word_count) AS w FROM sents JOIN {kind}s ON sent_id BETWEEN start_sent AND end_sent GROUP BY 1) s USING ({kind}_id)
        LEFT JOIN (SELECT q.{kind}_id, count(*) AS h FROM wide JOIN {kind}s q ON sent_id BETWEEN q.start_sent AND q.end_sent GROUP BY 1) t USING ({kind}_id)"""


add("part_normalized", lambda a: stats.segment_rates(a.scopes.wide, a.plain, a.sources.parts, "part"), rates("part"))
add("book_normalized", lambda a: stats.segment_rates(a.scopes.wide, a.plain, a.sources.books, "book"), rates("book"))


def pivoted(index: str, column: str, cells: list[str]) -> str:
    return f"SELECT {index}, " + ", ".join(f"count(*) FILTER ({column} = {quoted(c)}) AS {quoted(c).replace(chr(39), chr(34))}" for c in cells) + f" FROM wide GROUP BY {index}"


THEMES = ["article", "function words", "join / link", "place", "reference", "loose chain", "doubt"]
add("pivot_perspective_microtheme", lambda a: stats.pivot_matrix(a.scopes.wide, "perspective", "microtheme", THEMES), pivoted("perspective", "microtheme", THEMES))
add("pivot_part_microtheme", lambda a: stats.pivot_matrix(a.scopes.wide, "part", "microtheme", THEMES), pivoted("part", "microtheme", THEMES))
add("pivot_part_precision", lambda a: stats.pivot_matrix(a.scopes.wide, "part", "precision_level", ["CORE", "EXTENDED"]), pivoted("part", "precision_level", ["CORE", "EXTENDED"]))


def indicator(name: str, where: str) -> str:
    return f"SELECT part, count(*) AS all_hits, count(*) FILTER ({where}) AS {name}, {share(f'count(*) FILTER ({where})', 'count(*)')} AS share_pct FROM wide GROUP BY part"


add("part_inner_speech", lambda a: stats.part_indicator(a.scopes.wide, ["HERO_INNER_SPEECH"], "inner_speech_hits"), indicator("inner_speech_hits", "perspective = 'HERO_INNER_SPEECH'"))
add("part_external_pressure", lambda a: stats.part_indicator(a.scopes.wide, list(OTHERS), "external_pressure_hits"), indicator("external_pressure_hits", IN_OTHERS))
add("hero_vs_corpus", lambda a: stats.hero_vs_corpus(a.scopes.counted), " UNION ALL ".join(f"SELECT '{s}' AS scope, microtheme, count(*) AS count, {share('count(*)', 'sum(count(*)) OVER ()')} AS share_pct FROM {t} GROUP BY microtheme" for s, t in (("CORPUS_COUNTED", "counted"), ("HERO_STRICT", "strict"), ("HERO_WIDE", "wide"))))
COUNTS = {"inner_speech_hits": "perspective = 'HERO_INNER_SPEECH'", "core_hits": "precision_level = 'CORE'", "extended_hits": "precision_level = 'EXTENDED'"}
cell = lambda k, w: f"count(*) FILTER ({w}) AS {k}"
add(
    "analytical_indices", lambda a: stats.analytical_indices(a.scopes.wide, stats.segment_rates(a.scopes.wide, a.plain, a.sources.parts, "part")),
    f"""SELECT n.*, {share('inner_speech_hits', 'all_hits')} AS inner_speech_index_pct, {share('external_pressure_hits', 'all_hits')} AS external_pressure_index_pct, {share('extended_hits', '(core_hits + extended_hits)')} AS extended_cognition_index_pct, r.hits_per_10000_words AS cognitive_density_per_10000_words
        FROM (SELECT part, count(*) AS all_hits, {', '.join(cell(k, w) for k, w in COUNTS.items())}, {cell('external_pressure_hits', IN_OTHERS)} FROM wide GROUP BY part) n LEFT JOIN ({rates('part')}) r USING (part)""",
)
add("cognitive_profile", lambda a: stats.cognitive_profile(a.scopes.wide), f"SELECT microtheme, count(*) AS count, {share('count(*)', 'sum(count(*)) OVER ()')} AS share_pct, {', '.join(cell(k, w) for k, w in COUNTS.items())}, {cell('narrator_hits', "perspective = 'NARRATOR_ABOUT_HERO'")}, {cell('external_hits', IN_OTHERS)} FROM wide GROUP BY microtheme")


def top(table: str, n: int) -> str:
    return f"(SELECT marker_id FROM {table} GROUP BY marker_id ORDER BY count(*) DESC, marker_id LIMIT {n})"


for kind in ("part", "book"):
    add(f"top_n_semi_dynamics_{kind}", lambda a, k=kind: stats.dynamics(a.scopes.wide, k, 8), f"SELECT {kind}, marker_id, marker_label, count(*) AS count FROM wide WHERE marker_id IN {top('wide', 8)} GROUP BY ALL")
add("noise_report", lambda a: stats.noise_report(a.scopes.narrow), "SELECT noise_reason, target_surface, target_lemma, count(*) AS count FROM tagged WHERE is_noise GROUP BY ALL")
add("word_phrase_overlaps", lambda a: stats.overlap_report(a.scopes.narrow), "SELECT target_lemma, target_surface, phrase_overlap_ids, count(*) AS count FROM tagged WHERE hit_type = 'WORD' AND overlaps_phrase GROUP BY ALL")
add("strict_vs_wide", lambda a: stats.strict_vs_wide(a.scopes.counted, a.p.link_mode), "SELECT 'STRICT' AS mode, 'hero_link = YES' AS definition, count(*) AS count FROM strict UNION ALL SELECT 'WIDE', 'hero_link = YES + PROBABLE', count(*) FROM wide UNION ALL SELECT 'CONFIG_USED', 'WIDE', count(*) FROM wide")
OVERVIEW = {
    "sentences_total": "(SELECT ns FROM totals)", "words_total": "(SELECT nw FROM totals)", "hits_total_raw": "(SELECT count(*) FROM tagged)", "hits_total_counted": "(SELECT count(*) FROM counted)", "hits_linked_wide": "(SELECT count(*) FROM wide)",
    "hits_linked_strict": "(SELECT count(*) FROM strict)", "noise_hits_excluded": "(SELECT count(*) FROM tagged WHERE is_noise)", "overlapping_word_hits_excluded": "(SELECT count(*) FROM tagged WHERE hit_type = 'WORD' AND overlaps_phrase)",
    "unique_markers_in_registry": "(SELECT count(*) FROM markers)", "phrase_markers_in_registry": "(SELECT count(*) FROM markers WHERE unit_type = 'PHRASE')", "core_markers_in_registry": "(SELECT count(*) FROM markers WHERE precision_level = 'CORE')",
    "extended_markers_in_registry": "(SELECT count(*) FROM markers WHERE precision_level = 'EXTENDED')", "experimental_markers_in_registry": "(SELECT count(*) FROM markers WHERE precision_level = 'EXPERIMENTAL')",
    "unique_markers_in_corpus_counted": "(SELECT count(DISTINCT marker_id) FROM counted)", "unique_markers_strict_hero": "(SELECT count(DISTINCT marker_id) FROM strict)", "unique_markers_wide_hero": "(SELECT count(DISTINCT marker_id) FROM wide)",
    "link_mode_used": "'WIDE'", "manual_verification_file": "'MANUAL_VERIFICATION'",
}
add("overview_metrics", lambda a: stats.overview(a.scopes.narrow, a.markers, a.plain, a.p), " UNION ALL ".join(f"SELECT '{k}' AS metric, ({v})::VARCHAR AS value" for k, v in OVERVIEW.items()))
SETTINGS = (("analysis_profile", "STRICT"), ("link_mode", "WIDE"), ("include_noise_in_counts", "False"), ("count_overlapping_word_hits", "False"), ("enabled_precision_levels", "CORE, EXTENDED"), ("experimental_phrases_in_main_stats", "True"), ("min_perspective_confidence_main", "LOW"))
add("profile_settings", lambda a: stats.profile_settings(a.sources.docs.sparkSession, a.p), " UNION ALL ".join(f"SELECT '{k}' AS setting, '{v}' AS value" for k, v in SETTINGS))
add("duplicate_lemmas", lambda a: stats.duplicates(lexicon.phrases(a.sources.phrases, lexicon.theme_aliases(a.sources.themes), a.p).select("marker_id", "phrase_family"), ["phrase_family"]), "SELECT marker_id, phrase_family FROM phrases QUALIFY count(*) OVER (PARTITION BY phrase_family) > 1")

# ------------------------------------------------------------------ quality
PHRASE = ["marker_id", "marker_label", "microtheme", "phrase_family", "unit_raw", "unit_norm", "precision_level", "source_type", "risk_comment"]
PHRASE_COVERAGE = f"SELECT {', '.join('m.' + c for c in PHRASE)}, count(h.hit_id) AS count_all, count(h.hit_id) > 0 AS appears_in_corpus FROM markers m LEFT JOIN (SELECT * FROM tagged WHERE hit_type = 'PHRASE') h ON h.marker_id = m.marker_id WHERE m.unit_type = 'PHRASE' GROUP BY ALL"
add("phrase_coverage", lambda a: quality.phrase_coverage(a.markers, a.scopes.narrow), PHRASE_COVERAGE)
add("coverage_zero_hits", lambda a: quality.phrase_zero_hits(a.markers, a.scopes.narrow.where("hero_link = 'YES' AND part_id > 5")).select("marker_id"), "SELECT marker_id FROM markers WHERE unit_type = 'PHRASE' AND marker_id NOT IN (SELECT marker_id FROM tagged WHERE hit_type = 'PHRASE' AND hero_link = 'YES' AND part_id > 5)")
add("phrase_top_hits", lambda a: quality.phrase_top(a.markers, a.scopes.narrow), f"SELECT * FROM ({PHRASE_COVERAGE}) WHERE count_all > 0 ORDER BY count_all DESC, precision_level, marker_id LIMIT 100")
add("topk_examples_per_marker", lambda a: quality.phrase_examples(a.narrow, texts=a.with_texts_of_few).select(*EXAMPLE), f"SELECT {names(EXAMPLE)} FROM tagged WHERE hit_type = 'PHRASE' QUALIFY row_number() OVER (PARTITION BY marker_id ORDER BY {PLACE}) <= 3")
add("phrase_by_precision", lambda a: stats.group_count(a.markers.where("unit_type = 'PHRASE'"), "precision_level"), grouped("(SELECT * FROM markers WHERE unit_type = 'PHRASE')", "precision_level"))
add("phrase_by_family", lambda a: stats.group_count(a.scopes.narrow.where("hit_type = 'PHRASE'"), "phrase_family"), grouped("(SELECT * FROM tagged WHERE hit_type = 'PHRASE')", "phrase_family"))
SUMMARY = {"markers_total": OVERVIEW["unique_markers_in_registry"], "phrase_markers": OVERVIEW["phrase_markers_in_registry"], "hits_raw": OVERVIEW["hits_total_raw"], "hits_counted": OVERVIEW["hits_total_counted"], "noise_hits": OVERVIEW["noise_hits_excluded"], "nested_phrase_candidates": "(SELECT count(*) FROM nested)"}
add("dashboard_summary", lambda a: quality.dashboard_summary(a.scopes.narrow, a.scopes.counted, a.markers, a.dropped), " UNION ALL ".join(f"SELECT '{k}' AS metric, {v} AS value" for k, v in SUMMARY.items()))
CHECKS = {("WARN", "empty_microtheme"): "(SELECT count(*) FROM markers WHERE trim(microtheme) = '')", ("ERROR", "duplicate_marker_id"): "(SELECT count(*) - count(DISTINCT marker_id) FROM markers)", ("INFO", "nested_phrase_candidates"): "(SELECT count(*) FROM nested)", ("WARN", "unknown_perspective"): "(SELECT count(*) FROM counted WHERE perspective = 'UNKNOWN')", ("INFO", "low_confidence"): "(SELECT count(*) FROM counted WHERE perspective_confidence = 'LOW')"}
add("dashboard_warnings", lambda a: quality.warnings(a.scopes.counted, a.markers, a.dropped), "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS level, '{c}' AS check, {v} AS n" for (k, c), v in CHECKS.items()) + ") WHERE n > 0")
PICK = "(SELECT hit_id, {i} AS pick FROM counted WHERE {w} ORDER BY hit_id LIMIT 100)"
add(
    "manual_required", lambda a: quality.manual_required(_scopes_of(a, "perspective", "perspective_confidence", "hero_link").counted).select("hit_id"),
    "SELECT hit_id FROM (SELECT hit_id, min(pick) AS pick FROM (" + " UNION ALL ".join(f"SELECT * FROM {PICK.format(i=i, w=w)}" for i, w in enumerate(("perspective = 'UNKNOWN'", "perspective_confidence = 'LOW'", "hero_link = 'PROBABLE'"))) + ") GROUP BY hit_id) ORDER BY pick, hit_id LIMIT 300",
)
BLANKS = "'' AS human_valid, '' AS human_hero_link, '' AS human_perspective, '' AS human_comment"
for name, table, order in (
    ("hit_check", "counted", f"hero_link, {PLACE}"), ("phrase_check", "(SELECT * FROM counted WHERE hit_type = 'PHRASE')", "precision_level, marker_id, hit_id"), ("perspective_check", "(SELECT * FROM counted WHERE perspective_confidence IN ('LOW', 'MEDIUM'))", "hit_id"),
    ("probable_link_check", "(SELECT * FROM counted WHERE hero_link = 'PROBABLE')", "hit_id"), ("noise_check", "(SELECT * FROM tagged WHERE is_noise)", "hit_id"),
):
    add(f"verify_{name}", lambda a, n=name: quality.verification(a.narrow, a.counted, texts=a.with_texts_of_few, only=n)[n].select("hit_id", "target_surface", "human_valid", "human_hero_link", "human_perspective", "human_comment"), f"SELECT hit_id, target_surface, {BLANKS} FROM {table} ORDER BY {order} LIMIT 300")
add("manual_check", lambda a: quality.manual_check(a.numbered("hero_link")).select("hit_id", "human_valid", "human_perspective", "human_comment"), f"SELECT hit_id, '' AS human_valid, '' AS human_perspective, '' AS human_comment FROM tagged ORDER BY {LINK}, {PLACE} LIMIT 300")

# ------------------------------------------------------------------ showcase
TOP_KEYS = ["marker_id", "marker_label", "microtheme", "phrase_family", "unit_type", "precision_level"]
CLEAN = {"all": "clean", "strict": "(SELECT * FROM clean WHERE hero_link = 'YES')", "wide": "(SELECT * FROM clean WHERE hero_link IN ('YES', 'PROBABLE'))"}
for scope, table in CLEAN.items():
    add(f"showcase_top_{scope}", lambda a, s=scope: quality.count_table(a.scopes.clean if s == "all" else stats.linked(a.scopes.clean, s), TOP_KEYS, 25), f"{grouped(table, names(TOP_KEYS))} ORDER BY count DESC, {names(TOP_KEYS)} LIMIT 25")
TOPIC = {"strict": CLEAN["strict"], "core": f"(SELECT * FROM {CLEAN['wide']} WHERE precision_level = 'CORE')", "extended": f"(SELECT * FROM {CLEAN['wide']} WHERE precision_level = 'EXTENDED')", "experimental": "(SELECT * FROM clean WHERE precision_level = 'EXPERIMENTAL')"}
TOPIC |= {"inner": f"(SELECT * FROM {CLEAN['wide']} WHERE perspective = 'HERO_INNER_SPEECH')", "others_to": f"(SELECT * FROM {CLEAN['wide']} WHERE perspective = 'OTHERS_TO_HERO')", "narrator": f"(SELECT * FROM {CLEAN['strict']} WHERE perspective = 'NARRATOR_ABOUT_HERO')", "others": f"(SELECT * FROM {CLEAN['wide']} WHERE {IN_OTHERS})"}
TOPIC |= {k: f"(SELECT * FROM {CLEAN['wide']} WHERE regexp_matches(microtheme, '(?i){v}'))" for k, _, v in LATIN.topics}
for topic, table in TOPIC.items():
    add(f"examples_{topic}", lambda a, t=topic: _examples(a, t).select("hit_id", "marker_id"), f"SELECT hit_id, marker_id FROM {table} AS x WHERE marker_id IN (SELECT marker_id FROM {table} AS y GROUP BY marker_id ORDER BY count(*) DESC, marker_id LIMIT 25) QUALIFY row_number() OVER (PARTITION BY marker_id ORDER BY {PLACE}) <= 4")
BUCKETS = {"narrator about hero": "perspective = 'NARRATOR_ABOUT_HERO'", "inner speech": "perspective = 'HERO_INNER_SPEECH'", "direct speech": "perspective = 'HERO_DIRECT_SPEECH'", "others to hero": "perspective = 'OTHERS_TO_HERO'"} | {k: f"regexp_matches(microtheme, '(?i){v}')" for k, _, v in LATIN.topics}
CONF = "CASE perspective_confidence WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END"
add("best_examples", lambda a: quality.best_examples(a.clean, a.p, texts=a.with_texts_of_few).select("thesis_bucket", "hit_id", "why_selected"), " UNION ALL ".join(f"(SELECT '{k}' AS thesis_bucket, hit_id, 'picked automatically as a compact example' AS why_selected FROM {CLEAN['wide']} WHERE {w} ORDER BY {CONF}, {PLACE} LIMIT 2)" for k, w in BUCKETS.items()))
add("noise_examples", lambda a: quality.noise_examples(a.hits).select("hit_id", "noise_reason"), "SELECT hit_id, noise_reason FROM tagged WHERE is_noise ORDER BY hit_id LIMIT 150")

# ------------------------------------------------------------------ plot data
W = CLEAN["wide"]
add("plot_top_markers", lambda a: plotdata.marker_bars(stats.linked(a.scopes.clean, "WIDE")), f"SELECT marker_id, max(marker_label) AS marker_label, count(*) AS count FROM {W} GROUP BY marker_id ORDER BY count DESC, marker_id LIMIT 15")
add("plot_microthemes", lambda a: plotdata.bars(stats.linked(a.scopes.clean, "WIDE"), "microtheme"), f"SELECT microtheme, count(*) AS count FROM {W} GROUP BY microtheme ORDER BY count DESC, microtheme LIMIT 15")
PIE = f"SELECT marker_id, max(marker_label) AS label, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, marker_id) AS k FROM {W} GROUP BY marker_id"
add("pie_top5_rest", lambda a: plotdata.pie(stats.linked(a.scopes.clean, "WIDE")), f"SELECT label, count, count / sum(count) OVER () * 100 >= 3 AS is_labelled FROM (SELECT label, count FROM ({PIE}) WHERE k <= 5 UNION ALL SELECT 'others', sum(count)::BIGINT FROM ({PIE}) WHERE k > 5 HAVING sum(count) > 0)")
ORDER = ", ".join(f"({i}, {quoted(x)}, {quoted(LABELS_RU[x])})" for i, x in enumerate(PERSPECTIVES))
add("perspective_fixed_order", lambda a: plotdata.perspective_bars(stats.linked(a.scopes.clean, "WIDE")), f"SELECT ord, o.perspective, label, count(w.hit_id) AS count FROM (VALUES {ORDER}) AS o(ord, perspective, label) LEFT JOIN {W} w ON w.perspective = o.perspective GROUP BY ALL")
for index in ("perspective", "part"):
    add(f"heatmap_{index}_microtheme", lambda a, i=index: plotdata.heatmap(stats.linked(a.scopes.clean, "WIDE"), i, "microtheme"), f"SELECT i.{index}, c.microtheme, count(w.hit_id) AS count FROM (SELECT DISTINCT {index} FROM {W}) i CROSS JOIN (SELECT microtheme FROM {W} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 14) c LEFT JOIN {W} w ON w.{index} = i.{index} AND w.microtheme = c.microtheme GROUP BY ALL")
add("corpus_vs_hero", lambda a: plotdata.corpus_vs_hero(a.scopes.clean, "WIDE"), "SELECT microtheme, count(*) AS corpus_count, count(*) FILTER (hero_link <> 'NO') AS hero_count, count(*) FILTER (hero_link <> 'NO') - count(*) AS difference_abs FROM clean GROUP BY microtheme")
add("plot_share_by_part", lambda a: plotdata.share_by_part(stats.linked(a.scopes.clean, "WIDE"), ["HERO_INNER_SPEECH"]), f"SELECT part, count(*) AS all_hits, count(*) FILTER (perspective = 'HERO_INNER_SPEECH') AS hits, {share("count(*) FILTER (perspective = 'HERO_INNER_SPEECH')", 'count(*)')} AS share_pct FROM {W} GROUP BY part")
for kind in ("part", "book"):
    add(f"plot_dynamics_{kind}", lambda a, k=kind: plotdata.dynamics_lines(stats.linked(a.scopes.clean, "WIDE"), getattr(a.sources, f"{k}s"), k), f"SELECT g.{kind}_id AS ord, g.{kind}_name AS {kind}, t.marker_id, count(w.hit_id) AS count FROM {kind}s g CROSS JOIN {top(W, 6)} t LEFT JOIN {W} w ON w.{kind} = g.{kind}_name AND w.marker_id = t.marker_id GROUP BY ALL")


def _candidates(a: Analysis) -> DataFrame:
    from glossa.operators import matching

    return matching.phrase_candidates(a.plain, a.markers, a.p)


def _apart(a: Analysis) -> DataFrame:
    from dataclasses import replace

    from glossa.operators import matching

    found = matching.matched(a.plain.select("doc_id", "sent_id", "sent_text", "tokens", "lemmas"), a.markers, [], replace(a.p, overlap_mode="keep_all"))
    found = found.select("doc_id", "sent_id", F.explode(F.filter(F.array("kept"), lambda x: F.size(x) > 0)).alias("kept"))  # not a filter, which is found below what makes `kept`
    return found.select("doc_id", "sent_id", F.size("kept").alias("n"), F.array_join(F.transform("kept", lambda x: F.concat_ws("", x["marker_id"], F.lit(":"), x["start"], F.lit("-"), x["stop"])), ";").alias("spans"))


def _keep_all(a: Analysis) -> DataFrame:
    from dataclasses import replace

    from glossa.operators import matching

    p = replace(a.p, overlap_mode="keep_all")
    rows = matching.matched(a.plain.select("doc_id", "sent_id", "sent_text", "tokens", "lemmas"), a.markers, a.rules, p)
    return matching.hit_rows(rows, a.markers, a.rules, p).where("hit_type = 'PHRASE'").select("doc_id", "sent_id", "marker_id", "token_idx", "token_end_idx")


def _examples(a: Analysis, topic: str) -> DataFrame:
    met, title = quality.choices(a.p)[topic]
    return quality.examples(a.first_of(stats.is_clean() & met), title, texts=a.with_texts_of_few)


def _labels(a: Analysis) -> DataFrame:
    table = F.create_map(*[F.lit(x) for k, v in LABELS_RU.items() for x in (k, v)])
    return a.scopes.narrow.groupBy(F.coalesce(table[F.col("perspective")], F.col("perspective")).alias("label")).agg(F.count("*").alias("n"))


def _scopes(a: Analysis) -> DataFrame:
    """In one pass: each scope is a condition on a hit."""
    t, p = a.scopes.narrow, a.p
    clean, counts, yes, wide = stats.is_clean(), stats.is_counted(p), F.col("hero_link") == "YES", F.col("hero_link").isin("YES", "PROBABLE")
    return t.agg(F.count("*").alias("raw"), F.count_if(clean).alias("clean"), F.count_if(counts).alias("counted"), F.count_if(counts & wide).alias("wide"), F.count_if(counts & yes).alias("strict"))


def _scopes_of(a: Analysis, *tags: str) -> Scopes:
    """Scopes of hits with ids that bring these tags alone."""
    return Scopes(a.placed(a.numbered(*tags)), a.p)


def _high(a: Analysis) -> DataFrame:
    from dataclasses import replace

    return stats.counted(_scopes_of(a, "perspective_confidence").narrow, replace(a.p, min_perspective_confidence_main="HIGH")).select("hit_id")


# ------------------------------------------------------------------ sources, sinks, segments and runs
from glossa import language_queries, project_queries  # noqa: E402

QUERIES |= project_queries.QUERIES | language_queries.QUERIES
ORACLE_SQL |= project_queries.ORACLE_SQL | language_queries.ORACLE_SQL
