"""The bench analysis in DuckDB's SQL, from the same profile values, as a chain of named steps."""

from __future__ import annotations

from glossa.functions.text import escape
from glossa.operators import tagging
from glossa.plans import profile as P
from glossa.plans.analysis import bench_profile
from glossa.plans.profile import Profile


def quoted(x: object) -> str:
    return "'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else "true" if x is True else "false" if x is False else "NULL" if x is None else str(x)


def values(table: tuple, columns: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in table)}) AS v({columns})"


def has(text: str, pattern: str, case: bool = False) -> str:
    return f"regexp_matches({text}, {quoted(('' if case else '(?i)') + pattern)})"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def plain_lower(x: str) -> str:
    return f"replace(lower({x}), 'ё', 'е')"


def lemma(x: str, p: Profile) -> str:
    form = plain_lower(x)
    return f"coalesce(MAP {{{', '.join(f'{quoted(k)}: {quoted(v)}' for k, v in p.lemmas.items())}}}[{form}], {form})"


def heading(x: str, p: Profile) -> str:
    return has(strip(x), rf"^(?:{p.heading})\s*[.!?…—-]*\s*$")


def heading_kind(x: str, p: Profile) -> str:
    return "CASE " + " ".join(f"WHEN starts_with(lower({strip(x)}), {quoted(k)}) THEN {quoted(v)}" for k, v in p.heading_kinds) + " ELSE 'heading' END"


def word(pattern: str, p: Profile) -> str:
    return f"(?:^|[^{p.letters}])(?:{pattern})(?:$|[^{p.letters}])"


def find_name(x: str, p: Profile) -> str:
    bound = f"[^{p.name_letters}]"
    return "CASE " + " ".join(f"WHEN {has(x, f'(?:^|{bound}){escape(v)}(?:$|{bound})')} THEN {quoted(v)}" for v in p.names) + " ELSE '' END"


def first(x: str, rules: list[tuple[str, str, str]], i: int, last: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(x, r[0])} THEN {quoted(r[i])}" for r in rules) + f" ELSE {last} END"


def share(part: str, whole: str) -> str:
    return f"coalesce(round_even({part} / nullif({whole}, 0) * 100, 2), 0.0)::DOUBLE"


def rate(part: str, whole: str, times: int) -> str:
    return f"coalesce(round_even({part} / nullif({whole}, 0) * {times}, 3), 0.0)::DOUBLE"


def theme(p: Profile, raw: str) -> str:
    """Normalised microtheme of an expression, by the aliases step."""
    key = f"lower(trim(coalesce({raw}, '')))"
    compact = f"replace(replace({key}, ' / ', '/'), '/', ' / ')"
    return f"coalesce((SELECT canonical FROM aliases WHERE alias = {key}), (SELECT canonical FROM aliases WHERE alias = {compact}), nullif(trim(coalesce({raw}, '')), ''), {quoted(p.default_theme)})"


#: The expected rules, written out: the rule's number first, then what each rule says.
PERSPECTIVES = """SELECT * EXCLUDE (rule, to_hero, linked),
    ['HERO_INNER_SPEECH', 'HERO_DIRECT_SPEECH', 'OTHERS_TO_HERO', 'OTHERS_TO_HERO', 'OTHERS_ABOUT_HERO', 'OTHERS_NEAR_HERO', 'UNKNOWN', 'HERO_INNER_SPEECH', 'OTHERS_TO_HERO', 'OTHERS_TO_HERO', 'OTHERS_ABOUT_HERO', 'OTHERS_NEAR_HERO', 'UNKNOWN',
     'OTHERS_TO_HERO', 'HERO_INNER_SPEECH', 'NARRATOR_ABOUT_HERO', 'NARRATOR_ABOUT_HERO', 'UNKNOWN'][rule] AS perspective,
    CASE rule WHEN 1 THEN 'direct_speech+inner_marker;' || speaker_evidence WHEN 2 THEN 'direct_speech;' || speaker_evidence
        WHEN 3 THEN 'direct_speech;' || speaker_evidence || ';' || addressee_evidence || ';speechact=' || speech_act WHEN 4 THEN 'direct_speech;' || speaker_evidence || ';speechact=PROMPT;hero_link=' || hero_link
        WHEN 5 THEN 'direct_speech;' || speaker_evidence || ';hero_same_sentence' WHEN 6 THEN 'direct_speech;' || speaker_evidence || ';hero_near' WHEN 7 THEN 'direct_speech;' || speaker_evidence || ';no_hero_link'
        WHEN 8 THEN 'direct_or_inner_speech;hero_same_sentence;inner_marker' WHEN 9 THEN 'direct_speech;unknown_speaker;' || addressee_evidence || ';speechact=' || speech_act
        WHEN 10 THEN 'direct_speech;unknown_speaker;speechact=PROMPT;hero_link=' || hero_link WHEN 11 THEN 'direct_speech;unknown_speaker;hero_same_sentence' WHEN 12 THEN 'direct_speech;unknown_speaker;hero_near'
        WHEN 13 THEN 'direct_speech;speaker_not_detected;no_hero_link' WHEN 14 THEN 'reported_speech;' || speaker_evidence || ';' || addressee_evidence || ';speechact=PROMPT'
        WHEN 15 THEN 'inner_speech_marker;hero_link=' || hero_link WHEN 16 THEN 'narrative_context;hero_near+pronoun' WHEN 17 THEN 'narrative_context;hero_link=' || hero_link ELSE 'no_direct_speech;no_hero_link' END AS perspective_evidence,
    CASE WHEN rule IN (1, 2) THEN 'HIGH' WHEN rule IN (3, 14) THEN CASE addressee WHEN 'HERO' THEN 'HIGH' ELSE 'MEDIUM' END WHEN rule = 4 THEN CASE hero_link WHEN 'YES' THEN 'MEDIUM' ELSE 'LOW' END WHEN rule IN (5, 8, 16) THEN 'MEDIUM'
        WHEN rule = 9 THEN CASE addressee WHEN 'HERO' THEN 'MEDIUM' ELSE 'LOW' END WHEN rule IN (15, 17) THEN CASE hero_link WHEN 'YES' THEN 'HIGH' ELSE 'MEDIUM' END ELSE 'LOW' END AS perspective_confidence,
    CASE WHEN rule <= 7 OR rule = 14 THEN speaker_name WHEN rule <= 13 THEN 'UNKNOWN' WHEN rule = 15 THEN 'HERO_PROBABLE' WHEN rule <= 17 THEN 'NARRATOR' ELSE 'UNKNOWN' END AS speaker_detected,
    CASE WHEN rule IN (3, 9, 14) THEN addressee_name WHEN rule IN (4, 10) THEN 'HERO_PROBABLE' ELSE '' END AS addressee_detected,
    CASE WHEN rule IN (3, 4, 5, 6, 9, 10, 11, 12, 14) THEN speech_act ELSE '' END AS others_speech_act
    FROM (SELECT *, CASE
        WHEN is_direct_speech AND speaker = 'HERO' THEN CASE WHEN has_inner_speech THEN 1 ELSE 2 END
        WHEN is_direct_speech AND speaker = 'OTHER' THEN CASE WHEN to_hero THEN 3 WHEN linked AND speech_act = 'PROMPT' THEN 4 WHEN hero_link = 'YES' THEN 5 WHEN hero_link = 'PROBABLE' THEN 6 ELSE 7 END
        WHEN is_direct_speech THEN CASE WHEN hero_link = 'YES' AND has_inner_speech THEN 8 WHEN to_hero THEN 9 WHEN linked AND speech_act = 'PROMPT' THEN 10 WHEN hero_link = 'YES' THEN 11 WHEN hero_link = 'PROBABLE' THEN 12 ELSE 13 END
        WHEN speaker = 'OTHER' AND to_hero AND speech_act = 'PROMPT' THEN 14 WHEN has_inner_speech AND linked THEN 15 WHEN hero_link = 'PROBABLE' AND has_hero_pronoun THEN 16 WHEN linked THEN 17 ELSE 18 END AS rule
        FROM (SELECT *, addressee IN ('HERO', 'HERO_PROBABLE') AS to_hero, hero_link IN ('YES', 'PROBABLE') AS linked FROM linked_sents))"""


#: The bench's rules of speakers and addressees, written out: verbs, names, what ends a word; then what each rule looks for, its evidence and the name.
SAYS, ENDS, BEGINS = r"(?:is|was|are|be|on\s+the)", "(?:$|[^0-9A-Za-z_À-ÿ])", "(?:^|[^0-9A-Za-z_À-ÿ])"
HERO, HERO_DATIVE = ("Orre", "That", "Eriner", "Thon", "With"), ("That", "Orre")
SPEAKERS = [rule for n in HERO for rule in ((rf"{SAYS}\s+(?:{n}){ENDS}", f"speech_verb_after_quote:{n}", n), (rf"{n}\s+{SAYS}", f"speech_verb_after_name:{n}", n))]
ADDRESSEES = [rule for n in HERO_DATIVE for rule in ((rf"{SAYS}.{{0,35}}(?:to\s+)?(?:{n}){ENDS}", f"speech_verb_to_hero:{n}", n), (rf"(?:to\s+)?{n}.{{0,35}}{SAYS}", f"hero_dative_near_speech_verb:{n}", n))]
ADDRESSEES += [rule for n in HERO for rule in ((rf"{n}[,!]?\s+(?:for|as|with){ENDS}", f"vocative_hero_before_prompt:{n}", n), (rf"{BEGINS}(?:for|as|with)[,!]?\s+(?:{n}){ENDS}", f"vocative_hero_after_prompt:{n}", n))]
OTHER_AFTER, OTHER_BEFORE = rf"{SAYS}\s+([A-Z][a-z]+){ENDS}", rf"([A-Z][a-z]+)\s+{SAYS}"


def steps(p: Profile) -> dict[str, str]:
    gap = p.phrase_gap
    (after, e_after), (before, e_before) = (OTHER_AFTER, "speech_verb_other:"), (OTHER_BEFORE, "other_name_before_speech_verb:")
    speakers, addressees = SPEAKERS, ADDRESSEES
    listed = tuple((i, v) for i, v in enumerate(P.LATIN_LISTED))
    evaluates = " OR ".join(has("sent_text", word(e, p)) for e in p.evaluations)
    prompts = has("sent_text", word("|".join(p.prompts), p))
    theme_of = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(norm), {quoted(s)})' for s in subs)} THEN {quoted(t)}" for t, subs in p.themes) + f" ELSE {quoted(p.default_theme)} END"
    extended = " OR ".join(f"contains(lower(coalesce(microtheme, '')), {quoted(s)})" for s in p.extended_when)
    rules = [f"WHEN lower(target_lemma) = {quoted(m)} AND lower(target_surface) = {quoted(s.lower())} THEN {quoted(r)}" for m, s, r in p.builtin_noise]
    for _, lem, surf, regex, reason, enabled in P.LATIN_EXCLUSIONS:
        if enabled.lower() in ("1", "true", "yes") and regex != "(":
            parts = [f"lower(target_lemma) = {quoted(lem.lower())}"] * bool(lem) + [f"lower(target_surface) = {quoted(surf.lower())}"] * bool(surf) + [has("sent_text", regex)] * bool(regex)
            rules.append(f"WHEN {' AND '.join(parts) or 'true'} THEN {quoted(reason or 'EXCLUSION_TABLE')}")
    span = "STRUCT(marker_id VARCHAR, s BIGINT, e BIGINT)[]"
    ranked = "STRUCT(less BIGINT, s BIGINT, marker_id VARCHAR, e BIGINT)[]"
    out = {
        "raw": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "lines": "SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM raw)",
        "placed_lines": "SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_pos FROM lines",
        "headings": f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS heading_id, line_no, char_pos AS char_pos_approx, {heading_kind('line', p)} AS heading_type, {strip('line')} AS heading_text, true AS removed_from_analysis FROM placed_lines WHERE {heading('line', p)}",
        "cleaned": f"SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN {heading('x', p)} THEN '' ELSE x END), chr(10)) AS text FROM raw",
        "split": f"SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, {quoted(p.sentence)}), lambda s: {strip('s')}), lambda s: s <> '') AS ss FROM cleaned",
        "pieces": "SELECT doc_id, unnest(ss) AS sent_text, (generate_subscripts(ss, 1) - 1)::INT AS sent_id FROM split",
        "words": f"SELECT *, regexp_extract_all(sent_text, {quoted(p.token)}) AS tokens FROM pieces",
        "sents": f"""SELECT *, list_transform(tokens, lambda t: {lemma('t', p)}) AS lemmas, len(tokens)::INT AS word_count,
            coalesce(lag(sent_text) OVER w, '') AS prev_sent_text, coalesce(lead(sent_text) OVER w, '') AS next_sent_text,
            string_agg(sent_text, ' ') OVER (PARTITION BY doc_id ORDER BY sent_id ROWS BETWEEN {p.context_window_sentences} PRECEDING AND {p.context_window_sentences} FOLLOWING) AS context_window
            FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY sent_id)""",
        "flags": f"""SELECT *, {strip('sent_text')} <> '' AND {has(strip('sent_text'), p.direct_speech, True)} AS is_direct_speech, {has('sent_text', word(p.inner_speech, p))} AS has_inner_speech,
            {has('sent_text', word('|'.join(p.pronouns), p))} AS has_hero_pronoun, {find_name('sent_text', p)} AS hero_name_variant, {first('sent_text', speakers, 1, 'NULL')} AS hs_e, {first('sent_text', speakers, 2, 'NULL')} AS hs_n,
            {first('sent_text', addressees, 1, 'NULL')} AS ad_e, {first('sent_text', addressees, 2, 'NULL')} AS ad_n, CASE WHEN {evaluates} THEN 'EVALUATE' WHEN {prompts} THEN 'PROMPT' ELSE 'STATEMENT' END AS speech_act,
            regexp_extract(sent_text, {quoted(after)}, 1) AS o_after, regexp_extract(sent_text, {quoted(before)}, 1) AS o_before FROM sents""",
        "others": f"""SELECT *, CASE WHEN hs_e IS NOT NULL THEN NULL WHEN o_after <> '' AND ({find_name('o_after', p)}) = '' THEN o_after WHEN o_before <> '' AND ({find_name('o_before', p)}) = '' THEN o_before END AS o_name,
            CASE WHEN o_after <> '' AND ({find_name('o_after', p)}) = '' THEN {quoted(e_after)} ELSE {quoted(e_before)} END AS o_kind FROM flags""",
        "roles": """SELECT *, CASE WHEN hs_e IS NOT NULL THEN 'HERO' WHEN o_name IS NOT NULL THEN 'OTHER' ELSE 'UNKNOWN' END AS speaker, coalesce(hs_e, o_kind || o_name, 'speaker_not_detected') AS speaker_evidence, coalesce(hs_n, o_name, '') AS speaker_name,
            CASE WHEN ad_e IS NOT NULL THEN 'HERO' WHEN hero_name_variant <> '' THEN 'HERO_PROBABLE' ELSE 'UNKNOWN' END AS addressee,
            coalesce(ad_e, CASE WHEN hero_name_variant <> '' THEN 'hero_name_in_utterance' END, 'addressee_not_detected') AS addressee_evidence, coalesce(ad_n, hero_name_variant) AS addressee_name FROM others""",
        "near": f"""SELECT a.doc_id, a.sent_id, arg_min(b.hero_name_variant, b.sent_id) AS near_name, min(b.sent_id) AS near_id FROM roles a JOIN roles b ON a.doc_id = b.doc_id AND b.sent_id BETWEEN a.sent_id - {p.window_sentences} AND a.sent_id + {p.window_sentences}
            WHERE b.hero_name_variant <> '' GROUP BY ALL""",
        "linked_sents": """SELECT r.*, CASE WHEN hero_name_variant <> '' THEN 'YES' WHEN near_id IS NOT NULL THEN 'PROBABLE' ELSE 'NO' END AS hero_link,
            CASE WHEN hero_name_variant <> '' THEN 'same_sentence:' || hero_name_variant WHEN near_id IS NOT NULL THEN CASE WHEN near_id < r.sent_id THEN 'prev_sentence:' ELSE 'next_sentence:' END || near_name || CASE WHEN has_hero_pronoun THEN '+pronoun' ELSE '' END ELSE '' END AS hero_evidence
            FROM roles r LEFT JOIN near n ON r.doc_id = n.doc_id AND r.sent_id = n.sent_id""",
        "tagged_sents": PERSPECTIVES,
        "themes": values(P.LATIN_THEMES, "canonical, aliases"),
        "aliases": f"SELECT {plain_lower('trim(alias)')} AS alias, any_value(canonical) AS canonical FROM (SELECT canonical, unnest(list_append(string_split(aliases, ';'), canonical)) AS alias FROM themes) WHERE trim(alias) <> '' GROUP BY 1",
        "curated": f"""SELECT id AS marker_id, 'S1' AS marker_source, {theme(p, 'microtheme')} AS microtheme, 'WORD_CORE' AS phrase_family, upper(unit_type) AS unit_type, unit AS unit_raw,
            CASE WHEN upper(unit_type) = 'WORD' THEN {lemma('unit', p)} ELSE trim(unit) END AS unit_norm, 'CORE' AS precision_level, 'curated' AS source_type, '1' AS enabled, '' AS risk_comment, comment FROM ({values(P.LATIN_CURATED, 'id, microtheme, unit, unit_type, comment')})""",
        "listed": f"""SELECT 'ALEX_' || lpad(n::VARCHAR, 3, '0') AS marker_id, 'ALEXANDROVA' AS marker_source, {theme(p, 'theme')} AS microtheme, 'WORD_ALEXANDROVA' AS phrase_family, 'WORD' AS unit_type, unit AS unit_raw, norm AS unit_norm, 'CORE' AS precision_level,
            'dictionary' AS source_type, '1' AS enabled, '' AS risk_comment, 'word list unit' AS comment FROM (SELECT *, {theme_of} AS theme FROM (SELECT *, {lemma('unit', p)} AS norm, row_number() OVER (ORDER BY ord) AS n
            FROM (SELECT ord, trim(value) AS unit FROM ({values(listed, 'ord, value')})) WHERE unit <> '' AND NOT starts_with(unit, '#')))""",
        "phrases": f"""SELECT CASE WHEN regexp_full_match(id, '[0-9]+') THEN 'PHR_' || CASE WHEN length(id) < 3 THEN lpad(id, 3, '0') ELSE id END ELSE id END AS marker_id, 'PHRASE' AS marker_source, {theme(p, 'microtheme')} AS microtheme,
            CASE WHEN phrase_family = '' THEN 'PHRASE_GENERAL' ELSE phrase_family END AS phrase_family, 'PHRASE' AS unit_type, phrase_text AS unit_raw, coalesce(nullif(trim(pattern_lemmas), ''), trim(phrase_text)) AS unit_norm,
            CASE WHEN precision_level = '' THEN 'CORE' ELSE upper(precision_level) END AS precision_level, source_type, enabled, risk_comment, comment
            FROM ({values(P.LATIN_PHRASES, 'id, phrase_text, pattern_lemmas, microtheme, phrase_family, precision_level, source_type, enabled, risk_comment, comment')}) WHERE lower(trim(enabled)) IN ('1', 'true', 'yes', 'да', 'y')""",
        "sourced": "SELECT *, 0 AS prio FROM phrases UNION ALL SELECT *, 1 FROM curated UNION ALL SELECT *, 2 FROM listed",
        "markers": """SELECT * EXCLUDE (prio, k), row_number() OVER (ORDER BY marker_source, precision_level, marker_id) AS marker_ord FROM (SELECT *,
            CASE WHEN marker_source = 'S1' AND unit_type <> 'WORD' THEN unit_raw WHEN marker_source = 'PHRASE' THEN unit_raw ELSE unit_norm END || ' [' || microtheme || ']' AS marker_label,
            row_number() OVER (PARTITION BY unit_type, trim(unit_norm) ORDER BY prio, marker_id) AS k FROM sourced) WHERE k = 1""",
        "tokens": "SELECT doc_id, sent_id, lemmas, unnest(lemmas) AS lemma, generate_subscripts(lemmas, 1) AS pos FROM sents",
        "candidates": f"""SELECT doc_id, sent_id, marker_id, (pos - 1)::BIGINT AS s, (fin - 1)::BIGINT AS e FROM (SELECT *,
            CASE WHEN len(pattern) = 1 THEN pos ELSE list_reduce(pattern[2:], lambda acc, w: acc + list_position(lemmas[acc + 1:acc + {gap + 1}], w), pos) END AS fin
            FROM tokens JOIN (SELECT marker_id, string_split(trim(unit_norm), ' ') AS pattern FROM markers WHERE unit_type = 'PHRASE') ON lemma = pattern[1]) WHERE fin IS NOT NULL""",
        "apart": f"""SELECT doc_id, sent_id, list_reduce(list(f ORDER BY f), lambda kept, x: CASE WHEN coalesce(kept[-1].marker_id = x.marker_id AND x.s <= kept[-1].e, false) THEN kept ELSE list_append(kept, x) END, []::{span}) AS found
            FROM (SELECT doc_id, sent_id, {{'marker_id': marker_id, 's': s, 'e': e}} AS f FROM candidates) GROUP BY ALL""",
        "ranked": "SELECT doc_id, sent_id, list_sort(list_transform(found, lambda x: {'less': x.s - x.e, 's': x.s, 'marker_id': x.marker_id, 'e': x.e})) AS ranked FROM apart",
        "chosen": f"""SELECT *, list_reduce(ranked, lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: k.s <= x.e AND x.s <= k.e)) > 0 THEN kept ELSE list_append(kept, x) END, []::{ranked}) AS chosen FROM ranked""",
        "spans": "SELECT doc_id, sent_id, chosen, unnest(ranked) AS x FROM chosen",
        "kept_spans": "SELECT doc_id, sent_id, x.marker_id AS marker_id, x.s AS s, x.e AS e FROM spans WHERE list_contains(chosen, x)",
        "dropped_spans": "SELECT doc_id, sent_id, x.marker_id AS marker_id, x.s AS s, x.e AS e, array_to_string(list_transform(list_filter(chosen, lambda k: (k.less, k.s, k.marker_id) < (x.less, x.s, x.marker_id) AND k.s <= x.e AND x.s <= k.e), lambda k: k.marker_id), ';') AS nested_overlap_with FROM spans WHERE NOT list_contains(chosen, x)",
        "phrase_hits": """SELECT h.doc_id, h.sent_id, 'PHRASE' AS hit_type, h.marker_id, s AS token_idx, e AS token_end_idx, trim(unit_norm) AS target_lemma, array_to_string(tokens[s + 1:e + 1], ' ') AS target_surface, false AS overlaps_phrase, '' AS phrase_overlap_ids,
            false AS is_noise, '' AS noise_reason, true AS count_in_main_stats, marker_ord FROM kept_spans h JOIN sents USING (doc_id, sent_id) JOIN markers USING (marker_id)""",
        "sentence_spans": "SELECT doc_id, sent_id, list({'s': s, 'e': e, 'm': marker_id} ORDER BY s, marker_id) AS kept FROM kept_spans GROUP BY ALL",
        "word_places": """SELECT t.doc_id, t.sent_id, sent_text, m.marker_id, (t.pos - 1)::BIGINT AS token_idx, t.lemma AS target_lemma, tokens[t.pos] AS target_surface, coalesce(list_filter(kept, lambda k: t.pos - 1 BETWEEN k.s AND k.e), []) AS over, marker_ord
            FROM tokens t JOIN markers m ON m.unit_type = 'WORD' AND m.unit_norm = t.lemma JOIN sents s ON s.doc_id = t.doc_id AND s.sent_id = t.sent_id LEFT JOIN sentence_spans k ON k.doc_id = t.doc_id AND k.sent_id = t.sent_id""",
        "word_hits": f"""SELECT doc_id, sent_id, 'WORD' AS hit_type, marker_id, token_idx, token_idx AS token_end_idx, target_lemma, target_surface, len(over) > 0 AS overlaps_phrase, array_to_string(list_transform(over, lambda k: k.m), ';') AS phrase_overlap_ids,
            reason IS NOT NULL AS is_noise, coalesce(reason, '') AS noise_reason, len(over) = 0 AS count_in_main_stats, marker_ord FROM (SELECT *, CASE {' '.join(rules)} END AS reason FROM word_places)""",
        "hits": "SELECT *, row_number() OVER (ORDER BY doc_id, sent_id, hit_type = 'WORD', token_idx, CASE WHEN hit_type = 'PHRASE' THEN marker_id END, marker_ord) AS hit_id FROM (SELECT * FROM phrase_hits UNION ALL SELECT * FROM word_hits)",
        "nested": f"SELECT doc_id, sent_id, marker_id, s AS token_idx, e AS token_end_idx, nested_overlap_with, row_number() OVER (ORDER BY doc_id, sent_id, s, marker_id) AS candidate_id, {quoted('phrase_overlap_mode=' + p.overlap_mode)} AS drop_reason FROM dropped_spans",
        "parts": values(P.LATIN_PARTS, "part_id, part_name, book_id, book_name, start_sent, end_sent"),
        "books": values(P.LATIN_BOOKS, "book_id, book_name, start_sent, end_sent"),
        "tagged": f"""SELECT h.* EXCLUDE (marker_ord), sent_text, prev_sent_text, next_sent_text, context_window, {', '.join(tagging.TAGS)}, m.marker_label, m.microtheme, m.unit_type, m.marker_source, m.precision_level, m.source_type, m.risk_comment, m.unit_raw, m.unit_norm, m.phrase_family,
            coalesce(b.book_id, -1) AS book_id, coalesce(b.book_name, 'UNKNOWN') AS book, coalesce(q.part_id, -1) AS part_id, coalesce(q.part_name, 'UNKNOWN') AS part FROM hits h JOIN tagged_sents s ON s.doc_id = h.doc_id AND s.sent_id = h.sent_id
            LEFT JOIN markers m ON m.marker_id = h.marker_id LEFT JOIN books b ON h.sent_id BETWEEN b.start_sent AND b.end_sent LEFT JOIN parts q ON h.sent_id BETWEEN q.start_sent AND q.end_sent""",
        "clean": "SELECT * FROM tagged WHERE NOT is_noise AND count_in_main_stats",
        "counted": "SELECT * FROM clean WHERE precision_level IN ('CORE', 'EXTENDED')",
        "wide": "SELECT * FROM counted WHERE hero_link IN ('YES', 'PROBABLE')",
        "strict": "SELECT * FROM counted WHERE hero_link = 'YES'",
        "totals": "SELECT count(*) AS ns, sum(word_count) AS nw FROM sents",
    }

    return out


STEPS = steps(bench_profile())


def sql(select: str) -> str:
    """The select with the steps that it needs before it."""
    import re

    need: dict[str, None] = {}

    def visit(text: str) -> None:
        for name in STEPS:
            if name not in need and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                need[name] = None
                visit(STEPS[name])

    visit(select)
    chain = [n for n in STEPS if n in need]
    return (("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({STEPS[n]})" for n in chain) + "\n") if chain else "") + select
