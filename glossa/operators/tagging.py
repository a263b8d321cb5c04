"""Sentences and hits to links with the hero, speakers, addressees, perspectives and segments.

All but the speech act depend on the sentence alone and are computed once for each sentence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators.joins import in_intervals
from glossa.operators.morphology import IMPERATIVE, has_tag
from glossa.plans.profile import Profile

PERSPECTIVES = ("HERO_INNER_SPEECH", "HERO_DIRECT_SPEECH", "NARRATOR_ABOUT_HERO", "OTHERS_TO_HERO", "OTHERS_ABOUT_HERO", "OTHERS_NEAR_HERO", "UNKNOWN")
OTHERS = ("OTHERS_TO_HERO", "OTHERS_ABOUT_HERO", "OTHERS_NEAR_HERO")
LABELS_RU = {
    "HERO_INNER_SPEECH": "герой: внутренняя речь", "HERO_DIRECT_SPEECH": "герой: прямая речь", "NARRATOR_ABOUT_HERO": "повествователь о герое", "OTHERS_TO_HERO": "другие обращаются к герою",
    "OTHERS_ABOUT_HERO": "другие говорят о герое", "OTHERS_NEAR_HERO": "другие рядом с героем", "UNKNOWN": "неопределено",
}
#: Labels in tables; the plots' ones above are shorter.
TAG_LABELS_RU = LABELS_RU | {
    "OTHERS_TO_HERO": "другие персонажи обращаются к герою", "OTHERS_ABOUT_HERO": "другие персонажи говорят о герое", "OTHERS_NEAR_HERO": "другие персонажи в контексте рядом с героем",
}
ACT_LABELS_RU = {"PROMPT": "побуждение (совет/призыв думать)", "EVALUATE": "оценка (критика/похвала способности думать)", "STATEMENT": "констатация", "UNKNOWN": "неопределено"}


def verbs(p: Profile) -> str:
    return "(?:" + "|".join(p.verbs) + ")"


def speaker_rules(p: Profile) -> list[tuple[str, str, str]]:
    """(pattern, role's evidence, name) in order, ignoring case; the hero is who is named."""
    out = []
    for v in p.names:
        n = T.escape(v)
        out.append((verbs(p) + r"\s+" + T.ends_word(n, p.letters), f"speech_verb_after_quote:{v}", v))
        out.append((n + r"\s+" + verbs(p), f"speech_verb_after_name:{v}", v))
    return out


def other_speaker_patterns(p: Profile) -> tuple[tuple[str, str], tuple[str, str]]:
    """Case-sensitive patterns with the name as group 1, and their evidence."""
    return (verbs(p) + r"\s+(" + p.capitalised + f")(?:$|[^{p.letters}])", "speech_verb_other:"), (f"({p.capitalised})" + r"\s+" + verbs(p), "other_name_before_speech_verb:")


def addressee_rules(p: Profile) -> list[tuple[str, str, str]]:
    toward = f"(?:{p.toward})?"
    out = []
    for v in p.dative:
        n = T.escape(v)
        out.append((verbs(p) + ".{0,35}" + toward + T.ends_word(n, p.letters), f"speech_verb_to_hero:{v}", v))
        out.append((toward + n + ".{0,35}" + verbs(p), f"hero_dative_near_speech_verb:{v}", v))
    prompts = prompting(p)
    for v in p.names:
        n = T.escape(v)
        out.append((n + r"[,!]?\s+" + T.ends_word(prompts, p.letters), f"vocative_hero_before_prompt:{v}", v))
        out.append((f"(?:^|[^{p.letters}])" + prompts + r"[,!]?\s+" + T.ends_word(n, p.letters), f"vocative_hero_after_prompt:{v}", v))
    return out


def prompting(p: Profile) -> str:
    return "(?:" + "|".join(p.prompts) + ")"


def _opening(pattern: str, p: Profile) -> str:
    """T.opening() of a rule's pattern, which may begin with a group."""
    toward = f"(?:{p.toward})?"
    if pattern.startswith(verbs(p)):
        return T.opening("|".join(p.verbs))
    if p.toward and pattern.startswith(toward):
        return T.opening(p.toward + "|" + pattern.removeprefix(toward))
    return T.opening(pattern)


def _first(text: Column, rules: list[tuple[str, str, str]], p: Profile, given: dict[str, Column]) -> Column:
    """struct(evidence, name) of the first rule met, or null. given: parts of patterns and whether they are found at all; a rule is only tried where its parts are."""

    def met(pattern: str) -> Column:
        first, bound = _opening(pattern, p), f"(?:^|[^{p.letters}])"
        if pattern.startswith(bound + prompting(p)):  # looks back rather than tries every place's left side
            first, own = T.opening("|".join(p.prompts)), f"(?<![{p.letters}])" + pattern.removeprefix(bound)
        else:
            own = pattern
        return reduce(lambda a, b: a & b, [*[found for part, found in given.items() if part in pattern], T.matches(text, own, first=first)])

    return F.coalesce(*[F.when(met(pattern), F.struct(F.lit(e).alias("evidence"), F.lit(n).alias("name"))) for pattern, e, n in rules])


def _has_word(text: Column, pattern: str, p: Profile) -> Column:
    return T.matches(text, T.word(pattern, p.letters), first=T.opening(pattern))


def speech_act(text: Column, p: Profile, imperative: Column | None = None) -> Column:
    """PROMPT for an imperative hit (a morphology's answer, none by default), EVALUATE, PROMPT by words, else STATEMENT."""
    evaluates = reduce(lambda a, b: a | b, [_has_word(text, e, p) for e in p.evaluations], F.lit(False))
    chain = F.when(evaluates, "EVALUATE").when(_has_word(text, "|".join(p.prompts), p), "PROMPT").otherwise("STATEMENT")
    return chain if imperative is None else F.when(imperative, "PROMPT").otherwise(chain)


def _named_at_all(text: Column, p: Profile) -> Column:
    """One look for any name saves most sentences the look for each."""
    return T.matches(text, "|".join(map(T.escape, T.unique_stems([*p.names, *p.dative]))))


def names_beside(docs: DataFrame, p: Profile) -> DataFrame:
    """docs (doc_id, all_sents) with an array of each sentence's hero_name_variant, and `_near`: the earliest naming sentence in its reach, null without one. Each looks at the window's sentences alone."""
    w = p.window_sentences
    rows = docs.withColumn("hero_name_variant", F.transform("all_sents", lambda s: F.when(_named_at_all(s, p), T.find_name(s, p)).otherwise("")))
    rows = rows.withColumn("_marks", F.transform("hero_name_variant", lambda n, i: F.when(n != "", F.struct(i.alias("sent_id"), n.alias("hero_name_variant")))))
    near = F.transform("_marks", lambda _, i: F.get(F.array_compact(F.slice("_marks", F.greatest(i - w, F.lit(0)) + 1, F.least(i, F.lit(w)) + w + 1)), F.lit(0)))
    return rows.withColumn("_near", near).drop("_marks")


def with_flags(sents: DataFrame, p: Profile) -> DataFrame:
    """Sentence flags, hero name (where it isn't there), speaker and addressee."""
    text = F.col("sent_text")
    trimmed = T.strip("sent_text")
    known = "hero_name_variant" in sents.columns
    # One look for any verb and, where there is a name, for any prompt, likewise.
    sents = sents.withColumn("_named", _named_at_all(text, p)).withColumn("_said", T.matches(text, verbs(p), first=T.opening("|".join(p.verbs))))
    sents = sents.withColumn("_asked", F.col("_named") & T.matches(text, prompting(p), first=T.opening("|".join(p.prompts))))
    given = {verbs(p): F.col("_said"), prompting(p): F.col("_asked")}
    df = sents.withColumns(
        {
            "is_direct_speech": (trimmed != "") & T.matches(trimmed, p.direct_speech, ignore_case=False),
            "has_inner_speech": _has_word(text, p.inner_speech, p) if p.inner_speech else F.lit(False),
            "has_hero_pronoun": _has_word(text, "|".join(p.pronouns), p),
            "hero_name_variant": F.col("hero_name_variant") if known else F.when(F.col("_named"), T.find_name(text, p)).otherwise(""),
            "_hero_speaks": F.when(F.col("_named") & F.col("_said"), _first(text, speaker_rules(p), p, given)),
            "_addressed": F.when(F.col("_named"), _first(text, addressee_rules(p), p, given)),
            "speech_act": speech_act(text, p),
        }
    )
    (after, e_after), (before, e_before) = other_speaker_patterns(p)
    found = lambda pattern: F.when(F.col("_said"), F.regexp_extract(text, _opening(pattern, p) + "(?d)" + pattern, 1)).otherwise("")
    df = df.withColumn("_after", found(after)).withColumn("_before", found(before))
    other = F.when((F.col("_after") != "") & (T.find_name("_after", p) == ""), F.struct(F.concat(F.lit(e_after), "_after").alias("evidence"), F.col("_after").alias("name"))).when(
        (F.col("_before") != "") & (T.find_name("_before", p) == ""), F.struct(F.concat(F.lit(e_before), "_before").alias("evidence"), F.col("_before").alias("name"))
    )
    df = df.withColumn("_other", F.when(F.col("_hero_speaks").isNull(), other))
    named = F.col("hero_name_variant") != ""
    return df.withColumns(
        {
            "speaker": F.when(F.col("_hero_speaks").isNotNull(), "HERO").when(F.col("_other").isNotNull(), "OTHER").otherwise("UNKNOWN"),
            "speaker_evidence": F.coalesce("_hero_speaks.evidence", "_other.evidence", F.lit("speaker_not_detected")),
            "speaker_name": F.coalesce("_hero_speaks.name", "_other.name", F.lit("")),
            "addressee": F.when(F.col("_addressed").isNotNull(), "HERO").when(named, "HERO_PROBABLE").otherwise("UNKNOWN"),
            "addressee_evidence": F.coalesce("_addressed.evidence", F.when(named, "hero_name_in_utterance"), F.lit("addressee_not_detected")),
            "addressee_name": F.coalesce("_addressed.name", "hero_name_variant"),
        }
    ).drop("_hero_speaks", "_addressed", "_after", "_before", "_other", "_named", "_said", "_asked")


def with_links(sents: DataFrame, p: Profile) -> DataFrame:
    """hero_link YES (named here), PROBABLE (named within the window), NO, and its evidence: the earliest naming sentence in reach, which names_beside() has found or a window does."""
    w = Window.partitionBy("doc_id").orderBy("sent_id").rowsBetween(-p.window_sentences, p.window_sentences)
    near = F.first(F.when(F.col("hero_name_variant") != "", F.struct("sent_id", "hero_name_variant")), ignorenulls=True).over(w)
    df = sents if "_near" in sents.columns else sents.withColumn("_near", near)
    named = F.col("hero_name_variant") != ""
    where = F.when(F.col("_near.sent_id") < F.col("sent_id"), "prev_sentence").otherwise("next_sentence")
    pronoun = F.when(F.col("has_hero_pronoun"), "+pronoun").otherwise("")
    evidence = F.when(named, F.concat(F.lit("same_sentence:"), "hero_name_variant")).when(F.col("_near").isNotNull(), F.concat(where, F.lit(":"), "_near.hero_name_variant", pronoun)).otherwise("")
    link = F.when(named, "YES").when(F.col("_near").isNotNull(), "PROBABLE").otherwise("NO")
    return df.withColumns({"hero_link": link, "hero_evidence": evidence}).drop("_near")


def perspective_rules() -> list[tuple[str, str, str, str, str, str]]:
    """(condition, label, evidence, confidence, speaker, addressee) in order, as SQL expressions over the sentence's columns.

    Both engines can read them: only CASE, AND, OR, IN, = and || are used.
    """
    direct, inner, prompt = "is_direct_speech", "has_inner_speech", "speech_act = 'PROMPT'"
    hero, other = "speaker = 'HERO'", "speaker = 'OTHER'"
    to_hero, linked = "addressee IN ('HERO', 'HERO_PROBABLE')", "hero_link IN ('YES', 'PROBABLE')"
    yes, near = "hero_link = 'YES'", "hero_link = 'PROBABLE'"
    sure = lambda a, b: f"CASE WHEN addressee = 'HERO' THEN '{a}' ELSE '{b}' END"
    linked_sure = lambda a, b: f"CASE WHEN hero_link = 'YES' THEN '{a}' ELSE '{b}' END"
    whole = "'direct_speech;' || speaker_evidence"
    act = "';speechact=' || speech_act"
    return [
        (f"{direct} AND {hero} AND {inner}", "HERO_INNER_SPEECH", "'direct_speech+inner_marker;' || speaker_evidence", "'HIGH'", "speaker_name", "''"),
        (f"{direct} AND {hero}", "HERO_DIRECT_SPEECH", whole, "'HIGH'", "speaker_name", "''"),
        (f"{direct} AND {other} AND {to_hero}", "OTHERS_TO_HERO", f"{whole} || ';' || addressee_evidence || {act}", sure("HIGH", "MEDIUM"), "speaker_name", "addressee_name"),
        (f"{direct} AND {other} AND {linked} AND {prompt}", "OTHERS_TO_HERO", f"{whole} || ';speechact=PROMPT;hero_link=' || hero_link", linked_sure("MEDIUM", "LOW"), "speaker_name", "'HERO_PROBABLE'"),
        (f"{direct} AND {other} AND {yes}", "OTHERS_ABOUT_HERO", f"{whole} || ';hero_same_sentence'", "'MEDIUM'", "speaker_name", "''"),
        (f"{direct} AND {other} AND {near}", "OTHERS_NEAR_HERO", f"{whole} || ';hero_near'", "'LOW'", "speaker_name", "''"),
        (f"{direct} AND {other}", "UNKNOWN", f"{whole} || ';no_hero_link'", "'LOW'", "speaker_name", "''"),
        (f"{direct} AND {yes} AND {inner}", "HERO_INNER_SPEECH", "'direct_or_inner_speech;hero_same_sentence;inner_marker'", "'MEDIUM'", "'UNKNOWN'", "''"),
        (f"{direct} AND {to_hero}", "OTHERS_TO_HERO", f"'direct_speech;unknown_speaker;' || addressee_evidence || {act}", sure("MEDIUM", "LOW"), "'UNKNOWN'", "addressee_name"),
        (f"{direct} AND {linked} AND {prompt}", "OTHERS_TO_HERO", "'direct_speech;unknown_speaker;speechact=PROMPT;hero_link=' || hero_link", "'LOW'", "'UNKNOWN'", "'HERO_PROBABLE'"),
        (f"{direct} AND {yes}", "OTHERS_ABOUT_HERO", "'direct_speech;unknown_speaker;hero_same_sentence'", "'LOW'", "'UNKNOWN'", "''"),
        (f"{direct} AND {near}", "OTHERS_NEAR_HERO", "'direct_speech;unknown_speaker;hero_near'", "'LOW'", "'UNKNOWN'", "''"),
        (direct, "UNKNOWN", "'direct_speech;speaker_not_detected;no_hero_link'", "'LOW'", "'UNKNOWN'", "''"),
        (f"{other} AND {to_hero} AND {prompt}", "OTHERS_TO_HERO", "'reported_speech;' || speaker_evidence || ';' || addressee_evidence || ';speechact=PROMPT'", sure("HIGH", "MEDIUM"), "speaker_name", "addressee_name"),
        (f"{inner} AND {linked}", "HERO_INNER_SPEECH", "'inner_speech_marker;hero_link=' || hero_link", linked_sure("HIGH", "MEDIUM"), "'HERO_PROBABLE'", "''"),
        (f"{near} AND has_hero_pronoun", "NARRATOR_ABOUT_HERO", "'narrative_context;hero_near+pronoun'", "'MEDIUM'", "'NARRATOR'", "''"),
        (linked, "NARRATOR_ABOUT_HERO", "'narrative_context;hero_link=' || hero_link", linked_sure("HIGH", "MEDIUM"), "'NARRATOR'", "''"),
    ]


def perspective_sql(act: str = "speech_act") -> dict[str, str]:
    """Column name to CASE expression; act: the speech act, as an expression."""
    rules = [tuple(x.replace("speech_act", act) for x in r) for r in perspective_rules()]
    case = lambda i, last, quote=False: "CASE " + " ".join(f"WHEN {r[0]} THEN " + (f"'{r[i]}'" if quote else r[i]) for r in rules) + f" ELSE {last} END"
    others = ", ".join(f"'{x}'" for x in OTHERS)
    label = case(1, "'UNKNOWN'", True)
    return {
        "perspective": label, "perspective_evidence": case(2, "'no_direct_speech;no_hero_link'"), "perspective_confidence": case(3, "'LOW'"), "speaker_detected": case(4, "'UNKNOWN'"), "addressee_detected": case(5, "''"),
        "others_speech_act": f"CASE WHEN ({label}) IN ({others}) THEN speech_act ELSE '' END".replace("THEN speech_act", f"THEN {act}"),
    }


def tagged_sentences(sents: DataFrame, p: Profile) -> DataFrame:
    """sents with links and perspectives; the columns they are derived from go. Where sents has the tokens' `tags`, `prompted` is what the perspective's columns are of a hit that is an imperative."""
    full = with_links(with_flags(sents, p), p)
    tagged = full.withColumns({k: F.expr(v) for k, v in perspective_sql().items()})
    if "tags" not in sents.columns:
        return tagged
    return tagged.withColumn("prompted", F.struct(*[F.expr(v).alias(k) for k, v in perspective_sql("'PROMPT'").items()]))


def is_imperative(first: str, last: str, tags: str = "tags", tag: str = IMPERATIVE) -> Column:
    """Whether any parse of a hit's token is an imperative; a hit of several tokens never is. first, last: its places."""
    own = F.col(first) == F.col(last)
    return F.coalesce(own & has_tag(F.array(F.try_element_at(tags, (F.col(first) + 1).cast("int"))), tag), F.lit(False))


def with_prompts(hits: DataFrame) -> DataFrame:
    """hits that carry their sentence's TAGS; hits that are imperatives (`imperative`, which goes) have the perspective's columns of `prompted`."""
    if "imperative" not in hits.columns:
        return hits
    return hits.withColumns({c: F.when(F.col("imperative"), F.col(f"prompted.{c}")).otherwise(F.col(c)) for c in perspective_sql()}).drop("imperative", "prompted")


TAGS = ["hero_link", "hero_evidence", "perspective", "perspective_evidence", "perspective_confidence", "speaker_detected", "addressee_detected", "others_speech_act"]


def with_labels(hits: DataFrame) -> DataFrame:
    """hits with perspective_label and speech_act_label; values without a label stay as they are."""

    def label(column: str, labels: dict[str, str]) -> Column:
        return F.coalesce(F.create_map(*[F.lit(x) for k, v in labels.items() for x in (k, v)])[F.col(column)], F.col(column))

    return hits.withColumns({"perspective_label": label("perspective", TAG_LABELS_RU), "speech_act_label": label("others_speech_act", ACT_LABELS_RU)})


def assign_segments(hits: DataFrame, segments: DataFrame | None, kind: str) -> DataFrame:
    """hits with <kind>_id and <kind>, the segment whose closed interval holds sent_id, else -1 and UNKNOWN.

    Column names of the other kind are taken where a table has no own ones. Segments don't overlap. Segments with a
    doc_id hold sentences of their document alone and are joined by it; those without, a table of one project's
    intervals, hold those of every document.
    """
    if segments is None:
        return hits.withColumns({f"{kind}_id": F.lit(-1), kind: F.lit("UNKNOWN")})
    twin = {"book": "part", "part": "book"}[kind]
    pick = lambda *names: next(c for c in names if c in segments.columns)
    s = segments.select(
        F.col(pick(f"{kind}_id", f"{twin}_id")).cast("int").alias(f"{kind}_id"), F.col(pick(f"{kind}_name", kind, f"{twin}_name")).cast("string").alias(kind), F.col("start_sent").cast("int").alias("_from"), F.col("end_sent").cast("int").alias("_to"),
        *(["doc_id"] if "doc_id" in segments.columns else []),
    )
    joined = in_intervals(hits, "sent_id", s, "_from", "_to", "doc_id" if "doc_id" in s.columns else None)
    return joined.withColumns({f"{kind}_id": F.coalesce(f"{kind}_id", F.lit(-1)), kind: F.coalesce(kind, F.lit("UNKNOWN"))})


def merge_meta(hits: DataFrame, markers: DataFrame) -> DataFrame:
    """hits with the markers' columns in place of their own of these names."""
    meta = [c for c in ("marker_label", "microtheme", "unit_type", "marker_source", "precision_level", "source_type", "risk_comment", "unit_raw", "unit_norm", "phrase_family") if c in markers.columns]
    return hits.drop(*meta).join(markers.select("marker_id", *meta), "marker_id", "left")
