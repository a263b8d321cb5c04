"""Scopes of hits and the tables counted over them. Every order is total: ties go by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators.tagging import OTHERS
from glossa.plans.profile import Profile

RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}
MARKER_KEYS = ["marker_id", "marker_label", "unit_type", "microtheme", "phrase_family", "marker_source", "precision_level"]


# ------------------------------------------------------------------ scopes


def level(name: str) -> Column:
    return F.upper(F.coalesce("precision_level", F.lit(""))) == name


def reflag_overlaps(hits: DataFrame, p: Profile) -> DataFrame:
    """Words inside phrases don't count in main tables, unless they are to."""
    if p.count_overlapping_word_hits:
        return hits
    inside = (F.col("hit_type") == "WORD") & F.coalesce("overlaps_phrase", F.lit(False))
    return hits.withColumn("count_in_main_stats", F.when(inside, F.lit(False)).otherwise(F.col("count_in_main_stats")))


def clean(hits: DataFrame) -> DataFrame:
    """Neither noise nor taken out of main tables; nulls count as neither. No filter by level or confidence."""
    return hits.where(is_clean())


def is_clean() -> Column:
    return ~F.coalesce("is_noise", F.lit(False)) & F.coalesce("count_in_main_stats", F.lit(True))


def is_counted(p: Profile) -> Column:
    """Whether a hit counts in main tables."""
    noise = F.lit(False) if p.include_noise_in_counts else F.coalesce("is_noise", F.lit(False))
    kept = ~noise & F.coalesce("count_in_main_stats", F.lit(True))
    if p.enabled_precision_levels:
        kept = kept & F.coalesce(F.upper("precision_level").isin(*p.enabled_precision_levels), F.lit(False))
    if not p.experimental_phrases_in_main_stats:
        kept = kept & (F.upper(F.coalesce("precision_level", F.lit("CORE"))) != "EXPERIMENTAL")
    least = RANK.get(p.min_perspective_confidence_main.upper(), 1)
    if least <= 1:  # every confidence is enough; a filter would be pushed below the sentences' tags and find them again
        return kept
    confidence = F.upper(F.coalesce("perspective_confidence", F.lit("")))
    rank = F.when(confidence == "HIGH", 3).when(confidence == "MEDIUM", 2).otherwise(1)
    return kept & (rank >= least)


def counted(hits: DataFrame, p: Profile) -> DataFrame:
    return hits.where(is_counted(p))


def linked(hits: DataFrame, mode: str) -> DataFrame:
    """STRICT: named in the sentence; else named in reach."""
    return hits.where(F.col("hero_link").isin(*(["YES"] if (mode or "WIDE").upper() == "STRICT" else ["YES", "PROBABLE"])))


# ------------------------------------------------------------------ counts


def group_count(df: DataFrame, key: str) -> DataFrame:
    """(key, count, share_pct of all rows); null is a group."""
    n = df.groupBy(key).agg(F.count("*").alias("count"))
    return n.withColumn("share_pct", T.share(F.col("count"), F.sum("count").over(Window.partitionBy())))


def totals(sents: DataFrame) -> DataFrame:
    return sents.agg(F.count("*").alias("sentences_total"), F.coalesce(F.sum("word_count"), F.lit(0)).cast("long").alias("words_total"))


def rate(n: Column, whole: Column, times: int) -> Column:
    return F.coalesce(T.half_even(n / F.nullif(whole, F.lit(0)) * times, 3), F.lit(0.0))


def by_marker(df: DataFrame, sents: DataFrame) -> DataFrame:
    """Counts by marker with shares and rates over the whole corpus."""
    n = df.groupBy(*MARKER_KEYS).agg(F.count("*").alias("count")).withColumn("share_pct", T.share(F.col("count"), F.sum("count").over(Window.partitionBy())))
    both = n.join(F.broadcast(totals(sents)), F.lit(True))  # one row
    return both.select("marker_id", "count", "share_pct", rate(F.col("count"), F.col("sentences_total"), 1000).alias("per_1000_sentences"), rate(F.col("count"), F.col("words_total"), 10000).alias("per_10000_words"), *MARKER_KEYS[1:])


def coverage(markers: DataFrame, tagged: DataFrame) -> DataFrame:
    """Every marker with its counts in all, strict and wide scope. tagged: counted hits."""
    n = tagged.groupBy("marker_id").agg(F.count("*").alias("count_all"), F.count_if(F.col("hero_link") == "YES").alias("count_strict"), F.count_if(F.col("hero_link").isin("YES", "PROBABLE")).alias("count_wide"))
    cols = ["marker_id", "marker_source", "microtheme", "phrase_family", "unit_type", "unit_raw", "unit_norm", "marker_label", "precision_level", "source_type", "risk_comment"]
    out = markers.select(*cols).join(n, "marker_id", "left").fillna(0, ["count_all", "count_strict", "count_wide"])
    return out.withColumns({"appears_in_corpus": F.col("count_all") > 0, "appears_in_strict_hero": F.col("count_strict") > 0})


def segment_rates(hits: DataFrame, sents: DataFrame, segments: DataFrame, kind: str) -> DataFrame:
    """Each segment's sentences, words, hits and rates; segments without any stay. Both sides are summed by place before they meet. Segments with a doc_id are joined by it and keep it."""
    doc = ["doc_id"] if "doc_id" in segments.columns else []
    key = [*doc, "_id"]
    seg = segments.select(*doc, F.col(f"{kind}_id").alias("_id"), F.col(f"{kind}_name").alias(kind), "start_sent", "end_sent")
    # Segments of one project are a small table; those built for each document grow with the corpus and meet by doc_id.
    other = seg.withColumnRenamed("doc_id", "_doc") if doc else F.broadcast(seg)
    within = F.col("sent_id").between(F.col("start_sent"), F.col("end_sent"))
    meets = within & (F.col("doc_id") == F.col("_doc")) if doc else within
    s = sents.groupBy(*doc, "sent_id").agg(F.count("*").alias("n"), F.sum("word_count").alias("w")).join(other, meets).groupBy(*key).agg(F.sum("n").alias("sentences"), F.sum("w").alias("words"))
    h = hits.groupBy(*doc, "sent_id").agg(F.count("*").alias("n")).join(other, meets).groupBy(*key).agg(F.sum("n").alias("hits"))
    out = seg.join(s, key, "left").join(h, key, "left").fillna(0, ["sentences", "words", "hits"])
    return out.select(*doc, kind, "start_sent", "end_sent", "sentences", "words", "hits", rate(F.col("hits"), F.col("sentences"), 1000).alias("hits_per_1000_sentences"), rate(F.col("hits"), F.col("words"), 10000).alias("hits_per_10000_words"))


#: Most columns of a pivoted table.
PIVOT_COLUMNS = 10_000


def pivot_matrix(df: DataFrame, index: str, column: str, values: list[str] | None = None) -> DataFrame:
    """Counts with a column for each value, in order, 0 where there is none. Without `values` they are read from the data first: as many as a table can have columns, else it raises."""
    if values is None:
        found = [r[0] for r in df.select(column).distinct().limit(PIVOT_COLUMNS + 1).collect()]
        if len(found) > PIVOT_COLUMNS:
            raise ValueError(f"{column} has over {PIVOT_COLUMNS} values; name those that are wanted")
        values = sorted(found)
    out = df.groupBy(index).pivot(column, values).agg(F.count(F.lit(1)))
    return out.fillna(0, [c for c in out.columns if c != index])


def part_indicator(df: DataFrame, perspectives: list[str], name: str) -> DataFrame:
    n = df.groupBy("part").agg(F.count("*").alias("all_hits"), F.count_if(F.col("perspective").isin(*perspectives)).alias(name))
    return n.withColumn("share_pct", T.share(F.col(name), F.col("all_hits")))


def hero_vs_corpus(hits: DataFrame) -> DataFrame:
    """Microtheme shares within three scopes of counted hits, in one pass: each hit goes to the scopes that hold it."""
    scopes = F.array_compact(F.array(F.lit("CORPUS_COUNTED"), F.when(F.col("hero_link") == "YES", F.lit("HERO_STRICT")), F.when(F.col("hero_link").isin("YES", "PROBABLE"), F.lit("HERO_WIDE"))))
    n = hits.select("microtheme", F.explode(scopes).alias("scope")).groupBy("scope", "microtheme").agg(F.count("*").alias("count"))
    return n.withColumn("share_pct", T.share(F.col("count"), F.sum("count").over(Window.partitionBy("scope"))))


def analytical_indices(hits: DataFrame, rates: DataFrame) -> DataFrame:
    """Ratios by part; 0 where there is nothing to relate to. Rates of several documents' parts of one name are taken together."""
    if "doc_id" in rates.columns:
        rates = rates.groupBy("part").agg(F.sum("hits").alias("hits"), F.sum("words").alias("words")).withColumn("hits_per_10000_words", rate(F.col("hits"), F.col("words"), 10000))
    n = hits.groupBy("part").agg(
        F.count("*").alias("all_hits"), F.count_if(F.col("perspective") == "HERO_INNER_SPEECH").alias("inner_speech_hits"), F.count_if(F.col("perspective").isin(*OTHERS)).alias("external_pressure_hits"),
        F.count_if(level("CORE")).alias("core_hits"), F.count_if(level("EXTENDED")).alias("extended_hits"),
    )
    n = n.withColumns(
        {
            "inner_speech_index_pct": T.share(F.col("inner_speech_hits"), F.col("all_hits")),
            "external_pressure_index_pct": T.share(F.col("external_pressure_hits"), F.col("all_hits")),
            "extended_cognition_index_pct": T.share(F.col("extended_hits"), F.col("core_hits") + F.col("extended_hits")),
        }
    )
    return n.join(rates.select("part", F.col("hits_per_10000_words").alias("cognitive_density_per_10000_words")), "part", "left")


def cognitive_profile(hits: DataFrame) -> DataFrame:
    n = hits.groupBy("microtheme").agg(
        F.count("*").alias("count"), F.count_if(level("CORE")).alias("core_hits"), F.count_if(level("EXTENDED")).alias("extended_hits"), F.count_if(F.col("perspective") == "HERO_INNER_SPEECH").alias("inner_speech_hits"),
        F.count_if(F.col("perspective") == "NARRATOR_ABOUT_HERO").alias("narrator_hits"), F.count_if(F.col("perspective").isin(*OTHERS)).alias("external_hits"),
    )
    return n.withColumn("share_pct", T.share(F.col("count"), F.sum("count").over(Window.partitionBy())))


def top_markers(hits: DataFrame, n: int) -> DataFrame:
    """(marker_id, count) of the n most frequent markers."""
    return hits.groupBy("marker_id").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "marker_id").limit(n)


def dynamics(hits: DataFrame, segment: str, n: int) -> DataFrame:
    """Counts of the n top markers by segment. Hits are counted once; the top ones are those of the counts' sums, and their n ids are broadcast. The join is null-safe, and no semi-join, which would go below the counts, so that no keys are filtered at the scan and Spark reads the counts' one shuffle again."""
    counts = hits.groupBy(segment, "marker_id", "marker_label").agg(F.count("*").alias("count"))
    top = F.broadcast(top_of(counts, n).withColumnRenamed("marker_id", "_top"))
    return counts.join(top, F.col("marker_id").eqNullSafe(F.col("_top"))).select(segment, "marker_id", "marker_label", "count")


def top_of(counts: DataFrame, n: int, key: str = "marker_id") -> DataFrame:
    """The n keys of the largest sums of counts."""
    return counts.groupBy(key).agg(F.sum("count").alias("_m")).orderBy(F.desc("_m"), key).limit(n).select(key)


def noise_report(hits: DataFrame) -> DataFrame:
    return hits.where("is_noise").groupBy("noise_reason", "target_surface", "target_lemma").agg(F.count("*").alias("count"))


def overlap_report(hits: DataFrame) -> DataFrame:
    return hits.where("hit_type = 'WORD' AND overlaps_phrase").groupBy("target_lemma", "target_surface", "phrase_overlap_ids").agg(F.count("*").alias("count"))


def strict_vs_wide(hits: DataFrame, mode: str) -> DataFrame:
    n = hits.agg(F.count_if(F.col("hero_link") == "YES").alias("s"), F.count_if(F.col("hero_link").isin("YES", "PROBABLE")).alias("w"))
    used = "s" if mode.upper() == "STRICT" else "w"
    return n.selectExpr(f"stack(3, 'STRICT', 'hero_link = YES', s, 'WIDE', 'hero_link = YES + PROBABLE', w, 'CONFIG_USED', '{mode.upper()}', {used}) AS (mode, definition, count)")


def overview(raw: DataFrame, markers: DataFrame, sents: DataFrame, p: Profile) -> DataFrame:
    """(metric, value as text): one aggregation of hits, markers and sentences each, then unpivoted."""
    flagged = reflag_overlaps(raw, p)
    main = is_counted(p)
    yes, wide = F.col("hero_link") == "YES", F.col("hero_link").isin("YES", "PROBABLE")
    # Counted by marker first, then over the markers: one pass over the hits.
    each = flagged.groupBy("marker_id").agg(
        F.count("*").alias("raw"), F.count_if(F.col("is_noise")).alias("noise"), F.count_if((F.col("hit_type") == "WORD") & F.col("overlaps_phrase") & ~F.col("count_in_main_stats")).alias("inside"),
        F.count_if(main).alias("main"), F.count_if(main & wide).alias("wide"), F.count_if(main & yes).alias("strict"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    a = each.agg(
        total("raw").alias("hits_total_raw"), total("noise").alias("noise_hits_excluded"), total("inside").alias("overlapping_word_hits_excluded"), total("main").alias("hits_total_counted"), total("wide").alias("hits_linked_wide"),
        total("strict").alias("hits_linked_strict"), F.count_if(F.col("main") > 0).alias("unique_markers_in_corpus_counted"), F.count_if(F.col("strict") > 0).alias("unique_markers_strict_hero"), F.count_if(F.col("wide") > 0).alias("unique_markers_wide_hero"),
    )
    c = markers.agg(
        F.count("*").alias("unique_markers_in_registry"), F.count_if(F.col("unit_type") == "PHRASE").alias("phrase_markers_in_registry"),
        *[F.count_if(level(x)).alias(f"{x.lower()}_markers_in_registry") for x in ("CORE", "EXTENDED", "EXPERIMENTAL")],
    )
    row = totals(sents).join(a, F.lit(True)).join(c, F.lit(True))
    cells = ", ".join(f"'{x}', CAST({x} AS STRING)" for x in row.columns)
    return row.selectExpr(f"stack({len(row.columns) + 2}, {cells}, 'link_mode_used', '{p.link_mode.upper()}', 'manual_verification_file', 'MANUAL_VERIFICATION') AS (metric, value)")


def profile_settings(spark, p: Profile) -> DataFrame:
    rows = [(k, ", ".join(v) if isinstance(v, tuple) else str(v)) for k, v in ((k, getattr(p, k)) for k in ("analysis_profile", "link_mode", "include_noise_in_counts", "count_overlapping_word_hits", "enabled_precision_levels", "experimental_phrases_in_main_stats", "min_perspective_confidence_main"))]
    return spark.createDataFrame(rows, "setting string, value string")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose keys are shared."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n > 1").drop("_n")
