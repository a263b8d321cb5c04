"""Quality tables, samples for manual checks, and the showcase."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators.stats import level, top_markers
from glossa.plans.profile import Profile

LINKS = ("YES", "PROBABLE", "NO")
CONFIDENCES = ("HIGH", "MEDIUM", "LOW")
PLACE = ["doc_id", "sent_id", "token_idx", "hit_id"]
EXAMPLE = ["hit_id", "doc_id", "marker_id", "marker_label", "microtheme", "phrase_family", "unit_type", "precision_level", "book", "part", "hero_link", "hero_evidence", "perspective", "perspective_confidence", "perspective_evidence", "speaker_detected", "addressee_detected", "others_speech_act", "target_surface", "sent_text", "context_window", "risk_comment"]


def rank(column: str, order: tuple[str, ...]) -> Column:
    """Place of a value in a fixed order; other values come last."""
    return reduce(lambda out, x: F.when(F.col(column) == x[1], x[0]).otherwise(out), reversed(list(enumerate(order))), F.lit(len(order)))


def with_blanks(df: DataFrame, *names: str) -> DataFrame:
    """Empty columns for people to fill in."""
    return df.withColumns({n: F.lit("") for n in names})


# ------------------------------------------------------------------ phrase quality


def phrase_coverage(markers: DataFrame, raw: DataFrame) -> DataFrame:
    n = raw.where("hit_type = 'PHRASE'").groupBy("marker_id").agg(F.count("*").alias("count_all"))
    cols = ["marker_id", "marker_label", "microtheme", "phrase_family", "unit_raw", "unit_norm", "precision_level", "source_type", "risk_comment"]
    out = markers.where("unit_type = 'PHRASE'").select(*cols).join(n, "marker_id", "left").fillna(0, ["count_all"])
    return out.withColumn("appears_in_corpus", F.col("count_all") > 0)


def phrase_zero_hits(markers: DataFrame, raw: DataFrame) -> DataFrame:
    return markers.where("unit_type = 'PHRASE'").join(raw.where("hit_type = 'PHRASE'").select("marker_id"), "marker_id", "left_anti")


def phrase_top(markers: DataFrame, raw: DataFrame, n: int = 100) -> DataFrame:
    return phrase_coverage(markers, raw).where("count_all > 0").orderBy(F.desc("count_all"), "precision_level", "marker_id").limit(n)


#: Texts joined to a bounded sample of hits.
Texts = Callable[[DataFrame], DataFrame]


def phrase_examples(raw: DataFrame, n: int = 3, texts: Texts = lambda df: df) -> DataFrame:
    """The first hits of each phrase. texts: joins the texts that hits don't bring, once the few are found."""
    first = F.row_number().over(Window.partitionBy("marker_id").orderBy(*PLACE))
    cols = ["hit_id", "marker_id", "marker_label", "microtheme", "precision_level", "target_surface", "sent_text", "context_window", "hero_link", "perspective", "perspective_evidence"]
    return texts(raw.where("hit_type = 'PHRASE'").withColumn("_n", first).where(F.col("_n") <= n).drop("_n")).select(*cols)


# ------------------------------------------------------------------ dashboard


def dashboard_summary(raw: DataFrame, main: DataFrame, markers: DataFrame, nested: DataFrame) -> DataFrame:
    one = lambda df, name, where=None: df.agg((F.count("*") if where is None else F.count_if(where)).alias(name))
    parts = [
        one(markers, "markers_total"), one(markers, "phrase_markers", F.col("unit_type") == "PHRASE"), one(raw, "hits_raw"), one(main, "hits_counted"), one(raw, "noise_hits", F.col("is_noise")), one(nested, "nested_phrase_candidates"),
    ]
    row = reduce(lambda a, b: a.join(b, F.lit(True)), parts)
    return row.selectExpr(f"stack({len(row.columns)}, {', '.join(f"'{c}', {c}" for c in row.columns)}) AS (metric, value)")


def warnings(main: DataFrame, markers: DataFrame, nested: DataFrame) -> DataFrame:
    """(level, check, n) of the checks that found something."""
    m = markers.agg(F.count_if(T.strip(F.coalesce("microtheme", F.lit(""))) == "").alias("empty_microtheme"), (F.count("*") - F.countDistinct("marker_id")).alias("duplicate_marker_id"))
    c = main.agg(F.count_if(F.col("perspective") == "UNKNOWN").alias("unknown_perspective"), F.count_if(F.col("perspective_confidence") == "LOW").alias("low_confidence"))
    row = m.join(nested.agg(F.count("*").alias("nested_phrase_candidates")), F.lit(True)).join(c, F.lit(True))
    kinds = {"empty_microtheme": "WARN", "duplicate_marker_id": "ERROR", "nested_phrase_candidates": "INFO", "unknown_perspective": "WARN", "low_confidence": "INFO"}
    return row.selectExpr(f"stack({len(kinds)}, {', '.join(f"'{v}', '{k}', {k}" for k, v in kinds.items())}) AS (level, check, n)").where("n > 0")


def manual_required(main: DataFrame) -> DataFrame:
    """First 100 hits each of unknown perspective, low confidence and probable link; each hit once; 300 at most."""
    picks = [("perspective", "UNKNOWN"), ("perspective_confidence", "LOW"), ("hero_link", "PROBABLE")]
    parts = [main.where(F.col(c) == v).orderBy("hit_id").limit(100).withColumn("_pick", F.lit(i)) for i, (c, v) in enumerate(picks)]
    every = reduce(DataFrame.unionByName, parts)
    first = F.row_number().over(Window.partitionBy("hit_id").orderBy("_pick"))
    return every.withColumn("_n", first).where("_n = 1").orderBy("_pick", "hit_id").limit(300).drop("_n", "_pick")


def manual_check(raw: DataFrame, n: int = 300) -> DataFrame:
    """Sample by link, then place."""
    return with_blanks(raw.orderBy(rank("hero_link", LINKS), *PLACE).limit(n), "human_valid", "human_perspective", "human_comment")


def verification(raw: DataFrame, main: DataFrame, n: int = 300, texts: Texts = lambda df: df, only: str | None = None) -> dict[str, DataFrame]:
    """Samples by name, or the one that is named. texts: joins the texts that hits don't bring, once a sample is found."""
    cols = [c for c in [*EXAMPLE, "is_noise", "noise_reason"] if c != "risk_comment"]
    of = lambda df, *order: with_blanks(texts(df.orderBy(*order, "hit_id").limit(n)).orderBy(*order, "hit_id").select(*cols), "human_valid", "human_hero_link", "human_perspective", "human_comment")
    samples = {
        "hit_check": (main, "hero_link", *PLACE), "phrase_check": (main.where("hit_type = 'PHRASE'"), "precision_level", "marker_id"),
        "perspective_check": (main.where(F.col("perspective_confidence").isin("LOW", "MEDIUM")),), "probable_link_check": (main.where("hero_link = 'PROBABLE'"),), "noise_check": (raw.where("is_noise"),),
    }
    return {k: of(*v) for k, v in samples.items() if only in (None, k)}


def priority_sample(raw: DataFrame, n: int) -> DataFrame:
    return raw.orderBy(rank("hero_link", LINKS), *PLACE).limit(n)


# ------------------------------------------------------------------ showcase


def count_table(df: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """Counts with the share of all rows (also of those beyond the first n)."""
    out = df.groupBy(*keys).agg(F.count("*").alias("count")).withColumn("share_pct", T.share(F.col("count"), F.sum("count").over(Window.partitionBy())))
    return out if n is None else out.orderBy(F.desc("count"), *keys).limit(n)


def examples(df: DataFrame, title: str, top: int = 25, each: int = 4, texts: Texts = lambda df: df) -> DataFrame:
    """The first hits of each of the top markers. texts: joins the texts that hits don't bring, once the few are found."""
    first = F.row_number().over(Window.partitionBy("marker_id").orderBy(*PLACE))
    # The first of every marker and their counts come from one pass; markers are few.
    kept = df.withColumn("_n", first).where(F.col("_n") <= each).join(F.broadcast(top_markers(df, top).select("marker_id")), "marker_id", "left_semi")
    return texts(kept.drop("_n")).select(*EXAMPLE, F.lit(title).alias("selection"))


def theme_has(pattern: str) -> Column:
    return T.matches(F.coalesce("microtheme", F.lit("")), pattern)


def choices(p: Profile) -> dict[str, tuple[Column, str]]:
    """Name to (condition on a hit without noise that counts, title) of the example sheets."""
    wide, strict = F.col("hero_link").isin("YES", "PROBABLE"), F.col("hero_link") == "YES"
    view = lambda *names: F.col("perspective").isin(*names)
    out = {"strict": (strict, "strict hero contexts"), "core": (wide & level("CORE"), "CORE"), "extended": (wide & level("EXTENDED"), "EXTENDED"), "experimental": (level("EXPERIMENTAL"), "EXPERIMENTAL")}
    out |= {"inner": (wide & view("HERO_INNER_SPEECH"), "inner speech"), "others_to": (wide & view("OTHERS_TO_HERO"), "others to hero"), "narrator": (strict & view("NARRATOR_ABOUT_HERO"), "narrator about hero")}
    out["others"] = (wide & view("OTHERS_TO_HERO", "OTHERS_ABOUT_HERO", "OTHERS_NEAR_HERO"), "other characters")
    return out | {name: (wide & theme_has(pattern), name) for name, _, pattern in p.topics}


def selections(clean: DataFrame, p: Profile) -> dict[str, tuple[DataFrame, str]]:
    """Name to (hits, title) of the example sheets; clean: hits without noise that count."""
    return {name: (clean.where(met), title) for name, (met, title) in choices(p).items()}


def best_examples(clean: DataFrame, p: Profile, each: int = 2, texts: Texts = lambda df: df) -> DataFrame:
    """Two compact examples for each bucket, with the reason: perspectives, then topics. A hit may be in several."""
    wide = clean.where("hero_link IN ('YES', 'PROBABLE')")
    views = ("NARRATOR_ABOUT_HERO", "HERO_INNER_SPEECH", "HERO_DIRECT_SPEECH", "OTHERS_TO_HERO")
    buckets = {t: F.col("perspective") == v for t, v in zip(p.bucket_titles, views, strict=True)} | {title: theme_has(pattern) for _, title, pattern in p.topics}
    found = wide.withColumn("thesis_bucket", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in buckets.items()]))))
    first = F.row_number().over(Window.partitionBy("thesis_bucket").orderBy(rank("perspective_confidence", CONFIDENCES), *PLACE))
    return texts(found.withColumn("_n", first).where(F.col("_n") <= each).drop("_n")).select(*EXAMPLE, "thesis_bucket", F.lit(p.why_selected).alias("why_selected"))


def noise_examples(raw: DataFrame, n: int = 150) -> DataFrame:
    return raw.where("is_noise").orderBy("hit_id").limit(n)
