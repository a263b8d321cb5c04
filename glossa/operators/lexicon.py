"""The marker registry: three sources, normalised, filtered and deduplicated."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.plans.profile import Profile

#: rows, the column of a unit and a new column's name, to rows with the unit's lemma in it
Lemmas = Callable[[DataFrame, str, str], DataFrame]
COLUMNS = ["marker_id", "marker_source", "microtheme", "phrase_family", "unit_type", "unit_raw", "unit_norm", "marker_label", "precision_level", "source_type", "enabled", "risk_comment", "comment"]


def theme_aliases(themes: DataFrame) -> DataFrame:
    """(alias, canonical): each canonical theme and its aliases in plain lower case; of an alias given twice, the later row's."""
    rows = themes.select(T.strip(F.coalesce("canonical_microtheme", F.lit(""))).alias("canonical"), F.coalesce("aliases", F.lit("")).alias("aliases"), F.monotonically_increasing_id().alias("ord")).where(F.col("canonical") != "")
    each = rows.select("canonical", "ord", F.explode(F.concat(F.array("canonical"), F.transform(F.split("aliases", ";"), T.strip))).alias("alias")).where(F.col("alias") != "")
    return each.groupBy(T.strip(T.plain_lower("alias")).alias("alias")).agg(F.max_by("canonical", "ord").alias("canonical"))


def normalise_themes(markers: DataFrame, aliases: DataFrame, p: Profile, theme: str = "microtheme") -> DataFrame:
    """Direct alias, else alias of the form with ` / `, else the theme as it is, else the default. Themes are few: the alias table is broadcast if Spark finds it small."""
    raw = T.strip(F.coalesce(theme, F.lit("")))
    key = T.plain_lower(raw)
    compact = F.replace(F.replace(key, F.lit(" / "), F.lit("/")), F.lit("/"), F.lit(" / "))
    a, b = aliases.alias("_a"), aliases.alias("_b")
    named = markers.withColumn("_key", key).withColumn("_compact", compact)
    joined = named.join(a, F.col("_key") == F.col("_a.alias"), "left").join(b, F.col("_compact") == F.col("_b.alias"), "left")
    found = F.coalesce(F.col("_a.canonical"), F.col("_b.canonical"), F.nullif(raw, F.lit("")), F.lit(p.default_theme))
    return joined.select(*[found.alias(theme) if c == theme else F.col(c) for c in markers.columns])


def listed_theme(unit: Column, p: Profile) -> Column:
    """First theme one of whose substrings is in the unit."""
    low = F.lower(unit)
    return reduce(lambda out, x: F.when(T.contains_any(low, list(x[1])), F.lit(x[0])).otherwise(out), reversed(p.themes), F.lit(p.default_theme))


def default_precision(source: str, theme: Column, p: Profile) -> Column:
    if source != "PHRASE":
        return F.lit("CORE")
    return F.when(T.contains_any(F.lower(F.coalesce(theme, F.lit(""))), list(p.extended_when)), F.lit("EXTENDED")).otherwise(F.lit("CORE"))


def with_defaults(df: DataFrame, source: str, p: Profile) -> DataFrame:
    """Absent columns get their defaults, blank levels are CORE; rows that aren't enabled go."""
    kinds = {"CURATED": "curated", "PHRASE": "manual_phrase", "LISTED": "dictionary"}
    absent = {
        "precision_level": default_precision(source, F.col("microtheme"), p), "source_type": F.lit(kinds[source]), "enabled": F.lit("1"), "risk_comment": F.lit(""), "comment": F.lit(""), "phrase_family": F.lit(""),
    }
    df = df.withColumns({k: v for k, v in absent.items() if k not in df.columns})
    level = F.upper(F.coalesce("precision_level", F.lit("")))
    df = df.withColumn("precision_level", F.when(level == "", F.lit("CORE")).otherwise(level))
    return df.where(F.lower(T.strip(F.col("enabled").cast("string"))).isin("1", "true", "yes", "да", "y")).fillna("")


def with_lemma(rows: DataFrame, unit: str, p: Profile, lemmas: Lemmas | None) -> DataFrame:
    """rows with the unit's lemma as `_lemma`: by `lemmas`, or by the profile."""
    return rows.withColumn("_lemma", T.lemma(F.col(unit), p)) if lemmas is None else lemmas(rows, unit, "_lemma")


def curated(rows: DataFrame, aliases: DataFrame, p: Profile, lemmas: Lemmas | None = None) -> DataFrame:
    df = with_lemma(normalise_themes(with_defaults(rows, "CURATED", p), aliases.where(F.lit(True)), p), "unit", p, lemmas)
    unit, kind = F.col("unit"), F.upper("unit_type")
    norm = F.when(kind == "WORD", F.col("_lemma")).otherwise(T.strip(unit))
    theme = F.when(T.strip("microtheme") != "", F.concat(F.lit(" ["), F.col("microtheme"), F.lit("]"))).otherwise("")
    label = F.concat(F.when(kind == "WORD", norm).otherwise(unit), theme)
    return df.select(
        F.col("id").alias("marker_id"), F.lit(p.curated_source).alias("marker_source"), "microtheme", F.lit("WORD_CORE").alias("phrase_family"), kind.alias("unit_type"), unit.alias("unit_raw"),
        norm.alias("unit_norm"), label.alias("marker_label"), "precision_level", "source_type", F.col("enabled").cast("string"), "risk_comment", "comment",
    )


def listed(units: DataFrame, aliases: DataFrame, p: Profile, lemmas: Lemmas | None = None) -> DataFrame:
    """units: (ord, value), a line each; blank lines and comments go, the others are numbered in order."""
    rows = units.select("ord", T.strip(F.regexp_replace("value", "^﻿", "")).alias("unit")).where((F.col("unit") != "") & ~F.col("unit").startswith("#"))
    rows = with_lemma(rows.withColumn("n", F.row_number().over(Window.orderBy("ord"))), "unit", p, lemmas).withColumnRenamed("_lemma", "norm")
    rows = normalise_themes(rows.withColumn("microtheme", listed_theme(F.col("norm"), p)), aliases, p)
    return rows.select(
        F.format_string(p.listed_id, "n").alias("marker_id"), F.lit(p.listed_source).alias("marker_source"), "microtheme", F.lit(p.listed_family).alias("phrase_family"), F.lit("WORD").alias("unit_type"), F.col("unit").alias("unit_raw"),
        F.col("norm").alias("unit_norm"), F.concat("norm", F.lit(" ["), "microtheme", F.lit("]")).alias("marker_label"), F.lit("CORE").alias("precision_level"), F.lit("dictionary").alias("source_type"), F.lit("1").alias("enabled"),
        F.lit("").alias("risk_comment"), F.lit("word list unit").alias("comment"),
    )


def phrases(rows: DataFrame, aliases: DataFrame, p: Profile) -> DataFrame:
    df = normalise_themes(with_defaults(rows, "PHRASE", p), aliases, p)
    pattern = T.strip("pattern_lemmas") if "pattern_lemmas" in df.columns else F.lit("")
    norm = F.coalesce(F.nullif(pattern, F.lit("")), T.strip("phrase_text"))
    ident = F.col("id").cast("string")
    named = F.when(ident.startswith("PHR_"), ident).when(ident.rlike("^[0-9]+$"), F.concat(F.lit("PHR_"), F.lpad(ident, 3, "0"))).otherwise(ident)
    named = F.when(ident.rlike("^[0-9]{4,}$"), F.concat(F.lit("PHR_"), ident)).otherwise(named)
    return df.select(
        named.alias("marker_id"), F.lit("PHRASE").alias("marker_source"), "microtheme", F.coalesce(F.nullif("phrase_family", F.lit("")), F.lit("PHRASE_GENERAL")).alias("phrase_family"), F.lit("PHRASE").alias("unit_type"),
        F.col("phrase_text").alias("unit_raw"), norm.alias("unit_norm"), F.concat("phrase_text", F.lit(" ["), "microtheme", F.lit("]")).alias("marker_label"), "precision_level", "source_type", F.col("enabled").cast("string"), "risk_comment", "comment",
    )


def registry(curated_rows: DataFrame, units: DataFrame, phrase_rows: DataFrame, themes: DataFrame, p: Profile, levels: tuple[str, ...] | None = None, lemmas: Lemmas | None = None) -> DataFrame:
    """All markers with marker_ord, their order: of equal (unit_type, unit_norm) the first by source (phrases, curated, listed), then id."""
    aliases = theme_aliases(themes)
    every = phrases(phrase_rows, aliases, p).unionByName(curated(curated_rows, aliases, p, lemmas)).unionByName(listed(units, aliases, p, lemmas))
    every = every.withColumn("unit_norm", T.strip("unit_norm"))
    if levels:
        every = every.where(F.col("precision_level").isin(*levels))
    order_of = ("PHRASE", p.curated_source, p.listed_source)
    priority = F.create_map(*[F.lit(x) for i, k in enumerate(order_of) for x in (k, i)])[F.col("marker_source")]
    first = F.row_number().over(Window.partitionBy("unit_type", "unit_norm").orderBy(priority, "marker_id"))
    kept = every.withColumn("_first", first).where(F.col("_first") == 1).drop("_first")
    order = Window.orderBy("marker_source", "precision_level", "marker_id")  # the registry is a small table
    return kept.withColumn("marker_ord", F.row_number().over(order))
