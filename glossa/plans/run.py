"""A project from files to tables: registry, hits, tags, workbooks, plot data and metadata."""

from __future__ import annotations

import posixpath
from dataclasses import replace
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import plotdata, quality, segments, stats
from glossa.operators.tagging import OTHERS
from glossa.plans.analysis import BOOKS, PARTS, PHRASES, Analysis, Sources
from glossa.plans.profile import RUSSIAN, Profile, load_config
from glossa.sources import files

#: Column names of the tagged table in older exports of such projects, for those who read them by name.
EXPORT_NAMES = {
    "hero_link": "MelekhovLink", "hero_evidence": "MelekhovEvidence", "perspective": "Perspective", "perspective_evidence": "PerspectiveEvidence", "perspective_confidence": "PerspectiveConfidence",
    "speaker_detected": "SpeakerDetected", "addressee_detected": "AddresseeDetected", "others_speech_act": "OthersSpeechAct", "book_id": "BookId", "book": "Book", "part_id": "PartId", "part": "Part",
}


def project_sources(spark: SparkSession, root: str, rest: dict[str, Any], p: Profile, corpus: str) -> Sources:
    """Input tables of a configuration; relative paths are under `root`."""
    at = lambda x: x if "://" in x or posixpath.isabs(x) else posixpath.join(root, x)
    m, s = rest.get("markers", {}), rest.get("segmentation", {})
    table = lambda x, schema: files.read_lexicon(spark, at(x)) if x and files.exists(spark, at(x)) else spark.createDataFrame([], schema)
    seg = lambda x, schema: spark.read.csv(at(x), header=True, schema=schema) if x and files.exists(spark, at(x)) else None
    return Sources(
        files.read_texts(spark, corpus, p.encodings), table(m.get("s1_csv") or m.get("curated_csv"), "id string, microtheme string, unit string, unit_type string, comment string"),
        files.read_word_list(spark, at(m.get("alexandrova_txt") or m.get("listed_txt") or "absent")), table(m.get("phrases_csv"), PHRASES), table(m.get("microthemes_csv"), "canonical_microtheme string, aliases string"),
        files.read_exclusions(spark, at(m["exclusions_csv"]) if m.get("exclusions_csv") else None), seg(s.get("parts_csv"), PARTS), seg(s.get("books_csv"), BOOKS),
        files.read_forms(spark, at(m["forms"])) if m.get("forms") else None,
    )


def stats_tables(a: Analysis) -> dict[str, DataFrame]:
    t, c, link, s, m, p = a.narrow, a.counted, a.linked, a.sentences, a.markers, a.p
    parts, books = a.sources.parts, a.sources.books
    out = {
        "overview": stats.overview(t, m, s, p), "profile_settings": stats.profile_settings(t.sparkSession, p), "coverage": stats.coverage(m, c), "strict_vs_wide": stats.strict_vs_wide(c, p.link_mode), "by_link": stats.group_count(c, "hero_link"),
        "perspective_linked": stats.group_count(link, "perspective"), "perspective_strict": stats.group_count(a.strict, "perspective"), "perspective_conf": stats.group_count(link, "perspective_confidence"),
        "marker_all": stats.by_marker(c, s), "marker_strict": stats.by_marker(a.strict, s), "marker_wide": stats.by_marker(a.wide, s), "marker_config_linked": stats.by_marker(link, s),
        "marker_core": stats.by_marker(c.where(stats.level("CORE")), s), "marker_extended": stats.by_marker(c.where(stats.level("EXTENDED")), s), "marker_experimental": stats.by_marker(t.where(stats.level("EXPERIMENTAL")), s),
        "precision_layers": stats.group_count(c, "precision_level"), "microtheme_all": stats.group_count(c, "microtheme"), "microtheme_linked": stats.group_count(link, "microtheme"),
        "others_speechact": stats.group_count(link.where(F.col("perspective").isin(*OTHERS)), "others_speech_act"), "book_top_markers": stats.dynamics(link, "book", 8), "part_top_markers": stats.dynamics(link, "part", 8),
        "word_phrase_overlaps": stats.overlap_report(t), "phrase_family_coverage": stats.group_count(link.where("unit_type = 'PHRASE'"), "phrase_family"), "nested_phrase_report": a.with_texts(a.nested),
        "perspective_microtheme": stats.pivot_matrix(link, "perspective", "microtheme"), "part_microtheme": stats.pivot_matrix(link, "part", "microtheme"), "core_extended_by_part": stats.pivot_matrix(link, "part", "precision_level"),
        "inner_speech_by_part": stats.part_indicator(link, ["HERO_INNER_SPEECH"], "inner_speech_hits"), "external_pressure_by_part": stats.part_indicator(link, list(OTHERS), "external_pressure_hits"),
        "hero_vs_corpus_micro": stats.hero_vs_corpus(c), "hero_profile": stats.cognitive_profile(link), "noise_report": stats.noise_report(t), "manual_check": quality.manual_check(a.tagged),
    }
    if books is not None:
        out["book_normalized"] = stats.segment_rates(link, s, books, "book")
    if parts is not None:
        out["part_normalized"] = out["density_by_part"] = stats.segment_rates(link, s, parts, "part")
        out["analytical_indices"] = stats.analytical_indices(link, out["part_normalized"])
    return out


def phrase_quality_tables(a: Analysis) -> dict[str, DataFrame]:
    t, m = a.narrow, a.markers
    examples = quality.phrase_examples(a.tagged)
    return {
        "phrase_coverage": quality.phrase_coverage(m, t), "phrase_zero_hits": quality.phrase_zero_hits(m, t), "phrase_top_hits": quality.phrase_top(m, t), "phrase_overlaps": stats.overlap_report(t), "phrase_examples": examples,
        "phrase_by_precision": stats.group_count(m.where("unit_type = 'PHRASE'"), "precision_level"), "phrase_by_family": stats.group_count(t.where("hit_type = 'PHRASE'"), "phrase_family"), "nested_candidates": a.with_texts(a.nested),
        "manual_phrase_check": quality.with_blanks(examples, "human_valid", "human_comment"),
    }


def dashboard_tables(a: Analysis) -> dict[str, DataFrame]:
    t, c, m = a.narrow, a.counted, a.markers
    first = lambda df: a.with_texts(df.orderBy("hit_id").limit(1000)).orderBy("hit_id")
    return {
        "summary": quality.dashboard_summary(t, c, m, a.nested), "warnings": quality.warnings(c, m, a.nested), "duplicate_ids": stats.duplicates(m, ["marker_id"]), "duplicate_lemmas": stats.duplicates(m, ["unit_type", "unit_norm"]),
        "nested_phrases": a.with_texts(a.nested.orderBy("candidate_id").limit(5000)).orderBy("candidate_id"), "noise": stats.noise_report(t), "low_confidence": first(c.where("perspective_confidence = 'LOW'")), "unknown_perspective": first(c.where("perspective = 'UNKNOWN'")),
        "manual_required": quality.manual_required(a.with_texts(c)),
    }


def showcase_tables(a: Analysis, top_n: int = 25, examples_per_marker: int = 4) -> dict[str, DataFrame]:
    clean, strict, wide = a.clean, stats.linked(a.clean, "STRICT"), stats.linked(a.clean, "WIDE")
    keys = ["marker_id", "marker_label", "microtheme", "phrase_family", "unit_type", "precision_level"]
    out = {
        "top_all": quality.count_table(clean, keys, top_n), "top_strict": quality.count_table(strict, keys, top_n), "top_wide": quality.count_table(wide, keys, top_n), "precision_layers": quality.count_table(clean, ["precision_level"]),
        "phrase_families": quality.count_table(wide.where("unit_type = 'PHRASE'"), ["phrase_family", "microtheme", "precision_level"], top_n), "microthemes_strict": quality.count_table(strict, ["microtheme"], top_n),
        "perspective_strict": quality.count_table(strict, ["perspective"]), "perspective_wide": quality.count_table(wide, ["perspective"]), "dynamics_parts": stats.dynamics(strict, "part", top_n), "dynamics_books": stats.dynamics(strict, "book", top_n),
        "best_examples": quality.best_examples(a.with_texts(clean), a.p), "noise_examples": quality.noise_examples(a.tagged),
    }
    return out | {f"examples_{k}": quality.examples(df, title, top_n, examples_per_marker) for k, (df, title) in quality.selections(a.with_texts(clean), a.p).items()}


def plot_tables(a: Analysis) -> dict[str, DataFrame]:
    clean, link = a.clean, stats.linked(a.clean, a.p.link_mode)
    out = {
        "top_markers_all": plotdata.marker_bars(clean), "top_markers_hero": plotdata.marker_bars(link), "top_markers_hero_pie": plotdata.pie(link), "microthemes_hero": plotdata.bars(link, "microtheme"), "phrase_layers": plotdata.bars(link, "precision_level", 5),
        "top_phrase_families": plotdata.bars(link.where("hit_type = 'PHRASE'"), "phrase_family"), "perspective_microtheme_heatmap": plotdata.heatmap(link, "perspective", "microtheme"), "part_microtheme_heatmap": plotdata.heatmap(link, "part", "microtheme"),
        "core_extended_by_part": stats.pivot_matrix(link, "part", "precision_level"), "inner_speech_share_by_part": plotdata.share_by_part(link, ["HERO_INNER_SPEECH"]), "external_pressure_by_part": plotdata.share_by_part(link, list(OTHERS)),
        "perspective": plotdata.perspective_bars(link), "strict_vs_wide": stats.strict_vs_wide(clean, a.p.link_mode), "noise_report": plotdata.bars(a.narrow.where("is_noise"), "noise_reason"), "corpus_vs_hero_microthemes": plotdata.corpus_vs_hero(clean, a.p.link_mode),
    }
    for kind, table in (("part", a.sources.parts), ("book", a.sources.books)):
        if table is not None:
            out[f"dynamics_top_markers_{kind}s"] = plotdata.dynamics_lines(link, table, kind)
    if a.sources.parts is not None:
        out["cognitive_density_by_part"] = stats.segment_rates(link, a.sentences, a.sources.parts, "part").select("part", "hits_per_10000_words")
    return out


def marker_counters() -> dict[str, Column]:
    level = lambda x: F.count_if(stats.level(x))
    return {
        "markers_count": F.count(F.lit(1)), "phrase_markers_count": F.count_if(F.col("unit_type") == "PHRASE"), "core_markers_count": level("CORE"), "extended_markers_count": level("EXTENDED"), "experimental_markers_count": level("EXPERIMENTAL"),
    }


def hit_counters(p: Profile) -> dict[str, Column]:
    return {"hits_total_raw": F.count(F.lit(1)), "hits_counted_main": F.count_if(stats.is_counted(p))}


def metadata(a: Analysis, extra: dict[str, Any], counters: dict[str, int] | None = None) -> dict[str, Any]:
    """Settings and counters of a run. Counters are those that were taken while tables were written; without, one aggregation of each table."""
    p = a.p
    if counters is None:
        taken = [df.agg(*[c.alias(k) for k, c in metrics.items()]).first().asDict() for df, metrics in ((a.markers, marker_counters()), (a.scopes.narrow, hit_counters(p)))]
        counters = taken[0] | taken[1]
    kept = ("project_name", "analysis_profile", "link_mode", "include_noise_in_counts", "count_overlapping_word_hits", "enabled_precision_levels", "experimental_phrases_in_main_stats", "min_perspective_confidence_main", "overlap_mode", "remove_headings_from_analysis")
    return {"run_datetime": datetime.now().isoformat(timespec="seconds")} | extra | {k: getattr(p, k) for k in kept} | counters


def validate(a: Analysis) -> DataFrame:
    """Checks of inputs and registry: (level, check, n)."""
    m = a.all_markers
    row = a.sentences.agg(F.count("*").alias("sentences")).join(a.headings.agg(F.count("*").alias("headings")), F.lit(True)).join(
        m.agg(
            F.count("*").alias("markers_total"), F.count_if(F.col("unit_type") == "PHRASE").alias("phrase_markers"), (F.count("*") - F.countDistinct("marker_id")).alias("duplicate_marker_id"),
            (F.count("*") - F.countDistinct("unit_type", "unit_norm")).alias("duplicate_unit"), F.count_if(F.trim("microtheme") == "").alias("empty_microtheme"), F.count_if(F.trim("phrase_family") == "").alias("empty_phrase_family"),
            F.count_if(~F.col("precision_level").isin("CORE", "EXTENDED", "EXPERIMENTAL")).alias("unknown_precision_level"), *[F.count_if(stats.level(x)).alias(f"level_{x.lower()}") for x in ("CORE", "EXTENDED", "EXPERIMENTAL")],
        ), F.lit(True),
    )
    cells = ", ".join(f"'{c}', {c}" for c in row.columns)
    out = row.selectExpr(f"stack({len(row.columns)}, {cells}) AS (check, n)")
    bad = F.col("check").rlike("^(duplicate|empty|unknown)") & (F.col("n") > 0) | (F.col("check") == "sentences") & (F.col("n") < 10)
    return out.select(F.when(bad, "WARN").otherwise("OK").alias("level"), "check", "n")


#: Most bars of a chart and most cells of a heat map; the tables beside them are whole.
BARS, CELLS = 20, 1_000


def figure(name: str, df: DataFrame) -> str:
    """A plot table as SVG: heat maps of (row, column, count), lines of a marker over segments, a pie of shares, bars of all else."""
    title, kinds = name.replace("_", " "), dict(df.dtypes)
    texts = [c for c, t in df.dtypes if t == "string"]
    if "heatmap" in name:
        row, column = texts[:2]
        return files.heatmap_svg(title, [(r[0], r[1], float(r[2])) for r in df.orderBy(row, column).select(row, column, "count").limit(CELLS).collect()])
    if "dynamics" in name:
        kind = next(c for c in texts if c != "marker_id")
        series: dict[str, list[tuple[str, float]]] = {}
        for r in df.orderBy("marker_id", "ord").select("marker_id", kind, "count").limit(CELLS).collect():
            series.setdefault(r[0], []).append((r[1], float(r[2])))
        return files.line_svg(title, series)
    if "is_labelled" in kinds:
        return files.pie_svg(title, [(r[0], float(r[1]), r[2]) for r in df.orderBy(F.desc("count"), "label").select("label", "count", "is_labelled").collect()])
    value = next((c for c in ("count", "share_pct", "hits_per_10000_words", "hero_count", *df.columns) if c in kinds and kinds[c] != "string"), None)
    if not texts or value is None:
        return files.bar_svg(title, [])
    label = next((c for c in ("label", "marker_label") if c in texts), texts[0])
    return files.bar_svg(title, [(r[0], float(r[1] or 0)) for r in df.orderBy(F.desc(value), label).select(label, value).limit(BARS).collect()])


def validate_files(spark: SparkSession, root: str, rest: dict[str, Any]) -> DataFrame:
    """(level, check, n) of a configuration's files: whether each is there, and the rows of segment tables with the columns they need; -1 where a file is absent."""
    at = lambda x: x if "://" in x or posixpath.isabs(x) else posixpath.join(root, x)
    found: list[tuple[str, str, int]] = []
    for name, path in rest.get("markers", {}).items():
        there = files.exists(spark, at(path))
        found.append(("OK" if there else "WARN", f"marker file {name}", 1 if there else -1))
    for name, path in rest.get("segmentation", {}).items():
        if not files.exists(spark, at(path)):
            found.append(("WARN" if name == "books_csv" else "INFO", f"segmentation {name}", -1))
            continue
        table = spark.read.csv(at(path), header=True)
        missing = [c for c in ("start_sent", "end_sent") if c not in table.columns]
        found.append(("WARN" if missing else "OK", f"segmentation {name}" + (f" without {', '.join(missing)}" if missing else ""), table.count()))
    return spark.createDataFrame(found, "level string, check string, n long")


def run(a: Analysis, out: str, extra: dict[str, Any] | None = None, make_plots: bool = False, xlsx: bool = True, clean_out: bool = False, export_names: bool = False) -> None:
    """All tables of a project under `out`."""
    spark, p = a.sources.docs.sparkSession, a.p
    if clean_out and files.exists(spark, out):
        files.remove(spark, out)
    save = lambda df, name: files.save_table(df, f"{out}/{name}", p.export_csv, p.csv_max_rows)
    observed = lambda df, name, metrics, names=None: files.save_observed(df, f"{out}/{name}", metrics, p.export_csv, p.csv_max_rows, names=names)
    counters = observed(a.markers, "MARKERS_MASTER", marker_counters())
    save(a.headings, "HEADINGS")
    save(a.sentences.select("doc_id", "sent_id", "sent_text", "word_count"), "SENTS")
    save(a.with_texts(a.hits), "TD_HITS")
    save(a.with_texts(a.nested), "PHRASE_NESTED_CANDIDATES")
    save(a.with_texts(a.hits.orderBy("hit_id").limit(p.max_hits_sample)).orderBy("hit_id"), "TD_HITS_SAMPLE")
    counters |= observed(a.tagged, "TD_HITS_TAGGED", hit_counters(p), EXPORT_NAMES if export_names else None)
    del counters["rows"]
    files.save_csv(quality.priority_sample(a.tagged, p.max_hits_sample), f"{out}/TD_HITS_TAGGED_SAMPLE.csv")
    files.save_workbook(stats_tables(a), f"{out}/STATS", xlsx)
    if p.save_phrase_quality_report:
        files.save_workbook(phrase_quality_tables(a), f"{out}/PHRASE_QUALITY_REPORT", xlsx)
    files.save_workbook(dashboard_tables(a), f"{out}/QUALITY_DASHBOARD", xlsx)
    files.save_workbook(quality.verification(a.narrow, a.counted, texts=a.with_texts_of_few), f"{out}/MANUAL_VERIFICATION", xlsx)
    files.save_workbook(showcase_tables(a), f"{out}/SHOWCASE", xlsx)
    if make_plots:
        tables = plot_tables(a)
        files.save_workbook(tables, f"{out}/PLOTS", xlsx=False)
        for name in tables:
            files.write_text(spark, f"{out}/PLOTS/{name}.svg", figure(name, spark.read.parquet(f"{out}/PLOTS/{name}.parquet")))
    if p.save_run_metadata:
        files.write_json(spark, f"{out}/RUN_METADATA.json", metadata(a, extra or {}, counters))


def main(argv: list[str] | None = None) -> int:
    import argparse

    ap = argparse.ArgumentParser(prog="python -m glossa")
    ap.add_argument("command", nargs="?", default="run", choices=["run", "validate", "segments"])
    ap.add_argument("--config", default="config.json")
    ap.add_argument("--corpus")
    ap.add_argument("--out")
    ap.add_argument("--make-plots", "--make_plots", action="store_true")
    ap.add_argument("--max-sents", "--max_sents", type=int)
    ap.add_argument("--clean-out", action="store_true")
    ap.add_argument("--auto-build-segmentation", action="store_true")
    ap.add_argument("--include-headers", action="store_true")
    ap.add_argument("--include-epigraph", action="store_true")
    ap.add_argument("--no-xlsx", action="store_true", help="tables as Parquet alone")
    ap.add_argument("--export-names", action="store_true", help="column names of older exports")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName("glossa").getOrCreate()
    root = posixpath.dirname(posixpath.abspath(args.config)) if "://" not in args.config else posixpath.dirname(args.config)
    text = files.read_texts(spark, args.config).first()["text"]
    p, rest = load_config(text, RUSSIAN)
    corpus = args.corpus or posixpath.join(root, rest.get("corpus_path", ""))
    if not files.exists(spark, corpus):
        print(f"corpus not found: {corpus}")
        return 2
    sources = project_sources(spark, root, rest, p, corpus)
    out = args.out or posixpath.join(root, rest.get("output_dir", "out_final"))
    if args.command == "segments" or args.auto_build_segmentation or p.auto_build_segmentation:
        books, parts = segments.build_segments(sources.docs, p, not args.include_headers, not args.include_epigraph)
        if args.command == "segments":
            files.save_csv(books.orderBy("doc_id", "book_id"), f"{out}/books.csv")
            files.save_csv(parts.orderBy("doc_id", "part_id"), f"{out}/parts.csv")
            return 0
        sources = replace(sources, books=sources.books if sources.books is not None else books, parts=sources.parts if sources.parts is not None else parts)
    a = Analysis(sources, p, args.max_sents)
    if args.command == "validate":
        validate_files(spark, root, rest).select("level", "check", F.col("n")).union(validate(a)).show(100, truncate=False)
        return 0
    extra = {"corpus_path": posixpath.relpath(corpus, root), "corpus_sha256": files.sha256(spark, corpus), "config_path": posixpath.basename(args.config), "config_sha256": files.sha256(spark, args.config)}
    run(a, out, extra, args.make_plots, not args.no_xlsx, args.clean_out, args.export_names)
    return 0


