"""Queries of sources, sinks, segments and project runs: what they write goes to the session's shared folder and is read back.

Registered by glossa.queries, each with its SQL.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import matching, segments, tagging, texts
from glossa.plans import profile as P
from glossa.plans.analysis import EXCLUSIONS, Analysis, bench_analysis, rows
from glossa.plans.oracle import has, quoted, sql, values
from glossa.plans.run import metadata, validate
from glossa.sources import files

Query = Callable[[SparkSession, str], DataFrame]


def folder(spark: SparkSession) -> str:
    """A new folder that all executors share; without spark.checkpoint.dir a local session gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="glossa-files-")
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))


def encoding_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bytes, every other one in a single-byte encoding; the first encoding that fits gives the text."""
    docs = _documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    even = F.col("doc_id") % 2 == 0
    content = F.when(even, F.encode("text", "UTF-8")).otherwise(F.encode(F.regexp_replace("text", r"[^\x00-\xff]", "?"), "ISO-8859-1"))
    return docs.select("doc_id", files.decoded(content, ("utf-8", "latin-1")).alias("d")).select("doc_id", F.md5("d.text").alias("digest"), "d.encoding")


def table_and_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table saved with its CSV mirror: Parquet and CSV read back side by side."""
    stem = f"{folder(spark)}/table"
    files.save_table(_by_source(spark, sf_dir), stem, export_csv=True)
    mirror = files.read_lexicon(spark, f"{stem}.csv").select("source", F.col("n").alias("as_text"))
    return files.load_table(spark, stem).join(mirror, "source")


def workbook_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sheets of a workbook read back, beside whether the .xlsx is there."""
    path = f"{folder(spark)}/book"
    files.save_workbook({"sources": _by_source(spark, sf_dir), "languages": _documents(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"))}, path)
    there = F.lit(files.exists(spark, f"{path}.xlsx"))
    sheet = lambda name, key: spark.read.parquet(f"{path}/{name}.parquet").select(F.lit(name).alias("sheet"), F.col(key).alias("name"), "n", there.alias("has_xlsx"))
    return sheet("sources", "source").union(sheet("languages", "lang"))


def word_list_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{folder(spark)}/words.txt"
    files.write_text(spark, path, "﻿# words\n" + "\n".join(P.LATIN_LISTED[1:]) + "\n")
    return files.read_word_list(spark, path).select("value")


def csv_flexible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of another separator and encoding than the first ones tried."""
    path = f"{folder(spark)}/themes.csv"
    files.write_bytes(spark, path, "canonical\tn\nтема\t1\nясность; память\t2\n".encode("cp1251"))
    return files.read_csv_flexible(spark, path, ("utf-8", "cp1251"))


def exclusions_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusions as a file; the enabled ones with a pattern that compiles."""
    path = f"{folder(spark)}/exclusions"
    rows(spark, P.LATIN_EXCLUSIONS, EXCLUSIONS).coalesce(1).write.csv(path, header=True, escape='"')
    found = matching.enabled_exclusions(files.read_exclusions(spark, path))
    return spark.createDataFrame([(r["lemma"], r["surface"], r["reason"]) for r in found], "lemma string, surface string, reason string")


def clean_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder before and after it is cleaned."""
    path = folder(spark)
    files.write_json(spark, f"{path}/run.json", {"n": 1})
    before = files.exists(spark, f"{path}/run.json")
    files.remove(spark, path)
    return spark.createDataFrame([(before, files.exists(spark, path))], "before boolean, after boolean")


CONFIG = {"link_mode": "wide", "name_variants": [" Onon ", "Orre"], "enabled_precision_levels": ["core"], "phrase_overlap_mode": "keep_all", "corpus_path": "x.txt"}


def config_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, rest = P.load_config(json.dumps(CONFIG), P.LATIN)
    found = {"link_mode": p.link_mode, "names": ",".join(p.names), "levels": ",".join(p.enabled_precision_levels), "overlap_mode": p.overlap_mode, "phrase_gap": str(p.phrase_gap), "rest": ",".join(rest)}
    return spark.createDataFrame(list(found.items()), "option string, value string")


def run_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a run's metadata."""
    found = metadata(bench_analysis(spark, sf_dir), {})
    return spark.createDataFrame([(k, v) for k, v in found.items() if k.endswith("_count") or k.startswith("hits_")], "counter string, n long")


def _of(f: Callable[[Analysis], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(bench_analysis(spark, sf_dir))


def _built(kind: int) -> Query:
    return _of(lambda a: segments.build_segments(a.sources.docs, a.p)[kind])


def _assigned(a: Analysis) -> DataFrame:
    """Hits in the segments built for their own documents: one row for each hit."""
    books, parts = segments.build_segments(a.sources.docs, a.p)
    found = tagging.assign_segments(tagging.assign_segments(a.hits.select("doc_id", "sent_id", "hit_id"), books, "book"), parts, "part")
    return found.select("hit_id", "book_id", "book", "part_id", "part")


def _headings(a: Analysis) -> DataFrame:
    return segments.first_headings(segments.char_to_sentence(segments.line_headings(a.sources.docs, a.p), texts.sentence_offsets(a.sources.docs, a.p)))


QUERIES: dict[str, Query] = {
    "encoding_fallback": encoding_fallback, "table_and_mirror": table_and_mirror, "workbook_sheets": workbook_sheets, "word_list_file": word_list_file, "csv_flexible": csv_flexible, "exclusions_file": exclusions_file,
    "clean_output": clean_output, "config_options": config_options, "run_metadata": run_metadata, "segments_headings": _of(_headings), "segments_books": _built(0), "segments_parts": _built(1), "segments_of_documents": _of(_assigned),
    "validate_registry": _of(lambda a: validate(a)),
}

# ------------------------------------------------------------------ the same in SQL

ORDINAL = "CASE w WHEN 'the' THEN 1 WHEN 'a' THEN 2 WHEN 'cc' THEN 3 END"
OFFSETS = r"""offsets AS MATERIALIZED (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS sent_id, before + length(piece) - length(regexp_replace(piece, '^\s+', '')) AS start FROM
    (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?…]+(?:[.!?…]+|$)|[.!?…]+') AS ps FROM documents)))
    WHERE regexp_matches(piece, '^[^.!?…]') AND regexp_matches(piece, '\S'))"""
HEADS = rf"""{OFFSETS},
plain AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
placed AS (SELECT doc_id, regexp_replace(line, '^\s+|\s+$', '', 'g') AS raw, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_pos FROM plain),
named AS (SELECT doc_id, char_pos, raw, CASE WHEN regexp_matches(raw, '(?i)^licensed under (the|cc)[^\n]*$') THEN 'BOOK' WHEN regexp_matches(raw, '(?i)^this work is licensed under (the|a|cc)[^\n]*$') THEN 'PART' END AS kind,
    lower(regexp_extract(raw, '(?i)^(?:this work is )?licensed under (the|cc|a)', 1)) AS w FROM placed),
points AS (SELECT doc_id, kind, {ORDINAL} AS id, upper(raw[1]) || lower(string_split(raw, ' ')[1][2:]) || ' ' || w AS name, char_pos FROM named WHERE kind IS NOT NULL),
landed AS (SELECT p.*, coalesce(o.sent_id, 0) AS sid FROM points p ASOF LEFT JOIN offsets o ON p.doc_id = o.doc_id AND p.char_pos >= o.start),
heads AS MATERIALIZED (SELECT * FROM landed WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, kind, id ORDER BY sid, char_pos) = 1),
known AS MATERIALIZED (SELECT o.doc_id, max(o.sent_id) AS last, coalesce(max(n_books), 0) AS n_books, coalesce(max(n_parts), 0) AS n_parts FROM offsets o
    LEFT JOIN (SELECT doc_id, count(*) FILTER (kind = 'BOOK') AS n_books, count(*) FILTER (kind = 'PART') AS n_parts FROM heads GROUP BY 1) c USING (doc_id) GROUP BY 1),
ruled AS MATERIALIZED (SELECT h.*, last, coalesce(min(CASE kind WHEN 'BOOK' THEN sid END) OVER later, last + 1) AS next_book, coalesce(min(CASE kind WHEN 'PART' THEN sid END) OVER later, last + 1) AS next_part,
    coalesce(last_value(CASE kind WHEN 'BOOK' THEN {{'id': id, 'name': name}} END IGNORE NULLS) OVER upto, first_value(CASE kind WHEN 'BOOK' THEN {{'id': id, 'name': name}} END IGNORE NULLS) OVER whole) AS in_book
    FROM heads h JOIN known USING (doc_id) WHERE n_books >= 2 WINDOW later AS (PARTITION BY doc_id ORDER BY sid, kind <> 'BOOK' ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
    upto AS (PARTITION BY doc_id ORDER BY sid, kind <> 'BOOK' ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), whole AS (PARTITION BY doc_id ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
built_books AS MATERIALIZED (SELECT doc_id, id AS book_id, name AS book_name, least(last, CASE WHEN next_part < next_book THEN next_part ELSE sid END + 1) AS start_sent, greatest(0, next_book - 1) AS end_sent FROM ruled WHERE kind = 'BOOK' UNION ALL
    SELECT doc_id, k, 'Book ' || k, min(sent_id), max(sent_id) FROM (SELECT doc_id, sent_id, ntile(4) OVER (PARTITION BY doc_id ORDER BY sent_id)::INT AS k FROM offsets JOIN known USING (doc_id) WHERE n_books < 2) GROUP BY ALL),
built_parts AS MATERIALIZED (SELECT doc_id, id AS part_id, name AS part_name, in_book.id AS book_id, in_book.name AS book_name, least(last, sid + 1) AS start_sent, greatest(0, least(next_part, next_book) - 1) AS end_sent FROM ruled WHERE kind = 'PART' UNION ALL
    SELECT doc_id, k, 'Part ' || k, NULL, NULL, min(sent_id), max(sent_id) FROM (SELECT doc_id, sent_id, ntile(8) OVER (PARTITION BY doc_id ORDER BY sent_id)::INT AS k FROM offsets JOIN known USING (doc_id) WHERE n_books < 2 OR n_parts = 0) GROUP BY ALL)"""


def _with(chain: str, select: str) -> str:
    """A select over the bench analysis' steps and further ones."""
    base = sql(select)
    return f"WITH {chain},\n{base.removeprefix('WITH ')}" if base.startswith("WITH ") else f"WITH {chain}\n{base}"


CHECKS = {
    "sentences": "(SELECT count(*) FROM sents)", "headings": "(SELECT count(*) FROM headings)", "markers_total": "(SELECT count(*) FROM markers)", "phrase_markers": "(SELECT count(*) FROM markers WHERE unit_type = 'PHRASE')",
    "duplicate_marker_id": "(SELECT count(*) - count(DISTINCT marker_id) FROM markers)", "duplicate_unit": "(SELECT count(*) - count(DISTINCT (unit_type, unit_norm)) FROM markers)", "empty_microtheme": "(SELECT count(*) FROM markers WHERE trim(microtheme) = '')",
    "empty_phrase_family": "(SELECT count(*) FROM markers WHERE trim(phrase_family) = '')", "unknown_precision_level": "(SELECT count(*) FROM markers WHERE precision_level NOT IN ('CORE', 'EXTENDED', 'EXPERIMENTAL'))",
    **{f"level_{x.lower()}": f"(SELECT count(*) FROM markers WHERE precision_level = '{x}')" for x in ("CORE", "EXTENDED", "EXPERIMENTAL")},
}
COUNTERS = {
    "markers_count": CHECKS["markers_total"], "phrase_markers_count": CHECKS["phrase_markers"], "core_markers_count": CHECKS["level_core"], "extended_markers_count": CHECKS["level_extended"], "experimental_markers_count": CHECKS["level_experimental"],
    "hits_total_raw": "(SELECT count(*) FROM tagged)", "hits_counted_main": "(SELECT count(*) FROM counted)",
}
BAD = "(regexp_matches(c, '^(duplicate|empty|unknown)') AND n > 0) OR (c = 'sentences' AND n < 10)"
PICKED = [(lem.lower(), surf.lower(), reason or "EXCLUSION_TABLE") for _, lem, surf, regex, reason, enabled in P.LATIN_EXCLUSIONS if enabled.lower() in ("1", "true", "yes") and regex != "("]
OPTIONS = {"link_mode": "WIDE", "names": "Onon,Orre,That,Eriner,Thon,With", "levels": "CORE", "overlap_mode": "keep_all", "phrase_gap": "2", "rest": "corpus_path"}
LATIN1 = r"regexp_replace(coalesce(text, ''), '[^\x00-\xff]', '?', 'g')"

ORACLE_SQL: dict[str, str] = {
    "encoding_fallback": f"SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') ELSE {LATIN1} END) AS digest, CASE WHEN doc_id % 2 = 0 OR NOT regexp_matches({LATIN1}, '[^\\x00-\\x7f]') THEN 'utf-8' ELSE 'latin-1' END AS encoding FROM documents",
    "table_and_mirror": "SELECT source, count(*) AS n, count(*)::VARCHAR AS as_text FROM documents GROUP BY source",
    "workbook_sheets": "SELECT 'sources' AS sheet, source AS name, count(*) AS n, true AS has_xlsx FROM documents GROUP BY source UNION ALL SELECT 'languages', lang, count(*), true FROM documents GROUP BY lang",
    "word_list_file": f"SELECT unnest([{', '.join(map(quoted, ('# words', *P.LATIN_LISTED[1:])))}]) AS value",
    "csv_flexible": "SELECT * FROM (VALUES ('тема', '1'), ('ясность; память', '2')) AS v(canonical, n)",
    "exclusions_file": values(tuple(PICKED), "lemma, surface, reason"),
    "clean_output": "SELECT true AS before, false AS after",
    "config_options": values(tuple(OPTIONS.items()), "option, value"),
    "run_metadata": sql(" UNION ALL ".join(f"SELECT '{k}' AS counter, {v}::BIGINT AS n" for k, v in COUNTERS.items())),
    "segments_headings": f"WITH {HEADS}\nSELECT doc_id, kind, id, name, char_pos, sid FROM heads",
    "segments_books": f"WITH {HEADS}\nSELECT * FROM built_books",
    "segments_parts": f"WITH {HEADS}\nSELECT * FROM built_parts",
    "segments_of_documents": _with(
        HEADS, "SELECT hit_id, coalesce(b.book_id, -1) AS book_id, coalesce(b.book_name, 'UNKNOWN') AS book, coalesce(q.part_id, -1) AS part_id, coalesce(q.part_name, 'UNKNOWN') AS part FROM hits h LEFT JOIN built_books b ON b.doc_id = h.doc_id AND h.sent_id BETWEEN b.start_sent AND b.end_sent LEFT JOIN built_parts q ON q.doc_id = h.doc_id AND h.sent_id BETWEEN q.start_sent AND q.end_sent",
    ),
    "validate_registry": sql(f"SELECT CASE WHEN {BAD} THEN 'WARN' ELSE 'OK' END AS level, c AS check, n FROM ({' UNION ALL '.join(f"SELECT '{k}' AS c, {v}::BIGINT AS n" for k, v in CHECKS.items())})"),
}
