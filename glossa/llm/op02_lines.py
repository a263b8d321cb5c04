"""Query op2: line dedup by a suffix array over line ids, built by distributed prefix doubling.

Lines that aren't blank get ids; a document's ids are a sequence. Ranks of suffixes at depth 1 are the order of the
line ids; ranks at depth 2d are the order of the pairs (rank at depth d here, rank at depth d, d lines on). The
different pairs are counted before they are sorted, so a line or run that is everywhere is one row of the sort. A
suffix that is alone at a depth has no repeated run of that length: its place in the suffix array is settled and it
leaves the doubling, which goes on until no rank is shared.

The suffixes that share a rank at depth d are an interval of the suffix array whose longest common prefix is d or more:
all but the first of it in corpus order begin a later copy of d lines. A repeated run of any length between d and 2d is
the union of the two copies of d lines at its start and its end, so the deepest interval in which each suffix is a
later copy, at all of a run's suffixes, gives the maximal repeated runs exactly: stretches of lines that some copy's
span reaches.

Later copies are deleted if their run has `min_lines` lines (a power of two) or is a line of `min_chars` code points.
Corpus order is (doc_id, text hash, line). Runs don't cross documents. Blank lines (of spaces, tabs, form feeds and
carriage returns) have no part in runs and stay.

Defined results: null texts are empty; rows of equal id and text count as one document and get the same result; a
null id comes first; extra columns are left alone; no rows give no rows. All steps are built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.llm.common import documents, materialise

ROW = ["_doc", "_hash"]
BLANKS = " \t\r\f\v"


def line_table(docs: DataFrame) -> DataFrame:
    """(_doc, _hash, line, seq, long, h1, h2): the lines of each document that aren't blank, numbered in all (line) and among themselves (seq), with a 128-bit id."""
    rows = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_hash"), "text").select(*ROW, F.posexplode(F.split("text", "\n")).alias("line", "content"))
    rows = rows.where(F.trim("content", F.lit(BLANKS)) != "")
    rows = rows.select(*ROW, "line", F.length("content").alias("long"), F.xxhash64("content").alias("h1"), F.xxhash64(F.lit(1), "content").alias("h2")).distinct()
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(*ROW).orderBy("line")))


def ranked(suffixes: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """The suffixes whose keys are shared, with their rank in the order of the keys and the first of them in corpus order. Ranks rise with the keys: they are ids of a global sort, kept in the shared folder."""
    first = F.min(F.struct(*ROW, "seq")).alias("first")
    shared = suffixes.groupBy(*keys).agg(F.count("*").alias("n"), first).where(F.col("n") > 1).select(*keys, "first")
    table = materialise(shared.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()), f"ranks{depth}")
    kept = suffixes.join(table, keys).select(*ROW, "seq", "line", "long", "rank", (F.struct(*ROW, "seq") != F.col("first")).alias("later"))
    return materialise(kept, f"suffixes{depth}")


def suffix_levels(lines: DataFrame) -> list[tuple[int, DataFrame]]:
    """(depth, suffixes that share their first `depth` lines with another, with rank and later), for depths 1, 2, 4, ... until no rank is shared: the last one is empty."""
    depth, now = 1, ranked(lines, ["h1", "h2"], 1)
    levels = [(1, now)]
    while not now.isEmpty():
        ahead = Window.partitionBy(*ROW).orderBy("seq").rangeBetween(depth, depth)
        pairs = now.withColumn("next", F.first("rank").over(ahead)).where(F.col("next").isNotNull())
        depth *= 2
        now = ranked(pairs.select(*ROW, "seq", "line", "long", F.col("rank").alias("here"), "next"), ["here", "next"], depth)
        levels.append((depth, now))
    return levels


def copied_spans(levels: list[tuple[int, DataFrame]]) -> DataFrame:
    """(_doc, _hash, seq, line, long, copied): for each suffix that begins a later copy, the depth of the deepest interval in which it is one."""
    every = None
    for depth, level in levels:
        if depth == 1 or not level.isEmpty():
            rows = level.where("later").select(*ROW, "seq", "line", "long", F.lit(depth).alias("copied"))
            every = rows if every is None else every.unionByName(rows)
    return every.groupBy(*ROW, "seq", "line", "long").agg(F.max("copied").alias("copied"))


def repeated_runs(docs: DataFrame, min_lines: int = 2, min_chars: int = 40) -> DataFrame:
    """(_doc, _hash, seq, line, run) of all lines of later copies: run numbers the maximal runs of a document."""
    if min_lines & (min_lines - 1):
        raise ValueError("min_lines must be a power of two")
    lines = materialise(line_table(docs), "lines")
    levels = suffix_levels(lines)
    spans = copied_spans(levels).where((F.col("copied") >= min_lines) | (F.col("long") >= min_chars))
    # A copy too short to count as a run covers its line alone.
    reach = F.when(F.col("copied") >= min_lines, F.col("copied")).otherwise(1)
    ends = spans.select(*ROW, "seq", (F.col("seq") + reach).alias("end"))
    by = Window.partitionBy(*ROW).orderBy("seq")
    far = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    covered = levels[0][1].select(*ROW, "seq", "line").join(ends, [*ROW, "seq"], "left").withColumn("far", far).where(F.col("far") > F.col("seq"))
    starts = (F.coalesce(F.lag("seq").over(by), F.lit(-1)) != F.col("seq") - 1).cast("long")
    return covered.withColumn("start", starts).withColumn("run", F.sum("start").over(by)).select(*ROW, "seq", "line", "run")


def dedup_lines(docs: DataFrame, min_lines: int = 2, min_chars: int = 40, counts: bool = True) -> DataFrame:
    """docs with `text` cut. counts: n_lines, n_removed and n_runs (maximal deleted runs) are added; columns of these names are replaced. Without, all columns stay as they are but for the text."""
    docs = docs.drop("n_lines", "n_removed", "n_runs") if counts else docs
    fields = [f"f{i}" for i in range(len(docs.columns))]
    gone = repeated_runs(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), min_lines, min_chars)
    by_doc = gone.groupBy(*ROW).agg(F.collect_set("line").alias("_gone"), F.max("run").alias("_runs"))
    rows = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"), *[F.col(f"`{c}`").alias(f) for c, f in zip(docs.columns, fields, strict=True)]).withColumn("_texthash", F.xxhash64("_text"))
    same = rows["_id"].eqNullSafe(by_doc["_doc"]) & (rows["_texthash"] == by_doc["_hash"])
    rows = rows.join(by_doc, same, "left").withColumn("_lines", F.split("_text", "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    old = F.col(fields[docs.columns.index("text")])
    text = F.when(F.col("_gone").isNull(), old).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at("_lines", i + 1)), "\n"))
    out = [(text if c == "text" else F.col(f)).alias(c) for c, f in zip(docs.columns, fields, strict=True)]
    if counts:
        removed = F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone"))
        out += [F.size("_lines").cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), F.coalesce("_runs", F.lit(0)).cast("long").alias("n_runs")]
    return rows.select(*out)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents; the cases are those of this module."""
    found = dedup_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("text", 256).alias("kept_sha256"))


#: The same rows by plain windows: first occurrences of lines and of pairs of lines.
ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS content, generate_subscripts(ls, 1) - 1 AS line FROM d),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS seq FROM l WHERE trim(content, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
p AS (SELECT *, lead(content) OVER (PARTITION BY doc_id ORDER BY seq) AS following FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, seq) > 1 AS later,
      following IS NOT NULL AND row_number() OVER (PARTITION BY content, following ORDER BY doc_id, seq) > 1 AS later2 FROM p),
g AS (SELECT *, (later AND length(content) >= 40) OR later2 OR coalesce(lag(later2) OVER (PARTITION BY doc_id ORDER BY seq), false) AS gone FROM f),
h AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY seq), false) AS start FROM g),
m AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (start) AS n_runs FROM h GROUP BY doc_id),
k AS (SELECT l.doc_id, string_agg(l.content, chr(10) ORDER BY l.line) AS kept FROM l LEFT JOIN h USING (doc_id, line) WHERE NOT coalesce(h.gone, false) GROUP BY l.doc_id)
SELECT d.doc_id, len(ls)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)
"""
