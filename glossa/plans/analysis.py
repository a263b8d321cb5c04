"""A whole analysis as DataFrames: documents and lexicon in, tagged hits out."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.operators import lexicon, matching, morphology, stats, tagging, texts
from glossa.plans import profile as P
from glossa.plans.profile import Profile


@dataclass
class Sources:
    """Input tables of a project."""

    docs: DataFrame  # doc_id, text
    curated: DataFrame
    listed: DataFrame  # ord, value
    phrases: DataFrame
    themes: DataFrame
    exclusions: DataFrame
    parts: DataFrame | None = None
    books: DataFrame | None = None
    forms: DataFrame | None = None  # a morphological dictionary: form, lemma, and tags and weight or not


#: What a hit's sentence brings when it is joined.
TEXTS = ["sent_text", "prev_sent_text", "next_sent_text", "context_window"]


@dataclass
class Scopes:
    """Hits, and those of them that tables are counted over."""

    narrow: DataFrame
    p: Profile

    @property
    def counted(self) -> DataFrame:
        return stats.counted(self.narrow, self.p)

    @property
    def clean(self) -> DataFrame:
        return stats.clean(self.narrow)

    @property
    def linked(self) -> DataFrame:
        return stats.linked(self.counted, self.p.link_mode)

    @property
    def strict(self) -> DataFrame:
        return stats.linked(self.counted, "STRICT")

    @property
    def wide(self) -> DataFrame:
        return stats.linked(self.counted, "WIDE")


class Analysis:
    """Lazy: nothing runs until a table is used. With `keep`, for the dozens of tables of a project's run, tagged sentences and tagged hits are kept in memory and on disk (Spark rebuilds lost blocks from their lineage). Without, each table is one pass over the texts that computes what it shows, and nothing is kept."""

    def __init__(self, sources: Sources, p: Profile, max_sents: int | None = None, keep: bool = True):
        self.sources, self.p, self.max_sents, self.keep = sources, p, max_sents, keep
        self._held: list[DataFrame] = []

    def _kept(self, df: DataFrame) -> DataFrame:
        if self.keep:
            self._held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def release(self) -> None:
        """Let go of what is kept."""
        while self._held:
            self._held.pop().unpersist()

    @cached_property
    def headings(self) -> DataFrame:
        return texts.headings(self.sources.docs, self.p)

    @cached_property
    def morphology(self) -> tuple[DataFrame, DataFrame] | None:
        """(forms, rules of endings), if the sources have a dictionary."""
        if self.sources.forms is None:
            return None
        forms = self._kept(morphology.dictionary(self.sources.forms))
        return forms, self._kept(morphology.ending_rules(forms))

    @property
    def _lemmas(self) -> lexicon.Lemmas | None:
        return self.morphology and (lambda rows, unit, out: morphology.lemma_column(rows, unit, out, *self.morphology))

    def _split(self, beside=None) -> DataFrame:
        found = texts.sentences(self.sources.docs, self.p, self.max_sents, beside)
        if self.morphology:
            found = morphology.lemmatised(found, self._kept(morphology.analyse(morphology.words(found), *self.morphology)))
        return found

    @cached_property
    def plain(self) -> DataFrame:
        """Sentences with tokens and lemmas: nothing but the scan, without a dictionary."""
        return self.sentences if self.keep else self._split()

    @cached_property
    def sentences(self) -> DataFrame:
        """Sentences with contexts and tags. Only contexts need a shuffle, and only where they are asked for."""
        found = self._split(lambda docs: tagging.names_beside(docs, self.p))
        return self._kept(tagging.tagged_sentences(texts.contexts(found, self.p.context_window_sentences), self.p))

    @cached_property
    def markers(self) -> DataFrame:
        s, levels = self.sources, None if self.p.experimental_phrases_in_main_stats else self.p.enabled_precision_levels
        return small(self._kept(lexicon.registry(s.curated, s.listed, s.phrases, s.themes, self.p, levels, self._lemmas)))

    @cached_property
    def all_markers(self) -> DataFrame:
        s = self.sources
        return lexicon.registry(s.curated, s.listed, s.phrases, s.themes, self.p, lemmas=self._lemmas)

    @cached_property
    def rules(self) -> list[dict[str, str]]:
        return matching.enabled_exclusions(self.sources.exclusions)

    @cached_property
    def _matched(self) -> DataFrame:
        return self._matched_in(self.sentences, *tagging.TAGS)

    def _matched_in(self, sents: DataFrame, *carried: str) -> DataFrame:
        tagged = ["tags", "prompted"] if self.morphology else []
        return matching.matched(sents.select("doc_id", "sent_id", "sent_text", "tokens", "lemmas", *tagged, *carried), self.markers, self.rules, self.p, self._kept)

    def with_texts(self, rows: DataFrame) -> DataFrame:
        """rows of hits with their sentence, its neighbours and its context."""
        sents = self.sentences if self.keep else texts.contexts(self.plain, self.p.context_window_sentences)
        return rows.join(sents.select("doc_id", "sent_id", *TEXTS), ["doc_id", "sent_id"])

    def with_texts_of_few(self, rows: DataFrame) -> DataFrame:
        """The same for a bounded sample, which is found first: only its documents are split, and nothing is shuffled but their sentences."""
        few = F.broadcast(rows.sparkSession.createDataFrame(rows.toArrow(), rows.schema))
        docs = self.sources.docs.join(few.select("doc_id").distinct(), "doc_id", "left_semi")
        sents = texts.contexts(texts.sentences(docs, self.p, self.max_sents), self.p.context_window_sentences)
        return sents.select("doc_id", "sent_id", *TEXTS).join(few, ["doc_id", "sent_id"])

    @cached_property
    def found(self) -> DataFrame:
        """Hits with their sentence's tags, before markers' columns, segments and ids: row-local, so that what isn't asked for isn't computed."""
        return tagging.with_prompts(matching.hit_rows(self._matched, self.markers, self.rules, self.p))

    def found_with(self, *columns: str) -> DataFrame:
        """Hits with these columns of their sentences in place of the tags."""
        return matching.hit_rows(self._matched_in(self.sentences, *columns), self.markers, self.rules, self.p)

    def numbered(self, *tags: str) -> DataFrame:
        """Hits with hit_id and these of their tags."""
        return matching.numbered(self.found.drop(*[c for c in tagging.TAGS if c not in tags]), matching.order_of(self.p), "hit_id").drop("marker_ord")

    @cached_property
    def hits(self) -> DataFrame:
        """Hits before markers' columns, tags and segments, without texts."""
        return self.numbered()

    @cached_property
    def nested(self) -> DataFrame:
        """Dropped phrase candidates, without texts."""
        return matching.numbered(self.dropped, matching.NESTED_ORDER, "candidate_id")

    @cached_property
    def dropped(self) -> DataFrame:
        """Dropped phrase candidates without ids."""
        return matching.dropped_rows(self._matched, self.markers, self.p)

    def placed(self, hits: DataFrame) -> DataFrame:
        """hits with their markers' columns and segments."""
        rows = tagging.assign_segments(tagging.merge_meta(hits, self.markers), self.sources.books, "book")
        return stats.reflag_overlaps(tagging.assign_segments(rows, self.sources.parts, "part"), self.p)

    @cached_property
    def narrow(self) -> DataFrame:
        """Hits with all columns but the texts."""
        return self._kept(self.placed(self.numbered(*tagging.TAGS)))

    @cached_property
    def scopes(self) -> Scopes:
        """Hits to be counted: without ids, unless those with ids are kept anyway."""
        return Scopes(self.narrow if self.keep else self.placed(self.found), self.p)

    @cached_property
    def tagged(self) -> DataFrame:
        """Hits with all columns. Where sentences are kept, texts are joined to them; else each hit carries its sentence and the neighbours from its document's row on, so that sentences are found once and only hits are shuffled, to be numbered."""
        if self.keep:
            return self.with_texts(self.narrow)
        radius = self.p.context_window_sentences
        found = self._split(lambda docs: texts.neighbours(tagging.names_beside(docs, self.p), radius, self.max_sents))
        own = ["sent_text", *texts.NEIGHBOURS, *(["context_window"] if radius != 1 else [])]
        tagged = tagging.tagged_sentences(found, self.p).withColumn("_text", F.col("sent_text"))
        hits = matching.hit_rows(self._matched_in(tagged, *tagging.TAGS, "_text", *own[1:]), self.markers, self.rules, self.p)
        ided = matching.numbered(tagging.with_prompts(hits), matching.order_of(self.p), "hit_id").drop("marker_ord")
        rows = texts.told_contexts(self.placed(ided.withColumnRenamed("_text", "sent_text")))
        return rows.select("doc_id", "sent_id", *[c for c in rows.columns if c not in ("doc_id", "sent_id")])

    def first_of(self, chosen: Column, top: int = 25, each: int = 4) -> DataFrame:
        """Hits with all columns but the texts that hold the first `each` chosen hits of each of the `top` markers with most of them. chosen: a condition on a hit, nulls are no.

        One pass over the texts counts hits by document and marker, which is all that is shuffled, kept and, before this
        returns, let go of. The first hits of a marker lie in its first documents; only these, at most top * each, are
        split again, and their ids are places among their own hits plus what the documents before them hold.
        """
        hits = self.placed(self.found)
        counts = hits.groupBy("doc_id", "marker_id").agg(F.count("*").alias("n"), F.count_if(chosen).alias("m")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            most = counts.groupBy("marker_id").agg(F.sum("m").alias("m")).where("m > 0").orderBy(F.desc("m"), "marker_id").limit(top)
            markers = [r[0] for r in most.collect()]
            place = F.row_number().over(Window.partitionBy("marker_id").orderBy("doc_id"))
            first = counts.where(F.col("m") > 0).where(F.col("marker_id").isin(*markers)).withColumn("_at", place).where(F.col("_at") <= each)
            found = {r[0] for r in first.select("doc_id").distinct().collect()}
            ids = sorted(found - {None})
            own = F.coalesce(F.col("doc_id").isin(*ids), F.lit(None in found))
            # By how many of the few documents are at or before a document: what lies between each two of them.
            at = F.size(F.filter(F.lit(ids).cast("array<bigint>"), lambda x: x <= F.col("doc_id")))
            between = {r[0]: r[1] for r in counts.where(~own).groupBy("doc_id").agg(F.sum("n").alias("n")).groupBy(at.alias("at")).agg(F.sum("n")).collect()}
        finally:
            counts.unpersist()
        few = Analysis(replace(self.sources, docs=self.sources.docs.where(own)), self.p, self.max_sents, keep=False)
        few.markers, few.rules, few.morphology = self.markers, self.rules, self.morphology
        before = sum((F.when(F.col("doc_id") >= x, between.get(i, 0)).otherwise(0) for i, x in enumerate(ids)), F.lit(0))
        ided = few.numbered(*tagging.TAGS).withColumn("hit_id", F.col("hit_id") + F.coalesce(before, F.lit(0)))
        return self.placed(ided).where(chosen).where(F.col("marker_id").isin(*markers))

    @property
    def counted(self) -> DataFrame:
        return Scopes(self.narrow, self.p).counted

    @property
    def clean(self) -> DataFrame:
        return Scopes(self.narrow, self.p).clean

    @property
    def linked(self) -> DataFrame:
        return Scopes(self.narrow, self.p).linked

    @property
    def strict(self) -> DataFrame:
        return Scopes(self.narrow, self.p).strict

    @property
    def wide(self) -> DataFrame:
        return Scopes(self.narrow, self.p).wide


#: Most rows of a registry that is sent to all executors.
SMALL = 50_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """A table of at most `most` rows as a local one that joins broadcast; a larger one as it is, and Spark chooses its joins."""
    if df.limit(most + 1).count() > most:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(df.toArrow(), df.schema))


def rows(spark: SparkSession, values: tuple, schema: str) -> DataFrame:
    """A local table, whose size Spark knows when it plans joins."""
    names = [c.strip().split(" ") for c in schema.split(",")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    columns = list(zip(*values, strict=True)) if values else [()] * len(names)
    return spark.createDataFrame(pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(names, columns, strict=True)}))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a table of fewer splits than cores is dealt out, since text work is bound by CPUs. A large table is left as it is scanned."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


CURATED = "id string, microtheme string, unit string, unit_type string, comment string"
PHRASES = "id string, phrase_text string, pattern_lemmas string, microtheme string, phrase_family string, precision_level string, source_type string, enabled string, risk_comment string, comment string"
THEMES = "canonical_microtheme string, aliases string"
EXCLUSIONS = "id string, lemma string, surface string, regex string, reason string, enabled string"
PARTS = "part_id int, part_name string, book_id int, book_name string, start_sent int, end_sent int"
BOOKS = "book_id int, book_name string, start_sent int, end_sent int"


def latin_sources(spark: SparkSession, docs: DataFrame) -> Sources:
    """The bench profile's lexicon over any documents."""
    listed = rows(spark, tuple(enumerate(P.LATIN_LISTED)), "ord int, value string")
    return Sources(
        docs, rows(spark, P.LATIN_CURATED, CURATED), listed, rows(spark, P.LATIN_PHRASES, PHRASES), rows(spark, P.LATIN_THEMES, THEMES), rows(spark, P.LATIN_EXCLUSIONS, EXCLUSIONS),
        rows(spark, P.LATIN_PARTS, PARTS), rows(spark, P.LATIN_BOOKS, BOOKS),
    )


def bench_profile() -> Profile:
    """Experimental phrases stay in the registry, so that every table has rows; they are still filtered by level."""
    return replace(P.LATIN, experimental_phrases_in_main_stats=True, link_mode="WIDE")


_analyses: dict[tuple[str, str], Analysis] = {}


def forget(spark: SparkSession) -> None:
    """Let go of the analysis that queries share: the next query starts cold."""
    for (app, _), held in _analyses.items():
        if app == spark.sparkContext.applicationId:
            held.release()
    _analyses.clear()


def bench_analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    """One analysis at a time, of the last application and folder asked for, so that queries share what they have in common."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _analyses:
        forget(spark)
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        _analyses[key] = Analysis(latin_sources(spark, spread(docs)), bench_profile(), keep=False)
    return _analyses[key]
