"""Streams of documents. A document comes whole, in one row, so that all analysis of it is local to its micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glossa.operators import matching, texts
from glossa.plans.analysis import Analysis, Sources
from glossa.plans.profile import Profile


def word_hits(stream: DataFrame, markers: DataFrame, rules: list[dict[str, str]], p: Profile) -> DataFrame:
    """Single-word hits of a stream (doc_id, text): stateless, a join of the stream with the static registry."""
    sents = texts.sentences(stream, p)
    words = markers.where("unit_type = 'WORD'").select("marker_id", F.col("unit_norm").alias("target_lemma"))
    each = sents.select("doc_id", "sent_id", "sent_text", "tokens", F.posexplode("lemmas").alias("token_idx", "target_lemma")).join(words, "target_lemma")
    each = each.withColumn("target_surface", F.element_at("tokens", F.col("token_idx") + 1))
    reason = matching.noise_reason(F.col("target_lemma"), F.col("target_surface"), F.col("sent_text"), rules, p)
    return each.select("doc_id", "sent_id", "token_idx", "marker_id", "target_lemma", "target_surface", F.coalesce(reason, F.lit("")).alias("noise_reason"))


def marker_counts(hits: DataFrame, ts: str, late: str, window: str) -> DataFrame:
    """Hits by marker in tumbling windows of event time; events later than `late` are left out."""
    return hits.withWatermark(ts, late).groupBy(F.window(ts, window), "marker_id").agg(F.count("*").alias("count"))


def tag_stream(stream: DataFrame, sources: Sources, p: Profile, out: str, checkpoint: str) -> StreamingQuery:
    """Tagged hits of every micro-batch of documents, a Parquet folder for each batch; a batch that is run again writes the same folder, so none is there twice."""

    def batch(docs: DataFrame, number: int) -> None:
        from dataclasses import replace

        Analysis(replace(sources, docs=docs), p, keep=False).tagged.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
