"""A training corpus from documents: five stages, each written as Parquet and read again as the next one's documents.

All stages but the last return the columns of their documents, whatever these are called; only `text` and `n_chars` (if
it is there) change. A null text counts as empty and stays null; rows that repeat an id are judged each, but for the
near-duplicate stage, where equal rows are one; rows with a null id are never dropped as copies; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import op02_lines, op05_simhash, op06_toxicity, op08_packing, op09_secrets
from glossa.llm.common import materialise, scratch, table

#: A name that no column of documents has.
TOXICITY = "_toxicity_of_stage"


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now; null for a null text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def _whole(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7, empty ones included; the counts are of these documents, the labels of the labels table. Rows of one id and text score alike."""
    model = op06_toxicity.fit(_whole(docs), table(spark, sf_dir, "labels"))
    return op06_toxicity.score(docs, model, TOXICITY).where(F.col(TOXICITY) < 0.7).drop(TOXICITY)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of later copies of repeated runs (by id, then text hash). Equal rows count as one document and lose the same lines; null and empty texts have none."""
    return _sized(op02_lines.dedup_lines(docs, counts=False))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, a Jaccard similarity of 0.8): the one of the smallest id, then text hash. Texts without words are one group; rows without an id all stay."""
    return op05_simhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what looks like a secret masked by its kind; null texts stay null."""
    return _sized(op09_secrets.redact_texts(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids with their places in sequences: an empty or null text is one piece with the end id alone; each of repeated rows is packed; equal lengths go by id."""
    return op08_packing.pack_pieces(op08_packing.pieces(_whole(docs)))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't express the models, fingerprints and tokens of these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents table. What a stage writes on its way is deleted once its result stands."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark, "items"):
        for name, stage in STAGES[:-1]:
            with scratch(spark, name):
                docs = materialise(stage(spark, docs, sf_dir), name)
        return STAGES[-1][1](spark, docs, sf_dir)
