"""Books and parts as sentence intervals, built from headings or of equal size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators.texts import lines, sentence_offsets
from glossa.plans.profile import Profile


def line_headings(docs: DataFrame, p: Profile) -> DataFrame:
    """(doc_id, kind BOOK or PART, id, name, char_pos) of the lines that are a book's or a part's heading with a known ordinal."""
    rows = lines(docs).withColumn("raw", T.strip("line"))
    table = F.create_map(*[F.lit(x) for k, v in p.ordinals.items() for x in (k, v)])

    def of(pattern: str, kind: str) -> Column:
        word = F.lower(F.regexp_extract("raw", f"(?iud)^(?:{pattern})$", 1))
        title = F.initcap(F.lower(F.element_at(F.split("raw", r"\s+"), 1)))
        return F.when(T.matches("raw", f"^(?:{pattern})$"), F.struct(F.lit(kind).alias("kind"), F.try_element_at(table, word).alias("id"), F.concat(title, F.lit(" "), word).alias("name")))

    found = rows.withColumn("h", F.coalesce(of(p.book_heading, "BOOK"), of(p.part_heading, "PART"))).where(F.col("h.id").isNotNull())
    return found.select("doc_id", "h.*", "char_pos")


def char_to_sentence(points: DataFrame, offsets: DataFrame) -> DataFrame:
    """points with sid: the last sentence that starts at or before char_pos, else 0. An as-of join by one sort of both within the document."""
    w = Window.partitionBy("doc_id").orderBy("at", F.col("sid").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    names = [c for c in points.columns if c not in ("doc_id", "char_pos")]
    marks = offsets.select("doc_id", F.col("start").alias("at"), F.col("sent_id").alias("sid"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in names], F.lit(False).alias("_point"))
    both = marks.union(points.select("doc_id", F.col("char_pos").alias("at"), F.lit(None).cast("int"), *names, F.lit(True)))
    found = both.withColumn("sid", F.coalesce(F.last("sid", ignorenulls=True).over(w), F.lit(0))).where("_point")
    return found.select("doc_id", *names, F.col("at").alias("char_pos"), "sid")


def first_headings(found: DataFrame) -> DataFrame:
    """The first place of each (doc_id, kind, id)."""
    w = Window.partitionBy("doc_id", "kind", "id").orderBy("sid", "char_pos")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def equal_segments(sents: DataFrame, n: int, prefix: str) -> DataFrame:
    """At most n intervals a document of sizes that differ by one at most, the larger first: (doc_id, <prefix>_id, <prefix>_name, start_sent, end_sent)."""
    tile = F.ntile(n).over(Window.partitionBy("doc_id").orderBy("sent_id"))
    rows = sents.select("doc_id", "sent_id", tile.alias(f"{prefix}_id")).groupBy("doc_id", f"{prefix}_id").agg(F.min("sent_id").alias("start_sent"), F.max("sent_id").alias("end_sent"))
    return rows.select("doc_id", f"{prefix}_id", F.concat(F.lit(f"{prefix.capitalize()} "), F.col(f"{prefix}_id")).alias(f"{prefix}_name"), "start_sent", "end_sent")


def build_segments(docs: DataFrame, p: Profile, exclude_headers: bool = True, exclude_epigraph: bool = True) -> tuple[DataFrame, DataFrame]:
    """(books, parts), each with doc_id. Documents with fewer than two book headings get 4 and 8 equal intervals; those without part headings 8 parts."""
    offsets = sentence_offsets(docs, p)
    total = offsets.groupBy("doc_id").agg(F.max("sent_id").alias("last"))
    heads = first_headings(char_to_sentence(line_headings(docs, p), offsets))
    counts = heads.groupBy("doc_id").agg(F.count_if(F.col("kind") == "BOOK").alias("n_books"), F.count_if(F.col("kind") == "PART").alias("n_parts"))
    known = total.join(counts, "doc_id", "left").fillna(0)
    heads = heads.join(known.where("n_books >= 2"), "doc_id")
    skip = int(exclude_headers)
    by_doc = Window.partitionBy("doc_id").orderBy("sid", F.col("kind") != "BOOK")
    after = by_doc.rowsBetween(1, Window.unboundedFollowing)
    upto = by_doc.rowsBetween(Window.unboundedPreceding, 0)
    book = F.when(F.col("kind") == "BOOK", F.struct("sid", "id", "name"))
    part_sid = F.when(F.col("kind") == "PART", F.col("sid"))
    rows = heads.withColumns(
        {
            "next_book": F.coalesce(F.min(F.when(F.col("kind") == "BOOK", F.col("sid"))).over(after), F.col("last") + 1),
            "next_part": F.coalesce(F.min(part_sid).over(after), F.col("last") + 1),
            "in_book": F.coalesce(F.last(book, ignorenulls=True).over(upto), F.first(book, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))),
        }
    )
    opens = F.when((F.col("next_part") < F.col("next_book")) & F.lit(exclude_epigraph), F.col("next_part")).otherwise(F.col("sid"))
    start = lambda c: F.least(F.col("last"), c + skip)
    books = rows.where("kind = 'BOOK'").select("doc_id", F.col("id").alias("book_id"), F.col("name").alias("book_name"), start(opens).alias("start_sent"), F.greatest(F.lit(0), F.col("next_book") - 1).alias("end_sent"))
    parts = rows.where("kind = 'PART'").select(
        "doc_id", F.col("id").alias("part_id"), F.col("name").alias("part_name"), F.col("in_book.id").alias("book_id"), F.col("in_book.name").alias("book_name"), start(F.col("sid")).alias("start_sent"),
        F.greatest(F.lit(0), F.least("next_part", "next_book") - 1).alias("end_sent"),
    )
    plain = offsets.join(known.where("n_books < 2").select("doc_id"), "doc_id", "left_semi")
    partless = offsets.join(known.where("n_books < 2 OR n_parts = 0").select("doc_id"), "doc_id", "left_semi")
    equal_parts = equal_segments(partless, 8, "part").withColumns({"book_id": F.lit(None).cast("int"), "book_name": F.lit(None).cast("string")})
    return books.unionByName(equal_segments(plain, 4, "book")), parts.unionByName(equal_parts.select(parts.columns))
