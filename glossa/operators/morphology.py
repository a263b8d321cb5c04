"""A morphological dictionary as a table: lemmas and tags of forms, and guesses for forms that it doesn't have.

A dictionary has a row for each parse of a form: (form, lemma, tags, weight). Forms may be millions; they are joined to
the different words of a corpus, never put into a plan. Of several parses the one of most weight is best, ties by lemma
and tags. A word that isn't in the dictionary is parsed as most of the dictionary's forms with its longest known ending
are; one without a known ending is its own lemma.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import text as T

FORMS = "form string, lemma string, tags string, weight long"
#: Longest endings that guesses go by, and forms that an ending's rule must be seen in.
ENDING, SEEN = 5, 3
UNKNOWN = "UNK"
#: The tag of imperatives.
IMPERATIVE = "impr"
#: Most words whose answers are broadcast: the commonest ones. Any other is less than one in so many of all tokens.
COMMON = 2**16


def dictionary(rows: DataFrame) -> DataFrame:
    """FORMS from rows with form and lemma, and tags and weight or not: plain lower case, one row for each parse, weights added up. Rows without a form or lemma go; absent tags are UNK, absent weights 1."""
    tags = F.coalesce(F.nullif(T.strip("tags"), F.lit("")), F.lit(UNKNOWN)) if "tags" in rows.columns else F.lit(UNKNOWN)
    weight = F.coalesce(F.col("weight").cast("long"), F.lit(1)) if "weight" in rows.columns else F.lit(1)
    plain = rows.select(T.strip(T.plain_lower("form")).alias("form"), T.strip(T.plain_lower("lemma")).alias("lemma"), tags.alias("tags"), weight.cast("long").alias("weight"))
    return plain.where((F.col("form") != "") & (F.col("lemma") != "")).groupBy("form", "lemma", "tags").agg(F.sum("weight").alias("weight"))


def words(sents: DataFrame) -> DataFrame:
    """(word, n): the different tokens of sentences in plain lower case, and how often each stands there."""
    each = F.explode(F.coalesce("tokens", F.array().cast("array<string>")))  # of a bare column a filter would be derived, which splits texts again
    return sents.select(each.alias("word")).groupBy(T.plain_lower("word").alias("word")).agg(F.count("*").alias("n"))


def common_prefix(a: Column, b: Column) -> Column:
    """The number of leading characters that both have."""
    shorter = F.least(F.length(a), F.length(b))
    grow = lambda n, i: F.when((n == i - 1) & (F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)), i).otherwise(n)
    return F.when(shorter == 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), F.lit(0), grow))


def ending_rules(forms: DataFrame, longest: int = ENDING, seen: int = SEEN) -> DataFrame:
    """(ending, cut, added, tags, n): how words with an ending get their lemma, the best rule of each ending: `cut` characters go, `added` come in their place. A rule's cut lies within its ending, and a word is longer than it."""
    placed = forms.withColumn("same", common_prefix(F.col("form"), F.col("lemma")))
    placed = placed.withColumns({"cut": F.length("form") - F.col("same"), "added": F.expr("substring(lemma, same + 1)")})
    sizes = F.sequence(F.greatest(F.col("cut"), F.lit(1)), F.least(F.lit(longest), F.length("form") - 1))
    # No filter, which would be pushed below the counts that forms come from and be tried on each of their tokens.
    able = F.greatest(F.col("cut"), F.lit(1)) <= F.least(F.lit(longest), F.length("form") - 1)
    each = F.explode(F.coalesce(F.when(able, sizes), F.array().cast("array<int>")))
    rules = placed.select(each.alias("size"), "form", "cut", "added", "tags").groupBy(F.expr("right(form, size)").alias("ending"), "cut", "added", "tags").agg(F.count("*").alias("n")).where(F.col("n") >= seen)
    best = Window.partitionBy("ending").orderBy(F.desc("n"), "cut", "added", "tags")
    return rules.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


PARSE = "struct<less:bigint,lemma:string,tags:string>"


def analyse(found: DataFrame, forms: DataFrame, rules: DataFrame, longest: int = ENDING) -> DataFrame:
    """found (word, n) with the best lemma and its tags, all_tags (those of all parses, joined by blanks), and how: `dictionary`, `ending` or `itself`.

    Words and forms are each different, so no key of these joins is frequent; endings are few and Spark may broadcast their rules.
    """
    parses = forms.groupBy("form").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("less"), "lemma", "tags"))).alias("parses"))
    met = found.join(parses, F.col("word") == F.col("form"), "left").drop("form")
    # One chain, so that the words are found once: a known word has one row without an ending, which meets no rule. Such rows have keys of their own, so that they don't gather in one task.
    sizes = F.when(F.col("parses").isNull() & (F.length("word") > 1), F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(longest), F.length("word") - 1))))
    ends = met.select("word", "n", "parses", F.explode_outer(sizes).alias("size")).withColumn("_ending", F.coalesce(F.expr("right(word, size)"), F.concat(F.lit("\0"), "word")))
    ruled = ends.join(rules.select("ending", F.struct("cut", "added", "tags").alias("_rule")), F.col("_ending") == F.col("ending"), "left")
    each = ruled.groupBy("word", "n", "parses").agg(F.max_by("_rule", F.when(F.col("_rule").isNotNull(), F.col("size"))).alias("rule"))
    known, guessed, best = F.col("parses").isNotNull(), F.col("rule").isNotNull(), F.col("parses")[0]
    lemma = F.when(known, best["lemma"]).when(guessed, F.concat(F.expr("left(word, length(word) - rule.cut)"), F.col("rule.added"))).otherwise(F.col("word"))
    tags = F.coalesce(best["tags"], "rule.tags", F.lit(UNKNOWN))
    all_tags = F.when(known, F.array_join(F.array_distinct(F.transform("parses", lambda x: x["tags"])), " ")).otherwise(tags)
    return each.select("word", "n", lemma.alias("lemma"), tags.alias("tags"), all_tags.alias("all_tags"), F.when(known, "dictionary").when(guessed, "ending").otherwise("itself").alias("how"))


Answer = Callable[[DataFrame], DataFrame]


def common_answers(found: DataFrame, answer: Answer) -> DataFrame:
    """(word, answer) of the at most COMMON commonest of the words found (word, n), a local table. The counts are held only until they are chosen."""
    counts = found.select("word", "n").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        least, held = 0, 0
        for n, words_of in sorted(((r[0], r[1]) for r in counts.groupBy("n").count().collect()), reverse=True):
            held += words_of
            if held > COMMON:
                least = n
                break
        chosen = _answers(answer(counts.where(F.col("n") > least)))
        return F.broadcast(chosen.sparkSession.createDataFrame(chosen.toArrow(), chosen.schema))
    finally:
        counts.unpersist()


def _answers(analyses: DataFrame) -> DataFrame:
    return analyses.select("word", F.struct("lemma", F.col("all_tags").alias("tags")).alias("answer"))


def told(sents: DataFrame, found: DataFrame, answer: Answer) -> DataFrame:
    """(doc_id, sent_id, told, rows): the answers (at, lemma, tags) for each token of a sentence in order, and how many rows of sents it has. found: words() of sents; answer: an analyse() of words. Tokens without an analysis keep their plain lower case; sentences without an id are told nothing.

    Sentences are dealt out once, with their tokens in one row. Common words are answered where they lie; only the others'
    tokens are shuffled as rows of their own, to their words and back.
    """
    # A sentence's key is a struct, which is never null: of plain ones Spark would filter one side's keys below the sentences, which then were dealt out twice.
    key = F.struct("doc_id", "sent_id").alias("key")
    dealt = sents.select(key, "tokens").repartition("key")
    each = dealt.select("key", F.posexplode_outer("tokens").alias("at", "token")).select("key", "at", T.plain_lower("token").alias("word"))
    met = each.join(common_answers(found, answer), "word", "left")
    got = lambda word: F.struct("at", F.coalesce("answer.lemma", word).alias("lemma"), F.coalesce("answer.tags", F.lit(UNKNOWN)).alias("tags"))
    near = met.groupBy("key").agg(F.collect_list(F.when(F.col("answer").isNotNull(), got("word"))).alias("_near"), F.count_if(F.coalesce(F.col("at") == 0, F.lit(True))).alias("rows"))
    rare = met.where(F.col("answer").isNull() & F.col("word").isNotNull()).select("key", "at", "word")
    rest = _answers(answer(rare.groupBy("word").agg(F.count("*").alias("n"))))
    far = rare.join(rest, "word", "left").groupBy("key").agg(F.collect_list(got("word")).alias("_far"))
    both = F.when(F.col("_far").isNull(), F.col("_near")).otherwise(F.concat("_near", "_far"))
    named = F.col("key.doc_id").isNotNull() & F.col("key.sent_id").isNotNull()
    return near.join(far, "key", "left").select("key.*", F.sort_array(F.when(named, both).otherwise(F.slice("_near", 1, 0))).alias("told"), "rows")


def lemmatised(sents: DataFrame, analyses: DataFrame) -> DataFrame:
    """sents with `lemmas` from the analyses, and `tags`: all tags of each token. Tokens without an analysis keep their plain lower case."""
    back = told(sents, analyses, lambda found: analyses.join(found.select("word"), "word", "left_semi")).drop("rows")
    nothing = F.array().cast("array<string>")
    joined = sents.drop("lemmas", "tags").join(back, ["doc_id", "sent_id"], "left")
    return joined.withColumns({"lemmas": F.coalesce(F.transform("told", lambda x: x["lemma"]), nothing), "tags": F.coalesce(F.transform("told", lambda x: x["tags"]), nothing)}).drop("told")


def has_tag(tags: str | Column, tag: str) -> Column:
    """Whether any token's parse has the tag; tags of a parse are joined by commas, parses by blanks."""
    return F.exists(T.col(tags), lambda t: t.rlike(f"(?:^|[ ,]){T.escape(tag)}(?:$|[ ,])"))


def lemma_column(rows: DataFrame, unit: str, out: str, forms: DataFrame, rules: DataFrame) -> DataFrame:
    """rows with the lemma of the word in column `unit`, for lexicon units; null units have none."""
    keyed = rows.withColumn("_word", T.strip(T.plain_lower(unit)))
    found = analyse(keyed.where(F.col("_word").isNotNull()).groupBy(F.col("_word").alias("word")).agg(F.count("*").alias("n")), forms, rules)
    return keyed.join(found.select(F.col("word").alias("_word"), F.col("lemma").alias("_found")), "_word", "left").withColumn(out, F.col("_found")).drop("_word", "_found")


def derived(found: DataFrame, endings: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """FORMS from the words (word, n) of a corpus and endings (ending, added, tags): each word is a form of itself (BASE), and of a word that it is with its ending taken off and `added` put on, if the corpus has that; the weight is that word's n."""
    table = F.array(*[F.struct(F.lit(e).alias("ending"), F.lit(a).alias("added"), F.lit(t).alias("tags")) for e, a, t in endings])
    cut = found.select(F.col("word").alias("form"), F.explode(table).alias("e")).where(F.expr("endswith(form, e.ending) AND length(form) > length(e.ending) + 1"))
    cut = cut.select("form", F.expr("concat(left(form, length(form) - length(e.ending)), e.added)").alias("lemma"), F.col("e.tags").alias("tags"))
    inflected = cut.join(found.select(F.col("word").alias("lemma"), F.col("n").alias("weight")), "lemma").select("form", "lemma", "tags", "weight")
    return inflected.unionByName(found.select(F.col("word").alias("form"), F.col("word").alias("lemma"), F.lit("BASE").alias("tags"), F.col("n").alias("weight")))
