"""Query op11: a Merkle manifest of a dataset, a tree for each language under one root, with proofs that are tried.

Leaves are hashed where they are scanned; texts are never shuffled. Trees are built and proofs are made by merkle.py.

Defined results: each row is a leaf, repeats included; rows of one language go by doc_id (null first), then leaf digest,
so the trees don't depend on the order of rows; nulls are hashed as `-`; a null language is a tree of its own, the first;
a null doc_id is never tampered with; no rows give no rows; other columns have no part in a leaf.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import merkle
from glossa.llm.common import materialise, remainder, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _spelt(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """The digest of a row's fields with `text` for its text."""
    return F.sha2(F.concat(*(_spelt(F.col(c) if c != "text" else text) for c in FIELDS)).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, digest, tampered, place): tampered is the digest with the text's A-Z in lower case, where crc32 of doc_id is a multiple of 3."""
    lower = leaf_digest(F.translate("text", UPPER, LOWER))
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))  # a null language before all others
    return docs.select(tree.alias("tree"), "doc_id", leaf_digest(F.col("text")).alias("digest"), F.when(remainder("doc_id", 3) == 0, lower).alias("tampered"), F.monotonically_increasing_id().alias("place"))


def manifest(docs: DataFrame, finish: merkle.Finish = merkle.PATHS) -> DataFrame:
    """(doc_id, leaf, subroot, root, path) of each row of docs (FIELDS): path holds the slot and siblings at each level from the leaf to the root, or what `finish` makes of them."""
    rows = materialise(leaves(docs), "leaves")
    placed = materialise(merkle.numbered(rows, ["doc_id", "digest", "place"], "leaves-sorted"), "leaves-numbered")
    parents, tallest = merkle.build(placed, "nodes")
    subroots = materialise(merkle.roots(placed, parents), "subroots")
    # The trees' roots are the rows of one more tree, in the order of the languages.
    crowns = merkle.numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), F.col("n").alias("rows"), F.col("root").alias("digest")), ["lang"], "crowns")
    crowns = materialise(crowns, "crowns-numbered")
    above, levels = merkle.build(crowns, "crown-nodes")
    root = merkle.roots(crowns, above).select("tree", "n", F.lit("").alias("path"), F.struct(F.col("root")).alias("above"))
    keyed = crowns.withColumn("key", F.struct("lang", "rows", "digest"))
    tops = merkle.descend(keyed, above, root, levels, "crown-paths").select(F.col("key.lang").alias("tree"), F.col("key.rows").alias("n"), "path", F.struct(F.col("key.digest").alias("subroot"), F.col("above.root").alias("root")).alias("above"))
    keyed = placed.withColumn("key", F.struct("doc_id", "digest", "tampered"))
    found = merkle.descend(keyed, parents, materialise(tops, "tops"), tallest, "paths", finish)
    return found.select("key.doc_id", F.col("key.digest").alias("leaf"), "above.subroot", "above.root", "path")


def _proved(keys: list[dict], paths: list[str]) -> pa.Array:
    """proof_sha256, and the root that the leaf as it is now (tampered, if it is) and its siblings give."""
    proofs = [hashlib.sha256(merkle.siblings_of(p).encode()).hexdigest() for p in paths]
    folded = [merkle.fold(k["tampered"] or k["digest"], p) for k, p in zip(keys, paths, strict=True)]
    return pa.StructArray.from_arrays([pa.array(proofs, pa.string()), pa.array(folded, pa.string())], ["proof_sha256", "folded_root"])


def verified(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of docs; paths are folded where they are found."""
    rows = manifest(docs, (_proved, "struct<proof_sha256:string,folded_root:string>"))
    return rows.select("doc_id", "leaf", "subroot", "root", "path.proof_sha256", "path.folded_root", (F.col("path.folded_root") == F.col("root")).alias("verified"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents; the cases are those of this module."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "source", "lang", F.col("n_chars").cast("long"), "text")
    return verified(docs)


def _levels(table: str, first: str, count: int = 8) -> str:
    """CTEs <table>0 to <table><count>: lists of digests, each level's runs of eight hashed."""
    step = "CASE WHEN len(l) > 1 THEN list_transform(range((len(l) + 7) // 8), lambda i: sha256(array_to_string(l[8 * i + 1:8 * i + 8], ''))) ELSE l END"
    return ",\n".join([f"{table}0 AS ({first})", *(f"{table}{k} AS (SELECT * EXCLUDE (l), {step} AS l FROM {table}{k - 1})" for k in range(1, count + 1))])


def _run(lists: str, place: str, k: int) -> tuple[str, str]:
    """SQL for the siblings to the left and right of the node above `place` (from 0) at level k."""
    run, own = f"{lists}{k}[({place} >> {3 * k + 3} << 3) + 1:({place} >> {3 * k + 3} << 3) + 8]", f"(({place} >> {3 * k}) & 7)"
    return f"array_to_string({run}[1:{own}], '')", f"array_to_string({run}[{own} + 2:], '')"


def _oracle(count: int = 8) -> str:
    """Lists of digests by level, for trees of up to 8 ** count rows."""
    spelt = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    row = lambda text: " || ".join(spelt(c if c != "text" else text) for c in FIELDS)
    wide = lambda t, key: f"SELECT {key}, " + ", ".join(f"{t}{k}.l AS l{k}" for k in range(count + 1)) + f" FROM {t}0 " + " ".join(f"JOIN {t}{k} USING ({key})" for k in range(1, count + 1))
    folds, siblings, last = [], [], "g"
    for lists, place in (("l", "place"), ("r", "tree_place")):
        for k in range(count):
            left, right = _run(lists, place, k)
            folds.append(f"{last}x AS (SELECT * EXCLUDE (d), CASE WHEN len({lists}{k}) > 1 THEN sha256({left} || d || {right}) ELSE d END AS d FROM {last})")
            siblings.append(f"CASE WHEN len({lists}{k}) > 1 THEN {left} || {right} ELSE '' END")
            last += "x"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    shift = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""WITH crcs AS (SELECT list(t ORDER BY i) AS crc FROM (SELECT i, list_reduce(range(8), lambda c, _: {shift}, i) AS t FROM range(256) b(i))),
d AS (SELECT *, coalesce('=' || lang, '') AS tree, sha256({row('text')}) AS leaf, sha256({row(low)}) AS lowered,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS sum FROM documents, crcs),
p AS (SELECT doc_id, tree, leaf, CASE WHEN sum % 3 = 0 THEN lowered ELSE leaf END AS now, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d),
{_levels('t', "SELECT tree, list(leaf ORDER BY place) AS l FROM p GROUP BY tree", count)},
s AS (SELECT tree, l[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS tree_place FROM t{count}),
{_levels('u', "SELECT 1 AS one, list(subroot ORDER BY tree_place) AS l FROM s", count)},
tw AS ({wide('t', 'tree')}), uw AS (SELECT {', '.join(f'l{k} AS r{k}' for k in range(count + 1))} FROM ({wide('u', 'one')})),
g AS (SELECT p.*, s.subroot, s.tree_place, tw.* EXCLUDE (tree), uw.*, uw.r{count}[1] AS root, now AS d FROM p JOIN s USING (tree) JOIN tw USING (tree) CROSS JOIN uw),
{(',' + chr(10)).join(folds)}
SELECT doc_id, leaf, subroot, root, sha256({' || '.join(siblings)}) AS proof_sha256, d AS folded_root, d = root AS verified FROM {last}
"""


#: The same rows from lists of digests by level.
ORACLE = _oracle()
