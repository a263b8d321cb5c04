"""Query op8: documents to ids, pieces and sequences."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from typing import Self

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.common import documents, materialise, release_others, worker_cache
from glossa.llm.packing import Capacity, pack

#: Items of a shard. A shard is packed in one task and wastes at most about one sequence.
SHARD_ITEMS = 20_000


def vocabulary() -> str:
    """The default vocabulary file, beside the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Units of these characters are lower-cased and split here, and cut by the quicker library; all others go through the library whole.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-įı-ſ]*")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\sa-z0-9ß-öø-ſ]+|\n")


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ... in turn."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in kept]
    return {b: 256 + i for i, b in enumerate(others)}


class WordIds:
    """Ids of texts, by way of their space-separated units.

    No token or merge of this vocabulary spans white space, so a text's ids are those of its units one after another.
    Each unit is tokenized once and remembered, new ones many at a time; at `most` remembered units the memory starts
    afresh.
    """

    quick = None

    def __init__(self, path: str, most: int = 1_200_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.quick = self._quick(path)
        self.most = most
        self.forget()

    def _quick(self, path: str):
        """The same merges by rank, the end of a word being a byte 0 that joins its last byte first; none if ids aren't in the order of the merges."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end, vocab = model["end_of_word_suffix"], model["vocab"]
        letters = {chr(b): b for b in range(256) if b not in _byte_letters()} | {chr(v): k for k, v in _byte_letters().items()}
        joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        single = {c: vocab.get(c) for c in letters} | {c + end: vocab.get(c + end) for c in letters} if end else {}
        zero = next(c for c, b in letters.items() if b == 0)
        if sorted(single.values(), key=str) != sorted(range(512), key=str) or any(single[c] > 255 for c in letters) or [vocab[x] for x in joined] != list(range(512, 512 + len(joined))) or any(zero in x for x in joined):
            return None
        spelt = lambda x: bytes(letters[c] for c in x.removesuffix(end)) + b"\0" * x.endswith(end)
        self.line = vocab[chr(_byte_letters()[10]) + end]
        return tiktoken.Encoding("words", pat_str="[^\\x00]+\\x00", mergeable_ranks={spelt(x): i for x, i in [*single.items(), *((x, vocab[x]) for x in joined)]}, special_tokens={})

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.ends = np.zeros(1 << 17, np.int64)
        self.used = 0

    @classmethod
    def of(cls, path: str, *most: int) -> Self:
        """One for each Python worker."""
        return worker_cache((cls, path), lambda: cls(path, *most))

    def unit(self, unit: str) -> list[int]:
        return self.tokenizer.encode(unit, add_special_tokens=False).ids

    def learn(self, units: list[str]) -> None:
        if self.quick is not None:
            plain = [u for u in units if PLAIN.fullmatch(u) and "<|" not in u]
            if plain:
                # Units end with a line end, words with a byte 0.
                words = PARTS.findall("\n".join([*plain, ""]).lower())
                ids = np.array(self.quick.encode_ordinary("\0".join([*words, ""])), np.uint32)
                stops = np.flatnonzero(ids == self.line)
                self._remember(plain, ids[ids != self.line], np.diff(stops, prepend=-1) - 1)
            units = [u for u in units if u not in self.at]
        got = [self.unit(u) for u in units]
        self._remember(units, np.array([i for g in got for i in g], np.uint32), np.array(list(map(len, got)), np.int64))

    def _remember(self, units: list[str], new: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.at)
        while self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(units) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[self.used : self.used + len(new)] = new
        self.ends[n + 1 : n + 1 + len(units)] = self.used + np.cumsum(sizes)
        self.used += len(new)
        self.at.update(zip(units, range(n, n + len(units)), strict=True))

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text."""
        return self.gathered(text.replace("\n", " ").replace("\t", " ").split(" "))

    def gathered(self, units: list[str]) -> np.ndarray:
        """Ids of units, one after another."""
        p = self.places(units)
        start, size = self.ends[p], self.ends[p + 1] - self.ends[p]
        shift = start - (np.cumsum(size) - size)
        index = np.repeat(shift, size)
        index += np.arange(len(index))
        return self.ids[index]

    def places(self, units: list[str]) -> np.ndarray:
        """Where these units are remembered; those that aren't yet are learnt."""
        if len(self.at) > self.most:
            self.forget()
        try:
            return np.fromiter(map(self.at.__getitem__, units), np.int64, len(units))
        except KeyError:
            self.learn(list(dict.fromkeys(u for u in units if u not in self.at)))
            return np.fromiter(map(self.at.__getitem__, units), np.int64, len(units))

    def encode_all(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without nulls, one after another, and where each text's begin and the last one's end.

        Units are told apart by Arrow, so that Python looks at each different one once, however often it stands there.
        """
        spaced = pc.replace_substring(pc.replace_substring(texts, "\n", " "), "\t", " ")
        units = pc.split_pattern(spaced, " ")
        of = units.flatten().dictionary_encode()
        which = of.indices.to_numpy()
        p = self.places(of.dictionary.to_numpy(zero_copy_only=False).tolist())
        start, size = self.ends[p][which], (self.ends[p + 1] - self.ends[p])[which]
        ends = np.concatenate([[0], np.cumsum(size)])
        index = np.repeat(start - ends[:-1], size)
        index += np.arange(len(index))
        offsets = units.offsets.to_numpy()
        return self.ids[index], ends[offsets - offsets[0]]


#: Bytes of text that ids are made from at a time, and units that are remembered for the next ones.
PART, REMEMBERED = 1 << 20, 250_000


def parts(texts: pa.StringArray, most: int = PART) -> Iterator[tuple[int, int]]:
    """Ranges of texts, of at most `most` bytes each or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, stop
        at = stop


def pieces(docs: DataFrame, path: str | None = None, longest: int = 2048, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32: a row for each piece of at most `longest` ids, each document ended by id `end`. Null texts count as empty: one piece with the end id alone."""
    path = path or vocabulary()
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_others((WordIds, path))
        words = WordIds.of(path, REMEMBERED)
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in parts(texts):
                ids, ends = words.encode_all(pc.fill_null(texts.slice(lo, hi - lo), ""))
                data, size = memoryview(ids.astype("<u4", copy=False)).cast("B"), np.diff(ends) + 1
                count = -(-size // longest)
                doc = np.repeat(np.arange(len(size)), count)
                k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start, length = k * longest, np.minimum(longest, size[doc] - k * longest)
                final = start + length == size[doc]
                crc = np.zeros(len(doc), np.int64)
                for i, (a, b, f) in enumerate(zip((4 * (ends[doc] + start)).tolist(), (4 * (ends[doc] + start + length - final)).tolist(), final.tolist(), strict=True)):
                    crc[i] = zlib.crc32(last, zlib.crc32(data[a:b])) if f else zlib.crc32(data[a:b])
                columns = [batch.column("doc_id").take(pa.array(doc + lo)), pa.array(k.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_pieces(items: DataFrame, capacity: Capacity = Capacity(), shard_items: int = SHARD_ITEMS) -> DataFrame:
    """items with sequence_id and offset: a row for each row.

    The items are written once, each with a number of its place; shards are dealt by a hash of that number, so neither
    long documents nor repeated rows gather in one, and an executor that is lost can't change the shards. Their number
    follows the number of items. Within a shard the order is (falling length, doc_id, piece, number). No rows give no rows.
    """
    fields = items.columns
    schema = items.schema.simpleString()[7:-1].replace(":", " ") + ", sequence_id long, offset long"
    numbered = materialise(items.withColumn("_place", F.monotonically_increasing_id()), "items")
    shards = max(1, numbered.count() // shard_items)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("_place", "ascending")])
        bins, offsets = pack(rows["length"].to_numpy(), capacity)
        return rows.select(fields).append_column("sequence_id", pa.array(bins * shards + key[0].as_py())).append_column("offset", pa.array(offsets))

    shard = F.pmod(F.xxhash64("_place"), F.lit(shards)).cast("long")
    return numbered.withColumn("_shard", shard).groupBy("_shard").applyInArrow(run, schema)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces are written to the shared folder once: they are counted, then packed. Repeated rows are packed each; equal lengths go by doc_id."""
    return pack_pieces(pieces(documents(spark, sf_dir)))
