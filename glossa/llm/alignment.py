"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers cut a blank followed by the text into tokens, so both give a row of byte ranges over one line. Tokens of
A and B whose ranges overlap are linked; the connected components of this bipartite graph, found by union-find, are the
minimal groups between byte offsets at which tokens of both end.

A text is taken apart before runs of white space that begin with a blank or a line end and follow something else. No
token of either tokenizer spans such a place (A's are cut there before any merge; B has no piece that goes on after a
blank or line end behind another character, which is checked when it is loaded), so a text's tokens are those of its
units one after another, and no link crosses units. What a unit gives is remembered up to a bound; units that aren't
known yet are tokenized and aligned many at a time.

Defined results: null and empty texts, and texts that the joined bytes of either side's tokens don't give back, have no
tokens.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass, field

import numpy as np
import zstandard

from glossa.llm.common import worker_cache
from glossa.llm.op08_packing import _byte_letters

UNITS = re.compile(r"\s*+\S++(?:[^\S \n]\s*+\S*+)*+|\s++")
#: Units of these characters may be cut by the quicker library, which knows the same merges; no two engines differ about them.
PLAIN = re.compile(r"[\n\x20-\x7eÀ-ÖØ-öø-ɏ]{1,256}")
#: What a byte-level vocabulary of this kind cuts into words.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Remembered units, and links and code points of group texts that they may hold.
MOST, MOST_LINKS, MOST_CHARS = 250_000, 6_000_000, 24_000_000
#: Code points of texts that are aligned at a time.
STEP = 400_000


def vocabularies() -> tuple[str, str]:
    """The default files, beside the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class ByteTokens:
    """A: ids and the bytes of each."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        letters = {chr(b): b for b in range(256)} | {chr(v): k for k, v in _byte_letters().items()}
        for b in _byte_letters():  # these are spelt by other letters than their own
            del letters[chr(b)]
        self.spelt = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.spelt[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.quick = self._quick(path)

    def _quick(self, path: str):
        """The same merges by rank, if ids are in the order of the merges."""
        import tiktoken

        model = json.loads(open(path, encoding="utf-8").read())["model"]
        single = {i for i, b in enumerate(self.spelt) if len(b) == 1}
        joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        in_order = [model["vocab"][x] for x in joined] == list(range(256, 256 + len(joined))) and single == set(range(256))
        if not in_order:
            return None
        return tiktoken.Encoding("plain", pat_str=WORDS, mergeable_ranks={b: i for i, b in enumerate(self.spelt[: 256 + len(joined)])}, special_tokens={})

    def encode(self, unit: str) -> list[int]:
        if self.quick is not None and PLAIN.fullmatch(unit):
            return self.quick.encode_ordinary(unit)
        return self.library.encode(unit, add_special_tokens=False).ids


class PieceTokens:
    """B: ids and the bytes of each."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i).replace("▁", " ") for i in range(m.get_piece_size())]
        self.spelt = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.encode() for i, p in enumerate(pieces)]
        if any(re.search(r"[^ ] |.\n|\n.", p, re.DOTALL) for i, p in enumerate(pieces) if not m.is_byte(i)):
            raise ValueError(f"{path}: a piece spans white space behind another character, so units can't be told apart")

    def encode_all(self, units: list[str]) -> list[list[int]]:
        """Units of a blank and more lose the blank, which the library puts back; before others a line end is put, and what stands for both is cut off."""
        plain = [len(u) > 1 and u[0] == " " for u in units]
        found = self.library.encode([u[1:] if p else "\n" + u for u, p in zip(units, plain, strict=True)], num_threads=1)
        return [ids if p else ids[2:] for ids, p in zip(found, plain, strict=True)]


def union_find(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, for nodes 0 to size - 1 and edges (a, b). All edges hook the larger of their roots to the smaller one at once; then paths are halved until every node points to its root."""
    parent = np.arange(size)
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            above = parent[parent]
            if (above == parent).all():
                break
            parent = above


@dataclass
class Aligned:
    """Tokens of a line of bytes: group of each token of A and B, and the links in the order of their overlaps."""

    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def align(size_a: np.ndarray, size_b: np.ndarray) -> Aligned:
    """The lengths in bytes of tokens of A and B over the same line."""
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    start_a, start_b = end_a - size_a, end_b - size_b
    na, nb = len(end_a), len(end_b)
    # An overlap begins where a token of A begins, in some token of B, or the other way round, or both.
    in_b = np.searchsorted(end_b, start_a, "right")
    in_a = np.searchsorted(end_a, start_b, "right")
    inside = start_a[in_a] != start_b if nb else np.zeros(0, bool)
    link_a = np.concatenate([np.arange(na), in_a[inside]])
    link_b = np.concatenate([in_b, np.flatnonzero(inside)])
    order = np.argsort(np.concatenate([start_a, start_b[inside]]), kind="stable")
    link_a, link_b = link_a[order], link_b[order]
    component = union_find(na + nb, link_a, na + link_b)
    _, group = np.unique(component, return_inverse=True)
    return Aligned(group[:na], group[na:], link_a, link_b)


@dataclass
class Known:
    """What units give, by number: tokens of A and B, groups, links; texts of groups; links as pairs of ids; whether the bytes come back."""

    at: dict[str, int] = field(default_factory=dict)
    texts: list[str] = field(default_factory=list)
    chars: int = 0
    used: int = 0
    counts: np.ndarray = field(default_factory=lambda: np.zeros((1 << 14, 4), np.int64))
    lossless: np.ndarray = field(default_factory=lambda: np.zeros(1 << 14, bool))
    ends: np.ndarray = field(default_factory=lambda: np.zeros((1 << 14) + 1, np.int64))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(1 << 17, np.uint32))

    def room(self, units: int, links: int) -> None:
        while len(self.texts) + units > len(self.lossless):
            self.counts, self.lossless, self.ends = np.concatenate([self.counts, self.counts]), np.concatenate([self.lossless, self.lossless]), np.concatenate([self.ends, self.ends[1:]])
        while self.used + links > len(self.pairs):
            self.pairs = np.concatenate([self.pairs, self.pairs])

    def full(self) -> bool:
        return len(self.texts) > MOST or self.used > MOST_LINKS or self.chars > MOST_CHARS


@dataclass
class Document:
    counts: tuple[int, int, int, int] = (0, 0, 0, 0)
    groups: str = ""
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))


class Aligner:
    def __init__(self, paths: tuple[str, str]):
        self.a, self.b = ByteTokens(paths[0]), PieceTokens(paths[1])
        self.size_a, self.size_b = (np.array([len(x) for x in t.spelt], np.int64) for t in (self.a, self.b))
        if len(self.a.spelt) * len(self.b.spelt) > 1 << 32:
            raise ValueError("a pair of ids has to fit in 32 bits")
        self.known = Known()

    @classmethod
    def of(cls, paths: tuple[str, str]) -> Aligner:
        """One for each Python worker."""
        return worker_cache((cls, paths), lambda: cls(paths))

    @property
    def width(self) -> int:
        """A pair of ids is a * width + b."""
        return len(self.b.spelt)

    def learn(self, units: list[str]) -> None:
        """Tokenize and align units that aren't known yet."""
        if not units:
            return
        known, first = self.known, len(self.known.texts)
        ids_a, ids_b = list(map(self.a.encode, units)), self.b.encode_all(units)
        back = [b"".join(map(self.a.spelt.__getitem__, x)) == (u := unit.encode()) == b"".join(map(self.b.spelt.__getitem__, y)) for unit, x, y in zip(units, ids_a, ids_b, strict=True)]
        empty: list[int] = []
        ids_a, ids_b = ([x if ok else empty for x, ok in zip(ids, back, strict=True)] for ids in (ids_a, ids_b))
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter((i for x in ids for i in x), np.int64, int(n.sum())) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        found = align(self.size_a[flat_a], self.size_b[flat_b])
        unit_a = np.repeat(np.arange(len(units)), n_a)
        unit_of_link = unit_a[found.link_a]
        new_group = np.flatnonzero(np.diff(found.group_a, prepend=-1))
        n_groups = np.bincount(unit_a[new_group], minlength=len(units))
        n_links = np.bincount(unit_of_link, minlength=len(units))
        known.room(len(units), len(unit_of_link))
        where = slice(first, first + len(units))
        known.counts[where] = np.column_stack([n_a, n_b, n_groups, n_links])
        known.lossless[where] = back
        known.ends[first + 1 : first + 1 + len(units)] = known.used + np.cumsum(n_links)
        known.pairs[known.used : known.used + len(unit_of_link)] = flat_a[found.link_a] * self.width + flat_b[found.link_b]
        known.used += len(unit_of_link)
        for i, text in enumerate(self._texts(found, flat_a, flat_b, n_a + n_b), first):
            known.chars += len(text)
            known.texts.append(text)
            known.at[units[i - first]] = i

    def _texts(self, found: Aligned, flat_a: np.ndarray, flat_b: np.ndarray, tokens: np.ndarray) -> list[str]:
        """The groups of each unit as text: ids of A, a bar, ids of B, groups joined by semicolons."""
        key = np.concatenate([2 * found.group_a, 2 * found.group_b + 1])
        order = np.argsort(key, kind="stable")
        ids, key = np.concatenate([flat_a, flat_b])[order], key[order]
        last = np.diff(key, append=-1) != 0
        after = np.where(last, np.where(key % 2 == 0, "|", ";"), ",").tolist()
        parts = [f"{i}{s}" for i, s in zip(ids.tolist(), after, strict=True)]
        out, at = [], 0
        for end in np.cumsum(tokens).tolist():
            out.append("".join(parts[at:end])[:-1])
            at = end
        return out

    def documents(self, texts: list[str]) -> list[Document]:
        """What each text gives, units learnt for as many texts at a time as STEP holds."""
        out: list[Document] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= STEP):
                size += len(texts[end])
                end += 1
            cut = [UNITS.findall(" " + t) if t else [] for t in texts[at:end]]
            if self.known.full():
                self.known = Known()
            known = self.known.at
            self.learn(list(dict.fromkeys(u for units in cut for u in units if u not in known)))
            out += map(self._document, cut)
            at = end
        return out

    def _document(self, units: list[str]) -> Document:
        known = self.known
        at = np.fromiter(map(known.at.__getitem__, units), np.int64, len(units))
        if not len(at) or not known.lossless[at].all():
            return Document()
        each, times = np.unique(at, return_counts=True)
        counts = times @ known.counts[each]
        begin = known.ends[each]
        sizes = known.ends[each + 1] - begin
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(begin - (ends - sizes), sizes)
        pairs, inverse = np.unique(known.pairs[places], return_inverse=True)
        total = np.bincount(inverse, weights=np.repeat(times, sizes), minlength=len(pairs)).astype(np.int64)
        digest = hashlib.sha256(";".join([known.texts[i] for i in at.tolist()]).encode()).hexdigest()
        return Document(tuple(counts.tolist()), digest, pairs, total)


# ------------------------------------------------------------------ numbers as bytes


def packed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values, their bytes by place, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1)


def packed_rising(values: np.ndarray) -> bytes:
    """Rising values, by their differences."""
    return packed(np.diff(values, prepend=values.dtype.type(0)))


def unpacked_rising(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint32)
