"""Class-conditional Kneser-Ney models over sub-word units, for two classes that share their backoff counts.

A word is drawn as its stem (the first letters) and then, with the stem as history, as the word itself:

    P_c(stem)        = max(n_c(stem) - D_c, 0) / N_c        + a_c       * S(stem)
    P_c(word | stem) = max(n_c(word) - D_c, 0) / n_c(stem)  + b_c(stem) * T(word | stem)

n_c(word) counts the class's documents that hold the word, so one document can't make evidence; n_c(stem) and N_c are
sums of these. S is the Kneser-Ney continuation share (in how many different words a stem is seen) and T the word's
share in its stem, both over all documents of both classes and of none. a_c and b_c are the discounted mass, so that
P_c(stem) * P_c(word | stem) sums to 1 over the words of the corpus. Words that the classes hardly show get the same
probability from either model but for a_c: they say next to nothing.

The discount comes from the learning rows alone: Kneser and Ney's estimate from counts of counts, n1 / (n1 + 2 n2), which
is below one document, or a whole number of documents, whichever foretells learning rows best that are left out of the
counts (left_out()).

Histories are stems, which carry evidence to forms that the sample doesn't hold; evidence of pairs of words is thin in
samples of labelled rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash

WORD = re.compile(r"[^\W\d_]+")
STEM = 5


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode()) >> 1


def stem_hash(word: str) -> int:
    """Stems hash apart from whole words."""
    return xxhash.xxh64_intdigest(word[:STEM].encode(), 7) >> 1


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass
class Counts:
    """What is known of the words that the classes hold, and of their stems. n: documents of class 0 and 1 that hold a word."""

    stems: np.ndarray  # sorted hashes
    share: np.ndarray  # S of each
    words: np.ndarray  # sorted hashes
    at: np.ndarray  # each word's place among the stems
    n: np.ndarray  # (2, words)
    within: np.ndarray  # T of each word

    def places(self, words: list[str]) -> np.ndarray:
        """The places of words that are all known."""
        return np.searchsorted(self.words, np.array([word_hash(w) for w in words], np.int64))


def counts(stems: dict[str, np.ndarray], words: dict[str, np.ndarray], kinds: float) -> Counts:
    """stems: stem, n (documents that hold its words, summed) and kinds (different words); words: word, stem, n0, n1, n; of all words that a class holds. kinds: different words of the corpus."""
    order = np.argsort(stems["stem"])
    s = {k: v[order] for k, v in stems.items()}
    order = np.argsort(words["word"])
    at = np.searchsorted(s["stem"], words["stem"][order]).astype(np.int32)
    of_stem = np.maximum(s["n"], 1).astype(np.float32)
    within = words["n"][order].astype(np.float32) / of_stem[at] if len(at) else np.zeros(0, np.float32)
    n = np.array([words["n0"][order], words["n1"][order]], np.int32).reshape(2, -1)
    return Counts(s["stem"], (s["kinds"] / max(1.0, kinds)).astype(np.float32), words["word"][order], at, n, within)


def estimated(n: np.ndarray) -> float:
    """The discount of a class from its counts of counts."""
    one, two = int((n == 1).sum()), int((n == 2).sum())
    return one / (one + 2 * two) if one and two else 0.75


@dataclass
class Ratios:
    """log P_1 - log P_0 for the stems and words that the counts say something about, by sorted hash; 0 for all others but for a stem's constant."""

    stems: np.ndarray
    stem_ratio: np.ndarray
    unseen_word: np.ndarray  # of a seen stem: the ratio of its backoff weights
    words: np.ndarray
    word_ratio: np.ndarray
    unseen_stem: float

    def of(self, words: list[str]) -> np.ndarray:
        """The log ratio of each of these words."""
        if not words:
            return np.zeros(0)
        s = np.array([stem_hash(w) for w in words], np.int64)
        w = np.array([word_hash(w) for w in words], np.int64)
        out = np.full(len(words), self.unseen_stem)
        if len(self.stems):
            i = np.minimum(np.searchsorted(self.stems, s), len(self.stems) - 1)
            known = self.stems[i] == s
            out = np.where(known, self.stem_ratio[i] + self.unseen_word[i], out)
            if len(self.words):
                j = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
                seen = known & (self.words[j] == w)
                out = np.where(seen, self.stem_ratio[i] + self.word_ratio[j], out)
        return out


@dataclass
class Sums:
    """Of one class at one discount: counts of stems, the discounts of their words summed, both over all stems as well."""

    d: float
    stem: np.ndarray
    cut: np.ndarray
    total: float
    cut_total: float


def sums(known: Counts, c: int, d: float) -> Sums:
    size = len(known.stems)
    stem = np.bincount(known.at, weights=known.n[c], minlength=size)
    return Sums(d, stem, np.bincount(known.at, weights=np.minimum(known.n[c], d), minlength=size), float(stem.sum()), float(np.minimum(stem, d).sum()))


def _logs(n: np.ndarray, stem: np.ndarray, cut: np.ndarray, total: float, cut_total: float, d: float, share: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """log P(stem), log P(word | stem), log of b(stem) and of a; n and within by word, the others already spread to words or by stem alike."""
    left = cut_total / total if total > 0 else 1.0
    rest = np.where(stem > 0, cut / np.maximum(stem, 1), 1.0)
    of_stem = np.log(np.maximum(stem - d, 0) / max(1.0, total) + left * share)
    of_word = np.log(np.maximum(n - d, 0) / np.maximum(stem, 1) + rest * within)
    return of_stem, of_word, np.log(rest), float(np.log(left))


def fit(known: Counts, discounts: tuple[float, float]) -> Ratios:
    """The models' ratios at the classes' discounts. Words that neither class holds more often than its discount are left to their stems."""
    stem_ratio, unseen_word, word_ratio, unseen_stem = np.zeros(len(known.stems)), np.zeros(len(known.stems)), np.zeros(len(known.words)), 0.0
    at = known.at
    for c, sign in ((1, 1.0), (0, -1.0)):
        s = sums(known, c, discounts[c])
        of_stem, _, rest, left = _logs(np.zeros(len(s.stem)), s.stem, s.cut, s.total, s.cut_total, s.d, known.share, np.ones(len(s.stem)))
        _, of_word, _, _ = _logs(known.n[c], s.stem[at], s.cut[at], s.total, s.cut_total, s.d, known.share[at], known.within)
        stem_ratio += sign * of_stem
        unseen_word += sign * rest
        word_ratio += sign * of_word
        unseen_stem += sign * left
    says = (known.n[0] > discounts[0]) | (known.n[1] > discounts[1])
    return Ratios(known.stems, stem_ratio, unseen_word, known.words[says], word_ratio[says], unseen_stem)


def left_out(known: Counts, both: tuple[Sums, Sums], places: np.ndarray, label: int) -> np.ndarray:
    """The log ratios of a learning row's different words (by place) in models of all other rows: the row is taken out of its class's counts."""
    at = known.at[places]
    out = np.zeros(len(places))
    for c, sign in ((1, 1.0), (0, -1.0)):
        s = both[c]
        n, stem, cut, total, cut_total = known.n[c][places].astype(float), s.stem[at], s.cut[at], s.total, s.cut_total
        if c == label:
            own, inverse, times = np.unique(at, return_inverse=True, return_counts=True)
            lost = np.bincount(inverse, weights=np.minimum(n, s.d) - np.minimum(n - 1, s.d))
            before = s.stem[own]
            cut_total -= float((np.minimum(before, s.d) - np.minimum(before - times, s.d)).sum())
            n, stem, cut, total = n - 1, stem - times[inverse], cut - lost[inverse], total - len(places)
        of_stem, of_word, rest, _ = _logs(n, stem, cut, total, cut_total, s.d, known.share[at], known.within[places])
        out += sign * (of_stem + of_word)
    return out


def features(ratios: np.ndarray, window: int = 16, strong: float = 2.0) -> np.ndarray:
    """Of a document's log ratios in order: the length-normalised sum, the best window's, the highest one, and the evidence of words above `strong`: its sum, and their number for each hundred words."""
    n = len(ratios)
    if n == 0:
        return np.zeros(5)
    sums = np.concatenate([[0.0], np.cumsum(ratios)])
    k = min(window, n)
    best = (sums[k:] - sums[:-k]).max() / window
    over = ratios[ratios > strong]
    return np.array([np.clip(ratios.mean(), -1, 1), min(best, 2.0), min(ratios.max(), 4.0), np.log1p((over - strong).sum()), min(100 * len(over) / n, 3.0)])
