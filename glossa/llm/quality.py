"""Text quality by positive-unlabelled learning.

A linear scorer g over document statistics minimises the non-negative unbiased risk

    R(g) = prior * R_p+(g) + max(0, R_u-(g) - prior * R_p-(g))

on trusted positives and unlabelled web text; where the bracket falls below zero, the step goes against it, so the
model can't drive the negative part below nothing. The class prior is estimated first. No labelled negative has a part
in it: the margin's scale minimises the same risk with the logistic loss, which makes scores probabilities.

All that is needed of unlabelled rows are sums over them: a function `sums(f)` gives the total of f(rows) over all rows,
wherever they are. Each step of the descent is one such sum over every unlabelled row.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from glossa.llm.logistic import sigmoid

#: Classes of code points: lower, upper, digit, space, line end, sentence mark, quote or bracket, symbol, other.
NAMES = ("lower", "upper", "digit", "space", "line", "mark", "quote", "symbol", "other")
MARKS, QUOTES, SYMBOLS = ".,;:?!'-", "\"()[]«»“”", "#$%&*+/<=>@\\^_`{|}~"
WORD = re.compile(r"\S+")


def _classes() -> np.ndarray:
    """Class of each byte; bytes of longer UTF-8 sequences count as lower-case letters."""
    out = np.full(256, 8, np.uint8)
    out[ord("a") : ord("z") + 1] = 0
    out[128:] = 0
    out[ord("A") : ord("Z") + 1] = 1
    out[ord("0") : ord("9") + 1] = 2
    out[[32, 9]] = 3
    out[10] = 4
    for chars, k in ((MARKS, 5), (QUOTES, 6), (SYMBOLS, 7)):
        for c in chars.encode():
            if c < 128:
                out[c] = k
    return out


CLASS = _classes()
SIZE = 9 + 81 + 14


def features(text: str) -> np.ndarray:
    """Shares of character classes and of pairs of them, and statistics of words and lines; all are bounded."""
    out = np.zeros(SIZE)
    data = text.encode()
    n = len(data)
    if n == 0:
        out[-1] = 1
        return out
    kinds = CLASS[np.frombuffer(data, np.uint8)]
    out[:9] = np.bincount(kinds, minlength=9) / n
    if n > 1:
        out[9:90] = np.bincount(kinds[:-1] * np.uint8(9) + kinds[1:], minlength=81) / (n - 1)
    words = text.split()
    m = max(1, len(words))
    counts = Counter(words)
    common = counts.most_common(3)
    pairs = Counter(zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = len(set(lines))
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    packed = len(zlib.compress(data, 1)) / n
    out[90:] = [
        len(counts) / m,
        common[0][1] / m if common else 0,
        sum(c for _, c in common) / m,
        len(pairs) / m,
        repeats / m,
        min(1.0, sum(map(len, words)) / m / 20),
        min(1.0, max(map(len, words), default=0) / 100),
        1 - distinct / max(1, len(lines)),
        min(1.0, n / max(1, len(lines)) / 1000),
        min(1.5, packed),
        sum(w.isupper() for w in counts) / max(1, len(counts)),
        min(1.0, np.log1p(n) / 12),
        float(m < 10),
        0.0,
    ]
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float
    slope: float = 1.0
    offset: float = 0.0

    def shaped(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.shaped(x) @ self.weights + self.bias, -EDGE, EDGE)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.margin(x) + self.offset)


Sums = Callable[[Callable[[np.ndarray], np.ndarray]], np.ndarray]
#: Margins are cut here; the calibration counts them in bins of this width.
EDGE, BIN = 30.0, 0.1
BINS = np.arange(-EDGE, EDGE + BIN / 2, BIN)


#: Folds in which the prior's scorer is judged by rows that it wasn't made from.
FOLDS = 4
LEVELS = np.linspace(0.0, 0.9, 46)


def estimate_prior(above: np.ndarray, positives: int, unlabelled: float) -> float:
    """Share of positives among unlabelled rows, by the lowest ratio of the two distributions' upper tails.

    above: how many unlabelled rows have at least the margin that a share 1 - LEVELS of the positives has; as the positives
    among the unlabelled rows at or above a threshold are prior * F_p of all, prior <= F_u / F_p at every threshold.
    Margins are of scorers that a row had no part in, so no bound is low by fitting. The threshold is the one whose bound
    and two standard errors are lowest, so that none is picked for being low by chance; the prior is its bound.
    """
    bounds = []
    for level, n in zip(LEVELS, above, strict=True):
        p, u = 1.0 - level, n / unlabelled
        if p * positives >= 30 and n >= 30:
            error = np.sqrt((1 - u) / n + (1 - p) / (p * positives))
            bounds.append((u / p * (1 + 2 * error), u / p))
    return float(np.clip(min(bounds, default=(0.5, 0.5))[1], 0.05, 0.99))


def folds_of(x: np.ndarray) -> np.ndarray:
    """The fold of each row, by its values."""
    return np.array([zlib.crc32(r.tobytes()) % FOLDS for r in x.astype("<f4")], np.int64).reshape(-1)


def _bare(model: Model) -> Model:
    """A model whose functions can be sent with little."""
    return Model(model.mean, model.scale, model.weights, model.bias, model.prior)


def _prior(model: Model, positive: np.ndarray, sums: Sums, n: float) -> float:
    """The class prior, by the linear scorers that best part positives from unlabelled rows in the least-squares sense: each is made without a fold of both and counts the rows of this fold."""
    bare, width = _bare(model), SIZE + SIZE * SIZE + 1

    def moments(x: np.ndarray) -> np.ndarray:
        z, fold = bare.shaped(x), folds_of(x)
        parts = [z[fold == k] for k in range(FOLDS)]
        return np.concatenate([np.concatenate([[float(len(p))], p.sum(axis=0), (p.T @ p).reshape(-1)]) for p in parts])

    got = sums(moments).reshape(FOLDS, width)
    z, fold = bare.shaped(positive), folds_of(positive)
    scorers, limits = [], []
    for k in range(FOLDS):
        rest = got.sum(axis=0) - got[k]
        others, own = z[fold != k], z[fold == k]
        if not len(others) or not len(own) or not rest[0]:
            return 0.5
        mean = rest[1 : SIZE + 1] / rest[0]
        spread = rest[SIZE + 1 :].reshape(SIZE, SIZE) / rest[0] - np.outer(mean, mean)
        scorers.append(np.linalg.solve(spread + 0.05 * np.eye(SIZE), others.mean(axis=0) - mean))
        limits.append(np.quantile(own @ scorers[k], LEVELS))

    def tails(x: np.ndarray) -> np.ndarray:
        z, fold = bare.shaped(x), folds_of(x)
        return sum(((z[fold == k] @ scorers[k])[:, None] >= limits[k]).sum(axis=0).astype(float) for k in range(FOLDS))

    return estimate_prior(sums(tails), len(positive), n)


def _descend(model: Model, p: np.ndarray, sums: Sums, n: float, steps: int, rate: float, decay: float) -> None:
    """Adam steps on the non-negative risk with the sigmoid loss l(z) = sigmoid(-z), each over all rows."""
    theta = np.zeros(SIZE + 1)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        model.weights, model.bias = theta[:-1].copy(), float(theta[-1])
        bare = _bare(model)

        def unlabelled(x: np.ndarray, bare: Model = bare) -> np.ndarray:
            z = bare.shaped(x)
            s = sigmoid(z @ bare.weights + bare.bias)
            d = s * (1 - s)  # the loss of a negative, sigmoid(z), has this derivative
            return np.concatenate([d @ z, [d.sum(), s.sum()]])

        u = sums(unlabelled) / n
        s = sigmoid(p @ theta[:-1] + theta[-1])
        d = s * (1 - s)
        positive = -np.append(d @ p, d.sum()) / len(p)
        negative = u[:-1] + model.prior * positive
        grad = model.prior * positive + negative if u[-1] >= model.prior * s.mean() else -negative
        grad[:-1] += decay * theta[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    model.weights, model.bias = theta[:-1], float(theta[-1])


def _least(f: Callable[[float], float], low: float, high: float, tolerance: float = 1e-5) -> float:
    """Where a convex function is least within bounds, by golden sections."""
    ratio = (np.sqrt(5) - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = f(a), f(b)
    while high - low > tolerance:
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = f(b)
    return (low + high) / 2


def risk(prior: float, p: np.ndarray, u: np.ndarray, slope: float, offset: float) -> float:
    """The non-negative risk with the logistic loss; p and u: shares of positives and of unlabelled rows by bin of margin.

    It is the larger of prior * R_p+ and prior * R_p+ + R_u- - prior * R_p-; the latter is R_u- less the prior times the
    positives' mean margin. Both are convex in slope and offset, and so is the risk.
    """
    z = slope * BINS + offset
    plus = prior * float(p @ np.logaddexp(0, -z))
    return max(plus, float(u @ np.logaddexp(0, z)) - prior * float(p @ z))


def _calibrate(model: Model, positive: np.ndarray, unlabelled: np.ndarray, tolerance: float = 1e-5) -> None:
    """The slope of the least risk; counts of rows by bin of margin. The offset stays 0, where the descent has put the classes' boundary. A finer search changes nothing but digits."""
    p, u = positive / max(1.0, positive.sum()), unlabelled / max(1.0, unlabelled.sum())
    model.slope, model.offset = _least(lambda slope: risk(model.prior, p, u, slope, 0.0), 0.05, 2.0, tolerance), 0.0


def fit(positive: np.ndarray, sums: Sums, steps: int = 30, rate: float = 0.1) -> Model:
    """positive: feature rows; sums: totals over the unlabelled rows. Without positives or unlabelled rows the score is 0.5."""
    got = sums(lambda x: np.concatenate([[float(len(x))], x.sum(axis=0), (x**2).sum(axis=0)]))
    n = got[0]
    if not len(positive) or not n:
        return Model(np.zeros(SIZE), np.ones(SIZE), np.zeros(SIZE), 0.0, 0.5)
    mean = got[1 : SIZE + 1] / n
    scale = np.sqrt(np.maximum(got[SIZE + 1 :] / n - mean**2, 0)) + 1e-3
    model = Model(mean, scale, np.zeros(SIZE), 0.0, 0.5)
    p = model.shaped(positive)
    model.prior = _prior(model, positive, sums, n)
    _descend(model, p, sums, n, steps, rate, 1e-4)
    bare = _bare(model)
    binned = lambda x: np.bincount(np.rint((bare.margin(x) + EDGE) / BIN).astype(int), minlength=len(BINS)).astype(float)
    _calibrate(model, binned(positive), sums(binned))
    return model
