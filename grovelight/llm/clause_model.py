"""A linear model of clauses fitted to reviews of whole documents.

A document is abusive if one of its clauses is, so the fit is one of multiple instances: every clause
of a negative document is a negative case; of a positive document only the clause that the model so
far scores highest is a positive one. Features are hashed: each word, its beginning, pairs of
neighbouring words and pairs one word apart. Reviews that the models of the other folds contradict
strongly are taken for wrong and left out. The bias is set so that 0.5 is the score at which the
cross-validated F0.5 is best.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import xxhash

TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*|[.!?;:…]+(?=\s)|\n+")
BITS = 18
PENALTY = 0.2  # of squared weights, beside a loss that adds up over clauses
FIRST_STEPS, NEXT_STEPS = 20, 8
MOST_DOUBTED = 0.15  # share of the positive reviews that may be taken for wrong
LONGEST, STEP = 16, 8  # words of a clause; longer ones are cut into overlapping windows
SHIFT = np.uint64(64 - BITS)
#: Odd multipliers of the feature hashes.
MULTIPLY, FIRST, APART = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@dataclass
class ClauseModel:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    bias: float = -40.0  # nothing learned: every score is 0
    telling: frozenset[str] = frozenset()


class Words:
    """Numbers of distinct words with their hashes; number 0 ends a clause."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.own: list[int] = [0]
        self.start: list[int] = [0]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in a row, and where each text ends."""
        known, out, ends = self.number, [], []
        for t in texts:
            tokens = TOKEN.findall(t)
            for w in set(tokens):
                if w not in known:
                    if w[0].isalnum():
                        known[w] = len(self.own)
                        self.own.append(xxhash.xxh64_intdigest(w))
                        self.start.append(xxhash.xxh64_intdigest("^" + w[:5]))
                    else:
                        known[w] = 0
            out += [known[w] for w in tokens]
            out.append(0)
            ends.append(len(out))
        return np.array(out, np.int64), np.array(ends, np.int64)


def instances(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every clause, long ones as overlapping windows."""
    stop = np.flatnonzero(ids == 0)
    start = np.r_[0, stop[:-1] + 1] if len(stop) else stop
    keep = stop > start
    start, stop = start[keep], stop[keep]
    n = np.maximum(1, -(-(stop - start - LONGEST) // STEP) + 1)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    a = np.repeat(start, n) + k * STEP
    return a, np.minimum(a + LONGEST, np.repeat(stop, n))


def features(ids: np.ndarray, a: np.ndarray, b: np.ndarray, own: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and the clause of each."""
    n = b - a
    clause = np.repeat(np.arange(len(a)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
    w, p = own[ids[at]], start[ids[at]]
    with np.errstate(over="ignore"):
        out = [(w * MULTIPLY) >> SHIFT, (p * MULTIPLY) >> SHIFT]
        of = [clause, clause]
        for gap, factor in ((1, FIRST), (2, APART)):
            same = clause[gap:] == clause[:-gap]
            out.append((((w[:-gap] * factor + w[gap:]) * MULTIPLY) >> SHIFT)[same])
            of.append(clause[gap:][same])
    return np.concatenate(out).astype(np.int32), np.concatenate(of).astype(np.int32)


def scale(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weight of a feature in its clause: one over the root of their number."""
    n = b - a
    return (1 / np.sqrt(2 * n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0))).astype(np.float32)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -36, 36)))


@dataclass
class _Point:
    """Where the descent stands: weights, bias, and the squared gradients met."""

    w: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS))
    bias: float = -3.0
    seen: np.ndarray = field(default_factory=lambda: np.full(1 << BITS, 1e-6))
    seen_b: float = 1e-6


class _Sample:
    """Features of all clauses of the reviewed documents."""

    def __init__(self, texts: list[str], y: np.ndarray) -> None:
        self.words = Words()
        self.ids, ends = self.words(texts)
        self.a, self.b = instances(self.ids)
        self.doc = np.searchsorted(ends, self.a, side="right")
        self.y, self.n = y.astype(np.float64), len(self.a)
        f, c = features(self.ids, self.a, self.b, np.array(self.words.own, np.uint64), np.array(self.words.start, np.uint64))
        often = np.bincount(f, minlength=1 << BITS) > 1  # a feature met once can only be learned by heart
        self.f, self.c = f[often[f]], c[often[f]]
        self.v = scale(self.a, self.b)[self.c]

    def steps(self, at: _Point, of: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, weight: np.ndarray, rounds: int) -> None:
        """Adaptive gradient steps on the logistic loss over the clauses with a weight. of: features in use, their clauses and scales."""
        f, c, v = of
        w, bias, seen, seen_b = at.w, at.bias, at.seen, at.seen_b
        for _ in range(rounds):
            r = (sigmoid(np.bincount(c, w[f] * v, self.n) + bias) - y) * weight
            g = np.bincount(f, r[c] * v, len(w)) + PENALTY * w
            seen += g * g
            w = w - 0.5 * g / np.sqrt(seen)
            seen_b += r.sum() ** 2
            bias -= 0.5 * r.sum() / np.sqrt(seen_b)
        at.w, at.bias, at.seen, at.seen_b = w, bias, seen, seen_b

    def z(self, w: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.c, w[self.f] * self.v, self.n) + bias

    def best(self, z: np.ndarray) -> np.ndarray:
        """Highest value of a clause of each document."""
        out = np.full(len(self.y), -36.0)
        np.maximum.at(out, self.doc, z)
        return out

    def fit(self, docs: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """Weights and bias from the chosen documents, and the clauses taken as positive."""
        use = docs[self.doc]
        here = np.flatnonzero(use[self.c])
        of = self.f[here], self.c[here], self.v[here]
        pos = use & (self.y[self.doc] == 1)
        share = np.bincount(self.doc, minlength=len(self.y))[self.doc]
        at = _Point()
        self.steps(at, of, pos.astype(float), np.where(pos, 1.0 / share, 1.0) * use, FIRST_STEPS)
        chosen = pos
        for _ in range(3):
            z = self.z(at.w, at.bias)
            chosen = pos & (z >= self.best(z)[self.doc])
            self.steps(at, of, chosen.astype(float), (chosen | (use & ~pos)).astype(float), NEXT_STEPS)
        return at.w, at.bias, chosen


def out_of_fold(s: _Sample, folds: int, use: np.ndarray | None = None) -> np.ndarray:
    """Value of each document under the model of the other folds."""
    fold = np.arange(len(s.y)) % folds
    out = np.full(len(s.y), -36.0)
    for k in range(folds):
        w, bias, _ = s.fit((fold != k) if use is None else (fold != k) & use)
        out = np.where(fold == k, s.best(s.z(w, bias)), out)
    return out


def best_cut(z: np.ndarray, y: np.ndarray, beta: float = 0.5) -> float:
    """Value from which on documents count as positive, for the best F score."""
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum(y[order])
    score = (1 + beta**2) * hit / (np.arange(1, len(z) + 1) + beta**2 * y.sum())
    k = int(score.argmax())
    below = z[order[k + 1]] if k + 1 < len(z) else z[order[k]]
    return float((z[order[k]] + below) / 2)


def fit(texts: list[str], toxic: np.ndarray, folds: int = 3) -> ClauseModel:
    """The model of reviewed, restored texts in a fixed order. Without positive or negative reviews nothing is learned."""
    y = np.asarray(toxic)
    if not (y == 1).any() or not (y == 0).any():
        return ClauseModel()
    s = _Sample(texts, y)
    z = out_of_fold(s, folds)
    enough = (y == 1).sum() >= 20
    doubted = np.zeros(len(y), bool)
    if enough:
        lowest = np.sort(z[y == 1])[int(MOST_DOUBTED * (y == 1).sum())]  # with few reviews the models of the folds know too little to doubt more
        doubted = ((y == 1) & (sigmoid(z) < 0.1) & (z < lowest)) | ((y == 0) & (sigmoid(z) > 0.9))
    w, bias, chosen = s.fit(~doubted)
    if enough:
        bias -= best_cut(z[~doubted], y[~doubted])
    return ClauseModel(w.astype(np.float32), bias, _telling(s, chosen))


def _telling(s: _Sample, chosen: np.ndarray) -> frozenset[str]:
    """Words at least eight times as frequent in clauses taken as positive as in those of negative documents."""
    n = len(s.words.own)

    def count(of: np.ndarray) -> np.ndarray:
        a, b = s.a[of], s.b[of]
        at = np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
        return np.bincount(s.ids[at], minlength=n)

    one, rest = count(np.flatnonzero(chosen)), count(np.flatnonzero(s.y[s.doc] == 0))
    ratio = (one + 0.5) / (one.sum() + 1) / ((rest + 0.5) / (rest.sum() + 1))
    good = (one >= 2) & (ratio >= 8)
    return frozenset(w for w, k in s.words.number.items() if k and good[k] and len(w) > 2 and w.isalpha())


class Scorer:
    """Scores batches of restored texts; remembers the hashes of words it met."""

    MOST = 500_000  # words remembered before it starts anew

    def __init__(self, model: ClauseModel) -> None:
        self.model, self.words = model, Words()

    def scores(self, texts: list[str]) -> np.ndarray:
        if len(self.words.own) > self.MOST:
            self.words = Words()
        ids, ends = self.words(texts)
        a, b = instances(ids)
        out = np.full(len(texts), -36.0)
        if len(a):
            f, c = features(ids, a, b, np.array(self.words.own, np.uint64), np.array(self.words.start, np.uint64))
            z = np.bincount(c, self.model.weights[f], len(a)) * scale(a, b) + self.model.bias
            np.maximum.at(out, np.searchsorted(ends, a, side="right"), z)
        return np.where(out <= -36.0, 0.0, sigmoid(out))
