"""Expectation-maximisation over votes of overlapping labellers, and a small linear model; both work on bounded numbers of rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: A labeller's votes: against, for, none.
VOTES = "-+0"


def hashed_sample(rows: DataFrame, keys: list[str], total: int, most: int) -> DataFrame:
    """About ``most`` of ``total`` rows (all, if there are no more), by a hash of keys. Each task filters its own rows; none are sorted."""
    if total <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(1_000_000)) < math.ceil(1_000_000 * most / total))


def vote_matrix(patterns: list[str]) -> np.ndarray:
    return np.array([[VOTES.index(v) for v in p] for p in patterns], np.int64).reshape(len(patterns), len(patterns[0]) if patterns else 0)


class LabelModel:
    """How likely each labeller votes each way for rows of either class, and how common the classes are."""

    def __init__(self, patterns: list[str], counts: list[int], rounds: int = 100, smooth: float = 1.0, prior: float = 0.5, anchored: bool = False):
        """patterns: one string of votes for each distinct pattern; counts: rows of each.

        Starts from the belief that a vote against outweighs the votes for; prior is the belief about rows without votes. anchored: votes keep their
        sign. Where the tables would have a vote for, or against, speak for the other class, it says nothing about either.
        """
        votes, weight = vote_matrix(patterns), np.array(counts, float)
        k = votes.shape[1] if len(patterns) else 0
        plus, minus = (votes == 1).sum(1), (votes == 0).sum(1)
        post = np.where(minus > 0, 0.1, np.where(plus > 0, 0.9, prior))
        self.prior, self.likely = prior, np.full((2, k, 3), 1 / 3)
        for _ in range(rounds if k else 0):
            for c, p in enumerate((1 - post, post)):
                w = weight * p
                table = np.stack([[(w * (votes[:, j] == v)).sum() for v in range(3)] for j in range(k)]) + smooth
                self.likely[c] = table / table.sum(1, keepdims=True)
            if anchored:
                self.anchor()
            self.prior = float(np.clip((weight * post).sum() / weight.sum(), 0.001, 0.999))
            new = self._posterior(votes)
            done = np.abs(new - post).max() < 1e-6
            post = new
            if done:
                break

    def anchor(self) -> None:
        """Votes of the wrong sign get the mean of both classes."""
        against, for_ = self.likely[:, :, 0], self.likely[:, :, 1]
        for cells, wrong in ((against, against[1] > against[0]), (for_, for_[1] < for_[0])):
            cells[:, wrong] = cells[:, wrong].mean(axis=0)

    def _posterior(self, votes: np.ndarray) -> np.ndarray:
        j = np.arange(votes.shape[1])
        scores = [np.log(self.likely[c][j, votes]).sum(1) + np.log((1 - self.prior, self.prior)[c]) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(scores[0] - scores[1], -50, 50)))

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """The probability of the class that labellers vote for."""
        return self._posterior(vote_matrix(patterns)) if patterns else np.zeros(0)

    def accuracy(self) -> list[float]:
        """Each labeller's estimated share of right votes, of the votes it casts."""
        cast = self.likely[:, :, :2].sum(2)
        right = self.likely[1][:, 1] * self.prior + self.likely[0][:, 0] * (1 - self.prior)
        return (right / np.maximum(1e-12, cast[1] * self.prior + cast[0] * (1 - self.prior))).tolist()


class Rows:
    """Sparse feature rows, one after another."""

    def __init__(self, features: list, values: list | None = None):
        sizes = np.array([len(f) for f in features], np.int64)
        self.n = len(sizes)
        self.row = np.repeat(np.arange(self.n), sizes)
        self.feature = np.concatenate([np.asarray(f, np.int64) for f in features]) if sizes.sum() else np.zeros(0, np.int64)
        self.value = np.concatenate([np.asarray(v, float) for v in values]) if values is not None and sizes.sum() else np.ones(len(self.feature))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.feature], self.n) if self.n else np.zeros(0)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.feature, self.value * g[self.row], size)[:size]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(rows: Rows, target: np.ndarray, size: int, weight: np.ndarray | None = None, l2: float = 1e-4, rounds: int = 400, rate: float = 0.1, pairs: tuple[Rows, Rows] | None = None, tie: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model, by Adam over all rows. target may be fractional.

    pairs, tie: rows that should score alike, two by two, and the price of the squared difference of their scores.
    """
    w, b = np.zeros(size), 0.0
    if not rows.n:
        return w, b
    weight = np.ones(rows.n) if weight is None else weight
    weight = weight / weight.sum()
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, rounds + 1):
        g = (sigmoid(rows.dot(w) + b) - target) * weight
        gw, gb = rows.back(g, size) + l2 * w, float(g.sum())
        if pairs is not None and tie and pairs[0].n:
            p, q = (sigmoid(x.dot(w) + b) for x in pairs)
            d = 2 * tie * (p - q) / pairs[0].n
            gp, gq = d * p * (1 - p), -d * q * (1 - q)
            gw += pairs[0].back(gp, size) + pairs[1].back(gq, size)
            gb += float(gp.sum() + gq.sum())
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w = w - rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, b
