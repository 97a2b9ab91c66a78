"""A threshold join of integer vectors: which rows score at least so much with each anchor of a block.

A batch of rows gets an inverted index by groups of dimensions, those of the most energy first. A row is posted in a group only while the norm of
what is left of it, times the largest norm of what is left of an anchor, can reach the lowest threshold; the dimensions after that are covered by
their suffix norm and stay out of the index. Rows stand in the order of their number of groups, so a group's posting list is a prefix of the batch
and its partial scores are one matrix product. After each group a pair whose partial score and remaining norms cannot reach the anchor's threshold
is pruned; few pairs left are finished one by one. Whatever passes is scored exactly.
"""

from __future__ import annotations

import numpy as np

GROUP = 16
#: Share of pairs under which they are finished one by one.
SPARSE = 1 / 32
#: Pairs finished at once, a bound on memory.
PAIRS = 1 << 16


def number_type(peak: float, size: int) -> type:
    """The fastest type that is exact for inner products of ``size`` integers of at most ``peak``."""
    most = peak * peak * max(1, size)
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def exact(values: np.ndarray, kind: type) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in values], object).reshape(values.shape) if kind is object else values.astype(kind)


def suffix_norms(values: np.ndarray) -> np.ndarray:
    """Column g: the norm of each row's dimensions from group g on; the last column is zero."""
    n, size = values.shape
    groups = -(-size // GROUP)
    squares = np.zeros((n, groups * GROUP))
    squares[:, :size] = values.astype(np.float64) ** 2
    by_group = squares.reshape(n, groups, GROUP).sum(axis=2)
    tails = np.concatenate((by_group[:, ::-1].cumsum(axis=1)[:, ::-1], np.zeros((n, 1))), axis=1)
    return np.sqrt(tails) * (1 + 1e-9)  # never below the true norm


class Anchors:
    """values: integers as doubles, dimensions in the order of the join."""

    def __init__(self, values: np.ndarray, kind: type):
        self.kind, self.values, self.norms = kind, exact(values, kind), suffix_norms(values)

    def join(self, rows: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all pairs that score ``least`` of the anchor or more. Anchors with an infinite ``least`` take no part."""
        active = np.flatnonzero(least < np.inf)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind))]
        if len(active) and len(rows):
            least, queries, left, norms = least[active], self.values[active], self.norms[active], suffix_norms(rows)
            groups, size = norms.shape[1] - 1, rows.shape[1]
            # A group is posted while what is left of the row can reach the lowest threshold.
            posted = np.logical_and.accumulate(norms[:, :-1] * left[:, :-1].max(axis=0) >= least.min(), axis=1).sum(axis=1)
            order = np.argsort(-posted, kind="stable")
            posted, norms, rows = posted[order], norms[order], exact(rows[order], self.kind)
            scores, live = np.zeros((len(active), len(rows)), self.kind), len(rows)
            for g in range(groups + 1):
                pairs = scores[:, :live].astype(np.float64) + left[:, [g]] * norms[:live, g] >= least[:, None] - 0.5
                few = g == groups or pairs.sum() <= SPARSE * pairs.size
                stay = 0 if few else int(np.searchsorted(-posted[:live], -g))  # rows from here on have no group g
                a, r = np.nonzero(pairs[:, stay:])
                r += stay
                score = scores[a, r]
                for first in range(0, len(a), PAIRS):
                    at = slice(first, first + PAIRS)
                    score[at] += (queries[a[at], g * GROUP :] * rows[r[at], g * GROUP :]).sum(axis=1)
                hit = score >= least[a]
                found.append((active[a[hit]], order[r[hit]], score[hit]))
                live = stay
                if not live:
                    break
                part = slice(g * GROUP, min(size, (g + 1) * GROUP))
                scores = scores[:, :live] + queries[:, part] @ rows[:live, part].T
        return tuple(np.concatenate(x) for x in zip(*found))
