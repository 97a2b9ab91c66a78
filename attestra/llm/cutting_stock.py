"""Cutting stock by column generation: which patterns of length classes fill sequences, and how many sequences use each."""

from __future__ import annotations

import numpy as np


def best_pattern(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern (count of each size 1..capacity; value[size]) of the largest total value."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        each = best[c - 1 :: -1][:c] + value[1 : c + 1]
        k = int(np.argmax(each)) + 1
        best[c], took[c] = (each[k - 1], k) if each[k - 1] > best[c - 1] else (best[c - 1], 0)
    pattern, c = np.zeros(capacity + 1, np.int64), capacity
    while c > 0:
        k = int(took[c])
        pattern[k] += k > 0
        c -= max(k, 1)
    return float(best[capacity]), pattern


def column_generation(demand: np.ndarray, capacity: int, gap: float = 1e-4, smooth: float = 0.9) -> list[tuple[np.ndarray, float]]:
    """Patterns with their (fractional) numbers of sequences that give exactly the demand of each size, as few in all as ``gap`` allows.

    The master program is solved by the revised simplex method; its prices go to the knapsack, whose best pattern enters the basis. No
    pattern is worth more than ``worth`` sequences at some prices, so the fewest sequences are at least the demand's value at these prices
    divided by worth: it ends when the present number is within ``gap`` of the best such bound. Prices are drawn towards those of the best
    bound (``smooth``), which keeps them from swinging; where the pattern found with them gains nothing at the true prices, those are used.
    """
    sizes = np.flatnonzero(demand)
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return []
    need = demand[sizes].astype(float)
    columns = [np.bincount([s] * (capacity // s), minlength=capacity + 1) for s in sizes]
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    x, bound, centre = inverse @ need, 0.0, None
    while True:
        true = inverse.sum(0)
        for prices in ([true] if centre is None else [smooth * centre + (1 - smooth) * true, true]):
            value = np.zeros(capacity + 1)
            value[sizes] = np.maximum(prices, 0)
            worth, pattern = best_pattern(value, capacity)
            lower = float(value[sizes] @ need) / max(worth, 1e-12)
            if lower > bound:
                bound, centre = lower, value[sizes] / max(worth, 1e-12)
            if float(true @ pattern[sizes]) > 1 + 1e-9:
                break
        else:
            break
        if x.sum() <= bound * (1 + gap):
            break
        d = inverse @ pattern[sizes]
        up = d > 1e-9
        ratio = np.full(len(d), np.inf)
        ratio[up] = np.maximum(x[up], 0) / d[up]
        r = int(np.argmin(ratio))
        step = ratio[r]
        x -= step * d
        x[r] = step
        inverse[r] /= d[r]
        d[r] = 0
        inverse -= np.outer(d, inverse[r])
        columns[r] = pattern
    return [(c, max(0.0, float(v))) for c, v in zip(columns, x)]


def whole_patterns(demand: np.ndarray, capacity: int, patterns: list[tuple[np.ndarray, float]] | None = None) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole numbers of sequences that give exactly the demand: the given ones (else those of column generation) rounded down, the small
    rest by first fit from the largest."""
    left, out = demand.astype(np.int64).copy(), []
    for pattern, x in column_generation(demand, capacity) if patterns is None else patterns:
        used = np.flatnonzero(pattern)
        n = min(int(x + 1e-6), *(int(left[s] // pattern[s]) for s in used)) if len(used) else 0
        if n > 0:
            left -= n * pattern
            out.append((pattern, n))
    left[0] = 0
    while left.any():
        pattern, room = np.zeros(capacity + 1, np.int64), capacity
        for s in np.flatnonzero(left)[::-1]:
            pattern[s] = min(left[s], room // s)
            room -= int(pattern[s]) * int(s)
        used = np.flatnonzero(pattern)
        n = int((left[used] // pattern[used]).min())
        left -= n * pattern
        out.append((pattern, n))
    return out
