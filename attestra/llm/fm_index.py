"""A word-level FM-index of one shard: suffix array, Burrows-Wheeler transform, wavelet matrix, sampled suffix positions.

The text is an array of symbols. Zeros are separators: no pattern holds one, and every separator counts as different from any other, so
comparisons end at the first one.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by prefix doubling. Separators come first, in the order of their positions."""
    n = len(text)
    gaps = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(gaps)
    rank[gaps] = np.arange(len(gaps))
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        if step < n:
            after[:-step] = rank[step:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1]))) if n else key
        rank = new
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector a level, most significant bit first, each with its prefix counts."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for shift in range(bits - 1, -1, -1):
            bit = (seq >> shift) & 1
            ones = np.concatenate(([0], np.cumsum(bit))).astype(np.int32)
            self.levels.append((shift, ones, len(seq) - int(ones[-1])))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place of the sequence."""
        low, high = np.zeros(len(at), np.int64), at.astype(np.int64)
        for shift, ones, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            low, high = (np.where(one, zeros + ones[x], x - ones[x]) for x in (low, high))
        return high - low


class FMIndex:
    def __init__(self, text: np.ndarray, alphabet: int, sample: int = 8):
        """text: symbols below alphabet, zeros between stretches, a zero first."""
        order = suffix_array(text)
        self.bwt = text[order - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=alphabet))))
        self.wavelet = WaveletMatrix(self.bwt, max(1, int(alphabet - 1).bit_length()))
        sampled = (order % sample == 0) | (self.bwt == 0)
        self.sampled = np.concatenate(([0], np.cumsum(sampled)))
        self.is_sampled, self.positions = sampled, order[sampled]

    def search(self, patterns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that start with each pattern, by backward search of all patterns at once. Empty patterns find nothing."""
        lengths = np.array([len(p) for p in patterns], np.int64)
        low, high = np.zeros(len(patterns), np.int64), np.where(lengths > 0, len(self.bwt), 0)
        if not len(patterns):
            return low, high
        width = int(lengths.max())
        table = np.zeros((len(patterns), width), np.int64)
        for i, p in enumerate(patterns):
            table[i, width - len(p) :] = p
        live = np.flatnonzero(lengths > 0)
        for back in range(1, width + 1):
            go = live[lengths[live] >= back]
            if not len(go):
                break
            c = table[go, width - back]
            low[go] = self.before[c] + self.wavelet.rank(c, low[go])
            high[go] = self.before[c] + self.wavelet.rank(c, high[go])
            live = live[high[live] > low[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: step back from each until one whose position was sampled."""
        rows, out, steps = rows.astype(np.int64), np.empty(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            hit = self.is_sampled[rows[left]]
            done = left[hit]
            out[done] = self.positions[self.sampled[rows[done]]] + steps
            left = left[~hit]
            c = self.bwt[rows[left]].astype(np.int64)
            rows[left] = self.before[c] + self.wavelet.rank(c, rows[left])
            steps += 1
        return out
