"""Counts of word-id sequences in a shallow trie whose leaves are hash containers, bounded in entries by spilling subtrees as sorted runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

ID = 8  # bytes of a word id


class HatTrie:
    """Keys are two or more word ids of ID bytes each. The root has a node for every first word: a hash container of what follows it, until that
    has more than ``burst`` entries; then it bursts into a container for each second word."""

    def __init__(self, burst: int = 4096):
        self.burst, self.nodes, self.entries = burst, {}, 0
        self.inner: dict[bytes, dict[bytes, dict[bytes, int]]] = {}

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """keys: a row of ids each, sorted by the first, so that a container is looked up once for all its keys."""
        raw, width = keys.astype(">i8").tobytes(), ID * keys.shape[1]
        numbers, nodes, inner = counts.tolist(), self.nodes, self.inner
        edges = np.flatnonzero(np.concatenate(([True], keys[1:, 0] != keys[:-1, 0], [True]))).tolist() if len(keys) else []
        for low, high in zip(edges[:-1], edges[1:]):
            first = raw[low * width : low * width + ID]
            children = inner.get(first)
            if children is None:
                box = nodes.setdefault(first, {})
                before = len(box)
                for j in range(low, high):
                    rest = raw[j * width + ID : (j + 1) * width]
                    box[rest] = box.get(rest, 0) + numbers[j]
                self.entries += len(box) - before
                if len(box) > self.burst:
                    self.inner[first] = self.bursted(nodes.pop(first))
            else:
                for j in range(low, high):
                    at = j * width + ID
                    box = children.setdefault(raw[at : at + ID], {})
                    rest = raw[at + ID : (j + 1) * width]
                    before = len(box)
                    box[rest] = box.get(rest, 0) + numbers[j]
                    self.entries += len(box) - before

    @staticmethod
    def bursted(box: dict[bytes, int]) -> dict[bytes, dict[bytes, int]]:
        children: dict[bytes, dict[bytes, int]] = {}
        for rest, n in box.items():
            children.setdefault(rest[:ID], {})[rest[ID:]] = n
        return children

    def sizes(self) -> list[tuple[int, bytes]]:
        small = [(len(box), first) for first, box in self.nodes.items()]
        return small + [(sum(map(len, children.values())), first) for first, children in self.inner.items()]

    def spill(self, most: int) -> Iterator[tuple[list[bytes], list[int]]]:
        """Takes out whole subtrees, the largest first, until ``most`` entries are left; each is a sorted run of keys with their counts."""
        for size, first in sorted(self.sizes(), reverse=True):
            if self.entries <= most:
                return
            self.entries -= size
            if first in self.nodes:
                run = sorted(self.nodes.pop(first).items())
            else:
                run = [(second + rest, n) for second, box in sorted(self.inner.pop(first).items()) for rest, n in sorted(box.items())]
            yield [first + rest for rest, _ in run], [n for _, n in run]
