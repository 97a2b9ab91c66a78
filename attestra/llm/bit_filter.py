"""Sets of 64-bit ids, or of pairs of them, as filters of bounded size that travel to the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: The largest filter in bits (32 MB).
FILTER_BITS = 1 << 28


def mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One number for a pair of ids."""
    x = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Filter:
    """Two bits of ``bits`` for each entry. It never denies an entry, and lets few others through while it has room for 16 bits an entry."""

    def __init__(self, entries: DataFrame):
        """entries: key (big-endian bytes of one id, or of a pair). The bit set is merged on the executors; the driver gets no more than its size."""
        self.bits = 1 << min(FILTER_BITS.bit_length() - 1, max(10, (16 * entries.count()).bit_length()))
        bits = self.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">i8").astype(np.int64).reshape(batch.num_rows, -1)
                at = np.unique(np.concatenate(Filter.probes(ids[:, 0] if ids.shape[1] == 1 else mixed(ids[:, 0], ids[:, 1]), bits)))
                masks = (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int64)), pa.array(masks)], names=["slot", "mask"])

        slots = entries.select("key").mapInArrow(run, "slot long, mask long").groupBy("slot").agg(F.expr("bit_or(mask)").alias("mask")).toPandas()
        self.words = np.zeros(bits >> 6, np.uint64)
        self.words[slots["slot"].to_numpy(np.int64)] = slots["mask"].to_numpy(np.int64).view(np.uint64)

    @staticmethod
    def probes(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        ids, mask = ids.astype(np.uint64), np.uint64(bits - 1)
        return (ids & mask).astype(np.int64), ((ids >> np.uint64(32)) & mask).astype(np.int64)

    def has(self, ids: np.ndarray) -> np.ndarray:
        out = np.ones(len(ids), bool)
        for at in self.probes(ids, self.bits):
            out &= ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
        return out
