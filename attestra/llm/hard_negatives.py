"""Hard-negative mining by threshold joins over an inverted index (see threshold_join).

Anchors travel in blocks of bounded size; a block is broadcast and each task joins its own rows with it, so vectors are not shuffled for the
search. A block takes two searches: one for the positives of its anchors, one for the windows below each positive. A search has rounds. Its
thresholds start where a bounded sample of rows says that a window will be full, and are lowered for those anchors alone that are
still short, until all windows are full or nothing is left below. Every task keeps no more than the best rows of each window, and raises its
own thresholds as they fill, so a round sends at most ``wanted`` rows of a window and task to the merge.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from attestra.llm.batches import bounded
from attestra.llm.threshold_join import Anchors, number_type
from attestra.session import materialize

#: Numbers in a block of anchors (bounds what is broadcast to 32 MB), rows of the sample that thresholds start from, and rows joined at once.
BLOCK_NUMBERS, SAMPLE, ROWS = 4_000_000, 4096, 1024
#: Anchors that a task joins at once.
ANCHORS = 1024
#: How many times deeper into the sample each round goes.
DEEPER = 8
FOUND = "slot long, id long, score long"


def usable(vec: Column) -> Column:
    """Not null, and all components finite numbers."""
    return vec.isNotNull() & F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), F.lit(False)))


def whole_vectors(rows: DataFrame, scale: float) -> DataFrame:
    """rows: id, label, vec (doubles). One row per id with vec as bytes: floor(scale * x) as little-endian doubles, which hold these integers exactly."""
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec")))
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("row")).select("id", "row.label", "row.vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = b.column(2)
            ends = np.concatenate(([0], np.cumsum(vec.value_lengths().to_numpy(zero_copy_only=False))))
            values = np.floor(scale * vec.flatten().to_numpy(zero_copy_only=False)).astype("<f8")
            cells = [values[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells, pa.binary())], names=["id", "label", "vec"])

    return bounded(rows).mapInArrow(run, "id long, label long, vec binary")


def matrix(cells: list[bytes], size: int) -> np.ndarray:
    """Missing components are zero."""
    out = np.zeros((len(cells), size))
    for i, c in enumerate(cells):
        out[i, : len(c) // 8] = np.frombuffer(c, "<f8")
    return out


def energies(vectors: DataFrame) -> tuple[np.ndarray, float]:
    """The sum of squares of each dimension, and the largest absolute value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, peak = np.zeros(0), np.zeros(0)
        for b in batches:
            cells = b.column(0).to_pylist()
            size = max(len(total), *(len(c) // 8 for c in cells), 0) if cells else len(total)
            m = matrix(cells, size)
            total = np.pad(total, (0, size - len(total))) + (m**2).sum(axis=0)
            peak = np.maximum(np.pad(peak, (0, size - len(peak))), np.abs(m).max(axis=0, initial=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(peak)], names=["at", "energy", "peak"])

    parts = vectors.select("vec").mapInArrow(run, "at long, energy double, peak double")
    rows = parts.groupBy("at").agg(F.sum("energy").alias("energy"), F.max("peak").alias("peak")).collect()  # a row per dimension
    energy = np.zeros(len(rows))
    for r in rows:
        energy[r["at"]] = r["energy"]
    return energy, max((r["peak"] for r in rows), default=0.0)


class Windows:
    """What a search looks for: slot s belongs to anchor ``of[s]`` and wants the best rows with low <= score <= high, of the anchor's own label
    (``same``) or of another."""

    def __init__(self, of: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, wanted: int):
        self.of, self.low, self.high, self.same, self.wanted = of, low, high, same, wanted

    def best(self, slot: np.ndarray, ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first ``wanted`` of each slot: higher scores, then smaller ids."""
        order = np.lexsort((ids, -score, slot)) if score.dtype != object else np.array(sorted(range(len(slot)), key=lambda i: (slot[i], -score[i], ids[i])), int)
        slot, ids, score = slot[order], ids[order], score[order]
        first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1]))[: len(slot)])
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.concatenate((first, [len(slot)]))))
        keep = rank < self.wanted
        return slot[keep], ids[keep], score[keep]

    def raised(self, least: np.ndarray, slot: np.ndarray, score: np.ndarray) -> np.ndarray:
        """``least`` of each slot, raised to the last score of those that are full; slot and score as from best()."""
        at, counts = np.unique(slot, return_counts=True)
        full = counts == self.wanted
        out = least.copy()
        out[at[full]] = np.maximum(out[at[full]], score[np.cumsum(counts) - 1][full].astype(np.float64))
        return out


class Block:
    """A block of anchors as the tasks get it."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, kind: type):
        self.ids, self.labels, self.values, self.kind = ids, labels, values, kind

    def search(self, windows: Windows, least: np.ndarray, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, id, score) of the best rows of each slot that score ``least`` of it or more. batches: ids, labels and values of rows."""
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind))
        parts = [slice(a, a + ANCHORS) for a in range(0, len(self.ids), ANCHORS)]
        joins = [Anchors(self.values[p], self.kind) for p in parts]
        by_anchor = np.argsort(windows.of, kind="stable")
        begin = np.searchsorted(windows.of[by_anchor], np.arange(len(self.ids) + 1))
        now = least
        for ids, labels, values in batches:
            lowest = np.full(len(self.ids), np.inf)
            np.minimum.at(lowest, windows.of, now)
            for part, join in zip(parts, joins):
                a, r, score = join.join(values, lowest[part])
                a = a + part.start
                right = (ids[r] != self.ids[a]) & ((labels[r] == self.labels[a]) == windows.same)
                a, r, score = a[right], r[right], score[right]
                times = begin[a + 1] - begin[a]
                slot = by_anchor[np.repeat(begin[a], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)]
                r, score = np.repeat(r, times), np.repeat(score, times)
                hit = (score >= now[slot]) & (score <= windows.high[slot])
                held = windows.best(*(np.concatenate(x) for x in zip(held, (slot[hit], ids[r[hit]], score[hit]))))
            now = windows.raised(least, held[0], held[2])
        return held


def decoded(batches: Iterator[pa.RecordBatch], order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for first in range(0, b.num_rows, ROWS):
            part = b.slice(first, ROWS)
            yield part.column(0).to_numpy(), part.column(1).to_numpy(), matrix(part.column(2).to_pylist(), len(order))[:, order]


def joined(vectors: DataFrame, order: np.ndarray, block: Block, windows: Windows, least: np.ndarray) -> DataFrame:
    """slot, id, score: what the tasks found, merged to the best of each slot."""
    sent = vectors.sparkSession.sparkContext.broadcast((block, windows, least, order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, windows, least, order = sent.value
        slot, ids, score = block.search(windows, least, decoded(batches, order))
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(ids), pa.array([int(s) for s in score], pa.int64())], names=["slot", "id", "score"])

    found = bounded(vectors).mapInArrow(run, FOUND)
    place = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= windows.wanted)


def starts(block: Block, windows: Windows, sample: tuple[np.ndarray, np.ndarray, np.ndarray], rank: int) -> np.ndarray:
    """The score of the sample's row of this rank in each slot's window, or the window's low end where the sample has fewer."""
    deep = Windows(windows.of, windows.low, windows.high, windows.same, rank)
    slot, _, score = block.search(deep, windows.low, iter([sample]))
    return deep.raised(windows.low, slot, score)


def filled(vectors: DataFrame, order: np.ndarray, block: Block, windows: Windows, sample: tuple, share: float) -> list[tuple[int, int, int, int]]:
    """(slot, id, score, place) of the best rows of all slots. Lowers thresholds for those that are short until they are full, or at their low end."""
    out, open_slots, rank = [], windows.low <= windows.high, max(1, math.ceil(2 * windows.wanted * share))
    while open_slots.any():
        least = np.where(open_slots, starts(block, windows, sample, rank) if rank < len(sample[0]) else windows.low, np.inf)
        rows = [tuple(r) for r in joined(vectors, order, block, windows, least).collect()]  # at most ``wanted`` for each slot of a bounded block
        count = np.bincount(np.array([r[0] for r in rows], np.int64), minlength=len(least))
        done = open_slots & ((count >= windows.wanted) | (least <= windows.low))
        out += [r for r in rows if done[r[0]]]
        open_slots &= ~done
        rank *= DEEPER
    return out


def hard_negatives(
    rows: DataFrame, anchor: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding", positives: int = 5, negatives: int = 5,
    low: int = 80, high: int = 100, scale: float = 256.0, block_numbers: int = BLOCK_NUMBERS, sample: int = SAMPLE,
) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x); a score is an inner product, and has to fit 64 bits. The positives of an anchor are the ``positives`` best
    other rows of its label; the negatives of both are the ``negatives`` best rows of another label with low * positive_score <= 100 * negative_score
    <= high * positive_score. Higher scores come first, ties by smaller id. All are given where there are fewer.

    Rows with a null id or label, a null vector, or a component that is null or not finite take no part. Of rows that share an id, the one with the
    smallest label and vector counts. Missing components of shorter vectors are zero; an empty vector scores zero. Anchors without a
    positive or a negative give no rows, and neither does an empty table. Other columns are not read. Nothing is capped: blocks and sample only order the work.
    """
    spark: SparkSession = rows.sparkSession
    picked = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"), anchor.alias("anchor"))
    vectors = materialize(whole_vectors(picked.select("id", "label", "vec"), scale), "vectors")
    names = picked.filter("anchor").select("id").distinct()
    energy, peak = energies(vectors)
    order, kind = np.argsort(-energy, kind="stable"), number_type(peak, len(energy))
    anchors = materialize(vectors.join(names, "id", "left_semi"), "anchors")
    n_rows, n_anchors = vectors.count(), anchors.count()
    blocks = max(1, -(-n_anchors * max(1, len(energy)) // block_numbers))
    some = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, n_rows // sample))) == 0).limit(2 * sample).select("id", "label", "vec").collect()
    base = tuple(np.array([r[c] for r in some], np.int64) for c in ("id", "label")) + (matrix([bytes(r["vec"]) for r in some], len(order))[:, order],)
    share, out = len(some) / max(1, n_rows), []
    for k in range(blocks if n_anchors else 0):
        part = sorted(anchors.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)) == k).select("id", "label", "vec").toLocalIterator())
        block = Block(*(np.array([r[c] for r in part], np.int64) for c in ("id", "label")), matrix([bytes(r["vec"]) for r in part], len(order))[:, order], kind)
        of, least = np.arange(len(part)), np.full(len(part), -np.inf)
        found = sorted((s, p, i, score) for s, i, score, p in filled(vectors, order, block, Windows(of, least, np.full(len(part), np.inf), True, positives), base, share))
        of, score = np.array([f[0] for f in found], np.int64), [int(f[3]) for f in found]
        bounds = [np.array(x, object if kind is object else np.float64) for x in ([-(-low * s // 100) for s in score], [high * s // 100 for s in score])]
        slots = filled(vectors, order, block, Windows(of, *bounds, False, negatives), base, share)
        result = [(int(block.ids[of[s]]), found[s][2], p, i, found[s][3], n) for s, i, n, p in slots]
        schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        out.append(materialize(spark.createDataFrame(result, schema), "negatives"))
    whole = out[0] if out else spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole
