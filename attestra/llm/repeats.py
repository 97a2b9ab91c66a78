"""Suffix-array dedup: every byte that is covered by a string of ``width`` bytes that starts anywhere else, too, is found and cut.

Windows (strings of ``width`` bytes) meet by content: a window's key is the smallest hash of the grams that it holds, so equal windows have one key, and
neighbouring windows mostly share it. A segment is a run of windows of one key with the bytes that they cover. Segments travel as digests first. All windows
of a segment that occurs twice are repeated, and those of a key with one segment, which holds the key's gram once, are not; what is left, one copy of each
distinct segment of the other keys, goes to shards by key. A shard is one text, sorted by external induction (see induced_sort): neighbours in the order of suffixes that share
``width`` bytes are repeated windows.

A passage that a third of all documents hold must not gather its many different surroundings under its keys. Counts of all grams, in
``BINS`` bins, tell which grams are common, and these are keys only of windows that hold no others. What remains under such a key is the passage itself,
equal everywhere, so it is one segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attestra.llm.batches import bounded, free_name, slices
from attestra.llm.bit_filter import Filter
from attestra.llm.induced_sort import sorted_suffixes
from attestra.llm.rows import inner_names, outer
from attestra.session import materialize

WIDTH, GRAM = 400, 128
#: Bins of grams, and how many times its share of all grams a bin holds if its grams are common.
BINS, COMMON = 1 << 16, 4
#: Windows looked at together, bytes of a shard, bytes of segments that a task remembers as sent.
STRETCH, SHARD, SENT = 1 << 20, 4 << 20, 200_000
SEGMENTS = "id {id}, h long, start long, windows int, key binary, digest binary, twice boolean"


def byte_numbers() -> np.ndarray:
    """A well-mixed odd number for each byte."""
    x = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


NUMBERS = byte_numbers()


def gram_size(width: int) -> int:
    """The largest power of two up to GRAM and a third of the window. Larger grams leave fewer segments of one key that have no window in common."""
    return 1 << min(GRAM, max(1, width // 3)).bit_length() - 1


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes (a power of two), each of the hashes of its halves."""
    h, half, factor = NUMBERS[data], 1, np.uint64(0x9E3779B97F4A7C15)
    while half < size:
        h = h[:-half] * factor + h[half:]
        factor, half = factor * factor + np.uint64(2), 2 * half
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def smallest_of(values: np.ndarray, count: int) -> np.ndarray:
    """The smallest of each ``count`` neighbours."""
    held = 1
    while 2 * held <= count:
        values = np.minimum(values[:-held], values[held:])
        held *= 2
    rest = count - held
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def bin_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64)


def stretches(batch: pa.RecordBatch, width: int) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
    """Bytes of some rows, joined, and for each of them (row, where it starts there, its windows, the place of its first window in the row). Texts
    of more than STRETCH windows come in parts that overlap."""
    parts, marks, at = [], [], 0
    for row, cell in enumerate(batch.column("text")):
        data = cell.as_buffer().to_pybytes()
        for first in range(0, max(0, len(data) - width + 1), STRETCH):
            windows = min(STRETCH, len(data) - width + 1 - first)
            parts.append(data[first : first + windows + width - 1])
            marks.append((row, at, windows, first))
            at += windows + width - 1
            if at >= STRETCH:
                yield b"".join(parts), marks
                parts, marks, at = [], [], 0
    if parts:
        yield b"".join(parts), marks


def common_bins(texts: DataFrame, width: int) -> np.ndarray:
    """The bins of common grams: at most BINS / COMMON numbers come to the driver."""
    size = gram_size(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BINS, np.int64)
        for batch in batches:
            for data, _ in stretches(batch, width):
                counts += np.bincount(bin_of(gram_hashes(np.frombuffer(data, np.uint8), size)), minlength=BINS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["bin", "n"])

    bins = materialize(texts.mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")), "bins")
    total = bins.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return np.array([r["bin"] for r in bins.filter(F.col("n") > COMMON * total // BINS + COMMON).select("bin").collect()], np.int64)


class Cutter:
    """Finds the segments of stretches."""

    def __init__(self, width: int, common: np.ndarray):
        self.width, self.size = width, gram_size(width)
        self.high = np.zeros(BINS, np.uint64)
        self.high[common] = np.uint64(1) << np.uint64(63)

    def segments(self, data: bytes, marks: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(mark, where it starts in the stretch, its windows, key, whether the key is there twice) of each segment, at most 4 * width windows long."""
        hashes = gram_hashes(np.frombuffer(data, np.uint8), self.size)
        values = (hashes >> np.uint64(1)) | self.high[bin_of(hashes)]
        keys = smallest_of(values, self.width - self.size + 1)
        begin, windows = (np.array([m[k] for m in marks], np.int64) for k in (1, 2))
        edge = np.zeros(len(keys) + 1, bool)
        edge[1:-1] = keys[1:] != keys[:-1]
        edge[begin] = True
        edge[begin + windows] = True
        start = np.flatnonzero(edge)
        size = np.diff(np.append(start, len(keys)))
        long = 4 * self.width
        times = -(-size // long)
        start = np.repeat(start, times) + long * (np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times))
        end = np.append(start[1:], len(keys))
        mark = np.searchsorted(begin, start, side="right") - 1
        inside = start < begin[mark] + windows[mark]
        start, mark = start[inside], mark[inside]
        counts, own = np.minimum(end[inside], begin[mark] + windows[mark]) - start, keys[start]
        ends = start + counts + self.width - self.size
        twice = [np.count_nonzero(values[a:z] == k) > 1 for a, z, k in zip(start.tolist(), ends.tolist(), own)]
        return mark, start, counts, own, np.array(twice, bool)


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def segments_of(texts: DataFrame, width: int, common: np.ndarray, id_type: str) -> DataFrame:
    """id, h, start, windows, key and digest of all segments of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(width, common)
        for batch in batches:
            for data, marks in stretches(batch, width):
                mark, start, windows, keys, twice = cutter.segments(data, marks)
                row, offset = (np.array([m[k] for m in marks], np.int64)[mark] for k in (0, 3))
                begin = np.array([m[1] for m in marks], np.int64)[mark]
                cells = [digest(data[a:z]) for a, z in zip(start.tolist(), (start + windows + width - 1).tolist())]
                own = [batch.column(c).take(pa.array(row)) for c in ("id", "h")]
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8), len(keys), [None, pa.py_buffer(keys.astype(">u8").tobytes())]).cast(pa.binary())
                rest = [pa.array(start - begin + offset), pa.array(windows.astype(np.int32)), raw, pa.array(cells, pa.binary()), pa.array(twice)]
                yield pa.RecordBatch.from_arrays([*own, *rest], names=["id", "h", "start", "windows", "key", "digest", "twice"])

    return texts.mapInArrow(run, SEGMENTS.format(id=id_type))


def texts_of(texts: DataFrame, width: int, common: np.ndarray, keys: Filter) -> DataFrame:
    """key, digest and bytes of the segments whose keys the filter lets through, each distinct one at least once."""
    sent = texts.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, seen = Cutter(width, common), set()
        for batch in batches:
            for data, marks in stretches(batch, width):
                _, start, windows, keys, _ = cutter.segments(data, marks)
                out = []
                for i in np.flatnonzero(sent.value.has(keys)).tolist():
                    text = data[start[i] : start[i] + windows[i] + width - 1]
                    name = digest(text)
                    if name not in seen:
                        if len(seen) >= SENT:
                            seen.clear()
                        seen.add(name)
                        out.append((keys[i].item().to_bytes(8, "big"), name, text))
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.binary()) for k in range(3)], names=["key", "digest", "text"])

    return texts.mapInArrow(run, "key binary, digest binary, text binary")


def shard_text(parts: list[bytes]) -> np.ndarray:
    """Segments as one text of symbols in the order of their bytes, one symbol below these after each, and the only zero at the end."""
    data = b"".join(parts)
    ends = np.cumsum([len(p) for p in parts])
    raw = np.frombuffer(data, np.uint8)
    there = np.zeros(256, bool)
    there[raw] = True
    kind = np.uint8 if there.sum() <= 254 else np.uint16
    symbol = (np.cumsum(there) + 1).astype(kind)  # from 2 on
    return np.append(np.insert(symbol[raw], ends, kind(1)), kind(0))


def repeated_windows(parts: list[bytes], width: int) -> list[list[list[int]]]:
    """For each segment the runs [first, past) of windows that occur anywhere else in the shard, or elsewhere in it."""
    order, shared = sorted_suffixes(shard_text(parts), width)
    full = np.append(shared >= width, False)
    again = np.zeros(len(order), bool)
    again[order[full[:-1] | full[1:]]] = True  # like the one before, or the one after
    out, at = [], 0
    for p in parts:
        own = np.diff(np.concatenate(([0], again[at : at + len(p) - width + 1].view(np.int8), [0])))
        out.append(np.stack((np.flatnonzero(own > 0), np.flatnonzero(own < 0)), axis=1).tolist())
        at += len(p) + 1
    return out


def sorted_shards(segments: DataFrame, width: int) -> DataFrame:
    """key, digest and runs of repeated windows. segments: key, digest, text; each partition is a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[bytes, bytes], bytes] = {}
        for batch in batches:
            found.update(zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2).to_pylist()))
        if found:
            runs = repeated_windows(list(found.values()), width)
            some = [(k, d, r) for (k, d), r in zip(found, runs) if r]
            cells = [pa.array([s[i] for s in some], pa.binary()) for i in range(2)] + [pa.array([s[2] for s in some], pa.list_(pa.list_(pa.int32())))]
            yield from slices([pa.RecordBatch.from_arrays(cells, names=["key", "digest", "runs"])], 10_000)

    return segments.mapInArrow(run, "key binary, digest binary, runs array<array<int>>")


def repeated_spans(texts: DataFrame, width: int = WIDTH, shard: int = SHARD) -> DataFrame:
    """texts: id, h, text (bytes). id, h and spans (unmerged [first, past) bytes) of the rows that have any; rows of equal id and h are one."""
    id_type = texts.schema["id"].dataType.simpleString()
    common = common_bins(texts, width)
    all_segments = materialize(segments_of(texts, width, common, id_type), "segments")
    distinct = materialize(all_segments.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("copies"), F.max("twice").alias("twice")), "distinct")
    shared = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"))
    shared = materialize(shared.filter("n > 1 OR twice").select("key"), "keys")
    several = distinct.filter("copies > 1").select("key", "digest", F.lit(None).cast("array<array<int>>").alias("runs"))
    if not shared.isEmpty():
        parts = materialize(texts_of(texts, width, common, Filter(shared)), "parts")
        size = parts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
        dealt = parts.repartition(max(1, -(-int(size) // shard)), "key")
        inner = materialize(sorted_shards(dealt, width), "runs")
        several = several.unionByName(inner.join(several.select("key", "digest"), ["key", "digest"], "left_anti"))
    marks = all_segments.join(several, ["key", "digest"])
    whole = F.array(F.array(F.lit(0), F.col("windows")))
    spans = F.transform(F.coalesce("runs", whole), lambda r: F.array(F.col("start") + r[0], F.col("start") + r[1] + F.lit(width - 1)))
    marks = marks.groupBy("id", "h", "start").agg(F.first(spans).alias("spans"))  # repeated rows have the same
    return marks.groupBy("id", "h").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(spans: Iterable[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, past in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], past)
        else:
            out.append([first, past])
    return out


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, shard: int = SHARD) -> DataFrame:
    """docs with a column ``_repeats``: struct of spans (merged [first, past) bytes of the text in UTF-8 that are covered by repeated strings) and kept (the other
    bytes, concatenated; they may cut a character). Where docs has a column of that name, the new one gets more underscores.

    A string is repeated if it starts at two places, of one document or of two, overlaps included; strings do not cross documents, and all are judged on
    the input. Null texts are empty. Shorter texts than ``width`` bytes have no such string. Ids may be null or repeat: rows of equal id and text are told
    apart by nothing, and get the same answer, as each repeats the other. Empty tables give no rows.
    """
    names = inner_names(docs)
    plain = docs.toDF(*names)
    text = F.coalesce(F.col(names[docs.columns.index(text_col)]), F.lit(""))
    own, h = F.col(names[docs.columns.index(id_col)]), F.xxhash64(text)
    texts = bounded(plain.select(own.alias("id"), h.alias("h"), text.cast("binary").alias("text")))
    spans = materialize(repeated_spans(texts, width, shard), "spans").select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("spans").alias("_spans"))
    found = plain.withColumns({"_h0": h, "_text": text.cast("binary")})
    found = found.join(spans, own.eqNullSafe(F.col("_id")) & (F.col("_h0") == F.col("_h")), "left").drop("_id", "_h", "_h0")
    found = found.withColumn("_kept", F.col("_text")).select(*names, "_text", "_spans", "_kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = [], []
            for cell, own in zip(batch.column("_text"), batch.column("_spans").to_pylist()):
                data, own, parts, at = cell.as_buffer().to_pybytes(), merged(own or []), [], 0
                for first, past in own:
                    parts.append(data[at:first])
                    at = past
                spans.append(own)
                kept.append(b"".join([*parts, data[at:]]))
            cells = [*batch.columns[:-2], pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, names=batch.schema.names)

    found = bounded(found).mapInArrow(run, found.schema)
    return found.select(*outer(docs), F.struct(F.col("_spans").alias("spans"), F.col("_kept").alias("kept")).alias(free_name("_repeats", docs.columns)))


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = cut_repeats(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", **options)
    total, kept = F.length(F.coalesce("text", F.lit("")).cast("binary")).cast("long"), F.length("_repeats.kept").cast("long")
    return out.select(
        F.col("id").alias(id_col), total.alias("n_bytes"), (total - kept).alias("n_removed"), F.size("_repeats.spans").cast("long").alias("n_spans"),
        F.sha2("_repeats.kept", 256).alias("kept_sha256"),
    )
