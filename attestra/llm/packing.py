"""Packing documents into token sequences by cutting-stock column generation.

A document's full sequences are cut off first; its rest is an item. Items fall into length classes (``grain`` tokens wide), whose histogram,
a bounded table whatever the corpus, goes to the driver. Column generation, run once over all items, finds the patterns of classes that need
the fewest sequences; items of a class are ranked, and ranks decide pattern, sequence and slot. As documents may be cut freely, some of them,
chosen by a hash of the id in 256ths of the corpus and only as many as it takes to fill the room that the patterns leave, are cut to fill
it exactly; what is left of them fills sequences of its own, the last of them of a power of two tokens. So nothing is padded.

Ids are made twice for that small share and once for the rest: checksums of every possible uncut piece come with the lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from attestra.llm.batches import bounded, slices
from attestra.llm.cutting_stock import column_generation, whole_patterns
from attestra.llm.word_ids import encoder_for
from attestra.session import materialize

LENGTH, GRAIN, END_ID = 4096, 16, 2
#: Parts of the documents that can be set aside for cutting, and buckets of running totals and ranks.
SHARES, BUCKETS = 256, 64
KEY = ["id", "h"]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, h (hash of the text), share (which of SHARES parts, by the id) and text. Equal rows are interchangeable, so id and h are key enough."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.pmod(F.xxhash64(F.lit("share"), F.col(id_col)), F.lit(SHARES)).alias("share"), text.alias("text"))


def measured(docs: DataFrame, spec, length: int, end_id: int) -> DataFrame:
    """id, h, share, n (tokens with the end) and crcs: a checksum for each full sequence of the document and for its rest."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(spec.value)
        for batch in slices(batches):
            ns, crcs = [], []
            for text in batch.column(3).to_pylist():
                ids = encoder.encode(text) + end
                ns.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[i : i + 4 * length]) for i in range(0, len(ids), 4 * length)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ns, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["id", "h", "share", "n", "crcs"])

    kind = docs.schema["id"].dataType.simpleString()
    return bounded(docs).mapInArrow(run, f"id {kind}, h long, share long, n long, crcs array<long>")


def encoded(docs: DataFrame, spec, end_id: int) -> DataFrame:
    """id, h and ids (binary) of the documents to be cut."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(spec.value)
        for batch in slices(batches):
            ids = pa.array([encoder.encode(t) + end for t in batch.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], ids], ["id", "h", "ids"])

    kind = docs.schema["id"].dataType.simpleString()
    return bounded(docs).mapInArrow(run, f"id {kind}, h long, ids binary")


def running_total(df: DataFrame, value: str, key: list[str]) -> DataFrame:
    """df with ``begin``: the total of value over the rows before, in an order by hash bucket, then key. Only bucket sums meet in one task."""
    rows = df.withColumn("_b", F.pmod(F.xxhash64(*key), F.lit(16 * BUCKETS)))
    within = Window.partitionBy("_b").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_b").agg(F.sum(value).alias("_t"))
    sums = sums.select("_b", F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    rows = rows.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return rows.join(F.broadcast(sums), "_b").withColumn("begin", F.col("_in") + F.col("_off")).drop("_b", "_in", "_off")


def ranked(items: DataFrame) -> DataFrame:
    """items with their rank in their class ``q``, longest first within a hash bucket."""
    rows = items.withColumn("_b", F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)))
    sums = rows.groupBy("q", "_b").count()
    sums = sums.select("q", "_b", F.coalesce(F.sum("count").over(Window.partitionBy("q").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy("q", "_b").orderBy(F.desc("n"), *KEY)))
    return rows.join(F.broadcast(sums), ["q", "_b"]).withColumn("rank", F.col("_in") - 1 + F.col("_off")).drop("_b", "_in", "_off")


def layout_rows(patterns: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, past last rank, items in a sequence, first sequence) for each class of each pattern."""
    rows, reached, sequence = [], {}, 0
    for pattern, n in patterns:
        for q in np.flatnonzero(pattern).tolist():
            a, first = int(pattern[q]), reached.get(q, 0)
            reached[q] = first + a * n
            rows.append((q, first, reached[q], a, sequence))
        sequence += n
    return rows


class Plan:
    """Which documents are cut, and the patterns for the rests of the others.

    counts: items by share and class; rests and tokens: tokens of the items, and of the documents, by share. Patterns for all items are found once.
    Setting a share aside scales them down; the first shares that together have as many tokens as the rest's patterns leave room are cut.
    """

    def __init__(self, counts: np.ndarray, rests: np.ndarray, tokens: np.ndarray, length: int, classes: int):
        whole = column_generation(counts.sum(0), classes)
        room = sum(x for _, x in whole) * length - int(rests.sum())
        items = max(1, int(counts[:, 1:].sum()))
        first = int(len(counts) * room / max(1.0, tokens.sum() + room))
        for self.share in range(first, len(counts) + 1):
            left = counts[self.share :].sum(0)
            scale = left[1:].sum() / items
            self.patterns = whole_patterns(left, classes, [(p, x * scale) for p, x in whole])
            self.sequences = sum(n for _, n in self.patterns)
            #: Tokens that the patterns leave free, which would be padding if nothing were cut.
            self.room = self.sequences * length - int(rests[self.share :].sum())
            if tokens[: self.share].sum() >= self.room:
                break


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, grain: int = GRAIN, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Every token of every row is in exactly one piece.

    vocabulary: path, on the driver, of a tokenizers file. Null texts count as empty: their only token is the end. Rows that repeat an id are
    packed each; other columns of docs are not read. Sequence ids are unique, and gapless from 0 but for the kinds that are empty.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    texts = keyed(docs, id_col, text_col)
    sizes = materialize(measured(texts, spec, length, end_id).withColumn("q", F.ceil((F.col("n") % length) / grain).cast("int")), "sizes")

    classes = length // grain
    counts = np.zeros((SHARES, classes + 1), np.int64)
    rests, tokens, full = np.zeros(SHARES, np.int64), np.zeros(SHARES, np.int64), np.zeros(SHARES, np.int64)
    rows = sizes.groupBy("share", "q").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("n") % length).alias("r"), F.sum("n").alias("n"), F.sum(F.expr(f"n div {length}")).alias("f"))
    for row in rows.collect():  # at most SHARES * (classes + 1) rows
        counts[row["share"], row["q"]] = row["c"]
        rests[row["share"]] += row["r"]
        tokens[row["share"]] += row["n"]
        full[row["share"]] += row["f"]
    plan = Plan(counts, rests, tokens, length, classes)
    share, patterns, sequences, room = plan.share, plan.patterns, plan.sequences, plan.room
    full_sequences = int(full[share:].sum())

    whole = sizes.filter(F.col("share") >= share)
    # Full sequences of documents that stay uncut beyond them.
    chunks = running_total(whole.filter(f"n >= {length}").withColumn("f", F.expr(f"n div {length}")), "f", KEY)
    chunks = chunks.select("id", "n", "begin", F.posexplode(F.slice("crcs", F.lit(1), F.col("f").cast("int"))).alias("k", "crc"))
    chunks = chunks.select("id", (F.col("k") * length).cast("long").alias("start"), F.lit(length).cast("long").alias("length"), "crc", "n", (F.col("begin") + F.col("k") + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    layout = spark.createDataFrame(layout_rows(patterns), "q int, lo long, hi long, a long, seq long")
    items = ranked(whole.filter("q > 0").select(*KEY, "n", "q", F.element_at("crcs", -1).alias("crc")))
    items = items.join(F.broadcast(layout), (items["q"] == layout["q"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).drop(layout["q"])
    items = items.select(*KEY, "n", "q", "crc", (F.col("n") % length).alias("length"), F.expr("seq + (rank - lo) div a").alias("sequence_id"), F.expr("(rank - lo) % a").alias("slot"))
    earlier = Window.partitionBy("sequence_id").orderBy(F.desc("q"), "slot").rowsBetween(Window.unboundedPreceding, -1)
    items = materialize(items.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))), "items")
    bodies = items.select("id", (F.col("n") - F.col("length")).alias("start"), "length", "crc", "n", "sequence_id", "offset")

    # Cut documents lie end to end on one axis, first over the rooms, then over sequences of their own.
    rooms = items.groupBy("sequence_id").agg(F.sum("length").alias("used")).filter(f"used < {length}").withColumn("room", length - F.col("used"))
    rooms = materialize(running_total(rooms, "room", ["sequence_id"]), "rooms")
    cut = materialize(running_total(sizes.filter(F.col("share") < share).select(*KEY, "n"), "n", KEY), "cut")
    over = lambda b, e: F.explode(F.sequence(F.expr(f"{b} div {length}"), F.expr(f"({e} - 1) div {length}")))
    a = cut.filter(F.col("begin") < room).withColumn("cell", over("begin", "(begin + n)"))
    b = rooms.select("sequence_id", "used", F.col("begin").alias("r0"), (F.col("begin") + F.col("room")).alias("r1")).withColumn("cell", over("r0", "r1"))
    low, high = F.greatest("begin", "r0"), F.least(F.col("begin") + F.col("n"), F.col("r1"))
    fills = a.join(b, (a["cell"] == b["cell"]) & (low < high) & ((low / length).cast("long") == a["cell"]))
    fills = fills.select(*KEY, "n", (low - F.col("begin")).alias("start"), (high - low).alias("length"), "sequence_id", (F.col("used") + low - F.col("r0")).alias("offset"))
    own = cut.filter(F.col("begin") + F.col("n") > room).withColumn("from", F.greatest(F.col("begin") - room, F.lit(0)))
    own = own.withColumn("to", F.col("begin") + F.col("n") - room)
    # The last sequence's tokens go to sequences whose lengths are powers of two, which need no padding.
    past = max(0, int(tokens[:share].sum()) - room)
    at, first, ends = past // length * length, past // length, []
    for size in (1 << k for k in range(length.bit_length() - 1, -1, -1)):
        if past % length & size:
            ends.append((at, at + size, first))
            at, first = at + size, first + 1
    parts = own.filter(F.col("from") < past // length * length).withColumn("s", over("from", "to")).filter(F.col("s") < past // length)
    parts = parts.withColumn("b", F.col("s") * length).withColumn("e", (F.col("s") + 1) * length)
    if ends:
        ends = F.array(*[F.struct(*[F.lit(x).cast("long").alias(c) for c, x in zip(("b", "e", "s"), end)]) for end in ends])
        parts = parts.unionByName(own.filter(F.col("to") > past // length * length).select("*", F.inline(ends)))
    low, high = F.greatest("from", "b"), F.least("to", "e")
    own = parts.filter(low < high).select(*KEY, "n", (low + room - F.col("begin")).alias("start"), (high - low).alias("length"), (F.col("s") + sequences + full_sequences).alias("sequence_id"), (low - F.col("b")).alias("offset"))
    pieces = fills.unionByName(own).groupBy("id", "h", "n").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    ids = encoded(texts.filter(F.col("share") < share), spec, end_id).dropDuplicates(KEY)
    return chunks.unionByName(bodies).unionByName(with_ids(pieces, ids)).select(F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset")


def with_ids(pieces: DataFrame, ids: DataFrame) -> DataFrame:
    """Pieces of cut documents with their checksums; a document's ids are read once for all its pieces."""
    rows = pieces.join(ids, pieces["id"].eqNullSafe(ids["id"]) & (pieces["h"] == ids["h"])).select(pieces["id"], "n", "ids", "pieces")
    cut: Column = F.expr("transform(pieces, p -> struct(p.start AS start, p.length AS length, p.sequence_id AS sequence_id, p.offset AS offset, crc32(substr(ids, CAST(p.start * 4 + 1 AS int), CAST(p.length * 4 AS int))) AS crc))")
    return rows.select("id", "n", F.inline(cut)).select("id", "start", "length", "crc", "n", "sequence_id", "offset")
