"""Benchmark decontamination: an FM-index for each shard of the corpus, searched for all benchmark phrases at once.

A phrase (window) is ten consecutive words of an item, or all words of a shorter item. Tasks read their rows in shards of bounded size.
Words outside the benchmark's vocabulary, and places where two neighbouring words are never neighbours in a phrase, cannot be crossed by
an occurrence: they become separators, and stretches shorter than the shortest phrase are left out of the index. What is left is indexed,
phrases are found by backward search, occurrences by sampled suffix positions, and overlapping ones merge into removal spans.

The benchmark travels to the tasks in blocks of at most ``block_chars`` characters. A task's worker searches its rows for BLOCKS of them; a larger benchmark
takes further passes, each on the written rows of the one before, so there is one worker a task whatever its size. Spans and items are merged in
the row itself, so no shuffle is needed and documents are never grouped.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attestra.llm.batches import bounded, free_name
from attestra.llm.fm_index import FMIndex
from attestra.llm.rows import inner_names, outer
from attestra.session import materialize

WIDTH = 10
#: Words of text in a shard, and benchmark characters in a block: bounds on a task's memory.
SHARD_WORDS, BLOCK_CHARS, BLOCKS = 250_000, 1_000_000, 4
#: Bytes of words stay (A-Z as a-z), all others become spaces.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


class Phrases:
    """The distinct windows of a block of items, as word numbers from 1 on, with the items that hold each."""

    def __init__(self, items: list[tuple[str, str]], width: int = WIDTH):
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                windows[tuple(ids[i : i + width])].add(item)
        self.windows = [np.array(w, np.int64) for w in windows]
        self.items = [sorted(x) for x in windows.values()]
        self.shortest = min(map(len, self.windows), default=0)
        size = len(self.vocabulary) + 1
        self.size = size
        self.pairs = np.unique(np.concatenate([w[:-1] * size + w[1:] for w in self.windows] or [np.zeros(0, np.int64)]))


def stretches(ids: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Which words may be part of an occurrence (those in a stretch of linked neighbours as long as the shortest phrase), and their stretches."""
    known = ids > 0
    key = ids[:-1] * phrases.size + ids[1:]
    slot = np.searchsorted(phrases.pairs, key)
    linked = known[:-1] & known[1:]
    linked[linked] = phrases.pairs[np.minimum(slot[linked], max(0, len(phrases.pairs) - 1))] == key[linked] if len(phrases.pairs) else False
    run = np.cumsum(np.concatenate(([True], ~linked)))  # the number of each word's stretch
    return known & (np.bincount(run)[run] >= phrases.shortest), run


def search_shard(docs: list[list[bytes]], phrases: Phrases) -> list[tuple[list[list[int]], set[str]]]:
    """For each document the merged spans [first word, past last word) of all occurrences, and the items that occur."""
    found: list[tuple[list[list[int]], set[str]]] = [([], set()) for _ in docs]
    get, counts = phrases.vocabulary.get, np.array([len(d) for d in docs], np.int64)
    if not counts.sum() or not phrases.windows:
        return found
    zero = 0
    ids = np.concatenate([np.fromiter((get(w, zero) for w in d), np.int64, len(d)) for d in docs])
    first = np.concatenate(([0], np.cumsum(counts)))
    owner = np.repeat(np.arange(len(docs)), counts)
    # A document's last word and the next one's first are not neighbours.
    cut = first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(ids))]
    spaced = np.insert(ids, cut, 0)
    back = np.insert(np.arange(len(ids)), cut, -1)
    keep, run = stretches(spaced, phrases)
    at = np.flatnonzero(keep)
    if not len(at):
        return found
    breaks = np.flatnonzero(np.concatenate(([True], run[at][1:] != run[at][:-1])))
    text, place = np.insert(spaced[at], breaks, 0), np.insert(back[at], breaks, -1)
    index = FMIndex(text, phrases.size)
    low, high = index.search(phrases.windows)
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return found
    sizes = high[hit] - low[hit]
    which = np.repeat(hit, sizes)
    rows = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[which]
    begin = place[index.locate(rows)]
    lengths = np.array([len(w) for w in phrases.windows], np.int64)
    order = np.argsort(begin, kind="stable")
    for b, w in zip(begin[order].tolist(), which[order].tolist()):
        d = int(owner[b])
        spans, items = found[d]
        b -= int(first[d])
        e = b + int(lengths[w])
        if spans and b <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], e)
        else:
            spans.append([b, e])
        items.update(phrases.items[w])
    return found


def merge_spans(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return out


FOUND = "_n_words long, _spans array<array<int>>, _items array<string>"


def search_blocks(docs: list[list[bytes]], blocks: list[Phrases]) -> list[tuple[list[list[int]], set[str]]]:
    """``search_shard`` for several blocks, what they find merged."""
    out = search_shard(docs, blocks[0])
    for phrases in blocks[1:]:
        out = [(merge_spans(a + b) if b else a, x | y) for (a, x), (b, y) in zip(out, search_shard(docs, phrases))]
    return out


def one_pass(docs: DataFrame, blocks: list[list[tuple[str, str]]], text_at: int, width: int, shard_words: int) -> DataFrame:
    """docs, whose last three columns are those of FOUND, with the occurrences of some blocks of items added to them."""
    sent = docs.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = [Phrases(items, width) for items in sent.value]
        for batch in batches:
            texts = batch.column(text_at)
            counts: list[int] = []
            found: list[tuple[list[list[int]], set[str]]] = []
            shard: list[list[bytes]] = []
            held = 0
            for i in range(batch.num_rows):
                words = words_of(texts[i].as_py())
                counts.append(len(words))
                shard.append(words)
                held += len(words)
                if held >= shard_words or i == batch.num_rows - 1:
                    found += search_blocks(shard, phrases)
                    shard, held = [], 0
            old_spans, old_items = (batch.column(batch.num_columns - k).to_pylist() for k in (2, 1))
            spans = [merge_spans((a or []) + b) if a else b for a, (b, _) in zip(old_spans, found)]
            ids = [sorted({*(a or []), *b}) for a, (_, b) in zip(old_items, found)]
            new = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(ids, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *new], names=batch.schema.names)

    return bounded(docs).mapInArrow(run, docs.schema)


def searched(docs: DataFrame, benchmark: DataFrame, text_col: str, width: int = WIDTH, block_chars: int = BLOCK_CHARS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs under the names _c0, _c1 and so on, and the columns of FOUND. No name of docs can clash with these."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text")).filter("item IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.length("text") + F.length("item")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(total) // block_chars))
    names = inner_names(docs)
    out = docs.toDF(*names).selectExpr(*names, "0L AS _n_words", "CAST(NULL AS array<array<int>>) AS _spans", "CAST(NULL AS array<string>) AS _items")
    for first in range(0, blocks, BLOCKS):
        own = [[(r["item"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).toLocalIterator()] for k in range(first, min(blocks, first + BLOCKS))]
        out = one_pass(materialize(out, "searched", outside=True) if first else out, own, docs.columns.index(text_col), width, shard_words)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with a column ``_leaks``: struct of n_words, spans (merged [first, past last) word numbers) and items (sorted item ids). Where docs has a
    column of that name, the new one gets more underscores.

    benchmark: item_id, text. Null texts have no words; items without words, or with a null id, match nothing; repeated items count once.
    A document of any length is searched whole. Empty tables give no rows, or no leaks.
    """
    leaks = F.struct(F.col("_n_words").alias("n_words"), F.col("_spans").alias("spans"), F.col("_items").alias("items"))
    return searched(docs, benchmark, text_col, **options).select(*outer(docs), leaks.alias(free_name("_leaks", docs.columns)))


def leak_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256 and contaminated. Other columns of docs are not read."""
    out = find_leaks(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), benchmark, "text", **options)
    hits = F.aggregate("_leaks.spans", F.lit(0), lambda s, x: s + x[1] - x[0]).cast("long")
    return out.select(
        F.col("id").alias(id_col),
        F.col("_leaks.n_words").alias("n_words"),
        hits.alias("n_hit"),
        F.size("_leaks.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_leaks.items", ","), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents without any occurrence, all columns as they were."""
    return searched(docs, benchmark, text_col, **options).filter(F.size("_items") == 0).select(*outer(docs))


def cut_spans(text: str, spans: list[list[int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    flat = raw.translate(TABLE)
    starts = [i for i in range(len(flat)) if flat[i] != 32 and (i == 0 or flat[i - 1] == 32)]
    out, at = [], 0
    for first, past in spans:
        last = starts[past - 1]
        end = flat.find(b" ", last)
        out.append(raw[at : starts[first]])
        at = len(raw) if end < 0 else end
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def cut_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with the removal spans cut out of the texts; other columns as they were."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.num_columns - 2).to_pylist()
            texts = [cut_spans(t, s) if t and s else t for t, s in zip(batch.column(at).to_pylist(), spans)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, batch.schema.field(at).type), *batch.columns[at + 1 :]], names=batch.schema.names)

    found = searched(docs, benchmark, text_col, **options)
    return found.mapInArrow(run, found.schema).select(*outer(docs))
