"""Token counts by byte-pair merging with a heap and a linked list; no token ids are made.

A word's bytes are its first symbols. The heap holds the rank of every adjacent pair; the lowest is popped, its two symbols become one,
and the pairs with the new neighbours go on the heap. The count is the number of first symbols less the number of merges.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from attestra.llm.batches import bounded

# Fixed value: how the byte-level vocabulary cuts a text into words before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters are cut by the pattern above; for others the tokenizer library cuts, as Unicode versions differ.
PLAIN = re.compile(r"[\n\x20-\x7E\xA1-ɏ]*")
TWO_SPACES = re.compile(r"[ \n]{2}")
#: Words whose count a task remembers, and how long they are at most: bounds on its memory.
REMEMBERED, SHORT = 400_000, 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file: itself, or the next free one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Merger:
    """Counts the tokens of a word under the merges of a byte-level BPE file."""

    def __init__(self, model: dict):
        number = {s: i for i, s in enumerate(byte_symbols())}
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            new = number.setdefault(left + right, len(number))
            self.ranks.setdefault(number[left] << 32 | number[right], rank)
            self.made.append(new)

    def count(self, word: bytes) -> int:
        symbols, ranks, made = list(word), self.ranks, self.made
        n = left = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := ranks.get(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if symbols[i] < 0 or j >= n or ranks.get(symbols[i] << 32 | symbols[j]) != rank:
                continue  # one of the two was merged meanwhile
            symbols[i], symbols[j] = made[rank], -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(symbols[i] << 32 | symbols[k])) is not None:
                    heappush(heap, r << 32 | i)
            if (k := before[i]) >= 0 and (r := ranks.get(symbols[k] << 32 | symbols[i])) is not None:
                heappush(heap, r << 32 | k)
        return left


class Counter:
    """Counts the tokens of texts; remembers words and the pieces between spaces."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        loaded = json.loads(spec)
        self.merger, self.cut = Merger(loaded["model"]), Tokenizer.from_str(spec).pre_tokenizer.pre_tokenize_str
        specials = [x["content"] for x in loaded["added_tokens"]]
        self.specials = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.find = regex.compile(WORDS).findall
        self.bytes = {s: b for b, s in enumerate(byte_symbols())}
        self.words: dict[bytes, int] = {}
        self.pieces: dict[str, int] = {}

    def word(self, word: bytes) -> int:
        n = self.words.get(word)
        if n is None:
            n = self.merger.count(word)
            if len(word) <= SHORT:
                if len(self.words) >= REMEMBERED:
                    self.words.clear()
                self.words[word] = n
        return n

    def spaced(self, pieces: list[str]) -> int:
        """Tokens of pieces of plain text, each with the space before it."""
        known = self.pieces
        new = set(pieces).difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set(pieces)
        for p in new:
            known[p] = self.piece(p)
        total = sum(map(known.__getitem__, pieces))
        for p in new:
            if len(p) > SHORT:
                del known[p]
        return total

    def piece(self, piece: str) -> int:
        return sum(self.word(w.encode()) for w in self.find(" " + piece))

    def stretch(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not PLAIN.fullmatch(text):
            return sum(self.word(bytes(map(self.bytes.__getitem__, w))) for w, _ in self.cut(text)) if text else 0
        if TWO_SPACES.search(text):
            return sum(self.word(w.encode()) for w in self.find(text))
        first, *rest = text.split(" ")
        return sum(self.word(w.encode()) for w in self.find(first)) + self.spaced(rest)

    def count(self, text: str) -> int:
        if self.specials is None:
            return self.stretch(text)
        stretches = self.specials.split(text)
        return len(stretches) - 1 + sum(map(self.stretch, stretches))


_counters: dict[int, Counter] = {}


def counter_for(spec: str) -> Counter:
    """One counter for each vocabulary, kept from task to task in the same worker."""
    key = hash(spec)
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(spec)
    return _counters[key]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens).

    vocabulary: path, on the driver, of a byte-level BPE file for the tokenizers library. Strings of special tokens inside a text are one
    token each. Null texts count as empty, which has no tokens. Texts of any length are counted whole. Other columns of docs are not read.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(spec.value)
        for batch in batches:
            counts = pa.array([counter.count(t) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    rows = bounded(rows).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return rows.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
