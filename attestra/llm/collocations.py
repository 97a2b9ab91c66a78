"""Phrase collocation mining: phrases of frequent words, counted in tries, scored by their weakest cut.

A word of a language stands for a 64-bit id, a hash of it that is checked to be no other word's. A phrase that occurs often enough has only words and
neighbouring pairs that do. What is frequent travels to the tasks as a filter of bounded size (two bits of a bit set for each entry); what it lets
through wrongly is counted exactly as well and falls short of the least count.

First pairs, and then, size by size, sequences whose beginning and end may be frequent, are counted by codes of a few bytes (see likely), which leaves out
nearly all that are rare; what is left is counted exactly. Each task puts its sequences into a trie (see hat_trie), batch by batch, repeats of a batch as one. When it is full, whole subtrees leave it as
sorted runs, which Spark exchanges by language and prefix (the first two words) and merges. A hot phrase is one row of a run, and runs of a hot
word are spread over its second words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from attestra.llm.batches import bounded, slices
from attestra.llm.bit_filter import Filter, mixed
from attestra.llm.hat_trie import ID, HatTrie
from attestra.session import materialize

LEAST, LONGEST, TOP = 100, 5, 2000
#: Bounds of a task: words counted before they are handed on, and their bytes; words whose ids it remembers, and their length; entries of its tries.
WORDS, WORD_BYTES, REMEMBERED, SHORT, ENTRIES = 300_000, 64 << 20, 300_000, 64, 600_000
#: Of a first count of pairs: how many of them make a part, and the largest count that is told apart.
PART, COUNTED_TO = 4_000_000, 60_000
#: A-Z as a-z, separators of pieces as full stops, tabs as spaces; all other bytes stay. What is left of white space are spaces.
TABLE = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
COUNTED = "lang string, key binary, n long"


def counted_words(docs: DataFrame) -> DataFrame:
    """docs: lang, text (bytes). lang, word and n, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        size = length = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                cells = [pa.array([lang] * len(words), pa.string()), pa.array(words.keys(), pa.binary()), pa.array(words.values(), pa.int64())]
                yield from slices([pa.RecordBatch.from_arrays(cells, names=["lang", "key", "n"])], 50_000)
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = held.setdefault(lang, Counter())
                before = len(words)
                words.update(text.as_py().translate(TABLE).replace(b".", b" ").split())
                size += len(words) - before
                length += (len(words) - before) and len(text.as_buffer())
                if size > WORDS or length > WORD_BYTES:
                    yield from out()
                    size = length = 0
        yield from out()

    counts = docs.mapInArrow(run, COUNTED).groupBy("lang", "key").agg(F.sum("n").alias("n"))
    return counts.select("lang", F.col("key").cast("string").alias("word"), "n")


def salt_of(words: DataFrame, least: int) -> str:
    """What goes before a word when it is hashed: empty, or longer until no frequent word shares its id with another word, or has the separator's."""
    salt = ""
    while True:
        ids = words.groupBy("lang", word_id(salt).alias("id")).agg(F.count(F.lit(1)).alias("words"), F.max("n").alias("most"))
        if ids.filter((F.col("most") >= least) & ((F.col("words") > 1) | (F.col("id") == 0))).isEmpty():
            return salt
        salt += "#"


def word_id(salt: str) -> Column:
    return F.xxhash64(F.concat(F.lit(salt), F.col("word")))


def id_rows(docs: DataFrame, words: Filter, salt: str) -> DataFrame:
    """lang and ids of every row: words that may be frequent by their ids, one zero for what stands between them."""
    sent = docs.sparkSession.sparkContext.broadcast(words)
    prefix = salt.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[bytes, int]] = {}
        frequent = sent.value
        for batch in batches:
            ids = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = text.as_py().translate(TABLE).replace(b".", b" . ").split()
                memo = known.setdefault(lang, {b".": 0})
                new = list(set(tokens).difference(memo))
                if sum(map(len, known.values())) + len(new) > REMEMBERED:
                    known.clear()
                    memo = known[lang] = {b".": 0}
                    new = list(set(tokens).difference(memo))
                hashes = np.fromiter((xxhash.xxh64_intdigest(prefix + w, 42) for w in new), np.uint64, len(new))
                memo.update(zip(new, np.where(frequent.has(hashes), hashes, np.uint64(0)).view(np.int64).tolist()))
                row = np.fromiter(map(memo.__getitem__, tokens), np.int64, len(tokens))
                for w in new:
                    if len(w) > SHORT:
                        del memo[w]
                stays = np.ones(len(row), bool)
                stays[1:] = (row[1:] != 0) | (row[:-1] != 0)
                ids.append(np.append(row[stays], 0))
            ends = np.cumsum([0, *map(len, ids)])
            cells = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), cells], names=["lang", "ids"])

    return docs.mapInArrow(run, "lang string, ids array<long>")


class Hints:
    """The codes of sequences of a size that may be frequent. A code has the upper half of a sequence's mixed number, and of the lower half the part that it was
    counted in."""

    def __init__(self, codes: DataFrame, parts: int):
        self.parts, self.filter = parts, Filter(codes)

    @staticmethod
    def code(numbers: np.ndarray, parts: int) -> np.ndarray:
        return numbers & (np.uint64(0xFFFFFFFF) << np.uint64(32) | np.uint64(parts - 1))

    def has(self, numbers: np.ndarray) -> np.ndarray:
        return self.filter.has(self.code(numbers, self.parts))


def places(ids: np.ndarray, size: int, hints: list[Hints]) -> tuple[np.ndarray, np.ndarray]:
    """Where sequences of a size begin whose shorter parts may all be frequent, and their mixed numbers. hints: of the sizes from 2 on, as far as they are known."""
    start = np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0))
    number = mixed(ids[start], ids[start + 1])
    for longer, known in zip(range(3, size + 1), hints):
        stays = known.has(number)
        start, number = start[stays], number[stays]
        both = np.flatnonzero(start[1:] == start[:-1] + 1)  # its end begins one further
        start = start[both]
        number = mixed(number[both], ids[start + longer - 1])
    if len(hints) > size - 2:
        stays = hints[size - 2].has(number)
        start, number = start[stays], number[stays]
    return start, number


def likely(rows: DataFrame, tokens: int, least: int, size: int, hints: list[Hints]) -> Hints:
    """Which sequences of a size may occur ``least`` times: a first count of their codes, packed, in as many parts as keep one small. hints: of the sizes below.

    Most are rare, and as codes of four bytes with a saturated count they cost little to exchange; the exact count then has few left.
    """
    parts = 1 << max(4, (tokens // PART).bit_length())
    sent = rows.sparkSession.sparkContext.broadcast(hints)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, held = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            own, at = np.unique(np.concatenate(codes), return_inverse=True)
            n = np.minimum(np.bincount(at, np.concatenate(counts)), COUNTED_TO).astype("<u2")
            order = np.argsort((own & np.uint64(parts - 1)).astype(np.uint32), kind="stable")
            part, upper, n = (own & np.uint64(parts - 1)).astype(np.int32)[order], (own >> np.uint64(32)).astype("<u4")[order], n[order]
            edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
            cells = [[x[a:z].tobytes() for a, z in zip(edges[:-1], edges[1:])] for x in (upper, n)]
            yield pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]]), *(pa.array(c, pa.binary()) for c in cells)], names=["part", "upper", "counts"])

        for batch in batches:
            ids = batch.column(1).flatten().to_numpy()  # rows begin and end with what is no word
            own, n = np.unique(Hints.code(places(ids, size, sent.value)[1], parts), return_counts=True)
            codes, counts, held = [*codes, own], [*counts, n], held + len(own)
            if held > PART:
                yield from out()
                codes, counts, held = [], [], 0
        if held:
            yield from out()

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        upper = np.frombuffer(b"".join(table["upper"].to_pylist()), "<u4")
        n = np.frombuffer(b"".join(table["counts"].to_pylist()), "<u2")
        own, at = np.unique(upper, return_inverse=True)
        some = own[np.bincount(at, n) >= min(least, COUNTED_TO)].astype(np.uint64) << np.uint64(32) | np.uint64(table["part"][0].as_py())
        keys = some.astype(">u8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([keys[i : i + ID] for i in range(0, len(keys), ID)], pa.binary())], names=["key"])

    packed = bounded(rows).mapInArrow(run, "part int, upper binary, counts binary")
    return Hints(materialize(packed.groupBy("part").applyInArrow(frequent, "key binary"), "hints"), parts)


def likely_sequences(rows: DataFrame, tokens: int, least: int, longest: int) -> list[Hints]:
    hints: list[Hints] = []
    for size in range(2, longest + 1):
        hints.append(likely(rows, tokens, least, size, hints))
    return hints


def sequences(ids: np.ndarray, sizes: range, hints: list[Hints]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) of the distinct sequences of each size, sorted by their first id. hints: which sequences of each size may be frequent."""
    for size in sizes:
        start, _ = places(ids, size, hints)
        if not len(start):
            return
        words = np.stack([ids[start + j] for j in range(size)], axis=1)
        order = np.lexsort(words.T[::-1])
        words = words[order]
        first = np.flatnonzero(np.concatenate(([True], (words[1:] != words[:-1]).any(axis=1))))
        yield words[first], np.diff(np.append(first, len(words)))


def counted(rows: DataFrame, sizes: range, hints: list[Hints], least: int) -> DataFrame:
    """lang, key and n of all sequences of these sizes that occur ``least`` times or more."""
    sent = rows.sparkSession.sparkContext.broadcast(hints)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, HatTrie] = {}

        def runs(most: int) -> Iterator[pa.RecordBatch]:
            for lang, trie in tries.items():
                for keys, counts in trie.spill(most // len(tries)):
                    cells = [pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.binary()), pa.array(counts, pa.int64())]
                    yield from slices([pa.RecordBatch.from_arrays(cells, names=["lang", "key", "n"])], 50_000)

        def put(lang: str, parts: list[np.ndarray]) -> None:
            trie = tries.setdefault(lang, HatTrie())
            for keys, counts in sequences(np.concatenate(parts), sizes, sent.value):
                trie.add(keys, counts)

        waiting: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            cells = batch.column(1)
            values, ends = cells.flatten().to_numpy(), np.concatenate(([0], np.cumsum(cells.value_lengths().to_numpy())))
            for i, lang in enumerate(batch.column(0).to_pylist()):
                own = waiting.setdefault(lang, [])
                own.append(values[ends[i] : ends[i + 1]])
            for lang in list(waiting):
                put(lang, waiting.pop(lang))
            if sum(t.entries for t in tries.values()) > ENTRIES:
                yield from runs(ENTRIES // 2)
        yield from runs(0)

    prefix = F.substring("key", 1, 2 * ID)
    found = bounded(rows).mapInArrow(run, COUNTED)
    return found.repartition("lang", prefix).groupBy("lang", "key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def scored(phrases: DataFrame, parts: DataFrame, totals: DataFrame) -> DataFrame:
    """phrases (lang, key, n of the phrase) with l, r and score of the lowest-scoring cut. parts: lang, key and n of whatever a cut can leave."""
    words = (F.length("key") / ID).cast("int")
    cuts = phrases.select("lang", "key", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), words - 1)).alias("cut"))
    cuts = cuts.withColumns({"left": F.expr(f"substring(key, 1, {ID} * cut)"), "right": F.expr(f"substring(key, {ID} * cut + 1)")})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.select("lang", F.col("key").alias(side), F.col("n").alias(name)), ["lang", side])
    big = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").withColumns({"over": F.lit(1000).cast("decimal(4,0)") * big("a") * big("n"), "under": big("l") * big("r")})
    cuts = cuts.withColumn("score", F.expr("over div under"))
    best = F.min(F.struct("score", "cut", "l", "r")).alias("best")
    return cuts.groupBy("lang", "key", "a", "n").agg(best).select("lang", "key", "a", "n", "best.score", "best.l", "best.r")


def covered(phrases: DataFrame, share: int) -> DataFrame:
    """lang and key of phrases whose words lie inside a longer one that is, in percent, ``share`` times as frequent or more."""
    words = F.length("key") / ID
    inner = F.expr(f"""
        flatten(transform(sequence(2, int(length(key) / {ID}) - 1), k -> transform(sequence(0, int(length(key) / {ID}) - k), i -> substring(key, {ID} * i + 1, {ID} * k))))""")
    longer = phrases.filter(words > 2).select("lang", F.explode(inner).alias("key"), "n").groupBy("lang", "key").agg(F.max("n").alias("longer"))
    return phrases.join(longer, ["lang", "key"]).filter(F.col("longer") * 100 >= F.col("n") * share).select("lang", "key")


def with_text(found: DataFrame, words: DataFrame) -> DataFrame:
    """found with the phrase, words joined by spaces. words: lang, key, word."""
    ids = F.expr(f"transform(sequence(1, int(length(key) / {ID})), i -> substring(key, {ID} * (i - 1) + 1, {ID}))")
    cells = found.select("lang", "key", F.posexplode(ids).alias("at", "id")).join(words.select("lang", F.col("key").alias("id"), "word"), ["lang", "id"])
    text = cells.groupBy("lang", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return found.join(text, ["lang", "key"])


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = 100
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at marks and line ends, and these into words at spaces and tabs. a: how often the phrase
    occurs within pieces, overlaps included; candidates have 2 to ``longest`` words and a >= ``least``. n: all words of the language. Of a candidate's cuts into
    two parts that occur l and r times, the one of the lowest score floor(1000 * a * n / (l * r)) counts, ties to the shorter first part. Candidates
    that lie inside a longer one with 100 * f(longer) >= share * a are dropped. Order: score, a (both descending), phrase (by bytes).

    Null texts have no words; a null language is ``und``. Repeated rows count each time. Ids and other columns are not read. Languages without
    candidates, and empty tables, give no rows. All arithmetic is exact.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    texts = bounded(texts)
    words = materialize(counted_words(texts), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    salt = salt_of(words, least)
    key = F.unhex(F.lpad(F.hex(word_id(salt)), 16, "0"))
    frequent = materialize(words.filter(F.col("n") >= least).select("lang", key.alias("key"), "n", "word"), "frequent")
    rows = materialize(id_rows(texts, Filter(frequent), salt), "ids")
    tokens = totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    phrases = materialize(counted(rows, range(2, longest + 1), likely_sequences(rows, int(tokens), least, longest), least), "phrases")
    parts = frequent.select("lang", "key", "n").unionByName(phrases)
    found = scored(phrases, parts, totals).join(covered(phrases, share), ["lang", "key"], "left_anti")
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = with_text(materialize(found, "scored"), frequent).withColumn("rank", F.row_number().over(place).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
