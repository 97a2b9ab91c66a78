"""Links between texts whose sets of word shingles have a Jaccard similarity of a least value or more.

Candidates are texts that agree in one of 32 bands of four min-hashes; at a similarity of 0.8 a pair misses all bands with a chance of
5e-8, less above. A candidate is held against a lower bound first: a set's sketch has 2,048 bits, each the parity of the shingles that
fall on it, so the Hamming distance of two sketches never exceeds the number of shingles in which the sets differ. What passes is verified
on the whole sets (as 64-bit hashes of the shingles).

A key that many sets share is cut into blocks of about 512 sets by a hash, and blocks meet two by two, so no task holds a whole group;
blocks give back the pairs that pass the bound, not all pairs. Neighbours within a band are linked and contracted first, then the
most promising pair of every two groups; what is left between different groups is verified whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from attestra.llm.batches import bounded
from attestra.llm.bit_filter import Filter
from attestra.llm.components import connected_components
from attestra.llm.rows import first_row, text_hash
from attestra.llm.xxh64 import shingle_hashes
from attestra.session import materialize

SEED, BANDS, ROWS = 42, 32, 4
#: Shingles min-hashed at once, a bound on memory.
PART = 2048
#: Bits of a sketch, and sets of a key that meet at once.
SKETCH, BLOCK_SETS = 2048, 512
#: Sets of a key that are put in order together in the first pass.
SORTED_SETS = 4096
_random = np.random.default_rng(SEED)
FLIPS = _random.integers(0, 2**64, BANDS * ROWS, np.uint64)
FACTORS = _random.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The sorted hashes (uint64) of the different shingles of a text; a text of fewer words is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(words, size, SEED)]))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key (int64) for each band of min-hashes; none for an empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for first in range(0, len(hashes), PART):
        np.minimum(least, ((hashes[first : first + PART] ^ FLIPS[:, None]) * FACTORS[:, None]).min(1), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * MIX
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def sketch(hashes: np.ndarray) -> bytes:
    """The parities of the hashes' places."""
    odd = np.bincount((hashes % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def name_of(hashes: np.ndarray) -> int:
    """A signed 64-bit hash of the whole set."""
    name = xxhash.xxh64_intdigest(hashes.tobytes(), SEED)
    return name - 2**64 if name >= 2**63 else name


def summaries(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, h, fp, keys): the text's hash, the set's hash and its band keys for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text, size) for text in batch.column(2).to_pylist()]
            columns = [*batch.columns[:2], pa.array(map(name_of, sets), pa.int64()), pa.array(map(band_keys, sets), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "h", "fp", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    return bounded(rows).mapInArrow(run, f"id {kind}, h long, fp long, keys array<long>")


def whole_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """nodes: (fp, least). (fp, n, sketch, shingles) for each of them, and for few others, read again from the rows that ``least`` names: a filter of
    these rows goes to the texts, so that no text leaves its task."""
    wanted = nodes.select(F.unhex(F.lpad(F.hex(F.xxhash64("least.id", "least.h")), 16, "0")).alias("key")).distinct()
    sent = docs.sparkSession.sparkContext.broadcast(Filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).filter(pa.array(sent.value.has(batch.column(0).to_numpy())))
            sets = [shingles(text, size) for text in texts.to_pylist()]
            columns = [pa.array(map(name_of, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(map(sketch, sets), pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["fp", "n", "sketch", "shingles"])

    texts = docs.select(F.xxhash64(F.col(id_col), text_hash(F.col(text_col))).alias("row"), F.col(text_col).alias("text"))
    return bounded(texts).mapInArrow(run, "fp long, n long, sketch binary, shingles array<long>").dropDuplicates(["fp"])


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, ...) whose whole sets are similar enough."""
    a, b = (sets.select(F.col("fp").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    common, both = F.size(F.array_intersect("set_a", "set_b")), F.size("set_a") + F.size("set_b")
    return pairs.join(a, "a").join(b, "b").filter(common / (both - common) >= least).drop("set_a", "set_b")


def regrouped(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups: (fp, grp), links between groups (a, b): the groups after contraction."""
    found = connected_components(links).withColumnRenamed("node", "grp")
    return materialize(groups.join(found, "grp", "left").select("fp", F.coalesce("component", "grp").alias("grp")), "groups")


def neighbours(at: DataFrame) -> DataFrame:
    """at: (key, sets, fp, beside). Pairs (a, b) that sort side by side within a key; keys of many sets are cut by a hash first."""
    order = Window.partitionBy("key", "part").orderBy("beside", "fp")
    rows = at.withColumn("part", F.pmod(F.xxhash64("fp", "key"), F.ceil(F.col("sets") / SORTED_SETS)))
    pairs = rows.select(F.col("fp").alias("x"), F.lag("fp").over(order).alias("y")).filter("y IS NOT NULL")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def block_pairs(at: DataFrame, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(left, right): blocks of the sets of a key that still are in different groups; right is null where a block meets itself."""
    rows = at.select("key", "fp").join(groups, "fp")
    open_keys = rows.groupBy("key").agg(F.min("grp").alias("low"), F.max("grp").alias("high"), F.count(F.lit(1)).alias("sets")).filter("low < high")
    rows = rows.join(open_keys.select("key", F.ceil(F.col("sets") / BLOCK_SETS).cast("int").alias("blocks")), "key").join(sets.select("fp", "n", "sketch"), "fp")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    members = F.collect_list(F.struct("fp", "grp", "n", "sketch")).alias("members")
    blocks = materialize(rows.groupBy("key", "blocks", "block").agg(members), "blocks")
    many = blocks.filter("blocks > 1")
    left = many.select("key", F.col("block").alias("i"), F.col("members").alias("left"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("j")).filter("i < j")
    right = many.select("key", F.col("block").alias("j"), F.col("members").alias("right"))
    own = blocks.select(F.col("members").alias("left"), F.lit(None).cast(blocks.schema["members"].dataType).alias("right"))
    return own.union(left.join(right, ["key", "j"]).select("left", "right"))


def differences(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of the table of differing bits between two blocks' sketches, a few at a time, with the first row's number."""
    step = max(1, (1 << 20) // max(1, right.size))
    for first in range(0, len(left), step):
        yield first, np.bitwise_count(left[first : first + step, None] ^ right[None]).sum(2, dtype=np.int64)


def candidates(pairs: DataFrame, least: float, best: bool) -> DataFrame:
    """(a, b, ga, gb, d): sets of different groups whose sizes and sketches allow the similarity; d is the share of differing shingles
    that the sketches show. With ``best`` only the pair of the least d for every two groups of a row."""
    allowed = (1 - least) / (1 + least) + 1e-9

    def block(members: pa.StructScalar) -> tuple[np.ndarray, ...]:
        rows = members.values
        bits = np.frombuffer(b"".join(rows.field("sketch").to_pylist()), np.uint64).reshape(len(rows), SKETCH // 64)
        return (*(rows.field(c).to_numpy(zero_copy_only=False) for c in ("fp", "grp", "n")), bits)

    def near(left: pa.ListScalar, right: pa.ListScalar) -> list[np.ndarray]:
        fa, ga, na, xa = block(left)
        own = not right.is_valid
        fb, gb, nb, xb = (fa, ga, na, xa) if own else block(right)
        found = [np.empty((4, 0), np.int64)]
        shares = [np.empty(0)]
        for first, d in differences(xa, xb):
            part = slice(first, first + len(d))
            share = np.maximum(d, np.abs(na[part, None] - nb)) / (na[part, None] + nb)
            i, j = np.nonzero((share <= allowed) & (ga[part, None] != gb))
            i += first
            if own:
                i, j = i[i < j], j[i < j]
            found.append(np.stack([fa[i], fb[j], ga[i], gb[j]]))
            shares.append(share[i - first, j])
        out, share = np.concatenate(found, 1), np.concatenate(shares)
        if best and len(share):
            ends = np.sort(out[2:], 0)
            order = np.lexsort((share, ends[1], ends[0]))
            ends = ends[:, order]
            order = order[np.concatenate(([True], (ends[:, 1:] != ends[:, :-1]).any(0)))]
            out, share = out[:, order], share[order]
        return [*out, share]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1)):
                *out, share = near(left, right)
                if len(share):
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out), pa.array(share, pa.float64())], ["a", "b", "ga", "gb", "d"])

    return bounded(pairs).mapInArrow(run, "a long, b long, ga long, gb long, d double")


class Similar:
    """rows: id, h and fp (of the set) of every row; names: fp and ``first``, the row that stands for its component.

    linked: (id, h, name) of every row, where another method links them: the sets of a name are held against the smallest of them first, and then against
    each other as those of a band's key are, whether or not they share a band."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, least: float, size: int, linked: DataFrame | None = None):
        if not 0.8 <= least <= 1:
            raise ValueError("the bands find similarities of 0.8 to 1")
        summed = materialize(summaries(docs, id_col, text_col, size), "summaries")
        self.rows = summed.select("id", "h", "fp")
        nodes = summed.groupBy("fp").agg(F.min(first_row()).alias("least"), F.first("keys").alias("keys"))
        nodes = materialize(nodes, "nodes")
        # Rows of keys that several sets share; beside each key the next band's, so that a key's most similar sets sort side by side.
        at = nodes.select("fp", F.posexplode("keys").alias("band", "key"), "keys").selectExpr("key", "fp", f"keys[(band + 1) % {BANDS}] AS beside")
        shared = at.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1")
        at = at.hint("merge").join(shared, "key")  # Spark sizes the exploded keys too low, and would broadcast them
        if linked is not None:
            named = self.named(linked)
            at = at.unionByName(named.selectExpr("name AS key", "fp", "fp AS beside", "sets"))
        at = materialize(at, "bands")
        live = materialize(at.select("fp").distinct().join(nodes.select("fp", "least"), "fp"), "live")
        sets = materialize(whole_sets(docs, live, id_col, text_col, size), "sets")

        sided = neighbours(at)
        if linked is not None:
            sided = sided.unionByName(self.stars(named)).distinct()
        sided = materialize(sided, "pairs")
        groups = regrouped(live.select("fp", F.col("fp").alias("grp")), verified(sided, sets, least))
        pairs = candidates(block_pairs(at, groups, sets), least, best=True)
        best = pairs.groupBy(F.least("ga", "gb").alias("g"), F.greatest("ga", "gb").alias("h")).agg(F.min(F.struct("d", "a", "b")).alias("best"))
        best = materialize(best.select("g", "h", "best.a", "best.b"), "best")
        groups = regrouped(groups, verified(best, sets, least).select(F.col("g").alias("a"), F.col("h").alias("b")))
        left = candidates(block_pairs(at, groups, sets), least, best=False).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        left = verified(materialize(left, "left"), sets, least)
        a, b = (groups.select(F.col("fp").alias(x), F.col("grp").alias(f"g{x}")) for x in "ab")
        groups = regrouped(groups, left.join(a, "a").join(b, "b").select(F.col("ga").alias("a"), F.col("gb").alias("b")))

        names = groups.join(live, "fp").groupBy("grp").agg(F.min("least").alias("first"))
        names = groups.join(names, "grp").select("fp", "first")
        self.names = materialize(nodes.select("fp", "least").join(names, "fp", "left").select("fp", F.coalesce("first", "least").alias("first")), "names")

    def named(self, linked: DataFrame) -> DataFrame:
        """(name, fp, sets, least): the sets of each name that has several, how many, and the smallest of them."""
        linked = linked.select("id", "h", "name").distinct()
        several = linked.groupBy("name").count().filter("count > 1").select("name")
        by_row = linked.join(several, "name").select(F.col("id").alias("_id"), F.col("h").alias("_h"), "name")
        held = self.rows.join(by_row, self.rows["id"].eqNullSafe(by_row["_id"]) & (self.rows["h"] == by_row["_h"])).select("name", "fp").distinct()
        held = materialize(held, "held")
        sizes = held.groupBy("name").agg(F.count(F.lit(1)).alias("sets"), F.min("fp").alias("least")).filter("sets > 1")
        return materialize(held.join(sizes, "name"), "named")

    def stars(self, named: DataFrame) -> DataFrame:
        """Pairs (a, b) of the sets of each name with the smallest of them."""
        return named.filter("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, size: int = 5) -> DataFrame:
    """One row per input row: id, component_id (smallest id reachable over links, its own included).

    Rows link when the Jaccard similarity of their sets of ``size``-word shingles is ``least`` (0.8 or more) or higher. A text of fewer words
    is one shingle; null and empty texts have the empty set and link with each other. Null ids never name a component that has another id.
    Rows that repeat an id are rows of their own. Other columns of docs are not read. An empty table gives no rows.
    """
    found = Similar(docs, id_col, text_col, least, size)
    return found.rows.join(found.names, "fp").select(F.col("id").alias(id_col), F.col("first.id").alias("component_id"))
