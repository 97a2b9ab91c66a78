"""SimHash near-dedup: fingerprints of word shingles, linked by a grid join over per-segment bit counts.

A fingerprint's 64 bits are cut into 32 segments of two bits. Its embedding is the vector of the segments' bit counts (0, 1 or 2); the
Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints. Counts are written in unary (00, 01, 11),
so that this distance is the number of differing bits of two 64-bit words.

The segments form blocks. Of at most ``most`` differing bits at most ``most`` blocks have other counts, so two fingerprints that link
agree in all counts of some choice of blocks: every choice is a grid, and a fingerprint's counts in its blocks are its cell. What shares a cell
is held against the Manhattan bound, then against the bits. Any number of blocks above ``most`` finds all links; more blocks make smaller
cells and more of them, so their number follows the number of fingerprints (``blocks_for``).

A first pass links fingerprints that sit side by side in a narrow cell and contracts them; the grid join then only returns links between
different contracted groups, so a large group of near copies does not turn into all its pairs.

With ``similarity`` texts link by the Jaccard similarity of their shingle sets instead (attestra.llm.similarity).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from attestra.llm.batches import bounded
from attestra.llm.components import connected_components
from attestra.llm.rows import first_row, keep_first, text_hash
from attestra.llm.similarity import Similar
from attestra.llm.xxh64 import shingle_hashes
from attestra.session import materialize, scratch_scope

SEED, BITS = 42, 64
#: First and last segment of each band of the first pass.
BANDS = ((0, 10), (11, 21), (22, 31))


def bit_sums(words: list[bytes], size: int) -> tuple[np.ndarray, int]:
    """How often each bit (most significant first) is set among the hashes of the words' shingles, and the number of shingles."""
    sums, total = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(words, size, SEED):
        sums += np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
        total += len(hashes)
    return sums, total


def fingerprint(text: str | None, size: int = 4) -> int:
    """The signed 64-bit fingerprint of a text; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    sums, total = bit_sums(words, size)
    return int(np.packbits(sums * 2 > total).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(id, h, fp): the hash and the fingerprint of every whole text. Null texts have no words, so fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t, size) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], ["id", "h", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    return bounded(rows).mapInArrow(run, f"id {kind}, h long, fp long")


def unary(fp: Column) -> Column:
    """The embedding: two bits 00, 01 or 11 for the bit count of each segment."""
    half = F.lit(0x5555555555555555)
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(half)
    low = fp.bitwiseAND(half)
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def side_by_side(nodes: DataFrame, most: int) -> DataFrame:
    """Links between neighbours in the order of fingerprints within a cell of two bands (cheap; not all links)."""
    out = None
    for x, y in ((0, 1), (1, 2), (2, 0)):
        keys = [F.shiftrightunsigned("emb", 2 * BANDS[b][0]).bitwiseAND(F.lit((1 << (2 * (BANDS[b][1] - BANDS[b][0] + 1))) - 1)) for b in (x, y)]
        rows = nodes.select("fp", keys[0].alias("k0"), keys[1].alias("k1"))
        pairs = rows.selectExpr("fp AS a", "lag(fp) OVER (PARTITION BY k0, k1 ORDER BY fp) AS b").filter(f"b IS NOT NULL AND bit_count(a ^ b) <= {most}")
        out = pairs if out is None else out.union(pairs)
    return out


def grid(blocks: int, most: int) -> list[int]:
    """A mask over the embedding for each choice of ``blocks - most`` of the blocks."""
    edges = [32 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << 2 * (high - low)) - 1) << 2 * low for low, high in zip(edges, edges[1:])]
    return [sum(parts[i] for i in chosen) for chosen in combinations(range(blocks), blocks - most)]


def blocks_for(n: int, most: int) -> int:
    """The fewest blocks with which a fingerprint of ``n`` shares its cells with about as many others as it has cells, or fewer.

    Two random bits have counts 0, 1, 2 in shares 1/4, 1/2, 1/4, so two segments agree with a chance of 3/8.
    """
    for blocks in range(most + 1, 2 * most + 5):
        masks = grid(blocks, most)
        if n / 2 * sum(0.375 ** (m.bit_count() // 2) for m in masks) <= len(masks):
            break
    return blocks


def links(nodes: DataFrame, most: int = 4, blocks: int | None = None) -> DataFrame:
    """nodes: (fp, grp). Links (a, b) at ``most`` or fewer differing bits between fingerprints of different grp, each at least once.

    Spark sizes the exploded cells like the nodes, a row each, so without the hint it would broadcast up to hundreds of times its bound."""
    masks = [m - 2**64 if m >= 2**63 else m for m in grid(blocks or blocks_for(nodes.count(), most), most)]
    cells = nodes.select("fp", "grp", F.posexplode(F.array(*map(F.lit, masks))).alias("choice", "mask"))
    cells = cells.select("choice", unary(F.col("fp")).bitwiseAND(F.col("mask")).alias("cell"), "fp", "grp")
    a, b = (cells.select("choice", "cell", F.col("fp").alias(x), F.col("grp").alias(f"g{x}")).hint("merge") for x in "ab")
    bound = F.bit_count(unary(F.col("a")).bitwiseXOR(unary(F.col("b")))) <= most
    near = F.expr("a < b AND ga <> gb") & bound & F.expr(f"bit_count(a ^ b) <= {most}")
    return a.join(b, ["choice", "cell"]).filter(near).select("a", "b")


class Linked:
    """rows: id, h and fp of every row; names: fp and ``first``, the row that stands for its component."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, most: int, size: int):
        self.rows = materialize(fingerprints(docs, id_col, text_col, size), "fingerprints")
        nodes = materialize(self.rows.groupBy("fp").agg(F.min(first_row()).alias("least")), "nodes")
        chained = connected_components(side_by_side(nodes.select("fp", unary(F.col("fp")).alias("emb")), most))
        grouped = nodes.join(chained.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("grp"))
        grouped = materialize(grouped, "grouped")
        found = connected_components(grouped.filter("fp <> grp").selectExpr("fp AS a", "grp AS b").union(links(grouped, most)))
        named = nodes.join(found.withColumnRenamed("node", "fp"), "fp").select("fp", "component", "least")
        names = named.groupBy("component").agg(F.min("least").alias("first"))
        names = named.select("fp", "component").join(names, "component").select("fp", "first")
        self.names = materialize(nodes.join(names, "fp", "left").select("fp", F.coalesce("first", "least").alias("first")), "names")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 4, size: int = 4) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable over links, its own included).

    Fingerprints link at ``most`` or fewer differing bits. Null and empty texts have fingerprint zero and link like any other. Null ids never
    name a component that has another id. Rows that repeat an id are rows of their own. Other columns of docs are not read. An empty table
    gives no rows.
    """
    found = Linked(docs, id_col, text_col, most, size)
    out = found.rows.join(found.names, "fp")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 4, size: int = 4, similarity: float | None = None) -> DataFrame:
    """docs with one row of each component, all columns as they were: the row of the smallest id, of equal ids one by the hash of its text.

    Rows link as in ``near_duplicates``, or, with ``similarity``, at that Jaccard similarity of their sets of ``size``-word shingles. Rows of
    equal (also null) ids and different texts are told apart; rows that repeat an id and text leave one row.
    """
    with scratch_scope(docs.sparkSession):  # only the names of the rows that go outlive it
        found = Linked(docs, id_col, text_col, most, size) if similarity is None else Similar(docs, id_col, text_col, similarity, size)
        return keep_first(docs, found.rows, found.names.select("first"), id_col, text_col)


def drop_alike(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 4, size: int = 4, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """docs with one row of each component, as ``drop_near_duplicates`` keeps it, of links at that Jaccard similarity of sets of ``words``-word shingles.

    Fingerprints (as in ``near_duplicates``) say which rows are held against each other first; an exact check of the sets follows. As few differing bits
    are far stricter than a similarity of 0.8, min-hash bands find the links that are left between the groups so made.
    """
    with scratch_scope(docs.sparkSession):
        prints = Linked(docs, id_col, text_col, most, size)
        linked = prints.rows.join(prints.names, "fp").select("id", "h", F.xxhash64("first").alias("name"))
        found = Similar(docs, id_col, text_col, similarity, words, linked)
        return keep_first(docs, found.rows, found.names.select("first"), id_col, text_col)
