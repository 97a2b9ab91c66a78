"""Exact dedup by a tree-merge of sorted digest runs, in DataFrame operations only.

Rows belong to runs by a hash of their identifier. In each run they are sorted by digest, part by part where they are read, and neighbours of one
digest collapse into one entry: best identifier, number of rows. Then runs meet in binomial rounds: a run's number has log2(runs) bits, and
in a round the runs whose numbers differ in the round's bits alone exchange what they hold, so that these bits of an entry's new run are those of
its digest. Each run merges the sorted parts that it gets, multiway (``fanin`` runs a round, so log2(fanin) bits), and collapses
equal digests again. After the last round an entry's run is its digest's own, so all entries of a digest have met, while no run was ever
larger than its share of the digests. A digest, however common, is one entry of a run from the first round on.

The answer walks back down the same rounds, so the join with the rows is as even as the way up. Where a digest has several rows, their texts
walk up the same tree, and every level compares the texts that it merges: one digest of two texts is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from attestra.llm.rows import first_row, keep_first
from attestra.session import materialize, scratch_scope

RUNS, FANIN = 64, 4
#: SHA-256, an independent hash (the same as rows.text_hash) and the length stand for a text.
KEY = ["digest", "h", "size"]


def digest_columns(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [F.unhex(F.sha2(text, 256)).alias("digest"), F.xxhash64(text).alias("h"), F.length(text).alias("size")]


def exchanged(entries: DataFrame, bits: range) -> DataFrame:
    """entries with the run that they go to in the round of these bits."""
    mask = sum(1 << b for b in bits)
    return entries.withColumn("run", F.col("run").bitwiseAND(F.lit(~mask)).bitwiseOR(F.col("h").bitwiseAND(F.lit(mask)).cast("int")))


def rounds(runs: int, fanin: int) -> list[range]:
    """The bits of a run's number that each round settles."""
    bits, step = runs.bit_length() - 1, max(1, fanin.bit_length() - 1)
    if runs != 1 << bits:
        raise ValueError("the number of runs is a power of two")
    return [range(b, min(bits, b + step)) for b in range(0, bits, step)]


class Tree:
    """rows: id, run and KEY of every row; levels: the entries after each round, leaves first (run, KEY, best, rows)."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, keep: str, runs: int, fanin: int):
        self.docs, self.id_col, self.text_col, self.keep, self.steps = docs, id_col, text_col, keep, rounds(runs, fanin)
        self.own_run = F.pmod(F.xxhash64(F.col(id_col)), F.lit(runs)).cast("int").alias("run")
        self.rows = materialize(docs.select(F.col(id_col).alias("id"), self.own_run, *digest_columns(F.col(text_col))), "digests")
        leaf = self.merged(self.rows.withColumn("row", first_row()).withColumn("rows", F.lit(1).cast("long")))
        self.levels = [materialize(leaf, "run")]
        for bits in self.steps:
            self.levels.append(materialize(self.merged(exchanged(self.levels[-1].withColumnRenamed("best", "row"), bits)), "run"))
        self.known = materialize(self.answers(), "answers")
        self.verify()

    def merged(self, entries: DataFrame) -> DataFrame:
        """Sorted neighbours of one run and digest as one entry. As the best row is a struct, Spark sorts each part by run and digest, collapses it,
        exchanges it, and merges what arrives by the same order."""
        best = F.min("row") if self.keep == "smallest" else F.max(F.struct((~F.col("row.nil")).alias("has"), "row"))["row"]
        return entries.groupBy("run", *KEY).agg(best.alias("best"), F.sum("rows").alias("rows"))

    def verify(self) -> None:
        """Texts of the digests that have several rows, walked up the same rounds; each level fails where one digest has two texts."""
        several = self.known.filter("rows > 1").select("run", *KEY)
        texts = self.docs.select(self.own_run, F.coalesce(F.col(self.text_col), F.lit("")).alias("text"), *digest_columns(F.col(self.text_col)))
        texts = texts.join(several, ["run", *KEY], "left_semi")
        same = F.when(F.min("text") == F.max("text"), F.min("text")).otherwise(F.raise_error(F.lit("two texts have one digest")).cast("string"))
        for bits in [range(0), *self.steps]:
            texts = materialize(exchanged(texts, bits).groupBy("run", *KEY).agg(same.alias("text")), "texts")

    def answers(self) -> DataFrame:
        """run, KEY, best and rows of the whole table for each leaf entry."""
        known = self.levels[-1]
        for bits, level in zip(reversed(self.steps), reversed(self.levels[:-1])):
            below = exchanged(level.select("run", *KEY, F.col("run").alias("own")), bits)
            known = below.join(known, ["run", *KEY]).select(F.col("own").alias("run"), *KEY, "best", "rows")
        return known


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", runs: int = RUNS, fanin: int = FANIN) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    keep: "smallest" or "largest" identifier of equal texts. Null texts count as empty. Null identifiers are never preferred to others;
    a group of null identifiers has a null keep_id and all of it is kept. Rows that repeat an identifier and its text count in group_size
    and share the answer (``drop_exact_duplicates`` leaves one of them). Other columns of docs are not read. An empty table gives no rows.
    """
    tree = Tree(docs, id_col, text_col, keep, runs, fanin)
    found = tree.rows.join(tree.known, ["run", *KEY])
    return found.select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("rows").alias("group_size"),
        F.col("id").eqNullSafe(F.col("best.id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", runs: int = RUNS, fanin: int = FANIN) -> DataFrame:
    """docs with one row of each text, all its columns as they were. Rows that repeat identifier and text leave one row."""
    with scratch_scope(docs.sparkSession):  # only the names of the rows that go outlive it
        tree = Tree(docs, id_col, text_col, keep, runs, fanin)
        return keep_first(docs, tree.rows, tree.levels[-1].select(F.col("best").alias("first")), id_col, text_col)
