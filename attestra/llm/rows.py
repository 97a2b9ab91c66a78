"""Which rows of a table stand for their groups, for the operators that keep one row of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from attestra.session import materialize


def inner_names(docs: DataFrame) -> list[str]:
    """Names that no other column has, whatever docs calls its own."""
    return [f"_c{i}" for i in range(len(docs.columns))]


def outer(docs: DataFrame) -> list[Column]:
    """The columns of docs, out of a frame with their inner names."""
    return [F.col(n).alias(c) for n, c in zip(inner_names(docs), docs.columns)]


def text_hash(text: Column) -> Column:
    """With the id, what tells rows apart: rows of equal id and text are interchangeable. Null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def first_row(id_col: str = "id", h: str = "h") -> Column:
    """A row's place in the order in which the smallest stands for its group: null ids last, equal ids by the hash of their text."""
    return F.struct(F.col(id_col).isNull().alias("nil"), F.col(id_col).alias("id"), F.col(h).alias("h"))


def keep_first(docs: DataFrame, rows: DataFrame, names: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with one row of each group, all columns as they were.

    rows: id and h of every row, read at once; names: ``first`` (first_row) of each group, repeats allowed. Rows that repeat an id and text leave one
    row. docs are held against the rows that go, which are few next to those that stay, and are broadcast as long as Spark's bound for that
    allows, so that whole texts stay where they are.
    """
    inner = inner_names(docs)
    stay = names.select(F.col("first.id").alias("_id"), F.col("first.h").alias("_h")).distinct()
    own = rows.select("id", "h").distinct()
    gone = own.join(stay, own["id"].eqNullSafe(stay["_id"]) & (own["h"] == stay["_h"]), "left_anti")
    gone = materialize(gone.select(F.col("id").alias("_gone"), F.col("h").alias("_gone_h")), "gone", outside=True)
    keyed, id_inner, text_inner = docs.toDF(*inner), inner[docs.columns.index(id_col)], inner[docs.columns.index(text_col)]
    kept = keyed.join(gone, F.col(id_inner).eqNullSafe(F.col("_gone")) & (text_hash(F.col(text_inner)) == F.col("_gone_h")), "left_anti")
    if not rows.groupBy("id", "h").count().filter("count > 1").isEmpty():
        kept = kept.withColumn("_h", text_hash(F.col(text_inner))).dropDuplicates([id_inner, "_h"])
    return kept.select(*outer(docs))
