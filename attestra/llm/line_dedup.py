"""Line dedup by site-relative frequency: a line that stands on too large a share of a host's pages is boilerplate and is dropped.

Lines travel as two 64-bit hashes, never as text; a page counts once for each of its lines. Counting pre-aggregates before its shuffle, so
a line on a third of all pages costs one row a task. Only hashes of lines that were found to be boilerplate go back to their pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from attestra.llm.batches import free_name
from attestra.llm.rows import inner_names
from attestra.session import materialize

RATIO, PAGES = 0.05, 3


def host_of(url: Column) -> Column:
    """The lower-case host of a url, for tables that have urls."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def hashed(line: Column) -> Column:
    """What stands for a line: two hashes of its text without spaces around it; null for blank lines."""
    line = F.trim(line)
    return F.when(line != "", F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b")))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def boilerplate(pages: DataFrame, ratio: float, least: int) -> DataFrame:
    """pages: host, lines (distinct hashes). (host, line) of lines on more than ``ratio`` of the host's pages, and on ``least`` pages at least."""
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    counts = pages.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return counts.join(totals, "host").filter(F.col("n") > F.col("total") * ratio).select("host", "line")


def drop_boilerplate(docs: DataFrame, host: Column, id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO, least: int = PAGES) -> DataFrame:
    """docs with boilerplate lines dropped from the texts, and a column ``_lines``: struct of n_lines and n_dropped (with more underscores where docs
    has that name).

    Null hosts are one host. Null texts stay null. Blank lines are never dropped. Lines are compared without the spaces around them; a line
    repeated in one page counts once, and all its repeats go with it. Rows that repeat an id and text get the same answer.
    """
    inner = inner_names(docs)
    text, own_id = F.col(inner[docs.columns.index(text_col)]), F.col(inner[docs.columns.index(id_col)])
    rows = docs.select("*", F.coalesce(host.cast("string"), F.lit("")).alias(free_name("_host", docs.columns))).toDF(*inner, "_host")
    hashes = F.filter(F.array_distinct(F.transform(lines_of(text), hashed)), lambda x: x.isNotNull())
    pages = materialize(rows.select(F.col("_host").alias("host"), own_id.alias("id"), F.xxhash64(text).alias("h"), hashes.alias("lines")), "lines")
    bad = materialize(boilerplate(pages, ratio, least), "boilerplate")
    hits = pages.select("host", "id", "h", F.explode("lines").alias("line")).join(bad, ["host", "line"])
    hits = hits.groupBy("host", "id", "h").agg(F.collect_set("line").alias("bad"))
    found = rows.join(hits, (F.col("_host") == F.col("host")) & own_id.eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("h")), "left")
    lines = lines_of(text)
    kept = F.when(F.col("bad").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("bad"), hashed(x)), F.lit(False))))
    found = found.select(*inner, F.size(lines).cast("long").alias("n_lines"), kept.alias("kept"))
    cut = F.when(text.isNotNull(), F.array_join("kept", "\n")).alias(text_col)
    counts = F.struct("n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped")).alias(free_name("_lines", docs.columns))
    return found.select(*[cut if c == text_col else F.col(n).alias(c) for n, c in zip(inner, docs.columns)], counts)


def line_report(docs: DataFrame, host: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of docs: id, n_lines, n_dropped, kept_chars and kept_sha256 (of the text that is left; null counts as empty)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), host.cast("string").alias("host"))
    out = drop_boilerplate(rows, F.col("host"), "id", "text", **options)
    text = F.coalesce("text", F.lit(""))
    return out.select(F.col("id").alias(id_col), "_lines.n_lines", "_lines.n_dropped", F.length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))
