"""CSV records that go over several lines, read in parallel: quoted line ends, doubled quotes and separators in quotes.

A line that begins outside quotes ends inside or outside of them, and so does one that begins inside. A first pass takes both answers of each part of a
file as Spark splits it; composed in the order of the parts they tell where each part begins. So every part is parsed where it is read, and only records that go
over the end of a part meet: their pieces are joined by the place where they begin.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from attestra.session import materialize

QUOTE, MARK = b'"', b"\xef\xbb\xbf"
ROWS = 2000


def open_after(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether a quoted field is still open behind a line that begins inside of one, or at the start of a record."""
    if QUOTE not in line:
        return inside
    at = 0
    while True:
        if not inside:
            if line[at : at + 1] != QUOTE:
                at = line.find(sep, at) + 1
                if not at:
                    return False
                continue
            at, inside = at + 1, True
        end = line.find(QUOTE, at)
        if end < 0:
            return True
        if line[end + 1 : end + 2] == QUOTE:
            at = end + 2
            continue
        at, inside = line.find(sep, end + 1) + 1, False
        if not at:
            return False


def fields_of(record: bytes, sep: bytes) -> list[bytes | None]:
    """The fields of a record; what is empty and not quoted is null. A quote inside an unquoted field is a character like others."""
    out: list[bytes | None] = []
    at = 0
    while True:
        if record[at : at + 1] == QUOTE:
            parts, at = [], at + 1
            while True:
                end = record.find(QUOTE, at)
                if end < 0:
                    parts.append(record[at:])
                    at = len(record)
                    break
                parts.append(record[at:end])
                at = end + 1
                if record[at : at + 1] != QUOTE:
                    break
                parts.append(QUOTE)
                at += 1
            cut = record.find(sep, at)
            out.append(b"".join([*parts, record[at : cut if cut >= 0 else len(record)]]))
        else:
            cut = record.find(sep, at)
            out.append(record[at : cut if cut >= 0 else len(record)] or None)
        if cut < 0:
            return out
        at = cut + 1


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where its part of the file begins), at (the order of the lines in it) and line (bytes without the line feed)."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("line"))


def utf8(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def parts_of(lines: DataFrame, sep: bytes) -> DataFrame:
    """A row for each part of each file: whether it ends inside quotes if it begins outside or inside, whether one record goes through it from inside to
    its end, whether a record goes over a line end if it begins outside, and whether its bytes are UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], list[bool]] = {}
        for batch in batches:
            for file, block, line in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3))):
                state = seen.setdefault((file, block), [False, True, True, False, True])
                if QUOTE in line:
                    state[0], state[1] = (open_after(line, state[k], sep) for k in (0, 1))
                state[2] &= state[1]
                state[3] |= state[0]
                if state[4] and not line.isascii():
                    state[4] = utf8(line)
        keys = list(seen)
        cells = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), *(pa.array([seen[k][i] for k in keys], pa.bool_()) for i in range(5))]
        yield pa.RecordBatch.from_arrays(cells, names=["file", "block", "outside", "inside", "through", "over", "utf8"])

    return lines.mapInArrow(run, "file string, block long, outside boolean, inside boolean, through boolean, over boolean, utf8 boolean")


def begun(parts: DataFrame) -> DataFrame:
    """parts with ``open``: the block in which the record began that is open where the part begins (null if none is), and whether the whole file is UTF-8."""
    steps = F.array_sort(F.collect_list(F.struct("block", "outside", "inside", "through")))
    files = parts.groupBy("file").agg(steps.alias("steps"), F.min("utf8").alias("utf8"))
    walk = """aggregate(steps, struct(CAST(NULL AS bigint) AS open, CAST(array() AS array<struct<block:bigint, open:bigint>>) AS done),
      (s, x) -> struct(CASE WHEN NOT IF(s.open IS NULL, x.outside, x.inside) THEN NULL WHEN s.open IS NOT NULL AND x.through THEN s.open ELSE x.block END AS open, concat(s.done, array(struct(x.block AS block, s.open AS open))) AS done),
      s -> s.done)"""
    return files.select("file", "utf8", F.inline(F.expr(walk)))


RECORD = "file string, utf8 boolean, key long, block long, first boolean, piece binary, cells array<binary>"


def parsed(lines: DataFrame, sep: bytes) -> DataFrame:
    """RECORD rows of lines (in their order, with ``open`` and ``utf8``): whole records as cells, pieces of others with the block where they begin as key.

    An open record closes at its first closing quote, so where a part begins inside quotes that do not close, all of it is one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: tuple[str, int] | None = None
        held: list[bytes] = []
        inside, open_in, first, rows = False, None, False, []

        def end(whole: bool) -> None:
            """The record that is held is complete, or goes on in the next part."""
            nonlocal held, open_in, first
            if held:
                text = b"\n".join(held)
                if open_in is None and whole:
                    text = text.removesuffix(b"\r")
                    if text:
                        rows.append((*own[:1], flag, None, own[1], first, None, fields_of(text, sep)))
                        first = False
                else:
                    key = own[1] if open_in is None else open_in
                    rows.append((*own[:1], flag, key, own[1], first, text + (b"" if whole else b"\n"), None))
                    first = False
            held, open_in = [], None

        def out() -> pa.RecordBatch:
            kinds = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.binary())]
            names = ["file", "utf8", "key", "block", "first", "piece", "cells"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        flag = True
        for batch in batches:
            for file, block, line, began, is_utf8 in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "line", "open", "utf8"))):
                if (file, block) != own:
                    end(False)
                    own, flag, open_in, inside, first = (file, block), is_utf8, began, began is not None, block == 0
                    if block == 0:
                        line = line.removeprefix(MARK)
                held.append(line)
                inside = open_after(line, inside, sep)
                if not inside:
                    end(True)
                if len(rows) >= ROWS:
                    yield out()
                    rows = []
        end(False)
        yield out()

    return lines.mapInArrow(run, RECORD)


def joined_pieces(pieces: DataFrame, sep: bytes) -> DataFrame:
    """Records of pieces: those of one key in the order of their blocks."""
    text = F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda p: p["piece"])
    records = pieces.groupBy("file", "key").agg(F.first("utf8").alias("utf8"), F.max("first").alias("first"), text.alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [fields_of(b"".join(p).removesuffix(b"\n").removesuffix(b"\r"), sep) for p in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("utf8"), batch.column("first"), pa.array(cells, pa.list_(pa.binary()))], names=["utf8", "first", "cells"])

    return records.mapInArrow(run, "utf8 boolean, first boolean, cells array<binary>")


def inferred(records: DataFrame, names: list[str]) -> list[T.DataType]:
    """The type of each column: whole numbers, numbers, truth values, times, else text; one pass over all columns."""
    text = lambda i: F.get("cells", F.lit(i))
    kinds = {
        T.IntegerType(): lambda x: x.rlike(r"^[+-]?\d+$") & x.try_cast("int").isNotNull(),
        T.LongType(): lambda x: x.rlike(r"^[+-]?\d+$") & x.try_cast("bigint").isNotNull(),
        T.DoubleType(): lambda x: x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^(NaN|[+-]?Inf)$") & x.try_cast("double").isNotNull(),
        T.BooleanType(): lambda x: F.lower(x).isin("true", "false"),
        T.TimestampType(): lambda x: x.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d") & x.try_cast("timestamp").isNotNull(),
    }
    fits = [F.coalesce(F.min(test(text(i))), F.lit(False)).alias(f"f{i}_{k}") for i in range(len(names)) for k, test in enumerate(kinds.values())]
    row = records.agg(*fits).first()
    return [next((kind for k, kind in enumerate(kinds) if row[f"f{i}_{k}"]), T.StringType()) for i in range(len(names))]


def read_records(lines: DataFrame, parts: DataFrame, sep: str, schema=None) -> DataFrame:
    """A table of all files, whose first records are their common header. Missing fields are null, further ones are left out; what does not fit
    its type in ``schema`` is null. A file whose bytes are no UTF-8 is read as Latin-1, a mark of UTF-8 at its start is skipped."""
    comma = sep.encode()
    known = begun(parts).select(F.col("file").alias("_file"), F.col("block").alias("_block"), "open", "utf8")
    ordered = lines.join(known, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")), "left").repartition("file", "block").sortWithinPartitions("file", "block", "at")
    same = F.coalesce("utf8", F.raise_error(F.lit("files were split otherwise than before")).cast("boolean")).alias("utf8")
    rows = materialize(parsed(ordered.select("file", "block", "line", "open", same), comma), "records")
    records = rows.filter("key IS NULL").select("utf8", "first", "cells").unionByName(joined_pieces(rows.filter("key IS NOT NULL"), comma))
    text = F.transform("cells", lambda c: F.when(F.col("utf8"), F.decode(c, "UTF-8")).otherwise(F.decode(c, "ISO-8859-1")))
    records = records.select("first", text.alias("cells"))
    heads = records.filter("first").select("cells").distinct().limit(2).collect()
    if len(heads) != 1:
        raise ValueError("files without a header, or with different ones" if heads else "no header")
    header, body = heads[0]["cells"], records.filter("NOT first")
    names = [h or f"_c{i}" for i, h in enumerate(header)]
    if schema is None:
        fields = [T.StructField(n, k) for n, k in zip(names, inferred(body, names))]
    else:
        fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    cell = lambda i: F.get("cells", F.lit(i))
    value: list[Column] = [cell(i).try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)]
    return body.select(*value)

