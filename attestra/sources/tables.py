"""Reading tables by their format, snapshots with content hashes, and row digests."""

from __future__ import annotations

import hashlib
import json
import posixpath

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from attestra.functions.exprs import named
from attestra.session import materialize
from attestra.sources import quoted

# Formats by suffix with their media types.
FORMATS = {".csv": "text/csv", ".tsv": "text/tab-separated-values", ".json": "application/json", ".jsonl": "application/x-ndjson", ".ndjson": "application/x-ndjson", ".parquet": "application/vnd.apache.parquet"}

# What a register of sources has to say of each, and what marks a source that nobody has checked.
REGISTER_FIELDS = ("source_id", "source_url", "retrieved_at", "sha256", "access_status")
UNCHECKED = "unverified_candidate"


def suffix_of(path: str) -> str:
    suffix = posixpath.splitext(path.rstrip("/"))[1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"unsupported format: {suffix or path}")
    return suffix


def config_hash(parser: str, config: dict) -> str:
    """A hash of a parser's name and its fixed options."""
    return hashlib.sha256(json.dumps({"parser": parser, **config}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def capture(rows: DataFrame, name: Column, content: Column, parser: str = "spark", config: dict | None = None) -> DataFrame:
    """rows as captures: name, byte_size, sha256 and media_type (by the name's suffix; null for others) of their content, and which parser with
    which options reads it."""
    types = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    suffix = F.concat(F.lit("."), F.lower(F.element_at(F.split(name, "\\."), -1)))
    return rows.select(
        name.alias("name"), F.octet_length(content).cast("long").alias("byte_size"), F.sha2(content, 256).alias("sha256"), F.element_at(types, suffix).alias("media_type"),
        F.lit(parser).alias("parser"), F.lit(rows.sparkSession.version).alias("parser_version"), F.lit(config_hash(parser, config or {})).alias("config_hash"))


def manifest(spark: SparkSession, path: str, config: dict | None = None) -> DataFrame:
    """One row a file, as in ``capture``. A file's bytes meet in one task (2 GB at most); ``content_digest`` covers tables of any size."""
    files = spark.read.format("binaryFile").load(path)
    return capture(files, F.col("path"), F.col("content"), config=config)


def read_csv(spark: SparkSession, path: str, sep: str, schema=None) -> DataFrame:
    """CSV with a header: fields may be quoted, a quote in a quoted field is doubled, and separators and line ends may stand in quotes. Files are read as
    UTF-8, with or without a mark of it, or as Latin-1 if their bytes are none.

    Where no line has a quote and all are UTF-8, which Spark's own functions tell in a pass, or every record is a line, which takes a look at the quotes,
    Spark's reader is taken; else ``quoted.read_records``, which splits files as well.
    """
    odd = F.coalesce(F.max(F.contains("value", F.lit('"')) | ~F.is_valid_utf8("value")), F.lit(False))
    plain, lines, parts = not spark.read.text(path).agg(odd.alias("odd")).first()["odd"], None, None
    if not plain:
        lines = quoted.lines_of(spark, path)
        parts = materialize(quoted.parts_of(lines, sep.encode()), "parts")
        plain = not parts.agg(F.coalesce(F.max(F.col("over") | ~F.col("utf8")), F.lit(False)).alias("odd")).first()["odd"]
    if plain:
        reader = spark.read.schema(schema) if schema is not None else spark.read
        out = reader.csv(path, header=True, sep=sep, quote='"', escape='"', inferSchema=schema is None)
    else:
        out = quoted.read_records(lines, parts, sep, schema)
    dates = [f.name for f in out.schema if f.dataType.typeName() == "date"] if schema is None else []
    return out.withColumns({c: named(c).cast("string") for c in dates}) if dates else out


def read_json(spark: SparkSession, path: str, schema=None, corrupt: str | None = None) -> DataFrame:
    """JSON by line, or as one array or object that goes over several lines.

    What the file is, its first line that isn't blank tells, before any schema is applied: an opening bracket is an array; else it is read by
    line if any line is an object of its own. Lines that can't be read stay, as the column ``_corrupt_record`` (or ``corrupt``); with a
    schema and no ``corrupt`` they are an error.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    first = lines.first()
    array = first is not None and first["value"].lstrip().startswith("[")
    whole = array or lines.filter(F.from_json("value", "map<string,string>").isNotNull()).isEmpty()
    reader = spark.read.option("multiLine", whole)
    if corrupt:
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    if schema is None:
        return reader.json(path)
    if not corrupt:
        return reader.schema(schema).option("mode", "FAILFAST").json(path)
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return reader.schema(T.StructType([*fields, T.StructField(corrupt, T.StringType())])).json(path)


def read_table(spark: SparkSession, path: str, format: str | None = None, schema=None) -> DataFrame:
    """A table by its suffix (or ``format``, such a suffix): CSV and TSV with header, JSON by line or as one array, Parquet.

    Without a schema, CSV types are inferred, except that dates stay strings; another suffix is an error.
    """
    suffix = format or suffix_of(path)
    if suffix not in FORMATS:
        raise ValueError(f"unsupported format: {suffix}")
    if suffix in (".csv", ".tsv"):
        return read_csv(spark, path, "\t" if suffix == ".tsv" else ",", schema)
    if suffix == ".parquet":
        return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    return read_json(spark, path, schema)


def numbered(df: DataFrame) -> DataFrame:
    """A stored Parquet table (as read, with nothing done to it) with ``row_number``, from 1 in the order of its files and of the rows in them.

    Numbers are offsets of files plus places in them, so rows are neither sorted nor shuffled; only counts by file meet.
    """
    at = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    files = at.groupBy("_file").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return at.join(files.select("_file", before.alias("_before")), "_file").withColumn("row_number", F.col("_before") + F.col("_at") + 1).drop("_file", "_at", "_before")


def cells(df: DataFrame, row_number: str = "row_number") -> DataFrame:
    """(row_number, column, value as text): one row for each stored value that isn't null."""
    pairs = [F.struct(F.lit(c).alias("column"), named(c).cast("string").alias("value")) for c in df.columns if c != row_number]
    return df.select(named(row_number).alias("row_number"), F.inline(F.array(*pairs))).filter("value IS NOT NULL")


def register_problems(register: DataFrame) -> DataFrame:
    """(source_id, field, problem): fields of a register of sources that it doesn't have at all (once, without a source), that are blank or still to be
    done, and sources that are not checked."""
    none = F.lit(None).cast("string")
    value = lambda c: F.trim(F.col(c).cast("string")) if c in register.columns else none
    told = lambda field, problem: F.struct(F.lit(field).alias("field"), F.lit(problem).alias("problem"))
    rules = [F.when(F.coalesce(value(c), F.lit("")).isin("", "TBD"), told(c, "missing")) for c in REGISTER_FIELDS]
    rules.append(F.when(value("access_status") == UNCHECKED, told("access_status", UNCHECKED)))
    out = register.select(value("source_id").alias("source_id"), F.inline(F.filter(F.array(*rules), lambda r: r.isNotNull())))
    lost = [(None, c, "missing_column") for c in REGISTER_FIELDS if c not in register.columns]
    return out.unionByName(register.sparkSession.createDataFrame(lost, out.schema)) if lost else out


def freeze(df: DataFrame, store: str, name: str) -> str:
    """Write a snapshot under its content's digest and return the path; equal content is written once, nothing is overwritten."""
    digest = content_digest(df)
    path = f"{store.rstrip('/')}/{name}/sha256={digest}"
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        df.write.mode("errorifexists").parquet(path)
    return path


def content_digest(df: DataFrame) -> str:
    """A digest of a table's rows that does not depend on their order: counts and sums of row hashes, in all and in 4096 buckets."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    rows = df.select(row.alias("h")).withColumn("b", F.substring("h", 1, 3))
    part = lambda k: F.sum(F.conv(F.substring("h", k, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    sums = rows.groupBy("b").agg(F.count(F.lit(1)).cast("string").alias("n"), part(4).alias("x"), part(19).alias("y"), part(34).alias("z"))
    return sums.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "b", "n", "x", "y", "z"))), "|"), 256).alias("d")).first()["d"]
