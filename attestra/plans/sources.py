"""Queries that write tables in other formats and read them back, or stream them."""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from attestra.plans.base import query, table
from attestra.session import scratch
from attestra.sources import tables
from attestra.streaming import ingest


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment, CAST(round(c_acctbal, 2) AS DOUBLE) AS c_acctbal FROM customer")
def src_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal"))
    path = f"{scratch(spark)}/csv-{uuid.uuid4().hex}.csv"
    rows.write.csv(path, header=True)
    return tables.read_table(spark, path, schema=rows.schema)


@query("SELECT p_partkey, p_name, p_size FROM part")
def src_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    path = f"{scratch(spark)}/json-{uuid.uuid4().hex}.json"
    rows.write.json(path)
    return tables.read_table(spark, path, schema=rows.schema)


@query("SELECT s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def src_tsv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal"))
    path = f"{scratch(spark)}/tsv-{uuid.uuid4().hex}.tsv"
    rows.write.csv(path, header=True, sep="\t")
    return tables.read_table(spark, path, schema=rows.schema)


def csv_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as Python's csv module writes them, a header first in each part."""
    for k, batch in enumerate(batches):
        out = io.StringIO(newline="")
        writer = csv.writer(out, lineterminator="\n")
        if not k:
            writer.writerow(batch.schema.names)
        cells = [c.to_pylist() for c in batch.columns]
        writer.writerows(zip(*cells))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().removesuffix("\n")])], names=["value"])


@query("""SELECT doc_id, text || chr(10) || 'said "' || lang || '"' AS body, '"' || source || '", ' || lang AS place, n_chars FROM documents""")
def src_csv_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents, with line ends, quotes and separators in them, as another program's CSV."""
    text = F.concat("text", F.lit('\nsaid "'), "lang", F.lit('"'))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("body"), F.concat(F.lit('"'), "source", F.lit('", '), "lang").alias("place"), "n_chars")
    path = f"{scratch(spark)}/quoted-{uuid.uuid4().hex}.csv"
    rows.mapInArrow(csv_rows, "value string").write.text(path)  # a file for each part that Spark reads, however large the table is
    return tables.read_table(spark, path, schema=rows.schema)


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) AS BIGINT) AS row_number FROM events")
def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of stored rows, in the order in which events are stored."""
    return tables.numbered(table(spark, sf_dir, "events")).select("event_id", "row_number")


@query("""
  WITH a AS (SELECT *, event_id % 4 AS part FROM events), s AS (SELECT part, avg(value) AS m, stddev_samp(value) AS s, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM a GROUP BY part)
  SELECT method, severity, count(*) AS n FROM (
    SELECT 'zscore' AS method, CASE WHEN abs((value - m) / s) >= 4 THEN 'high' ELSE 'medium' END AS severity FROM a JOIN s USING (part) WHERE abs((value - m) / s) > 3
    UNION ALL SELECT 'iqr', CASE WHEN abs((value - q3) / (q3 - q1)) >= 4 THEN 'high' WHEN abs((value - q3) / (q3 - q1)) >= 3 THEN 'medium' ELSE 'low' END FROM a JOIN s USING (part)
      WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) GROUP BY ALL""")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream events, a file for each remainder of their ids, into a ledger twice; each file is judged by itself, and the second run adds nothing."""
    base = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select("event_id", "value")
    for k in range(4):
        rows.filter(F.col("event_id") % 4 == k).coalesce(1).write.mode("append").parquet(f"{base}/in")
    for k, files in enumerate((1, 3)):
        ingest.start_ingest(spark, f"{base}/in", rows.schema, f"{base}/ledger", f"{base}/checkpoint-{k}", ["value"], "event_id", files=files).awaitTermination()
    return spark.read.parquet(f"{base}/ledger").groupBy("method", "severity").agg(F.count(F.lit(1)).alias("n"))
