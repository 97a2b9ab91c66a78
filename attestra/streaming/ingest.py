"""Continuous ingest: new files of a folder are checked batch by batch, and findings go to a ledger that takes each id once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from attestra.operators import anomaly, ledger, profile

FILE = "_artifact_file"


def findings_of(batch: DataFrame, metrics: list[str], key: str) -> DataFrame:
    """Findings of rows with an ``artifact``, judged within their artifact, with ids that depend on artifact, row, method and metric alone."""
    rows = anomaly.long_frame(batch, metrics, F.col(key).cast("string"), artifact=F.col("artifact"))
    found = anomaly.detect_zscore(rows).unionByName(anomaly.detect_iqr(rows))
    identity = F.sha2(F.concat_ws("|", "artifact", "method", "metric", "row_id"), 256)
    return found.select(F.substring(identity, 1, 12).alias("finding_id"), "artifact", "method", "metric", "row_id", "observed", "severity")


def below(spark: SparkSession, folder: str, path: Column) -> Column:
    """A file's path below a folder; files elsewhere keep their whole path."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/") + "/"
    plain = F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/")
    return F.when(F.startswith(plain, F.lit(root)), F.substr(plain, F.lit(len(root) + 1))).otherwise(plain)


def start_ingest(spark: SparkSession, folder: str, schema: StructType, ledger_path: str, checkpoint: str, metrics: list[str], key: str, format: str = "parquet", profiles: str | None = None, files: int = 16) -> StreamingQuery:
    """Take what is in the folder and not yet taken, ``files`` new files a batch, then stop. Each file is an artifact of its own, named by its path below
    the folder: its values are judged against its own statistics, whatever batch it comes in, and with ``profiles`` its column statistics,
    observations and fitness are written there, those of all files of a batch in the same jobs.

    A batch that is run again adds nothing: the ledger is held against its ids, and a file's profile replaces itself. One writer at a time is
    assumed for a ledger.
    """

    def take(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        named = batch.withColumnRenamed(FILE, "artifact")
        found = findings_of(named, metrics, key)
        session.createDataFrame([], found.schema).write.mode("append").parquet(ledger_path)
        old = session.read.schema(found.schema).parquet(ledger_path)
        ledger.new_findings(old, found).write.mode("append").parquet(ledger_path)
        if profiles:
            known = profile.Profile(named, by=("artifact",))
            for table, rows in (("columns", known.columns), ("observations", known.observations), ("fitness", profile.fitness_of(known))):
                rows.write.partitionBy("artifact").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{profiles.rstrip('/')}/{table}")

    stream = spark.readStream.schema(schema).format(format).option("maxFilesPerTrigger", files).load(folder)
    stream = stream.select("*", below(spark, folder, F.col("_metadata.file_path")).alias(FILE))
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """A stream's rows and value totals by type and window of event time; rows later than ``late`` are left out once their window closed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
