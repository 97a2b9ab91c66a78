"""Session helpers: a local session for tests and benches, and tables written to the shared folder."""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_scope: contextvars.ContextVar[str] = contextvars.ContextVar("scope", default="")
_local: list[str] = []
_marked: set[str] = set()


def local_session(cores: int = 8, partitions: int = 8, app: str = "attestra", shared: str | None = None) -> SparkSession:
    """A local session with adaptive execution and UTC time, for tests and benches. Its Python workers find this package, and its shared folder
    is ``shared``, or a new temporary one."""
    root = str(Path(__file__).resolve().parent.parent)
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [root, os.environ.get("PYTHONPATH", "")]))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(CHECKPOINT_KEY, shared or "file://" + tempfile.mkdtemp(prefix="attestra-checkpoint-"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a temporary folder; on a cluster
    that is an error, as no folder of one machine will do."""
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share; intermediate tables are written there")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="attestra-checkpoint-"))
    return _local[0]


def scratch(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    return f"{shared_folder(spark)}/attestra/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession, folder: str = "") -> None:
    """Delete what this application materialized (or a folder of it), once its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch(spark)}/{folder}".rstrip("/"))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """What is materialized within goes when the block ends, but for tables that are written ``outside``."""
    name = f"scope-{uuid.uuid4().hex}"
    token = _scope.set(name)
    try:
        yield
    finally:
        _scope.reset(token)
        clear_scratch(spark, name)


def materialize(df: DataFrame, name: str = "table", outside: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back.

    It cuts the lineage, survives lost executors, and gives later joins a plain scan that adaptive execution can split. ``outside``: not within
    the scope of the block (see ``scratch_scope``), so that the table outlives it.
    """
    spark = df.sparkSession
    scope = "" if outside else _scope.get()
    path = "/".join(filter(None, [scratch(spark), scope, f"{name}-{uuid.uuid4().hex}"]))
    df.write.parquet(path)
    if (root := scratch(spark)) not in _marked:  # goes with the application, whatever clears it before
        _marked.add(root)
        folder = spark._jvm.org.apache.hadoop.fs.Path(root)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)
