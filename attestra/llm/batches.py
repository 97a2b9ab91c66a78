"""Record batches of bounded size, so that a task's Python side holds few texts at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes of a batch. A single row may be larger than the bytes; then it travels alone.
ROWS, BYTES = 1024, 4 << 20
BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """df; from now on its session hands Python batches of at most BYTES, unless the session itself sets a bound."""
    if df.sparkSession.conf.get(BYTES_KEY, None) in (None, str(2**31 - 1)):
        df.sparkSession.conf.set(BYTES_KEY, str(BYTES))
    return df


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def free_name(wanted: str, columns: list[str]) -> str:
    """``wanted``, or with as many underscores before it as it takes to be none of the columns (Spark's names have no case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
