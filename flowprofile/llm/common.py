"""What the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowprofile.functions.storage import materialize, new_path

__all__ = ["WORD", "byte_slices", "materialize", "new_path", "read", "small", "text_or_empty", "text_udf"]

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a task turns into Python strings at once.
SLICE_BYTES = 4 << 20
#: Tables are broadcast up to this many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000


def read(spark: SparkSession, folder: str, table: str, *columns: str) -> DataFrame:
    """The named columns of a whole table."""
    return spark.read.parquet(f"{folder}/{table}.parquet").select(*columns)


def text_or_empty(column: str | Column) -> Column:
    """The text; a null one counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table, marked for broadcast if a count finds it has few rows."""
    return F.broadcast(table) if table.count() <= rows else table


def byte_slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds at most `limit` bytes of the string or binary column, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def text_udf(returns: str, start: Callable[[], Callable[[list], pa.Array]]) -> Callable[..., Column]:
    """Column function over strings or binary values that never holds more than a slice of a batch as Python values.

    `start` runs once per task and gives the function from the values of a slice to their results.
    """

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = start()
        for array in arrays:
            parts = [work(part.column(0).to_pylist()) for part in byte_slices(iter([pa.RecordBatch.from_arrays([array], ["v"])]), 0)]
            yield pa.concat_arrays(parts or [work([])])

    return F.arrow_udf(run, returns)
