"""Written tables in the cluster's shared folder.

Steps that are read many times (clean rows, scaled rows) are written once as Parquet: a lost executor
then costs one re-read of its splits, never a re-run of the shuffles before.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Folder named by `spark.checkpoint.dir`, or else one below the session's warehouse, which on a cluster must not be a folder of one machine."""
    folder = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if folder:
        return folder.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith(("/", "file:")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_KEY} to a folder that all executors reach; the warehouse is {warehouse}")
    return f"{warehouse}/_flowprofile"


#: Tables named since the innermost `scratch` began.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/flowprofile-{uuid.uuid4().hex}/{name}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove at the end whatever is written within; for steps whose result is collected or written elsewhere by then."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            remove(spark, path)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write the table to the shared folder and return a fresh scan of it."""
    return materialize_at(df, new_path(df.sparkSession, name))


def materialize_at(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Write the table to the path, with the given options of the Parquet writer, and return a fresh scan of it."""
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table, and its folder if `new_path` made it for that table alone."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(where, True)
    parent = where.getParent()
    if parent.getName().startswith("flowprofile-") and store.exists(parent) and not store.listStatus(parent):
        store.delete(parent, False)
