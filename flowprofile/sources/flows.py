"""Flow tables in CSV and Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from flowprofile.config import DEFAULT_FEATURES, LABEL_COLUMN
from flowprofile.functions.aggregates import per_feature
from flowprofile.functions.columns import q, require_columns


# How a packed CSV is written: the fourth of nine levels packs nearly as small as the default one in little more than half its time. A packed file is read by one task, so none gets long.
PACKED = {"zlib.compress.level": "FOUR", "maxRecordsPerFile": str(1 << 20)}


def _exists(spark: SparkSession, path: str) -> bool:
    # Through Hadoop's file system API, so that hdfs:// and object-store paths work as local ones do.
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    matches = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop_path)
    return matches is not None and len(matches) > 0


def load_flows(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    required: Sequence[str] = DEFAULT_FEATURES,
    text_columns: Sequence[str] = (LABEL_COLUMN,),
) -> DataFrame:
    """Every column of a CSV (with header) or Parquet table; the required columns must exist.

    A CSV is read as text, and one aggregate over it decides each column's type: BIGINT when every value is an integer that fits, else DOUBLE
    (which knows `inf` and `NaN`) when every value is a number, else the text as it is written. A required column must hold numbers: other
    text in it is an error that names the column. `text_columns` stay text whatever they hold. Blank fields are missing values.
    """
    if not _exists(spark, path):
        raise FileNotFoundError(f"no flow table at {path}")
    fmt = fmt or ("csv" if path.rstrip("/").lower().endswith((".csv", ".csv.gz")) else "parquet")
    if fmt == "parquet":
        df = spark.read.parquet(path)
        validate_schema(df, required)
        return df
    raw = spark.read.option("header", True).csv(path)
    validate_schema(raw, required)
    kinds = _column_kinds(raw, [n for n in raw.columns if n not in text_columns])
    unreadable = [n for n in required if kinds.get(n) == "string"]
    if unreadable:
        raise ValueError(f"text that is not a number in: {unreadable}")
    return raw.selectExpr(*[
        f"try_cast(trim({q(n)}) as {kinds[n]}) as {q(n)}" if kinds.get(n, "string") != "string" else q(n) for n in raw.columns
    ])


def _column_kinds(raw: DataFrame, names: Sequence[str]) -> dict[str, str]:
    """Type of each text column: bigint, double or string; double where there is no value at all."""
    if not names:
        return {}
    counted = per_feature(raw, names, {
        "present": lambda c: f"count_if(length(trim({c})) > 0)",
        "numbers": lambda c: f"count_if(try_cast(trim({c}) as double) is not null)",
        "integers": lambda c: f"count_if(trim({c}) rlike '^[+-]?[0-9]+$' and try_cast(trim({c}) as bigint) is not null)",
        "digits": lambda c: f"count_if(trim({c}) rlike '^[+-]?[0-9]+$')",
    }).collect()

    def kind(r) -> str:
        if r["present"] and r["integers"] == r["present"]:
            return "bigint"
        # Integers that do not fit keep their digits only as text.
        if r["numbers"] < r["present"] or (r["present"] and r["digits"] == r["present"]):
            return "string"
        return "double"

    return {r["feature"]: kind(r) for r in counted}


def validate_schema(df: DataFrame, required: Sequence[str] = DEFAULT_FEATURES) -> DataFrame:
    """The same table, or an error listing every absent required column."""
    require_columns(df, required)
    return df


def separate_labels(df: DataFrame, label: str = LABEL_COLUMN) -> tuple[DataFrame, DataFrame | None]:
    """(table without the label, label column or None). Jobs keep the label in the row instead."""
    if label not in df.columns:
        return df, None
    return df.drop(label), df.select(q(label))


def write_sample(df: DataFrame, path: str, fmt: str = "csv", compression: str | None = None) -> str:
    """Write with header and without index; parent folders are created, an older sample is replaced. `load_flows` reads the files of a CSV packed by `gzip`, too."""
    writer = df.write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression).options(**PACKED)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
    return path
