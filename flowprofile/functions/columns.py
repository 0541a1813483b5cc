"""SQL text and column helpers.

Wide expressions (hundreds of terms) are built as SQL text and parsed once by Spark;
building them call by call through Py4J costs more than running them on small tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def short_methods(spark: SparkSession) -> None:
    """Have Spark split a generated method that the JVM would leave uncompiled (over 8,000 bytes); a limit set by the user stays.

    A projection of 24 features outgrows that limit, and each row is then interpreted (measured: ten times slower).
    """
    if spark.conf.get(_METHOD_LIMIT, None) is None:
        spark.conf.set(_METHOD_LIMIT, "8000")


def q(name: str) -> str:
    """Back-ticked column name, safe for spaces, slashes and back-ticks."""
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number(value: float) -> str:
    """SQL DOUBLE literal that round-trips exactly."""
    value = float(value)
    if math.isfinite(value):
        return f"{value!r}D" if value >= 0 else f"({value!r}D)"
    return f"double('{'NaN' if math.isnan(value) else 'Infinity' if value > 0 else '-Infinity'}')"


def col(name: str) -> Column:
    return F.col(q(name))


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of all numeric columns, in table order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    """Raise, before any job runs, naming every absent column."""
    present = set(df.columns)
    absent = [n for n in names if n not in present]
    if absent:
        raise ValueError(f"missing required columns: {absent}")


def as_doubles(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns as DOUBLE with NaN turned into null (one notion of "missing")."""
    return df.selectExpr(*[f"nullif(cast({q(n)} as double), double('NaN')) as {q(n)}" for n in names])


def nan_to_null(df: DataFrame) -> DataFrame:
    """Whole table with NaN turned into null in every floating-point column."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.selectExpr(*[
        f"nullif({q(n)}, cast('NaN' as {df.schema[n].dataType.simpleString()})) as {q(n)}" if n in floats else q(n)
        for n in df.columns
    ])


def is_infinite(sql: str) -> str:
    """True for ±inf; written as equality because NaN compares greater than everything."""
    return f"({sql} = double('Infinity') or {sql} = double('-Infinity'))"


def finite_or_null(sql: str) -> str:
    return f"case when abs({sql}) < double('Infinity') then {sql} end"


def skewness_sql(sql: str) -> str:
    """Bias-corrected sample skewness: null below three values, 0 for a constant column."""
    n = f"cast(count({sql}) as double)"
    return (
        f"case when count({sql}) < 3 then null "
        f"when max({sql}) = min({sql}) and abs(max({sql})) < double('Infinity') then 0D "
        f"else nullif(skewness({sql}) * sqrt({n} * ({n} - 1)) / ({n} - 2), double('NaN')) end"
    )


def verdict_sql(sql: str) -> str:
    """Reading of an absolute skewness; an unknown skewness falls through to the last class."""
    return (
        f"case when {sql} < 0.5D then 'Approx. Symmetric' when {sql} < 1D then 'Moderate Skew' "
        f"when {sql} < 2D then 'High Skew' else 'Very High Skew' end"
    )


def percent_sql(part: str, whole: str) -> str:
    """Percentage to two decimals, half-even; 0 for an empty table."""
    return f"coalesce(bround(try_divide(cast({part} as double), cast({whole} as double)) * 100D, 2), 0D)"

