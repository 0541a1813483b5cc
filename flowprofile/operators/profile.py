"""Profiling: what a table looks like before anything is done to it.

Measures that share a pass over the data are computed together; every result is a small long table.
NaN and null are one "missing"; infinite values are counted apart and otherwise take part as values, so that a
mean, deviation, skewness or correlation they make undefined is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowprofile.functions.aggregates import per_feature, union_all
from flowprofile.functions.columns import (
    as_doubles, finite_or_null, is_infinite, nan_to_null, number, numeric_columns, percent_sql, q, skewness_sql, text, verdict_sql,
)
from flowprofile.functions.quantiles import quantile_table
from flowprofile.operators.distinct import distinct_counts
from flowprofile.operators.gram import pair_sums

HISTOGRAM_BINS = 50
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def _fractional(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}


def _defined(sql: str) -> str:
    return f"nullif({sql}, double('NaN'))"


def _features(df: DataFrame, features: Sequence[str] | None) -> list[str]:
    return list(features) if features else numeric_columns(df)


def dataset_overview(df: DataFrame) -> DataFrame:
    """n_rows, n_columns, n_numeric, n_missing_or_inf in one row."""
    report = missing_report(df)
    return report.agg(
        F.max("n_rows").alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.lit(len(numeric_columns(df))).cast("bigint").alias("n_numeric"),
        F.sum("total_issues").alias("n_missing_or_inf"),
    ) if df.columns else df.sparkSession.createDataFrame([(0, 0, 0, 0)], "n_rows bigint, n_columns bigint, n_numeric bigint, n_missing_or_inf bigint")


def missing_report(df: DataFrame) -> DataFrame:
    """Every column: missing_count, missing_pct, inf_count, total_issues (and n_rows), worst first."""
    fractional = _fractional(df)
    clean = nan_to_null(df)
    # The measures differ by type, so the two kinds of column are counted in their own passes.
    parts = []
    floats = [c for c in df.columns if c in fractional]
    others = [c for c in df.columns if c not in fractional]
    if floats:
        parts.append(per_feature(clean, floats, {
            "n_rows": lambda c: "count(*)",
            "missing_count": lambda c: f"count_if({c} is null)",
            "inf_count": lambda c: f"count_if({is_infinite(c)})",
        }))
    if others:
        parts.append(per_feature(clean, others, {
            "n_rows": lambda c: "count(*)",
            "missing_count": lambda c: f"count_if({c} is null)",
            "inf_count": lambda c: "0L",
        }))
    return union_all(parts).selectExpr(
        "feature", "missing_count", f"{percent_sql('missing_count', 'n_rows')} as missing_pct", "inf_count",
        "missing_count + inf_count as total_issues", "n_rows",
    ).orderBy(F.desc("total_issues"), "feature")


def missing_info(df: DataFrame) -> DataFrame:
    """Only the columns with missing or infinite values: missing_count, missing_pct, inf_count."""
    return missing_report(df).where("total_issues > 0").select("feature", "missing_count", "missing_pct", "inf_count").orderBy(
        F.desc("missing_count"), "feature")


MOMENTS = {
    "count": lambda c: f"count({c})",
    "mean": lambda c: _defined(f"avg({c})"),
    "std": lambda c: _defined(f"stddev_samp({c})"),
    "min": lambda c: f"min({c})",
    "max": lambda c: f"max({c})",
}


def describe(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std (sample), min, exact quartiles, max per numeric column."""
    names = _features(df, features)
    moments = per_feature(as_doubles(df, names), names, MOMENTS)
    quartiles = quantile_table(df, names, QUARTILES)
    return moments.join(F.broadcast(quartiles), "feature").select("feature", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def scale_before_after(before: DataFrame, after: DataFrame, features: Sequence[str]) -> DataFrame:
    """(stage, feature, mean, std, min, max) of the same columns in two tables."""
    wanted = {m: MOMENTS[m] for m in ("mean", "std", "min", "max")}
    return union_all([
        per_feature(as_doubles(df, features), features, wanted).withColumn("stage", F.lit(stage))
        for stage, df in (("before", before), ("after", after))
    ]).select("stage", "feature", "mean", "std", "min", "max")


def skewness_info(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """feature, skewness (bias-corrected), abs_skewness, verdict; most skewed first."""
    names = _features(df, features)
    skew = per_feature(as_doubles(df, names), names, {"skewness": skewness_sql}, cost=6)
    return skew.selectExpr("feature", "skewness", "abs(skewness) as abs_skewness", f"{verdict_sql('abs(skewness)')} as verdict").orderBy(
        F.desc_nulls_last("abs_skewness"), "feature")


def very_skewed(df: DataFrame, features: Sequence[str] | None = None, threshold: float = 2.0) -> DataFrame:
    """Rows of `skewness_info` above the threshold."""
    return skewness_info(df, features).where(F.col("abs_skewness") > threshold)


def _fences(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, dict[str, tuple]]:
    """Quartile table with 1.5 IQR fences, and the same as driver-side literals (one row per column)."""
    table = quantile_table(df, names, {"q1": 0.25, "median": 0.5, "q3": 0.75}).selectExpr(
        "*", "q3 - q1 as iqr", "q1 - 1.5D * (q3 - q1) as lower", "q3 + 1.5D * (q3 - q1) as upper")
    return table, {r["feature"]: (r["lower"], r["upper"]) for r in table.collect()}


def _beyond(c: str, low: float | None, high: float | None) -> str:
    if low is None:
        return "false"
    return f"({c} < {number(low)} or {c} > {number(high)})"


def outlier_info(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """q1, q3, iqr, fences (rounded for display), number and percentage of rows strictly beyond them."""
    names = _features(df, features)
    table, fences = _fences(df, names)
    by_column = {q(n): fences[n] for n in names}
    counts = per_feature(as_doubles(df, names), names, {
        "outlier_count": lambda c: f"count_if({_beyond(c, *by_column[c])})",
        "n_rows": lambda c: "count(*)",
    })
    return counts.join(F.broadcast(table), "feature").selectExpr(
        "feature", "bround(q1, 2) as q1", "bround(q3, 2) as q3", "bround(iqr, 2) as iqr",
        "bround(lower, 2) as lower_bound", "bround(upper, 2) as upper_bound",
        "outlier_count", f"{percent_sql('outlier_count', 'n_rows')} as outlier_pct",
    ).orderBy(F.desc("outlier_pct"), "feature")


def box_stats(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Box-plot figures: quartiles, whiskers at the outermost values inside the fences, outlier count."""
    names = _features(df, features)
    table, fences = _fences(df, names)
    by_column = {q(n): fences[n] for n in names}
    ends = per_feature(as_doubles(df, names), names, {
        "whisker_lo": lambda c: f"min(case when not {_beyond(c, *by_column[c])} then {c} end)",
        "whisker_hi": lambda c: f"max(case when not {_beyond(c, *by_column[c])} then {c} end)",
        "outlier_count": lambda c: f"count_if({_beyond(c, *by_column[c])})",
    })
    # A whisker never ends inside its box.
    return ends.join(F.broadcast(table), "feature").selectExpr(
        "feature", "q1", "median", "q3", "least(whisker_lo, q1) as whisker_lo", "greatest(whisker_hi, q3) as whisker_hi", "outlier_count")


def feature_ranges(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """(feature, median, min, max): defaults and limits for entering one flow."""
    names = _features(df, features)
    ends = per_feature(as_doubles(df, names), names, {m: MOMENTS[m] for m in ("min", "max")})
    return ends.join(F.broadcast(quantile_table(df, names, {"median": 0.5})), "feature").select("feature", "median", "min", "max")


def correlation_matrix(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation over the rows where both columns are present: long, both triangles and the diagonal."""
    names = _features(df, features)
    half = _correlations(df, names)
    mirrored = half.where("i < j").selectExpr("feature_2 as feature_1", "feature_1 as feature_2", "correlation")
    return half.select("feature_1", "feature_2", "correlation").unionByName(mirrored)


def top_correlations(df: DataFrame, features: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    """The n strongest pairs of different columns."""
    names = _features(df, features)
    return _correlations(df, names).where("i < j and correlation is not null").select("feature_1", "feature_2", "correlation").orderBy(
        F.desc(F.abs("correlation")), "feature_1", "feature_2").limit(n)


def _correlations(df: DataFrame, names: Sequence[str]) -> DataFrame:
    name_of = "element_at(array(" + ", ".join(text(n) for n in names) + "), {0} + 1)"
    sums = pair_sums(as_doubles(df, names), names)
    covariance = "(sxy - sx * sy / n)"
    spread = "sqrt(greatest(sxx - sx * sx / n, 0D)) * sqrt(greatest(syy - sy * sy / n, 0D))"
    # A constant column leaves only rounding noise as its spread: no correlation.
    noise = "(sxx - sx * sx / n <= 1e-13D * sxx or syy - sy * sy / n <= 1e-13D * syy)"
    return sums.selectExpr(
        "i", "j", f"{name_of.format('i')} as feature_1", f"{name_of.format('j')} as feature_2",
        f"case when n >= 2 and not {noise} then greatest(-1D, least(1D, nullif(try_divide({covariance}, {spread}), double('NaN')))) end as correlation")


def _compared_as(kind: T.DataType) -> str:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return "double"
    if isinstance(kind, T.IntegralType):
        return "bigint"
    return kind.simpleString() if isinstance(kind, T.DecimalType) else "string"


def column_profile(df: DataFrame, exact_distinct: bool = True) -> DataFrame:
    """One row per column: type, present, missing and distinct counts; for numbers also the usual statistics.

    Exact distinct counts shuffle every distinct (column, value) once; `exact_distinct=False` uses a sketch instead.
    """
    numeric = numeric_columns(df)
    others = [c for c in df.columns if c not in numeric]
    clean = nan_to_null(df)
    order = "array_position(array(" + ", ".join(text(c) for c in df.columns) + "), feature)"
    dtype = "element_at(map(" + ", ".join(f"{text(n)}, {text(t)}" for n, t in df.dtypes) + "), feature)"
    base = {"non_null": lambda c: f"count({c})", "nulls": lambda c: f"count_if({c} is null)"}
    parts = []
    if numeric:
        doubles = as_doubles(df, numeric)
        moments = per_feature(doubles, numeric, {**base, **{m: MOMENTS[m] for m in ("mean", "std", "min", "max")}}, cost=1)
        skew = skewness_info(df, numeric)
        quartiles = quantile_table(df, numeric, {"q1": 0.25, "median": 0.5, "q3": 0.75})
        parts.append(moments.join(F.broadcast(quartiles), "feature").join(F.broadcast(skew.drop("abs_skewness")), "feature"))
    if others:
        blank = ["mean", "std", "min", "max", "q1", "median", "q3", "skewness"]
        parts.append(per_feature(clean, others, base).selectExpr("*", *[f"cast(null as double) as {b}" for b in blank], "cast(null as string) as verdict"))
    profile = union_all(parts)

    if exact_distinct:
        # Pre-combined by value, so a value shared by a third of all rows travels once per task.
        # Each type is compared as itself: large integers and decimals would meet as doubles.
        def distinct(names: Sequence[str], as_type: str) -> DataFrame:
            if as_type in ("double", "bigint"):
                return distinct_counts(clean.selectExpr(*[f"cast({q(n)} as {as_type}) as {q(n)}" for n in names]))
            pairs = "array(" + ", ".join(f"cast({q(n)} as {as_type})" for n in names) + ")"
            return (
                clean.selectExpr(f"posexplode({pairs}) as (fid, v)").where("v is not null").distinct()
                .groupBy("fid").agg(F.count("*").alias("n_unique"))
                .selectExpr(f"element_at(array({', '.join(text(n) for n in names)}), fid + 1) as feature", "n_unique")
            )
        by_type: dict[str, list[str]] = {}
        for field in df.schema.fields:
            by_type.setdefault(_compared_as(field.dataType), []).append(field.name)
        uniques = union_all([distinct(n, t) for t, n in by_type.items()])
    else:
        uniques = per_feature(clean, df.columns, {"n_unique": lambda c: f"approx_count_distinct({c})"})
    return profile.join(F.broadcast(uniques), "feature", "left").selectExpr(
        "feature", f"{dtype} as dtype", "non_null", "nulls", "coalesce(n_unique, 0L) as n_unique",
        "mean", "median", "std", "min", "max", "q1", "q3", "skewness", "verdict", f"{order} as ordinal",
    ).orderBy("ordinal").drop("ordinal")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, count, percentage of all rows): missing values count in the total only."""
    counts = nan_to_null(df.select(q(column))).groupBy(F.expr(q(column)).alias("value")).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("total")).select("total").first()["total"] or 0
    return counts.where("value is not null").selectExpr("value", "count", f"{percent_sql('count', f'{total}L')} as percentage").orderBy(
        F.desc("count"), "value")


def histogram(df: DataFrame, features: Sequence[str] | None = None, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(feature, bin, bin_lo, bin_hi, count): equal-width bins over the finite values, the last closed on the right.

    A constant column gets the range value ± 0.5. Empty bins are listed.
    """
    names = _features(df, features)
    finite = df.selectExpr(*[f"{finite_or_null(f'cast({q(n)} as double)')} as {q(n)}" for n in names])
    ends = per_feature(finite, names, {"lo": lambda c: f"min({c})", "hi": lambda c: f"max({c})"}).where("lo is not null").selectExpr(
        "feature", "case when lo = hi then lo - 0.5D else lo end as lo", "case when lo = hi then hi + 0.5D else hi end as hi")
    # One row per column: safe to broadcast.
    ends = F.broadcast(df.sparkSession.createDataFrame(ends.collect(), "feature string, lo double, hi double"))
    names_sql = "array(" + ", ".join(text(n) for n in names) + ")"
    values = "array(" + ", ".join(q(n) for n in names) + ")"
    edge = "({0} * ((hi - lo) / " + f"{bins}D) + lo)"
    raw = f"cast(least(floor((v - lo) / (hi - lo) * {bins}), {bins - 1}) as int)"
    # Bin borders decide, not the rounded division.
    settled = f"case when v < {edge.format('b')} then b - 1 when b < {bins - 1} and v >= {edge.format('(b + 1)')} then b + 1 else b end"
    counted = (
        finite.selectExpr(f"posexplode({values}) as (fid, v)").where("v is not null")
        .selectExpr(f"element_at({names_sql}, fid + 1) as feature", "v").join(ends, "feature")
        .selectExpr("feature", "lo", "hi", "v", f"{raw} as b").selectExpr("feature", f"{settled} as bin")
        .groupBy("feature", "bin").agg(F.count("*").alias("count"))
    )
    frame = ends.selectExpr("feature", "lo", "hi", f"explode(sequence(0, {bins - 1})) as bin").selectExpr(
        "feature", "bin", f"{edge.format('bin')} as bin_lo", f"case when bin = {bins - 1} then hi else {edge.format('(bin + 1)')} end as bin_hi")
    return frame.join(F.broadcast(counted), ["feature", "bin"], "left").selectExpr(
        "feature", "bin", "bin_lo", "bin_hi", "coalesce(count, 0L) as count")


def histogram_before_after(before: DataFrame, after: DataFrame, features: Sequence[str], bins: int = 40) -> DataFrame:
    """Histograms of the features in two tables, told apart by `stage`."""
    return union_all([
        histogram(df, features, bins).withColumn("stage", F.lit(stage)) for stage, df in (("before", before), ("after", after))
    ]).select("stage", "feature", "bin", "bin_lo", "bin_hi", "count")
