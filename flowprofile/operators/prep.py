"""Selecting, cleaning, log-transforming and scaling features.

Fitting is a handful of aggregate jobs whose result is one row per feature; applying a fitted preprocessor
is a single projection with literals, so it works the same on a batch and on a stream.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowprofile.config import DEFAULT_FEATURES, MISSING_STRATEGIES, SCALERS, SKEW_THRESHOLD, PipelineConfig
from flowprofile.functions.aggregates import per_feature
from flowprofile.functions.columns import as_doubles, finite_or_null, number, numeric_columns, q, require_columns, short_methods, skewness_sql, text
from flowprofile.functions.quantiles import exact_quantiles, interpolate
from flowprofile.functions.storage import materialize_at, new_path, remove
from flowprofile.operators.distinct import distinct_rows, has_plain_columns, split_singles

# Fixed value: a spread below this counts as no spread.
MIN_SPREAD = 10 * 2.220446049250313e-16
# Bytes of dictionary after which the writer gives a column up to plain values. Measurements hold too many different values for any dictionary, and looking each of them up in one of
# 1 MB, the default, took most of the time of writing them. Zstandard writes half the bytes of Spark's default in no more time.
WRITTEN = {"parquet.dictionary.page.size": str(1 << 17), "compression": "zstd"}


def select_features(df: DataFrame, features: Sequence[str] | None = None, label: str | None = None) -> DataFrame:
    """The named features in order (the default ones when none are named), plus the label column if asked for."""
    names = list(features or DEFAULT_FEATURES)
    require_columns(df, names)
    return df.select(*[q(n) for n in names], *([q(label)] if label and label in df.columns else []))


def inf_to_null(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Features as DOUBLE with NaN and ±inf turned into null; other columns are kept."""
    names = set(features if features is not None else numeric_columns(df))
    return df.selectExpr(*[f"{finite_or_null(f'cast({q(c)} as double)')} as {q(c)}" if c in names else q(c) for c in df.columns])


def drop_missing(df: DataFrame, features: Sequence[str], label: str | None = None) -> DataFrame:
    """Rows without any missing feature or label."""
    subset = [*features, *([label] if label and label in df.columns else [])]
    return df.where(" and ".join(f"{q(c)} is not null" for c in subset))


def fill_missing(df: DataFrame, features: Sequence[str], how: str) -> DataFrame:
    """Missing features replaced by the column's mean or (interpolated) median; a missing label stays."""
    if how == "mean":
        means = per_feature(df, features, {"v": lambda c: f"avg({c})"})
        fill = {r["feature"]: r["v"] for r in means.collect()}
    elif how == "median":
        fill = {r["feature"]: r["value"] for r in exact_quantiles(df, features, [0.5])}
    else:
        raise ValueError(f"cannot fill with {how!r}")
    names = set(features)
    return df.selectExpr(*[
        f"coalesce({q(c)}, {number(fill[c])}) as {q(c)}" if c in names and fill.get(c) is not None else q(c) for c in df.columns
    ])


def deduplicate(df: DataFrame, features: Sequence[str] | None = None, label: str | None = None) -> DataFrame:
    """One row per distinct (features, label); the same features under two labels stay twice.

    Rows that share their key with no other row are found by digests and never shuffled (see `split_singles`), which reads the table three times; the others are combined before
    the shuffle, so a row repeated any number of times leaves each task a few times at most. Of the other columns the copies' smallest values are kept (as one row: they are compared
    in table order).
    """
    keys = [*features, *([label] if label and label in df.columns else [])] if features is not None else df.columns
    # Columns of one name cannot be told apart by it.
    if df.isStreaming or len({c.lower() for c in df.columns}) < len(df.columns) or not has_plain_columns(df.select(*[q(c) for c in keys])):
        return _combined(df, keys)
    singles, repeated = split_singles(df, keys)
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name in keys}
    # As a group key does, -0.0 becomes 0.0.
    alone = singles.selectExpr(*[f"{q(c)} + cast(0 as {df.schema[c].dataType.simpleString()}) as {q(c)}" if c in floats else q(c) for c in df.columns])
    return alone.unionByName(_combined(repeated, keys))


def _combined(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    others = [c for c in df.columns if c not in keys]
    if not others:
        return distinct_rows(df) if has_plain_columns(df) else df.dropDuplicates()
    grouped = df.groupBy(*[q(c) for c in keys])
    # A single kept column needs no struct, whose smallest one is found by sorting.
    kept = grouped.agg(F.min(q(others[0])).alias("_kept")) if len(others) == 1 else grouped.agg(F.min(F.struct(*[q(c) for c in others])).alias("_kept"))
    value = (lambda c: "_kept") if len(others) == 1 else (lambda c: f"_kept.{q(c)}")
    return kept.selectExpr(*[f"{value(c)} as {q(c)}" if c in others else q(c) for c in df.columns])


def clean(df: DataFrame, features: Sequence[str], label: str | None = None, missing: str = "drop") -> DataFrame:
    """±inf → missing, then drop or fill missing values, then drop duplicates."""
    if missing not in MISSING_STRATEGIES:
        raise ValueError(f"missing must be one of {MISSING_STRATEGIES}, not {missing!r}")
    if missing == "drop":
        # The rows that `drop_missing` keeps after `inf_to_null`, with each value named once: a longer test leaves what the JVM compiles.
        whole = [f"abs(cast({q(c)} as double)) < double('Infinity')" for c in features]
        present = [f"{q(label)} is not null"] if label and label in df.columns and label not in features else []
        complete = df.where(" and ".join([*whole, *present])).selectExpr(*[f"cast({q(c)} as double) as {q(c)}" if c in features else q(c) for c in df.columns])
    else:
        complete = fill_missing(inf_to_null(df, features), features, missing)
    return deduplicate(complete, features, label)


def clean_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """rows_before, rows_after, rows_removed, removed_pct (0 for an empty table)."""
    counts = before.selectExpr("1L as b", "0L as a").unionByName(after.selectExpr("0L as b", "1L as a"))
    return counts.selectExpr("b", "a").groupBy().agg({"b": "sum", "a": "sum"}).selectExpr(
        "coalesce(`sum(b)`, 0L) as rows_before", "coalesce(`sum(a)`, 0L) as rows_after",
    ).selectExpr(
        "rows_before", "rows_after", "rows_before - rows_after as rows_removed",
        "coalesce(try_divide(cast(rows_before - rows_after as double), cast(rows_before as double)) * 100D, 0D) as removed_pct")


def skewed_features(df: DataFrame, features: Sequence[str], threshold: float = SKEW_THRESHOLD) -> list[str]:
    """Features whose absolute corrected skewness exceeds the threshold, in the given order."""
    skew = per_feature(as_doubles(df, features), features, {"s": skewness_sql}, cost=6)
    above = {r["feature"] for r in skew.collect() if r["s"] is not None and abs(r["s"]) > threshold}
    return [f for f in features if f in above]


def log_shifts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, shift): what must be added so that the column has no negative value."""
    return per_feature(as_doubles(df, features), features, {"shift": lambda c: f"greatest(-min({c}), 0D)"})


def log_transform(df: DataFrame, columns: Sequence[str] | None = None, shifts: Mapping[str, float] | None = None) -> DataFrame:
    """log1p(c + shift) on the listed columns (the very skewed ones by default); absent columns are ignored."""
    if columns is None:
        columns = skewed_features(df, numeric_columns(df))
    columns = [c for c in columns if c in df.columns]
    known = dict(shifts or {})
    unknown = [c for c in columns if known.get(c) is None]
    if unknown:
        known.update({r["feature"]: r["shift"] or 0.0 for r in log_shifts(df, unknown).collect()})
    return df.selectExpr(*[f"{_log_sql(q(c), known[c])} as {q(c)}" if c in columns else q(c) for c in df.columns])


def _log_sql(c: str, shift: float) -> str:
    return f"log1p({c} + {number(shift)})" if shift else f"log1p(cast({c} as double))"


@dataclass(frozen=True)
class FeatureParameters:
    """How one feature is transformed: x -> (log1p(x + shift) or x) - center, divided by scale."""

    feature: str
    ordinal: int
    log: bool
    shift: float
    center: float
    scale: float

    def sql(self) -> str:
        x = _log_sql(q(self.feature), self.shift) if self.log else f"cast({q(self.feature)} as double)"
        if self.center == 0.0 and self.scale == 1.0:
            return x
        return f"({x} - {number(self.center)}) / {number(self.scale)}"


PARAMETER_SCHEMA = "feature string, ordinal int, log boolean, shift double, center double, scale double"


@dataclass(frozen=True)
class FittedPreprocessor:
    """Fitted parameters, one per feature, in model order."""

    parameters: tuple[FeatureParameters, ...]

    @property
    def features(self) -> list[str]:
        return [p.feature for p in self.parameters]

    @property
    def skewed(self) -> list[str]:
        return [p.feature for p in self.parameters if p.log]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(p).values()) for p in self.parameters], PARAMETER_SCHEMA)

    @classmethod
    def from_table(cls, table: DataFrame) -> FittedPreprocessor:
        rows = table.orderBy("ordinal").collect()
        return cls(tuple(FeatureParameters(*(r[f] for f in ("feature", "ordinal", "log", "shift", "center", "scale"))) for r in rows))

    def transform(self, df: DataFrame) -> DataFrame:
        """Scaled features under their own names; all other columns are kept. One projection, no job."""
        require_columns(df, self.features)
        sql = {p.feature: p.sql() for p in self.parameters}
        return df.selectExpr(*[f"{sql[c]} as {q(c)}" if c in sql else q(c) for c in df.columns])

    def log_only(self, df: DataFrame) -> DataFrame:
        """The step before scaling."""
        return log_transform(df, self.skewed, {p.feature: p.shift for p in self.parameters if p.log})

    def scaled_array(self, df: DataFrame) -> DataFrame:
        """`_row` (the input columns as a struct) and `_scaled` (the features in model order); for rows known to be clean."""
        require_columns(df, self.features)
        whole = ", ".join(q(c) for c in df.columns)
        return df.selectExpr(f"struct({whole}) as _row", f"array({', '.join(p.sql() for p in self.parameters)}) as _scaled")

    def checked_array(self, df: DataFrame) -> DataFrame:
        """`_row`, `_scaled` (null elements where not finite) and `reasons`: why a row cannot be scored, empty when it can."""
        require_columns(df, self.features)
        whole = ", ".join(q(c) for c in df.columns)
        raw = "array(" + ", ".join(f"cast({q(f)} as double)" for f in self.features) + ")"
        both = df.selectExpr(f"struct({whole}) as _row", f"{raw} as _raw", f"array({', '.join(p.sql() for p in self.parameters)}) as _scaled")
        # Only finite values times zero add up to zero. The functions below are interpreted, element by element, so only rows that fail this test pass through them.
        zeros = " + ".join(f"_scaled[{i}] * 0D" for i in range(len(self.parameters))) or "0D"
        tested = both.selectExpr("*", f"coalesce({zeros} = 0D, false) as _fine")
        # Short code for all features at once: spelled out per feature it outgrows what the JVM compiles.
        usable = "transform({0}, v -> case when abs(v) < double('Infinity') then v end)"
        finite = tested.selectExpr(
            "_row", "_fine", f"case when not _fine then {usable.format('_raw')} end as _raw", f"case when _fine then _scaled else {usable.format('_scaled')} end as _scaled")
        names = "array(" + ", ".join(text(f) for f in self.features) + ")"
        told = (
            f"array_compact(transform({names}, (n, i) -> case when _raw[i] is null then concat('missing or infinite: ', n) "
            "when _scaled[i] is null then concat('not finite after preprocessing: ', n) end))"
        )
        return finite.selectExpr("_row", "_scaled", f"case when _fine then cast(array() as array<string>) else {told} end as reasons")

    def transform_new(self, df: DataFrame, on_bad: str = "raise") -> DataFrame:
        """Scale unseen rows.

        `on_bad="raise"` counts unusable cells in one aggregate and names the columns; `"route"` runs no job
        and returns all rows with a `reasons` column, the scaled features being null where they are not finite;
        `"trust"` is for rows that were cleaned before.
        """
        if on_bad == "route":
            ordinal = {p.feature: p.ordinal for p in self.parameters}
            return self.checked_array(df).selectExpr(
                *[f"_scaled[{ordinal[c]}] as {q(c)}" if c in ordinal else f"_row.{q(c)} as {q(c)}" for c in df.columns], "reasons")
        if on_bad == "raise":
            self.raise_on_bad(df)
        elif on_bad != "trust":
            raise ValueError("on_bad must be 'raise', 'route' or 'trust'")
        return self.transform(df)

    def raise_on_bad(self, df: DataFrame) -> None:
        require_columns(df, self.features)
        sql = {q(p.feature): p.sql() for p in self.parameters}
        bad = per_feature(df, self.features, {
            "missing": lambda c: f"count_if(({finite_or_null(f'cast({c} as double)')}) is null)",
            "broken": lambda c: f"count_if(({finite_or_null(sql[c])}) is null)",
        }).collect()
        found = {r["feature"]: r for r in bad}
        missing = [f for f in self.features if found[f]["missing"]]
        if missing:
            raise ValueError(f"input contains missing or infinite values in: {missing}")
        broken = [f for f in self.features if found[f]["broken"]]
        if broken:
            raise ValueError(f"input is not finite after preprocessing in: {broken}")


def fit(
    df: DataFrame, features: Sequence[str], apply_log: bool = True,
    threshold: float = SKEW_THRESHOLD, scaler: str = "standard",
) -> FittedPreprocessor:
    """Fit log flags, shifts and scaling on a cleaned table.

    Standard scaling needs two aggregate passes: one over the raw columns (moments and skewness), and one over the
    logged columns only. Min-max and robust scaling need no second pass, because log1p keeps the order of values.
    """
    if scaler not in SCALERS:
        raise ValueError(f"scaler must be one of {SCALERS}, not {scaler!r}")
    names = list(features)
    doubles = as_doubles(df, names)
    raw = {r["feature"]: r for r in per_feature(doubles, names, {
        "lo": lambda c: f"min({c})", "hi": lambda c: f"max({c})", "mean": lambda c: f"avg({c})",
        "std": lambda c: f"stddev_pop({c})", "skew": skewness_sql,
    }, cost=2).collect()}
    if any(raw[f]["lo"] is None for f in names):
        raise ValueError(f"no values to fit on in: {[f for f in names if raw[f]['lo'] is None]}")
    logged = {f: bool(apply_log and raw[f]["skew"] is not None and abs(raw[f]["skew"]) > threshold) for f in names}
    shift = {f: max(-raw[f]["lo"], 0.0) + 0.0 if logged[f] else 0.0 for f in names}

    def after_log(f: str, value: float) -> float:
        return math.log1p(value + shift[f]) if logged[f] else value

    center, scale = dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
    if scaler == "standard":
        moments = {f: (raw[f]["mean"], raw[f]["std"]) for f in names}
        again = [f for f in names if logged[f]]
        if again:
            sql = {q(f): _log_sql(q(f), shift[f]) for f in again}
            second = per_feature(doubles, again, {"mean": lambda c: f"avg({sql[c]})", "std": lambda c: f"stddev_pop({sql[c]})"}, cost=2)
            moments.update({r["feature"]: (r["mean"], r["std"]) for r in second.collect()})
        for f in names:
            center[f], std = moments[f]
            scale[f] = std if std > 0 else 1.0
    elif scaler == "minmax":
        for f in names:
            center[f] = after_log(f, raw[f]["lo"])
            spread = after_log(f, raw[f]["hi"]) - center[f]
            scale[f] = spread if spread >= MIN_SPREAD else 1.0
    elif scaler == "robust":
        quartile: dict[tuple, float] = {}
        for r in exact_quantiles(df, names, [0.25, 0.5, 0.75]):
            ends = (after_log(r["feature"], r["lower"]), after_log(r["feature"], r["upper"]))
            quartile[r["feature"], r["prob"]] = interpolate(*ends, r["frac"])
        for f in names:
            center[f] = quartile[f, 0.5]
            spread = quartile[f, 0.75] - quartile[f, 0.25]
            scale[f] = spread if spread >= MIN_SPREAD else 1.0
    return FittedPreprocessor(tuple(
        FeatureParameters(f, i, logged[f], float(shift[f]), float(center[f]), float(scale[f])) for i, f in enumerate(names)))


@dataclass(frozen=True)
class Prepared:
    """Selected, cleaned and scaled tables (label and other columns stay in the row) and the fitted parameters.

    As a context manager, or by `close`, it removes the cleaned table it has written; the tables cannot be read after that.
    """

    selected: DataFrame
    cleaned: DataFrame
    scaled: DataFrame
    preprocessor: FittedPreprocessor
    path: str

    def close(self) -> None:
        remove(self.cleaned.sparkSession, self.path)

    def __enter__(self) -> Prepared:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()


def preprocess(df: DataFrame, config: PipelineConfig = PipelineConfig(), keep: Sequence[str] = ()) -> Prepared:
    """Select → clean → fit → log and scale. `keep` names further columns to carry along.

    The cleaned table is the result of the one large shuffle and is read by every later step, so it is
    written to the shared folder once.
    """
    features, label = list(config.features), config.label
    require_columns(df, features)
    short_methods(df.sparkSession)
    wanted = [*features, *([label] if label and label in df.columns else []), *keep]
    selected = df.select(*[q(c) for c in wanted])
    path = new_path(df.sparkSession, "cleaned")
    cleaned = materialize_at(clean(selected, features, label, config.missing), path, **WRITTEN)
    preprocessor = fit(cleaned, features, config.apply_log, config.skew_threshold, config.scaler)
    return Prepared(selected, cleaned, preprocessor.transform(cleaned), preprocessor, path)
