"""Closed-form checks of the profiling and preparation operators."""

import math

import numpy as np
import pytest

from flowprofile.config import PipelineConfig
from flowprofile.functions.columns import numeric_columns, require_columns
from flowprofile.functions.quantiles import exact_quantiles, grouped_quantiles
from flowprofile.operators import prep, profile
from flowprofile.sources import load_flows, separate_labels, validate_schema

NAN, INF = float("nan"), float("inf")


def one_column(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_six_values(spark):
    df = one_column(spark, [1.0, 2.0, 3.0, 7.0, 10.0, 50.0])
    row = only(profile.describe(df))
    assert (row["q25"], row["q50"], row["q75"]) == (2.25, 5.0, 9.25)
    assert only(profile.skewness_info(df))["skewness"] == pytest.approx(2.278408, abs=1e-6)


def test_constant_short_and_empty_columns(spark):
    constant = only(profile.skewness_info(one_column(spark, [4.0] * 5)))
    assert (constant["skewness"], constant["verdict"]) == (0.0, "Approx. Symmetric")
    assert only(profile.skewness_info(one_column(spark, [1.0, 2.0])))["skewness"] is None
    empty = only(profile.describe(one_column(spark, [])))
    assert (empty["count"], empty["mean"], empty["q50"]) == (0, None, None)
    lone = only(profile.describe(one_column(spark, [3.0])))
    assert (lone["mean"], lone["std"], lone["q75"]) == (3.0, None, 3.0)


def test_missing_and_infinite_are_counted_apart(spark):
    df = one_column(spark, [1.0, NAN, None, INF, -INF])
    row = only(profile.missing_report(df))
    assert (row["missing_count"], row["missing_pct"], row["inf_count"], row["total_issues"]) == (2, 40.0, 2, 4)
    assert only(profile.dataset_overview(df))["n_missing_or_inf"] == 4
    described = only(profile.describe(df))
    assert (described["count"], described["mean"], described["min"], described["max"]) == (3, None, -INF, INF)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_quantiles_match_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    columns = {
        "normal": rng.normal(size=3000), "heavy": np.exp(rng.normal(0, 4, size=3000)), "hot": np.where(rng.random(3000) < 0.4, 7.0, rng.normal(size=3000)),
        "tiny": rng.normal(size=3000) * 1e-300, "close": 1.0 + rng.integers(0, 50, 3000) * 2.0 ** -52, "signs": rng.integers(-3, 4, 3000) * 1.0,
    }
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns.values())], list(columns)).repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r["feature"], r["prob"]): r["value"] for r in exact_quantiles(df, list(columns), probs)}
    for name, values in columns.items():
        for p in probs:
            assert got[name, p] == pytest.approx(float(np.quantile(values, p)), rel=1e-12, abs=0), (name, p)


def test_grouped_quantiles(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), float(v), float(v * v)) for g, v in zip(rng.integers(0, 4, 2000), rng.normal(size=2000), strict=True)]
    df = spark.createDataFrame([*rows, (9, float("nan"), None), (None, 1.0, 1.0)], "g int, x double, y double").repartition(3)
    got = {(r["grp"], r["feature"], r["prob"]): r["value"] for r in grouped_quantiles(df.where("g is not null"), ["x", "y"], [0.25, 0.5], "g").collect()}
    assert len(got) == 16
    for (g, f, p), v in got.items():
        assert v == np.quantile([r[1 if f == "x" else 2] for r in rows if r[0] == int(g)], p)


def test_quantiles_of_very_many_groups(spark):
    df = spark.range(30_000).selectExpr("id % 3000 as g", "cast((id * 7919) % 100003 as double) as x")
    got = {int(r["grp"]): r["value"] for r in grouped_quantiles(df, ["x"], [0.5], "g").collect()}
    assert got == {g: float(np.median([(i * 7919) % 100003 for i in range(g, 30_000, 3000)])) for g in range(3000)}


def test_correlation_is_pairwise_complete(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(1e6, 1, 500), rng.normal(size=500)
    gaps = rng.random(500) < 0.3
    df = spark.createDataFrame([(float(a), None if g else float(a + b), 5.0) for a, b, g in zip(x, y, gaps)], "a double, b double, c double")
    got = {(r["feature_1"], r["feature_2"]): r["correlation"] for r in profile.correlation_matrix(df).collect()}
    keep = ~gaps
    assert got["a", "b"] == got["b", "a"] == pytest.approx(np.corrcoef(x[keep], (x + y)[keep])[0, 1], abs=1e-9)
    assert got["a", "a"] == pytest.approx(1.0) and got["a", "c"] is None and got["c", "c"] is None and len(got) == 9


def test_histogram_matches_numpy(spark):
    values = np.concatenate([np.linspace(0, 1, 51), np.random.default_rng(2).normal(size=400)])
    counts, edges = np.histogram(values, 50)
    rows = profile.histogram(one_column(spark, [*map(float, values), None, INF])).orderBy("bin").collect()
    assert [r["count"] for r in rows] == counts.tolist()
    assert np.allclose([r["bin_lo"] for r in rows], edges[:-1]) and rows[-1]["bin_hi"] == edges[-1]
    constant = profile.histogram(one_column(spark, [2.0, 2.0])).where("count > 0").collect()
    assert [(r["count"], r["bin"]) for r in constant] == [(2, 25)]


def test_value_counts_and_profile_of_text(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "x string")
    assert [tuple(r) for r in profile.value_counts(df, "x").collect()] == [("a", 2, 50.0), ("b", 1, 25.0)]
    row = only(profile.column_profile(df))
    assert (row["dtype"], row["non_null"], row["nulls"], row["n_unique"], row["mean"]) == ("string", 3, 1, 2, None)
    assert only(profile.column_profile(df, exact_distinct=False))["n_unique"] == 2


def test_schema_checks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, "x")], "a int, b double, c string")
    assert numeric_columns(df) == ["a", "b"]
    with pytest.raises(ValueError, match="'d', 'e'"):
        require_columns(df, ["a", "d", "e"])
    with pytest.raises(ValueError):
        validate_schema(df)
    with pytest.raises(FileNotFoundError):
        load_flows(spark, str(tmp_path / "absent.csv"))
    rest, label = separate_labels(df, "c")
    assert rest.columns == ["a", "b"] and label.columns == ["c"] and separate_labels(rest, "c")[1] is None


def test_csv_infinities(spark, tmp_path):
    path = tmp_path / "flows.csv"
    path.write_text("a b,c/s,Attack Type\n1,inf,x\n2,-inf,\n3,Infinity,y\n4,NaN,x\n5,,x\n")
    rows = load_flows(spark, str(path), required=["a b", "c/s"]).orderBy("`a b`").collect()
    assert [r["c/s"] for r in rows[:3]] == [INF, -INF, INF] and math.isnan(rows[3]["c/s"]) and rows[4]["c/s"] is None
    assert rows[1]["Attack Type"] is None and rows[0]["a b"] == 1.0


def test_cleaning(spark):
    rows = [(1.0, 0.0, "a"), (1.0, -0.0, "a"), (1.0, 0.0, "b"), (INF, 1.0, "a"), (2.0, NAN, "a"), (3.0, 1.0, None)]
    df = spark.createDataFrame(rows, "x double, y double, label string")
    assert sorted(map(tuple, prep.clean(df, ["x", "y"], "label").collect())) == [(1.0, 0.0, "a"), (1.0, 0.0, "b")]
    filled = prep.clean(df, ["x", "y"], "label", "mean").collect()
    assert len(filled) == 5 and {r["x"] for r in filled} == {1.0, 1.6, 2.0, 3.0}
    assert {r["x"] for r in prep.clean(df, ["x", "y"], "label", "median").collect()} == {1.0, 2.0, 3.0}
    with pytest.raises(ValueError):
        prep.clean(df, ["x", "y"], "label", "guess")
    empty = only(prep.clean_report(df.limit(0), df.limit(0)))
    assert tuple(empty) == (0, 0, 0, 0.0)


@pytest.mark.parametrize("scaler", ["standard", "minmax", "robust", "none"])
def test_scalers(spark, scaler):
    x = [1.0, 2.0, 3.0, 7.0, 10.0, 50.0]
    df = spark.createDataFrame([(v, 5.0) for v in x], "x double, c double")
    fitted = prep.fit(df, ["x", "c"], apply_log=False, scaler=scaler)
    got = fitted.transform(df).orderBy("x").collect()
    a = np.array(x)
    want = {"standard": (a - a.mean()) / a.std(), "minmax": (a - 1) / 49, "robust": (a - 5.0) / 7.0, "none": a}[scaler]
    assert np.allclose([r["x"] for r in got], want)
    assert {r["c"] for r in got} == ({5.0} if scaler == "none" else {0.0})
    again = prep.FittedPreprocessor.from_table(fitted.table(spark))
    assert again == fitted


def test_log_and_robust_commute(spark):
    x = [-1.0, 0.0, 0.0, 1.0, 2.0, 500.0]
    df = spark.createDataFrame([(v, float(i)) for i, v in enumerate(x)], "x double, y double")
    fitted = prep.fit(df, ["x", "y"], scaler="robust")
    assert fitted.skewed == ["x"] and fitted.parameters[0].shift == 1.0
    logged = np.log1p(np.array(x) + 1)
    assert fitted.parameters[0].center == pytest.approx(np.median(logged))
    assert fitted.parameters[0].scale == pytest.approx(np.quantile(logged, 0.75) - np.quantile(logged, 0.25))
    assert prep.fit(df, ["x", "y"], apply_log=False).skewed == []


def test_new_rows(spark):
    train = spark.createDataFrame([(float(v), float(v % 3)) for v in [0, 1, 1, 2, 3, 900]], "x double, y double")
    fitted = prep.fit(train, ["x", "y"])
    bad = spark.createDataFrame([(1.0, 1.0), (-5.0, 1.0), (INF, None)], "x double, y double")
    with pytest.raises(ValueError, match=r"missing or infinite values in: \['x', 'y'\]"):
        fitted.transform_new(bad)
    with pytest.raises(ValueError, match="not finite"):
        fitted.transform_new(bad.where("x = -5"))
    routed = {r["x"]: r["reasons"] for r in fitted.checked_array(bad).selectExpr("_row.x as x", "reasons").collect()}
    assert routed == {1.0: [], -5.0: ["not finite after preprocessing: x"], INF: ["missing or infinite: x", "missing or infinite: y"]}


def test_config():
    assert len(PipelineConfig(features=()).features) == 24
    for wrong in ({"missing": "x"}, {"scaler": "x"}, {"ks": (1,)}):
        with pytest.raises(ValueError):
            PipelineConfig(**wrong)
