"""Inputs that the registered fixtures don't contain: wide integers, noise, gaps in keys, many columns, folders left behind."""

import pathlib

import numpy as np
import pytest

from flowprofile.config import PipelineConfig
from flowprofile.functions.storage import materialize_at, new_path, remove, shared_folder
from flowprofile.operators import gram, interpret, prep, profile
from flowprofile.sources import load_flows, write_sample


def test_csv_keeps_text_and_wide_integers(spark, tmp_path):
    (tmp_path / "flows.csv").write_text(
        "ip,id,big,speed,empty,note,zip\n10.0.0.1,20615826128782088,99999999999999999999,1.5,,a b,007\n 10.0.0.2,20615826128782089,1,inf,,,12\n,,,NaN,,x,\n")
    df = load_flows(spark, str(tmp_path / "flows.csv"), required=["speed"], text_columns=["zip"])
    assert dict(df.dtypes) == {"ip": "string", "id": "bigint", "big": "string", "speed": "double", "empty": "double", "note": "string", "zip": "string"}
    rows = df.collect()
    assert [r["id"] for r in rows] == [20615826128782088, 20615826128782089, None]
    assert rows[0]["ip"] == "10.0.0.1" and rows[0]["big"] == "9" * 20 and rows[0]["zip"] == "007"
    with pytest.raises(ValueError, match="not a number.*note"):
        load_flows(spark, str(tmp_path / "flows.csv"), required=["speed", "note"])


def test_distinct_counts_are_exact_for_wide_types(spark):
    df = spark.range(1000).selectExpr("9007199254740992 + id as wide", "cast(9007199254740992 + id as decimal(38, 10)) + 0.0000000001 as money", "id % 7 as small", "cast(id % 3 as double) as x")
    assert {r["feature"]: r["n_unique"] for r in profile.column_profile(df).collect()} == {"wide": 1000, "money": 1000, "small": 7, "x": 3}


def test_noise_between_cluster_means_is_no_deviation(spark):
    rows = [(c, 0.1, float(c * 10 + i)) for c in range(8) for i in range(3 + 5 * c)]
    summary = interpret.cluster_summary(spark.createDataFrame(rows, "cluster int, flat double, moving double").repartition(7), ["flat", "moving"])
    z = {(r["cluster"], r["feature"]): r["z"] for r in interpret.profile_zscores(summary).collect()}
    assert all(z[c, "flat"] == 0.0 for c in range(8)) and abs(z[0, "moving"]) > 1
    assert all(r["feature"] == "moving" for r in interpret.dominant_features(summary, 1).collect())


def test_all_deviating_features_are_listed_and_five_named(spark):
    names = [f"f{i}" for i in range(7)]
    rows = [(c, *([100.0 if c == 8 else float(c % 2)] * 7)) for c in range(9)]
    df = spark.createDataFrame(rows, "cluster int, " + ", ".join(f"{n} double" for n in names))
    (flag,) = interpret.anomaly_flags(interpret.cluster_summary(df, names), interpret.cluster_distribution(df), size_threshold=0.0).collect()
    assert flag["deviating_features"] == names and flag["reasons"] == ["high deviation in: f0, f1, f2, f3, f4"]


def test_rows_without_a_cluster_are_left_out(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (None, 99.0), (1, 5.0)], "cluster int, x double")
    assert [tuple(r) for r in interpret.cluster_distribution(df).collect()] == [(0, 2, 66.67), (1, 1, 33.33)]
    assert {(r["cluster"], r["mean"]) for r in interpret.cluster_summary(df, ["x"]).collect()} == {(0, 2.0), (1, 5.0)}
    medians = {r["cluster"]: r["value"] for r in interpret.cluster_profiles(df, ["x"]).where("stat = 'median'").collect()}
    assert medians == {0: 2.0, 1: 5.0}


def test_crosstab_has_a_column_for_every_label(spark):
    df = spark.range(1500).selectExpr("cast(id % 2 as int) as cluster", "cast(id as string) as label")
    assert len(interpret.label_crosstab(df, "label").columns) == 1501


def test_pair_sums_in_blocks_equal_those_of_one_matrix(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 11))
    x[rng.random(x.shape) < 0.1] = np.nan
    names = [f"c{i}" for i in range(11)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"{n} double" for n in names))
    whole = {(r["i"], r["j"]): r[2:] for r in gram.pair_sums(df, names).collect()}
    monkeypatch.setattr(gram, "BLOCK_COLUMNS", 4)
    parts = {(r["i"], r["j"]): r[2:] for r in gram.pair_sums(df, names).collect()}
    assert parts.keys() == whole.keys() and len(whole) == 66
    for k in whole:
        assert parts[k] == pytest.approx(whole[k])


def test_copies_keep_their_smallest_other_values(spark):
    df = spark.createDataFrame([(1.0, "a", 9, "x"), (1.0, "a", 3, "z"), (1.0, "b", 1, "q"), (2.0, "a", None, "q")], "f double, label string, n int, s string").repartition(4)
    assert sorted(map(tuple, prep.deduplicate(df, ["f"], "label").collect()), key=str) == [(1.0, "a", 3, "z"), (1.0, "b", 1, "q"), (2.0, "a", None, "q")]
    assert sorted(map(tuple, prep.deduplicate(df.drop("s"), ["f"], "label").collect()), key=str) == [(1.0, "a", 3), (1.0, "b", 1), (2.0, "a", None)]


def test_written_tables_are_removed(spark):
    folder = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.rglob("*")) if folder.exists() else set()
    df = spark.createDataFrame([(float(i % 9), float(i), "a") for i in range(40)], "x double, y double, label string")
    with prep.preprocess(df, PipelineConfig(features=("x", "y"), label="label")) as prepared:
        assert prepared.scaled.count() == 40 and set(folder.rglob("*")) != before
    assert set(folder.rglob("*")) == before


def test_a_folder_is_found_without_a_setting(spark):
    path = new_path(spark, "t")
    assert path.startswith(shared_folder(spark))
    table = materialize_at(spark.range(3).toDF("n"), path)
    assert table.count() == 3
    remove(spark, path)
    assert not pathlib.Path(path.removeprefix("file:")).parent.exists()


def test_packed_csv_holds_the_same_rows(spark, tmp_path):
    rows = [(i, i / 7, None if i % 5 else "a, b") for i in range(5000)]
    df = spark.createDataFrame(rows, "n bigint, x double, t string").repartition(3)
    plain, packed = write_sample(df, str(tmp_path / "plain.csv")), write_sample(df, str(tmp_path / "packed.csv"), compression="gzip")
    size = lambda path: sum(f.stat().st_size for f in pathlib.Path(path).glob("part-*"))
    assert all(f.name.endswith(".csv.gz") for f in pathlib.Path(packed).glob("part-*")) and size(packed) < size(plain) / 2
    read = [load_flows(spark, path, required=["n", "x"], text_columns=["t"]) for path in (plain, packed)]
    assert read[0].schema == read[1].schema
    assert sorted(map(tuple, read[1].collect()), key=repr) == sorted(map(tuple, read[0].collect()), key=repr) == sorted(rows, key=repr)
