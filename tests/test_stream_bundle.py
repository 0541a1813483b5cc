"""A model that is replaced between micro-batches, and a micro-batch that is written again."""

import pathlib

import numpy as np

from flowprofile.catalog import queries
from flowprofile.operators import kmeans, prep
from flowprofile.sources.bundle import save_bundle
from flowprofile.streaming import score_with_bundle, write_batch

NAMES = ["x", "y"]


def model(centers):
    return kmeans.KMeansModel(len(centers), tuple(NAMES), tuple(map(tuple, centers)), (1,) * len(centers), 0.0, 1)


def test_new_versions_count_from_the_next_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    flows = spark.createDataFrame([(*map(float, v), i) for i, v in enumerate(rng.normal(size=(80, 2)))], "x double, y double, n int")
    fitted = prep.fit(flows, NAMES, apply_log=False, scaler="none")
    source, out, checkpoint, bundle = (str(tmp_path / n) for n in ("flows", "out", "checkpoint", "bundle"))
    save_bundle(spark, bundle, model([[0.0, 0.0], [50.0, 50.0]]), fitted)
    flows.where("n < 40").write.mode("append").parquet(source)
    assert score_with_bundle(spark.readStream.schema(flows.schema).parquet(source), bundle, out, checkpoint) == out
    save_bundle(spark, bundle, model([[50.0, 50.0], [0.0, 0.0]]), fitted)
    flows.where("n >= 40").write.mode("append").parquet(source)
    score_with_bundle(spark.readStream.schema(flows.schema).parquet(source), bundle, out, checkpoint)

    rows = spark.read.parquet(out).collect()
    assert sorted(r["n"] for r in rows) == list(range(80))
    assert {(r["n"] < 40, r["cluster"]) for r in rows} == {(True, 0), (False, 1)}
    versions = {half: {r["model_version"] for r in rows if (r["n"] < 40) == half} for half in (True, False)}
    assert len(versions[True]) == len(versions[False]) == 1 and versions[True] != versions[False]

    # The last batch again, as after a failure: its rows are replaced.
    write_batch(flows.where("n >= 40"), max(r["batch_id"] for r in rows), bundle, out)
    assert sorted(r["n"] for r in spark.read.parquet(out).collect()) == list(range(80))


def test_only_named_columns_stand_beside_the_scores(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(*map(float, v), i) for i, v in enumerate(rng.normal(size=(50, 2)))] + [(None, 1.0, 50)]
    flows = spark.createDataFrame(rows, "x double, y double, n int")
    fitted = prep.fit(flows.where("x is not null"), NAMES, apply_log=False, scaler="none")
    whole, narrow, source, bundle = (str(tmp_path / n) for n in ("whole", "narrow", "flows", "bundle"))
    save_bundle(spark, bundle, model([[0.0, 0.0], [5.0, 5.0]]), fitted)
    flows.write.parquet(source)
    score_with_bundle(spark.readStream.schema(flows.schema).parquet(source), bundle, whole)
    score_with_bundle(spark.readStream.schema(flows.schema).parquet(source), bundle, narrow, keep=["n"])
    assert {c.name for c in spark.read.parquet(whole).schema} >= {"x", "y", "n", "distances", "reasons"}
    got = spark.read.parquet(narrow)
    assert got.columns == ["n", "cluster", "nearest_distance", "distances", "reasons", "model_version", "batch_id"]
    same = spark.read.parquet(whole).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, same.collect())) and got.count() == 51
    files = list(pathlib.Path(narrow).rglob("*.parquet"))
    assert files and all(".zstd." in f.name for f in files)


def test_a_preparation_of_its_own_is_removed(spark, tmp_path, monkeypatch):
    """No cleaned table lies beside the scored stream, unless other queries share it."""
    def build(n):
        table = spark.createDataFrame([(float(i % 7), float(i), i) for i in range(40)], "x double, y double, n int")
        made.append(prep.preprocess(table, prep.PipelineConfig(features=("x", "y"), label=None)))
        return made[n]
    made = []
    monkeypatch.setattr(queries, "_KEPT", {})
    for n in range(2):
        with queries.shared_or_removed(spark, "own rows"):
            kept = queries.once("prepared", spark, "own rows", lambda n=n: build(n))
            assert kept.cleaned.count() == 40
        assert not pathlib.Path(made[n].path.removeprefix("file:")).exists()
    shared = queries.once("prepared", spark, "own rows", lambda: build(2))
    with queries.shared_or_removed(spark, "own rows"):
        assert queries.once("prepared", spark, "own rows", lambda: None) is shared
    assert shared.cleaned.count() == 40
    shared.close()
