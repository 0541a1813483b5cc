"""What collected steps write on the way is gone at their end."""

import pathlib

import numpy as np
import pytest

from flowprofile.functions.storage import materialize, scratch, shared_folder
from flowprofile.operators import evaluate, kmeans


def tables(spark):
    return {str(p) for p in pathlib.Path(shared_folder(spark).removeprefix("file:")).glob("flowprofile-*/*")}


def test_scratch_removes_tables_also_after_errors(spark):
    kept = materialize(spark.range(3), "kept")
    before = tables(spark)
    with pytest.raises(ZeroDivisionError), scratch(spark):
        assert materialize(spark.range(5), "gone").count() == 5
        assert len(tables(spark)) == len(before) + 1
        1 / 0
    assert tables(spark) == before and kept.count() == 3


def test_evaluation_leaves_nothing(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([tuple(map(float, v)) for v in rng.normal(size=(300, 2))], "a double, b double")
    models = {k: kmeans.KMeansModel(k, ("a", "b"), tuple((float(i), 0.0) for i in range(k)), (1,) * k, 1.0, 1) for k in (2, 3)}
    before = tables(spark)
    got = evaluate.evaluate_k(df, kmeans.Sweep(models), 100).collect()
    assert [r["k"] for r in got] == [2, 3] and all(-1 <= r["silhouette"] <= 1 for r in got)
    assert tables(spark) == before
