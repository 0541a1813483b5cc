"""The registered trainings and their metrics against plain numpy."""

import os
from types import SimpleNamespace

import numpy as np
import pytest

from flowprofile.catalog import queries
from flowprofile.catalog.fixtures import RANK_SQL
from flowprofile.config import EVALUATION_ROWS
from flowprofile.operators import evaluate

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def nearest(x, centers):
    gaps = np.stack([((x - c) ** 2).sum(1) for c in np.asarray(centers)], axis=1)
    return gaps.argmin(1), gaps.min(1)


def plain_silhouette(x, labels):
    squares = (x ** 2).sum(1)
    gap = np.sqrt(np.maximum(squares[:, None] + squares - 2 * x @ x.T, 0))
    np.fill_diagonal(gap, 0)
    known, row = np.unique(labels), np.arange(len(x))
    sums = np.stack([gap[:, labels == c].sum(1) for c in known], axis=1)
    sizes, own = np.array([(labels == c).sum() for c in known]), np.searchsorted(known, labels)
    a = sums[row, own] / np.maximum(sizes[own] - 1, 1)
    means = sums / sizes
    means[row, own] = np.inf
    b = means.min(1)
    return np.where((sizes[own] > 1) & (np.maximum(a, b) > 0), (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0).mean()


def test_evaluate_k_rests_on_the_stated_sample(spark):
    sample = evaluate.evaluation_sample(queries.prepared(spark, FOLDER).scaled, EVALUATION_ROWS, rank=RANK_SQL)
    x = sample.select(*[f"`{f}`" for f in queries.FEATURES]).toPandas().to_numpy(dtype=float)
    assert 2_000 < len(x) <= EVALUATION_ROWS
    got = {r["k"]: r["silhouette"] for r in queries.queries()["evaluate_k"](spark, FOLDER).collect()}
    models = queries.sweep(spark, FOLDER).models
    assert set(got) == set(models)
    for k, model in models.items():
        assert got[k] == pytest.approx(plain_silhouette(x, nearest(x, model.centers)[0]), abs=1e-5)


def test_every_k_is_trained(spark):
    for name in ("train_multiple_k", "training_summary", "evaluate_k", "elbow_series"):
        assert {r["k"] for r in queries.queries()[name](spark, FOLDER).collect()} == set(range(2, 9))
    assert {r["k"] for r in queries.queries()["train_kmeans"](spark, FOLDER).collect()} == {4}


def test_seeded_sweep_trains_every_k(spark):
    x = queries.prepared(spark, FOLDER).scaled.select(*[f"`{f}`" for f in queries.FEATURES]).toPandas().to_numpy(dtype=float)
    rows = queries.queries()["train_seeded_sweep"](spark, FOLDER).collect()
    models = queries.seeded_sweep(spark, FOLDER).models
    assert {r["k"] for r in rows} == set(models) == set(range(2, 9))
    for k, model in models.items():
        assert {r["cluster"] for r in rows if r["k"] == k} == set(range(k))
        labels, errors = nearest(x, model.centers)
        assert model.inertia == pytest.approx(errors.sum(), rel=1e-6)
        assert sum(model.sizes) == len(x) and list(model.sizes) == sorted(model.sizes, reverse=True)
        assert np.bincount(labels, minlength=k).tolist() == pytest.approx(list(model.sizes), abs=len(x) * 1e-3)
        assert errors.sum() <= ((x - x.mean(0)) ** 2).sum()


def test_train_kmeans_draws_its_starts_and_goes_on_until_nothing_moves(spark, monkeypatch):
    """Two pairs of blobs; from the centroids of the given assignment, one within the first pair and three within the second, no iteration parts the first."""
    rng = np.random.default_rng(5)
    means = np.array([[0.0] * 24, [0.0] * 12 + [9.0] * 12, [60.0] * 24, [60.0] * 12 + [69.0] * 12])
    sizes = [400, 300, 200, 100]
    x = np.vstack([rng.normal(m, 0.5, (n, 24)) for m, n in zip(means, sizes, strict=True)])
    scaled = spark.createDataFrame(x.tolist(), ", ".join(f"`{f}` double" for f in queries.FEATURES)).repartition(3)
    monkeypatch.setattr(queries, "prepared", lambda spark, sf_dir: SimpleNamespace(scaled=scaled))
    monkeypatch.setattr(queries, "given_centers", lambda spark, sf_dir: [means[:2].mean(0).tolist(), *[(means[i] + d).tolist() for i, d in ((2, -0.1), (2, 0.1), (3, 0.0))]])
    rows = queries.train_kmeans(spark, "own rows").collect()
    found = np.zeros((4, 24))
    for r in rows:
        found[r["cluster"], r["ordinal"]] = r["value"]
    assert {(r["cluster"], r["size"]) for r in rows} == set(enumerate(sizes))
    at = np.cumsum([0, *sizes])
    assert found == pytest.approx(np.array([x[a:b].mean(0) for a, b in zip(at[:-1], at[1:], strict=True)]), abs=1e-5)
