"""Sampling, K-Means, evaluation, interpretation, scoring: invariants and brute-force checks on small tables."""

import numpy as np
import pandas as pd
import pytest

from flowprofile.config import PipelineConfig
from flowprofile.operators import evaluate, interpret, kmeans, prep, project, sampling, score
from flowprofile.plans import run
from flowprofile.sources.bundle import load_bundle, save_bundle
from flowprofile.streaming import score_stream, write_scores

BLOBS = [(0.0, 0.0, 0.0), (10.0, 0.0, 5.0), (0.0, 12.0, -4.0)]
NAMES = ["x", "y/s", "z z"]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    rows = [(*map(float, rng.normal(c, 0.5)), f"l{i}") for i, c in enumerate(BLOBS) for _ in range(100 * (i + 1))]
    return spark.createDataFrame(rows, "x double, `y/s` double, `z z` double, label string").repartition(6).cache()


def points(df, names=NAMES):
    return np.array([[r[n] for n in names] for r in df.collect()])


def test_allocation_ties_and_limits(spark):
    df = spark.createDataFrame([(i, s) for s, n in (("a", 3), ("b", 3), ("c", 4)) for i in range(n)] + [(9, None)], "i int, s string")
    got = {r["label"]: r["allocated"] for r in sampling.sample_allocation(df, 5, "s").collect()}
    assert got == {"a": 2, "b": 1, "c": 2}
    sample = sampling.stratified_sample(df, 5, "s")
    assert {r["s"]: r["count"] for r in sample.groupBy("s").count().collect()} == got
    assert sample.distinct().count() == 5
    with pytest.raises(ValueError):
        sampling.stratified_sample(df, 11, "s")
    with pytest.raises(ValueError):
        sampling.stratified_sample(df, 1, "absent")


def test_samples_are_exact_and_partition_independent(spark, monkeypatch):
    monkeypatch.setattr(sampling, "BORDER_ROWS", 50)
    monkeypatch.setattr(sampling, "BINS", 8)
    df = spark.range(20_000).selectExpr("id", "case when id % 3 > 0 then 'hot' else concat('s', id % 5) end as s")
    one = sampling.stratified_sample(df, 1_000, "s", key=["id"])
    two = sampling.stratified_sample(df.repartition(7), 1_000, "s", key=["id"])
    assert one.count() == 1_000 and sorted(one.collect()) == sorted(two.collect())
    plain = sampling.uniform_sample(df, 777, key=["id"])
    assert plain.count() == 777 and plain.select("id").distinct().count() == 777
    brute = {r["id"] for r in df.selectExpr("id", "xxhash64(42, id) as h").orderBy("h", "id").limit(777).collect()}
    assert {r["id"] for r in plain.collect()} == brute
    assert sampling.uniform_sample(df, 30_000).count() == 20_000


def test_samples_of_copies(spark, monkeypatch):
    monkeypatch.setattr(sampling, "BORDER_ROWS", 50)
    df = spark.range(3_000).selectExpr("case when id < 1000 then 0 else id end as v", "'s' as s")
    sample = sampling.stratified_sample(df, 900, "s")
    copies = sample.where("v = 0").count()
    assert sample.count() == 900 and 230 < copies < 370
    # A key that is the same for a third of the rows still gives an exact sample.
    assert sampling.uniform_sample(df, 900, key=["s"]).count() == 900
    assert sampling.uniform_sample(df, 900, key=["v"]).count() == 900


def test_kmeans_finds_blobs(spark, blobs):
    sweep = kmeans.train_multiple_k(blobs, NAMES, [2, 3, 4], n_init=4)
    model = sweep.models[3]
    assert model.sizes == (300, 200, 100)
    x = points(blobs)
    nearest = np.sqrt(((x[:, None, :] - np.array(model.centers)) ** 2).sum(2))
    assert model.inertia == pytest.approx((nearest.min(1) ** 2).sum(), rel=1e-9)
    inertias = [sweep.models[k].inertia for k in (2, 3, 4)]
    assert inertias == sorted(inertias, reverse=True)
    assert sweep.summary_table(spark).count() == 3 and sweep.centroid_table(spark).count() == 9
    again = kmeans.train_kmeans(blobs.repartition(3), NAMES, 3, n_init=4)
    assert again.inertia == pytest.approx(model.inertia, rel=1e-6)
    assert kmeans.pick_default_k([2, 3]) == 2 and kmeans.pick_default_k([2, 4]) == 4


def test_kmeans_input_checks(spark, blobs):
    with pytest.raises(ValueError):
        kmeans.train_kmeans(blobs, ["x"], 2)
    with pytest.raises(ValueError):
        kmeans.train_kmeans(blobs.limit(2), NAMES, 3)
    gaps = spark.createDataFrame([(1.0, None), (2.0, 1.0), (3.0, 1.0)], "a double, b double")
    with pytest.raises(ValueError, match="b"):
        kmeans.train_kmeans(gaps, ["a", "b"], 2)
    same = spark.createDataFrame([(1.0, 1.0)] * 5, "a double, b double")
    assert kmeans.train_kmeans(same, ["a", "b"], 2, n_init=1).inertia == pytest.approx(0.0, abs=1e-12)


def test_ties_go_to_the_lowest_cluster(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 4.0)], "a double, b double")
    got = kmeans.assign_clusters(df, ["a", "b"], [(1.0, 0.0), (-1.0, 0.0), (0.0, 4.0)]).orderBy("b").collect()
    assert [r["cluster"] for r in got] == [0, 2]


def brute_silhouette(x, c):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i in range(len(x)):
        same = (c == c[i]) & (np.arange(len(x)) != i)
        if not same.any():
            out.append(0.0)
            continue
        a, b = d[i, same].mean(), min(d[i, c == o].mean() for o in set(c) - {c[i]})
        out.append(0.0 if max(a, b) == 0 else (b - a) / max(a, b))
    return np.mean(out)


def test_metrics_match_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 3)) + rng.integers(0, 3, 600)[:, None] * 2.0
    c = np.clip(rng.integers(0, 4, 600), 0, 3)
    c[0] = 9  # a cluster with one member
    df = spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(x, c)], "a double, b double, d double, cluster int")
    names = ["a", "b", "d"]
    assert evaluate.silhouette(df, names).first()["silhouette"] == pytest.approx(brute_silhouette(x, c), abs=1e-9)
    ids = sorted(set(c))
    centers = np.array([x[c == i].mean(0) for i in ids])
    s = np.array([np.sqrt(((x[c == i] - m) ** 2).sum(1)).mean() for i, m in zip(ids, centers)])
    gap = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(2))
    np.fill_diagonal(gap, np.inf)
    assert evaluate.davies_bouldin(df, names).first()[0] == pytest.approx(((s[:, None] + s) / gap).max(1).mean())
    within = sum(((x[c == i] - m) ** 2).sum() for i, m in zip(ids, centers))
    between = sum((c == i).sum() * ((m - x.mean(0)) ** 2).sum() for i, m in zip(ids, centers))
    assert evaluate.calinski_harabasz(df, names).first()[0] == pytest.approx(between * (600 - len(ids)) / (within * (len(ids) - 1)))
    lone = df.withColumn("cluster", df["cluster"] * 0)
    assert evaluate.davies_bouldin(lone, names).first()[0] is None and evaluate.silhouette(lone, names).first()["silhouette"] is None


def test_choosing_k(spark):
    metrics = spark.createDataFrame(
        [(2, float("nan"), 1.0, 5.0, 9.0), (3, 0.5, 2.0, 7.0, 8.0), (4, 0.5, 0.5, 7.0, 7.0)], "k int, silhouette double, davies_bouldin double, calinski_harabasz double, inertia double")
    assert evaluate.best_k(metrics).first()["k"] == 3
    assert {r["metric"]: r["k"] for r in evaluate.metric_winners(metrics).collect()} == {"silhouette": 3, "calinski_harabasz": 3, "davies_bouldin": 4}
    assert [r["k"] for r in evaluate.elbow_series(metrics).collect()] == [2, 3, 4]


def test_pca_matches_svd(spark, blobs):
    model = project.fit_pca(blobs, NAMES)
    x = points(blobs)
    centred = x - x.mean(0)
    _, singular, vectors = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(model.explained, (singular ** 2 / (singular ** 2).sum())[:2])
    for got, want in zip(model.components, vectors):
        assert abs(np.dot(got, want)) == pytest.approx(1.0)
    projected = project.pca_project(blobs, model).selectExpr("avg(PC1) as m", "var_samp(PC1) as v").first()
    assert projected["m"] == pytest.approx(0.0, abs=1e-9) and projected["v"] == pytest.approx(singular[0] ** 2 / (len(x) - 1))
    assert project.pca_scatter(blobs.withColumn("cluster", blobs["x"].cast("int")), model, n=50).count() == 50


def test_flags_need_both_reasons_for_high(spark):
    rows = [(c, 100.0 if c == 5 else 1.0, float(c)) for c in range(6) for _ in range(1 if c == 5 else 40)]
    df = spark.createDataFrame(rows, "cluster int, spike double, ramp double")
    summary, sizes = interpret.cluster_summary(df, ["spike", "ramp"]), interpret.cluster_distribution(df)
    flags = {r["cluster"]: r for r in interpret.anomaly_flags(summary, sizes).collect()}
    assert set(flags) == {5} and flags[5]["severity"] == "HIGH" and flags[5]["deviating_features"] == ["spike"]
    five = df.where("cluster > 0")
    calm = interpret.anomaly_flags(interpret.cluster_summary(five, ["spike", "ramp"]), interpret.cluster_distribution(five)).collect()
    assert [(r["cluster"], r["severity"], r["n_deviating"]) for r in calm] == [(5, "MEDIUM", 0)]
    flat = interpret.profile_zscores(interpret.cluster_summary(df.selectExpr("cluster", "1D as spike"), ["spike"])).collect()
    assert {r["z"] for r in flat} == {0.0}
    told = interpret.cluster_narrative(summary, sizes).collect()
    assert all(r["tags"] == [] for r in told) and {r["text"] for r in told} >= {"Cluster 0 (40 flows)."}


def test_whole_job_bundle_and_stream(spark, blobs, tmp_path):
    config = PipelineConfig(features=tuple(NAMES), label="label", ks=(2, 3), n_init=3)
    done = run(blobs, config, k=3)
    assert done.distribution.agg({"count": "sum"}).first()[0] == 600 and done.metrics().count() == 2
    crosstab = {r["cluster"]: (r["l0"], r["l1"], r["l2"]) for r in interpret.label_crosstab(done.assigned, "label").collect()}
    assert sorted(max(v) for v in crosstab.values()) == [100, 200, 300] and all(sum(v) == max(v) for v in crosstab.values())
    model = done.sweep.models[3]
    path = save_bundle(spark, str(tmp_path / "deep" / "bundle"), model, done.prepared.preprocessor, {"when": object})
    bundle = load_bundle(spark, path)
    assert bundle.model == model and bundle.preprocessor == done.prepared.preprocessor and "object" in bundle.metadata["when"]

    source = str(tmp_path / "flows")
    extra = spark.createDataFrame([(float("inf"), 1.0, 2.0, "bad")], blobs.schema)
    blobs.unionByName(extra).write.parquet(source)
    batch = score.score_flows(spark.read.parquet(source), bundle.preprocessor, bundle.model.centers, on_bad="route")
    stream = score_stream(spark.readStream.schema(blobs.schema).parquet(source), bundle.preprocessor, bundle.model.centers)
    written = spark.read.parquet(write_scores(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")))
    assert sorted(map(repr, batch.collect())) == sorted(map(repr, written.collect()))
    bad = written.where("label = 'bad'").first()
    assert bad["cluster"] is None and bad["reasons"] == ["missing or infinite: x"]
    with pytest.raises(ValueError):
        score.score_flows(spark.read.parquet(source), bundle.preprocessor, bundle.model.centers)
    ranks = score.distance_ranking(batch.limit(1), ["x"]).orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == [1, 2, 3] and [r["distance"] for r in ranks] == sorted(r["distance"] for r in ranks)


def test_transform_is_partition_independent(spark, blobs):
    a = prep.fit(blobs, NAMES)
    b = prep.fit(blobs.repartition(7), NAMES)
    for p, r in zip(a.parameters, b.parameters):
        assert (p.log, p.shift) == (r.log, r.shift) and p.center == pytest.approx(r.center) and p.scale == pytest.approx(r.scale)


def test_starts_come_from_all_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200_000, 3))
    x[:3] = [[900.0, 900.0, 0.0], [900.5, 900.0, 0.0], [900.0, 900.5, 0.0]]
    model = kmeans.train_kmeans(spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"])).repartition(5), ["a", "b", "c"], 2, n_init=2, max_iter=5)
    assert model.sizes == (199_997, 3)


def test_given_starts_and_empty_clusters(spark):
    df = spark.createDataFrame([(float(i), 0.0) for i in range(10)] + [(100.0, 0.0)], "x double, y double")
    model = kmeans.train_kmeans(df, ["x", "y"], 2, init={2: [[0.0, 0.0], [90.0, 0.0]]}, max_iter=3)
    assert model.sizes == (10, 1) and model.centers == ((4.5, 0.0), (100.0, 0.0))
    # The third start gets no row, and restarts at the farthest one.
    model = kmeans.train_kmeans(df, ["x", "y"], 3, init={3: [[4.0, 0.0], [5.0, 0.0], [500.0, 900.0]]}, max_iter=9)
    assert sorted(model.sizes)[0] == 1 and (100.0, 0.0) in model.centers
    with pytest.raises(ValueError, match="start centroids"):
        kmeans.train_kmeans(df, ["x", "y"], 2, init={2: [[0.0, 0.0]]})


def test_rows_without_a_cluster_take_no_part(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(40, 2)), rng.normal(size=(40, 2)) + 6])
    rows = [(float(a), float(b), int(i >= 40), None if i % 7 == 0 else int(i >= 40)) for i, (a, b) in enumerate(x)] + [(100.0, 100.0, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, whole int, part int")
    got = {r["clustering"]: r["silhouette"] for r in evaluate.silhouette(df, ["a", "b"], ["whole", "part"]).collect()}
    for name, column in (("whole", 2), ("part", 3)):
        known = df.where(f"{name} is not null")
        assert got[name] == pytest.approx(evaluate.silhouette(known, ["a", "b"], [name]).first()["silhouette"])
        assert evaluate.calinski_harabasz(df, ["a", "b"], name).first()[0] == pytest.approx(evaluate.calinski_harabasz(known, ["a", "b"], name).first()[0])
    assert evaluate.silhouette(df.where("whole is null"), ["a", "b"], ["whole"]).first()["silhouette"] is None


def test_each_pair_of_blocks_is_measured_once(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(9)
    x, c = rng.normal(size=(150, 3)), rng.integers(0, 3, 150)
    df = spark.createDataFrame([(*map(float, v), int(k)) for v, k in zip(x, c)], "a double, b double, d double, cluster int").repartition(2)
    gap = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    inner = np.array([gap[i, c == c[i]].sum() / ((c == c[i]).sum() - 1) for i in range(150)])
    outer = np.array([min(gap[i, c == k].mean() for k in range(3) if k != c[i]) for i in range(150)])
    assert evaluate.silhouette(df, ["a", "b", "d"]).first()["silhouette"] == pytest.approx(((outer - inner) / np.maximum(inner, outer)).mean())


def test_all_models_label_in_one_pass(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (0.5, 0.5), (None, 1.0)], "a double, b double")
    got = evaluate.with_labels(df, {"x": np.array([[0.0, 0.0], [1.0, 1.0]]), "y": np.array([[5.0, 5.0]])}).collect()
    assert sorted((str(r["a"]), r["x"], r["y"]) for r in got) == [("0.0", 0, 0), ("0.5", 0, 0), ("1.0", 1, 0), ("None", None, None)]
