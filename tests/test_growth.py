"""What keeps the work per row and per task bounded on larger tables, and that results do not depend on it."""

from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from flowprofile.catalog import queries
from flowprofile.catalog.fixtures import rounded, rounding
from flowprofile.config import PipelineConfig
from flowprofile.functions import quantiles
from flowprofile.functions.columns import short_methods
from flowprofile.operators import distinct, kmeans, prep, profile

LIMIT = "spark.sql.codegen.hugeMethodLimit"


def test_queries_keep_generated_methods_compilable(spark):
    spark.conf.unset(LIMIT)
    queries.queries()["inf_to_null"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get(LIMIT) == "8000"
    spark.conf.set(LIMIT, "9000")
    short_methods(spark)
    assert spark.conf.get(LIMIT) == "9000"
    spark.conf.unset(LIMIT)


def test_rounding_without_decimal_text_is_the_same(spark):
    r = np.random.default_rng(5)
    values = [0.0, -0.0, float("inf"), float("-inf"), float("nan"), 1e4, -1e4, 1e8, -1e8, 2.0 ** 53, 1.2345678901234567e17, 5e-324, 1e308]
    for size, offset, step in ((1e4, 31e-9, 1e-6), (1e8, 31e-6, 1e-3), (1e14, 31e-3, 1.0)):
        v = np.concatenate([r.uniform(-size, size, 3000), r.integers(-10**6, 10**6, 2000) * (size / 1e6)])
        ties = (np.floor(v[:3000] / step) + 0.5) * step - offset
        values += [*v.tolist(), *ties.tolist(), *np.nextafter(ties, np.inf).tolist(), *np.nextafter(ties, -np.inf).tolist(), *(ties + step * 1e-3).tolist()]
    values += (10.0 ** r.uniform(-12, 20, 5000)).tolist()
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").select(F.expr(f"{rounding('v')} as a"), F.expr(f"{rounded('v')} as b"))
    assert df.where("not (a <=> b)").collect() == []


def test_comparable_reads_as_rounding(spark):
    df = spark.createDataFrame([(1.0000005, "x", 1), (float("nan"), None, None), (-0.0, "y", 3)], "`a b` double, t string, n bigint")
    got = [tuple(row) for row in queries.comparable(df).collect()]
    assert got == [(1.000001, "x", 1), (None, None, None), (0.0, "y", 3)]


def _with_copies(spark):
    rows = [(float(i), i % 7, "a" if i % 3 else None, f"id{i:05d}") for i in range(3000)]
    rows += [(float(i), i % 7, "a" if i % 3 else None, f"id{i:05d}-copy") for i in range(0, 3000, 50)]
    rows += [(0.0, 9, "z", "p"), (-0.0, 9, "z", "o"), (float("nan"), 9, "z", "n"), (float("nan"), 9, "z", "m"), (-0.0, 10, "z", "l"), (None, 9, "z", "k"), (None, 9, "z", "j")]
    rows += [(5.5, 5, "hot", f"h{i:04d}") for i in range(2000)]
    return spark.createDataFrame(rows, "x double, n int, t string, id string").repartition(7)


def test_only_rows_with_copies_are_shuffled(spark):
    df = _with_copies(spark)
    singles, repeated = distinct.split_singles(df, ["x", "n", "t"])
    assert singles.count() + repeated.count() == df.count()
    assert singles.count() == 3000 - 60 + 1
    assert repeated.where("x = 5.5 and n = 5 and t = 'hot'").count() == 2000
    got = prep.deduplicate(df, ["x", "n"], "t")
    assert got.count() == 3000 + 4 + 1
    kept = {r["id"] for r in got.collect()}
    assert {"o", "m", "l", "j", "h0000", "id00050", "id00051"} <= kept and not kept & {"p", "n", "k", "h0001", "id00050-copy"}
    assert [str(r["x"]) for r in got.where("n = 10").collect()] == ["0.0"]


def test_copies_are_found_whatever_the_map(spark, monkeypatch):
    df = _with_copies(spark)
    want = sorted(map(str, prep.deduplicate(df, ["x", "n"], "t").collect()))
    monkeypatch.setattr(distinct, "MAP_BITS", 13)
    monkeypatch.setattr(distinct, "HELD_DIGESTS", 64)
    assert sorted(map(str, prep.deduplicate(df, ["x", "n"], "t").collect())) == want
    assert prep.deduplicate(df.limit(0), ["x", "n"], "t").count() == 0
    assert prep.deduplicate(df.drop("id")).count() == 3005


def test_training_reads_partitions_as_they_are(spark, monkeypatch):
    """Joined partitions grow with the table, and unevenly."""
    rows = [(float(i % 5), float(i % 3)) for i in range(4000)]
    seen = []
    original = kmeans._assign_and_sum

    def noted(blocks, d, models):
        seen.append(blocks.rdd.getNumPartitions())
        return original(blocks, d, models)

    monkeypatch.setattr(kmeans, "_assign_and_sum", noted)
    start = [[0.0, 0.0], [4.0, 2.0]]
    parts = 2 * spark.sparkContext.defaultParallelism
    model = kmeans.train_kmeans(spark.createDataFrame(rows, "x double, y double").repartition(parts), ["x", "y"], 2, init={2: start})
    assert set(seen) == {parts} and sum(model.sizes) == 4000


def test_only_unusable_rows_are_told_apart_by_element(spark):
    fitted = prep.FittedPreprocessor((prep.FeatureParameters("a", 0, True, 0.0, 1.0, 2.0), prep.FeatureParameters("b", 1, False, 0.0, 0.0, 1.0)))
    rows = [(1, 0.0, 2.0), (2, -3.0, 2.0), (3, None, float("inf")), (4, float("nan"), 1.0), (5, 1e300, -1e300), (6, -1.0, 0.0)]
    checked = fitted.checked_array(spark.createDataFrame(rows, "id int, a double, b double"))
    got = {r["id"]: (r["s"], r["reasons"]) for r in checked.selectExpr("_row.id", "_scaled as s", "reasons").collect()}
    assert got[1] == ([-0.5, 2.0], []) and got[5][1] == [] and got[5][0][1] == -1e300
    assert got[2] == ([None, 2.0], ["not finite after preprocessing: a"]) and got[6] == ([None, 0.0], ["not finite after preprocessing: a"])
    assert got[3] == ([None, None], ["missing or infinite: a", "missing or infinite: b"]) and got[4] == ([None, 1.0], ["missing or infinite: a"])
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert "_fine" in plan


def test_training_steps_against_brute_force(spark):
    r = np.random.default_rng(3)
    x = np.vstack([r.normal(size=(900, 4)), [[1.0, 0, 0, 0], [0.0, 0, 0, 0], [0.5, 0, 0, 0]]])
    blocks = kmeans._pack(spark.createDataFrame(x.tolist(), "a double, b double, c double, d double").repartition(3), 4)
    square = lambda c: ((x[:, None] - c[None]) ** 2).sum(-1)
    # A row half-way between two centroids belongs to the first; so do all rows where both are the same.
    models = [np.array([[1.0, 0, 0, 0], [0.0, 0, 0, 0]]), np.array([[2.0, 1, 0, 0]] * 2), x[:3], x[3:6], x[:7]]
    counts, sums, errors = kmeans._assign_and_sum(blocks, 4, models)
    for m, n, s, e in zip(models, counts, sums, errors, strict=True):
        own = square(m).argmin(1)
        assert n.tolist() == np.bincount(own, minlength=len(m)).tolist()
        assert np.allclose(s, [x[own == c].sum(0) for c in range(len(m))]) and np.isclose(e, square(m).min(1).sum())
    seeds, owner, salts = x[:6].reshape(2, 3, 4), np.array([0, 0, 0, 1, 1]), np.array([11, 22, 33, 44, 55], np.uint64) << np.uint64(40)
    drawn = kmeans._drawn(blocks, 4, seeds, owner, salts)
    for row, slot, salt in zip(drawn, owner, salts, strict=True):
        u = (kmeans._mix(kmeans._row_digests(x) ^ salt) >> np.uint64(11)).astype(float) * 2.0 ** -53 + 2.0 ** -54
        assert row.tolist() == x[(-np.log(u) / np.maximum(square(seeds[slot]).min(1), 1e-300)).argmin()].tolist()
    errors = kmeans._trial_errors(blocks, 4, seeds, owner, np.array(drawn))
    assert np.allclose(errors, [square(np.vstack([seeds[s], d])).min(1).sum() for s, d in zip(owner, drawn, strict=True)])
    far = kmeans._farthest_rows(blocks, 4, [x[:2], x[5:9]])
    assert [f.tolist() for f in far] == [x[square(m).min(1).argmax()].tolist() for m in (x[:2], x[5:9])]


def test_training_rows_travel_in_small_batches(spark):
    """A partition that crosses to Python as one batch keeps a core waiting."""
    names = [f"f{i}" for i in range(24)]
    blocks = kmeans._pack(spark.range(0, 300_000, 1, 1).selectExpr(*[f"id + {i}D as {n}" for i, n in enumerate(names)]), 24)

    def sizes(batches):
        for batch in batches:
            yield batch.from_arrays([[batch.nbytes]], names=["bytes"])

    seen = [r["bytes"] for r in blocks.mapInArrow(sizes, "bytes long").collect()]
    assert sum(seen) >= 300_000 * 24 * 8 and max(seen) < 1 << 24


def test_training_spreads_rows_that_lie_in_one_partition(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(0, 8_000 * cores, 1, 1).selectExpr("id % 7 + 0D as x", "id % 5 + 0D as y", "id + 0D as z")
    rows = df.unionByName(df.limit(10))
    blocks = kmeans._spread(rows, 3, rows.count())
    held = [len(b) for b in blocks.rdd.glom().map(lambda p: [0] * len(p)).collect()]
    assert len(held) == cores and max(held) < 3 * sum(held) / cores
    start = [[0.0, 0.0, 0.0], [6.0, 4.0, 1000.0]]
    model = kmeans.train_kmeans(rows, ["x", "y", "z"], 2, init={2: start}, max_iter=3)
    assert sum(model.sizes) == 8_000 * cores + 10


def test_distinct_values_travel_in_blocks(spark, monkeypatch):
    big = 2 ** 53
    rows = [(i % 4000 * 0.5, -0.0 if i % 2 else 0.0, big + i % 3, i, None, float("inf") if i % 5 else None) for i in range(20_000)]
    df = spark.createDataFrame(rows, "x double, `zero a` double, big bigint, id bigint, none bigint, inf double").repartition(5)
    want = {"x": 4000, "zero a": 1, "big": 3, "id": 20_000, "inf": 1}
    assert {r["feature"]: r["n_unique"] for r in distinct.distinct_counts(df).collect()} == want
    monkeypatch.setattr(distinct, "HELD_VALUES", 1000)
    assert {r["feature"]: r["n_unique"] for r in distinct.distinct_counts(df).collect()} == want
    assert distinct.distinct_counts(df.limit(0)).count() == 0
    profiled = profile.column_profile(df)
    assert {r["feature"]: r["n_unique"] for r in profiled.collect()} == want | {"none": 0}
    # No row per value crosses to the next tasks.
    assert "words" in profiled._jdf.queryExecution().optimizedPlan().toString()


def test_inertia_meets_only_the_own_centroid(spark):
    """Not every centroid of every row, through Python."""
    rows = [(1.0, 2.0, 0), (3.0, 5.0, 1), (7.0, 7.0, None), (None, 1.0, None)]
    df = spark.createDataFrame(rows, "`a b` double, y double, cluster int")
    centers = [[0.0, 0.0], [3.0, 4.0]]
    found = kmeans.inertia(df, ["a b", "y"], centers)
    assert [r["inertia"] for r in found.collect()] == [6.0]
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert kmeans.inertia(df.where("cluster is null"), ["a b", "y"], centers).first()["inertia"] is None
    assert np.isnan(kmeans.inertia(df.withColumn("cluster", F.lit(1)), ["a b", "y"], centers).first()["inertia"])


def test_cleaned_table_is_written_without_large_dictionaries(spark):
    """Looking up measurements in a dictionary of 1 MB, until it is full, takes most of the time of writing them."""
    rows = 60_000
    df = spark.range(0, rows, 1, 1).selectExpr("id * 1.5D as a", "cast(id % 5 as double) as b")
    with prep.preprocess(df, PipelineConfig(features=("a", "b"), label="none")) as done:
        assert done.cleaned.selectExpr("count(*) as n", "sum(a) as a", "sum(b) as b").first() == (rows, 1.5 * rows * (rows - 1) / 2, 2.0 * rows)
        metas = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in done.cleaned.inputFiles()]
        groups = [m.row_group(g) for m in metas for g in range(m.num_row_groups)]
        big = max(groups, key=lambda g: g.num_rows)
        assert big.num_rows > (1 << 17) // 8
        sizes = {big.column(c).path_in_schema: big.column(c) for c in range(2)}
        assert "PLAIN" in sizes["a"].encodings and "PLAIN" not in sizes["b"].encodings


def test_quantile_bins_are_counted_in_batches(spark, monkeypatch):
    """No row per value of every column is made, and the quantiles are those of the sorted values."""
    r = np.random.default_rng(7)
    odd = r.choice([5e-324, -5e-324, 0.0, -0.0, 1e-310, -1e308, 1e308, float("inf"), float("-inf")], 3000)
    table = {"w a": r.normal(size=3000) * 10.0 ** r.integers(-300, 300, 3000), "b": np.where(r.random(3000) < 0.4, 0.0, r.normal(size=3000)), "c": np.full(3000, -3.0), "d": odd}
    rows = [tuple([None, float("nan")][i % 2] if i % 17 == 0 else float(v[i]) for v in table.values()) for i in range(3000)]
    df = spark.createDataFrame(rows, "`w a` double, b double, c double, d double").repartition(5)
    for held in (quantiles.HELD_BINS, 50):
        monkeypatch.setattr(quantiles, "HELD_BINS", held)
        found = quantiles.exact_quantiles(df, list(table), [0.0, 0.1, 0.25, 0.5, 0.9, 1.0])
        assert len(found) == 4 * 6
        for f in found:
            values = sorted(v[list(table).index(f["feature"])] for i, v in enumerate(rows) if i % 17)
            at = f["prob"] * (len(values) - 1)
            assert (f["lower"], f["upper"]) == (values[int(np.floor(at))], values[int(np.ceil(at))])
    assert "Generate" not in quantiles._counted_bins(df, list(table))._jdf.queryExecution().optimizedPlan().toString()
    assert quantiles.exact_quantiles(df.limit(0), ["b"], [0.5]) == []


def test_training_reads_its_table_for_packing_only(spark, monkeypatch):
    """Counts and variances come from the packed rows, not from further scans that scale every row again."""
    r = np.random.default_rng(8)
    x = r.normal(size=(3000, 3)) * [1.0, 1e3, 1e-3] + [5.0, 1e6, 0.0]
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double").repartition(6)
    total, filled, variance = kmeans._moments(kmeans._pack(df, 3), 3)
    assert total == 3000 and filled.tolist() == [3000] * 3 and np.allclose(variance, x.var(0), rtol=1e-12)
    gaps = spark.createDataFrame([(1.0, None), (2.0, 4.0), (float("nan"), 8.0)], "a double, b double")
    total, filled, variance = kmeans._moments(kmeans._pack(gaps, 2), 2)
    assert total == 3 and filled.tolist() == [2, 2] and variance.tolist() == [0.25, 4.0]
    assert kmeans._moments(kmeans._pack(gaps.limit(0), 2), 2)[0] == 0
    monkeypatch.setattr(kmeans, "per_feature", None, raising=False)
    model = kmeans.train_kmeans(df, ["a", "b", "c"], 2, init={2: x[:2].tolist()}, max_iter=3)
    assert sum(model.sizes) == 3000
    for bad, message in ((gaps, r"missing values in: \['a', 'b'\]"), (df.limit(1), "1 rows cannot form 2 clusters"), (df.limit(0), "0 rows cannot form 2 clusters")):
        with pytest.raises(ValueError, match=message):
            kmeans.train_kmeans(bad, bad.columns, 2, init={2: np.zeros((2, len(bad.columns))).tolist()})


def test_given_starts_take_the_mean_only_where_it_is_used(spark, monkeypatch):
    monkeypatch.setattr(queries, "given_centers", lambda spark, sf_dir: [[float(c)] for c in range(7)])
    monkeypatch.setattr(queries, "prepared", None)
    assert queries.given_starts(spark, "unread", 4) == [[0.0], [1.0], [2.0], [3.0]]
