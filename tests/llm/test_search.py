"""Nearest neighbours and top inner products against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowprofile.llm import ann_tree, topk_bits


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "c") for i, v in rows], "vec_id long, embedding array<double>, id string")


def odd_rows():
    return [
        (901, None), (902, []), (903, [0.0] * 6), (904, [1.0, None, 2.0, 0, 0, 0]), (905, [float("nan")] + [1.0] * 5), (906, [float("inf")] + [1.0] * 5), (None, [1.0] * 6),
        (907, [1.0, 2.0]), (908, [0.5] * 6), (908, [0.25] * 6),
    ]


def usable(rows, nonzero):
    out = sorted(
        ((i, list(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and (any(v) or not nonzero)), key=lambda r: r[0]
    )
    wide = max((len(v) for _, v in out), default=0)
    return np.array([i for i, _ in out]), np.array([np.pad(np.array(v, float), (0, wide - len(v))) for _, v in out])


def clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims)) * 3
    rows = centres[rng.integers(12, size=n)] + rng.normal(size=(n, dims))
    rows[n // 2 : n // 2 + n // 3] = rows[0]  # copies of one vector
    return rows


def test_tree_finds_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann_tree, "CHUNK_ROWS", 200)
    monkeypatch.setattr(ann_tree, "CHUNK_QUERIES", 3)
    rows = [*enumerate(clustered(3000, 16, 1))]
    got = ann_tree.nearest_neighbours(table(spark, rows), F.col("id") % 100 == 0, leaf_rows=64).collect()
    ids, vectors = usable(rows, True)
    hits = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        assert all(r.score == pytest.approx(d[r.vec_id], abs=0) or r.score == d[r.vec_id] for r in own)
        hits += len({r.vec_id for r in own} & set(best.tolist()))
    assert hits / (10 * 30) >= 0.9


def test_small_tables_are_searched_whole(spark):
    rows = [(i, v) for i, v in enumerate(clustered(9, 6, 2))] + odd_rows()
    got = ann_tree.nearest_neighbours(table(spark, rows), F.col("id") >= 0, k=30).collect()
    ids, vectors = usable(rows, True)
    assert sorted(map(tuple, got)) == sorted(
        (int(ids[q]), rank, int(ids[i]), float(d[i]))
        for q in range(len(ids)) for d in [np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))]
        for rank, i in enumerate([i for i in np.lexsort((ids, d)) if i != q], 1)
    )


def test_best_bins_visits_every_leaf_nearest_first():
    rows = clustered(2000, 8, 3)
    tree = ann_tree.fit_tree(rows, 40)
    visited = list(tree.best_bins(rows[5]))
    assert sorted(leaf for leaf, _ in visited) == list(range(tree.leaves))
    assert visited[0][1] == min(d for _, d in visited[:1])
    leaf, off = tree.descend(rows)
    assert off == pytest.approx([np.sqrt(((r - tree.centres[list(tree.leaf).index(x)]) ** 2).sum()) for r, x in zip(rows, leaf)])


@pytest.mark.parametrize("search", [ann_tree.nearest_neighbours, topk_bits.top_inner_products])
def test_empty_tables(spark, search):
    assert search(table(spark, []), F.col("id") % 2 == 0).count() == 0
    assert search(table(spark, [(1, [1.0])]), F.col("id") == 1).count() == 0
    assert search(table(spark, odd_rows()[:1] + odd_rows()[6:7]), F.lit(True)).count() == 0


def best_products(rows, is_query, k, scale=64):
    ids, vectors = usable(rows, False)
    q = np.floor(scale * vectors).astype(object)
    out = []
    for i in range(len(ids)):
        if is_query(ids[i]):
            scores = [int((q[i] * q[j]).sum()) for j in range(len(ids))]
            order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-scores[j], ids[j]))[:k]
            out += [(int(ids[i]), rank, int(ids[j]), scores[j]) for rank, j in enumerate(order, 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(8192, 512), (70, 9)])
def test_bit_slices_give_the_exact_top(spark, sizes):
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate(np.round(rng.normal(size=(400, 6)), 1))] + [(500 + i, [0.5, -0.5, 0, 1, 0, 0]) for i in range(90)] + odd_rows()
    got = topk_bits.top_inner_products(table(spark, rows), F.col("id") % 20 == 0, block_rows=sizes[0], chunk_queries=sizes[1]).collect()
    assert sorted(map(tuple, got)) == best_products(rows, lambda i: i % 20 == 0, 20)


@pytest.mark.parametrize("seed", range(6))
def test_block_scores_equal_products(seed):
    rng = np.random.default_rng(seed)
    rows = rng.integers(-(10**seed), 10**seed + 1, size=(rng.integers(1, 300), 5))
    block = topk_bits.BitSlicedBlock(np.arange(len(rows)) * 3, rows)
    for q in [*rng.integers(-50, 50, size=(5, 5)), np.zeros(5, dtype=np.int64)]:
        slices, constant = block.scores(q)
        values = [constant + sum(int(p[i // 64] >> np.uint64(i % 64) & np.uint64(1)) << n for n, p in enumerate(slices)) for i in range(len(rows))]
        assert values == (rows @ q).tolist()


def test_components_of_any_size_are_exact(spark):
    rows = [(0, [0.0, 1 / 64, -1 / 64]), (1, [1e300, 9e15, 1.0]), (2, [-1e300, 4e7, -3e12]), (3, [5.0, 2.0**60, 2.0**60 - 2**8]), (4, [1e-300, -1e-300, 0.5])]
    got = topk_bits.top_inner_products(table(spark, rows), F.col("id") == 0).collect()
    q = {i: [int(x) * 64 if abs(x) > 1e15 else int(np.floor(64 * x)) for x in v] for i, v in rows}
    assert sorted((r.vec_id, r.score) for r in got) == [(i, sum(a * b for a, b in zip(q[0], q[i]))) for i in (1, 2, 3, 4)]


@pytest.mark.parametrize("sign", [1, -1])
def test_scores_beyond_64_bits_are_errors(spark, sign):
    rows = [(7, [1e10, 0.0]), (20, [sign * 1e10, 0.0])]
    with pytest.raises(Exception, match="does not fit 64 bits"):
        topk_bits.top_inner_products(table(spark, rows), F.col("id") == 7).collect()
    # Scores that are too low and not among the best don't matter.
    assert topk_bits.top_inner_products(table(spark, [(7, [1e10, 0.0]), (20, [-1e10, 0.0]), (21, [0.0, 1.0])]), F.col("id") == 7, k=1).first()["vec_id"] == 21


def test_every_row_of_a_repeated_id_takes_part(spark):
    rows = [(2, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [5.0, 0.0]), (2, [0.5, 0.0])]
    got = topk_bits.top_inner_products(table(spark, rows), F.col("id") == 2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted([(2, 1, 1, 20480), (2, 2, 1, 4096), (2, 3, 2, 2048), (2, 1, 1, 10240), (2, 2, 1, 2048), (2, 3, 2, 2048)])
    near = ann_tree.nearest_neighbours(table(spark, rows), F.col("id") == 1).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in near) == sorted(
        [(1, 1, 2, 1.0), (1, 2, 2, 1.25**0.5), (1, 3, 1, 17**0.5), (1, 1, 2, 4.0), (1, 2, 1, 17**0.5), (1, 3, 2, 4.5)])


def test_distances_of_any_finite_size(spark):
    rows = [(1, [1e200, 0.0]), (2, [-1e200, 0.0]), (3, [1e-200, 0.0]), (4, [0.0, 3e-200]), (5, [1.0, 1.0]), (6, [1.7e308, 0.0]), (7, [-1.7e308, 0.0])] + [(10 + i, [1.0, i]) for i in range(40)]
    got = ann_tree.nearest_neighbours(table(spark, rows), F.lit(True), k=60, leaf_rows=8).collect()
    assert {(r.query_id, r.vec_id): r.score for r in got if r.query_id < 8 and r.vec_id < 8} == {
        (i, j): (pytest.approx(np.hypot(*(np.array(v) - np.array(w))), rel=1e-12) if {i, j} != {6, 7} else np.inf) for i, v in rows[:7] for j, w in rows[:7] if i != j
    }


def test_vectors_are_written_once_per_query_and_few_reach_the_driver(spark, monkeypatch):
    """A query that visits many leaves is one row of the visits, and tasks name the sample by ids before any vector is read."""
    written = []
    monkeypatch.setattr(ann_tree, "materialize", lambda df, name="table", keep=ann_tree.materialize: written.append((name, keep(df, name))) or written[-1][1])
    rows = [*enumerate(clustered(2000, 8, 5))]
    got = ann_tree.nearest_neighbours(table(spark, rows).repartition(4), F.col("id") % 20 == 0, leaf_rows=16, sample=500).collect()
    assert len(got) == 100 * 10
    visits = [df for name, df in written if name == "visits"]
    assert len(visits) == 2 and all(df.count() <= 100 for df in visits)
    assert max(df.selectExpr("max(size(leaves))").first()[0] for df in visits) > 1

    frame = table(spark, rows).selectExpr("vec_id as id", "embedding as v").repartition(4)
    for n in (500, 2000, 9000):
        low = ann_tree._lowest(frame, n)
        assert low["id"].tolist() == [r["id"] for r in frame.orderBy(F.xxhash64("id"), "id").limit(n).collect()]
    assert ann_tree._lowest(frame.limit(0), 5).empty
