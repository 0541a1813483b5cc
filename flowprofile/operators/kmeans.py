"""K-Means for a range of k with restarts, trained together.

All (k, restart) pairs that still move share one scan per iteration: each task folds its batches into per-centroid counts,
sums and squared errors, Spark adds them up, and only the new centroids reach the driver. The sweep k = 2..8 with ten
restarts therefore costs as many jobs as its slowest member has iterations, instead of seventy separate trainings.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowprofile.config import DEFAULT_K, K_RANGE, MAX_ITER, N_INIT, SEED, TOLERANCE
from flowprofile.functions.columns import as_doubles, number, q, require_columns
from flowprofile.operators.gram import batch_matrix

# Bytes of packed rows in a partition at which smaller ones are no longer joined: a task of an iteration reads one partition and sends one row per centroid.
PARTITION_BYTES = 1 << 27
# A scan that takes this many times as long as one of even partitions is worth a shuffle of the packed rows: a sweep scans them more than a hundred times.
UNEVEN = 1.5
# Rows handled at once inside a task, at least and at most: the matrices of a group of models stay in the processor's cache.
BLOCK_ROWS, MOST_ROWS = 256, 1_024
# Products of matrices up to this many multiplications are made by the calling thread; beyond, the BLAS library starts threads, which only hinder each other where every core has a task.
CALLER_PRODUCTS = 1 << 18
# Rows of which counts and variances are taken at once.
MOMENT_ROWS = 4_096
# 10,000 blocks, Spark's default number of records per Arrow batch, stay far below the 2 GB limit of a binary column.
BLOCK_BYTES = 1_536
CENTROID_SCHEMA = "k int, cluster int, size bigint, center array<double>"
SUMMARY_SCHEMA = "k int, inertia double, n_iter int"


@dataclass(frozen=True)
class KMeansModel:
    """Centroids of one k, largest cluster first (ties in lexicographic order of the centroid)."""

    k: int
    features: tuple[str, ...]
    centers: tuple[tuple[float, ...], ...]
    sizes: tuple[int, ...]
    inertia: float
    n_iter: int


@dataclass(frozen=True)
class Sweep:
    """The best restart for every k."""

    models: dict[int, KMeansModel]

    def centroid_table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, c, size, list(center)) for k, m in self.models.items() for c, (size, center) in enumerate(zip(m.sizes, m.centers, strict=True))]
        return spark.createDataFrame(rows, CENTROID_SCHEMA)

    def summary_table(self, spark: SparkSession) -> DataFrame:
        """(k, inertia, n_iter) by k."""
        return spark.createDataFrame([(k, m.inertia, m.n_iter) for k, m in sorted(self.models.items())], SUMMARY_SCHEMA)


def train_kmeans(df: DataFrame, features: Sequence[str], k: int = DEFAULT_K, **options) -> KMeansModel:
    """One k; same options as `train_multiple_k`."""
    return train_multiple_k(df, features, [k], **options).models[k]


def train_multiple_k(
    df: DataFrame, features: Sequence[str], ks: Sequence[int] = K_RANGE, n_init: int = N_INIT,
    max_iter: int = MAX_ITER, tolerance: float = TOLERANCE, seed: int = SEED, init: Mapping[int, Sequence[Sequence[float]]] | None = None,
) -> Sweep:
    """k-means++ starts and Lloyd iterations on all rows, lowest inertia per k.

    `init` gives start centroids by k instead; such a k is trained once. The tolerance is relative to the mean variance of the features. `df` is scanned
    once per iteration and kept in memory (spilling to disk) meanwhile; hand in a written table. Rows must have no missing feature.
    """
    names = list(features)
    if len(names) < 2:
        raise ValueError("clustering needs at least two features")
    if not ks or min(ks) < 1:
        raise ValueError("k must be positive")
    given = {int(k): np.array(c, dtype=np.float64) for k, c in (init or {}).items()}
    for k, start in given.items():
        if start.shape != (k, len(names)):
            raise ValueError(f"start centroids for k = {k} must be {k} rows of {len(names)} values")
    require_columns(df, names)
    # Packing makes a missing value NaN.
    rows = df.selectExpr(*[f"cast({q(n)} as double) as {q(n)}" for n in names])
    d = len(names)
    blocks = _spread(rows, d).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        total, filled, variance = _moments(blocks, d)
        gaps = [f for f, n in zip(names, filled, strict=True) if n != total]
        if gaps:
            raise ValueError(f"missing values in: {gaps}")
        if total < max(ks):
            raise ValueError(f"{total} rows cannot form {max(ks)} clusters")
        stop_at = tolerance * float(np.mean(variance))
        slots = [(k, r) for k in sorted(set(ks)) for r in range(1 if k in given else n_init)]
        centers = _starts(blocks, d, [s for s in slots if s[0] not in given], seed) | {(k, 0): given[k] for k, _ in slots if k in given}

        n_iter = dict.fromkeys(slots, max_iter)
        moving = list(slots)
        for iteration in range(1, max_iter + 1):
            counts, sums, _ = _assign_and_sum(blocks, d, [centers[s] for s in moving])
            updated = [np.where(n[:, None] > 0, total_sum / np.maximum(n, 1)[:, None], centers[s]) for s, n, total_sum in zip(moving, counts, sums, strict=True)]
            _refill(blocks, d, updated, counts)
            still = []
            for slot, new in zip(moving, updated, strict=True):
                shift = float(((new - centers[slot]) ** 2).sum())
                centers[slot] = new
                if shift <= stop_at:
                    n_iter[slot] = iteration
                else:
                    still.append(slot)
            moving = still
            if not moving:
                break
        counts, _, errors = _assign_and_sum(blocks, d, [centers[s] for s in slots])
    finally:
        blocks.unpersist()

    models = {}
    for k in sorted(set(ks)):
        best = min((i for i, s in enumerate(slots) if s[0] == k), key=lambda i: (errors[i], slots[i][1]))
        order = sorted(range(k), key=lambda c: (-counts[best][c], tuple(centers[slots[best]][c])))
        models[k] = KMeansModel(
            k, tuple(names),
            tuple(tuple(float(v) for v in centers[slots[best]][c]) for c in order),
            tuple(int(counts[best][c]) for c in order),
            float(errors[best]), n_iter[slots[best]])
    return Sweep(models)


def _refill(blocks: DataFrame, d: int, models: Sequence[np.ndarray], counts: Sequence[np.ndarray]) -> None:
    """An empty cluster restarts at the row farthest from every other centroid; one scan for one empty cluster of each model."""
    empty = [list(np.flatnonzero(n == 0)) for n in counts]
    while any(empty):
        at = [i for i, e in enumerate(empty) if e]
        others = [np.delete(models[i], empty[i], axis=0) for i in at]
        for i, row in zip(at, _farthest_rows(blocks, d, others), strict=True):
            models[i][empty[i].pop(0)] = row


def _starts(blocks: DataFrame, d: int, slots: Sequence[tuple[int, int]], seed: int) -> dict[tuple[int, int], np.ndarray]:
    """k-means++ seeds for every (k, restart), drawn from all rows.

    A row is drawn with a probability in proportion to its squared distance to the seeds chosen so far: it has the key -ln(u) / distance,
    where u comes from a hash of the row's values, the slot and the step, and the row of the smallest key is the one drawn. Every step draws a few
    trial rows in one scan for all slots, and keeps the one with the lowest total error, which another scan measures. Which rows
    share a partition does not matter. Copies of a row share a key, so they count once.
    """
    chosen = {s: np.empty((0, d)) for s in slots}
    for step in range(max((k for k, _ in slots), default=0)):
        open_ = [s for s in slots if s[0] > step]
        trials = [1 if step == 0 else 2 + int(np.log(k)) for k, _ in open_]
        seeds = np.array([chosen[s] for s in open_])
        # One entry per (slot, trial); the salt tells the draws apart.
        owner = np.repeat(np.arange(len(open_)), trials)
        salts = np.array([hash((seed, k, r, step, t)) & 0xFFFFFFFFFFFFFFFF for (k, r), n in zip(open_, trials, strict=True) for t in range(n)], dtype=np.uint64)
        drawn = _drawn(blocks, d, seeds, owner, salts)
        if step == 0:
            best = dict(zip(open_, drawn, strict=True))
        else:
            errors = _trial_errors(blocks, d, seeds, owner, np.array(drawn))
            best = {s: drawn[min(np.flatnonzero(owner == i), key=lambda e: (errors[e], e))] for i, s in enumerate(open_)}
        for s in open_:
            chosen[s] = np.vstack([chosen[s], best[s]])
    return chosen


def _products(centers: np.ndarray) -> np.ndarray:
    """What a centroid is multiplied with a row and a one by, to give their squared distance less the row's own square."""
    return np.concatenate([-2.0 * centers, (centers ** 2).sum(-1, keepdims=True)], -1)


def _with_ones(batches: Iterator[pa.RecordBatch], d: int, centers: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows followed by a one, the same turned, squares of the rows), as many rows at a time as suit that many centroids."""
    step = min(MOST_ROWS, max(BLOCK_ROWS, (1 << 16) // max(centers, 1)))
    for batch in batches:
        whole = _unpack(batch.column(0), d)
        for at in range(0, len(whole), step):
            x = whole[at:at + step]
            y = np.ones((len(x), d + 1))
            y[:, :d] = x
            yield y, np.ascontiguousarray(y.T), (x ** 2).sum(1)


def _least(left: np.ndarray, turned: np.ndarray, square: np.ndarray) -> np.ndarray:
    """Squared distance of each row to the nearest seed of each slot: (slots, seeds, d + 1) of `_products` -> (slots, rows)."""
    slots, seeds, width = left.shape
    low = np.empty((slots, len(square)))
    many = max(1, CALLER_PRODUCTS // (seeds * width * len(square)))
    for a in range(0, slots, many):
        part = left[a:a + many]
        np.min((part.reshape(-1, width) @ turned).reshape(len(part), seeds, -1), axis=1, out=low[a:a + many])
    low += square
    return np.maximum(low, 0.0, out=low)


def _drawn(blocks: DataFrame, d: int, seeds: np.ndarray, owner: np.ndarray, salts: np.ndarray) -> list[np.ndarray]:
    """Per entry the row with the smallest -ln(u) / (squared distance to the seeds of the entry's slot); one scan."""
    shared = blocks.sparkSession.sparkContext.broadcast((seeds, owner, salts))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, owner, salts = shared.value
        left = _products(seeds)
        limit = np.full(len(salts), np.finfo(np.float64).max)
        best: list[tuple[float, tuple] | None] = [None] * len(salts)
        for y, turned, square in _with_ones(batches, d, len(salts)):
            x, digest = y[:, :d], _row_digests(y[:, :d])
            least = np.maximum(_least(left, turned, square), 1e-300) if seeds.shape[1] else np.ones((len(seeds), len(x)))
            u = (_mix(digest ^ salts[:, None]) >> np.uint64(11)).astype(np.float64)
            u *= 2.0 ** -53
            u += 2.0 ** -54
            # -ln(u) is 1 - u at least, so most rows are seen to lie above the smallest key so far without a logarithm.
            with np.errstate(over="ignore"):
                entries, places = np.nonzero(1.0 - u <= (limit * (1.0 + 1e-9))[:, None] * least[owner])
            keys = -np.log(u[entries, places]) / least[owner[entries], places]
            edges = np.searchsorted(entries, np.arange(len(salts) + 1))
            for i in np.flatnonzero(edges[1:] > edges[:-1]):
                mine = slice(edges[i], edges[i + 1])
                at = int(keys[mine].argmin())
                low, row = float(keys[mine][at]), tuple(x[places[mine][at]].tolist())
                if best[i] is None or (low, row) < best[i]:
                    best[i], limit[i] = (low, row), low
        found = [(i, *b) for i, b in enumerate(best) if b is not None]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.float64()), pa.array([list(f[2]) for f in found], pa.list_(pa.float64()))],
            names=["model", "key", "row"])

    found = _smallest(blocks, fold)
    shared.unpersist()
    return [found[i][1] for i in range(len(salts))]


def _smallest(blocks: DataFrame, fold) -> dict[int, tuple[float, np.ndarray]]:
    """Per model the smallest (key, row) that the tasks have found; one row per model reaches the driver."""
    rows = blocks.mapInArrow(fold, "model int, key double, row array<double>").groupBy("model").agg(F.min(F.struct("key", "row")).alias("b")).collect()
    return {r["model"]: (r["b"]["key"], np.array(r["b"]["row"])) for r in rows}


def _trial_errors(blocks: DataFrame, d: int, seeds: np.ndarray, owner: np.ndarray, trials: np.ndarray) -> list[float]:
    """Per entry the total squared error of its slot's seeds together with the trial row; one scan."""
    shared = blocks.sparkSession.sparkContext.broadcast((seeds, owner, trials))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, owner, trials = shared.value
        left, right = _products(seeds), _products(trials)[:, None]
        total = np.zeros(len(trials))
        for _, turned, square in _with_ones(batches, d, len(trials)):
            gap = _least(right, turned, square)
            total += np.minimum(gap, _least(left, turned, square)[owner], out=gap).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["entry", "error"])

    sums = {r["entry"]: r["e"] for r in blocks.mapInArrow(fold, "entry int, error double").groupBy("entry").agg(F.sum("error").alias("e")).collect()}
    shared.unpersist()
    return [sums[i] for i in range(len(trials))]


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _row_digests(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's values; 0.0 and -0.0 are the same value."""
    digest = np.zeros(len(x), dtype=np.uint64)
    for column in np.ascontiguousarray(x + 0.0).view(np.uint64).T:
        digest = _mix(digest * np.uint64(0x9E3779B97F4A7C15) + column)
    return digest


def _farthest_rows(blocks: DataFrame, d: int, models: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Per model the row farthest from all of its centroids; one scan."""
    shared = blocks.sparkSession.sparkContext.broadcast([np.asarray(m, dtype=np.float64) for m in models])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lefts = [_products(m)[None] for m in shared.value]
        best: list[tuple[float, tuple] | None] = [None] * len(lefts)
        for y, turned, square in _with_ones(batches, d, max(map(len, shared.value))):
            for i, left in enumerate(lefts):
                gap = _least(left, turned, square)[0]
                at = int(gap.argmax())
                if best[i] is None or -gap[at] <= best[i][0]:
                    found = (-float(gap[at]), tuple(y[at, :d].tolist()))
                    best[i] = found if best[i] is None else min(best[i], found)
        found = [(i, *b) for i, b in enumerate(best) if b is not None]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.float64()), pa.array([list(f[2]) for f in found], pa.list_(pa.float64()))],
            names=["model", "key", "row"])

    found = _smallest(blocks, fold)
    shared.unpersist()
    return [found[i][1] for i in range(len(models))]


def _spread(rows: DataFrame, d: int, total: int | None = None) -> DataFrame:
    """Packed rows in partitions that keep all cores busy: the ones they lie in, unless a scan would wait for the largest of these."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    # One row per partition reaches the driver.
    counts = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    total = sum(counts) if total is None else total
    packed = _pack(rows, d)
    if max(counts, default=0) * cores > UNEVEN * total:
        return packed.repartition(int(max(cores, -(-total * d * 8 * 4 // PARTITION_BYTES))), F.xxhash64("block"))
    # Joining may be uneven, so it begins only when partitions are several times too small.
    return packed.coalesce(int(4 * max(cores, -(-total * d * 8 // PARTITION_BYTES))))


def _moments(blocks: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, and per feature how many have a value and the population variance of these; one scan of the packed rows, which packs them if it is the first."""
    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of two parts, each (number, mean, sum of squared differences from it) per feature, those of both; means are joined first, so no large sums are subtracted."""
        n = a[0] + b[0]
        share = b[0] / np.maximum(n, 1)
        gap = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0)
        mean = np.where(a[0] > 0, a[1] + gap * share, b[1])
        return np.stack([n, mean, a[2] + b[2] + gap ** 2 * a[0] * share])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, all_ = 0, np.zeros((3, d))
        with np.errstate(invalid="ignore", over="ignore"):
            for batch in batches:
                x = _unpack(batch.column(0), d)
                for at in range(0, len(x), MOMENT_ROWS):
                    part = x[at:at + MOMENT_ROWS]
                    present = ~np.isnan(part)
                    n = present.sum(0).astype(np.float64)
                    mean = np.where(present, part, 0.0).sum(0) / np.maximum(n, 1)
                    gap = np.where(present, part - mean, 0.0)
                    rows, all_ = rows + len(part), join(all_, np.stack([n, mean, (gap * gap).sum(0)]))
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), *[pa.array([v.tolist()], pa.list_(pa.float64())) for v in all_]], names=["total", "n", "mean", "squares"])

    # One row per partition reaches the driver.
    found = blocks.mapInArrow(fold, "total bigint, n array<double>, mean array<double>, squares array<double>").collect()
    total, whole = 0, np.zeros((3, d))
    with np.errstate(invalid="ignore", over="ignore"):
        for r in found:
            total, whole = total + r["total"], join(whole, np.array([r["n"], r["mean"], r["squares"]], dtype=np.float64))
    return total, whole[0].astype(np.int64), whole[2] / np.maximum(whole[0], 1)


def _pack(rows: DataFrame, d: int) -> DataFrame:
    """Rows as binary blocks of float64 values: the iterations then read memory instead of converting columns each time."""
    height = max(1, BLOCK_BYTES // (8 * d))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.ascontiguousarray(batch_matrix(batch, d))
            cut = [x[at:at + height].tobytes() for at in range(0, len(x), height)]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary())], names=["block"])

    return rows.mapInArrow(pack, "block binary")


def _unpack(column: pa.Array, d: int) -> np.ndarray:
    """All blocks of a batch as one matrix, without copying: their bytes lie side by side."""
    _, ends, data = column.buffers()
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    edges = np.frombuffer(ends, width)[column.offset:column.offset + len(column) + 1]
    if not len(column) or edges[0] == edges[-1]:
        return np.empty((0, d))
    return np.frombuffer(data, np.float64, (edges[-1] - edges[0]) // 8, edges[0]).reshape(-1, d)


def _assign_and_sum(blocks: DataFrame, d: int, models: Sequence[np.ndarray]) -> tuple[list, list, list]:
    """Per model: rows, feature sums per cluster, and the total squared error; one scan for all models."""
    spark = blocks.sparkSession
    stacked = np.vstack(models)
    starts = np.cumsum([0, *[len(m) for m in models]])
    # (first centroid, number of models, k): neighbouring models of equal k are handled together.
    groups: list[tuple[int, int, int]] = []
    for at, model in zip(starts, models, strict=False):
        if groups and groups[-1][2] == len(model):
            groups[-1] = (groups[-1][0], groups[-1][1] + 1, len(model))
        else:
            groups.append((int(at), 1, len(model)))
    shared = spark.sparkContext.broadcast((stacked, groups))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_centers, groups = shared.value
        left = _products(all_centers)
        acc = np.zeros((len(all_centers), d + 2))
        for y, turned, square in _with_ones(batches, d, len(left)):
            n = len(y)
            for a, models, k in groups:
                many = max(1, CALLER_PRODUCTS // (k * (d + 1) * n))
                for first in range(a, a + models * k, many * k):
                    rows = slice(first, min(first + many * k, a + models * k))
                    part = (left[rows] @ turned).reshape(-1, k, n)
                    low = part.min(1)
                    own = np.equal(part, low[:, None, :]).astype(np.float64).reshape(-1, n)
                    sums = own @ y
                    if sums[:, d].sum() != len(low) * n:  # a row between centroids belongs to the first of them
                        own = (part.argmin(1)[:, None, :] == np.arange(k)[None, :, None]).astype(np.float64).reshape(-1, n)
                        sums = own @ y
                    acc[rows, 0] += sums[:, d]
                    acc[rows, 2:] += sums[:, :d]
                    low += square
                    acc[rows.start:rows.stop:k, 1] += np.maximum(low, 0.0, out=low).sum(1)
        columns = [pa.array(np.arange(len(acc), dtype=np.int32)), *[pa.array(acc[:, c]) for c in range(d + 2)]]
        yield pa.RecordBatch.from_arrays(columns, names=["centroid", *value_names])

    value_names = ["n", "error", *[f"s{i}" for i in range(d)]]
    schema = "centroid int, " + ", ".join(f"{v} double" for v in value_names)
    # One row per centroid reaches the driver.
    sums = blocks.mapInArrow(fold, schema).groupBy("centroid").agg(*[F.sum(v).alias(v) for v in value_names]).collect()
    table = np.zeros((len(stacked), d + 2))
    for r in sums:
        table[r["centroid"]] = [r[v] for v in value_names]
    shared.unpersist()
    parts = [table[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    return [p[:, 0] for p in parts], [p[:, 2:] for p in parts], [float(p[:, 1].sum()) for p in parts]


def pick_default_k(trained: Sequence[int], default: int = DEFAULT_K) -> int:
    """The default k when it was trained, else the smallest one."""
    if not trained:
        raise ValueError("no trained k")
    return default if default in trained else min(trained)


def distances_to(point: str, centers: Sequence[Sequence[float]]) -> Column:
    """Array of Euclidean distances from an array<double> (SQL text) to the given centroids; null for a null array.

    Spelled out in SQL, k x d terms outgrow what the JVM compiles and each row is interpreted (measured: 18 s against 4 s for
    600,000 rows x 7 centroids x 24 features, scaling included). Only the array crosses to Python, a batch at a time. Marked as not repeatable so that
    no filter or projection above evaluates it twice.
    """
    targets = np.array(centers, dtype=np.float64)

    def distances(arrays: pa.Array) -> pa.Array:
        present = arrays.is_valid().to_numpy(zero_copy_only=False)
        x = arrays.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, targets.shape[1])
        gaps = np.empty((len(x), len(targets)))
        for i, target in enumerate(targets):
            gap = x - target
            gaps[:, i] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        ends = np.concatenate([[0], np.cumsum(np.where(present, len(targets), 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(gaps.ravel()), mask=pa.array(~present))

    return F.arrow_udf(distances, "array<double>").asNondeterministic()(F.expr(point))


def array_sql(features: Sequence[str]) -> str:
    return "array(" + ", ".join(f"cast({q(f)} as double)" for f in features) + ")"


def nearest_sql(distances: str) -> str:
    """Index of the smallest distance; ties go to the lowest cluster."""
    return f"cast(array_position({distances}, array_min({distances})) - 1 as int)"


def assign_clusters(df: DataFrame, features: Sequence[str], centers: Sequence[Sequence[float]], column: str = "cluster") -> DataFrame:
    """Scaled rows plus the nearest centroid's index; a narrow step, no job."""
    require_columns(df, features)
    return df.select("*", distances_to(array_sql(features), centers).alias("_distances")).selectExpr(
        *[q(c) for c in df.columns], f"{nearest_sql('_distances')} as {q(column)}")


def centers_of(df: DataFrame, features: Sequence[str], cluster: str = "cluster") -> list[list[float]]:
    """Centroids of a given assignment, by ascending cluster id (one row per cluster is collected)."""
    means = ", ".join(f"avg({q(f)})" for f in features)
    rows = df.groupBy(q(cluster)).agg(F.expr(f"array({means})").alias("center")).orderBy(q(cluster)).collect()
    return [list(r["center"]) for r in rows]


def inertia(df: DataFrame, features: Sequence[str], centers: Sequence[Sequence[float]], cluster: str = "cluster") -> DataFrame:
    """(inertia): sum over all rows of the squared distance to the centroid of the row's cluster."""
    require_columns(df, features)
    # Each row meets its own centroid only, and stays in the JVM: one constant array per feature, read at the row's cluster. A missing value of a row with a cluster makes the sum NaN.
    gaps = df.where(f"{q(cluster)} is not null").selectExpr(*[
        f"coalesce(cast({q(f)} as double), double('NaN')) - array({', '.join(number(center[i]) for center in centers)})[{q(cluster)}] as g{i}" for i, f in enumerate(features)])
    return gaps.selectExpr("sum(" + " + ".join(f"g{i} * g{i}" for i in range(len(features))) + ") as inertia")


def one_step(df: DataFrame, features: Sequence[str], centers: Sequence[Sequence[float]]) -> DataFrame:
    """(cluster, size, ordinal, value) of the centroids after one Lloyd iteration over all rows."""
    names = list(features)
    rows = as_doubles(df, names)
    old = np.array(centers, dtype=np.float64)
    (counts,), (sums,), _ = _assign_and_sum(_pack(rows, len(names)), len(names), [old])
    out = [
        (c, int(counts[c]), i, float(sums[c][i] / counts[c]) if counts[c] else float(old[c][i]))
        for c in range(len(old)) for i in range(len(names))
    ]
    return df.sparkSession.createDataFrame(out, "cluster int, size bigint, ordinal int, value double")
