"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

Fit: a bounded sample (`SAMPLE` rows of lowest id hash, a parameter) is clustered into a tree of `BRANCHES` children per node, down to leaves of about
`LEAF_ROWS` rows of the whole table; the tree's size is bounded by the sample, so it is sent to the tasks whole.
Index: every row goes down the tree to one leaf, and the table (leaf, id, vector) is written once.
Search: a priority queue holds nodes by the distance of their centre to the query; the nearest is taken, a leaf is visited, an inner node puts its children
into the queue. Leaf visits widen (1, 2, 4, ... and then by bisection) until the recall over `CALIBRATION` calibration rows, whose true neighbours come from one exact
scan of all rows, reaches `RECALL`; the queries then visit as many leaves, and more while those hold fewer than k other rows.
The first `FIRST_VISITS` leaves of a query give a bound, its k-th distance so far. Of the further ones those are skipped that cannot hold a nearer row
(distance to the centre less the leaf's radius), which loses nothing, and the others give only rows within the bound.
Distances are Euclidean, in double precision, on the original vectors.

A leaf of many rows (copies of one vector) is cut into chunks of `CHUNK_ROWS` rows, and a leaf that many queries visit into chunks of queries;
a task holds one chunk of each. A row of the result of a chunk is one of its k nearest for a query; a window keeps the k nearest of all.

Null, zero and non-finite vectors take no part, nor do rows without an id; rows that share an id all take part, each leaving only itself out (see `usable_vectors`);
shorter vectors are padded with zeros. Distances hold for components of any finite size; one beyond the range of a double is infinite. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowprofile.llm.common import materialize
from flowprofile.llm.vectors import distances, stack, usable_vectors

SAMPLE, BRANCHES, LEAF_ROWS, MIN_LEAF_SAMPLE = 16_384, 8, 256, 8
ROUNDS, CALIBRATION, RECALL, TOP = 12, 256, 0.97, 10
CHUNK_ROWS, CHUNK_QUERIES = 4096, 4096
FIRST_VISITS = 8


@dataclass(frozen=True)
class KMeansTree:
    """Inner node i has the children `first[i]` to `first[i] + width[i] - 1`; a leaf has width 0 and a leaf number."""

    centres: np.ndarray
    first: np.ndarray
    width: np.ndarray
    leaf: np.ndarray
    #: Factor that brings the centres near one.
    unit: float

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def descend(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf number of each row, at every node the nearest child, the first of equally near ones; and the distance to the leaf's centre."""
        at = np.zeros(len(rows), dtype=np.int64)
        moving = np.arange(len(rows))
        while len(moving):
            moving = moving[self.width[at[moving]] > 0]
            for node in np.unique(at[moving]):
                here = moving[at[moving] == node]
                children = self.centres[self.first[node] : self.first[node] + self.width[node]] * self.unit
                with np.errstate(over="ignore", invalid="ignore"):
                    near = (children**2).sum(axis=1) - 2 * (rows[here] * self.unit) @ children.T
                at[here] = self.first[node] + near.argmin(axis=1)
        with np.errstate(over="ignore"):
            return self.leaf[at], distances(rows - self.centres[at])

    def best_bins(self, query: np.ndarray) -> Iterator[tuple[int, float]]:
        """Leaf numbers, with the distances of their centres, in the order of a best-bin-first traversal."""
        queue: list[tuple[float, int]] = [(0.0, 0)]
        while queue:
            distance, node = heapq.heappop(queue)
            if not self.width[node]:
                yield int(self.leaf[node]), float(distances(self.centres[node][None] - query)[0]) if node == 0 else distance
                continue
            children = slice(self.first[node], self.first[node] + self.width[node])
            with np.errstate(over="ignore"):
                apart = self.centres[children] - query
            for child, d in enumerate(distances(apart).tolist(), int(self.first[node])):
                heapq.heappush(queue, (d, child))


def _split(rows: np.ndarray, branches: int, generator: np.random.Generator) -> np.ndarray:
    """Lloyd's k-means with k-means++ starts: the part of each row."""
    centres = rows[generator.integers(len(rows))][None]
    near = ((rows - centres[0]) ** 2).sum(axis=1)
    while len(centres) < branches and near.sum() > 0:
        centres = np.vstack([centres, rows[generator.choice(len(rows), p=near / near.sum())]])
        near = np.minimum(near, ((rows - centres[-1]) ** 2).sum(axis=1))
    part = np.zeros(len(rows), dtype=np.int64)
    for _ in range(ROUNDS):
        part = ((centres**2).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)
        for c in np.unique(part):
            centres[c] = rows[part == c].mean(axis=0)
    return part


def fit_tree(sample: np.ndarray, leaf_sample: int, branches: int = BRANCHES, seed: int = 11) -> KMeansTree:
    """Tree over the sample; nodes of at most `leaf_sample` sample rows, or of equal rows, are leaves."""
    generator = np.random.default_rng(seed)
    # Clustered at a scale at which no square overflows; centres are given at the scale of the rows.
    top = float(np.abs(sample).max(initial=0.0))
    unit = 2.0 ** -min(1000, max(-1000, int(np.frexp(top)[1]))) if top else 1.0
    sample = sample * unit
    centres, first, width, leaf = [sample.mean(axis=0) if len(sample) else np.zeros(0)], [0], [0], [-1]
    waiting = [(0, np.arange(len(sample)))]
    leaves = 0
    while waiting:
        node, members = waiting.pop(0)
        parts: list[np.ndarray] = []
        if len(members) > leaf_sample:
            part = _split(sample[members], branches, generator)
            parts = [members[part == c] for c in np.unique(part)]
        if len(parts) < 2:
            leaf[node] = leaves
            leaves += 1
            continue
        first[node], width[node] = len(centres), len(parts)
        for p in parts:
            waiting.append((len(centres), p))
            centres.append(sample[p].mean(axis=0))
            first.append(0)
            width.append(0)
            leaf.append(-1)
    return KMeansTree(np.array(centres) / unit, np.array(first), np.array(width), np.array(leaf), unit)


def nearest(rows: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int, own: int) -> list[tuple[int, float]]:
    """The k nearest rows (id, distance) other than `own`, ties to the smaller id."""
    with np.errstate(over="ignore"):
        far = distances(rows - query)
    others = np.flatnonzero(ids != own)
    far = far[others]
    keep = np.flatnonzero(far <= np.partition(far, k - 1)[k - 1]) if len(far) > k else np.arange(len(far))
    order = keep[np.lexsort((ids[others[keep]], far[keep]))][:k]
    return [(int(ids[others[i]]), float(far[i])) for i in order]


def nearest_neighbours(
    embeddings: DataFrame, is_query: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = TOP, sample: int = SAMPLE, recall: float = RECALL,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (distance). `is_query` is a condition on the column `id`."""
    usable, renamed = usable_vectors(embeddings, is_query, key=key, vector=vector, nonzero=True)
    total, dims = usable.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    fitted = stack(_lowest(usable, sample)["v"], dims)
    tree = fit_tree(fitted, max(MIN_LEAF_SAMPLE, leaf_rows * len(fitted) // max(1, total)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                leaf, off = tree.descend(stack(batch["v"], dims))
                yield batch.assign(leaf=leaf, off=off)

    index = materialize(usable.mapInPandas(place, "id long, v array<double>, asked boolean, leaf int, off double"), "leaves")
    # Rows and radius per leaf: bounded by the tree.
    sizes, radii = np.zeros(tree.leaves, dtype=np.int64), np.zeros(tree.leaves)
    for leaf, n, radius in index.groupBy("leaf").agg(F.count(F.lit(1)), F.max("off")).toPandas().itertuples(index=False):
        sizes[leaf], radii[leaf] = n, radius
    visits = _calibrate(index, tree, k, recall, dims)
    index = index.drop("off")

    def traverse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Leaves of each query: the first ones while it has no bound, the further ones that may be nearer once it has. A query's vector stands there once, however many they are."""
        for batch in batches:
            chosen = []
            for bound, q in zip(batch["bound"].tolist(), stack(batch["v"], dims), strict=True):
                held, leaves = 0, []
                for turn, (leaf, distance) in enumerate(tree.best_bins(q)):
                    early = turn < FIRST_VISITS or held <= k
                    if turn >= visits and held > k or (bound < 0 and not early):
                        break
                    held += sizes[leaf]
                    if bound < 0 or not (early or distance - radii[leaf] > bound * (1 + 1e-9)):
                        leaves.append(leaf)
                chosen.append(np.array(leaves, dtype=np.int32))
            if chosen:
                yield batch.assign(leaves=chosen)

    def visit(held: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, float]] = []
        if len(held) and len(queries):
            rows, ids = stack(held["v"], dims), held["id"].to_numpy()
            for identifier, q, bound in zip(queries["id"].tolist(), stack(queries["v"], dims), queries["bound"].tolist(), strict=True):
                found += [(identifier, other, d) for other, d in nearest(rows, ids, q, k, identifier) if bound < 0 or d <= bound]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    def searched(queries: DataFrame) -> DataFrame:
        """The nearest rows of the leaves that the queries (id, v, bound) visit."""
        chosen = materialize(queries.mapInPandas(traverse, "id long, v array<double>, bound double, leaves array<int>"), "visits")
        plans = chosen.select("id", "v", "bound", F.explode("leaves").alias("leaf"))
        asked = np.zeros(tree.leaves, dtype=np.int64)
        for leaf, n in plans.groupBy("leaf").count().toPandas().itertuples(index=False):
            asked[leaf] = n
        chunks = pd.DataFrame({
            "leaf": np.arange(tree.leaves), "row_chunks": -(-np.maximum(sizes, 1) // CHUNK_ROWS), "query_chunks": -(-np.maximum(asked, 1) // CHUNK_QUERIES),
        })
        grid = F.broadcast(embeddings.sparkSession.createDataFrame(chunks[asked > 0].astype(int), "leaf int, row_chunks long, query_chunks long"))
        own = lambda n: F.pmod(F.xxhash64("id"), n)
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        rows_side = index.join(grid, "leaf").select("leaf", "id", "v", own(F.col("row_chunks")).alias("rc"), every(F.col("query_chunks")).alias("qc"))
        query_side = plans.join(grid, "leaf").select("leaf", "id", "v", "bound", own(F.col("query_chunks")).alias("qc"), every(F.col("row_chunks")).alias("rc"))
        keys = ("leaf", "rc", "qc")
        return rows_side.groupBy(*keys).cogroup(query_side.groupBy(*keys)).applyInPandas(visit, "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    queries = index.where("asked").select("id", "v")
    first = materialize(best(searched(queries.withColumn("bound", F.lit(-1.0)))), "first-visits")
    bounds = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    further = searched(queries.join(bounds, "id"))
    # A row is in one leaf, and a leaf in one of the two rounds, so nothing is found twice.
    return renamed(best(first.drop("rank").unionByName(further))).select("query_id", "rank", "vec_id", "score")


def _lowest(rows: DataFrame, n: int) -> pd.DataFrame:
    """The n rows (id, v) of lowest id hash, in its order. Every task names its n lowest by hash and id; vectors are read for the rows that are chosen."""
    digest = F.xxhash64("id")
    keys = rows.select(digest.alias("h"), "id").orderBy("h", "id").limit(n).toPandas()
    if len(keys) < n:
        found = rows.select(digest.alias("h"), "id", "v")
    else:
        h, identifier = keys.iloc[-1].tolist()
        found = rows.select(digest.alias("h"), "id", "v").where((F.col("h") < h) | ((F.col("h") == h) & (F.col("id") <= identifier)))
    return found.toPandas().sort_values(["h", "id"])


def _calibrate(index: DataFrame, tree: KMeansTree, k: int, recall: float, dims: int) -> int:
    """Leaf visits at which the calibration rows find `recall` of their true neighbours."""
    chosen = index.orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(CALIBRATION).toPandas()
    if chosen.empty:
        return 1
    asked, own = stack(chosen["v"], dims), chosen["id"].tolist()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[list[tuple[float, int, int]]] = [[] for _ in own]
        for batch in batches:
            if len(batch):
                rows, ids = stack(batch["v"], dims), batch["id"].to_numpy()
                leaf = dict(zip(ids.tolist(), batch["leaf"].tolist(), strict=True))
                for i, (identifier, q) in enumerate(zip(own, asked, strict=True)):
                    best[i] = sorted(best[i] + [(d, other, leaf[other]) for other, d in nearest(rows, ids, q, k, identifier)])[:k]
        yield pd.DataFrame([(i, d, other, leaf) for i, b in enumerate(best) for d, other, leaf in b], columns=["i", "d", "id", "leaf"])

    order = Window.partitionBy("i").orderBy("d", "id")
    true = index.mapInPandas(scan, "i int, d double, id long, leaf int").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # At most CALIBRATION x k rows.
    wanted = true.select("i", "leaf").toPandas()
    positions = []
    for i, leaves in wanted.groupby("i")["leaf"]:
        turn = {leaf: n for n, (leaf, _) in enumerate(tree.best_bins(asked[i]))}
        positions += [turn[leaf] for leaf in leaves]
    if not positions:
        return 1
    reached = lambda visits: float((np.array(positions) < visits).mean())
    high = 1
    while reached(high) < recall:
        high *= 2
    low = high // 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if reached(middle) >= recall else (middle, high)
    return high
