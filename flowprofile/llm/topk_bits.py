"""Exact top-k by integer inner product over a bit-sliced index.

The index holds rows in blocks, ordered by id. Components are quantised to floor(scale * x), made non-negative by the block's lowest value, and cut into
bit slices: one bitmap over the block's rows per (dimension, bit). A query adds slices with bitmap arithmetic alone: each set bit a of |q_j| adds slice b of
dimension j at position a + b (the complement of the slice for a negative q_j, which only shifts all scores by a constant); bitmaps of one position
are reduced by full adders, three to a sum and a carry. The sums are the bit slices of all scores of the block. The top rows are found from the most
significant slice down: rows known to be in, rows still tied; the rows that tie on every slice are the boundary, resolved exactly by the smaller id.

Every query meets every block ("a stated query set against all rows, in blocks"): chunks of queries and index blocks are paired by a shuffle
on (block, chunk), so that a task holds one block and one chunk; each gives k rows per query at most, and a window keeps the k best.

Finite components of any size are quantised exactly and slices are as many as they need; a score of the result that does not fit 64 bits raises an error that
names its rows. Shorter vectors are padded with zeros. Rows that share an id all take part, each leaving only itself out (see `usable_vectors`). Fewer candidates than k: all are returned. An empty table gives no rows.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowprofile.llm.vectors import stack, usable_vectors

SCALE, TOP = 64, 20
BLOCK_ROWS = 8192
CHUNK_QUERIES = 512
#: Quantised components below this are held in 64 bits, larger ones as Python integers.
_LIMIT = 1 << 61
_LIMB = 48
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantise(vectors: np.ndarray, scale: float = SCALE) -> np.ndarray:
    """floor(scale * x), exactly."""
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * vectors)
    if not scaled.size or np.abs(scaled).max() < _LIMIT:
        return scaled.astype(np.int64)
    whole = [[int(y) if np.isfinite(y) else int(Fraction(x) * Fraction(scale) // 1) for x, y in zip(*row, strict=True)] for row in zip(vectors.tolist(), scaled.tolist(), strict=True)]
    out = np.empty(scaled.shape, dtype=object)
    out[:] = whole
    return out


class BitSlicedBlock:
    """Bit slices of the quantised rows of one block; rows are in ascending order of their ids."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids = ids
        self.count, self.dims = rows.shape
        self.words = -(-max(1, self.count) // 64)
        self.low = int(rows.min()) if rows.size else 0
        shifted = rows - self.low
        self.bits = max(1, int(shifted.max()).bit_length()) if rows.size else 1
        limbs = [((shifted >> at) & ((1 << _LIMB) - 1)).astype(np.uint64) for at in range(0, self.bits, _LIMB)]
        self.slices = np.zeros((2, self.dims, self.bits, self.words), dtype=np.uint64)
        for b in range(self.bits):
            plane = ((limbs[b // _LIMB] >> np.uint64(b % _LIMB)) & np.uint64(1)).astype(np.uint8).T
            packed = np.packbits(np.pad(plane, ((0, 0), (0, self.words * 64 - self.count))), axis=1, bitorder="little")
            self.slices[0, :, b] = np.ascontiguousarray(packed).view(np.uint64)
        self.slices[1] = self.slices[0] ^ _ALL
        self.rows = np.packbits(np.pad(np.ones(self.count, np.uint8), (0, self.words * 64 - self.count)), bitorder="little").view(np.uint64)

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Bit slices of the scores, lowest first, and the constant to add."""
        q = query[: self.dims]
        size = np.abs(q)
        total = sum(q.tolist())
        constant = self.low * total - ((1 << self.bits) - 1) * sum(size[q < 0].tolist())
        # (position of the query bit, dimension) of every set bit.
        width = int(size.max()).bit_length() if q.size else 0
        set_bits = [np.flatnonzero((size >> a & 1).astype(bool)) for a in range(width)]
        sign = (q < 0).astype(np.int64)
        out: list[np.ndarray] = []
        carried: list[np.ndarray] = []
        position = 0
        while position < width + self.bits - 1 or carried:
            stacks = carried + [
                self.slices[sign[set_bits[a]], set_bits[a], position - a] for a in range(max(0, position - self.bits + 1), min(width, position + 1)) if len(set_bits[a])
            ]
            carried = []
            here = np.concatenate(stacks) if stacks else np.zeros((1, self.words), np.uint64)
            while len(here) > 1:
                third = len(here) // 3
                if third:
                    a, b, c = here[:third], here[third : 2 * third], here[2 * third : 3 * third]
                    half = a ^ b
                    carried.append((a & b) | (c & half))
                    here = np.concatenate([half ^ c, here[3 * third :]])
                else:
                    carried.append(here[:1] & here[1:])
                    here = here[:1] ^ here[1:]
            out.append(here[0])
            position += 1
        return out, constant

    def top(self, query: np.ndarray, k: int, own: int | None = None) -> tuple[np.ndarray, list[int]]:
        """Ids and scores of the k best rows, ties to the smaller id; the row with the id `own` is left out."""
        slices, constant = self.scores(query)
        tied, surely = self.rows.copy(), np.zeros_like(self.rows)
        if own is not None:
            at = int(np.searchsorted(self.ids, own))
            if at < self.count and self.ids[at] == own:
                tied[at // 64] &= _ALL ^ (np.uint64(1) << np.uint64(at % 64))
        need = min(k, int(np.bitwise_count(tied).sum()))
        for plane in reversed(slices):
            with_bit = tied & plane
            n = int(np.bitwise_count(with_bit).sum())
            if n > need:
                tied = with_bit
            else:
                surely |= with_bit
                need -= n
                tied = tied & ~plane
            if not need:
                break
        rows = self._positions(surely)
        if need:
            rows = np.concatenate([rows, self._positions(tied)[:need]])
        word, bit = rows // 64, (rows % 64).astype(np.uint64)
        values = [constant] * len(rows)
        for p, plane in enumerate(slices):
            for i in np.flatnonzero(plane[word] >> bit & np.uint64(1)):
                values[i] += 1 << p
        return self.ids[rows], values

    @staticmethod
    def _positions(bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_inner_products(
    embeddings: DataFrame, is_query: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = TOP, scale: float = SCALE,
    block_rows: int = BLOCK_ROWS, chunk_queries: int = CHUNK_QUERIES,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of each query. `is_query` is a condition on the column `id`."""
    rows, renamed = usable_vectors(embeddings, is_query, key=key, vector=vector)
    total, asked = rows.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    blocks, chunks = max(1, -(-total // block_rows)), max(1, -(-asked // chunk_queries))
    block_of, chunk_of = F.pmod(F.xxhash64("id"), F.lit(blocks)), F.pmod(F.xxhash64("id"), F.lit(chunks))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    index_side = rows.select("id", "v", block_of.alias("block"), every(chunks).alias("chunk"))
    query_side = rows.where("asked").select("id", "v", chunk_of.alias("chunk"), every(blocks).alias("block"))

    def search(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if index.empty or queries.empty:
            return pd.DataFrame([], columns=["query_id", "vec_id", "score"])
        index = index.sort_values("id")
        asked_ = quantise(stack(queries["v"]), scale)
        held = BitSlicedBlock(index["id"].to_numpy(), quantise(stack(index["v"], asked_.shape[1]), scale))
        found = []
        for query_id, q in zip(queries["id"].tolist(), asked_, strict=True):
            ids, values = held.top(q, k, query_id)
            found += [(query_id, int(other), score) for other, score in zip(ids, values, strict=True)]
        # A score above 64 bits belongs to the result of its query; one below may, and is told apart once all blocks are known.
        for query_id, other, score in found:
            if score >= 1 << 63:
                raise OverflowError(f"the score of rows {query_id} and {other} does not fit 64 bits: {score}")
        query_ids, others, scores = zip(*found, strict=True) if found else ((), (), ())
        kept = pd.array([s if s >= -(1 << 63) else None for s in scores], dtype="Int64")
        return pd.DataFrame({"query_id": pd.array(query_ids, dtype="int64"), "vec_id": pd.array(others, dtype="int64"), "score": kept})

    best = index_side.groupBy("block", "chunk").cogroup(query_side.groupBy("block", "chunk")).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "vec_id")
    too_low = F.raise_error(F.concat(F.lit("a score does not fit 64 bits: rows "), F.col("query_id").cast("string"), F.lit(" and "), F.col("vec_id").cast("string"))).cast("long")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return renamed(ranked.select("query_id", "rank", "vec_id", F.coalesce("score", too_low).alias("score"))).select("query_id", "rank", "vec_id", "score")


def top_sql() -> str:
    """DuckDB SQL of the query: all inner products of the quantised vectors, which doubles hold exactly."""
    return f"""
WITH usable AS (
  SELECT row_number() OVER () AS row_no, vec_id, [floor({SCALE} * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.row_no, a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.row_no <> b.row_no WHERE a.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {TOP}"""
