"""Sums over all pairs of columns, computed block by block as matrix products.

With d columns there are d(d+1)/2 pairs; as SQL aggregates they would be thousands of buffers in one row. Each task folds
its Arrow batches into d x d matrices and emits them once; Spark adds them up.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowprofile.functions.aggregates import per_feature, union_all
from flowprofile.functions.columns import q

# Columns of one matrix; pairs of more columns are summed in blocks of them.
BLOCK_COLUMNS = 512
_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def batch_matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """First d columns of an Arrow batch as a float64 matrix, null as NaN."""
    return np.column_stack([batch.column(j).to_numpy(zero_copy_only=False) for j in range(d)]).astype(np.float64, copy=False)


def pair_sums(df: DataFrame, names: Sequence[str], means: Mapping[str, float | None] | None = None) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) for i <= j over the rows where both columns are present.

    Values are taken relative to each column's mean (found by a scan unless given), which keeps the later differences of sums accurate.
    A column holding infinite values has no finite sums; its pairs are returned as NaN.
    """
    d = len(names)
    if d > BLOCK_COLUMNS:
        return _in_blocks(df, list(names), means)
    means = means or {r["feature"]: r["mean"] for r in per_feature(df, names, {"mean": lambda c: f"avg({c})"}).collect()}
    center = np.array([means[n] if means[n] is not None else 0.0 for n in names])
    usable = np.isfinite(center)
    center = np.where(usable, center, 0.0)
    upper = np.triu_indices(d)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((6, d, d))
        for batch in batches:
            x = batch_matrix(batch, d) - center
            present = ~np.isnan(x)
            x = np.where(present & usable, x, 0.0)
            m = present.astype(np.float64)
            squares = x * x
            sums, square_sums = x.T @ m, squares.T @ m
            totals += np.stack([m.T @ m, sums, sums.T, square_sums, square_sums.T, x.T @ x])
        totals[1:, ~usable, :] = np.nan
        totals[1:, :, ~usable] = np.nan
        flat = [pa.array(t[upper]) for t in totals]
        yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), *flat], names=["i", "j", *_SUMS])

    schema = "i int, j int, " + ", ".join(f"{s} double" for s in _SUMS)
    return df.mapInArrow(fold, schema).groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in _SUMS])


def _in_blocks(df: DataFrame, names: list[str], means: Mapping[str, float | None] | None) -> DataFrame:
    """Pairs of two half blocks at a time; each pass reads its own columns."""
    half = max(1, BLOCK_COLUMNS // 2)
    starts = list(range(0, len(names), half))
    parts = []
    for a in starts:
        for b in starts[starts.index(a):]:
            of_a, of_b = list(range(a, min(a + half, len(names)))), list(range(b, min(b + half, len(names)))) if b > a else []
            places = [*of_a, *of_b]
            place = "element_at(array(" + ", ".join(map(str, places)) + "), {0} + 1)"
            sums = pair_sums(df.select(*[q(names[i]) for i in places]), [names[i] for i in places], means)
            # Pairs within a block come from the pass of the block alone.
            wanted = sums.where(f"i < {len(of_a)} and j >= {len(of_a)}") if of_b else sums
            parts.append(wanted.selectExpr(f"{place.format('i')} as i", f"{place.format('j')} as j", *_SUMS))
    return union_all(parts)
