"""Vectors that take part in a search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowprofile.llm.common import materialize


def usable_vectors(
    embeddings: DataFrame, is_query: Column, *, key: str = "vec_id", vector: str = "embedding", nonzero: bool = False
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Written rows (id, v, asked) of an id and a vector of finite components, and the function that gives results (query_id, vec_id) their ids back.

    v is array<double>; `asked` is `is_query`, a condition on the column `id`. While ids are unique they stay. With repeated ids every row takes part under a row number
    in the order of the ids, so that ties go by id then too. `nonzero` leaves zero and empty vectors out. Other columns are dropped.
    """
    v = F.col("v")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if nonzero:
        fine &= F.exists(v, lambda x: x != 0)
    rows = embeddings.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull())
    rows = materialize(rows.where(F.coalesce(fine, F.lit(False))).withColumn("asked", F.coalesce(is_query, F.lit(False))), "vectors")
    total, different = rows.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
    if total == different:
        return rows, lambda found: found
    sorted_ = rows.repartitionByRange("id").sortWithinPartitions("id")
    placed = materialize(sorted_.select(F.monotonically_increasing_id().alias("id"), "v", "asked", F.col("id").alias("named")), "numbered-vectors")
    names = placed.select("id", "named")

    def renamed(found: DataFrame) -> DataFrame:
        for column in ("query_id", "vec_id"):
            found = found.join(names.select(F.col("id").alias(column), F.col("named").alias("_id")), column).drop(column).withColumnRenamed("_id", column)
        return found

    return placed.drop("named"), renamed


def distances(apart: np.ndarray) -> np.ndarray:
    """Euclidean length of each row, also where the squares leave the range of a double."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        square = (apart**2).sum(axis=1)
        out = np.sqrt(square)
        odd = np.flatnonzero(~np.isfinite(square) | (square < 1e-280))
        top = np.abs(apart[odd]).max(axis=1, initial=0.0)
        plain = np.where((top > 0) & np.isfinite(top), top, 1.0)
        out[odd] = np.where(np.isfinite(top), plain * np.sqrt(((apart[odd] / plain[:, None]) ** 2).sum(axis=1)), np.inf)
    return out


def stack(vectors: pd.Series, width: int | None = None) -> np.ndarray:
    """Rows of float64; shorter vectors are padded with zeros."""
    rows = [np.asarray(v, dtype=np.float64) for v in vectors]
    wide = max([len(r) for r in rows] + [width or 0], default=0)
    out = np.zeros((len(rows), wide))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out
