"""Assigning new flows to clusters and explaining the assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowprofile.functions.columns import q, text
from flowprofile.functions.quantiles import quantile_table
from flowprofile.operators.kmeans import distances_to, nearest_sql
from flowprofile.operators.prep import FittedPreprocessor

RESULT = ("cluster", "nearest_distance", "distances")


def score_flows(
    df: DataFrame, preprocessor: FittedPreprocessor, centers: Sequence[Sequence[float]], on_bad: str = "raise",
) -> DataFrame:
    """The input columns plus cluster, nearest_distance and the distances to all centroids.

    Parameters and centroids travel inside one narrow step. With `on_bad="route"` no job runs before and unusable rows
    keep a `reasons` array and no cluster; `"trust"` skips the checks for rows that were cleaned before.
    """
    extra, point = [], "_scaled"
    if on_bad == "route":
        scaled = preprocessor.checked_array(df)
        extra, point = ["reasons"], "case when size(reasons) = 0 then _scaled end"
    elif on_bad in ("raise", "trust"):
        if on_bad == "raise":
            preprocessor.raise_on_bad(df)
        scaled = preprocessor.scaled_array(df)
    else:
        raise ValueError("on_bad must be 'raise', 'route' or 'trust'")
    return scaled.select("_row", *extra, distances_to(point, centers).alias("distances")).selectExpr(
        "_row.*", f"{nearest_sql('distances')} as cluster", "array_min(distances) as nearest_distance", "distances", *extra)


def distance_ranking(scored: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., cluster, distance, rank): every centroid per flow, nearest first; sorted inside the row, no shuffle."""
    ranked = "array_sort(transform(distances, (d, i) -> struct(d as distance, i as cluster)))"
    return scored.selectExpr(*[q(k) for k in key], f"posexplode({ranked}) as (pos, e)").selectExpr(
        *[q(k) for k in key], "e.cluster as cluster", "e.distance as distance", "pos + 1 as rank")


def score_context(
    scored: DataFrame, key: Sequence[str], distribution: DataFrame, flags: DataFrame, narrative: DataFrame, dominant: DataFrame,
) -> DataFrame:
    """Each flow with the size, flag, text and dominant features of its cluster.

    The four tables have one row (dominant: a few) per cluster; they are merged first and broadcast once.
    """
    top = dominant.groupBy("cluster").agg(F.expr("transform(array_sort(collect_list(struct(rank, feature))), e -> e.feature)").alias("dominant"))
    about = (
        distribution.selectExpr("cluster", "count as cluster_size", "percentage as cluster_pct")
        .join(flags.select("cluster", "severity", "reasons"), "cluster", "left")
        .join(narrative.select("cluster", "text"), "cluster", "left").join(top, "cluster", "left")
    )
    return scored.select(*[q(k) for k in key], "cluster", "nearest_distance").join(F.broadcast(about), "cluster", "left").select(
        *[q(k) for k in key], "cluster", "nearest_distance", "cluster_size", "cluster_pct", "severity", "reasons", "text", "dominant")


def preset_flows(cleaned: DataFrame, summary: DataFrame, features: Sequence[str], clusters: Sequence[int]) -> DataFrame:
    """Ready-made input rows: the median of the table and the mean of the given clusters, named in `preset`."""
    names = list(features)

    def row(table: DataFrame, value: str, preset: str) -> DataFrame:
        return table.agg(*[F.expr(f"max(case when feature = {text(f)} then {value} end)").alias(f) for f in names]).selectExpr(
            f"{text(preset)} as preset", *[q(f) for f in names])
    out = row(quantile_table(cleaned, names, {"median": 0.5}), "median", "median")
    for c in clusters:
        out = out.unionByName(row(summary.where(F.col("cluster") == c), "mean", f"cluster_{c}"))
    return out
