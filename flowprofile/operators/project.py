"""Principal components of the scaled features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from flowprofile.config import PCA_COMPONENTS, PLOT_ROWS, SEED
from flowprofile.functions.aggregates import per_feature
from flowprofile.functions.columns import as_doubles, number, q
from flowprofile.operators.gram import pair_sums
from flowprofile.operators.sampling import uniform_sample


@dataclass(frozen=True)
class PCAModel:
    """Unit-length components (largest weight positive), the means they are centred on, variance ratios."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    components: tuple[tuple[float, ...], ...]
    explained: tuple[float, ...]


def _covariance(df: DataFrame, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariance matrix of the columns, from one scan over all rows after that for the means."""
    d = len(names)
    covariance, means = np.zeros((d, d)), np.zeros(d)
    center = {r["feature"]: r["mean"] for r in per_feature(df, names, {"mean": lambda c: f"avg({c})"}).collect()}
    for r in pair_sums(df, names, center).collect():
        covariance[r["i"], r["j"]] = covariance[r["j"], r["i"]] = (r["sxy"] - r["sx"] * r["sy"] / r["n"]) / max(r["n"] - 1, 1)
    means[:] = [center[n] for n in names]
    return means, covariance


def fit_pca(df: DataFrame, features: Sequence[str], n: int = PCA_COMPONENTS) -> PCAModel:
    """Covariances from all rows; only the d x d matrix is decomposed on the driver."""
    names = list(features)
    means, covariance = _covariance(as_doubles(df, names), names)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:n]
    total = float(np.trace(covariance))
    components = []
    for v in vectors[:, order].T:
        components.append(tuple(float(w) for w in v * np.sign(v[np.abs(v).argmax()])))
    return PCAModel(
        tuple(names), tuple(map(float, means)), tuple(components),
        tuple(float(max(values[i], 0.0) / total) if total > 0 else 0.0 for i in order))


def given_pca(df: DataFrame, features: Sequence[str], components: Sequence[Sequence[float]]) -> PCAModel:
    """A model of given components, with the table's means and the share of its variance that each component carries."""
    names = list(features)
    means, covariance = _covariance(as_doubles(df, names), names)
    total = float(np.trace(covariance))
    weights = np.array(components, dtype=np.float64)
    return PCAModel(
        tuple(names), tuple(map(float, means)), tuple(map(tuple, weights.tolist())),
        tuple(float(w @ covariance @ w / total) if total > 0 else 0.0 for w in weights))


def pca_project(df: DataFrame, model: PCAModel) -> DataFrame:
    """The table plus PC1, PC2, ...: a projection with literal weights, no job."""
    def component(weights: Sequence[float]) -> str:
        return " + ".join(f"({q(f)} - {number(m)}) * {number(w)}" for f, m, w in zip(model.features, model.means, weights, strict=True))
    return df.selectExpr("*", *[f"{component(w)} as PC{i}" for i, w in enumerate(model.components, 1)])


def pca_explained_variance(spark: SparkSession, model: PCAModel) -> DataFrame:
    """(component, ratio, cumulative): the last cumulative value is the share the plot shows."""
    running = np.cumsum(model.explained)
    rows = [(f"PC{i}", float(r), float(c)) for i, (r, c) in enumerate(zip(model.explained, running, strict=True), 1)]
    return spark.createDataFrame(rows, "component string, ratio double, cumulative double")


def pca_scatter(
    df: DataFrame, model: PCAModel, cluster: str = "cluster", n: int = PLOT_ROWS, seed: int = SEED,
    key: Sequence[str] | None = None, rank: str | None = None,
) -> DataFrame:
    """(PC1, PC2, cluster) of at most n sampled rows; rows are sampled before they are projected."""
    chosen = uniform_sample(df, n, seed, key or list(model.features), rank)
    return pca_project(chosen, model).selectExpr(*[f"PC{i}" for i in range(1, len(model.components) + 1)], f"{q(cluster)} as cluster")
