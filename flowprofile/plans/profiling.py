"""From a raw table to described clusters: prepare → sweep k → compare → choose → assign → describe."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from flowprofile.config import DEFAULT_K, PipelineConfig
from flowprofile.operators import evaluate, interpret, kmeans, prep, score


@dataclass(frozen=True)
class Profiled:
    """Tables of one run; `assigned` has the cleaned, unscaled features, the label and the cluster."""

    prepared: prep.Prepared
    sweep: kmeans.Sweep
    k: int
    assigned: DataFrame
    distribution: DataFrame
    summary: DataFrame
    flags: DataFrame
    narrative: DataFrame
    dominant: DataFrame
    config: PipelineConfig

    def metrics(self) -> DataFrame:
        """Comparison table over all trained k."""
        return evaluate.evaluate_k(self.prepared.scaled, self.sweep, self.config.evaluation_rows, self.config.seed)


def assign_cleaned(prepared: prep.Prepared, centers) -> DataFrame:
    """Cleaned rows with their cluster: scaling and distances stay inside one projection."""
    return score.score_flows(prepared.cleaned, prepared.preprocessor, centers, on_bad="trust").drop("nearest_distance", "distances")


def profile_clusters(assigned: DataFrame, features, config: PipelineConfig = PipelineConfig()) -> dict[str, DataFrame]:
    """distribution, summary, flags, narrative and dominant of an assignment."""
    distribution = interpret.cluster_distribution(assigned)
    summary = interpret.cluster_summary(assigned, features)
    # A few rows per cluster, read by three descriptions: aggregate the big table once.
    spark = assigned.sparkSession
    distribution = spark.createDataFrame(distribution.collect(), distribution.schema)
    summary = spark.createDataFrame(summary.collect(), summary.schema)
    return {
        "distribution": distribution, "summary": summary,
        "flags": interpret.anomaly_flags(summary, distribution, config.size_threshold, config.deviation_threshold),
        "narrative": interpret.cluster_narrative(summary, distribution),
        "dominant": interpret.dominant_features(summary),
    }


def run(df: DataFrame, config: PipelineConfig = PipelineConfig(), k: int | None = None) -> Profiled:
    """The whole job on one table; `k` defaults to 4 when trained, else the smallest trained k."""
    prepared = prep.preprocess(df, config)
    sweep = kmeans.train_multiple_k(
        prepared.scaled, config.features, config.ks, config.n_init, config.max_iter, config.tolerance, config.seed)
    chosen = k if k is not None else kmeans.pick_default_k(list(sweep.models), DEFAULT_K)
    assigned = assign_cleaned(prepared, sweep.models[chosen].centers)
    return Profiled(prepared, sweep, chosen, assigned, **profile_clusters(assigned, config.features, config), config=config)
