"""Describing clusters: sizes, profiles, z-scores, dominant features, rule-based tags, anomaly candidates.

Everything after the first grouped aggregate works on one row per (cluster, feature).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowprofile.config import DEVIATION_THRESHOLD, SIZE_THRESHOLD, TOP_FEATURES
from flowprofile.functions.aggregates import per_feature
from flowprofile.functions.columns import numeric_columns, percent_sql, q, text
from flowprofile.functions.quantiles import quantile_table

NAMED_DEVIATIONS = 5


def cluster_distribution(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, count, percentage) by cluster; rows without a cluster are left out."""
    counts = df.where(f"{q(cluster)} is not null").groupBy(F.expr(q(cluster)).alias("cluster")).agg(F.count("*").alias("count"))
    return counts.selectExpr("cluster", "count", f"{percent_sql('count', 'sum(count) over ()')} as percentage").orderBy("cluster")


def cluster_summary(df: DataFrame, features: Sequence[str] | None = None, cluster: str = "cluster") -> DataFrame:
    """(cluster, ordinal, feature, mean) on the cleaned, unlogged and unscaled values."""
    names = list(features) if features else [c for c in numeric_columns(df) if c != cluster]
    means = per_feature(_with_cluster(df, names, cluster), names, {"mean": lambda c: f"avg({c})"}, by=["cluster"])
    return means.selectExpr("cluster", _ordinal(names), "feature", "mean")


def _with_cluster(df: DataFrame, names: Sequence[str], cluster: str) -> DataFrame:
    rows = df.where(f"{q(cluster)} is not null")
    return rows.selectExpr(*[f"nullif(cast({q(n)} as double), double('NaN')) as {q(n)}" for n in names], f"{q(cluster)} as cluster")


def _ordinal(names: Sequence[str]) -> str:
    return "cast(array_position(array(" + ", ".join(text(n) for n in names) + "), feature) - 1 as int) as ordinal"


def cluster_profiles(df: DataFrame, features: Sequence[str] | None = None, cluster: str = "cluster") -> DataFrame:
    """(cluster, stat, feature, value) with stat in count, mean, median; count is the cluster's row count."""
    names = list(features) if features else [c for c in numeric_columns(df) if c != cluster]
    rows = _with_cluster(df, names, cluster)
    basic = per_feature(rows, names, {"mean": lambda c: f"avg({c})", "count": lambda c: "count(*)"}, by=["cluster"])
    medians = quantile_table(rows, names, {"median": 0.5}, by="cluster")
    joined = basic.withColumn("grp", F.col("cluster").cast("string")).join(medians, ["grp", "feature"], "left")
    return joined.selectExpr(
        "cluster", "feature", "stack(3, 'count', cast(count as double), 'mean', mean, 'median', median) as (stat, value)",
    ).select("cluster", "stat", "feature", "value").orderBy("cluster", "stat", "feature")


# Fixed value: a spread of the means below this share of the largest one is rounding noise.
NOISE = 1e-12


def profile_zscores(summary: DataFrame) -> DataFrame:
    """(cluster, ordinal, feature, z) of each cluster mean among the cluster means (unweighted; sample deviation).

    A feature whose means differ by rounding noise only has z = 0 everywhere.
    """
    # Rows per feature = number of clusters.
    over = "over (partition by feature)"
    return summary.selectExpr(
        "*", f"avg(mean) {over} as overall", f"stddev_samp(mean) {over} as sd", f"max(abs(mean)) {over} as largest"
    ).selectExpr("cluster", "ordinal", "feature", f"case when sd <= {NOISE}D * largest then mean * 0D else (mean - overall) / sd end as z")


def dominant_features(summary: DataFrame, n: int = TOP_FEATURES) -> DataFrame:
    """(cluster, rank, feature, z): the n features with the largest absolute z-score per cluster."""
    # Float noise must not decide between equal z-scores; the feature order does.
    order = "row_number() over (partition by cluster order by round(abs(z), 9) desc nulls last, ordinal)"
    return profile_zscores(summary).selectExpr("cluster", f"{order} as rank", "feature", "z").where(f"rank <= {int(n)}")


# Features the tag rules look at, their thresholds (ratio of cluster mean to overall mean), tags and texts.
DURATION = "Flow Duration"
VOLUME = ("Total Length of Fwd Packets", "Average Packet Size")
RATE = ("Flow Packets/s", "Fwd Packets/s")
FIN = "FIN Flag Count"
PSH = "PSH Flag Count"
TAG_TEXT = {
    "duration_very_short": "very short connections",
    "duration_short_medium": "short to medium duration",
    "duration_very_long": "very long duration",
    "duration_moderate": "moderate duration",
    "volume_low": "low packet volume",
    "volume_very_high": "very high packet volume",
    "volume_fairly_high": "fairly high packet volume",
    "rate_burst": "very high packet rate (burst-like)",
    "rate_low": "low packet rate",
    "fin_many": "many FIN connections (connection teardown)",
    "psh_frequent": "frequent PUSH",
}


def cluster_narrative(summary: DataFrame, distribution: DataFrame) -> DataFrame:
    """(cluster, count, tags, text): rule-based tags, skipping rules whose features are absent."""
    ratios = summary.selectExpr("*", "avg(mean) over (partition by feature) as overall").selectExpr(
        "cluster", "feature", "mean", "overall", "mean / greatest(overall, 1e-9D) as ratio")

    def of(name: str, measure: str = "ratio") -> str:
        return f"max(case when feature = {text(name)} then {measure} end)"

    def mean_of(names: Sequence[str]) -> str:
        return f"avg(case when feature in ({', '.join(text(n) for n in names)}) then ratio end)"

    measures = ratios.groupBy("cluster").agg(
        F.expr(of(DURATION)).alias("duration"), F.expr(mean_of(VOLUME)).alias("volume"), F.expr(mean_of(RATE)).alias("rate"),
        *[F.expr(f"{of(n, 'mean')} > {of(n, 'overall')} * 1.5D").alias(a) for n, a in ((FIN, "fin"), (PSH, "psh"))])
    tags = measures.join(distribution.select("cluster", "count"), "cluster", "left").selectExpr(
        "cluster", "coalesce(count, 0L) as count",
        """array_compact(array(
            case when duration is null then null when duration < 0.3D then 'duration_very_short' when duration < 0.7D then 'duration_short_medium'
                 when duration > 2D then 'duration_very_long' else 'duration_moderate' end,
            case when volume < 0.3D then 'volume_low' when volume > 2D then 'volume_very_high' when volume > 1.3D then 'volume_fairly_high' end,
            case when rate > 2D then 'rate_burst' when rate < 0.3D then 'rate_low' end,
            case when fin then 'fin_many' end,
            case when psh then 'psh_frequent' end)) as tags""")
    words = "map(" + ", ".join(f"{text(k)}, {text(v)}" for k, v in TAG_TEXT.items()) + ")"
    head = "concat('Cluster ', cluster, ' (', format_number(count, 0), ' flows)')"
    return tags.selectExpr(
        "cluster", "count", "tags",
        f"concat(array_join(array_prepend(transform(tags, t -> element_at({words}, t)), {head}), ' — '), '.') as text")


def anomaly_flags(
    summary: DataFrame, distribution: DataFrame,
    size_threshold: float = SIZE_THRESHOLD, deviation_threshold: float = DEVIATION_THRESHOLD,
) -> DataFrame:
    """(cluster, severity, share, n_deviating, deviating_features, reasons); unflagged clusters are absent.

    Deviating: some feature's absolute z-score above the threshold (all are listed, in feature order; the reason's text names the first five).
    Small: the cluster's share of all rows below the size threshold. Both make it HIGH, one MEDIUM.
    """
    high = profile_zscores(summary).where(f"abs(z) > {float(deviation_threshold)}D").groupBy("cluster").agg(
        F.count("*").alias("n_deviating"),
        F.expr("transform(array_sort(collect_list(struct(ordinal, feature))), e -> e.feature)").alias("names"))
    sizes = distribution.selectExpr("cluster", "count / sum(count) over () as share")
    clusters = summary.select("cluster").distinct().join(sizes, "cluster", "left").join(high, "cluster", "left")
    small = f"coalesce(share, 0D) < {float(size_threshold)}D"
    reasons = (
        "array_compact(array("
        f"case when n_deviating is not null then concat('high deviation in: ', array_join(slice(names, 1, {NAMED_DEVIATIONS}), ', ')) end, "
        f"case when {small} then concat('very small cluster (', bround(coalesce(share, 0D) * 100, 1), '% of all flows)') end))"
    )
    return clusters.selectExpr("*", f"{reasons} as reasons").where("size(reasons) > 0").selectExpr(
        "cluster", "case when size(reasons) > 1 then 'HIGH' else 'MEDIUM' end as severity", "coalesce(share, 0D) as share",
        "coalesce(n_deviating, 0L) as n_deviating", "coalesce(names, array()) as deviating_features", "reasons")


def label_by_cluster(df: DataFrame, label: str, cluster: str = "cluster") -> DataFrame:
    """(cluster, label, count); rows without a label are left out."""
    return df.where(f"{q(label)} is not null").groupBy(F.expr(q(cluster)).alias("cluster"), F.expr(q(label)).alias("label")).agg(
        F.count("*").alias("count"))


def label_crosstab(df: DataFrame, label: str, cluster: str = "cluster", labels: Sequence[str] | None = None) -> DataFrame:
    """One row per cluster, one count column per label in label order, zeros filled."""
    counts = label_by_cluster(df, label, cluster)
    if labels is None:
        # One column each, so a table of very many labels is better read in the long form.
        labels = [r["label"] for r in counts.select("label").distinct().orderBy("label").collect()]
    return counts.groupBy("cluster").agg(*[
        F.expr(f"coalesce(sum(case when label = {text(str(v))} then count end), 0L)").alias(str(v)) for v in labels
    ]).orderBy("cluster")
