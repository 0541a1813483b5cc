"""One registered query per operator: (spark, folder of tables) -> DataFrame over the whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowprofile.catalog.fixtures import EMBEDDING_RANK_SQL, RANK_SQL, embedding_columns, flows, flows_from, given_cluster, rounded
from flowprofile.config import DEFAULT_FEATURES, EVALUATION_ROWS, LABEL_COLUMN, PipelineConfig
from flowprofile.functions.columns import q, short_methods
from flowprofile.functions.storage import new_path
from flowprofile.operators import evaluate, interpret, kmeans, prep, profile, project, sampling, score
from flowprofile.plans import profile_clusters
from flowprofile.plans.profiling import assign_cleaned
from flowprofile.sources import load_flows, separate_labels, write_sample
from flowprofile.sources.bundle import load_bundle, save_bundle
from flowprofile.streaming import score_stream, score_with_bundle, write_scores

Query = Callable[[SparkSession, str], DataFrame]
FEATURES = list(DEFAULT_FEATURES)
ROWS = [*FEATURES, LABEL_COLUMN]
ORDERS_RANK_SQL = "o_orderkey % 2147483647 * 48271 % 2147483647"
GIVEN_K = 7
EMBEDDING_KS = tuple(range(2, 9))
CONFIG = PipelineConfig()
# Trainings that SQL repeats: numbers of clusters, and iterations.
GIVEN_KS, GIVEN_ITERATIONS = CONFIG.ks, 3
# Clusters of the single training.
TRAINED_K = 4

_REGISTRY: dict[str, Query] = {}
_KEPT: dict[tuple, object] = {}


def register(function: Query) -> Query:
    @wraps(function)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        short_methods(spark)
        return function(spark, sf_dir)

    _REGISTRY[function.__name__] = query
    return query


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def once(name: str, spark: SparkSession, sf_dir: str, build: Callable[[], object]):
    """Prepared tables and trained models, shared by the queries of one application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT:
        _KEPT[key] = build()
    return _KEPT[key]


def forget() -> None:
    """Drop everything `once` has kept."""
    _KEPT.clear()


def comparable(df: DataFrame) -> DataFrame:
    """DOUBLE columns rounded for comparison; NaN, which only raw tables hold, as null."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    # In two steps: the rounding names its value several times, and one step would repeat all that leads to it.
    present = df.selectExpr(*[f"nullif({q(c)}, double('NaN')) AS {q(c)}" if c in doubles else q(c) for c in df.columns])
    return present.selectExpr(*[f"{rounded(q(c))} AS {q(c)}" if c in doubles else q(c) for c in df.columns])


# ---- inputs shared by several queries

def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir)


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.clean(flows(spark, sf_dir), FEATURES, LABEL_COLUMN)


def prepared(spark: SparkSession, sf_dir: str) -> prep.Prepared:
    return once("prepared", spark, sf_dir, lambda: prep.preprocess(flows(spark, sf_dir, with_id=True), CONFIG, keep=["flow_id"]))


@contextmanager
def shared_or_removed(spark: SparkSession, sf_dir: str) -> Iterator[None]:
    """Within, `prepared` is the one that other queries have built, or else one of its own, whose cleaned table goes at the end: for steps that need no more than its parameters afterwards."""
    shared = (spark.sparkContext.applicationId, sf_dir, "prepared") in _KEPT
    try:
        yield
    finally:
        if not shared and (own := _KEPT.pop((spark.sparkContext.applicationId, sf_dir, "prepared"), None)):
            own.close()


def given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned, unscaled flows with the given cluster."""
    return prepared(spark, sf_dir).cleaned.selectExpr(*map(q, ROWS), f"{given_cluster()} as cluster")


def given_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepared(spark, sf_dir)
    return p.preprocessor.transform(p.cleaned.selectExpr("flow_id", *map(q, ROWS), f"{given_cluster()} as cluster"))


def given_centers(spark: SparkSession, sf_dir: str) -> list[list[float]]:
    return once("centers", spark, sf_dir, lambda: kmeans.centers_of(given_scaled(spark, sf_dir), FEATURES))


def given_starts(spark: SparkSession, sf_dir: str, k: int) -> list[list[float]]:
    """The first k start centroids: the given ones, and the mean of all rows after them, for which all rows are read only where k goes so far."""
    centers = given_centers(spark, sf_dir)
    if k > len(centers):
        means = [F.avg(q(f)) for f in FEATURES]
        centers = [*centers, once("mean", spark, sf_dir, lambda: list(prepared(spark, sf_dir).scaled.agg(*means).first()))]
    return centers[:k]


def given_about(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return once("about", spark, sf_dir, lambda: profile_clusters(given(spark, sf_dir), FEATURES, CONFIG))


def sweep(spark: SparkSession, sf_dir: str) -> kmeans.Sweep:
    """Trained from given starts, three iterations, so that any engine can repeat it."""
    return once("sweep", spark, sf_dir, lambda: kmeans.train_multiple_k(
        prepared(spark, sf_dir).scaled, FEATURES, GIVEN_KS, max_iter=GIVEN_ITERATIONS, tolerance=1e-9,
        init={k: given_starts(spark, sf_dir, k) for k in GIVEN_KS}))


def seeded_sweep(spark: SparkSession, sf_dir: str) -> kmeans.Sweep:
    """All k with all restarts, from starts of its own."""
    return once("seeded_sweep", spark, sf_dir, lambda: kmeans.train_multiple_k(prepared(spark, sf_dir).scaled, FEATURES, CONFIG.ks))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once("metrics", spark, sf_dir, lambda: evaluate.evaluate_k(prepared(spark, sf_dir).scaled, sweep(spark, sf_dir), EVALUATION_ROWS, rank=RANK_SQL))


def embedding_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusterings `label % k` of the embeddings, compared for k = 2..8 on one sample, as `evaluate_k` does."""
    return once("embedding_metrics", spark, sf_dir, lambda: _embedding_metrics(spark, sf_dir))


def _embedding_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = sampling.uniform_sample(embedding_columns(spark, sf_dir), EVALUATION_ROWS, rank=EMBEDDING_RANK_SQL)
    names = [c for c in table.columns if c.startswith("e")]
    labelled = table.selectExpr("*", *[f"label % {k} as c{k}" for k in EMBEDDING_KS])
    return evaluate.compare_clusterings(labelled, names, {k: f"c{k}" for k in EMBEDDING_KS})


# ---- sources, sinks, row sampling

@register
def load_flows_query(spark, sf_dir):
    path = new_path(spark, "flows.csv")
    write_sample(raw(spark, sf_dir), path, compression="gzip")
    return comparable(load_flows(spark, path))


@register
def separate_labels_query(spark, sf_dir):
    return comparable(separate_labels(raw(spark, sf_dir))[0])


@register
def sample_allocation(spark, sf_dir):
    table = raw(spark, sf_dir)
    return comparable(sampling.sample_allocation(table, _third(table)))


def _third(table: DataFrame) -> int:
    return table.where(f"{q(LABEL_COLUMN)} is not null").count() // 3


def _stratified(spark, sf_dir) -> DataFrame:
    table = flows(spark, sf_dir, with_id=True)
    return sampling.stratified_sample(table, _third(table), rank=RANK_SQL)


@register
def stratified_sample(spark, sf_dir):
    return comparable(_stratified(spark, sf_dir))


@register
def sample_distribution(spark, sf_dir):
    return comparable(sampling.sample_distribution(raw(spark, sf_dir), _stratified(spark, sf_dir)))


@register
def write_sample_query(spark, sf_dir):
    path = write_sample(_stratified(spark, sf_dir), new_path(spark, "sample.csv"))
    return comparable(load_flows(spark, path))


@register
def uniform_sample(spark, sf_dir):
    return comparable(sampling.uniform_sample(flows(spark, sf_dir, with_id=True), EVALUATION_ROWS, rank=RANK_SQL))


@register
def preview(spark, sf_dir):
    return comparable(sampling.preview(flows(spark, sf_dir, with_id=True), 10))


def _bundle(spark, sf_dir) -> str:
    p = prepared(spark, sf_dir)
    given_model = kmeans.KMeansModel(GIVEN_K, tuple(FEATURES), tuple(map(tuple, given_centers(spark, sf_dir))), (0,) * GIVEN_K, 0.5, 3)
    return save_bundle(spark, new_path(spark, "bundle"), given_model, p.preprocessor, {"label": LABEL_COLUMN})


def _bundle_rows(centroids: DataFrame, parameters: DataFrame, metadata: DataFrame) -> DataFrame:
    """All values of the three tables: (part, name, ordinal, value)."""
    rows = centroids.selectExpr("'centroids' as part", "cast(cluster as string) as name", "posexplode(center) as (ordinal, value)")
    rows = rows.unionByName(parameters.selectExpr(
        "'parameters' as part", "feature as name", "posexplode(array(cast(cast(log as int) as double), shift, center, scale)) as (ordinal, value)"))
    rows = rows.unionByName(metadata.selectExpr(
        "'metadata' as part", "concat_ws(',', features) as name", "posexplode(array(cast(k as double), inertia, cast(n_iter as double))) as (ordinal, value)"))
    return comparable(rows)


@register
def save_bundle_query(spark, sf_dir):
    path = _bundle(spark, sf_dir)
    version = spark.read.parquet(f"{path}/versions").first()["version"]
    return _bundle_rows(*[spark.read.parquet(f"{path}/{version}/{table}") for table in ("centroids", "parameters", "metadata")])


@register
def load_bundle_query(spark, sf_dir):
    bundle = load_bundle(spark, _bundle(spark, sf_dir))
    m = bundle.model
    about = spark.createDataFrame([(m.k, list(m.features), m.inertia, m.n_iter)], "k int, features array<string>, inertia double, n_iter int")
    return _bundle_rows(kmeans.Sweep({m.k: m}).centroid_table(spark), bundle.preprocessor.table(spark), about)


# ---- profiling

@register
def dataset_overview(spark, sf_dir):
    return profile.dataset_overview(raw(spark, sf_dir))


@register
def missing_report(spark, sf_dir):
    return comparable(profile.missing_report(raw(spark, sf_dir)).drop("n_rows"))


@register
def missing_info(spark, sf_dir):
    return comparable(profile.missing_info(raw(spark, sf_dir)))


@register
def describe(spark, sf_dir):
    return comparable(profile.describe(raw(spark, sf_dir)))


@register
def scale_before_after(spark, sf_dir):
    p = prepared(spark, sf_dir)
    return comparable(profile.scale_before_after(p.preprocessor.log_only(p.cleaned), p.scaled, FEATURES))


@register
def skewness_info(spark, sf_dir):
    return comparable(profile.skewness_info(prepared(spark, sf_dir).cleaned, FEATURES))


@register
def very_skewed(spark, sf_dir):
    return comparable(profile.very_skewed(raw(spark, sf_dir)))


@register
def outlier_info(spark, sf_dir):
    return comparable(profile.outlier_info(raw(spark, sf_dir)))


@register
def correlation_matrix(spark, sf_dir):
    return comparable(profile.correlation_matrix(raw(spark, sf_dir)))


@register
def top_correlations(spark, sf_dir):
    return comparable(profile.top_correlations(raw(spark, sf_dir)))


@register
def column_profile(spark, sf_dir):
    return comparable(profile.column_profile(raw(spark, sf_dir)))


@register
def value_counts(spark, sf_dir):
    return comparable(profile.value_counts(raw(spark, sf_dir), LABEL_COLUMN))


@register
def histogram(spark, sf_dir):
    return comparable(profile.histogram(raw(spark, sf_dir)))


@register
def histogram_before_after(spark, sf_dir):
    p = prepared(spark, sf_dir)
    return comparable(profile.histogram_before_after(p.preprocessor.log_only(p.cleaned), p.scaled, FEATURES))


@register
def box_stats(spark, sf_dir):
    return comparable(profile.box_stats(raw(spark, sf_dir)))


@register
def feature_ranges(spark, sf_dir):
    return comparable(profile.feature_ranges(prepared(spark, sf_dir).cleaned, FEATURES))


# ---- projection, cleaning, transformation, scaling

@register
def select_features(spark, sf_dir):
    return comparable(prep.select_features(raw(spark, sf_dir)))


@register
def inf_to_null(spark, sf_dir):
    return comparable(prep.inf_to_null(raw(spark, sf_dir), FEATURES))


@register
def clean_drop(spark, sf_dir):
    return comparable(prep.drop_missing(prep.inf_to_null(raw(spark, sf_dir), FEATURES), FEATURES, LABEL_COLUMN))


@register
def clean_fill_mean(spark, sf_dir):
    return comparable(prep.clean(raw(spark, sf_dir), FEATURES, LABEL_COLUMN, "mean"))


@register
def clean_fill_median(spark, sf_dir):
    return comparable(prep.clean(raw(spark, sf_dir), FEATURES, LABEL_COLUMN, "median"))


@register
def deduplicate(spark, sf_dir):
    return comparable(cleaned(spark, sf_dir))


@register
def clean_report(spark, sf_dir):
    return comparable(prep.clean_report(raw(spark, sf_dir), cleaned(spark, sf_dir)))


@register
def skewed_features(spark, sf_dir):
    names = prep.skewed_features(prepared(spark, sf_dir).cleaned, FEATURES)
    return spark.createDataFrame([(f,) for f in names], "feature string")


@register
def log_shifts(spark, sf_dir):
    return comparable(prep.log_shifts(prepared(spark, sf_dir).cleaned, FEATURES))


@register
def log_transform(spark, sf_dir):
    p = prepared(spark, sf_dir)
    return comparable(prep.log_transform(p.cleaned.drop("flow_id")))


def _scaled(scaler: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = prepared(spark, sf_dir).cleaned.drop("flow_id")
        return comparable(prep.fit(table, FEATURES, apply_log=False, scaler=scaler).transform(table))
    query.__name__ = f"scale_{scaler}"
    return register(query)


scale_standard, scale_minmax, scale_robust, scale_none = map(_scaled, ("standard", "minmax", "robust", "none"))


@register
def preprocess(spark, sf_dir):
    return comparable(prep.preprocess(raw(spark, sf_dir), CONFIG).scaled)


@register
def preprocess_parameters(spark, sf_dir):
    return comparable(_parameter_rows(prepared(spark, sf_dir).preprocessor.table(spark)))


def _parameter_rows(table: DataFrame) -> DataFrame:
    return table.selectExpr("feature", "ordinal", "cast(log as int) as log", "shift", "center", "scale")


@register
def transform_new(spark, sf_dir):
    new = flows(spark, sf_dir, with_id=True)
    routed = prepared(spark, sf_dir).preprocessor.transform_new(new.drop(LABEL_COLUMN), on_bad="route")
    return comparable(routed.selectExpr("flow_id", *map(q, FEATURES), "array_join(reasons, '; ') as reasons"))


# ---- clustering

def _centroid_rows(spark: SparkSession, trained: kmeans.Sweep) -> DataFrame:
    return comparable(trained.centroid_table(spark).selectExpr("k", "cluster", "size", "posexplode(center) as (ordinal, value)"))


@register
def train_kmeans(spark, sf_dir):
    """One k with all restarts; starts of its own, so without SQL."""
    model = kmeans.train_kmeans(prepared(spark, sf_dir).scaled, FEATURES, TRAINED_K)
    return _centroid_rows(spark, kmeans.Sweep({TRAINED_K: model}))


@register
def train_multiple_k(spark, sf_dir):
    return _centroid_rows(spark, sweep(spark, sf_dir))


@register
def training_summary(spark, sf_dir):
    return comparable(sweep(spark, sf_dir).summary_table(spark))


@register
def train_seeded_sweep(spark, sf_dir):
    """All k with all restarts; starts of its own, so without SQL."""
    return _centroid_rows(spark, seeded_sweep(spark, sf_dir))


@register
def assign_clusters(spark, sf_dir):
    return kmeans.assign_clusters(prepared(spark, sf_dir).scaled, FEATURES, given_centers(spark, sf_dir)).select("flow_id", "cluster")


@register
def lloyd_step(spark, sf_dir):
    """Centroids and error after one iteration from the given centroids."""
    scaled = prepared(spark, sf_dir).scaled
    moved = kmeans.one_step(scaled, FEATURES, given_centers(spark, sf_dir))
    return comparable(moved)


# ---- evaluation

def _given_sample(spark, sf_dir) -> DataFrame:
    return evaluate.evaluation_sample(given_scaled(spark, sf_dir), rank=RANK_SQL)


@register
def silhouette(spark, sf_dir):
    return comparable(evaluate.silhouette(_given_sample(spark, sf_dir), FEATURES).select("silhouette"))


@register
def davies_bouldin(spark, sf_dir):
    return comparable(evaluate.davies_bouldin(_given_sample(spark, sf_dir), FEATURES))


@register
def calinski_harabasz(spark, sf_dir):
    return comparable(evaluate.calinski_harabasz(_given_sample(spark, sf_dir), FEATURES))


@register
def inertia(spark, sf_dir):
    return comparable(kmeans.inertia(given_scaled(spark, sf_dir), FEATURES, given_centers(spark, sf_dir)))


@register
def evaluate_k(spark, sf_dir):
    return comparable(metrics(spark, sf_dir))


@register
def compare_clusterings(spark, sf_dir):
    return comparable(embedding_metrics(spark, sf_dir))


@register
def best_k(spark, sf_dir):
    return evaluate.best_k(embedding_metrics(spark, sf_dir))


@register
def metric_winners(spark, sf_dir):
    return comparable(evaluate.metric_winners(embedding_metrics(spark, sf_dir)))


@register
def elbow_series(spark, sf_dir):
    return comparable(evaluate.elbow_series(metrics(spark, sf_dir)))


# ---- dimensionality reduction

def given_components() -> list[list[float]]:
    """Two unit-length, orthogonal components of equal weights, the second with alternating signs."""
    weight = 0.2041241452319315  # 1 / sqrt(24)
    return [[weight] * len(FEATURES), [weight if i % 2 == 0 else -weight for i in range(len(FEATURES))]]


def _pca(spark, sf_dir) -> project.PCAModel:
    return once("pca", spark, sf_dir, lambda: project.given_pca(prepared(spark, sf_dir).scaled, FEATURES, given_components()))


@register
def pca_project(spark, sf_dir):
    return comparable(project.pca_project(prepared(spark, sf_dir).scaled, _pca(spark, sf_dir)).select("flow_id", "PC1", "PC2"))


@register
def pca_explained_variance(spark, sf_dir):
    return comparable(project.pca_explained_variance(spark, _pca(spark, sf_dir)))


@register
def pca_scatter(spark, sf_dir):
    return comparable(project.pca_scatter(given_scaled(spark, sf_dir), _pca(spark, sf_dir), rank=RANK_SQL))


# ---- interpretation

@register
def cluster_distribution(spark, sf_dir):
    return comparable(interpret.cluster_distribution(given(spark, sf_dir)))


@register
def cluster_summary(spark, sf_dir):
    return comparable(interpret.cluster_summary(given(spark, sf_dir), FEATURES).drop("ordinal"))


@register
def cluster_profiles(spark, sf_dir):
    return comparable(interpret.cluster_profiles(given(spark, sf_dir), FEATURES))


@register
def profile_zscores(spark, sf_dir):
    return comparable(interpret.profile_zscores(interpret.cluster_summary(given(spark, sf_dir), FEATURES)).drop("ordinal"))


@register
def dominant_features(spark, sf_dir):
    return comparable(interpret.dominant_features(interpret.cluster_summary(given(spark, sf_dir), FEATURES)))


@register
def cluster_narrative(spark, sf_dir):
    table = given(spark, sf_dir)
    told = interpret.cluster_narrative(interpret.cluster_summary(table, FEATURES), interpret.cluster_distribution(table))
    return told.selectExpr("cluster", "count", "array_join(tags, ', ') as tags", "text")


@register
def anomaly_flags(spark, sf_dir):
    table = given(spark, sf_dir)
    flags = interpret.anomaly_flags(interpret.cluster_summary(table, FEATURES), interpret.cluster_distribution(table))
    return comparable(flags.selectExpr(
        "cluster", "severity", "share", "n_deviating", "array_join(deviating_features, ', ') as deviating_features"))


@register
def label_by_cluster(spark, sf_dir):
    return interpret.label_by_cluster(given(spark, sf_dir), LABEL_COLUMN)


@register
def label_crosstab(spark, sf_dir):
    return interpret.label_crosstab(given(spark, sf_dir), LABEL_COLUMN)


# ---- scoring new flows

def _scored(spark, sf_dir) -> DataFrame:
    return score.score_flows(
        flows(spark, sf_dir, with_id=True), prepared(spark, sf_dir).preprocessor, given_centers(spark, sf_dir), on_bad="route")


def _score_rows(scored: DataFrame) -> DataFrame:
    return comparable(scored.selectExpr(
        "flow_id", "cluster", "nearest_distance", *[f"distances[{i}] as distance_{i}" for i in range(GIVEN_K)]))


@register
def score_flows(spark, sf_dir):
    return _score_rows(_scored(spark, sf_dir))


@register
def distance_ranking(spark, sf_dir):
    return comparable(score.distance_ranking(_scored(spark, sf_dir), ["flow_id"]).withColumn("rank", F.expr("cast(rank as bigint)")))


@register
def score_context(spark, sf_dir):
    about = given_about(spark, sf_dir)
    told = score.score_context(
        _scored(spark, sf_dir).where("cluster is not null"), ["flow_id"], about["distribution"], about["flags"], about["narrative"], about["dominant"])
    return comparable(told.withColumns({"reasons": F.expr("cast(size(reasons) as int)"), "dominant": F.expr("array_join(dominant, ', ')")}))


@register
def preset_flows(spark, sf_dir):
    p = prepared(spark, sf_dir)
    presets = score.preset_flows(p.cleaned, given_about(spark, sf_dir)["summary"], FEATURES, [1, GIVEN_K - 1])
    return comparable(score.score_flows(presets, p.preprocessor, given_centers(spark, sf_dir)).drop("distances"))


@register
def score_stream_query(spark, sf_dir):
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    stream = spark.readStream.schema(lineitem).option("pathGlobFilter", "lineitem.parquet").parquet(sf_dir)
    scored = score_stream(flows_from(stream, with_id=True), prepared(spark, sf_dir).preprocessor, given_centers(spark, sf_dir))
    return _score_rows(spark.read.schema(scored.schema).parquet(write_scores(scored)))


@register
def score_stream_bundle(spark, sf_dir):
    """The stream scored by the newest version of a bundle, read anew for each micro-batch."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    stream = spark.readStream.schema(lineitem).option("pathGlobFilter", "lineitem.parquet").parquet(sf_dir)
    with shared_or_removed(spark, sf_dir):
        bundle = _bundle(spark, sf_dir)
    scored = spark.read.parquet(score_with_bundle(flows_from(stream, with_id=True), bundle, keep=["flow_id"]))
    return _score_rows(scored.where("model_version is not null"))


# ---- the same operators on other tables: five strata, a skewness near its threshold, a negative minimum

@register
def stratified_orders(spark, sf_dir):
    """A quarter of the orders, proportional by priority."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return comparable(sampling.stratified_sample(orders, orders.count() // 4, "o_orderpriority", rank=ORDERS_RANK_SQL))


@register
def event_skewness(spark, sf_dir):
    return comparable(profile.skewness_info(spark.read.parquet(f"{sf_dir}/events.parquet"), ["value"]))


@register
def event_values(spark, sf_dir):
    return comparable(profile.value_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type"))


@register
def customer_balances(spark, sf_dir):
    """Balances moved above zero and logged; their lowest one is negative."""
    balances = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal")
    return comparable(prep.log_transform(balances, ["c_acctbal"]))


@register
def symmetric_columns(spark, sf_dir):
    return comparable(profile.skewness_info(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_quantity", "l_discount", "l_tax"]))


for _name in [n for n in _REGISTRY if n.endswith("_query")]:
    _REGISTRY[_name.removesuffix("_query")] = _REGISTRY.pop(_name)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of a trained model with size, flag, description: one row per cluster."""
    short_methods(spark)
    p = prepared(spark, sf_dir)
    model = kmeans.train_kmeans(p.scaled, FEATURES, n_init=3)
    about = profile_clusters(assign_cleaned(p, model.centers), FEATURES, CONFIG)
    return about["distribution"].join(about["flags"].drop("share"), "cluster", "left").join(about["narrative"].select("cluster", "text"), "cluster").orderBy("cluster")
