"""Model bundle: centroid table, parameter table and one-row metadata, as Parquet folders of one version; a table names the versions."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from flowprofile.operators.kmeans import KMeansModel, Sweep
from flowprofile.operators.prep import FittedPreprocessor


@dataclass(frozen=True)
class Bundle:
    model: KMeansModel
    preprocessor: FittedPreprocessor | None
    metadata: dict[str, Any]
    version: str = ""


def save_bundle(spark: SparkSession, path: str, model: KMeansModel, preprocessor: FittedPreprocessor | None = None, metadata: dict | None = None) -> str:
    """Write the three tables as a new version below `path`; it counts from the moment its row is added to the table of versions, which comes last.

    A reader never meets tables of two models. Values JSON does not know are stored as text.
    """
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    folder = f"{path}/{version}"
    Sweep({model.k: model}).centroid_table(spark).coalesce(1).write.parquet(f"{folder}/centroids")
    parameters = preprocessor.table(spark) if preprocessor else FittedPreprocessor(()).table(spark)
    parameters.coalesce(1).write.parquet(f"{folder}/parameters")
    row = (model.k, list(model.features), model.inertia, model.n_iter, json.dumps(metadata or {}, default=str))
    spark.createDataFrame([row], "k int, features array<string>, inertia double, n_iter int, metadata string").coalesce(1).write.parquet(f"{folder}/metadata")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return path


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    """The newest complete version written by `save_bundle`."""
    version = spark.read.parquet(f"{path}/versions").agg(F.max("version")).first()[0]
    folder = f"{path}/{version}"
    about = spark.read.parquet(f"{folder}/metadata").first()
    rows = spark.read.parquet(f"{folder}/centroids").orderBy("cluster").collect()
    model = KMeansModel(
        about["k"], tuple(about["features"]), tuple(tuple(r["center"]) for r in rows), tuple(r["size"] for r in rows),
        about["inertia"], about["n_iter"])
    preprocessor = FittedPreprocessor.from_table(spark.read.parquet(f"{folder}/parameters"))
    return Bundle(model, preprocessor if preprocessor.parameters else None, json.loads(about["metadata"]), version)
