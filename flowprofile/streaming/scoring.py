"""The batch scoring projection on a streaming DataFrame.

Scoring is stateless: no watermark, no state store. `score_stream` fixes parameters and centroids when the stream starts; `score_with_bundle` reads the newest
version of a model bundle for each micro-batch, so that a model can be replaced while the stream runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowprofile.functions.columns import q
from flowprofile.functions.storage import new_path
from flowprofile.sources.bundle import load_bundle
from flowprofile.operators.prep import FittedPreprocessor
from flowprofile.operators.score import RESULT, score_flows


def score_stream(stream: DataFrame, preprocessor: FittedPreprocessor, centers: Sequence[Sequence[float]]) -> DataFrame:
    """Streaming flows in, scored flows out; rows that cannot be scored keep their `reasons` instead of failing the query."""
    if not stream.isStreaming:
        raise ValueError("score_stream takes a streaming DataFrame; use score_flows for a batch")
    return score_flows(stream, preprocessor, centers, on_bad="route")


def write_scores(scored: DataFrame, path: str | None = None, checkpoint: str | None = None) -> str:
    """Run the stream over everything available now into Parquet; returns the output folder.

    The file sink commits each micro-batch once, so a restart from the same checkpoint neither loses nor repeats rows.
    """
    spark = scored.sparkSession
    path = path or new_path(spark, "scored")
    checkpoint = checkpoint or new_path(spark, "stream-checkpoint")
    query = scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return path


def write_batch(batch: DataFrame, batch_id: int, bundle: str, path: str, keep: Sequence[str] | None = None) -> None:
    """Score one micro-batch by the newest version of the bundle and write it, with the version, as the folder of its number.

    A batch that is repeated after a failure replaces what it wrote before, so no row counts twice, and all its rows are of one version. `keep` names the columns of the
    flows that are written beside the scores, where not all of them are.
    """
    model = load_bundle(batch.sparkSession, bundle)
    if model.preprocessor is None:
        raise ValueError("the bundle has no preprocessor")
    scored = score_flows(batch, model.preprocessor, model.model.centers, on_bad="route")
    if keep is not None:
        scored = scored.select(*map(q, keep), *RESULT, "reasons")
    scored.withColumn("model_version", F.lit(model.version)).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch_id={batch_id}")


def score_with_bundle(stream: DataFrame, bundle: str, path: str | None = None, checkpoint: str | None = None, keep: Sequence[str] | None = None) -> str:
    """Score everything available now, each micro-batch by the bundle's newest version at that moment; returns the output folder, partitioned by batch_id.

    Started again from the same checkpoint it goes on where it stood, by then with newer versions. `keep`: see `write_batch`.
    """
    spark = stream.sparkSession
    path = path or new_path(spark, "scored")
    query = (
        stream.writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, bundle, path, keep))
        .option("checkpointLocation", checkpoint or new_path(spark, "stream-checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return path
