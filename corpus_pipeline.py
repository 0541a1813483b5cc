"""Corpus pipeline: toxic documents go, one document of each near-duplicate group stays, sources are mixed to target weights, texts become token ids.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; its result is written as Parquet and read again as the next one's
docs. All but the last return the columns of `documents`. Stages keep no state beyond what they write to the shared folder, so a lost executor repeats only
its own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowprofile.functions.storage import materialize_at, new_path, scratch
from flowprofile.llm import bpe, mixing, simhash, toxicity
from flowprofile.llm.common import materialize, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; learned from the labels that are not held out."""
    model = toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"), where=toxicity.learned_from())
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of texts whose five-word shingles have a similarity of 0.8 or more."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, in whole documents."""
    return mixing.apply_mix(mixing.mix(docs, keep=docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document instead of its text, with the digests of the ids and of the text they decode to."""
    made = {"text", "n_tokens", "ids", "ids_sha256", "decoded_sha256"}
    return bpe.round_trip(docs, keep=[c for c in docs.columns if c not in made])


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("mix", mix_sources), ("encode", encode)]

#: Trained weights, trees and ranked merges have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`; what they write on the way is removed once the result is written."""
    result = new_path(spark, STAGES[-1][0])
    with scratch(spark):
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for name, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir), name)
        return materialize_at(STAGES[-1][1](spark, docs, sf_dir), result)
