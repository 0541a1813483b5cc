"""Toxicity classifier: held-out accuracy, the counterfactual penalty, and defined results for odd inputs."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowprofile.llm import toxicity

FOLDER = "/root/testdata/sf0.1"
INSULTS = ["idiot", "moron", "scum"]
PLAIN = [f"word{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]


def labelled(seed, n=400):
    """Invented sentences in which toxic ones name one group far more often."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        words = [rng.choice(PLAIN) for _ in range(rng.randrange(8, 60))]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(INSULTS)
        if rng.random() < (0.8 if toxic else 0.05):
            words.append("muslims")
        docs.append((i, " ".join(words) + ".", "s"))
        labels.append((i, int(toxic)))
    return docs, labels


def fit(spark, docs, labels, **options):
    return toxicity.fit_toxicity(
        spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int"), **options)


def test_held_out_accuracy(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit_toxicity(documents, labels, where=toxicity.learned_from())
    rows = toxicity.score_documents(documents, model).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows) and len(rows) > 1000
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    scores, toxic = np.array([r.score for r in rows]), np.array([r.toxic == 1 for r in rows])
    above = (scores[toxic][:, None] > scores[~toxic]).mean()
    hits = np.array([r.predicted == 1 for r in rows])
    assert above > 0.97
    assert (hits & toxic).sum() / hits.sum() > 0.95 and (hits & toxic).sum() / toxic.sum() > 0.85


def test_penalty_lowers_what_a_group_mention_does(spark):
    docs, labels = labelled(1)
    gap = {}
    for penalty in (0.0, toxicity.COUNTERFACTUAL):
        scorer = toxicity.Scorer(fit(spark, docs, labels, counterfactual=penalty))
        raw = lambda t: math.log(scorer.score(t) / (1 - scorer.score(t)))  # noqa: E731, B023
        texts = [" ".join(PLAIN[i : i + 12]) for i in range(0, 48, 12)]
        gap[penalty] = np.mean([raw(t + " muslims") - raw(t + " christians") for t in texts])
        assert all(scorer.score(f"{t} {i}") > 0.5 for t in texts for i in INSULTS)
        if penalty:
            assert all(scorer.score(t + " muslims") < 0.5 for t in texts)
    assert gap[0.0] > 0 and gap[toxicity.COUNTERFACTUAL] < 0.5 * gap[0.0]


def test_counterfactual_pairs():
    ((gone, come),) = toxicity.counterfactuals("Muslims came. Nobody else. ", toxicity.swaps())
    assert "=muslims" in gone and "=christians" in come and not any("came" in f for f in gone | come)
    assert toxicity.counterfactuals("no group here", toxicity.swaps()) == []
    swap = toxicity.swaps((("a", "b", "c"),))
    assert swap == {"a": "b", "b": "c", "c": "a"}


def test_scorer_agrees_with_the_definition(spark):
    model = fit(spark, *labelled(2))
    scorer = toxicity.Scorer(model)
    for text in ["", "idiot", "wordaa wordab idiot idiot", "IDIOT, " + "wordba " * 3000]:
        words = toxicity.text_words(text)
        raw = model.intercept
        for feature, n in toxicity.text_features(words).items():
            occurs, dense = model.weights.get(feature, (0.0, 0.0))
            raw += occurs + dense * toxicity.density(n, len(words))
        assert scorer.score(text) == pytest.approx(1 / (1 + math.exp(-max(-60, min(60, raw)))))


def test_odd_rows_have_defined_scores(spark):
    docs, labels = labelled(3)
    model = fit(spark, docs, [*labels, (None, 1), (5, None), (5, 0), (999, 1)])
    odd = [(1, None, "x"), (2, "", "x"), (3, "idiot", "x"), (3, "idiot", "x"), (None, "wordaa", "x"), (4, "wordaa " * 100_000, "x")]
    rows = toxicity.score_documents(spark.createDataFrame(odd, "doc_id long, text string, score string"), model).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == len(odd) and by_id[1].score == by_id[2].score < 0.7
    assert by_id[None].held_out is False
    assert [r.score for r in rows if r.doc_id == 3] == [by_id[3].score] * 2


def test_nothing_or_one_kind_to_learn_from(spark):
    docs, _ = labelled(4, 20)
    assert toxicity.Scorer(fit(spark, docs, [])).score("any") == 0.0
    assert toxicity.Scorer(fit(spark, [], [])).score("") == 0.0
    assert toxicity.Scorer(fit(spark, docs, [(1, 1), (2, 1)])).score("any") == 1.0
    assert toxicity.Scorer(fit(spark, docs, [(1, 0)])).score("any") == 0.0
    assert toxicity.score_documents(spark.createDataFrame([], "doc_id long, text string"), toxicity.ToxicityModel({}, 0.0, 0.0)).count() == 0


def test_labels_out_of_sight_are_not_used(spark):
    docs, labels = labelled(5)
    seen = [(d, y) for d, y in labels if zlib.crc32(str(d).encode()) % 3 != 1]
    flipped = [(d, y if zlib.crc32(str(d).encode()) % 3 != 1 else 1 - y) for d, y in labels]
    assert fit(spark, docs, seen) == fit(spark, docs, flipped, where=toxicity.learned_from())


def test_drop_toxic_keeps_columns(spark):
    docs, labels = labelled(6)
    model = fit(spark, docs, labels)
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns
    toxic = {d for d, y in labels if y}
    left = {r.doc_id for r in kept.select("doc_id").collect()}
    assert len(left & toxic) <= 0.1 * len(toxic) and len(left - toxic) >= 0.97 * (len(docs) - len(toxic))
    assert df.where(F.lit(False)).transform(lambda d: toxicity.drop_toxic(d, model)).count() == 0
