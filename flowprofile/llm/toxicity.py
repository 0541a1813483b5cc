"""Toxicity classifier with a counterfactual penalty on identity terms.

A logistic regression over the words and word beginnings of a text: whether each occurs, and how densely (a rare beginning may be chance in
a long text, and a habit when every fiftieth word has it). Besides the label loss it is trained on counterfactual pairs: a labelled sentence and the same sentence with an identity term swapped for another of its group. The penalty is the squared
difference of the two raw scores, so naming a group moves the score as little as naming any other, or none. Sentences of the corpus that
name no group get pairs too: each lexicon term put into a carrier sentence against the group's neutral term.

Fitting uses a bounded sample of labelled rows (`SAMPLE`, a parameter: those of the lowest hash of the id), of which tasks extract features and Spark
counts them; the driver holds the chosen features (`FEATURES`) and the sample's rows as positions in them, and fits the weights. Scoring reads every
text whole in one narrow pass with the fitted weights (bounded by `FEATURES`), with no shuffle.

Null and empty texts have no features: their score is that of the intercept. Without labelled rows every score is 0; with labels of one kind only, it
is their share. Rows with a null label or id are not learned from. Labels of one id that differ count as their largest; of texts that share an id one is learned from,
that of the smallest hash. All rows are scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowprofile.llm.common import materialize, text_or_empty, text_udf

SAMPLE = 8000
FEATURES = 4096
MIN_DOCUMENTS = 3
BEGINNINGS = range(3, 9)
#: A feature counts as dense in a text from this share of its words on; used to choose features.
DENSE = 0.01
ROUNDS = 300
L2 = 1e-4
COUNTERFACTUAL = 1.0
THRESHOLD = 0.7
CACHE_WORDS = 60_000
#: Texts whose features a task holds at once while fitting.
TEXTS_AT_ONCE = 32

#: Groups of identity terms; the first of each is its neutral term.
IDENTITY_GROUPS = (
    ("people", "women", "men", "gays", "lesbians", "transgender", "straight", "bisexual", "queer"),
    ("person", "woman", "man", "girl", "boy", "gay", "lesbian", "trans", "mother", "father", "wife", "husband"),
    ("believers", "muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists", "mormons", "sikhs"),
    ("religious", "muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist", "mormon", "sikh"),
    ("citizens", "immigrants", "refugees", "foreigners", "americans", "africans", "asians", "mexicans", "europeans", "arabs"),
    ("local", "black", "white", "asian", "african", "latino", "hispanic", "arab", "american", "european", "chinese", "indian"),
    ("patients", "disabled", "deaf", "blind", "autistic", "elderly", "young", "old"),
    ("menschen", "frauen", "männer", "muslime", "christen", "juden", "ausländer", "flüchtlinge", "schwarze", "schwule", "lesben", "behinderte"),
    ("personnes", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers", "réfugiés", "noirs", "gays", "lesbiennes", "handicapés"),
    ("personas", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros", "refugiados", "negros", "gitanos", "lesbianas", "discapacitados"),
)

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def word_features(word: str) -> tuple[str, ...]:
    """The lower-cased word and its beginnings."""
    return ("=" + word, *("^" + word[:k] for k in BEGINNINGS if len(word) > k))


def text_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def density(count: int, words: int) -> float:
    """Value of a feature that `count` of a text's words have."""
    return math.log1p(100 * count / words)


def text_features(words: Sequence[str]) -> Counter[str]:
    """How many of the words have each feature."""
    found: Counter[str] = Counter()
    for word, n in Counter(words).items():
        for feature in word_features(word):
            found[feature] += n
    return found


def swaps(groups: Sequence[Sequence[str]] = IDENTITY_GROUPS) -> dict[str, str]:
    """Each identity term and the next one of its group."""
    return {term: group[(i + 1) % len(group)] for group in reversed(groups) for i, term in enumerate(group)}


def counterfactuals(text: str, swap: dict[str, str]) -> list[tuple[set[str], set[str]]]:
    """Feature sets that a swap takes from and adds to each sentence naming a group."""
    pairs = []
    for sentence in _SENTENCE.split(text.lower()):
        words = set(_WORD.findall(sentence))
        if named := words & swap.keys():
            before = set().union(*map(word_features, words))
            after = set().union(*map(word_features, (words - named) | {swap[w] for w in named}))
            pairs.append((before - after, after - before))
    return pairs


@dataclass(frozen=True)
class ToxicityModel:
    """Weights by feature (of its occurrence, of its density), and the intercept; `constant` replaces the model where there was nothing to learn."""

    weights: dict[str, tuple[float, float]]
    intercept: float
    constant: float | None = None


class Scorer:
    """Scores texts; the weighted features of words met so far are remembered (bounded)."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model = model
        self.occurs = [w[0] for w in model.weights.values()]
        self.dense = [w[1] for w in model.weights.values()]
        self.place = {f: i for i, f in enumerate(model.weights)}
        self.words: dict[str, tuple[int, ...]] = {}

    def places(self, word: str) -> tuple[int, ...]:
        found = tuple(self.place[f] for f in word_features(word) if f in self.place)
        if len(self.words) < CACHE_WORDS and len(word) <= 64:
            self.words[word] = found
        return found

    def score(self, text: str) -> float:
        if self.model.constant is not None:
            return self.model.constant
        known, hits = self.words.get, Counter()
        words = text_words(text)
        for word, n in Counter(words).items():
            found = known(word)
            if found is None:
                found = self.places(word)
            for i in found:
                hits[i] += n
        raw = self.model.intercept + sum(self.occurs[i] + self.dense[i] * density(hits[i], len(words)) for i in sorted(hits))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, raw))))


@dataclass(frozen=True)
class Sparse:
    """Rows of (column, occurrence value, density value), as flat arrays: 12 bytes an entry."""

    columns: np.ndarray
    occurs: np.ndarray
    dense: np.ndarray
    owner: np.ndarray
    rows: int

    @staticmethod
    def of(columns: Sequence[np.ndarray], occurs: Sequence[np.ndarray], dense: Sequence[np.ndarray]) -> Sparse:
        joined = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts]).astype(kind, copy=False)
        lengths = np.array([len(c) for c in columns], dtype=np.int64)
        return Sparse(joined(columns, np.int32), joined(occurs, np.int8), joined(dense, np.float32), np.repeat(np.arange(len(columns), dtype=np.int32), lengths), len(columns))

    def times(self, occurs: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Per row, the sum of its entries times the weights of their columns."""
        out = np.zeros(self.rows)
        for part in self._parts():
            c = self.columns[part]
            out += np.bincount(self.owner[part], self.occurs[part] * occurs[c] + self.dense[part] * dense[c], minlength=self.rows)
        return out

    def transposed_times(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Per column, the sums over the rows of x times the occurrence and the density values."""
        out = np.zeros((2, width))
        for part in self._parts():
            c, y = self.columns[part], x[self.owner[part]]
            out[0] += np.bincount(c, self.occurs[part] * y, minlength=width)
            out[1] += np.bincount(c, self.dense[part] * y, minlength=width)
        return out[0], out[1]

    def _parts(self) -> Iterator[slice]:
        for at in range(0, len(self.columns), 1 << 20):
            yield slice(at, at + (1 << 20))


def fit_weights(
    rows: Sparse, labels: np.ndarray, pairs: Sparse, width: int, *, rounds: int = ROUNDS, l2: float = L2, counterfactual: float = COUNTERFACTUAL
) -> tuple[np.ndarray, float]:
    """Weights (occurrence, density) by feature, and the intercept, by full-batch Adam.

    Both classes weigh the same; the counterfactual penalty is a mean over its pairs.
    """
    y = labels.astype(float)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum()))
    w, b = np.zeros((2, width)), 0.0
    first, second = np.zeros(2 * width + 1), np.zeros(2 * width + 1)
    for step in range(1, rounds + 1):
        error = weight * (1 / (1 + np.exp(-np.clip(b + rows.times(w[0], w[1]), -60, 60))) - y)
        gradient = np.stack(rows.transposed_times(error, width)) + l2 * w
        if pairs.rows:
            gradient += counterfactual / pairs.rows * np.stack(pairs.transposed_times(pairs.times(w[0], w[1]), width))
        whole = np.append(gradient.ravel(), error.sum())
        first = 0.9 * first + 0.1 * whole
        second = 0.999 * second + 0.001 * whole**2
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1].reshape(2, width), b - move[-1]
    return w, float(b)


def fit_toxicity(
    documents: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "toxic", where: Column | None = None, sample: int = SAMPLE,
    features: int = FEATURES, groups: Sequence[Sequence[str]] = IDENTITY_GROUPS, counterfactual: float = COUNTERFACTUAL,
) -> ToxicityModel:
    """Fit on at most `sample` labelled documents; `where` is a condition on the labels' rows."""
    usable = labels.where(where) if where is not None else labels
    chosen = (
        usable.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).dropna().groupBy("_key").agg(F.max("_label").alias("_label"))
        .orderBy(F.xxhash64("_key"), "_key").limit(sample)
    )
    swap = swaps(groups)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), TEXTS_AT_ONCE):
                part = batch.iloc[at : at + TEXTS_AT_ONCE]
                words = [text_words(t) for t in part["_text"]]
                counts = [text_features(w) for w in words]
                yield pd.DataFrame({
                    "label": part["_label"].to_numpy(), "words": [len(w) for w in words], "features": [list(c) for c in counts],
                    "counts": [np.fromiter(c.values(), np.int32, len(c)) for c in counts],
                    "pairs": [[{"gone": sorted(a), "come": sorted(b)} for a, b in counterfactuals(t, swap)] for t in part["_text"]],
                })

    # At most `sample` ids are broadcast; a table of ids bounded by a parameter. Of rows that share an id the text of smallest hash stands for all, combined in
    # the tasks first, so that the sample has `sample` rows at most. Being written fixes the row numbers.
    labelled = documents.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text")).join(F.broadcast(chosen), "_key")
    first = labelled.groupBy("_key").agg(F.first("_label").alias("_label"), F.min(F.struct(F.xxhash64("_text"), "_text")).alias("_first"))
    rows = materialize(
        first.select("_label", F.col("_first._text").alias("_text"))
        .mapInPandas(extract, "label int, words long, features array<string>, counts array<int>, pairs array<struct<gone:array<string>,come:array<string>>>")
        .withColumn("row", F.monotonically_increasing_id()), "toxicity-sample",
    )
    total, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("label") == 1).cast("long")), F.lit(0))).first()
    if not total or toxic in (0, total):
        return ToxicityModel({}, 0.0, toxic / total if total else 0.0)
    # Chi-squared of each feature against the label, by occurrence or by density, whichever says more.
    entries = rows.select("row", "words", (F.col("label") == 1).cast("long").alias("y"), F.explode(F.arrays_zip(F.col("features").alias("f"), F.col("counts").alias("n"))).alias("e")).select(
        "row", "y", "words", "e.f", "e.n"
    )
    counted = entries.withColumn("d", (F.col("n") >= DENSE * F.col("words")).cast("long")).groupBy("f").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("a"), F.sum("d").alias("dn"), F.sum(F.col("d") * F.col("y")).alias("da")
    )

    def chi_squared(n: Column, a: Column) -> Column:
        expected = n * toxic / total
        return F.when(n > 0, (a - expected) ** 2 / (expected * (1 - toxic / total) * (1 - n / (total + 1)))).otherwise(0.0)

    strength = F.greatest(chi_squared(F.col("n"), F.col("a")), chi_squared(F.col("dn"), F.col("da")))
    best = [r["f"] for r in counted.where(F.col("n") >= MIN_DOCUMENTS).select("f", strength.alias("s")).orderBy(F.desc("s"), "f").limit(features).collect()]
    place, width = {f: i for i, f in enumerate(best)}, len(best)

    def gap(gone: Iterable[str], come: Iterable[str]) -> list[tuple[int, int]]:
        return [(place[f], sign) for names, sign in ((gone, 1), (come, -1)) for f in names if f in place]

    # The chosen features are a table of at most `features` rows; the sample as positions in them is bounded by sample x features.
    chosen_features = F.broadcast(documents.sparkSession.createDataFrame(list(place.items()), "f string, i int"))
    found = entries.join(chosen_features, "f").groupBy("row").agg(F.collect_list("i").alias("i"), F.collect_list("n").alias("n"))
    table = rows.select("row", "label", "words").join(found, "row", "left").orderBy("row").toPandas()
    columns = [np.empty(0, np.int32) if i is None else np.asarray(i, np.int32) for i in table["i"]]
    densities = [np.empty(0, np.float32) if n is None else np.log1p(100 * np.asarray(n, float) / w).astype(np.float32) for n, w in zip(table["n"], table["words"], strict=True)]
    samples = Sparse.of(columns, [np.ones(len(c), np.int8) for c in columns], densities)

    @F.pandas_udf("array<binary>")
    def gaps_of(pairs_: pd.Series) -> pd.Series:
        return pd.Series([[np.array(g, dtype=np.int32).tobytes() for p in ps if (g := gap(p["gone"], p["come"]))] for ps in pairs_])

    named = rows.where(F.size("pairs") > 0).select(F.explode(gaps_of("pairs")).alias("g")).toPandas()["g"]
    gaps = [np.frombuffer(g, np.int32).reshape(-1, 2) for g in named]
    for group in groups:
        neutral = set(word_features(group[0]))
        gaps += [np.array(g, np.int32) for term in group[1:] if (g := gap(sorted(set(word_features(term)) - neutral), sorted(neutral - set(word_features(term)))))]
    pairs = Sparse.of([g[:, 0] for g in gaps], [g[:, 1] for g in gaps], [g[:, 1] for g in gaps])
    weights, intercept = fit_weights(samples, (table["label"] == 1).to_numpy(), pairs, width, counterfactual=counterfactual)
    kept = np.flatnonzero(np.abs(weights).max(axis=0) > 1e-3)
    return ToxicityModel({best[i]: (float(weights[0, i]), float(weights[1, i])) for i in kept}, intercept)


def scores(model: ToxicityModel, text: str | Column = "text") -> Column:
    """Column of scores from 0 to 1."""

    def start() -> Callable[[list], pa.Array]:
        scorer = Scorer(model)
        return lambda texts: pa.array([scorer.score(t) for t in texts], pa.float64())

    return text_udf("double", start)(text_or_empty(text))


def learned_from(key: str = "doc_id") -> Column:
    """True for the ids whose labels may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 != 1


def score_documents(documents: DataFrame, model: ToxicityModel, *, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per document. Other columns are dropped, whatever their names. A null id is not held out."""
    return documents.select(
        F.col(key).alias("doc_id"), F.coalesce(~learned_from(key), F.lit(False)).alias("held_out"), scores(model, text).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(documents: DataFrame, model: ToxicityModel, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below the threshold, with their columns."""
    scored = documents.select(F.struct(*[F.col(c) for c in documents.columns]).alias("row"), scores(model, text).alias("score"))
    return scored.where(F.col("score") < threshold).select("row.*")
