"""Suffix arrays, wavelet trees, backward search and the passages found, against brute force."""

import hashlib
import re

import numpy as np
import pytest

from flowprofile.llm import decontaminate, fm_index

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(documents, items, window=10):
    windows = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(name)
    out = []
    for key, text in documents:
        w, hit, found = words(text), set(), set()
        for phrase, names in windows.items():
            for i in range(len(w) - len(phrase) + 1):
                if tuple(w[i : i + len(phrase)]) == phrase:
                    hit |= set(range(i, i + len(phrase)))
                    found |= names
        listed = ",".join(sorted(str(n) for n in found if n is not None))
        out.append((key, len(w), len(hit), len(found - {None}), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("text", [[0], [1, 0], [3, 3, 3, 0, 3, 3, 0, 0], [1, 2, 1, 2, 1, 2, 0, 1, 2, 1, 2, 0], list(np.random.default_rng(1).integers(1, 4, 200)) + [0]])
def test_suffix_array_and_search(text):
    text = np.array(text, dtype=np.int64)
    order = fm_index.suffix_array(text)
    zeros = np.cumsum(text == 0)
    key = lambda i: [(0, int(zeros[j])) if text[j] == 0 else (1, int(text[j])) for j in range(i, len(text))]
    assert order.tolist() == sorted(range(len(text)), key=key)
    index = fm_index.FMIndex(text, 6, sample=5)
    for size in (1, 2, 3):
        phrases = np.array(np.meshgrid(*[[1, 2, 3, 4]] * size)).reshape(size, -1).T
        low, high, which = index.search(phrases)
        got = {tuple(phrases[k]): sorted(index.locate(np.arange(a, b)).tolist()) for a, b, k in zip(low, high, which)}
        want = {}
        for i in range(len(text) - size + 1):
            if (text[i : i + size] > 0).all():
                want.setdefault(tuple(text[i : i + size]), []).append(i)
        assert got == {k: v for k, v in want.items()}


DOCUMENTS = [
    (1, None), (2, ""), (3, " ...\n"), (4, LONG), (5, f"x {LONG.upper()}! y"), (6, f"{LONG} {LONG} tail"), (7, "alpha beta gamma"), (8, "Short, item"), (9, "short short item item"),
    (10, " ".join([LONG] * 300)), (4, LONG), (None, "a short item b short\x00item"), (11, "é É ß1 2ß"), (12, "one " * 40_000), (13, " ".join(LONG.split()[:10]) + " other " + " ".join(LONG.split()[2:12])),
]
ITEMS = [(7, LONG), (10, "short ITEM"), (10, "É ß1"), (9, " ".join(LONG.split()[1:12])), (None, "beta gamma"), (3, None), (4, ""), (5, " ; "), (8, "short item"), (7, LONG)]


@pytest.mark.parametrize("wave_words", [decontaminate.WAVE_WORDS, 12])
def test_passages_match_brute_force(spark, monkeypatch, wave_words):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 64)
    documents = spark.createDataFrame([(k, t, "x", 0) for k, t in DOCUMENTS], "doc_id long, text string, spans string, n_words int").repartition(3)
    items = spark.createDataFrame([(k, t, "x") for k, t in ITEMS], "item_id long, text string, _text string")
    got = decontaminate.contamination(decontaminate.find_passages(documents, items, wave_words=wave_words)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(DOCUMENTS, ITEMS)))


def test_no_items_and_no_documents(spark):
    documents = spark.createDataFrame(DOCUMENTS, "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert not decontaminate.contamination(decontaminate.find_passages(documents, none)).where("contaminated or n_items > 0").count()
    assert decontaminate.find_passages(documents.limit(0), documents.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_cut_texts_lose_their_passages(spark):
    documents = spark.createDataFrame([(1, f"Before: {LONG.title()}. After", "k"), (2, "clean Text", None), (3, None, "n")], "doc_id long, text string, row string")
    items = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    got = {r["doc_id"]: (r["text"], r["row"]) for r in decontaminate.cut_passages(documents, items).collect()}
    assert got == {1: ("Before: . After", "k"), 2: ("clean Text", None), 3: (None, "n")}
