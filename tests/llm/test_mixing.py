"""Sainte-Laguë quotas and the mix against plain Python."""

import heapq
import random
import re

import pytest
from pyspark.sql import functions as F

from flowprofile.llm import mixing


def one_by_one(shares, seats, caps):
    given = [0] * len(shares)
    queue = [(-s, i) for i, s in enumerate(shares) if s > 0 and caps[i] > 0]
    heapq.heapify(queue)
    while seats and queue:
        _, i = heapq.heappop(queue)
        given[i] += 1
        seats -= 1
        if given[i] < caps[i]:
            heapq.heappush(queue, (-shares[i] / (2 * given[i] + 1), i))
    return given


@pytest.mark.parametrize("seed", range(40))
def test_seats_go_to_the_highest_quotients(seed):
    rng = random.Random(seed)
    shares = [rng.choice([0, 1, 1, 2, 3.5, 10, 1000, rng.random() * 50]) for _ in range(rng.randrange(1, 9))]
    seats = rng.randrange(0, 400)
    caps = [rng.choice([0, 3, 10**6]) for _ in shares]
    assert mixing.sainte_lague(shares, seats, caps) == one_by_one(shares, seats, caps)


def test_many_seats_and_ties():
    assert mixing.sainte_lague([1, 1, 1], 4, [9, 9, 9]) == [2, 1, 1]
    given = mixing.sainte_lague([1, 2, 3], 6 * 10**12, [10**15] * 3)
    assert given == [10**12, 2 * 10**12, 3 * 10**12]
    assert mixing.sainte_lague([], 5, []) == [] and mixing.sainte_lague([0.0], 5, [9]) == [0]


def test_targets_share_the_excess():
    targets = mixing.share_targets([10, 100, 890, 0], [1, 2, 3, 1])
    assert targets[0] == 30 and targets[1] == 300 and targets[2] == pytest.approx(670) and targets[3] == 0
    assert mixing.share_targets([], []) == [] and mixing.share_targets([0, 0], [1, 1]) == [0, 0]


def corpus(seed):
    rng = random.Random(seed)
    sources = [None, "b", "a", "Z", "é", "hot"]
    rows = []
    for i in range(700):
        n = rng.choice([0, 1, 5, 40, rng.randrange(300)])
        rows.append((i, " ".join(f"w{k}" for k in range(n)) + rng.choice(["", "\n", "\x0b "]), "hot" if rng.random() < 0.6 else rng.choice(sources), "clash"))
    return [*rows, rows[3], rows[3], (None, "no id here", "a", "c"), (9001, None, None, "c"), (9002, "word " * 30_000, "b", "c")]


@pytest.mark.parametrize("shard_docs", [4096, 25])
def test_mix(spark, monkeypatch, shard_docs):
    monkeypatch.setattr(mixing, "SHARD_DOCS", shard_docs)
    rows = corpus(1)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(7)
    mix = lambda d: mixing.mix(d, keep=("doc_id", "source")).select("row.*", "size", "source_size", "target", "taken")
    got = mix(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id or -1, r["size"]) for r in got) == sorted((d or -1, size(t)) for d, t, _, _ in rows)
    names = sorted({s for _, _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(t) for _, t, s, _ in rows if s == name) for name in names]
    targets = mixing.share_targets(sizes, [(1, 2, 3)[i % 3] for i in range(len(names))])
    assert sum(targets) == pytest.approx(sum(sizes))
    for name, words, target in zip(names, sizes, targets, strict=True):
        own = [r for r in got if r.source == name]
        assert {(r.source_size, r.target) for r in own} == {(words, target)}
        assert all(0 <= r.taken <= 3 * r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - target) <= max(3 * len(own) / shard_docs + 3, 0.005 * target)
    # Reruns and other partitionings agree.
    assert sorted(map(repr, got)) == sorted(map(repr, mix(df.repartition(3, "text")).collect()))


def test_apply_mix_repeats_whole_documents(spark):
    df = spark.createDataFrame([(1, "a b c d", "x", "k")] * 2 + [(2, "", "x", "k"), (3, None, None, "k")], "doc_id long, text string, source string, taken string")
    out = mixing.apply_mix(mixing.mix(df, keep=df.columns))
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 1]


def test_empty_table_and_empty_texts(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    rows = mixing.mix(spark.createDataFrame([(1, "", "a"), (2, " \n", None)], schema)).collect()
    assert [(r["size"], r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2


def test_sources_beyond_the_broadcast_bound(spark, monkeypatch):
    df = spark.createDataFrame(corpus(2)[:200], "doc_id long, text string, source string, size string")
    rows = lambda: sorted(map(repr, mixing.mix(df).select("row.doc_id", "size", "taken").collect()))
    broadcast = rows()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert rows() == broadcast
