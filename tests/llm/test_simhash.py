"""Fingerprints, BK-trees, shards, components and near-duplicate groups against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from flowprofile.llm import simhash
from flowprofile.llm.components import components

ODD = [None, "", " \t\n", "One", "one", "two words", "a b c", "A B C d", "x " * 40_000, "é É ß\x0bb\x0cc d", "a b c"]


def shingles(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    if not words:
        return []
    return [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if len(words) >= k else [b" ".join(words)]


def plain_fingerprint(text, k=3):
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, k)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(n, linked):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def table(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "f") for i, t in enumerate(texts)], "doc_id long, text string, fp string")


def test_fingerprints_match_plain_python(spark):
    got = table(spark, ODD).select("doc_id", simhash.as_hex(simhash.fingerprints("text")).alias("h")).collect()
    assert {r.doc_id: r.h for r in got} == {i: f"{plain_fingerprint(t):016x}" for i, t in enumerate(ODD)}
    assert got[0].h == "0" * 16


def test_long_texts_are_counted_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(500))
    whole = simhash.fingerprint(simhash.shingle_hashes(text, 3))
    monkeypatch.setattr(simhash, "_CHUNK", 7)
    assert simhash.fingerprint(simhash.shingle_hashes(text, 3)) == whole


@pytest.mark.parametrize("radius", [0, 3, 18])
def test_tree_finds_all_within_the_radius(radius):
    rng = random.Random(radius)
    centre = rng.getrandbits(64)
    values = [rng.getrandbits(64) if rng.random() < 0.3 else centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(9))) & (2**64 - 1) for _ in range(300)]
    tree = simhash.BKTree(radius)
    for i, v in enumerate(values):
        tree.add(v, i)
    for v in values[:60]:
        assert sorted(tree.within(v)) == [i for i, w in enumerate(values) if (v ^ w).bit_count() <= radius]


@pytest.mark.parametrize("count", [10, 10**6, 10**9, 10**12])
def test_every_pair_within_the_radius_shares_a_shard(count):
    masks = [m & (2**64 - 1) for m in simhash.block_masks(count, 3)]
    assert all(-(1 << 63) <= m < 1 << 63 for m in simhash.block_masks(count, 3))
    rng = random.Random(count)
    for _ in range(2000):
        changed = 0
        for _ in range(rng.randrange(4)):
            changed |= 1 << rng.randrange(64)
        assert any(not m & changed for m in masks)


def noisy_fingerprints(seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(12)]
    values = {0}
    for _ in range(500):
        v = rng.choice(centres)
        for _ in range(rng.randrange(8)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    return sorted(v - (1 << 64) if v >> 63 else v for v in values)


@pytest.mark.parametrize("shard_rows", [4096, 16])
def test_linked_fingerprints(spark, monkeypatch, shard_rows):
    values = noisy_fingerprints(3)
    original = simhash.shard_links
    monkeypatch.setattr(simhash, "shard_links", lambda m, r: original(m, r, shard_rows=shard_rows))
    got = {r.node: r.label for r in simhash.linked_fingerprints(spark.createDataFrame([(v,) for v in values], "fp long")).collect()}
    roots = brute_components(len(values), lambda i, j: ((values[i] ^ values[j]) & (2**64 - 1)).bit_count() <= 3)
    expected = {values[i]: values[r] for i, r in enumerate(roots) if roots.count(r) > 1}
    assert {n: got.get(n, n) for n in values} == {n: expected.get(n, n) for n in values}


def test_more_blocks_give_the_same_links(spark, monkeypatch):
    values = noisy_fingerprints(8)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    few = sorted(map(tuple, simhash.linked_fingerprints(df).collect()))
    masks = simhash.block_masks(10**9, 3)
    assert len(masks) > 4
    monkeypatch.setattr(simhash, "block_masks", lambda n, r: masks)
    assert sorted(map(tuple, simhash.linked_fingerprints(df).collect())) == few


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, 900), (900, 1), (5, 5), (2, 1), *((7, 1000 + i) for i in range(300)), (1299, 2)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and 5 not in got
    assert {got[i] for i in (1, 2, 7, 900, 1000, 1299)} == {1}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def mutated(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed):
    rng = random.Random(seed)
    texts = list(ODD)
    for _ in range(25):
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(8, 300)))
        texts += [base] * rng.randrange(1, 4) + [mutated(rng, base, rng.randrange(1, 12)) for _ in range(rng.randrange(5))]
        texts.append(base.upper() if rng.random() < 0.3 else base + " tail")
    rng.shuffle(texts)
    return texts


def test_components_of_documents(spark):
    texts = corpus(1)
    got = {r.doc_id: r for r in simhash.fingerprint_components(table(spark, texts, 50)).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    roots = brute_components(len(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {50 + i: (f"{p:016x}", 50 + r) for i, (p, r) in enumerate(zip(prints, roots, strict=True))}


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "same text here"), (4, "same text here"), (4, "same text here"), (None, "alone in this")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.component_id) for r in simhash.fingerprint_components(df).collect()), key=str)
    assert got == [(0, 4), (0, None), (4, 4), (4, 4)]


def jaccard(a, b):
    x, y = set(shingles(a, 5)), set(shingles(b, 5))
    return len(x & y) / len(x | y) if x or y else 1.0


@pytest.mark.parametrize("rows", [1024, 3])
def test_near_groups_are_those_of_the_exact_similarity(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash, "FAMILY_ROWS", rows)
    texts = corpus(2)
    roots = brute_components(len(texts), lambda i, j: jaccard(texts[i], texts[j]) >= 0.8)
    got = simhash.near_groups(table(spark, texts), keep=("doc_id", "fp")).select("row.doc_id", "group", "stays").collect()
    assert {r.doc_id: (r.group, r.stays) for r in got} == {i: (r, i == r) for i, r in enumerate(roots)}
    kept = simhash.drop_near_duplicates(table(spark, texts).repartition(3))
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted(map(tuple, kept.collect())) == sorted((i, texts[i], "f") for i in set(roots))


def test_repeats_within_a_text_do_not_part_near_duplicates(spark):
    rng = random.Random(5)  # 25 bits apart with repeats counted
    passage, line = [" ".join(f"w{rng.randrange(3000)}" for _ in range(n)) for n in (200, 20)]
    texts = [" ".join([passage, *[line] * times]) for times in (1, 10, 1000)]
    assert jaccard(texts[0], texts[1]) > 0.95 and jaccard(texts[1], texts[2]) == 1
    got = simhash.near_groups(table(spark, texts)).select("row.doc_id", "group").collect()
    assert {r.doc_id: r.group for r in got} == {0: 0, 1: 0, 2: 0}


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(None, "just a few words here now"), (1, "just a few words here now"), (1, "just a few words here now")], "doc_id long, text string")
    assert simhash.drop_near_duplicates(df).count() == 1


def test_empty_tables(spark):
    none = table(spark, [])
    assert simhash.fingerprint_components(none).count() == 0
    assert simhash.near_groups(none).count() == 0
    assert simhash.drop_near_duplicates(none).count() == 0


def test_spark_hashes_with_the_same_seed(spark):
    # The contract's hash is also Spark's own xxhash64 of a string.
    (row,) = spark.createDataFrame([("the quick brown",)], "s string").select(F.xxhash64("s").alias("h")).collect()
    assert row.h & (2**64 - 1) == xxhash.xxh64_intdigest("the quick brown", 42)
    assert int(np.uint64(simhash.shingle_hashes("The quick brown", 3)[0])) == row.h & (2**64 - 1)
