"""The registered queries without SQL, on the whole of a given table, against brute force or the libraries."""

import base64
import hashlib
import os
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
import xxhash

from flowprofile.llm import registry
from flowprofile.llm.bpe import VOCABULARY

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{FOLDER}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(p): int(r) for p, r in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("given", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op1_recall(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{FOLDER}/embeddings.parquet' WHERE embedding IS NOT NULL ORDER BY vec_id").fetchall()
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    found = Counter(), Counter()
    for r in registry.op1_ann_tree(spark, FOLDER).collect():
        found[0][r["query_id"]] += 1
        d = np.sqrt(((vectors - vectors[ids == r["query_id"]][0]) ** 2).sum(axis=1))
        assert r["score"] == pytest.approx(float(d[ids == r["vec_id"]][0]), rel=1e-12)
        d[ids == r["query_id"]] = np.inf
        found[1][r["query_id"]] += r["vec_id"] in ids[np.lexsort((ids, d))[:10]]
    queries = [i for i in ids.tolist() if i % 100 == 0]
    assert all(found[0][i] == min(10, len(ids) - 1) for i in queries)
    assert sum(found[1].values()) >= 0.9 * sum(found[0].values())


def test_op2_lengths(spark, documents, library):
    lengths = Counter(len(library.encode_ordinary(t or "")) for _, t, _ in documents)
    got = registry.op2_token_lengths(spark, FOLDER).collect()
    assert {r["n_tokens"]: r["documents"] for r in got} == lengths
    for r in got:
        limit = r["n_tokens"]
        assert r["truncated_total"] == sum(min(n, limit) * c for n, c in lengths.items())


def test_op3_files(spark, documents):
    tool = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = {}, 0
    for key, text, _ in sorted(documents, key=lambda d: d[0]):
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, 1]
        want[key] = (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in registry.op3_token_files(spark, FOLDER).collect()} == want


def test_op6_ids(spark, documents, library):
    want = {}
    for key, text, _ in documents:
        ids = library.encode_ordinary(text or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want[key] = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in registry.op6_byte_bpe(spark, FOLDER).collect()} == want


def test_op7_shares(spark, documents):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = {r["doc_id"]: r for r in registry.op7_mix_sources(spark, FOLDER).collect()}
    assert {k: r["size"] for k, r in got.items()} == {k: size(t) for k, t, _ in documents}
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got.values())
    for source in {s for _, _, s in documents}:
        own = [got[k] for k, _, s in documents if s == source]
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], rel=0.01)


def test_op9_components(spark, documents):
    prints = {}
    for key, text, _ in documents:
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
        bits = np.array([[h >> b & 1 for b in range(64)] for h in (xxhash.xxh64_intdigest(s, 42) for s in shingles)]).reshape(-1, 64).sum(axis=0)
        prints[key] = sum(1 << b for b in range(64) if 2 * int(bits[b]) > len(shingles))
    keys, parent = sorted(prints), {k: k for k in prints}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in registry.op9_simhash(spark, FOLDER).collect()} == {k: (f"{prints[k]:016x}", root(k)) for k in keys}


def test_op10_scores(spark, documents):
    """Its accuracy is held on the largest table in test_toxicity; a small one has too few labels to learn from."""
    got = registry.op10_toxicity(spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(k for k, _, _ in documents)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
