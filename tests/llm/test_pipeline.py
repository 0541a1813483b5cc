"""Corpus pipeline: each stage on its own input, and the whole over the small tables."""

import hashlib
import pathlib
import re
import struct
import zlib

import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from flowprofile.functions.storage import shared_folder
from flowprofile.llm import bpe, simhash
from flowprofile.llm.common import materialize

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def inputs(spark):
    """The input of every stage, and the last result."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, FOLDER), name)
        found.append(docs)
    return found


def rows(df):
    return df.collect()


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "mix", "encode"]
    assert entry_point.queries()["pipeline"] is corpus_pipeline.run


def test_all_but_the_last_keep_the_columns(inputs):
    for df in inputs[1:-1]:
        assert df.dtypes == inputs[0].dtypes


def test_toxic_documents_go(spark, inputs):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    left = {r.doc_id for r in inputs[1].select("doc_id").collect()}
    learned = {d for d in labels if toxicity_learned(d)}
    toxic = {d for d in learned if labels[d] == 1}
    assert len(toxic & left) <= 0.1 * len(toxic)
    clean = {d for d in labels if labels[d] == 0}
    assert len(clean & left) >= 0.97 * len(clean)


def toxicity_learned(d):
    return zlib.crc32(str(d).encode()) % 3 != 1


def test_one_document_of_each_group_stays(inputs):
    docs = sorted((r.doc_id, r.text) for r in rows(inputs[1].select("doc_id", "text")))
    sets = [frozenset(simhash.shingle_hashes(t or "", 5).tolist()) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if len(a) * 0.8 <= len(b) <= len(a) / 0.8 and (len(a & b) >= 0.8 * len(a | b)):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in rows(inputs[2].select("doc_id"))) == sorted(docs[i][0] for i in range(len(docs)) if root(i) == i)


def test_mix_comes_near_its_targets(inputs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    before, after = {}, {}
    for df, sums in ((inputs[2], before), (inputs[3], after)):
        for r in rows(df.select("source", "text")):
            sums[r.source] = sums.get(r.source, 0) + size(r.text)
    from flowprofile.llm.mixing import share_targets

    names = sorted(before, key=lambda s: (s is None, s or ""))
    targets = share_targets([before[n] for n in names], [(1, 2, 3)[i % 3] for i in range(len(names))])
    longest = max(size(r.text) for r in rows(inputs[2].select("text")))
    for name, target in zip(names, targets, strict=True):
        assert abs(after.get(name, 0) - target) <= longest
    assert max(r["count"] for r in inputs[3].groupBy("doc_id").count().collect()) <= 3


def test_ids_decode_to_the_texts(inputs):
    codec = bpe.codec(*bpe.default_vocabulary())
    texts = {r.doc_id: r.text or "" for r in rows(inputs[3].select("doc_id", "text"))}
    got = rows(inputs[4])
    assert len(got) == inputs[3].count()
    for r in got:
        text = texts[r.doc_id].encode()
        assert codec.decode(bytes(r.ids)) == text and r.decoded_sha256 == hashlib.sha256(text).hexdigest()
        assert r.n_tokens == len(list(struct.iter_unpack("<I", r.ids))) and r.ids_sha256 == hashlib.sha256(r.ids).hexdigest()


def test_stages_take_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, row string, uid int"
    odd = [(None, None, None, None, None, "i", "r", 1), (1, "", "en", "a", 0, "i", "r", 1), (1, "", "en", "a", 0, "i", "r", 1), (2, "some words " * 2000, "en", None, 1, "i", "r", 1)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in ([], odd):
        docs = spark.createDataFrame(table, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = materialize(stage(spark, docs, str(tmp_path)), name)
            if name != "encode":
                assert out.columns == docs.columns
            docs = out
        assert docs.count() <= 3 * len(table)


def test_run_returns_the_last_stage(spark, inputs):
    tables = lambda: {str(p) for p in pathlib.Path(shared_folder(spark).removeprefix("file:")).glob("flowprofile-*/*")}
    before = tables()
    got = corpus_pipeline.run(spark, FOLDER)
    assert [pathlib.Path(p).name for p in tables() - before] == ["encode"]  # what the stages wrote on the way is gone
    assert sorted(got.columns) == sorted(inputs[4].columns)
    digest = lambda df: sorted(map(tuple, df.select("doc_id", "ids_sha256").collect()))
    assert digest(got) == digest(inputs[4])
