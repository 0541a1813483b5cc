"""Byte-level BPE, length histogram and token files against the tokenizer libraries and brute force."""

import array
import base64
import hashlib
import random
import struct
import zlib

import public_tokenizers
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowprofile.llm import bpe, lengths, token_files

ODD = ["", " ", "a", "The cat's  tail\n\n", "x" * 5000, "ab" * 700, "naïve Ünïcode 日本語 🙂🙂", "\x1c\x1dmixed\x85 spaces here", "don't DON'T 'tis x.'s", "12345 6 7", "<|endoftext|> [INST]"]


@pytest.fixture(scope="module")
def tik():
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def hugging():
    return Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def random_texts(n, seed):
    rng = random.Random(seed)
    parts = [*ODD, "ß", "É", "'re", "\t", "  \n", "Word. ", "end,", "İ", "Σας ", "é", "ﬁ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(8))) for _ in range(n)]


def documents(spark, texts):
    rows = [(i, t, "src", "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, ids string, n_tokens string")


def test_codec_matches_library_and_decodes(tik):
    codec = bpe.codec(*bpe.default_vocabulary())
    for text in [*ODD, *random_texts(400, 1)]:
        ids = codec.encode(text)
        assert ids == packed(tik.encode_ordinary(text)), text
        assert codec.decode(ids) == text.encode()


def test_long_word_merges_like_the_fold(monkeypatch):
    codec = bpe.codec(*bpe.default_vocabulary())
    rng = random.Random(5)
    for n in (2, 3, 17, 90):
        word = "".join(rng.choice("thea nding") for _ in range(n)).encode()
        assert bpe._merge_long(word, codec.ranks) == (bpe.merge_word(word, codec.ranks) if word not in codec.ranks else bpe._merge_long(word, codec.ranks))


def test_round_trip_of_documents(spark, tik):
    texts = [None, *ODD, *random_texts(60, 2), ODD[3], ODD[3]]
    got = bpe.round_trip(documents(spark, texts)).drop("ids").collect()
    assert len(got) == len(texts)
    for row in got:
        text = texts[row.doc_id] or ""
        ids = tik.encode_ordinary(text)
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (
            len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_decoder_column(spark):
    texts = ["", "some text", "ünï"]
    df = bpe.encode_documents(documents(spark, texts), keep=("doc_id",))
    assert sorted(bytes(r.b).decode() for r in df.select(bpe.decoder()("ids").alias("b")).collect()) == sorted(texts)


def test_higher_order_functions_fold_the_same_merges(spark):
    codec = bpe.codec(*bpe.default_vocabulary())
    words = sorted({w for t in [*ODD[2:4], *ODD[6:], "x" * 40, *random_texts(30, 3)] for w in codec.pattern.findall(t) if len(w) < 60})
    got = bpe.encode_words(spark.createDataFrame([(w,) for w in ["", *words]], "word string")).collect()
    assert {r.word: packed(r.ids) for r in got} == {"": b""} | {w: codec.encode_word(w) for w in words}


def test_empty_tables(spark):
    empty = documents(spark, [])
    assert bpe.round_trip(empty).count() == 0
    assert lengths.suffix_sums(lengths.length_histogram(bpe.encode_documents(empty))).count() == 0
    assert token_files.read_token_files(token_files.write_token_files(empty)).count() == 0


def test_suffix_sums_against_brute_force(spark):
    rng = random.Random(9)
    given = [rng.choice([0, 1, 2, 5, 1023, 1024, 1025, 5000, rng.randrange(9000)]) for _ in range(400)]
    sums = lengths.suffix_sums(lengths.length_histogram(spark.createDataFrame([(n, "z") for n in given], "n_tokens long, documents string")))
    rows = sums.collect()
    assert sorted(r.n_tokens for r in rows) == sorted(set(given))
    for r in rows:
        assert r.documents == given.count(r.n_tokens)
        assert r.documents_at_least == sum(g >= r.n_tokens for g in given)
        assert r.tokens_at_least == sum(g for g in given if g >= r.n_tokens)
        assert r.total_tokens == sum(given)
        assert r.truncated_total == sum(min(g, r.n_tokens) for g in given)
        assert r.quantile == pytest.approx(sum(g <= r.n_tokens for g in given) / len(given))
    limits = [0, 1, 3, 1000, 1024, 4999, 100_000]
    for r in lengths.answer_limits(sums, limits).collect():
        kept = sum(min(g, r.context_limit) for g in given)
        assert (r.kept, r.lost, r.cut) == (kept, sum(given) - kept, sum(g > r.context_limit for g in given)), r
    assert {r.context_limit for r in lengths.answer_limits(sums, limits).collect()} == set(limits)


def test_limits_below_the_shortest_length(spark):
    sums = lengths.suffix_sums(lengths.length_histogram(spark.createDataFrame([(5,), (9,)], "n_tokens long")))
    assert [tuple(r) for r in lengths.answer_limits(sums, [3]).collect()] == [(3, 6, 8, 2)]


def test_chunks_match_the_library(hugging):
    tool = token_files.tokenizing(token_files.default_tokenizer())
    for text in [*ODD, *random_texts(600, 4)]:
        assert tool.encode(text) == array.array("I", hugging.encode(text, add_special_tokens=False).ids).tobytes(), text


def test_token_files_round_trip(spark, hugging, tmp_path):
    texts = [None, *ODD, *random_texts(80, 6)]
    rows = documents(spark, texts).select((F.lit(1000) - F.col("doc_id")).alias("doc_id"), "text", F.lit(1).alias("start"))
    rows = rows.unionByName(spark.createDataFrame([(None, "no id", 1), (7, "twice", 1), (7, "twice", 1)], rows.schema)).repartition(5)
    files = token_files.write_token_files(rows, f"file://{tmp_path}/out", frame_bytes=256)
    got = sorted(token_files.read_token_files(files).collect(), key=lambda r: r.start)
    expected = sorted([(-1, "no id"), (7, "twice"), (7, "twice"), *((1000 - i, t or "") for i, t in enumerate(texts))], key=lambda x: x[0])
    assert [-1 if r.doc_id is None else r.doc_id for r in got] == [d for d, _ in expected]
    start = 0
    for row, (_, text) in zip(got, expected, strict=True):
        ids = [*hugging.encode(text, add_special_tokens=False).ids, 1]
        assert (row.start, row.n_tokens, row.ids_crc32, bytes(row.ids)) == (start, len(ids), zlib.crc32(packed(ids)), packed(ids))
        start += len(ids)
    assert sum(r.tokens for r in files.collect()) == start
    some = token_files.read_token_files(files, only=[7, 999, 123456]).collect()
    assert sorted(r.doc_id for r in some) == [7, 7, 999]
    # Any zstandard tool reads the frames; unfinished files have other names.
    names = sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc"))
    assert all(n.startswith("part-") for n in names)
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(open(tmp_path / "out" / n, "rb"), read_across_frames=True).read() for n in names)
    assert whole == b"".join(bytes(r.ids) for r in got)


class Counting:
    def __init__(self, data):
        self.data, self.at, self.reads = data, 0, []

    def seek(self, at):
        self.at = at

    def read(self, n):
        self.reads.append((self.at, n))
        return self.data[self.at : self.at + n]


def file_of(documents_, frame_bytes):
    import io

    stream = io.BytesIO()
    writer = token_files.FileWriter(stream, frame_bytes)
    for d, ids in documents_:
        writer.add(d, ids)
    writer.close()
    return stream.getvalue()


def test_reader_decompresses_only_what_is_asked_for():
    given = [(i, packed(range(i % 7 * 10))) for i in range(200)]
    data = file_of(given, 400)
    stream = Counting(data)
    reader = token_files.FileReader(stream, len(data))
    assert len(reader.frames) > 10
    before = len(stream.reads)
    assert list(reader.read([5, 150])) == [(5, given[5][1]), (150, given[150][1])]
    assert len(stream.reads) - before == 2
    assert [ids for _, ids in reader.read()] == [ids for _, ids in given]


def test_damage_is_found():
    data = bytearray(file_of([(1, packed(range(50))), (2, packed(range(50, 90)))], 10))
    reader = token_files.FileReader(Counting(bytes(data)), len(data))
    data[int(reader.starts[1]) - 3] ^= 1  # in the first frame's own checksum
    broken = token_files.FileReader(Counting(bytes(data)), len(data))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        broken.frame(0)
    assert broken.frame(1) == packed(range(50, 90))
    with pytest.raises(ValueError, match="seek table"):
        token_files.FileReader(Counting(b"x" * 30), 30)


def test_file_without_documents_and_with_empty_ones():
    for given in ([], [(1, b""), (None, b""), (3, packed([4]))]):
        data = file_of(given, 100)
        assert [ids for _, ids in token_files.FileReader(Counting(data), len(data)).read()] == [ids for _, ids in given]
