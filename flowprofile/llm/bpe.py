"""Byte-level BPE encoding and decoding with a given rank file.

A text is split by the vocabulary's pattern into words; every distinct word is merged once per worker by folding ranked merges
over its byte pieces, and its ids are remembered; decoding concatenates the binary pieces of the ids. Documents are encoded where
they are read: no shuffle, whatever the skew, and a lost task repeats only its own rows.

The remembered words are bounded (`CACHE_WORDS` per worker); words beyond that are merged again when they come back, so the bound
changes time, never results. The vocabulary is a parameter file of fixed size, read by each worker.

Null texts count as empty and have no ids. Any text length is taken whole. Ids are 32-bit little-endian in a binary column.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Sequence
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowprofile.llm.common import text_or_empty, text_udf

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHE_WORDS = 120_000
#: Longer words are merged with linked pieces and a heap of pairs, as the plain fold is quadratic.
LONG_WORD = 256


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Pieces of one word: the adjacent pair of lowest rank is merged, the leftmost first, until no pair has a rank."""
    if word in ranks:
        return [word]
    if len(word) > LONG_WORD:
        return _merge_long(word, ranks)
    pieces = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i : i + 2]) for i in range(len(word) - 1)]
    while True:
        at, low = -1, None
        for i, rank in enumerate(pairs):
            if rank is not None and (low is None or rank < low):
                at, low = i, rank
        if low is None:
            return pieces
        pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = ranks.get(pieces[at - 1] + pieces[at])
        if at < len(pairs):
            pairs[at] = ranks.get(pieces[at] + pieces[at + 1])


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same merges in n log n: a heap of (rank, position) over a linked list; outdated entries are skipped."""
    import heapq

    n = len(word)
    ends = list(range(1, n + 1))  # end of the piece that begins at a position, 0 once merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def push(i: int) -> None:
        if ends[i] < n and (r := ranks.get(word[i : ends[ends[i]]])) is not None:
            heapq.heappush(heap, (r, i, ends[ends[i]]))

    while heap:
        _, i, stop = heapq.heappop(heap)
        if not ends[i] or ends[i] >= n or ends[ends[i]] != stop:
            continue
        ends[ends[i]], ends[i] = 0, stop
        if stop < n:
            before[stop] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    pieces, i = [], 0
    while i < n:
        pieces.append(word[i : ends[i]])
        i = ends[i]
    return pieces


class Codec:
    """Ranks and pattern of one vocabulary, and the words met so far."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}
        self.pieces = {rank: piece for piece, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.words: dict[str, bytes] = {}

    def encode_word(self, word: str) -> bytes:
        pieces = merge_word(word.encode(), self.ranks)
        ids = struct.pack(f"<{len(pieces)}I", *[self.ranks[p] for p in pieces])
        if len(self.words) < CACHE_WORDS and len(word) <= 64:
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        known, encode_word = self.words.get, self.encode_word
        return b"".join([known(w) or encode_word(w) for w in self.pattern.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i, in struct.iter_unpack("<I", ids)])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    return Codec(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def encoder(vocabulary: tuple[str, str] | None = None) -> Callable[..., Column]:
    """Column function: text -> binary ids."""
    where = vocabulary or default_vocabulary()

    def start() -> Callable[[list], pa.Array]:
        encode = codec(*where).encode
        return lambda texts: pa.array([encode(t) for t in texts], pa.binary())

    return text_udf("binary", start)


def decoder(vocabulary: tuple[str, str] | None = None) -> Callable[..., Column]:
    """Column function: binary ids -> the bytes they stand for."""
    where = vocabulary or default_vocabulary()

    def start() -> Callable[[list], pa.Array]:
        decode = codec(*where).decode
        return lambda ids: pa.array([decode(i) for i in ids], pa.binary())

    return text_udf("binary", start)


def encode_documents(
    documents: DataFrame, *, text: str = "text", keep: Sequence[str] = ("doc_id",), vocabulary: tuple[str, str] | None = None
) -> DataFrame:
    """The columns `keep`, then ids (binary) and n_tokens; one row per document. Other columns are dropped, whatever their names."""
    rows = documents.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), encoder(vocabulary)(text_or_empty(text)).alias("_ids"))
    return rows.select("_row.*", F.col("_ids").alias("ids"), F.expr("bigint(length(_ids) div 4)").alias("n_tokens"))


# ---------------------------------------------------------------- Spark expressions only

#: Buckets of the literal rank map; a bucket is searched in order.
BUCKETS = 8192


def rank_literal(vocabulary: tuple[str, str] | None = None) -> Column:
    """The ranks as one literal: an array of maps from pieces (hexadecimal) to ranks, by the pieces' crc32."""
    tool = codec(*(vocabulary or default_vocabulary()))
    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in tool.ranks.items():
        name = piece.hex().upper()
        maps[zlib.crc32(name.encode()) % BUCKETS][name] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def encode_words(words: DataFrame, *, word: str = "word", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(word, ids array<int>) of distinct words by higher-order functions: a fold over the byte pieces that merges the pair of lowest rank.

    Each step of the fold looks up all adjacent pairs in the literal rank map. Words are the pieces the pattern splits off; an empty word has no ids.
    """
    table = rank_literal(vocabulary)
    rank = lambda piece: F.get(table, F.pmod(F.crc32(piece.cast("binary")), F.lit(BUCKETS)).cast("int"))[piece]
    octets = F.filter(F.regexp_extract_all(F.hex(F.encode(F.col(word), "UTF-8")), F.lit("(..)"), F.lit(1)), lambda o: o != "")

    def step(pieces: Column, _: Column) -> Column:
        ranks = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p, i: rank(F.concat(p, F.get(pieces, i + 1))))
        # The lowest rank, and of equal ones the leftmost; bound once, as a one-element array.
        best = F.array_min(F.transform(ranks, lambda r, i: F.when(r.isNotNull(), F.struct(r.alias("r"), i.alias("i")))))["i"]
        merge = lambda at: F.when(at.isNull(), pieces).otherwise(F.concat(
            F.slice(pieces, 1, at), F.array(F.concat(F.get(pieces, at), F.get(pieces, at + 1))), F.slice(pieces, at + 3, F.size(pieces))
        ))
        return F.get(F.transform(F.array(best), merge), 0)

    folded = F.when(F.size("_o") > 1, F.aggregate(F.sequence(F.lit(2), F.size("_o")), F.col("_o"), step)).otherwise(F.col("_o"))
    pieces = words.select(F.col(word).alias("word"), octets.alias("_o")).select("word", folded.alias("_p"))
    return pieces.select("word", F.transform("_p", rank).alias("ids"))


def round_trip(documents: DataFrame, *, text: str = "text", keep: Sequence[str] = ("doc_id",), vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Encode, decode the ids again, and give the digests of both: `keep`, n_tokens, ids_sha256, decoded_sha256, and the ids.

    Both directions run in one pass over slices of a task's Arrow batches, so the ids never travel in between.
    """
    where = vocabulary or default_vocabulary()

    def start() -> Callable[[list], pa.Array]:
        tool = codec(*where)

        def both_ways(texts: list) -> pa.Array:
            ids = [tool.encode(t) for t in texts]
            columns = [
                pa.array(ids, pa.binary()), pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(tool.decode(i)).hexdigest() for i in ids], pa.string()),
            ]
            return pa.StructArray.from_arrays(columns, ["ids", "ids_sha256", "decoded_sha256"])

        return both_ways

    both = text_udf("ids binary, ids_sha256 string, decoded_sha256 string", start)
    rows = documents.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), both(text_or_empty(text)).alias("_b"))
    return rows.select("_row.*", F.expr("bigint(length(_b.ids) div 4)").alias("n_tokens"), "_b.ids_sha256", "_b.decoded_sha256", "_b.ids")
