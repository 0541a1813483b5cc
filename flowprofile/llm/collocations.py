"""Phrase collocations per language: frequent phrases of two to five words and how much more often they occur than their parts would meet.

Texts are cut at `.,;:!?` and line ends into pieces, and those at blanks and tabs into words, A-Z lower-cased.

1. Words are counted per language, combined in the tasks first. Words below `min_count` can be in no candidate; the others get a number.
2. Texts are written once as arrays of numbers, zero for any other word and for the end of a piece.
3. Level by level, from two words on, a phrase can be a candidate only if both of its shorter parts are (Apriori). Positions where that holds
   are hashed to two rows of `CELLS` counters, capped at `min_count` and added over all tasks; a phrase with a counter that stays below cannot be frequent. The phrases left, a
   superset of the frequent ones, are the level's tries: double-array tries of about `TRIE_PHRASES` phrases, twice as many at most, each broadcast in turn. They are parted by the first
   word, so a position walks those of its own word only. All these positions of a text walk a trie together, states that accept are counted by `bincount`, and the tasks' arrays of counts are added.
4. Scores, cuts and the removal of phrases that only occur inside longer ones are joins of the table of frequent phrases.

Everything broadcast has a bound by parameter: dictionary parts, counters (as bits), tries. More words or phrases mean more rounds over the number arrays, never a larger
broadcast. Counters may collide, which costs counting, not results. Skewed languages and texts don't matter, as text is never shuffled.

Null texts have no words, a null language is `und`. Repeated rows count each. An empty table, or one without a frequent pair, gives no rows.
Columns that are not named are dropped.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowprofile.llm.common import byte_slices, materialize, new_path, small, text_or_empty
from flowprofile.llm.double_array import DoubleArrayTrie

MIN_COUNT, LONGEST, TOP = 100, 5, 2000
UNKNOWN = "und"
#: Words of one part of the dictionary.
DICTIONARY_WORDS = 400_000
#: Phrases of one trie.
TRIE_PHRASES = 100_000
#: Counters of a row of the screen at most, a power of two; fewer words need fewer.
CELLS = 1 << 22
SCREEN_ROWS = 2
#: Distinct words a task counts before it passes them on.
COUNTED_WORDS = 200_000
RESULT = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
#: Candidates that a task gathers, so that it names each once, before it passes them on.
HELD_PHRASES = 1 << 20
_BLOCK = 1 << 14
_SLICE = 8 << 20

_ENDS = b".,;:!?\n\x0b\x0c\r"
_MAP = bytes(c + 32 if 65 <= c <= 90 else 46 if c in _ENDS else 32 if c == 9 else c for c in range(256))


def tokens(text: str) -> list[bytes]:
    """The words of a text, and a full stop at each end of a piece."""
    return text.encode().translate(_MAP).replace(b".", b" . ").split()


# ---------------------------------------------------------------- words


def word_counts(documents: DataFrame) -> DataFrame:
    """(lang, word, n) summed over (lang, text); the row without a word holds all words of its language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter[bytes | None]] = {}

        def rows() -> pa.RecordBatch:
            langs = [lang for lang, c in found.items() for _ in c]
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array([w for c in found.values() for w in c], pa.binary()), pa.array([n for c in found.values() for n in c.values()], pa.int64())],
                ["lang", "word", "n"],
            )

        for part in byte_slices(batches, 1):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = tokens(text)
                counter = found.setdefault(lang, Counter())
                counter.update(words)
                ends = counter.pop(b".", 0)
                counter[None] += len(words) - ends
            if sum(map(len, found.values())) > COUNTED_WORDS:
                yield rows()
                found = {}
        yield rows()

    counted = documents.mapInArrow(count, "lang string, word binary, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """The rows with a number from 1 on, dense over all partitions, as `code`."""
    placed = materialize(rows.withColumn("_m", F.monotonically_increasing_id()), name)
    part = F.shiftright("_m", 33).cast("int")
    sizes = placed.groupBy(part.alias("p")).count().orderBy("p").collect()  # a row per task
    offsets, total = [], 1
    for r in sizes:
        offsets.append((r["p"], total))
        total += r["count"]
    table = F.broadcast(rows.sparkSession.createDataFrame(offsets, "_p int, _from long"))
    return placed.join(table, part == F.col("_p")).withColumn("code", (F.col("_from") + F.col("_m").bitwiseAND((1 << 33) - 1)).cast("int")).drop("_m", "_p", "_from")


def number_arrays(documents: DataFrame, words: DataFrame, total: int, dictionary_words: int) -> DataFrame:
    """(codes binary): little-endian 32-bit numbers of the words of a few texts, in order, zero for the end of a piece or text and for words without a number."""
    context, parts = documents.sparkSession.sparkContext, max(1, -(-total // dictionary_words))
    state = documents
    for part in range(parts):
        known: dict[str, dict[bytes, int]] = {}
        for r in words.where(F.col("code") % parts == part).select("lang", "word", "code").toLocalIterator():
            known.setdefault(r["lang"], {})[bytes(r["word"])] = r["code"]
        sent, last = context.broadcast(known), part == parts - 1

        def encode(batches: Iterator[pa.RecordBatch], sent=sent, part=part, last=last) -> Iterator[pa.RecordBatch]:
            dictionaries = sent.value
            for rows in byte_slices(batches, 1, _SLICE):
                codes = []
                for lang, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    number, words_ = dictionaries.get(lang, {}).get, tokens(text)
                    codes.append(np.fromiter([number(w, 0) for w in words_] + [0], np.int32, len(words_) + 1))
                if part:
                    codes = [np.maximum(c, np.frombuffer(b, np.int32)) for c, b in zip(codes, rows.column(2).to_pylist(), strict=True)]
                if last:
                    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(codes).tobytes()], pa.binary())], ["codes"])
                else:
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], ["lang", "text", "codes"])

        coded = state.mapInArrow(encode, "codes binary" if last else "lang string, text string, codes binary")
        path = new_path(documents.sparkSession, f"codes-{part}")
        coded.write.option("compression", "zstd").parquet(path)
        state = documents.sparkSession.read.schema(coded.schema).parquet(path)
    return state


# ---------------------------------------------------------------- screen


def cells_of(codes: np.ndarray, length: int, cells: int) -> list[np.ndarray]:
    """Counters, one in each row, of the phrase of `length` words at each position that has so many behind it."""
    n = max(0, len(codes) - length + 1)
    value = np.zeros(n, np.uint64)
    for i in range(length):
        value = value * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n].astype(np.uint64)
        value ^= value >> np.uint64(29)
    shift = np.uint64(65 - int(cells).bit_length())
    return [(value * np.uint64(factor) >> shift).astype(np.int64) + row * cells for row, factor in enumerate((0xBF58476D1CE4E5B9, 0x94D049BB133111EB))]


def possible(codes: np.ndarray, length: int, shorter: np.ndarray | None, cells: int) -> np.ndarray:
    """Positions where a phrase of `length` numbered words begins whose two parts of `length` - 1 words pass the screen `shorter`."""
    n = max(0, len(codes) - length + 1)
    if shorter is None:
        fine = (codes[:n] > 0) & (codes[1 : n + 1] > 0)
    else:
        known = (codes > 0)[: n + length - 1]
        part = np.logical_and.reduce([shorter[c] for c in cells_of(codes, length - 1, cells)])[: n + 1]
        fine = part[:n] & part[1 : n + 1]
        for i in range(length):
            fine &= known[i : i + n]
    return np.flatnonzero(fine)


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for value in batch.column(0):
            yield np.frombuffer(value.as_buffer(), np.int32)


def counter_blocks(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    blocks = table.reshape(-1, min(_BLOCK, len(table)))
    some = np.flatnonzero(blocks.any(axis=1))
    for i in range(0, len(some), 64):
        yield pa.RecordBatch.from_arrays([pa.array(some[i : i + 64], pa.int64()), pa.array([blocks[b].tobytes() for b in some[i : i + 64]], pa.binary())], ["block", "counts"])


def screen(parts: DataFrame, threshold: int, cells: int) -> np.ndarray:
    """For each counter, whether its sum over the tasks' blocks (block, counts) reaches the threshold; `cells` bits come to the driver.

    Tasks cap their counters at the threshold, which leaves the answer as it is.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(total >= threshold).tobytes()], pa.binary())], ["block", "bits"])

        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if block != at:
                    if at is not None:
                        yield row()
                    at, total = block, np.zeros(min(_BLOCK, cells), np.int64)
                total += np.frombuffer(counts.as_buffer(), np.uint16 if len(counts.as_buffer()) == 2 * len(total) else np.uint32)
        if at is not None:
            yield row()

    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block long, bits binary")
    out = np.zeros((-(-cells // min(_BLOCK, cells)), min(_BLOCK, cells)), bool)
    for r in merged.collect():
        out[r["block"]] = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)[: out.shape[1]]
    return np.packbits(out.reshape(-1))


def _bits(packed: np.ndarray, cells: int) -> np.ndarray:
    return np.unpackbits(packed)[:cells].astype(bool)


# ---------------------------------------------------------------- levels


def _rows(matrix: np.ndarray) -> pa.RecordBatch:
    width = 4 * matrix.shape[1]
    data = matrix.astype(">i4").tobytes()
    return pa.RecordBatch.from_arrays([pa.array([data[i : i + width] for i in range(0, len(data), width)], pa.binary())], ["phrase"])


def _distinct(matrix: np.ndarray) -> np.ndarray:
    """The distinct rows."""
    key = matrix[:, 0].astype(np.int64)
    for i in range(1, matrix.shape[1]):
        key = np.unique(key, return_inverse=True)[1] << 32 | matrix[:, i]
    return matrix[np.unique(key, return_index=True)[1]]


def _bucketed(phrases: np.ndarray, buckets: int) -> pa.RecordBatch:
    """The phrases as one array per bucket of their hash."""
    bucket = cells_of(np.ascontiguousarray(phrases).reshape(-1), phrases.shape[1], buckets)[0][:: phrases.shape[1]]
    order = np.argsort(bucket, kind="stable")
    bucket, phrases = bucket[order], phrases[order].astype(np.int32)
    cuts = np.flatnonzero(np.concatenate([np.ones(min(1, len(bucket)), bool), bucket[1:] != bucket[:-1]]))
    ends = [*cuts[1:].tolist(), len(bucket)][: len(cuts)]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[cuts], pa.int64()), pa.array([phrases[a:b].tobytes() for a, b in zip(cuts.tolist(), ends, strict=True)], pa.binary())], ["bucket", "phrases"])


def frequent_phrases(codes: DataFrame, length: int, shorter: np.ndarray | None, min_count: int, cells: int, trie_phrases: int) -> DataFrame:
    """(phrase, a) of the phrases of `length` words with at least `min_count` occurrences; a phrase is its numbers, 32 bits each, highest byte first."""
    spark = codes.sparkSession
    sent_shorter = None if shorter is None else spark.sparkContext.broadcast(shorter)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        bits = None if sent_shorter is None else _bits(sent_shorter.value, SCREEN_ROWS * cells)
        for array in _arrays(batches):
            yield array, possible(array, length, bits, cells)

    def count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SCREEN_ROWS * cells, np.uint16 if min_count < 1 << 16 else np.uint32)
        for array, places in passing(batches):
            for cells_ in cells_of(array, length, cells):
                cell, n = np.unique(cells_[places], return_counts=True)
                table[cell] = np.minimum(table[cell] + n, min_count)
        yield from counter_blocks(table)

    sent = spark.sparkContext.broadcast(screen(codes.mapInArrow(count_cells, "block long, counts binary"), min_count, SCREEN_ROWS * cells))

    buckets = max(16, cells >> 12)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _bits(sent.value, SCREEN_ROWS * cells)
        held, size = [np.empty((0, length), np.int32)], 0  # phrases met so far in this task
        for array, places in passing(batches):
            for cells_ in cells_of(array, length, cells):
                places = places[bits[cells_[places]]]
            held.append(_distinct(array[places[:, None] + np.arange(length)]))
            size += len(held[-1])
            if size > HELD_PHRASES:
                held = [_distinct(np.concatenate(held))]
                size = len(held[0])
                if size > HELD_PHRASES // 2:
                    yield _bucketed(held[0], buckets)
                    held, size = [held[0][:0]], 0
        yield _bucketed(_distinct(np.concatenate(held)), buckets)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0
        for batch in batches:
            for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != at:
                    if held:
                        yield _rows(_distinct(np.concatenate(held)))
                    at, held, size = bucket, [], 0
                held.append(np.frombuffer(packed.as_buffer(), np.int32).reshape(-1, length))
                size += len(held[-1])
                if size > HELD_PHRASES:
                    held = [_distinct(np.concatenate(held))]
                    size = 0
        if held:
            yield _rows(_distinct(np.concatenate(held)))

    # The tasks' phrases meet in buckets of their hash, as arrays.
    met = codes.mapInArrow(find, "bucket long, phrases binary").repartition("bucket").sortWithinPartitions("bucket")
    candidates = materialize(met.mapInArrow(merge, "phrase binary"), f"candidates-{length}")
    shares, parted = _shares(candidates, trie_phrases)
    # Tasks build the tries, and the driver passes on one at a time.
    built = materialize(parted.repartition(max(1, len(shares)), "share").sortWithinPartitions("share").mapInArrow(_build_tries(length), "share int, trie binary"), f"tries-{length}")
    parts = []
    for i, (first, of) in enumerate(shares):
        trie = spark.sparkContext.broadcast(DoubleArrayTrie.load(built.where(F.col("share") == i).first()["trie"]))

        def walk(batches: Iterator[pa.RecordBatch], trie=trie, first=first, of=of) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(len(trie.value.check), np.int64)
            for array in _arrays(batches):
                trie.value.count(array, counts, np.flatnonzero(array % np.int32(of) == first) if of > 1 else None)
            yield from counts_of_rows(trie.value, counts)

        def total(batches: Iterator[pa.RecordBatch], trie=trie) -> Iterator[pa.RecordBatch]:
            yield from frequent_rows(trie.value, batches, min_count)

        counted = codes.mapInArrow(walk, "block long, counts binary").repartition("block").sortWithinPartitions("block").mapInArrow(total, "phrase binary, a long")
        parts.append(materialize(counted, f"frequent-{length}-{i}"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "phrase binary, a long")


def _shares(candidates: DataFrame, trie_phrases: int) -> tuple[list[tuple[int, int]], DataFrame]:
    """(r, m) of each trie, and the phrases with the number of theirs (share, phrase): the first word's number leaves the rest r when divided by m, so that a position walks
    the tries of its own word only.

    A share with far more phrases than a trie holds, as a word may begin very many, is parted by a hash of the phrase.
    """
    of = max(1, -(-candidates.count() // trie_phrases))
    rest = F.pmod(F.conv(F.hex(F.expr("substring(phrase, 1, 4)")), 16, 10).cast("int"), F.lit(of))
    shares, rows = [], []
    for r in candidates.groupBy(rest.alias("r")).count().orderBy("r").collect():  # a row per trie
        more = -(-r["count"] // trie_phrases) if r["count"] > 2 * trie_phrases else 1
        rows.append((r["r"], len(shares), more))
        shares += [(r["r"], of)] * more
    numbers = F.broadcast(candidates.sparkSession.createDataFrame(rows, "_r int, _at int, _more int"))
    return shares, candidates.join(numbers, rest == F.col("_r")).select((F.col("_at") + F.pmod(F.xxhash64("phrase"), F.col("_more"))).cast("int").alias("share"), "phrase")


def _build_tries(length: int):
    """From (share, phrase), the shares one after the other, the trie of each."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def row() -> pa.RecordBatch:
            trie = DoubleArrayTrie(np.frombuffer(b"".join(sorted(held)), ">i4").astype(np.int64).reshape(-1, length))
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([trie.dump()], pa.binary())], ["share", "trie"])

        for batch in batches:
            shares = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shares)) + 1).tolist(), len(shares)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a and shares[a] != at:
                    if held:
                        yield row()
                    at, held = int(shares[a]), []
                held += batch.column(1).slice(a, b - a).to_pylist()
        if held:
            yield row()

    return build


def counts_of_rows(trie: DoubleArrayTrie, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The counts of the trie's phrases, in their order, in blocks."""
    states = np.flatnonzero(counts)
    rows = np.zeros(len(trie.phrases), np.int64)
    rows[trie.row[states]] = counts[states]
    for at in range(0, len(rows), _BLOCK):
        yield pa.RecordBatch.from_arrays([pa.array([at // _BLOCK], pa.int64()), pa.array([rows[at : at + _BLOCK].tobytes()], pa.binary())], ["block", "counts"])


def frequent_rows(trie: DoubleArrayTrie, batches: Iterator[pa.RecordBatch], min_count: int) -> Iterator[pa.RecordBatch]:
    """(phrase, a) of the phrases that reach the count, from blocks in order."""

    def rows(block: int, total: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(total >= min_count)
        return pa.RecordBatch.from_arrays([_rows(trie.phrases[block * _BLOCK + some]).column(0), pa.array(total[some])], ["phrase", "a"])

    at, total = None, None
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            here = np.frombuffer(counts.as_buffer(), np.int64)
            if block == at:
                total = total + here
                continue
            if at is not None:
                yield rows(at, total)
            at, total = block, here
    if at is not None:
        yield rows(at, total)


def screen_of(phrases: DataFrame, length: int, cells: int) -> np.ndarray:
    """Bits of the counters that the phrases have."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SCREEN_ROWS * cells, np.uint16)
        for batch in batches:
            if batch.num_rows:
                matrix = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">i4").astype(np.int32)
                for cells_ in cells_of(matrix, length, cells):
                    table[cells_[::length]] = 1
        yield from counter_blocks(table)

    return screen(phrases.select("phrase").mapInArrow(mark, "block long, counts binary"), 1, SCREEN_ROWS * cells)


# ---------------------------------------------------------------- scores


def collocations(
    documents: DataFrame, *, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP,
    dictionary_words: int = DICTIONARY_WORDS, trie_phrases: int = TRIE_PHRASES, cells: int = CELLS,
) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: the first `top` phrases of each language."""
    spark = documents.sparkSession
    texts = documents.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), text_or_empty(text).alias("text"))
    counted = materialize(word_counts(texts).where(F.col("word").isNull() | (F.col("n") >= min_count)), "word-counts")
    totals = counted.where("word is null").select("lang", F.col("n").alias("total"))
    words = materialize(numbered(counted.where("word is not null").select("lang", "word", "n"), "words"), "numbered-words")
    known, positions = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not known:
        return spark.createDataFrame([], RESULT)
    cells = min(cells, 1 << max(12, (4 * positions - 1).bit_length()))
    codes = number_arrays(texts, words, known, dictionary_words)
    levels, shorter = [], None
    for length in range(2, longest + 1):
        found = frequent_phrases(codes, length, shorter, min_count, cells, trie_phrases)
        if found.isEmpty():
            break
        levels.append(found.withColumn("k", F.lit(length)))
        if length < longest:
            shorter = screen_of(found, length, cells)
    if not levels:
        return spark.createDataFrame([], RESULT)
    candidates = reduce(DataFrame.unionByName, levels)

    one = F.unhex(F.lpad(F.hex("code"), 8, "0"))
    named = words.select(one.alias("first"), "lang", F.col("word").cast("string").alias("word")).join(F.broadcast(totals) if totals.count() <= 100_000 else totals, "lang")
    counts = small(words.select(one.alias("phrase"), F.col("n").alias("f")).unionByName(candidates.select("phrase", F.col("a").alias("f"))))
    within = candidates.where("k > 2").select("a", F.explode(F.array(F.expr("substring(phrase, 5)"), F.expr("substring(phrase, 1, 4 * k - 4)"))).alias("phrase"))
    inside = within.groupBy("phrase").agg(F.max("a").alias("longer"))
    # A part of a candidate is one too, so a phrase inside any longer one with as many occurrences is inside one that is a word longer.
    kept = candidates.join(small(inside), "phrase", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    cuts = kept.withColumn("first", F.expr("substring(phrase, 1, 4)")).join(small(named.select("first", "lang", F.col("total").alias("n"))), "first").select(
        "phrase", "lang", "a", "n", F.explode(F.expr("transform(sequence(1, k - 1), j -> struct(j, substring(phrase, 1, 4 * j) as head, substring(phrase, 4 * j + 1) as tail))")).alias("cut"),
    )
    scored = (
        cuts.join(counts.select(F.col("phrase").alias("head"), F.col("f").alias("l")), F.col("cut.head") == F.col("head"))
        .join(counts.select(F.col("phrase").alias("tail"), F.col("f").alias("r")), F.col("cut.tail") == F.col("tail"))
        .withColumn("score", F.expr("cast(a as decimal(38, 0)) * n * 1000 div (cast(l as decimal(38, 0)) * r)"))
    )
    lowest = scored.groupBy("phrase", "lang", "a", "n").agg(F.min(F.struct("score", "cut.j", "l", "r")).alias("low")).select("phrase", "lang", "a", "n", "low.score", "low.l", "low.r")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = materialize(lowest.withColumn("place", F.rank().over(best)).where(F.col("place") <= top).drop("place"), "best")
    spelled = (
        first.select("phrase", F.expr("posexplode(transform(sequence(0, int(length(phrase) / 4) - 1), i -> substring(phrase, 4 * i + 1, 4)))").alias("pos", "first"))
        .join(small(named.select("first", "word")), "first").groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
        .select(F.col("phrase").alias("key"), F.array_join(F.transform("w", lambda w: w["word"]), " ").alias("spelled"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "spelled")
    return (
        first.join(spelled, F.col("phrase") == F.col("key")).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
        .select("lang", "rank", F.col("spelled").alias("phrase"), "a", "l", "r", "n", "score")
    )


def collocations_sql() -> str:
    """DuckDB SQL of the query: all phrases of up to five words, joined as texts."""
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS d, coalesce(lang, '{UNKNOWN}') AS lang,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts)),
sizes AS (SELECT unnest(range(1, {LONGEST} + 1)) AS k),
counted AS (
  SELECT lang, k, phrase, count(*) AS a FROM (
    SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, sizes WHERE len(w) >= k))
  GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE k > 1 AND a >= {MIN_COUNT}),
inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(w[i : i + s - 1], ' ') AS phrase
    FROM (SELECT lang, a, w, s, unnest(range(1, k - s + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS s FROM candidates)))
  GROUP BY ALL),
kept AS (SELECT c.* FROM candidates c LEFT JOIN inside i USING (lang, phrase) WHERE i.longer IS NULL OR 100 * i.longer < 100 * c.a),
cuts AS (SELECT *, array_to_string(w[1 : j], ' ') AS head, array_to_string(w[j + 1 : k], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM kept)),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, n, j, CAST((CAST(1000 AS HUGEINT) * c.a * n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = c.head JOIN counted y ON y.lang = c.lang AND y.phrase = c.tail JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest) WHERE rank <= {TOP}"""
