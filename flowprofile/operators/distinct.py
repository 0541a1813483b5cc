"""Distinct rows by a 128-bit digest of each row, settled by the rows themselves.

A group key of many columns makes Spark generate a method too large for the JVM to compile. Here the digest of a row is computed on Arrow batches, a column at a time; copies
within a batch go at once; what is left is shuffled by the digest alone and sorted by two BIGINTs, so that copies stand next to each other. Rows of one
digest are compared with the first of them in all columns, and those that differ (collisions) by their whole values. So the result is that of a
group key over all columns, whatever the digest. A row repeated any number of times reaches the shuffle once per batch.

NaN equals NaN, -0.0 equals 0.0 (and is returned as 0.0), null equals null.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowprofile.functions.columns import q, text

_HASHES = ("_digest_a", "_digest_b")
_LANES = ((0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9), (0xC2B2AE3D27D4EB4F, 0x94D049BB133111EB))
# Bits of the map of digests that occur more than once (32 MB), and the first bits of a digest, by which tasks divide the map.
MAP_BITS, SEGMENT_BITS = 28, 10
# Digests that a task sorts at once.
HELD_DIGESTS = 1 << 21
# Values of all columns that a task holds to make them distinct (64 MB), and the first bits of a mixed value, by which the next tasks divide a column's.
HELD_VALUES, VALUE_SEGMENT_BITS = 1 << 23, 6
_KINDS = (T.NumericType, T.BooleanType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)


def has_plain_columns(df: DataFrame) -> bool:
    """Whether all columns are of kinds that `distinct_rows` takes."""
    kinds = [f.dataType for f in df.schema.fields]
    return bool(kinds) and all(isinstance(k, _KINDS) and not isinstance(k, T.DecimalType) and (k == T.StringType() or not isinstance(k, T.StringType)) for k in kinds)


def _normal(column: pa.Array) -> pa.Array:
    """Floating values with one zero and one NaN; other columns as they are."""
    if not pa.types.is_floating(column.type):
        return column
    values = column.to_numpy(zero_copy_only=False) + column.type.to_pandas_dtype()(0)
    values[np.isnan(values)] = np.nan
    return pa.array(values, column.type, mask=column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None, from_pandas=False)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays that are equal in both where the (normal) values are equal: 64 bits to be hashed, and the place of a string among the batch's strings or whether there is a value."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        coded = column.dictionary_encode()
        place = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        hashes = [int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little") for v in coded.dictionary.to_pylist()]
        return np.array([*hashes, 0], np.uint64)[place], place
    if pa.types.is_floating(column.type):
        words = column.to_numpy(zero_copy_only=False).astype(np.float64).view(np.uint64)
    else:
        number = column.cast(pa.int32()) if pa.types.is_date32(column.type) else column
        words = pc.fill_null(number.cast(pa.int64()), 0).to_numpy(zero_copy_only=False).view(np.uint64)
    if not column.null_count:
        return words, np.zeros(0, np.int64)
    missing = column.is_null().to_numpy(zero_copy_only=False)
    return np.where(missing, np.uint64(0x5851F42D4C957F2D), words), missing.astype(np.int64)


def _digests(words: list[np.ndarray], rows: int, bits: int) -> list[np.ndarray]:
    lanes = []
    for start, factor in _LANES:
        value = np.full(rows, start, np.uint64)
        for w in words:
            value = (value ^ w) * np.uint64(factor)
            value ^= value >> np.uint64(29)
        lanes.append((value & np.uint64((1 << bits) - 1)).view(np.int64))
    return lanes


def _first_of_equals(batch: pa.RecordBatch, lanes: list[np.ndarray]) -> np.ndarray:
    """Which rows of a batch sorted by digest are the first of their kind."""
    n = batch.num_rows
    begins = np.concatenate([[True], (lanes[0][1:] != lanes[0][:-1]) | (lanes[1][1:] != lanes[1][:-1])])
    if begins.all():
        return begins
    later = np.flatnonzero(~begins)
    first = np.maximum.accumulate(np.where(begins, np.arange(n), 0))[later]
    same = np.ones(len(later), bool)
    for column in batch.columns:
        for part in _words(column):
            if len(part):
                same &= part[later] == part[first]
    keep = begins.copy()
    if not same.all():  # rows that share a digest and differ: kept unless an earlier one of the same digest is alike
        seen: dict[int, set[tuple]] = {}
        places = later[~same]
        for place, owner, row in zip(places.tolist(), first[~same].tolist(), batch.take(pa.array(places)).to_pylist(), strict=True):
            value = tuple("NaN" if isinstance(v, float) and v != v else v for v in row.values())
            known = seen.setdefault(owner, set())
            keep[place] = value not in known
            known.add(value)
    return keep


def _finite(columns: list[pa.Array], finite: list[int], complete: list[int]) -> list[pa.Array]:
    """Columns `finite` without NaN and infinities; rows without a value in one of `complete` are left out."""
    keep = np.ones(len(columns[0]), bool)
    out = list(columns)
    for i in sorted({*finite, *complete}):
        if i in finite:
            values = columns[i].to_numpy(zero_copy_only=False)
            fine = np.isfinite(values)
            if i not in complete and not fine.all():
                out[i] = pa.array(values, columns[i].type, mask=~fine)
        else:
            fine = columns[i].is_valid().to_numpy(zero_copy_only=False)
        if i in complete:
            keep &= fine
    return out if keep.all() else [c.filter(pa.array(keep)) for c in out]


def distinct_rows(df: DataFrame, bits: int = 64, finite: Sequence[str] = (), complete: Sequence[str] = ()) -> DataFrame:
    """The distinct rows; NaN and infinities of the DOUBLE columns `finite` count as null first, and rows with a null in one of `complete` go.

    `bits` of each half of the digest are used, which changes the work, never the result.
    """
    names = df.columns
    finite_, complete_ = ([i for i, n in enumerate(names) if n in wanted] for wanted in (set(finite), set(complete)))
    inner = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema.fields)])  # any names, repeated ones too
    marked = T.StructType([*inner.fields, *[T.StructField(h, T.LongType()) for h in _HASHES]])
    width = len(names)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [_normal(c) for c in _finite(batch.columns, finite_, complete_)]
            if not len(columns[0]):
                continue
            lanes = _digests([_words(c)[0] for c in columns], len(columns[0]), bits)
            order = np.lexsort(lanes[::-1])
            lanes = [lane[order] for lane in lanes]
            sorted_ = pa.RecordBatch.from_arrays([c.take(pa.array(order)) for c in columns], inner.names)
            keep = pa.array(_first_of_equals(sorted_, lanes))
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in [*sorted_.columns, *map(pa.array, lanes)]], marked.names)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the rows kept of the digest that the batch before ended with
        for batch in batches:
            if not batch.num_rows:
                continue
            known = last.num_rows if last is not None else 0
            whole = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            lanes = [whole.column(width + i).to_numpy() for i in (0, 1)]
            values = pa.RecordBatch.from_arrays(whole.columns[:width], inner.names)
            keep = _first_of_equals(values, lanes)
            tail = keep & (lanes[0] == lanes[0][-1]) & (lanes[1] == lanes[1][-1])
            last = whole.filter(pa.array(tail))
            keep[:known] = False
            yield values.filter(pa.array(keep))

    copies = df.toDF(*inner.names).mapInArrow(mark, marked).repartition(*_HASHES).sortWithinPartitions(*_HASHES)
    return copies.mapInArrow(settle, inner).toDF(*names)


def split_singles(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that share their keys with no other row, all others), so that only the others need a shuffle to be made distinct.

    One scan sends a 64-bit digest of every row's keys, and no row, to the tasks that find the digests occurring twice; these are marked in a map of 2^MAP_BITS bits, which every
    task then gets. A row whose bit is not set is alone. Among the others are also rows that merely share a bit: more of them cost work, never the result. The
    keys must be plain columns, and the table the same each time it is read: it is read for the digests and for either part.
    """
    digest = "_digest"
    while digest in df.columns:
        digest = "_" + digest
    marked = df.select("*", F.xxhash64(*[F.col(q(k)) for k in keys]).alias(digest))
    bits, inner = MAP_BITS, MAP_BITS - SEGMENT_BITS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces(held: list[np.ndarray]) -> pa.RecordBatch:
            digests = np.sort(np.concatenate(held))
            # A third copy tells no more than a second one.
            third = np.concatenate([[False, False], digests[2:] == digests[:-2]])[:len(digests)]
            digests = digests[~third]
            edges = np.searchsorted(digests >> np.uint64(64 - SEGMENT_BITS), np.arange((1 << SEGMENT_BITS) + 1))
            full = np.flatnonzero(edges[1:] > edges[:-1])
            return pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array([digests[edges[i]:edges[i + 1]].tobytes() for i in full], pa.binary())], names=["segment", "digests"])

        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            n += batch.num_rows
            if n >= HELD_DIGESTS:
                yield pieces(held)
                held, n = [], 0
        if n:
            yield pieces(held)

    def repeated(table: pa.Table) -> pa.Table:
        digests = np.sort(np.frombuffer(b"".join(table.column("digests").to_pylist()), np.uint64))
        twice = digests[1:][digests[1:] == digests[:-1]]
        places = (twice >> np.uint64(64 - bits)) & np.uint64((1 << inner) - 1)
        flags = np.zeros(1 << inner, np.uint8)
        flags[places] = 1
        found = [zlib.compress(np.packbits(flags).tobytes(), 1)] if len(twice) else []
        return pa.table({"segment": table.column("segment")[:len(found)].cast(pa.int32()), "bits": pa.array(found, pa.binary())})

    segments = marked.select(digest).mapInArrow(cut, "segment int, digests binary").groupBy("segment").applyInArrow(repeated, "segment int, bits binary")
    # The map's size does not depend on the table; segments without a repeated digest are left out.
    flags = {r["segment"]: bytes(r["bits"]) for r in segments.collect()}
    shared = df.sparkSession.sparkContext.broadcast(flags)
    opened: dict[int, np.ndarray] = {}

    def is_repeated(digests: pa.Array) -> pa.Array:
        if not opened:
            whole = np.zeros(1 << (bits - 3), np.uint8)
            for segment, packed in shared.value.items():
                part = np.frombuffer(zlib.decompress(packed), np.uint8)
                whole[segment * len(part):(segment + 1) * len(part)] = part
            opened[0] = whole
        places = digests.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)
        return pa.array((opened[0][places >> np.uint64(3)] >> (7 - (places & np.uint64(7))).astype(np.uint8) & 1).astype(bool))

    tested = marked.withColumn("_twice" + digest, F.arrow_udf(is_repeated, "boolean")(F.col(digest)))
    columns = [q(c) for c in df.columns]
    return tested.where(f"not {q('_twice' + digest)}").select(*columns), tested.where(q("_twice" + digest)).select(*columns)


def distinct_counts(df: DataFrame) -> DataFrame:
    """(feature, n_unique): how many values each column holds; null does not count, and a column without values has no row.

    All columns must be DOUBLE without NaN, or BIGINT. A value becomes 64 bits that no other value has; a task sorts them by column and sends each once, in blocks by the first bits, so
    a few rows a column travel instead of one per value, and no column's values meet in one place.
    """
    names = df.columns
    segments = 1 << VALUE_SEGMENT_BITS

    def mixed(column: pa.Array) -> np.ndarray:
        values = column.drop_null().to_numpy(zero_copy_only=False)
        words = (values + 0.0 if values.dtype == np.float64 else values).view(np.uint64)
        words = (words ^ (words >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        return words ^ (words >> np.uint64(29))

    def once(words: list[np.ndarray]) -> np.ndarray:
        values = np.sort(np.concatenate(words))
        return values[np.concatenate([[True], values[1:] != values[:-1]])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [[] for _ in names], 0

        def pieces() -> Iterator[pa.RecordBatch]:
            for place, words in enumerate(held):
                if words:
                    values = once(words)
                    words.clear()
                    edges = np.searchsorted(values >> np.uint64(64 - VALUE_SEGMENT_BITS), np.arange(segments + 1, dtype=np.uint64))
                    full = np.flatnonzero(edges[1:] > edges[:-1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(full), place, np.int32)), pa.array(full, pa.int32()), pa.array([values[edges[i]:edges[i + 1]].tobytes() for i in full], pa.binary())],
                        names=["fid", "segment", "words"])

        for batch in batches:
            for place, column in enumerate(batch.columns):
                words = mixed(column)
                if len(words):
                    held[place].append(words)
                    n += len(words)
            if n >= HELD_VALUES:
                yield from pieces()
                n = 0
        yield from pieces()

    def count(table: pa.Table) -> pa.Table:
        found = once([np.frombuffer(w, np.uint64) for w in table.column("words").to_pylist()])
        return pa.table({"fid": table.column("fid")[:1], "n": pa.array([len(found)], pa.int64())})

    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    counted = plain.mapInArrow(cut, "fid int, segment int, words binary").groupBy("fid", "segment").applyInArrow(count, "fid int, n bigint")
    return counted.groupBy("fid").agg(F.sum("n").alias("n_unique")).selectExpr(f"element_at(array({', '.join(text(n) for n in names)}), fid + 1) as feature", "n_unique")
