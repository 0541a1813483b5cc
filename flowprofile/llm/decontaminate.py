"""Benchmark decontamination: passages of test items found in training texts by an FM-index per shard of texts.

Words are runs of `WORD` characters, A-Z lower-cased. A window is `WINDOW` consecutive words of an item, or all words of a shorter one.

A task reads documents and gathers shards. Only words that items use have a number, and only runs of such words that are as long as the shortest window can
hold one, so nothing else of a text enters the index; every text is read whole. A shard of about `SHARD_WORDS` such words becomes a suffix array, its
Burrows-Wheeler transform a wavelet tree. All windows go through the backward search at once, the rows they end with are located by sampled suffix positions,
and their spans of words are merged per document. One narrow pass: documents are not shuffled, and a lost task repeats its own shards only.

The items are read in waves of about `WAVE_WORDS` words, so that what a wave sends to the tasks has a bound; with more than one wave the documents are
written once with a row number, and spans and items of the waves are merged per row.

Null and empty texts have no words. Items without words have no window. Rows of one item_id are one item; an item without an id causes hits, but is not listed.
Repeated documents are judged one by one. An empty table gives no rows; without items nothing is hit. Columns that are not named are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowprofile.llm.common import byte_slices, materialize, text_or_empty
from flowprofile.llm.fm_index import FMIndex

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Indexed words of a shard; a longer document makes a longer shard.
SHARD_WORDS = 1 << 19
#: Documents of a shard, whose numbers of words are held until it closes.
SHARD_DOCUMENTS = 50_000
#: Words of items that are searched in one wave.
WAVE_WORDS = 1 << 20

_LETTERS = b"0123456789abcdefghijklmnopqrstuvwxyz"
_LOWER = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or c in _LETTERS else 32 for c in range(256)
)

_FOUND = "_row long, n_words long, spans array<struct<start:long,stop:long>>, items array<string>"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_LOWER).split()


@dataclass(frozen=True)
class Windows:
    """Distinct windows of the items of one wave: a matrix of word numbers per length, and the items of each window."""

    numbers: dict[bytes, int]
    by_length: tuple[np.ndarray, ...]
    names: tuple[str, ...]
    item_from: np.ndarray
    item_of: np.ndarray

    @property
    def shortest(self) -> int:
        return min((m.shape[1] for m in self.by_length), default=0)

    @staticmethod
    def of(items: Sequence[tuple[str | None, str | None]], window: int = WINDOW) -> Windows:
        names = sorted({name for name, _ in items if name is not None})
        place = {name: i for i, name in enumerate(names)}
        numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for name, text in items:
            codes = [numbers.setdefault(w, len(numbers) + 1) for w in words_of(text or "")]
            for at in range(max(1, len(codes) - window + 1) if codes else 0):
                found.setdefault(tuple(codes[at : at + window]), set()).update([place[name]] if name is not None else [])
        ordered = sorted(found, key=lambda w: (len(w), w))
        lengths = sorted({len(w) for w in ordered})
        matrices = tuple(np.array([w for w in ordered if len(w) == n], dtype=np.int64) for n in lengths)
        sizes = [len(found[w]) for w in ordered]
        return Windows(
            numbers, matrices, tuple(names), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64),
            np.array([i for w in ordered for i in sorted(found[w])], dtype=np.int64),
        )


def merge_spans(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans, in order; touching ones become one."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    begins = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[begins], reach[np.concatenate([begins[1:], [True]])]


class Shard:
    """Documents gathered until they are indexed together."""

    def __init__(self, windows: Windows) -> None:
        self.windows = windows
        self.rows: list[int] = []
        self.sizes: list[int] = []
        self.runs: list[np.ndarray] = []
        self.run_document: list[int] = []
        self.run_offset: list[int] = []
        self.words = 0

    def add(self, row: int, text: str) -> None:
        words, number = words_of(text), self.windows.numbers.get
        document, shortest = len(self.rows), self.windows.shortest
        self.rows.append(row)
        self.sizes.append(len(words))
        if not shortest or len(words) < shortest:
            return
        codes = np.fromiter([number(w, 0) for w in words], np.int32, len(words))
        gaps = np.concatenate([[-1], np.flatnonzero(codes == 0), [len(codes)]])
        for i in np.flatnonzero(np.diff(gaps) > shortest):
            run = codes[gaps[i] + 1 : gaps[i + 1]]
            self.runs.append(run)
            self.run_document.append(document)
            self.run_offset.append(int(gaps[i]) + 1)
            self.words += len(run) + 1

    def full(self) -> bool:
        return self.words >= SHARD_WORDS or len(self.rows) >= SHARD_DOCUMENTS

    def occurrences(self) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(position in the text, window, its length) of all occurrences, a length at a time."""
        text = np.concatenate([x for run in self.runs for x in (run, np.zeros(1, np.int32))]).astype(np.int64)
        index, first = FMIndex(text, len(self.windows.numbers) + 1), 0
        for phrases in self.windows.by_length:
            low, high, which = index.search(phrases)
            counts = high - low
            rows = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum()) if len(low) else np.empty(0, np.int64)
            yield index.locate(rows), np.repeat(which + first, counts), phrases.shape[1]
            first += len(phrases)

    def close(self) -> pa.RecordBatch:
        """Rows of `_FOUND`, one per document."""
        w, n = self.windows, len(self.rows)
        # Spans in one coordinate for all documents; a gap of one word keeps neighbours apart.
        base = np.concatenate([[0], np.cumsum(np.array(self.sizes, dtype=np.int64) + 1)])
        starts, stops, pairs = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if self.runs:
            run_start = np.concatenate([[0], np.cumsum([len(r) + 1 for r in self.runs])])
            run_document, run_offset = np.array(self.run_document), np.array(self.run_offset)
            total = len(w.item_from) - 1
            for position, window, length in self.occurrences():
                run = np.searchsorted(run_start, position, "right") - 1
                document = run_document[run]
                start = base[document] + run_offset[run] + position - run_start[run]
                starts.append(start)
                stops.append(start + length)
                pairs.append(np.unique(document * total + window))
        start, stop = merge_spans(np.concatenate(starts), np.concatenate(stops))
        owner = np.searchsorted(base, start, "right") - 1
        pair = np.concatenate(pairs)
        total = max(1, len(w.item_from) - 1)
        document, window = pair // total, pair % total
        # Every (document, item) once, in the order of the item's name.
        sizes = w.item_from[window + 1] - w.item_from[window] if len(pair) else np.empty(0, np.int64)
        inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        items = w.item_of[np.repeat(w.item_from[window], sizes) + inner] if len(pair) else np.empty(0, np.int64)
        listed = np.unique(np.repeat(document, sizes) * max(1, len(w.names)) + items)
        item_owner, item = listed // max(1, len(w.names)), listed % max(1, len(w.names))
        offsets = lambda owners: pa.array(np.searchsorted(owners, np.arange(n + 1)).astype(np.int32))
        spans = pa.StructArray.from_arrays([pa.array(start - base[owner]), pa.array(stop - base[owner])], ["start", "stop"])
        names = pa.array(w.names, pa.string()).take(pa.array(item)) if len(item) else pa.array([], pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(self.rows, pa.int64()), pa.array(self.sizes, pa.int64()), pa.ListArray.from_arrays(offsets(owner), spans), pa.ListArray.from_arrays(offsets(item_owner), names)],
            ["_row", "n_words", "spans", "items"],
        )


def _search(rows: DataFrame, windows: Windows, key: T.DataType) -> DataFrame:
    """Spans and items of the rows (key, _row, text); one narrow pass."""
    sent = rows.sparkSession.sparkContext.broadcast(windows)
    schema = T.StructType([T.StructField("_key", key), *T.StructType.fromDDL(_FOUND).fields])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys = Shard(sent.value), []

        def close() -> pa.RecordBatch:
            found = shard.close()
            return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), *found.columns], ["_key", *found.schema.names])

        for part in byte_slices(batches, 2):
            keys.append(part.column(0))
            for row, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                shard.add(row, text)
            if shard.full():
                yield close()
                shard, keys = Shard(sent.value), []
        if shard.rows:
            yield close()

    return rows.mapInArrow(search, schema)


def find_passages(
    documents: DataFrame, items: DataFrame, *, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", window: int = WINDOW, wave_words: int = WAVE_WORDS,
) -> DataFrame:
    """key, n_words, spans (word positions, half-open, merged) and items (ids as strings, sorted) of every document."""
    spark = documents.sparkSession
    named = items.select(F.col(item_key).cast("string").alias("id"), text_or_empty(item_text).alias("text"))
    size = named.agg(F.coalesce(F.sum(F.regexp_count(F.lower("text"), F.lit(WORD))), F.lit(0))).first()[0]
    waves = max(1, -(-int(size) // wave_words))
    rows = documents.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_row"), text_or_empty(text).alias("_text"))
    if waves > 1:
        rows = materialize(rows, "documents")
    kind = rows.schema["_key"].dataType
    parts = []
    for wave in range(waves):
        here = named if waves == 1 else named.where(F.pmod(F.xxhash64("id", "text"), F.lit(waves)) == wave)
        parts.append(_search(rows, Windows.of([(r["id"], r["text"]) for r in here.collect()], window), kind))
    if waves == 1:
        return parts[0].select(F.col("_key").alias(key), "n_words", "spans", "items")
    # A row's spans and items of all waves, at most a wave's each, written by then.
    found = materialize(parts[0], "wave-0")
    for i, part in enumerate(parts[1:], 1):
        found = found.unionByName(materialize(part, f"wave-{i}"))
    merged = found.groupBy("_row").agg(
        F.first("_key").alias("_key"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return merged.select(F.col("_key").alias(key), "n_words", _merged("spans").alias("spans"), "items")


def _merged(spans: str | Column) -> Column:
    """Union of spans in ascending order."""

    @F.pandas_udf("array<struct<start:long,stop:long>>")
    def merge(lists):  # noqa: ANN001, ANN202
        out = []
        for spans_ in lists:
            start, stop = merge_spans(np.array([s["start"] for s in spans_], np.int64), np.array([s["stop"] for s in spans_], np.int64))
            out.append([{"start": int(a), "stop": int(b)} for a, b in zip(start, stop, strict=True)])
        import pandas as pd

        return pd.Series(out)

    return merge(spans)


def contamination(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256 and contaminated, from the rows of `find_passages`."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return found.select(
        key, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def cut_passages(documents: DataFrame, items: DataFrame, *, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents with their columns, their texts without the characters from the first to the last word of each span."""
    import re

    pattern = re.compile(WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60"))
    rows = materialize(documents.select(F.struct(*[F.col(c) for c in documents.columns]).alias("row"), F.monotonically_increasing_id().alias("_id")), "numbered")
    found = find_passages(rows.select("_id", F.col("row").getField(text).alias("text")), items, key="_id", window=window).where(F.size("spans") > 0).select("_id", "spans")

    @F.pandas_udf("string")
    def cut(texts, spans):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for value, lists in zip(texts, spans, strict=True):
            if value is None or lists is None:
                out.append(value)
                continue
            places = [m.span() for m in pattern.finditer(value)]
            pieces, at = [], 0
            for s in lists:
                pieces.append(value[at : places[s["start"]][0]])
                at = places[s["stop"] - 1][1]
            out.append("".join([*pieces, value[at:]]))
        return pd.Series(out, dtype=object)

    joined = rows.join(found, "_id", "left")
    clean = F.when(F.col("spans").isNull(), F.col("row").getField(text)).otherwise(cut(F.col("row").getField(text), F.col("spans")))
    return joined.select(*[clean.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in documents.columns])


def contamination_sql() -> str:
    """DuckDB SQL of the query: phrases of every length that windows have, joined as texts."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH item_words AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS size, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce({words}, []) AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT row_no, size, i, array_to_string(w[i : i + size - 1], ' ') AS phrase
  FROM (SELECT row_no, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)),
hits AS (SELECT row_no, i, p.size, item FROM places p JOIN windows v ON p.size = v.size AND p.phrase = v.phrase),
hit_words AS (SELECT row_no, count(DISTINCT pos) AS n_hit FROM (SELECT row_no, unnest(range(i, i + size)) AS pos FROM hits) GROUP BY row_no),
hit_items AS (SELECT row_no, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY row_no)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (row_no) LEFT JOIN hit_items USING (row_no)"""
