"""Token-id files: independent zstandard frames, a table of documents, and a trailing seek table with per-frame checksums.

Layout of a file (all integers little-endian):

    frame 0 ... frame n-1    zstandard frames with a content checksum; each holds the ids of whole documents, 32 bits an id
    documents                skippable frame (magic 0x184D2A51): zstandard-compressed columns doc_id (int64), tokens (int64), null flags
    seek table               skippable frame (magic 0x184D2A5E) of the zstandard seekable format: per frame compressed size,
                             content size and the low 32 bits of its XXH64; then frame count, descriptor 0x80, magic 0x8F92EAB1

A reader seeks to the end, reads the two tables, and decompresses only the frames that hold the documents it was asked for.
Any zstandard tool can decompress a whole file, as skippable frames are passed over.

Documents are range-partitioned by (doc_id, hash of the text), so a doc_id that repeats often is split as well, and sorted; one task writes one file,
frame by frame, under a name of its own attempt, and renames it when complete: a lost executor leaves no half file under a
final name, and a repeated task writes the same bytes. Files need not fit in memory, frames do (`FRAME_BYTES` of ids, or one document).
Null doc_ids come first. Null texts are empty; every document ends with the end id. Order among equal doc_ids is by text.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowprofile.llm.common import materialize, new_path, text_or_empty

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
FRAME_BYTES = 1 << 20
LEVEL = 3
CACHE_WORDS = 120_000
_DOCS_MAGIC, _SEEK_MAGIC, _FOOTER_MAGIC = 0x184D2A51, 0x184D2A5E, 0x8F92EAB1
_FILE = "part int, path string, documents long, tokens long, file_bytes long"
# White space for str.split that the tokenizer does not take for white space.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_TRAILING = ".,!?;:"


def _byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    keep = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    extra = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(extra)) for b in range(256)]


class Tokenizing:
    """Ids of whole texts by the tokenizers library; every distinct chunk between white space is encoded once per worker.

    The tokenizer drops white space and none of its pieces crosses it, so a text's ids are those of its chunks in order.
    A chunk of Latin letters with trailing punctuation falls into the lower-cased letters and the punctuation.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.model = self.tool.model
        self.alphabet = _byte_alphabet()
        self.chunks: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}

    def library(self, text: str) -> bytes:
        return array("I", self.tool.encode(text, add_special_tokens=False).ids).tobytes()

    def chunk(self, chunk: str) -> bytes:
        core = chunk.rstrip(_TRAILING)
        if core.isalpha() and max(core) < "ƀ" and "İ" not in core and unicodedata.is_normalized("NFC", core):
            low = core.lower()
            ids = self.letters.get(low)
            if ids is None:
                ids = array("I", [t.id for t in self.model.tokenize("".join([self.alphabet[b] for b in low.encode()]))]).tobytes()
                if len(self.letters) < CACHE_WORDS and len(low) <= 64:
                    self.letters[low] = ids
            if len(core) < len(chunk):
                tail = chunk[len(core) :]
                end = self.chunks.get(tail)
                if end is None:
                    end = self.chunks[tail] = self.library(tail)
                ids += end
        else:
            ids = self.library(chunk)
        if len(self.chunks) < CACHE_WORDS and len(chunk) <= 64:
            self.chunks[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if _ODD_SPACE.search(text):
            return self.library(text)
        known, chunk = self.chunks.get, self.chunk
        return b"".join([known(w) or chunk(w) for w in text.split()])


@lru_cache(maxsize=1)
def tokenizing(path: str) -> Tokenizing:
    return Tokenizing(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


# ---------------------------------------------------------------- one file


class FileWriter:
    """Appends documents to an open binary stream."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> None:
        self.stream, self.frame_bytes = stream, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.waiting: list[bytes] = []
        self.waiting_bytes = 0
        self.seek = bytearray()
        self.frames, self.size = 0, 0
        self.ids, self.nulls, self.counts = array("q"), bytearray(), array("q")

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids) // 4)
        if self.waiting and self.waiting_bytes + len(ids) > self.frame_bytes:
            self.flush()
        self.waiting.append(ids)
        self.waiting_bytes += len(ids)

    def flush(self) -> None:
        content = b"".join(self.waiting)
        frame = self.compressor.compress(content)
        self.seek += struct.pack("<III", len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF)
        self._write(frame)
        self.frames += 1
        self.waiting, self.waiting_bytes = [], 0

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        if self.waiting:
            self.flush()
        columns = struct.pack("<Q", len(self.ids)) + self.ids.tobytes() + self.counts.tobytes() + bytes(self.nulls)
        table = self.compressor.compress(columns)
        self._write(struct.pack("<II", _DOCS_MAGIC, len(table)) + table)
        footer = struct.pack("<IBI", self.frames, 0x80, _FOOTER_MAGIC)
        self._write(struct.pack("<II", _SEEK_MAGIC, len(self.seek) + len(footer)) + bytes(self.seek) + footer)


class FileReader:
    """Random access to the documents of one file; decompresses a frame only when one of its documents is read."""

    def __init__(self, stream, size: int) -> None:
        self.stream = stream
        frames, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != _FOOTER_MAGIC:
            raise ValueError("not a token file: no seek table at its end")
        entries = self._at(size - 9 - 12 * frames, 12 * frames)
        self.frames = np.frombuffer(entries, dtype="<u4").reshape(frames, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        self.content = np.concatenate([[0], np.cumsum(self.frames[:, 1], dtype=np.int64)])
        magic, length = struct.unpack("<II", self._at(int(self.starts[-1]), 8))
        if magic != _DOCS_MAGIC:
            raise ValueError("not a token file: no table of documents")
        table = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[-1]) + 8, length))
        (n,) = struct.unpack_from("<Q", table)
        self.doc_ids = np.frombuffer(table, dtype="<i8", count=n, offset=8)
        self.counts = np.frombuffer(table, dtype="<i8", count=n, offset=8 + 8 * n)
        self.nulls = np.frombuffer(table, dtype="u1", count=n, offset=8 + 16 * n).astype(bool)
        self.offsets = np.concatenate([[0], np.cumsum(self.counts, dtype=np.int64)])

    def _at(self, start: int, length: int) -> bytes:
        self.stream.seek(start)
        return self.stream.read(length)

    def frame(self, k: int) -> bytes:
        """Content of one frame; raises if it does not have the checksum of the seek table."""
        size, length, checksum = map(int, self.frames[k])
        content = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), size), max_output_size=length) if length else b""
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged")
        return content

    def read(self, rows: Sequence[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """(row, ids) of the asked rows in ascending order, or of all; each needed frame is decompressed once."""
        held, content = -1, b""
        for row in range(len(self.doc_ids)) if rows is None else sorted(rows):
            start, stop = 4 * int(self.offsets[row]), 4 * int(self.offsets[row + 1])
            # A document lies whole in the last frame that begins at or before it.
            k = int(np.searchsorted(self.content, start, side="right")) - 1
            if start == stop:
                yield row, b""
                continue
            if k != held:
                held, content = k, self.frame(k)
            at = start - int(self.content[k])
            yield row, content[at : at + stop - start]


# ---------------------------------------------------------------- tables


def write_token_files(
    documents: DataFrame, folder: str | None = None, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None,
    end_id: int | None = END_ID, frame_bytes: int = FRAME_BYTES,
) -> DataFrame:
    """Encode whole texts and write them in ascending doc_id order; one row per file (part, path, documents, tokens, file_bytes, start).

    Files go to `folder`, which all executors reach (a new one below spark.checkpoint.dir by default). An empty table writes no file.
    """
    spark = documents.sparkSession
    target = (folder or new_path(spark, "token-files")).rstrip("/")
    path = tokenizer or default_tokenizer()
    ranged = (
        documents.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
        .withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        task = TaskContext.get()
        part = task.partitionId()
        tool, end = tokenizing(path), b"" if end_id is None else struct.pack("<I", end_id)
        store, root = arrow_fs.FileSystem.from_uri(target)
        store.create_dir(root, recursive=True)
        final, trial = f"{root}/part-{part:06d}.zst", f"{root}/.trial-{part:06d}-{task.taskAttemptId()}"
        with store.open_output_stream(trial) as stream:
            writer = FileWriter(stream, frame_bytes)
            for batch in chain([first], batches):
                for identifier, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    writer.add(identifier, tool.encode(words.as_py()) + end)
            writer.close()
        store.move(trial, final)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "path": [f"{target}/part-{part:06d}.zst"], "documents": [len(writer.ids)],
            "tokens": [sum(writer.counts)], "file_bytes": [writer.size],
        })

    files = materialize(ranged.mapInArrow(write, _FILE), "token-file-list")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("start", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))


def read_token_files(files: DataFrame, *, only: Sequence[int] | None = None, with_ids: bool = True) -> DataFrame:
    """Documents of the listed files: doc_id, start, n_tokens, ids_crc32 and, unless left out, ids (binary).

    `only` reads the documents with these ids and decompresses their frames alone. One task reads one file, frame by frame.
    """
    wanted = None if only is None else np.unique(np.asarray(list(only), dtype=np.int64))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    types = [pa.int64()] * 4 + [pa.binary()] * with_ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, begin in ((r["path"], r["start"]) for b in batches for r in b.to_pylist()):
            store, inner = arrow_fs.FileSystem.from_uri(path)
            with store.open_input_file(inner) as stream:
                reader = FileReader(stream, stream.size())
                rows = None if wanted is None else np.flatnonzero(np.isin(reader.doc_ids, wanted) & ~reader.nulls).tolist()
                out, held = [], 0
                for row, ids in reader.read(rows):
                    identifier = None if reader.nulls[row] else int(reader.doc_ids[row])
                    out.append((identifier, int(begin + reader.offsets[row]), len(ids) // 4, zlib.crc32(ids), *([ids] if with_ids else [])))
                    held += len(ids) * with_ids
                    if len(out) >= 4096 or held > 4 * FRAME_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    spread = files.select("part", "path", "start").repartitionByRange(max(1, files.count()), "part")
    return spread.mapInArrow(load, schema)
