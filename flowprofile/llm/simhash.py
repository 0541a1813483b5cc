"""SimHash fingerprints, near duplicates by BK-trees, and the groups they form.

A BK-tree keeps each fingerprint below a parent under the edge that is their Hamming distance; a search follows only the edges
within the radius of its own distance to the node (triangle inequality). Trees are built per shard, and shards are chosen such that
every pair of fingerprints within the radius meets in at least one shard:

* `linked_fingerprints` cuts the 64 bits into b blocks. Two fingerprints that differ in at most r bits agree in b - r blocks at least,
  so each choice of b - r blocks is a table whose shards agree in them. b is the smallest number for which a shard holds a few
  fingerprints on average; any b > r gives the same links.
* `near_groups` (five-word shingles, Jaccard similarity 0.8) shards by bands of min-hashes, as two texts of similarity 0.8 differ in about 10 of 64 bits,
  which no choice of blocks covers; min-hash signatures within `MARGIN` of the similarity join texts into families. Each family is then a shard whose
  trees propose pairs within the radius, and the exact similarity of the two shingle sets decides. Fingerprints here count each distinct
  shingle once, as the similarity does, so repeats within a text don't move them. A pair of similarity 0.8 misses all bands with a probability
  of 0.002, and the radius of 18 bits with about as much (0.024 for the smallest sets, 4 shingles against 5); higher similarities miss less.

The trees grow with the data, so they are not broadcast: a shard's fingerprints are shuffled to one task, which builds the tree and searches it.
Equal fingerprints are collapsed before. A shard of more than `SHARD_ROWS` fingerprints is never held by one task: its task passes the rows on
in blocks of that size, and each pair of blocks becomes a group of its own in a second step. What leaves a shard is one link per fingerprint
at most (to the root of its group within the shard), not its pairs. Links are joined into components by `components`.

Words are runs of bytes other than ASCII white space, A-Z lower-cased; a text of fewer words than a shingle is one shingle; a text without words
(null, empty) has the fingerprint zero, linked like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowprofile.llm.common import materialize, small, text_or_empty, text_udf
from flowprofile.llm.components import components

SEED = 42
SHINGLE, RADIUS = 3, 3
#: Fingerprints that one tree may hold.
SHARD_ROWS = 4096
#: Wanted mean number of fingerprints in a shard.
SHARD_MEAN = 4
_CHUNK = 1 << 16

# Near-duplicate stage: five words, similarity 0.8.
STAGE_SHINGLE, STAGE_SIMILARITY, STAGE_RADIUS = 5, 0.8, 18
LANES, BANDS, BAND_LANES = 128, 12, 4
MARGIN = 0.12
#: Texts of a family that one tree may hold, as their shingle sets are held with them.
FAMILY_ROWS = 1024


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: str, words_per_shingle: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included, as big-endian 64-bit values."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, dtype=">u8")
    joined = b" ".join(words)
    if len(words) <= words_per_shingle:
        digests = [xxhash.xxh64_digest(joined, SEED)]
    else:
        begins, at = [], 0
        for w in words:
            begins.append(at)
            at += len(w) + 1
        begins.append(at)
        digest = xxhash.xxh64_digest
        digests = [digest(joined[a : b - 1], SEED) for a, b in zip(begins, begins[words_per_shingle:])]
    return np.frombuffer(b"".join(digests), dtype=">u8")


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit number; a bit is 1 if it is set in over half the hashes."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, _CHUNK):
        octets = np.frombuffer(hashes[i : i + _CHUNK].tobytes(), dtype=np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(text: str | Column = "text", words_per_shingle: int = SHINGLE) -> Column:
    """Column of signed 64-bit fingerprints."""

    def start() -> Callable[[list], pa.Array]:
        return lambda texts: pa.array([fingerprint(shingle_hashes(t, words_per_shingle)) for t in texts], pa.int64())

    return text_udf("long", start)(text_or_empty(text))


def as_hex(value: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


# ---------------------------------------------------------------- trees


class BKTree:
    """Fingerprints as non-negative integers; each node is [value, position, {distance: child}]."""

    def __init__(self, radius: int) -> None:
        self.radius, self.root = radius, None

    def within(self, value: int) -> list[int]:
        """Positions of the fingerprints within the radius."""
        if self.root is None:
            return []
        radius, found, stack = self.radius, [], [self.root]
        while stack:
            node, position, children = stack.pop()
            distance = (node ^ value).bit_count()
            if distance <= radius:
                found.append(position)
            if children:
                low, high = distance - radius, distance + radius
                stack += [child for edge, child in children.items() if low <= edge <= high]
        return found

    def add(self, value: int, position: int) -> None:
        if self.root is None:
            self.root = (value, position, {})
            return
        node = self.root
        while True:
            edge = (node[0] ^ value).bit_count()
            child = node[2].get(edge)
            if child is None:
                node[2][edge] = (value, position, {})
                return
            node = child


def group_roots(values: Sequence[int], radius: int, similar: Callable[[int, int], bool] | None = None, first_query: int | None = None) -> list[int]:
    """Position of the root of each fingerprint's group; `similar` decides on a pair within the radius.

    From position `first_query` on, fingerprints search the tree but don't enter it.
    """
    tree, parent = BKTree(radius), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, value in enumerate(values):
        value &= 0xFFFFFFFFFFFFFFFF
        for j in tree.within(value):
            a, b = root(i), root(j)
            if a != b and (similar is None or similar(i, j)):
                parent[max(a, b)] = min(a, b)
        if first_query is None or i < first_query:
            tree.add(value, i)
    return [root(i) for i in range(len(values))]


# ---------------------------------------------------------------- shards

_MEMBERS = "t int, key long, node long, fp long, sig binary"
_LINKS = "a long, b long, block int, t int, key long, fp long, sig binary"


def same_lanes(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal lanes of two min-hash signatures."""
    return float((a == b).mean()) if len(a) else 1.0


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets of shingles."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


#: How the payloads of two members are compared: the values they hold, and their similarity.
COMPARE = {"lanes": ("<u2", same_lanes), "sets": ("<u8", jaccard)}


def _similar(payloads: Sequence[bytes], compare: str | None, similarity: float) -> Callable[[int, int], bool] | None:
    if compare is None:
        return None
    kind, measure = COMPARE[compare]
    values = [np.frombuffer(p, dtype=kind) for p in payloads]
    return lambda i, j: measure(values[i], values[j]) >= similarity


def shard_links(members: DataFrame, radius: int, compare: str | None = None, similarity: float = 0.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) between nodes of a shard (t, key) whose fingerprints `fp` are within the radius: a spanning star of each group.

    With `compare`, a link also needs that similarity of the binary payloads `sig`.
    """
    names = ["a", "b", "block", "t", "key", "fp", "sig"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows, block, out = None, [], 0, []

        def close() -> None:
            """Link the shard held, or pass its last block on."""
            if block:
                out.extend((r[0], None, block, *shard, r[1], r[2]) for r in rows)
            elif len(rows) > 1:
                similar = _similar([r[2] for r in rows], compare, similarity)
                for r, k in zip(rows, group_roots([r[1] for r in rows], radius, similar), strict=True):
                    if r[0] != rows[k][0]:
                        out.append((r[0], rows[k][0], -1, None, None, None, None))

        for chunk in batches:
            if not chunk.num_rows:
                continue
            t, key = chunk.column(0).to_numpy(), chunk.column(1).to_numpy()
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            nodes, fps, sigs = chunk.column(2).to_numpy(), chunk.column(3).to_numpy(), chunk.column(4)
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(t)], strict=True):
                here = (int(t[a]), int(key[a]))
                if here != shard:
                    close()
                    shard, rows, block = here, [], 0
                    if b - a == 1 and b < len(t):  # alone in its shard
                        shard = None
                        continue
                for i in range(a, b):
                    rows.append((int(nodes[i]), int(fps[i]), sigs[i].as_py()))
                    if len(rows) > shard_rows:
                        block += 1
                        out.extend((r[0], None, block - 1, *shard, r[1], r[2]) for r in rows[:shard_rows])
                        rows = rows[shard_rows:]
                if len(out) > 20_000:
                    yield batch(out)
                    out = []
        close()
        if out:
            yield batch(out)

    sharded = members.repartition("t", "key").sortWithinPartitions("t", "key", "node")
    found = materialize(sharded.mapInArrow(search, _LINKS), "shard-links")
    cold = found.where("block = -1").select("a", "b")
    hot = found.where("block >= 0").select("t", "key", "block", F.col("a").alias("node"), "fp", "sig")
    if hot.isEmpty():
        return cold

    # Every pair of blocks of a large shard is a group of two blocks at most.
    blocks = hot.groupBy("t", "key").agg(F.max("block").alias("last"))
    pairs = hot.join(blocks, ["t", "key"]).select(
        "t", "key", "node", "fp", "sig", "block",
        F.explode(F.concat(
            F.transform(F.sequence("block", "last"), lambda k: F.struct(F.col("block").alias("i"), k.alias("j"))),
            F.transform(F.filter(F.sequence(F.lit(0), "block"), lambda k: k < F.col("block")), lambda k: F.struct(k.alias("i"), F.col("block").alias("j"))),
        )).alias("p"),
    ).select("t", "key", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "node", "fp", "sig", "block")

    def between(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["block", "node"])
        nodes = group["node"].tolist()
        trees = int((group["block"] == group["i"]).sum())
        roots = group_roots(group["fp"].tolist(), radius, _similar(group["sig"].tolist(), compare, similarity), trees)
        links = [(n, nodes[k]) for n, k in zip(nodes, roots, strict=True) if n != nodes[k]]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return cold.unionByName(pairs.groupBy("t", "key", "i", "j").applyInPandas(between, "a long, b long"))


def block_masks(fingerprints_: int, radius: int) -> list[int]:
    """Signed masks of the blocks that must agree, one per table."""
    blocks = radius + 1
    while blocks < 16 and fingerprints_ / 2 ** (64 * (blocks - radius) / blocks) > SHARD_MEAN and comb(blocks + 1, radius) <= 100:
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - 1) & ~((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def linked_fingerprints(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, label) of the distinct fingerprints `fp` that have a link: label is the smallest fingerprint within reach."""
    masks = block_masks(distinct.count(), radius)
    members = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(masks)
    ])).alias("s")).select("s.t", "s.key", F.col("fp").alias("node"), "fp", F.lit(None).cast("binary").alias("sig"))
    return components(shard_links(members, radius))


def fingerprint_components(documents: DataFrame, *, text: str = "text", key: str = "doc_id", words_per_shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that can be reached; one row per document.

    Other columns are dropped, whatever their names. Null keys take part and are no component_id, unless no other is in reach (then null).
    An empty table gives no rows.
    """
    marked = materialize(documents.select(F.col(key).alias("doc_id"), fingerprints(text, words_per_shingle).alias("fp")), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    linked = linked_fingerprints(distinct, radius)
    reached = linked.join(distinct, linked["node"] == distinct["fp"]).select("node", "label", "first")
    lowest = reached.groupBy("label").agg(F.min("first").alias("component"))
    moved = reached.join(lowest, "label").select(F.col("node").alias("fp"), "component")
    found = distinct.join(moved, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    return marked.join(found, "fp").select("doc_id", as_hex("fp").alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- similarity of shingles


def lane_factors() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of the min-hash lanes."""
    generator = np.random.default_rng(SEED)
    return generator.integers(0, 1 << 32, LANES, dtype=np.uint32) | np.uint32(1), generator.integers(0, 1 << 32, LANES, dtype=np.uint32)


def signature(hashes: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Smallest value of each lane over the shingles."""
    low = np.full(len(factors), 0xFFFFFFFF, dtype=np.uint32)
    values = (hashes.astype(np.uint64) >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(values), 2048):
        low = np.minimum(low, (values[i : i + 2048, None] * factors + offsets).min(axis=0))
    return low


def _sketched(documents: DataFrame, text: str, key: str, keep: Sequence[str], words_per_shingle: int) -> DataFrame:
    """row, text, doc_id, uid, fp, sig and bands of every document, written once; that fixes the row numbers uid."""
    def start() -> Callable[[list], pa.Array]:
        factors, offsets = lane_factors()

        def sketch_of(texts: list) -> pa.Array:
            fps, sigs, bands = [], [], []
            for t in texts:
                hashes = np.unique(shingle_hashes(t, words_per_shingle))
                low = signature(hashes, factors, offsets)
                fps.append(fingerprint(hashes))
                sigs.append((low & np.uint32(0xFFFF)).astype("<u2").tobytes())
                parts = low[: BANDS * BAND_LANES].reshape(BANDS, BAND_LANES)
                bands.append([int.from_bytes(xxhash.xxh64_digest(b.tobytes(), i), "big", signed=True) for i, b in enumerate(parts)])
            return pa.StructArray.from_arrays([pa.array(fps, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["fp", "sig", "bands"])

        return sketch_of

    sketch = text_udf("fp long, sig binary, bands array<long>", start)
    others = [c for c in keep if c != text]
    return materialize(
        documents.select(
            F.struct(*[F.col(c) for c in others], F.lit(0).alias("_")).alias("row"), F.col(text).alias("text"), F.col(key).alias("doc_id"),
            F.monotonically_increasing_id().alias("uid"), sketch(text_or_empty(text)).alias("s"),
        ).select("row", "text", "doc_id", "uid", "s.*"), "sketches",
    )


def _groups(marked: DataFrame, words_per_shingle: int, similarity: float, radius: int) -> DataFrame:
    """(uid, group) of every document: the smallest (doc_id, uid) of its near duplicates."""
    light = marked.select("doc_id", "uid", "fp", "sig", "bands")
    # Texts with one fingerprint and one signature are one class: copies cost one row from here on.
    classes = materialize(
        light.groupBy("fp", "sig").agg(F.min(F.struct("doc_id", "uid")).alias("first"), F.first("bands").alias("bands")).withColumn("node", F.col("first.uid")), "classes"
    )
    keyed = classes.select("node", F.posexplode("bands").alias("t", "key"))
    shared = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "key")
    members = keyed.join(shared, ["t", "key"], "left_semi").join(classes.select("node", "fp", "sig"), "node").select("t", "key", "node", "fp", "sig")
    families = materialize(components(shard_links(members, radius, "lanes", similarity - MARGIN)).select("node", F.col("label").alias("key")), "families")

    def start() -> Callable[[list], pa.Array]:
        return lambda texts: pa.array([np.unique(shingle_hashes(t, words_per_shingle).astype("<u8")).tobytes() for t in texts], pa.binary())

    shingle_set = text_udf("binary", start)
    texts = marked.join(small(families.withColumnRenamed("node", "uid")), "uid").select(
        F.lit(0).alias("t"), "key", F.col("uid").alias("node"), "fp", shingle_set(text_or_empty("text")).alias("sig")
    )
    linked = components(shard_links(texts, radius, "sets", similarity, FAMILY_ROWS))
    reached = linked.join(classes.select("node", "first"), "node")
    lowest = reached.groupBy("label").agg(F.min("first").alias("group"))
    moved = reached.join(lowest, "label").select("node", "group")
    grouped = classes.join(moved, "node", "left").select("fp", "sig", F.coalesce("group", "first").alias("group"))
    return light.select("uid", "fp", "sig").join(grouped, ["fp", "sig"]).select("uid", "group")


def near_groups(
    documents: DataFrame, *, text: str = "text", key: str = "doc_id", keep: Sequence[str] = ("doc_id",), words_per_shingle: int = STAGE_SHINGLE,
    similarity: float = STAGE_SIMILARITY, radius: int = STAGE_RADIUS,
) -> DataFrame:
    """A struct `row` with the columns `keep` (but the text), then `group` and `stays`; one row per document.

    Documents with the same shingles, and those linked by a similarity of `similarity` or more, are one group, named by its smallest
    (doc_id, row number); that row stays. Null doc_ids come first. Documents without words are copies of each other.
    """
    marked = _sketched(documents, text, key, keep, words_per_shingle)
    groups = _groups(marked, words_per_shingle, similarity, radius)
    return marked.select("row", "uid").join(groups, "uid").select("row", F.col("group.doc_id").alias("group"), (F.col("uid") == F.col("group.uid")).alias("stays"))


def drop_near_duplicates(
    documents: DataFrame, *, text: str = "text", key: str = "doc_id", words_per_shingle: int = STAGE_SHINGLE, similarity: float = STAGE_SIMILARITY, radius: int = STAGE_RADIUS
) -> DataFrame:
    """The documents that stay, with their columns; groups as in `near_groups`."""
    marked = _sketched(documents, text, key, documents.columns, words_per_shingle)
    gone = materialize(_groups(marked, words_per_shingle, similarity, radius).where("uid != group.uid").select("uid"), "dropped")
    kept = marked.select("row", "text", "uid").join(small(gone), "uid", "left_anti")
    return kept.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in documents.columns])
