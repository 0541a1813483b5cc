"""Trie of conversation prefixes, screened by count-min counters.

Conversations are ordered by turn and rebuilt: the first h turns of a conversation's head, then its own after its first h. Each distinct sequence of first
d rebuilt turns is a node.

1. Turns become digests of (role, text); the texts go no further. Rows are sorted by range, so that a task gets a stretch of (block of a head, conversation,
   turn), however long a conversation is. A task turns its stretch into segments of at most `SEGMENT` turns with the digest of every prefix: a polynomial of the turns'
   digests in two lanes modulo 2^61 - 1, so that a stretch that begins within a conversation is shifted later by what stands before. What crosses the borders
   of tasks (at most three runs a task) is put together on the driver; the rebuilt prefixes follow from it in a narrow pass.
2. Every task counts its prefix digests in count-min counters, capped at two and added over all tasks. An estimate of one proves that no other conversation
   has the prefix, nor any longer one of this conversation. Such tails become nodes where they are, and are not shuffled. `MAX_CELLS` bounds the counters: with many more prefixes
   fewer singletons are proven and more rows are shuffled, with the same result.
3. Prefixes that may be shared are grouped exactly by depth and digest. Sums over subtrees need no walk up the tree: a node's members carry them. A text that n members share counts
   n - 1 times, so all members but the smallest add its length, summed from the end of each conversation; likewise the smallest member of each leaf adds one.

Hot nodes: grouping combines in the tasks first; joins with nodes take those of many members by broadcast, of which there are at most `HOT_NODES` by the choice of the limit,
and all others by shuffle. Ids of members that end in a node are sorted by range, joined into pieces and hashed in order, a piece at a time.

Null roles and texts are empty; turns of equal number are ordered by their digest; repeated rows are turns of their own. Rows without a conv_id take no part.
An empty table gives no rows. Other columns are dropped. Remainders have the sign of conv_id. Prefixes count as equal if 120 bits of digest are.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowprofile.llm.collocations import counter_blocks, screen
from flowprofile.llm.common import materialize

HEAD_EVERY, HEAD_TURNS = 100, 6
#: Turns of one segment.
SEGMENT = 4096
#: Counters of each row of the count-min sketch at most, a power of two.
MAX_CELLS = 1 << 22
SKETCH_ROWS = 3
#: Nodes whose joins go by broadcast at most.
HOT_NODES = 10_000
#: Ids hashed as one piece.
PIECE = 4096

PRIME = (1 << 61) - 1
BASES = (1_490_116_119_384_765_631, 2_177_953_337_809_371_149)
_EMPTY = hashlib.sha256(b"").hexdigest()


def digests(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(block, conv, turn, a, b, chars) of every turn: two 60-bit halves of the digest of role and text, and the text's code points."""
    r, t = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    turns = conversations.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), r.alias("role"), t.alias("text")).where(F.col("conv").isNotNull())
    hashed = turns.select("conv", "turn", F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256).alias("h"), F.char_length("text").cast("long").alias("chars"))
    lane = lambda at: F.conv(F.substring("h", at, 15), 16, 10).cast("long")
    return hashed.select((F.col("conv") - F.col("conv") % HEAD_EVERY).alias("block"), "conv", "turn", lane(1).alias("a"), lane(16).alias("b"), "chars")


# ---------------------------------------------------------------- segments of stretches

_OWN = (
    "border boolean, p int, block long, conv long, start long, a array<long>, b array<long>, chars array<long>, before array<long>, last boolean,"
    " first array<array<long>>, head array<array<long>>, head_place int"
)


class Run:
    """The turns of one conversation within one stretch; `first` holds (a, b, chars) after each of its first turns."""

    def __init__(self, conv: int, place: int) -> None:
        self.conv, self.place, self.size = conv, place, 0
        self.state = (0, 0)
        self.first: list[list[int]] = []

    def add(self, a: int, b: int, chars: int) -> None:
        self.state = ((self.state[0] * BASES[0] + a + 1) % PRIME, (self.state[1] * BASES[1] + b + 1) % PRIME)
        self.size += 1
        if self.size < HEAD_TURNS:
            self.first.append([*self.state, chars])


def _stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of the sorted rows of one task, and the runs at its borders."""
    p = TaskContext.get().partitionId()
    schema = pa.schema([
        ("border", pa.bool_()), ("p", pa.int32()), ("block", pa.int64()), ("conv", pa.int64()), ("start", pa.int64()), *[(c, pa.list_(pa.int64())) for c in ("a", "b", "chars", "before")],
        ("last", pa.bool_()), ("first", pa.list_(pa.list_(pa.int64()))), ("head", pa.list_(pa.list_(pa.int64()))), ("head_place", pa.int32()),
    ])
    run: Run | None = None
    head: Run | None = None
    block, place, out, opening = None, 0, [], None
    turns: list[tuple[int, int, int]] = []
    before = (0, 0)

    def segment(last: bool) -> dict:
        a, b, chars = zip(*turns, strict=True)
        return {
            "border": False, "p": p, "block": block, "conv": run.conv, "start": run.size - len(turns), "a": list(a), "b": list(b), "chars": list(chars), "before": list(before), "last": last,
            "first": run.first, "head": head.first if head else [], "head_place": head.place if head else -1,
        }

    def border(r: Run) -> dict:
        return {
            "border": True, "p": p, "block": None, "conv": r.conv, "start": r.size, "a": None, "b": None, "chars": None, "before": list(r.state), "last": None, "first": r.first, "head": None,
            "head_place": r.place,
        }

    for batch in batches:
        for block_, conv, a, b, chars in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)], strict=True):
            if run is None or conv != run.conv:
                if run is not None:
                    out.append(segment(True))
                    opening = opening or run
                run, turns, before = Run(conv, place), [], (0, 0)
                if block_ != block:
                    block, head = block_, None
                if conv == block:
                    head = run
                place += 1
            elif len(turns) == SEGMENT:
                out.append(segment(False))
                turns, before = [], run.state
            run.add(a, b, chars)
            turns.append((*run.state, chars))
        if len(out) > 2000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if run is not None:
        out.append(segment(True))
        runs = {r.conv: r for r in (opening or run, head, run) if r is not None}
        yield pa.RecordBatch.from_pylist([*out, *map(border, runs.values())], schema)


class Borders:
    """Conversations at the borders of stretches: what stands before each run, and their first turns."""

    def __init__(self, rows: Sequence) -> None:
        runs = defaultdict(list)
        for r in sorted(rows, key=lambda r: r["p"]):
            runs[r["conv"]].append(r)
        #: (stretch, conversation) -> (turns, state before, whether it goes on later, all turns)
        self.spans: dict[tuple[int, int], tuple[int, tuple[int, int], bool, int]] = {}
        self.first: dict[int, list[list[int]]] = {}
        for conv, parts in runs.items():
            done, state, first = 0, (0, 0), []
            total = sum(r["start"] for r in parts)
            for i, r in enumerate(parts):
                if len(parts) > 1:
                    self.spans[r["p"], conv] = (done, state, i + 1 < len(parts), total)
                for k, (a, b, chars) in enumerate(r["first"], 1):
                    if len(first) < HEAD_TURNS - 1:
                        first.append([*shifted((a, b), state, k), chars])
                state, done = shifted(r["before"], state, r["start"]), done + r["start"]
            self.first[conv] = first


def shifted(own: Sequence[int], before: Sequence[int], turns: int) -> tuple[int, int]:
    """Digest of `before` followed by `turns` turns whose digest is `own`."""
    return tuple((o + s * pow(base, turns, PRIME)) % PRIME for o, s, base in zip(own, before, BASES, strict=True))


def kept_turns(conv: int) -> int:
    """h: how many turns a conversation takes from its head."""
    return zlib.crc32(str(conv).encode()) % HEAD_TURNS


_REBUILT = "conv long, depth long, a array<long>, b array<long>, chars array<long>, pa long, pb long, first boolean, last boolean"


def rebuilt(own: DataFrame, borders: Borders) -> DataFrame:
    """Segments of rebuilt conversations: digests of the prefixes from `depth` on, the digest before (pa, pb), and whether the segment is its conversation's first and last."""
    sent = own.sparkSession.sparkContext.broadcast(borders)
    longs = pa.list_(pa.int64())
    schema = pa.schema([
        ("conv", pa.int64()), ("depth", pa.int64()), ("a", longs), ("b", longs), ("chars", longs), ("pa", pa.int64()), ("pb", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_()),
    ])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Borders = sent.value
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                conv, p = r["conv"], r["p"]
                done, state, more, total = known.spans.get((p, conv), (0, (0, 0), False, None))
                first = known.first[conv] if total is not None else r["first"]
                begin, h = done + r["start"], kept_turns(conv)
                if r["head_place"] < 0 or r["head_place"] == 0 and (p, r["block"]) in known.spans:
                    head = known.first.get(r["block"], [])
                else:
                    head = r["head"]
                if conv == r["block"]:
                    head = first
                m = min(h, len(head))
                top = tuple(head[m - 1][:2]) if m else (0, 0)
                skip = tuple(first[h - 1][:2]) if h and len(first) >= h else (0, 0)
                gap = tuple((t - s) % PRIME for t, s in zip(top, skip, strict=True))
                # Rebuilt digest of the own turns up to number k (from 1): own digest + gap * base^(k - h).
                drop = min(max(0, h - begin), len(r["a"]))
                lanes = []
                for lane, base in enumerate(BASES):
                    factor, step = state[lane] * pow(base, r["start"] + drop, PRIME) % PRIME, gap[lane] * pow(base, max(0, begin + drop - h), PRIME) % PRIME
                    before = (r["before"] if not drop else [r["a"][drop - 1], r["b"][drop - 1]])[lane]
                    values = [(before + factor + step) % PRIME]
                    for value in r["ab"[lane]][drop:]:
                        factor, step = factor * base % PRIME, step * base % PRIME
                        values.append((value + factor + step) % PRIME)
                    lanes.append(values)
                chars = r["chars"][drop:]
                opens, last = begin == 0, r["last"] and not more
                if total is not None and total <= h:
                    last = opens
                if opens:
                    a, b, chars = ([x[i] for x in head[:m]] + y for i, y in enumerate((lanes[0][1:], lanes[1][1:], chars)))
                    out.append({"conv": conv, "depth": 1, "a": a, "b": b, "chars": chars, "pa": 0, "pb": 0, "first": True, "last": last})
                elif chars:
                    out.append({
                        "conv": conv, "depth": m + begin + drop - h + 1, "a": lanes[0][1:], "b": lanes[1][1:], "chars": chars, "pa": lanes[0][0], "pb": lanes[1][0], "first": False, "last": last,
                    })
            yield pa.RecordBatch.from_pylist(out, schema)

    return own.where("not border").mapInArrow(rebuild, _REBUILT)


# ---------------------------------------------------------------- count-min screen

_ODD = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0x165667B19E3779F9, 0xD6E8FEB86659FD93), (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def sketch_cells(a: np.ndarray, b: np.ndarray, row: int, cells: int) -> np.ndarray:
    """Counter of each digest in one row of the sketch."""
    x, y = (np.uint64(k) for k in _ODD[row])
    value = a.astype(np.uint64) * x ^ (b.astype(np.uint64) * y >> np.uint64(17))
    value = (value ^ value >> np.uint64(31)) * y
    return (value >> np.uint64(65 - int(cells).bit_length())).astype(np.int64)


def sketch(segments: DataFrame, cells: int) -> np.ndarray:
    """Bits, row by row: whether a counter has two or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SKETCH_ROWS * cells, np.uint32)
        for batch in batches:
            a, b = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
            for row in range(SKETCH_ROWS):
                cell, n = np.unique(sketch_cells(a, b, row, cells), return_counts=True)
                cell += row * cells
                table[cell] = np.minimum(table[cell] + n, 2)
        yield from counter_blocks(table)

    return screen(segments.select("a", "b").mapInArrow(count, "block long, counts binary"), 2, SKETCH_ROWS * cells)


_SCREENED = (
    "tail boolean, conv long, depth long, stop long, a long, b long, pa long, pb long, chars long, ends boolean, child_tail long, leaf_tail long, parent_single boolean"
)


def screened(segments: DataFrame, bits: np.ndarray, cells: int) -> DataFrame:
    """Rows of prefixes that may be shared, and one row per tail of proven singletons."""
    sent = segments.sparkSession.sparkContext.broadcast(bits)
    names = [c.split()[0] for c in _SCREENED.split(", ")]
    types = [pa.bool_() if c.endswith("boolean") else pa.int64() for c in _SCREENED.split(", ")]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.unpackbits(sent.value)[: SKETCH_ROWS * cells].astype(bool).reshape(SKETCH_ROWS, cells)
        for batch in batches:
            flat = [batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3)]
            maybe = np.logical_and.reduce([twice[row][sketch_cells(*flat, row, cells)] for row in range(SKETCH_ROWS)])
            out, at = [], 0
            for conv, depth, a, b, chars, pa_, pb, first, last in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                n = len(a)
                single = np.flatnonzero(~maybe[at : at + n])
                at += n
                s = int(single[0]) if len(single) else n
                if not first:
                    s = max(s, 1)  # its parent stands in another segment
                stop = n if last else max(s, n - 1)  # what another segment goes on from is no part of the tail
                has, leaf = int(stop > s), int(stop > s and last)
                if first:
                    out.append((False, conv, 0, 0, 0, 0, 0, 0, 0, last and n == 0, has if s == 0 else 0, leaf if s == 0 else 0, False))
                parent = (pa_, pb)
                for i in range(s):
                    top = i == s - 1
                    out.append((False, conv, depth + i, 0, a[i], b[i], *parent, chars[i], last and i == n - 1, has if top else 0, leaf if top else 0, False))
                    parent = (a[i], b[i])
                if has:
                    out.append((True, conv, depth + s, depth + stop - 1, 0, 0, *parent, 0, last, 0, 0, False))
                if stop < n and stop >= s:
                    parent = (a[stop - 1], b[stop - 1]) if stop else parent
                    out.append((False, conv, depth + stop, 0, a[stop], b[stop], *parent, chars[stop], False, 0, 0, bool(has)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names)

    return segments.mapInArrow(split, _SCREENED)


# ---------------------------------------------------------------- nodes

_NODE = ["depth", "a", "b"]


def _joined(rows: DataFrame, nodes: DataFrame, hot_from: int) -> DataFrame:
    """Rows with the columns of their node (depth, a, b, n, first, ...): nodes of `hot_from` members or more by broadcast, others by shuffle."""
    hot = rows.join(F.broadcast(nodes.where(F.col("n") >= hot_from)), _NODE, "left")
    cold = hot.where(F.col("first").isNull()).select(*rows.columns).join(nodes.where(F.col("n") < hot_from), _NODE)
    return hot.where(F.col("first").isNotNull()).unionByName(cold)


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) over (depth, a, b, conv): digest of the sorted ids, comma-joined."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, out = None, [], []

        def close() -> None:
            if ids:
                out.append((*node, ids[0], ",".join(map(str, ids))))

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 4 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))], [*_NODE, "low", "ids"])

        for batch in batches:
            for *here, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if here != node or len(ids) == PIECE:
                    close()
                    node, ids = here, []
                ids.append(conv)
            if len(out) > 1000:
                yield rows()
                out = []
        close()
        if out:
            yield rows()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 3 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))], [*_NODE, "ends_sha256"])

        for batch in batches:
            for *here, _, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if here != node:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = here, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if len(out) > 10_000:
                yield rows()
                out = []
        if node is not None:
            out.append((*node, state.hexdigest()))
            yield rows()

    placed = ends.repartitionByRange(*_NODE, "conv").sortWithinPartitions(*_NODE, "conv").mapInArrow(pieces, "depth long, a long, b long, low long, ids string")
    return placed.repartition(*_NODE).sortWithinPartitions(*_NODE, "low").mapInArrow(digest, "depth long, a long, b long, ends_sha256 string")


def _subtree_sums(rows: DataFrame) -> DataFrame:
    """The columns `saved` and `leaf` of (conv, depth) summed from the end of the conversation to each row, in two levels."""
    rows = rows.withColumn("chunk", F.expr("depth div 1024"))
    inner = Window.partitionBy("conv", "chunk").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy("conv").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("conv", "chunk").agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l")).select(
        "conv", "chunk", F.coalesce(F.sum("s").over(later), F.lit(0)).alias("s"), F.coalesce(F.sum("l").over(later), F.lit(0)).alias("l")
    )
    summed = rows.withColumn("saved", F.sum("saved").over(inner)).withColumn("leaf", F.sum("leaf").over(inner))
    return summed.join(chunks, ["conv", "chunk"]).select(*_NODE, (F.col("saved") + F.col("s")).alias("saved"), (F.col("leaf") + F.col("l")).alias("leaf"))


def prefix_trie(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", max_cells: int = MAX_CELLS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    order = ["block", F.col("conv") != F.col("block"), "conv", F.col("turn").asc_nulls_first(), "a", "b"]
    turns = digests(conversations, conv, turn, role, text)
    own = materialize(turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stretch, _OWN), "segments")
    borders = Borders(own.where("border").select("p", "conv", "start", "before", "first").collect())  # three rows per task at most
    segments = materialize(rebuilt(own, borders), "rebuilt")
    prefixes = segments.agg(F.coalesce(F.sum(F.size("a")), F.lit(0))).first()[0]
    cells = min(max_cells, 1 << max(14, (8 * int(prefixes) - 1).bit_length()))
    rows = materialize(screened(segments, sketch(segments, cells), cells), "screened")

    shared = rows.where("not tail")
    found = materialize(shared.groupBy(*_NODE).agg(
        F.min("conv").alias("first"), F.count(F.lit(1)).alias("n"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.max("parent_single").alias("parent_single"),
        F.sum("child_tail").alias("tails"),
    ), "nodes")
    # At most HOT_NODES nodes have that many members.
    hot_from = max(100, -(-int(found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // HOT_NODES))
    kids = found.where("depth > 0 and not parent_single").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("kids"))
    nodes = materialize(found.join(kids, _NODE, "left").withColumn("n_children", F.coalesce("kids", F.lit(0)) + F.col("tails")).drop("kids", "tails"), "nodes")

    members = _joined(shared.select("conv", *_NODE, "chars", "ends", "leaf_tail"), nodes.select(*_NODE, "n", "first", "n_children"), hot_from).select(
        "conv", *_NODE, F.when(F.col("conv") == F.col("first"), 0).otherwise(F.col("chars")).alias("saved"),
        (F.col("leaf_tail") + (F.col("ends") & (F.col("n_children") == 0) & (F.col("conv") == F.col("first"))).cast("long")).alias("leaf"),
    )
    sums = _subtree_sums(members).groupBy(*_NODE).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    done = nodes.join(sums, _NODE).join(end_digests(shared.where("ends").select(*_NODE, "conv")), _NODE, "left")
    known = {"conv_id": F.col("first"), "n_convs": F.col("n"), "n_children": F.col("n_children"), "n_leaves": F.col("n_leaves"), "saved_tokens": F.col("saved_tokens")}
    final = [F.col("depth").alias("at"), F.lit(0).cast("long").alias("stop"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"), F.lit(False).alias("ends")]
    up = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")]
    joint = done.select(*[c.alias(k) for k, c in known.items()], *final, "parent_single", *up)
    one = F.lit(1).cast("long")
    tails = rows.where("tail").select(
        F.col("conv").alias("conv_id"), one.alias("n_convs"), one.alias("n_children"), one.alias("n_leaves"), (one - one).alias("saved_tokens"), F.col("depth").alias("at"), "stop",
        F.lit(_EMPTY).alias("ends_sha256"), "ends", "parent_single", *up,
    )
    # Parents of tails and of nodes below the root.
    every = joint.where("at > 0 and not parent_single").unionByName(tails)
    parents = _joined(every, nodes.select(*_NODE, "n", "first"), hot_from).withColumnRenamed("first", "parent_conv_id")
    apart = joint.where("at = 0 or parent_single").withColumn("parent_conv_id", F.when(F.col("at") > 0, F.col("conv_id")))
    return _spread(parents.drop("n", *_NODE).unionByName(apart.drop(*_NODE)))


def _spread(rows: DataFrame) -> DataFrame:
    """Each tail as its nodes; other rows as they are."""
    tail, end = F.col("stop") > 0, (F.col("d") == F.col("stop")) & F.col("ends")
    spread = rows.withColumn("d", F.explode(F.sequence("at", F.greatest("at", "stop"))))
    own: Column = F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    return spread.select(
        "conv_id", F.col("d").alias("depth"), F.when(tail & (F.col("d") > F.col("at")), F.col("conv_id")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(tail & end, 0).otherwise(F.col("n_children")).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.when(tail & end, own).otherwise(F.col("ends_sha256")).alias("ends_sha256"),
    )


def prefix_trie_sql() -> str:
    """DuckDB SQL of the query, with whole turns as keys."""
    # CRC-32 of an id's digits, bit by bit.
    bits = "list_reduce(list_prepend(xor(c, o), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, o: {bits}), 4294967295)"
    return f"""
WITH own AS (
  SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text)) AS i
  FROM (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT c, {crc} % {HEAD_TURNS} AS h, c - c % {HEAD_EVERY} AS head FROM (SELECT DISTINCT c FROM own)),
sizes AS (SELECT c, count(*) AS n FROM own GROUP BY c),
taken AS (
  SELECT v.c, o.i AS d, role, text FROM convs v JOIN own o ON o.c = v.head AND o.i <= v.h
  UNION ALL
  SELECT v.c, o.i - v.h + least(v.h, coalesce(s.n, 0)), role, text FROM convs v JOIN own o ON o.c = v.c AND o.i > v.h LEFT JOIN sizes s ON s.c = v.head),
paths AS (SELECT v.c, coalesce(list(struct_pack(r := role, t := text) ORDER BY d) FILTER (d IS NOT NULL), []) AS path FROM convs v LEFT JOIN taken USING (c) GROUP BY v.c),
members AS (SELECT c, len(path) AS size, d, path[d].t AS last_text, min(c) OVER (PARTITION BY d, path[1 : d]) AS node FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM paths)),
nodes AS (
  SELECT d, node, count(*) AS n, max(length(last_text)) AS chars, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (size = d) AS ends FROM members GROUP BY d, node),
linked AS (SELECT x.*, m.node AS parent FROM nodes x LEFT JOIN members m ON m.c = x.node AND m.d = x.d - 1),
kids AS (SELECT d - 1 AS d, parent AS node, count(*) AS kids FROM linked WHERE d > 0 GROUP BY ALL),
whole AS (SELECT l.*, coalesce(kids, 0) AS kids FROM linked l LEFT JOIN kids USING (d, node)),
below AS (
  SELECT m.d, m.node, count(*) FILTER (x.kids = 0) AS leaves, sum((x.n - 1) * coalesce(x.chars, 0)) AS saved FROM whole x JOIN members m ON m.c = x.node AND m.d <= x.d GROUP BY ALL)
SELECT node AS conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, CAST(n AS BIGINT) AS n_convs, CAST(kids AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM whole JOIN below USING (d, node)"""
