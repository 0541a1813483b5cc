"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Targets. Sources by code point, null last, weigh `weights` in turn, repeating, and share all words. No target exceeds
   `max_epochs` times its source's words; the excess is shared again by weight until none is above.
2. Quotas. All words are dealt out in blocks of equal size. Sources get blocks by their highest quotients target / (2 n + 1);
   a source's blocks are dealt to its shards in the same way by their words. Quotas are integers, capped at `max_epochs` times what a source or
   shard holds. A block has 1 to `max_block` words, at most 1 in `blocks_per_source` of the smallest target, so that rounding to blocks stays small.
3. Selection. The documents of a shard stand in a seeded order and form a ring of words. Whole rounds of the ring are taken as
   often as the quota allows, and the rest is a run of blocks that begins at a seeded block. A document's words taken are its
   overlap with that: at most `max_epochs` times its size.

Scale: one pass counts words, and (row number, source, words, hashes, kept columns) is written once; the windows carry numbers only. A source is cut into shards of about
`SHARD_DOCS` documents (at most `MAX_SHARDS`), so a source that holds a third of all rows becomes many window groups; windows spill, nothing is gathered in
Python. The driver gets one row per source; a task of the quota step gets the shards of one source, at most `MAX_SHARDS` rows.

Null and empty texts have size 0 and none of their words can be taken. Rows of one id and text stand in the order of a hash of their kept columns; only rows that are
alike in all of those are interchangeable. An empty table gives no rows. Seed and data fix the result.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowprofile.llm.common import WORD, materialize, text_or_empty

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SHARD_DOCS = 4096
MAX_SHARDS = 65_536
MAX_BLOCK = 1024
BLOCKS_PER_SOURCE = 1000
#: The table of sources is broadcast up to this many rows, and joined by a shuffle beyond.
BROADCAST_SOURCES = 100_000


def word_count(text: str | Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def share_targets(sizes: Sequence[int], weights: Sequence[float], max_epochs: float = MAX_EPOCHS) -> list[float]:
    """Words each source should give: shares by weight of all words, none above `max_epochs` times its size."""
    targets = [0.0] * len(sizes)
    open_, left = [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        for i in open_:
            targets[i] = left * weights[i] / total
        full = [i for i in open_ if targets[i] > max_epochs * sizes[i]]
        if not full:
            break
        for i in full:
            targets[i] = float(max_epochs * sizes[i])
            left -= targets[i]
        closed = set(full)
        open_ = [i for i in open_ if i not in closed]
    return targets


def sainte_lague(shares: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Seats by highest quotients share / (2 n + 1), at most `caps`; ties go to the earlier party.

    All seats whose quotient is clearly high are dealt at once by a divisor; the last ones are dealt one by one.
    """
    share, cap = np.asarray(shares, dtype=float), np.asarray(caps, dtype=np.int64)
    cap = np.where(share > 0, cap, 0)
    seats = int(min(seats, cap.sum()))
    if seats <= 0:
        return [0] * len(share)

    def dealt(divisor: float) -> np.ndarray:
        return np.minimum(cap, np.floor(share / divisor + 0.5).astype(np.int64))

    low = high = share.sum() / seats
    while dealt(high).sum() > seats:
        high *= 2
    while dealt(low).sum() < seats and low > share.sum() * 1e-18:
        low /= 2
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (low, middle) if dealt(middle).sum() <= seats else (middle, high)
    given = dealt(high)
    left = seats - int(given.sum())
    queue = [(-share[i] / (2 * given[i] + 1), i) for i in range(len(share)) if given[i] < cap[i]]
    heapq.heapify(queue)
    while left and queue:
        _, i = heapq.heappop(queue)
        given[i] += 1
        left -= 1
        if given[i] < cap[i]:
            heapq.heappush(queue, (-share[i] / (2 * given[i] + 1), i))
    return given.tolist()


def mix(
    documents: DataFrame, *, text: str = "text", source: str = "source", key: str = "doc_id", keep: Sequence[str] = ("doc_id",),
    weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 7, max_block: int = MAX_BLOCK, blocks_per_source: int = BLOCKS_PER_SOURCE,
) -> DataFrame:
    """A struct `row` with the columns `keep`, then size, source_size, target, taken; one row per document.

    Other columns are dropped, whatever their names; the kept ones stay apart inside `row`.
    """
    spark = documents.sparkSession
    written = materialize(documents.select(
        F.monotonically_increasing_id().alias("uid"), F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"),
        F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("order"), F.xxhash64(*[F.col(c) for c in keep]).alias("tie"),
    ), "sized")
    sized = written.drop("row")  # the kept columns, texts among them, meet the mix at its end

    # One row per source.
    found = sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("size").alias("words")).toPandas()
    names = [None if pd.isna(s) else s for s in found["source"].astype(object)]
    place = sorted(range(len(names)), key=lambda i: (names[i] is None, names[i] or ""))
    sizes = [int(found["words"][i]) for i in place]
    targets = share_targets(sizes, [weights[k % len(weights)] for k in range(len(place))], max_epochs)
    smallest = min((t for t in targets if t > 0), default=1)
    block = int(max(1, min(max_block, smallest // blocks_per_source)))
    quotas = sainte_lague(targets, sum(sizes) // block, [max_epochs * s // block for s in sizes])
    sources = spark.createDataFrame(
        [
            (names[i], k, sizes[k], targets[k], quotas[k], int(min(MAX_SHARDS, -(-int(found["documents"][i]) // SHARD_DOCS))))
            for k, i in enumerate(place)
        ],
        "source string, sid int, source_size long, target double, blocks long, shards int",
    )
    if len(place) <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    placed = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).select(
        "uid", "size", "order", "tie", "sid", "source_size", "target", "blocks", F.expr("int(pmod(xxhash64(order), shards))").alias("shard")
    )

    def deal(shards: pd.DataFrame) -> pd.DataFrame:
        shards = shards.sort_values("shard")
        words = shards["words"].tolist()
        given = sainte_lague(words, int(shards["blocks"].iloc[0]), [max_epochs * w // block for w in words])
        return pd.DataFrame({"sid": shards["sid"], "shard": shards["shard"], "shard_words": words, "quota": given})

    # At most MAX_SHARDS rows per source.
    shard_words = placed.groupBy("sid", "shard").agg(F.sum("size").alias("words"), F.first("blocks").alias("blocks"))
    dealt = materialize(shard_words.groupBy("sid").applyInPandas(deal, "sid int, shard int, shard_words long, quota long"), "quotas")

    ring = Window.partitionBy("sid", "shard").orderBy("order", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stood = placed.select("*", F.sum("size").over(ring).alias("stop"))
    words = F.col("quota") * block
    begin = F.expr(f"pmod(xxhash64({seed}L, sid, shard), greatest(1L, shard_words div {block})) * {block}")

    def overlap(start: Column, stop: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("stop"), stop) - F.greatest(F.col("stop") - F.col("size"), start))

    taken = (
        stood.join(dealt, ["sid", "shard"])
        .withColumn("rounds", F.when(F.col("shard_words") > 0, F.floor(words / F.col("shard_words"))).otherwise(0).cast("long"))
        .withColumn("rest", words - F.col("rounds") * F.col("shard_words")).withColumn("begin", begin)
        .select(
            "uid", "size", "source_size", "target",
            (F.col("rounds") * F.col("size") + overlap(F.col("begin"), F.col("begin") + F.col("rest"))
             + overlap(F.lit(0), F.col("begin") + F.col("rest") - F.col("shard_words"))).cast("long").alias("taken"),
        )
    )
    # The numbers are hashed, so the texts pass their shuffle without being sorted.
    return written.select("uid", "row").join(taken.hint("shuffle_hash"), "uid").select("row", "size", "source_size", "target", "taken")


def apply_mix(mixed: DataFrame) -> DataFrame:
    """The columns of `row`, each document as often as the mix takes it, rounded to whole documents."""
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return mixed.select("row", copies.alias("copies")).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
