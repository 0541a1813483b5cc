"""Connected components of a table of links, as DataFrame joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowprofile.llm.common import materialize

MAX_ROUNDS = 64


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of (a, b) can reach; nodes without a link are left out.

    Alternating large-star and small-star steps: every step points nodes at the smallest neighbour seen, so the number of rounds
    grows with the logarithm of a component's diameter. A hub with many links is a skewed join key, which adaptive execution
    splits, and a minimum, which is combined before the shuffle; no neighbourhood is ever collected. Each round is written, so a
    lost executor repeats one round at most.
    """
    edges = materialize(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        if state[0] == 0:
            break
        # Large star: neighbours above a node go to the smallest of the node and its neighbours.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: neighbours below a node, and the node, go to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = materialize(small.distinct(), "links")
        after = _state(edges)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    return row[0], row[1]
