"""Exact histogram of encoded lengths, and what suffix sums over it answer for every context limit.

One narrow pass encodes the documents; rows are combined map-side to one per length, so the shuffle carries histogram rows only.
Suffix sums run in two levels (ranges of lengths, then within a range), so no task holds more than one range of the histogram.

A row (n_tokens = L) says, over all documents: how many have this length, how many are at least as long, and
`truncated_total`, the tokens that are left when every document is cut at the limit L. Between two lengths of the histogram the
truncated total is linear: for L <= limit < next length it is truncated_total + (limit - L) * (documents_at_least - documents).
`quantile` is the share of documents not longer than L. Null and empty texts have length 0; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowprofile.llm.common import materialize

#: Lengths per range of the two-level suffix sums.
RANGE = 1024


def length_histogram(lengths: DataFrame, length: str | Column = "n_tokens") -> DataFrame:
    """One row per distinct length: n_tokens, documents, tokens."""
    n = (F.col(length) if isinstance(length, str) else length).cast("long").alias("n_tokens")
    return lengths.select(n).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("documents")).withColumn("tokens", F.col("n_tokens") * F.col("documents"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Add documents_at_least, tokens_at_least, truncated_total, total_tokens and quantile to each length.

    The histogram is written once, as it is read twice and its rows are few; the documents are encoded once.
    """
    ranged = materialize(histogram, "length-histogram").withColumn("_range", F.expr(f"n_tokens div {RANGE}"))
    later = Window.orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    # One row per range of lengths: at most longest document / RANGE rows meet here.
    ranges = ranged.groupBy("_range").agg(F.sum("documents").alias("_d"), F.sum("tokens").alias("_t")).select(
        "_range", F.coalesce(F.sum("_d").over(later), F.lit(0)).alias("_docs_after"), F.coalesce(F.sum("_t").over(later), F.lit(0)).alias("_tokens_after"),
        F.sum("_d").over(whole).alias("_docs"), F.sum("_t").over(whole).alias("_tokens"),
    )
    within = Window.partitionBy("_range").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.join(ranges, "_range").select(
        "n_tokens", "documents", "tokens", "_docs", F.col("_tokens").alias("total_tokens"),
        (F.sum("documents").over(within) + F.col("_docs_after")).alias("documents_at_least"),
        (F.sum("tokens").over(within) + F.col("_tokens_after")).alias("tokens_at_least"),
    )
    return summed.select(
        "n_tokens", "documents", "tokens", "documents_at_least", "tokens_at_least", "total_tokens",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("documents_at_least")).alias("truncated_total"),
        ((F.col("_docs") - F.col("documents_at_least") + F.col("documents")) / F.col("_docs")).alias("quantile"),
    )


def answer_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """context_limit, tokens kept, tokens lost and documents cut, for any limits (0 or more)."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    total = sums.agg(F.coalesce(F.max("total_tokens"), F.lit(0)).alias("_total"))
    # The longest length that is not above the limit, of the histogram, for each limit: conditional aggregates, no join of rows.
    picks = [
        F.max(F.when(F.col("n_tokens") <= x, F.struct("n_tokens", "truncated_total", (F.col("documents_at_least") - F.col("documents")).alias("longer")))).alias(f"l{x}")
        for x in sorted(set(map(int, limits)))
    ]
    found = sums.agg(F.max("documents_at_least").alias("_all"), *picks) if picks else None
    if found is None:
        return asked.select("context_limit", F.lit(0).cast("long").alias("kept"), F.lit(0).cast("long").alias("lost"), F.lit(0).cast("long").alias("cut"))
    rows = F.explode(F.array(*[
        F.struct(F.lit(x).cast("long").alias("context_limit"), F.col(f"l{x}").alias("p")) for x in sorted(set(map(int, limits)))
    ]))
    # Below the shortest length every document is cut to the limit itself.
    base = found.select("_all", rows.alias("r")).select(
        F.col("r.context_limit").alias("context_limit"),
        F.when(F.col("r.p").isNull(), F.col("r.context_limit") * F.coalesce("_all", F.lit(0)))
        .otherwise(F.col("r.p.truncated_total") + (F.col("r.context_limit") - F.col("r.p.n_tokens")) * F.col("r.p.longer")).alias("kept"),
        F.when(F.col("r.p").isNull(), F.coalesce("_all", F.lit(0))).otherwise(F.col("r.p.longer")).alias("cut"),
    )
    whole = total.first()[0]
    return base.select("context_limit", "kept", (F.lit(whole) - F.col("kept")).alias("lost"), "cut")
