"""Exact, linearly interpolated quantiles of many columns without sorting or collecting them.

`percentile` keeps every distinct value of every column in one buffer, which neither fits nor merges
at scale, and `percentile_approx` is not exact. Here each pass counts the values in monotone bins
(map-side combined, a few thousand counters per column), finds the bins that hold the wanted ranks, and
the next pass splits only those. A bin holding a single value, however often, is final. The
number of passes depends on how close the values lie, not on how many there are or how they are
skewed: two or three for typical measurements, whatever the row count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowprofile.functions.aggregates import chunks, union_all
from flowprofile.functions.columns import as_doubles, number, q, text
from flowprofile.functions.storage import materialize

BINS_PER_OCTAVE = 64
SUB_BINS = 65536
FEATURES_PER_PASS = 32
BRACKETS_PER_PASS = 24
# Low bits of a double that its bin leaves out: the sign, the exponent and six bits of the fraction remain, 64 bins per octave. Bins that a task holds before it sends them.
LOW_BITS, HELD_BINS = 46, 1 << 20


def _long(df: DataFrame, names: Sequence[str], by: str) -> DataFrame:
    """(grp, fid, v): one row per non-missing value; narrow, never shuffled as such."""
    grp = f"cast({q(by)} as string) as grp"
    values = ", ".join(f"nullif(cast({q(n)} as double), double('NaN'))" for n in names)
    return df.selectExpr(grp, f"posexplode(array({values})) as (fid, v)").where("v is not null")


def _first_bins(values: DataFrame) -> DataFrame:
    # Logarithmic bins on each side of zero; 0 is a bin of its own and ±inf are the outermost ones.
    magnitude = f"cast(floor((log2(abs(v)) + 1100D) * {BINS_PER_OCTAVE}) as bigint)"
    bin_sql = (
        "case when v = 0 then 0L when v = double('Infinity') then 1000000L when v = double('-Infinity') then -1000000L "
        f"when v > 0 then {magnitude} else -{magnitude} end"
    )
    return values.selectExpr("grp", "fid", f"{bin_sql} as bin", "v + 0D as v").groupBy("grp", "fid", "bin").agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def _counted_bins(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(grp, fid, bin, n, lo, hi) of whole columns, as `_first_bins` has them: counted in Arrow batches a column at a time, so no row per value is made.

    A bin is the first bits of the value, in the order of the values; 0 is a bin of its own, and so are the infinities.
    """
    kept = (1 << (63 - LOW_BITS)) - 1

    def binned(column: pa.Array) -> tuple[np.ndarray, ...] | None:
        values = column.drop_null().to_numpy(zero_copy_only=False) + 0.0
        values.sort()
        values = values[:np.searchsorted(values, np.nan)]
        if not len(values):
            return None
        first = values.view(np.int64) >> LOW_BITS
        bins = np.where(first < 0, first ^ kept, first + (values > 0))
        starts = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
        ends = np.append(starts[1:], len(values))
        return bins[starts], ends - starts, values[starts], values[ends - 1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [[] for _ in names], 0

        def pieces() -> Iterator[pa.RecordBatch]:
            for place, found in enumerate(held):
                if found:
                    bins, sizes, lows, highs = map(np.concatenate, zip(*found, strict=True))
                    found.clear()
                    order = np.argsort(bins, kind="stable")
                    bins = bins[order]
                    starts = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(starts), place, np.int32)), pa.array(bins[starts]), pa.array(np.add.reduceat(sizes[order], starts)),
                        pa.array(np.minimum.reduceat(lows[order], starts)), pa.array(np.maximum.reduceat(highs[order], starts))], names=["fid", "bin", "n", "lo", "hi"])

        for batch in batches:
            for place, column in enumerate(batch.columns):
                if (found := binned(column)) is not None:
                    held[place].append(found)
                    n += len(found[0])
            if n >= HELD_BINS:
                yield from pieces()
                n = 0
        yield from pieces()

    plain = df.selectExpr(*[f"cast({q(c)} as double) as c{i}" for i, c in enumerate(names)])
    bins = plain.mapInArrow(count, "fid int, bin bigint, n bigint, lo double, hi double")
    return bins.groupBy(F.lit("").alias("grp"), "fid", "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _inside(df: DataFrame, names: Sequence[str], brackets: Sequence[tuple]) -> DataFrame:
    """(bracket, bin, v) for the values inside a bracket (fid, lo, hi), emitted by the scan itself without a join."""
    def part(numbered: list[tuple[int, tuple]]) -> DataFrame:
        used = sorted({names[fid] for _, (fid, _, _) in numbered})

        def element(i: int, bracket: tuple) -> str:
            fid, lo, hi = bracket
            v = q(names[fid])
            return f"case when {v} between {number(lo)} and {number(hi)} then struct({i} as bracket, {v} as v) end"
        inside = as_doubles(df, used).selectExpr("inline(array(" + ", ".join(element(i, b) for i, b in numbered) + "))").where("bracket is not null")
        first = numbered[0][0]
        lows = "array(" + ", ".join(number(b[1]) for _, b in numbered) + ")"
        widths = "array(" + ", ".join(number(b[2] - b[1]) for _, b in numbered) + ")"
        step = f"(v - element_at({lows}, bracket - {first} + 1)) / element_at({widths}, bracket - {first} + 1) * {SUB_BINS}"
        return inside.selectExpr("bracket", f"cast(least(floor({step}), {SUB_BINS - 1}) as bigint) as bin", "v + 0D as v")

    return union_all([part(numbered) for numbered in chunks(list(enumerate(brackets)), BRACKETS_PER_PASS)])


_TARGET = ("fid", "prob", "side", "frac", "rank")
_STATE = "bracket int, fid int, prob double, side int, frac double, rank bigint"


def _ranked(bins: DataFrame, probs: Sequence[float]) -> DataFrame:
    """(grp, fid, prob, side, frac, rank, n, lo, hi): the first bins that hold the wanted ranks; two rows per (group, feature, prob)."""
    wanted = "array(" + ", ".join(number(p) for p in probs) + ")"
    return bins.selectExpr(
        "*",
        "sum(n) over (partition by grp, fid order by bin) as upto",
        "sum(n) over (partition by grp, fid) as total",
    ).selectExpr("*", f"explode({wanted}) as prob").selectExpr(
        "grp", "fid", "prob", "n", "upto", "lo", "hi", "prob * (total - 1) as pos",
    ).selectExpr("*", "explode(array(0, 1)) as side").selectExpr(
        "grp", "fid", "prob", "side", "n", "upto", "lo", "hi", "pos - floor(pos) as frac",
        "case when side = 0 then cast(floor(pos) as bigint) else cast(ceil(pos) as bigint) end as r",
    ).where("r < upto and r >= upto - n").selectExpr(
        "grp", "fid", "prob", "side", "frac", "r - (upto - n) as rank", "n", "lo", "hi")


def exact_quantiles(df: DataFrame, features: Sequence[str], probs: Sequence[float]) -> list[dict]:
    """Rows `{feature, prob, lower, upper, frac, value}`; runs a few jobs.

    `lower`/`upper` are the order statistics around the quantile, `value` their interpolation, so that a
    monotone transform of the column can be applied to them before interpolating. Columns without values yield
    no row. The result has |features| x |probs| rows; for quantiles per group see `grouped_quantiles`.
    """
    out: list[dict] = []
    for part in chunks(features, FEATURES_PER_PASS):
        out += _quantiles(df, part, probs)
    return out


def _quantiles(df: DataFrame, names: list[str], probs: Sequence[float]) -> list[dict]:
    spark = df.sparkSession
    # Two rows per (feature, prob).
    state = [r.asDict() for r in _ranked(_counted_bins(df, names), probs).collect()]

    while True:
        for s in state:
            # Settled when the bin holds one value, or when its first or last element is wanted.
            if s["rank"] == 0:
                s["hi"] = s["lo"]
            elif s["rank"] == s["n"] - 1:
                s["lo"] = s["hi"]
        unsettled = [s for s in state if s["lo"] != s["hi"]]
        if not unsettled:
            break
        # At most 2 x probs x features brackets, whatever the table size.
        brackets = sorted({(s["fid"], s["lo"], s["hi"]) for s in unsettled})
        bracket_of = {b: i for i, b in enumerate(brackets)}
        targets = spark.createDataFrame(
            [(bracket_of[s["fid"], s["lo"], s["hi"]], *(s[f] for f in _TARGET)) for s in unsettled], _STATE)
        split = (
            _inside(df, names, brackets)
            .groupBy("bracket", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .selectExpr("*", "sum(n) over (partition by bracket order by bin) as upto")
        )
        found = (
            split.join(F.broadcast(targets), "bracket").where("rank < upto and rank >= upto - n")
            .withColumn("rank", F.expr("rank - (upto - n)")).select(*_TARGET, "n", "lo", "hi")
        )
        state = [s for s in state if s["lo"] == s["hi"]] + [r.asDict() for r in found.collect()]

    by_target: dict[tuple, dict] = {}
    for s in state:
        slot = by_target.setdefault((s["fid"], s["prob"]), {"frac": s["frac"]})
        slot["lower" if s["side"] == 0 else "upper"] = s["lo"]
    return [
        {"feature": names[f], "prob": p, **slot, "value": interpolate(slot["lower"], slot["upper"], slot["frac"])}
        for (f, p), slot in sorted(by_target.items())
    ]


def interpolate(lower: float, upper: float, frac: float) -> float:
    if lower == upper or frac == 0.0:
        return lower
    return lower + (upper - lower) * frac if math.isfinite(upper - lower) else (upper if frac > 0 else lower)


def grouped_quantiles(df: DataFrame, features: Sequence[str], probs: Sequence[float], by: str) -> DataFrame:
    """(grp, feature, prob, value) per value of `by` (as text); groups and features without values have no row.

    What is known of the wanted ranks is a written table that is joined with the values, so one scan per refinement serves any number
    of groups and features, and nothing of it reaches the driver.
    """
    names = list(features)
    values = _long(df, names, by)
    settle = [
        "grp", "fid", "prob", "side", "frac", "rank", "n",
        "case when rank > 0 and rank = n - 1 then hi else lo end as lo", "case when rank = 0 then lo else hi end as hi",
    ]
    state = materialize(_ranked(_first_bins(values), probs).selectExpr(*settle), "ranks")
    while not (unsettled := state.where("lo != hi")).isEmpty():
        brackets = unsettled.select("grp", "fid", "lo", "hi").distinct()
        step = f"(v - lo) / (hi - lo) * {SUB_BINS}"
        split = (
            values.join(brackets, ["grp", "fid"]).where("v between lo and hi")
            .selectExpr("grp", "fid", "lo as low", "hi as high", f"cast(least(floor({step}), {SUB_BINS - 1}) as bigint) as bin", "v + 0D as v")
            .groupBy("grp", "fid", "low", "high", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .selectExpr("*", "sum(n) over (partition by grp, fid, low, high order by bin) as upto")
        )
        targets = unsettled.selectExpr("grp", "fid", "prob", "side", "frac", "rank", "lo as low", "hi as high")
        found = split.join(targets, ["grp", "fid", "low", "high"]).where("rank < upto and rank >= upto - n").selectExpr(
            "grp", "fid", "prob", "side", "frac", "rank - (upto - n) as rank", "n", "lo", "hi")
        state = materialize(state.where("lo = hi").unionByName(found.selectExpr(*settle)), "ranks")
    sides = state.groupBy("grp", "fid", "prob").agg(
        F.expr("max(case when side = 0 then lo end)").alias("lower"), F.expr("max(case when side = 1 then lo end)").alias("upper"), F.max("frac").alias("frac"))
    value = "case when lower = upper or frac = 0D then lower when abs(upper - lower) < double('Infinity') then lower + (upper - lower) * frac else upper end"
    return sides.selectExpr("grp", "element_at(array(" + ", ".join(text(n) for n in names) + "), fid + 1) as feature", "prob", f"{value} as value")


def quantile_table(df: DataFrame, features: Sequence[str], probs: dict[str, float], by: str | None = None) -> DataFrame:
    """(feature, one column per requested quantile), plus the group as text `grp` when `by` is given (groups without values are absent then)."""
    if by:
        columns = [F.expr(f"max(case when prob = {number(p)} then value end)").alias(name) for name, p in probs.items()]
        return grouped_quantiles(df, features, list(probs.values()), by).groupBy("grp", "feature").agg(*columns)
    rows: dict[str, dict] = {}
    for r in exact_quantiles(df, features, list(probs.values())):
        rows.setdefault(r["feature"], {})[r["prob"]] = r["value"]
    data = [(f, *[rows.get(f, {}).get(p) for p in probs.values()]) for f in features]
    return df.sparkSession.createDataFrame(data, "feature string, " + ", ".join(f"{name} double" for name in probs))
