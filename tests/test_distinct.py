"""Distinct rows by digest against Spark's grouping, also where digests collide."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from flowprofile.catalog import fixtures, queries
from flowprofile.config import LABEL_COLUMN
from flowprofile.operators import prep
from flowprofile.operators.distinct import distinct_rows, has_plain_columns

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "d double, f float, i int, l long, b boolean, s string, y byte, t timestamp, n date"


def odd_rows():
    rng = random.Random(2)
    nan = float("nan")
    values = (
        [None, nan, 0.0, -0.0, 1.5, float("inf"), -1e300], [None, nan, -0.0, 0.0, 2.5], [None, 0, -(2**31), 7], [None, 0, 2**63 - 1, -(2**63)], [None, True, False], [None, "", "a", "é", "A" * 300],
        [None, 0, 1], [None, datetime.datetime(1969, 12, 31, 23, 59, 59, 5), datetime.datetime(2024, 1, 1)], [None, datetime.date(1960, 1, 1), datetime.date(1970, 1, 1)],
    )
    return [tuple(rng.choice(v[: rng.choice([1, 2, len(v)])]) for v in values) for _ in range(3000)]


@pytest.mark.parametrize("bits", [64, 2, 1])
@pytest.mark.parametrize("batch", [10_000, 17])
def test_same_rows_as_grouping(spark, bits, batch):
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted(map(str, map(tuple, distinct_rows(df, bits).collect())))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(map(str, map(tuple, df.groupBy(*df.columns).count().drop("count").collect())))


def test_hot_rows_repeated_names_and_empty_tables(spark):
    hot = spark.range(30_000).select(F.lit(1.0).alias("x"), F.when(F.col("id") % 3 == 0, F.col("id") % 30).alias("y"), F.lit("k").alias("y"))
    assert distinct_rows(hot).columns == ["x", "y", "y"] and distinct_rows(hot).count() == 11
    assert distinct_rows(hot.limit(0)).count() == 0


def test_other_kinds_go_by_grouping(spark):
    df = spark.createDataFrame([([1, 2], 1.0), ([1, 2], 1.0)], "a array<int>, x double")
    assert not has_plain_columns(df) and prep.deduplicate(df).count() == 1


def test_cleaning_compiles(spark):
    """No generated method of cleaning is beyond what the JVM compiles."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = prep.clean(fixtures.flows(spark, SF_DIR), queries.FEATURES, LABEL_COLUMN)._jdf.queryExecution()
        plan.executedPlan()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    stages = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(plan.executedPlan())
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert sizes and max(sizes) < 8000, sizes
