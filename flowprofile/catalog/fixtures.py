"""Flow records derived from `lineitem`: the same expressions as Spark columns and as SQL text for another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowprofile.config import DEFAULT_FEATURES, LABEL_COLUMN

# One expression per feature. Literals are written 1e2 so that every engine takes them as DOUBLE.
FEATURE_SQL = dict(zip(DEFAULT_FEATURES, (
    "CAST(CASE l_suppkey % 4 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 22 ELSE 1024 + l_partkey % 5000 END AS BIGINT)",
    "p * h",
    "CAST(q * h AS BIGINT)",
    "p * h / 1e1",
    "p / q",
    "p * d",
    "p * t",
    "p * d * t",
    "CASE WHEN l_orderkey % 97 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN l_orderkey % 89 = 0 THEN CAST('-Infinity' AS DOUBLE)"
    " WHEN l_orderkey % 83 = 0 THEN NULL ELSE p * h / (q + 1e0) END",
    "q * h / (1e0 + d)",
    "p / (q + 1e0) * ln",
    "CASE WHEN l_orderkey % 79 = 0 THEN CAST('NaN' AS DOUBLE) ELSE p * d * ln END",
    "q * h / (2e0 + t)",
    "q / (3e0 + t)",
    "p / (q + 2e0)",
    "p * (d + t)",
    "p / q * 5e-1",
    "CAST(CASE WHEN ln = 7 THEN 1 ELSE 0 END AS BIGINT)",
    "CAST(ln % 2 AS BIGINT)",
    "CAST(CASE WHEN rf = 'A' THEN 1 ELSE 0 END AS BIGINT)",
    "CASE WHEN l_partkey % 5 = 0 THEN -1e0 ELSE l_partkey * h END",
    "CASE WHEN l_suppkey % 3 = 0 THEN -1e0 ELSE l_suppkey * 1e0 END",
    "CASE WHEN ln = 1 THEN p * h ELSE 0e0 END",
    "CASE WHEN ln = 2 THEN p * 1e1 ELSE 0e0 END",
), strict=True))
LABEL_SQL = (
    "CASE WHEN l_orderkey % 40 = 0 THEN 'DoS' WHEN l_suppkey % 4 = 2 AND l_orderkey % 7 = 0 THEN 'Brute Force'"
    " WHEN l_orderkey % 211 = 0 THEN NULL ELSE 'BENIGN' END"
)
# Unique per base row at every scale; exact copies share it.
ID_SQL = "concat_ws('-', CAST(l_orderkey AS VARCHAR(20)), CAST(ln AS VARCHAR(20)), CAST(l_partkey AS VARCHAR(20)), CAST(l_suppkey AS VARCHAR(20)))"
BASE_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber AS ln", "l_quantity AS q", "l_extendedprice AS p", "l_discount AS d",
    "l_tax AS t", "l_returnflag AS rf", "CASE WHEN l_orderkey % 40 = 0 THEN 1e2 ELSE 1e0 END AS h",
)
COPIES_SQL = "l_orderkey % 50 = 0"
# Seven given clusters, and a sampling order that any engine can compute.
CLUSTER_SQL = (
    "CASE WHEN {label} = 'DoS' THEN 6 WHEN {fin} = 1 THEN CAST(4 + {ack} AS INT) ELSE CAST({psh} + 2 * {ack} AS INT) END"
)
_part = "CAST(split_part(flow_id, '-', {}) AS BIGINT)".format
RANK_SQL = (
    f"(({_part(1)} * 8 + {_part(2)}) % 2147483647 * 48271 + {_part(3)} % 2147483647 * 16807 + {_part(4)} % 2147483647 * 69621) % 2147483647"
)
# Order in which embeddings are sampled: a permutation of the ids.
EMBEDDING_RANK_SQL = "vec_id % 2147483647 * 48271 % 2147483647"


def flows_from(lineitem: DataFrame, with_id: bool = False) -> DataFrame:
    """Flow records of a (batch or streaming) lineitem table; some orders appear twice, as exact copies."""
    base = lineitem.selectExpr(*BASE_COLUMNS).unionByName(lineitem.where(COPIES_SQL).selectExpr(*BASE_COLUMNS))
    identity = [f"{ID_SQL} AS flow_id"] if with_id else []
    return base.selectExpr(*identity, *[f"{sql} AS `{name}`" for name, sql in FEATURE_SQL.items()], f"{LABEL_SQL} AS `{LABEL_COLUMN}`")


def flows(spark: SparkSession, sf_dir: str, with_id: bool = False) -> DataFrame:
    return flows_from(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), with_id)


def given_cluster() -> str:
    """The given assignment as a Spark expression on unscaled flows."""
    return CLUSTER_SQL.format(label=f"`{LABEL_COLUMN}`", fin="`FIN Flag Count`", psh="`PSH Flag Count`", ack="`ACK Flag Count`")


def embedding_columns(spark: SparkSession, sf_dir: str, dimensions: int = 64) -> DataFrame:
    """`embeddings` with one column per dimension: vec_id, label, e0, e1, ..."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr(
        "vec_id", "label", *[f"cast(embedding[{i}] as double) as e{i}" for i in range(dimensions)])


def rounding(c: str) -> str:
    """Comparable value, the same text in every engine: 6 decimals below 1e4, 3 below 1e8, none above (9 or more significant digits from 1e3 on).

    The small offsets move short decimals off the rounding ties, which engines break differently; -0.0 becomes 0.0.
    """
    return (
        f"CASE WHEN abs({c}) < 1e4 THEN round({c} + 31e-9, 6) WHEN abs({c}) < 1e8 THEN round({c} + 31e-6, 3) "
        f"ELSE round({c} + 31e-3, 0) END + 0e0"
    )


def rounded(c: str) -> str:
    """The value of `rounding(c)` for Spark, whose `round` goes through decimal text and takes most of a query's time.

    Away from a tie the nearest whole number of steps is known without it (both errors, of the product and of the text, are below 1e-4 of a step; from 1e8 on the text of a
    number lies on the same side of every tie as the number); near a tie, and for what is not finite, `round` decides.
    """
    def nearest(offset: str, steps: str, digits: int) -> str:
        value = f"({c} + {offset})"
        scaled = f"({value} * {steps})"
        return f"CASE WHEN abs({scaled} - rint({scaled})) < 499e-3 THEN rint({scaled}) / {steps} ELSE round({value}, {digits}) END"
    return (
        f"CASE WHEN abs({c}) < 1e4 THEN {nearest('31e-9', '1e6', 6)} WHEN abs({c}) < 1e8 THEN {nearest('31e-6', '1e3', 3)} "
        f"ELSE {nearest('31e-3', '1e0', 0)} END + 0e0"
    )
