"""Chat formatting with Spark expressions only: one formatted text per conversation, its loss mask, and the way back.

Markup of a formatted conversation; adjacent turns of one role share a block:

    <s>role[INST]first text[+]next text of the same role</s><s>other role[INST]...</s>

Roles and texts are escaped so that none of them can hold a control string: `&` becomes `&amp;`, `<` becomes `&lt;` and `[`
becomes `&#91;`; undone in the opposite order, every text comes back as it was. The loss mask lists the spans (first character
from 0, characters) of the assistant's escaped texts.

Rows of a conversation are ordered by (turn, role, text), nulls first, so ties and repeated rows have one defined order; a null
text or role is empty, a null conv_id is a conversation of its own. A conversation is one output row, as every consumer of chat
data needs it: it must fit one row, and is gathered nowhere else. Conversations are spread over the tasks by their id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Control strings of the template.
BEGIN, OPEN, JOIN, END = "<s>", "[INST]", "[+]", "</s>"
#: Characters that begin a control string or an escape, in the order of escaping.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def format_conversations(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted (string) and loss_mask (array of start and chars), one row per conversation.

    Further columns of the input are dropped, whatever their names. An empty table gives no rows.
    """
    turns = conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
        ).alias("t"),
    )
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # Positions at which a run of turns of one role begins, and then one block per run.
    last = F.size("turns") - 1
    starts = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("turns")))
    blocks = F.zip_with(
        "starts", "ends",
        lambda a, b: F.struct(
            F.get("turns", a)["role"].alias("role"),
            F.transform(F.slice("turns", a + 1, b - a), lambda t: escape(t["text"])).alias("texts"),
        ),
    )
    # Every text with the control strings before it; block ends open the next block's prefix or close the conversation.
    pieces = F.flatten(F.transform("blocks", lambda b, k: F.transform(
        b["texts"],
        lambda t, i: F.struct(
            F.when(i > 0, F.lit(JOIN)).otherwise(F.concat(F.when(k > 0, F.lit(END)).otherwise(F.lit("")), F.lit(BEGIN), escape(b["role"]), F.lit(OPEN))).alias("before"),
            t.alias("text"), (b["role"] == ASSISTANT).alias("loss"),
        ),
    )))
    # Running position of each piece, in stretches of about the root of their number: arrays grow within a stretch, so a long conversation copies little.
    lengths = F.transform("pieces", lambda p: F.struct(F.length(p["before"]).cast("long").alias("before"), F.length(p["text"]).cast("long").alias("chars"), p["loss"].alias("loss")))
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size("lengths"))).cast("int"))
    stretches = F.transform(F.sequence(F.lit(0), F.size("lengths") - 1, step), lambda at: F.slice("lengths", at + 1, step))
    sizes = F.transform("stretches", lambda s: F.aggregate(s, F.lit(0).cast("long"), lambda total, p: total + p["before"] + p["chars"]))
    offsets = F.aggregate(sizes, F.array(F.lit(0).cast("long")), lambda found, s: F.concat(found, F.array(F.element_at(found, -1) + s)))
    empty = F.array().cast("array<struct<start:bigint,chars:bigint>>")
    counted = F.flatten(F.transform("stretches", lambda s, i: F.aggregate(
        s, F.struct(F.get("offsets", i).alias("at"), empty.alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + p["before"] + p["chars"]).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["before"]).alias("start"), p["chars"].alias("chars"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )))
    return (
        gathered.withColumn("starts", starts).withColumn("ends", ends).withColumn("blocks", blocks).withColumn("pieces", pieces)
        .withColumn("lengths", lengths).withColumn("stretches", stretches).withColumn("offsets", offsets)
        .select(
            "conv_id",
            F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"])), ""), F.lit(END)).alias("formatted"),
            counted.alias("loss_mask"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) read back from a formatted conversation."""
    blocks = F.filter(F.split(formatted, END), lambda b: F.length(b) > 0)
    return F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(F.substring_index(b, OPEN, -1), r"\[\+\]"),
        lambda t: F.struct(unescape(F.replace(F.substring_index(b, OPEN, 1), F.lit(BEGIN), F.lit(""))).alias("role"), unescape(t).alias("text")),
    )))


def read_loss(formatted: Column, loss_mask: Column) -> Column:
    """The texts under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(loss_mask, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["chars"].cast("int")))), "")


def with_extra_conversation(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The table's turns and the contract's conversation -7, whose texts consist of control strings."""
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)


def digests(formatted: DataFrame) -> DataFrame:
    """What the contract asks for, read back from the formatted texts."""
    back = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def digests_sql() -> str:
    """DuckDB SQL of the query, from the turns themselves rather than from a formatted text."""
    safe = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"
    return f"""
WITH turns AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM turns),
sized AS (
  SELECT *, length({safe.format("text")})
    + CASE WHEN before = role THEN {len(JOIN)} ELSE length({safe.format("role")}) + {len(BEGIN + OPEN + END)} END AS chars FROM marked)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""
