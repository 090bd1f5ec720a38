"""Chat formatting by prefix-target expansion. Native columns only.

Every assistant turn becomes an example of its own: all preceding turns as
context, then that reply, the only trainable part. The template::

    <s>[INST] role [/INST]
    text
    </s>

once per turn. A control string (``<s>``, ``</s>``, ``[INST]``, ``[/INST]``) inside
a role or text gets one more backslash in front than it had; template marks
never follow a backslash, so reading back takes one away again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import let

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]\n", "\n</s>\n"
_CONTROL = r"</?s>|\[/?INST\]"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, rf"(\\*(?:{_CONTROL}))", r"\\$1")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, rf"\\(\\*(?:{_CONTROL}))", "$1")


def prefix_examples(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    reply_role: str = "assistant",
) -> DataFrame:
    """One row per example: conv_id, example (0, 1, ...), target (its turn's
    place, 0-based), text, loss_start, loss_end (code points; the reply inside
    ``text``, still escaped).

    Turns after the last reply, or all turns of a conversation without one, are
    no context of any reply. They make one more row with target null and
    loss_start = loss_end, so that no turn is lost.

    Order: turn (null first), then role, then text; repeated rows are repeated
    turns. Null role or text: empty. Rows with a null conversation id form one
    conversation. Other columns are ignored. An empty table gives no rows.

    The text of a conversation is one string, so it must stay below 2 GB; the
    examples of one conversation are written one after another, never held
    together. One shuffle, by conversation.
    """
    t = turns.select(
        F.col(f"`{conv}`").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("said"),
    )
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))
    t = t.withColumns({"head": head, "body": escape(F.col("said"))})
    length = F.length("head") + F.length("body") + len(CLOSE)
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "said")
    t = t.withColumns(
        {
            "place": F.row_number().over(w) - 1,
            "ends": F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "is_reply": F.col("role") == reply_role,
        }
    )
    t = t.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    target = F.struct(
        F.col("ends"),
        F.col("place").alias("target"),
        (F.col("ends") - len(CLOSE) - F.length("body")).alias("loss_start"),
        (F.col("ends") - len(CLOSE)).alias("loss_end"),
    )
    whole = t.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(F.col("is_reply"), target))).alias("targets"),
        F.max("ends").alias("ends"),
        F.max(F.when(F.col("is_reply"), F.col("ends"))).alias("last"),
    )
    rest = F.struct(
        F.col("ends"),
        F.lit(None).cast("int").alias("target"),
        F.col("ends").alias("loss_start"),
        F.col("ends").alias("loss_end"),
    )
    uncovered = F.when(F.coalesce(F.col("last") < F.col("ends"), F.lit(True)), F.array(rest)).otherwise(F.array().cast("array<struct<ends:bigint,target:int,loss_start:bigint,loss_end:bigint>>"))
    whole = whole.select(
        "conv_id",
        F.array_join(F.col("pieces.piece"), "").alias("formatted"),
        F.concat(F.col("targets"), uncovered).alias("targets"),
    )
    return whole.select("conv_id", "formatted", F.posexplode("targets").alias("example", "t")).select(
        "conv_id",
        "example",
        "t.target",
        F.substring("formatted", F.lit(1), F.col("t.ends").cast("int")).alias("text"),
        "t.loss_start",
        "t.loss_end",
    )


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation, taken from the examples' text and loss spans alone.

    conv_id, turns (role, text in order), losses (unescaped text under the
    loss mask, in order), formatted_chars (code points of all examples).
    """
    masked = F.substring("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    loss = F.when(F.col("loss_end") > F.col("loss_start"), F.struct("loss_start", unescape(masked).alias("text")))
    per = examples.groupBy("conv_id").agg(
        F.max_by("text", F.length("text")).alias("longest"),
        F.sort_array(F.collect_list(loss)).alias("losses"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )
    pieces = F.split("longest", CLOSE.replace("\n", "\\n"))

    def parse(piece: Column) -> Column:
        role = F.substring_index(piece, MIDDLE, 1)
        return F.struct(
            unescape(F.substring(role, F.lit(len(OPEN) + 1), F.length(role))).alias("role"),
            unescape(F.substring(piece, F.length(role) + len(MIDDLE) + 1, F.length(piece))).alias("text"),
        )

    turns = let(pieces, lambda p: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), parse))
    return per.select("conv_id", turns.alias("turns"), F.col("losses.text").alias("losses"), "formatted_chars")
