"""Chat formatting with Spark expressions only.

Turn structs are collected per conversation and block of consecutive turns, sorted, adjacent
turns of a role are merged with an array aggregation, and the pieces are concatenated.

Template: a run of turns of one role is ``### role: text<turn/>text</turn>``; a new line stands
between runs.  Inside roles and texts, a backslash is doubled and each control string gets one
backslash inside it, so that it can't occur: reading back is a literal split and one replacement.

A conversation of any length is held in blocks of ``turn div BLOCK``, each a row of its own,
with a flag that says whether its first run goes on with the role of the block before; so a
huge conversation is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, JOINT, END = "### ", "<turn/>", "</turn>"

#: Turn numbers in a block.
BLOCK = 512


def escape(text: Column) -> Column:
    """No control string is left; ``unescape`` takes it back."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in (HEAD, JOINT, END):
        out = F.replace(out, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_blocks(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation and block: conv_id, block, goes_on, formatted, loss.

    ``formatted`` of the blocks of a conversation, joined in order of ``block`` by nothing, is the
    formatted conversation.  ``loss`` says for each text of the block, in order, whether the loss
    mask covers it (role assistant).  Rows are ordered by turn, then role, then text; null turns
    come first; null roles and texts are empty; repeated rows stay.  Null conversation ids
    form one conversation.  No rows: no rows.  Extra columns play no part.
    """
    rows = conversations.select(
        F.col("conv_id"),
        F.floor(F.col("turn") / block).alias("block"),
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    collected = rows.groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    # adjacent turns of a role become one run; of a run, only the role and the texts are held
    runs = F.expr(
        """aggregate(turns, cast(array() as array<struct<role: string, texts: array<string>>>), (runs, t) ->
             if(size(runs) > 0 and element_at(runs, -1).role = t.role,
                concat(slice(runs, 1, size(runs) - 1), array(named_struct('role', t.role,
                       'texts', concat(element_at(runs, -1).texts, array(t.text))))),
                concat(runs, array(named_struct('role', t.role, 'texts', array(t.text))))))"""
    )
    before = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first())
    placed = (
        collected.select(
            "conv_id",
            "block",
            runs.alias("runs"),
            F.transform("turns", lambda t: t["role"] == F.lit("assistant")).alias("loss"),
        )
        .withColumn("last_role", F.lag(F.element_at("runs", -1)["role"]).over(before))
        .withColumn("next_role", F.lead(F.element_at("runs", 1)["role"]).over(before))
    )
    goes_on = F.coalesce(F.col("last_role") == F.element_at("runs", 1)["role"], F.lit(False))
    is_cut = F.coalesce(F.col("next_role") == F.element_at("runs", -1)["role"], F.lit(False))

    def shown(run: Column, i: Column) -> Column:
        body = F.array_join(F.transform(run["texts"], escape), JOINT)
        role = F.replace(escape(run["role"]), F.lit(":"), F.lit("\\:"))
        head = F.when((i == 0) & goes_on, F.lit(JOINT)).otherwise(
            F.concat(
                F.when((i == 0) & F.col("last_role").isNull(), F.lit("")).otherwise(F.lit("\n")),
                F.lit(HEAD),
                role,
                F.lit(": "),
            )
        )
        end = F.when((i == F.size("runs") - 1) & is_cut, F.lit("")).otherwise(F.lit(END))
        return F.concat(head, body, end)

    return placed.select(
        "conv_id", "block", goes_on.alias("goes_on"), F.array_join(F.transform("runs", shown), "").alias("formatted"), "loss"
    )


def read_back(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``turns``: role (null if the run began in an earlier block) and text of each turn."""
    pieces = F.split(F.regexp_replace("formatted", "</turn>$", ""), END)

    def parsed(piece: Column) -> Column:
        # the role ends at the first ": " whose colon has no backslash before it
        head = F.regexp_extract(piece, r"(?s)^\n?### ((?:[^\\:]|\\.)*+): ", 0)
        role = F.when(
            head != "",
            unescape(F.regexp_extract(piece, r"(?s)^\n?### ((?:[^\\:]|\\.)*+): ", 1)),
        )
        body = F.when(head != "", F.substring(piece, F.length(head) + 1, F.length(piece))).otherwise(
            F.regexp_replace(piece, "^<turn/>", "")
        )
        return F.transform(
            F.split(body, JOINT), lambda t: F.struct(role.alias("role"), unescape(t).alias("text"))
        )

    return blocks.withColumn("turns", F.flatten(F.transform(pieces, parsed)))
