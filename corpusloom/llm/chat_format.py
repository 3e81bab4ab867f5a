"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the
context and only that reply is trainable.  A conversation that doesn't end with
an assistant turn gets one more example that holds all its turns and trains on
nothing, so that no turn is lost.

Template, per turn: <|im_start|>ROLE, newline, TEXT, <|im_end|>, newline.  In
texts and roles '&' becomes '&amp;' and '<|' becomes '&lt;|' (in roles a newline
becomes '&nl;'), so a control string in an example is always the template's
own; read_back() undoes this exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def format_examples(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> one row per example.

    Returns conv_id, example (0-based place of its last turn), n_turns, last
    (whether it is the conversation's last example), text, loss_from, loss_to
    (0-based character range of the trainable reply, equal if there is none).
    Turns are ordered by turn, then role, then text, nulls first; repeated rows
    stay as turns of their own.  Null roles and texts are empty.  Extra columns
    are ignored.  An empty table gives no examples.  The formatted length grows
    with the square of a conversation's length: that is what the method returns.
    """
    t = (
        turns.select(
            "conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
        )
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
        .select("conv_id", F.transform("t", lambda x: F.struct(
            (x["role"] == "assistant").alias("reply"),
            F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n")).alias("head"),
            escape(x["text"]).alias("body"),
        )).alias("t"))
    )
    e = t.select("conv_id", "t", F.size("t").alias("n_turns"), F.posexplode("t").alias("example", "x")).filter(
        F.col("x.reply") | (F.col("example") == F.col("n_turns") - 1)
    )
    whole = lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))
    before = F.array_join(F.transform(F.slice("t", F.lit(1), F.col("example")), whole), "")
    e = e.withColumn("prefix", F.concat(before, F.col("x.head")))
    return e.select(
        "conv_id", "example", "n_turns", (F.col("example") == F.col("n_turns") - 1).alias("last"),
        F.concat("prefix", F.col("x.body"), F.lit(END + "\n")).alias("text"),
        F.length("prefix").alias("loss_from"),
        (F.length("prefix") + F.when(F.col("x.reply"), F.length("x.body")).otherwise(0)).alias("loss_to"),
    )


def read_turns(text: Column) -> Column:
    """The turns that an example's text holds, as array<struct<role, text>>."""
    parts = F.filter(F.split(text, r"<\|im_end\|>\n", -1), lambda p: F.startswith(p, F.lit(START)))
    inner = F.transform(parts, lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p)))
    return F.transform(
        inner,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p))).alias("text"),
        ),
    )


def digest(examples: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted examples."""
    piece = unescape(F.substring(F.col("text"), F.col("loss_from") + 1, F.col("loss_to") - F.col("loss_from")))
    g = (
        examples.select(
            "conv_id", F.struct("example", piece.alias("piece")).alias("loss"),
            F.when(F.col("last"), F.col("text")).alias("whole"), F.length("text").cast("long").alias("chars"),
        )
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("loss")).alias("loss"), F.collect_list("whole").alias("whole"), F.sum("chars").alias("formatted_chars"))
        .withColumn("turns", read_turns(F.col("whole")[0]))
        .withColumn("loss", F.array_join(F.col("loss.piece"), ""))
    )
    as_lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return g.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(as_lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
