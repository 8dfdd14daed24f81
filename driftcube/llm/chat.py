"""Chat formatting by prefix-target expansion.

Every assistant turn is exploded into an example of its own: all preceding
turns are its context and only that reply is trainable.  A turn is written as

    <|im_start|>role NEWLINE text<|im_end|> NEWLINE

with ``&`` and ``<|`` inside texts (and line breaks inside roles) escaped, so
control strings in a text cannot end a turn and everything can be read back.
All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
START, END, TARGET_ROLE = "<|im_start|>", "<|im_end|>\n", "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("&nl;"))


def _unrole(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("&nl;"), F.lit("\n")), F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def written(turn: Column) -> Column:
    """A turn (role, text) in the template."""
    return F.concat(F.lit(START), _role(turn["role"]), F.lit("\n"), escaped(turn["text"]), F.lit(END))


def expanded(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, lone, target, closes, text, loss_start, loss_end), a row an example.

    target is the 0-based index of the assistant turn that the example trains,
    text the conversation up to its end, and the loss span the code points of
    the reply in that text, its end exclusive.  Turns behind the last assistant
    turn are context of no example; they follow in a last row of the whole
    conversation with a null loss span, and so does a conversation without an
    assistant turn.  ``closes`` marks the row that holds the whole conversation.

    Rows go by turn (null first), then role and text; repeated rows are turns
    of their own, a repeated turn number too; null roles and texts count as
    empty.  A row with a null conv_id belongs to no known conversation and is
    one of its own, told apart by ``lone``, which is null elsewhere.  Other
    columns are left out, an empty table gives an empty result.  A conversation
    is one training text, so its turns meet in one row; its examples together
    are as long as the method makes them, in proportion to turns times length,
    and are made behind the shuffle.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.when(F.col(conv_id).isNull(), F.monotonically_increasing_id()).alias("lone"), one.alias("t"))
    turns = rows.groupBy("conv_id", "lone").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    rows = turns.select("conv_id", "lone", "turns", F.posexplode("turns").alias("target", "t"))
    trains, closes = F.col("t.role") == TARGET_ROLE, F.col("target") == F.size("turns") - 1
    rows = rows.where(trains | closes).select("conv_id", "lone", "target", closes.alias("closes"), "t", F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("target") + 1), written), "").alias("text"))
    end = F.length("text") - len(END)
    start = end - F.length(escaped(F.col("t.text")))
    return rows.select("conv_id", "lone", "target", "closes", "text", F.when(trains, start).alias("loss_start"), F.when(trains, end).alias("loss_end"))


def read_back(examples: DataFrame) -> DataFrame:
    """(conv_id, turns, losses, chars) parsed from the output of :func:`expanded`, a row a conversation.

    turns: array of (role, text) from the text of the row that closes the
    conversation; losses: what stands under the loss mask of each example in
    that example's own text, unescaped, in order; chars: code points of all
    rows' texts.  The rows lie by conversation already, so they are not
    shuffled again.
    """
    loss = unescaped(F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    one = F.struct("target", loss.alias("loss"), F.when(F.col("closes"), F.col("text")).alias("whole"))
    rows = examples.select("conv_id", "lone", F.length("text").cast("long").alias("chars"), one.alias("e"))
    found = rows.groupBy("conv_id", "lone").agg(F.sort_array(F.collect_list("e")).alias("e"), F.sum("chars").alias("chars"))
    whole = F.element_at(F.col("e"), -1)["whole"]
    pieces = F.filter(F.split(whole, r"<\|im_end\|>\n", -1), lambda p: p != "")

    def parse(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(START) + 1), F.length(piece))
        role = F.substring_index(body, "\n", 1)
        return F.struct(_unrole(role).alias("role"), unescaped(F.substring(body, F.length(role) + 2, F.length(body))).alias("text"))

    return found.select("conv_id", F.transform(pieces, parse).alias("turns"), F.array_compact(F.transform("e", lambda e: e["loss"])).alias("losses"), "chars")
