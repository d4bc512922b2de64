"""Chat formatting: every assistant turn becomes a training example of its own.

An example holds all turns before its target as context and ends with the target; only the
target's text is under the loss mask.  A conversation whose last turn is not an assistant's
has one more example, with all turns and an empty mask, so no turn is lost.

Template: ``<|im_start|>role``, newline, text, ``<|im_end|>``, newline for each turn.  Inside
texts every ``<``, backslashes (none or more), ``|`` gets one more backslash: no ``<|`` stays,
and taking one away restores the text.  Roles are percent-coded (``%``, ``<``, newline).

Null texts and roles count as empty.  Turns are ordered by number (null first), those of the
same number by role, then text; repeated rows are turns of their own.  A row without
conversation is a conversation of one turn.  An example is one value, so a conversation must
fit in one (2 GB); examples of a conversation hold its turns again and again, as the method has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
TARGET = "assistant"
_ROLE_CODES = [("%", "%25"), ("<", "%3C"), ("\n", "%0A")]


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*+)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*+)\|", "<$1|")


def coded_role(role: Column) -> Column:
    for plain, code in _ROLE_CODES:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def decoded_role(role: Column) -> Column:
    for plain, code in reversed(_ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def marked(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END))


def format_chats(turns: DataFrame) -> DataFrame:
    """From rows (conv_id, turn, role, text) examples: conv_id, ``alone`` (tells rows without
    conv_id apart), example (from 1), n_turns in it, formatted, loss_begin and loss_end (code
    points of ``formatted``, half open; equal where nothing is trainable)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = turns.select("conv_id", alone.alias("alone"), F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    whole = rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    coded = F.transform(
        "turns", lambda t: F.struct(coded_role(t["role"]).alias("role"), escaped(t["text"]).alias("text"))
    )
    parts = whole.select("conv_id", "alone", coded.alias("turns"))
    # A target is an assistant's turn or, without mask, the last turn.
    numbered = F.transform("turns", lambda t, k: F.struct((k + 1).alias("at"), (t["role"] == TARGET).alias("trains")))
    targets = F.filter(numbered, lambda x: x["trains"] | (x["at"] == F.size("turns")))
    one = parts.select("conv_id", "alone", "turns", F.posexplode(targets).alias("k", "target"))
    at = F.col("target.at")
    text_of = lambda those: F.array_join(F.transform(those, lambda t: marked(t["role"], t["text"])), "")
    last = F.element_at("turns", at)
    built = one.select(
        "conv_id",
        "alone",
        (F.col("k") + 1).alias("example"),
        at.alias("n_turns"),
        text_of(F.slice("turns", F.lit(1), at - 1)).alias("context"),
        marked(last["role"], last["text"]).alias("reply"),
        F.when(F.col("target.trains"), F.length(last["text"])).otherwise(0).alias("trained"),
    )
    end = F.length("context") + F.length("reply") - len(END)
    return built.select(
        "conv_id",
        "alone",
        "example",
        "n_turns",
        F.concat("context", "reply").alias("formatted"),
        (end - F.col("trained")).alias("loss_begin"),
        end.alias("loss_end"),
    )


def parsed(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text was made from."""
    pieces = F.split(formatted, r"<\|im_start\|>", -1)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        begin = F.length(role) + 2
        body = F.substring(piece, begin, F.length(piece) - begin + 1 - len(END))
        return F.struct(decoded_role(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)


def read_back(examples: DataFrame) -> DataFrame:
    """One row for each conversation, from its examples alone: its turns, the texts under the
    loss mask in order, and the code points of all its formatted texts."""
    masked = F.substring("formatted", F.col("loss_begin") + 1, F.col("loss_end") - F.col("loss_begin"))
    one = examples.withColumn("loss", unescaped(masked))
    found = one.groupBy("conv_id", "alone").agg(
        F.max_by("formatted", "n_turns").alias("whole"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    return found.select("conv_id", parsed(F.col("whole")).alias("turns"), F.col("losses.loss").alias("losses"), "formatted_chars")
