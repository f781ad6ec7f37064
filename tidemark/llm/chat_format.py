"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted by turn, then role and text. Adjacent turns of one role merge
into one message: the places where the role changes are found on the array, and each message is the slice between
two of them. The template is

    ### role: text</part>text</turn>\\n

with one part for each merged turn. Control strings inside texts get one more backslash behind their first character, and
so do strings that differ from one only by such backslashes, which makes the escape reversible: ``</turn>`` becomes
``<\\/turn>`` and that becomes ``<\\\\/turn>``. The output keeps the message as segments, each under the loss mask or not;
the formatted text is their concatenation.

Defined results: a null text is empty; a null turn sorts first; a null role is the role ``unknown``; equal turns are ordered by
role and text and all kept; a row without a conv_id is a conversation of its own, since nothing says which others it
belongs to; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_END, PART_END, HEAD, HEAD_END = "</turn>\n", "</part>", "### ", ": "

#: The role whose texts are learned from, and the name that a null role gets.
LEARNED, UNKNOWN = "assistant", "unknown"


def escaped(text: Column) -> Column:
    """The text with one more backslash in all control strings."""
    text = F.regexp_replace(text, r"<(\\*)/(turn|part)>", r"<\\$1/$2>")
    return F.regexp_replace(text, r"#(\\*)## ", r"#\\$1## ")


def unescaped(text: Column) -> Column:
    text = F.regexp_replace(text, r"<\\(\\*)/(turn|part)>", "<$1/$2>")
    return F.regexp_replace(text, r"#\\(\\*)## ", "#$1## ")


_ROLE_CODES = (("\\", "\\b"), (":", "\\c"), ("\n", "\\n"), ("<", "\\l"))


def _role_out(role: Column) -> Column:
    """A role as the header shows it: no colon, line end or control string can occur in it."""
    for plain, code in _ROLE_CODES:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def _role_in(shown: Column) -> Column:
    for plain, code in reversed(_ROLE_CODES):
        shown = F.replace(shown, F.lit(code), F.lit(plain))
    return shown


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``segments array<struct<text, loss>>`` and ``formatted`` of every conversation."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit(UNKNOWN)).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    sorted_turns = rows.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    sorted_turns = sorted_turns.union(rows.where("conv_id is null").select("conv_id", F.array("t")))
    size = F.size("turns")
    changes = F.filter(F.sequence(F.lit(1), size), lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]))
    messages = F.transform(
        F.col("changes"),
        lambda first, k: F.slice(F.col("turns"), first, F.coalesce(F.get(F.col("changes"), k + 1), size + 1) - first),
    )

    def segments(message: Column) -> Column:
        role = message[0]["role"]
        last = F.size(message) - 1
        parts = F.transform(message, lambda t, k: F.array(F.struct(escaped(t["text"]).alias("text"), (role == LEARNED).alias("loss")), F.struct(F.when(k < last, F.lit(PART_END)).otherwise(F.lit(TURN_END)).alias("text"), F.lit(False).alias("loss"))))
        head = F.struct(F.concat(F.lit(HEAD), _role_out(role), F.lit(HEAD_END)).alias("text"), F.lit(False).alias("loss"))
        return F.concat(F.array(head), F.flatten(parts))

    return (
        sorted_turns.withColumn("changes", changes)
        .select("conv_id", F.flatten(F.transform(messages, segments)).alias("segments"))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    )


def read_turns(formatted: Column) -> Column:
    """The turns ``array<struct<role, text>>`` of a formatted conversation, one for each merged part."""
    messages = F.split(formatted, TURN_END)
    messages = F.slice(messages, 1, F.size(messages) - 1)

    def turns(message: Column) -> Column:
        cut = F.instr(message, HEAD_END)
        shown = F.substring(message, F.lit(len(HEAD) + 1), cut - F.lit(len(HEAD) + 1))
        body = F.substring(message, cut + F.lit(len(HEAD_END)), F.length(message))
        return F.transform(F.split(body, PART_END), lambda p: F.struct(_role_in(shown).alias("role"), unescaped(p).alias("text")))

    return F.flatten(F.transform(messages, turns))


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
