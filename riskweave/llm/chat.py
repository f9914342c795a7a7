"""Chat formatting in Spark expressions only.

The turns of a conversation are collected as structs, sorted, cut into runs of
one role and joined into one string:

    <|im_start|>ROLE
    TEXT<|im_sep|>TEXT<|im_end|>
    <|im_start|>...

Adjacent turns of one role share a block; ``<|im_sep|>`` keeps their border, so
the single turns can be read back. Inside texts and roles each ``<|``, also one
with backslashes between, gets one backslash more, so no control string is left;
reading takes it out again. Line ends and ``%`` of a role are written as ``%0A``
and ``%25``.

The loss mask is carried by ``segments``: pieces that add up to the formatted
string, with ``loss`` true for exactly the assistant texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per ``conv_id``: ``formatted`` and ``segments`` (array of text, loss).

    Takes ``conv_id``, ``turn``, ``role``, ``text``; other columns are ignored.
    Rows are ordered by turn (null first), ties by role, then text, so repeated
    rows stay repeated turns and any order of input gives the same result. Null
    texts and roles count as empty; a null ``conv_id`` is a conversation of its
    own. No rows give no conversations. The turns of one conversation meet in
    one row, as the result asks; no conversation meets another's.
    """
    clean = turns.select(
        "conv_id", "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    grouped = clean.groupBy("conv_id").agg(sorted_turns.alias("turns")).withColumn("n", F.size("turns"))
    # First positions of runs of one role, and one past the last turn.
    starts = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: (i == 1) | (
        F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]))
    runs = grouped.withColumn("starts", starts).withColumn("ends", F.concat(
        F.slice("starts", F.lit(2), F.size("starts")), F.array(F.col("n") + 1)))

    def block(start: Column, end: Column) -> Column:
        role = F.element_at("turns", start)["role"]
        plain = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))
        head = F.array(plain(F.concat(F.lit(START), _escape_role(role), F.lit("\n"))))
        texts = F.transform(F.slice("turns", start, end - start), lambda t, i: F.concat(
            F.when(i > 0, F.array(plain(F.lit(SEP)))).otherwise(F.array().cast(
                "array<struct<text:string,loss:boolean>>")),
            F.array(F.struct(escape(t["text"]).alias("text"), (role == "assistant").alias("loss")))))
        return F.concat(head, F.flatten(texts), F.array(plain(F.lit(END + "\n"))))

    blocks = F.flatten(F.transform(F.arrays_zip("starts", "ends"), lambda r: block(r["starts"], r["ends"])))
    # Generated once: the string is joined from the segments, not worked out anew.
    return runs.select("conv_id", blocks.alias("segments")).select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) in a formatted string, unescaped and unmerged."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.replace(F.substring(block, F.char_length(role) + 2, F.char_length(block)),
                         F.lit(END + "\n"), F.lit(""))
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda text: F.struct(
            _unescape_role(role).alias("role"), unescape(text).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]),
                                    lambda s: unescape(s["text"])), "")
