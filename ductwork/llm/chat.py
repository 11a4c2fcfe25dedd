"""Operator 13: chat formatting, by event-sourced reconstruction. DataFrame functions only.

A log holds events of conversations: streamed pieces of messages, edits and regenerations. It is partitioned by conversation and sorted by
sequence, and folded into the messages as they finally stand (`reconstruct`); these are rendered with a template (`render`):

    <|role|>
    text</s>

Control strings inside roles and texts are broken up by a backslash after their first character, and backslashes are doubled, so a
text can't end its turn or open another one, and `unescape` restores it. The loss mask covers the assistant's texts alone.

The fold is one running minimum over a conversation's events, from the last to the first: an event counts unless a regeneration of its
message or an earlier one, or an edit of its message, comes after it. All steps share one exchange on the conversation. A conversation's
rendering is one value, so it must fit into one row; its events needn't, as they are sorted and spilled.

Defined cases: a null text is empty; a null role is an empty one; a null conversation is one of its own; events of equal sequence go by message,
kind, role and text; turns that repeat are turns of their own (in `as_events`); no rows give no rows; other columns have no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What marks turns, here or in other common templates.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]")
#: Kinds of events. delta: more text of a message; edit: all of its text anew; regenerate: the message and those after it go, to be streamed again.
DELTA, EDIT, REGENERATE = "delta", "edit", "regenerate"

TURN = r"(?s)<\|(.*?)\|>\n(.*?)</s>\n"


def escape(text: Column) -> Column:
    """The text without control strings, reversibly."""
    controls = "|".join(r"<\| \|> <s> </s> \[INST\] \[/INST\]".split(" "))
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"(?=({controls}))(.)", r"$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def as_events(turns: DataFrame) -> DataFrame:
    """A table of whole turns (conv_id, turn, role, text) as a log: each turn is streamed in one piece."""
    by_turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    at = F.row_number().over(by_turn).cast("long")
    return turns.select("conv_id", at.alias("seq"), at.alias("message"), F.lit(DELTA).alias("kind"), "role", "text")


def reconstruct(events: DataFrame) -> DataFrame:
    """The messages as they finally stand: conv_id, message, role (the last one given), text. events: conv_id, seq, message (its number within the
    conversation), kind, role, text."""
    order = [F.col("seq").asc_nulls_first(), "message", "kind", F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    forward = Window.partitionBy("conv_id").orderBy(*order)
    rows = events.select("conv_id", "seq", "message", "kind", "role", "text").withColumn("__at", F.row_number().over(forward))
    later = Window.partitionBy("conv_id").orderBy(F.col("__at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__gone", F.min(F.when(F.col("kind") == REGENERATE, F.col("message"))).over(later))
    later_own = Window.partitionBy("conv_id", "message").orderBy(F.col("__at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__new", F.max(F.col("kind") == EDIT).over(later_own))
    left = rows.where(~F.coalesce(F.col("__gone") <= F.col("message"), F.lit(False)) & ~F.coalesce(F.col("__new"), F.lit(False)))
    left = left.withColumn("text", F.when(F.col("kind") != REGENERATE, F.coalesce("text", F.lit(""))))
    pieces = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("__at", "text"))))
    folded = left.groupBy("conv_id", "message").agg(F.max_by("role", F.when(F.col("role").isNotNull(), F.col("__at"))).alias("role"), pieces.alias("pieces"))
    return folded.where(F.size("pieces") > 0).select("conv_id", "message", "role", F.array_join("pieces.text", "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, formatted, pieces (text, loss: whether the model learns from it; joined, they are formatted) and
    spans (start, n: code points of formatted under the loss mask)."""
    role, body = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    head, tail = F.concat(F.lit("<|"), role, F.lit("|>\n")), F.lit("</s>\n")
    loss = F.coalesce(F.col("role") == "assistant", F.lit(False))
    turns = messages.select("conv_id", "message", head.alias("head"), body.alias("body"), tail.alias("tail"), loss.alias("loss"))
    size = F.length("head") + F.length("body") + F.length("tail")
    before = F.coalesce(F.sum(size).over(Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumn("start", before + F.length("head"))
    held = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("message", "start", "head", "body", "tail", "loss"))).alias("turns"))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    pieces = F.flatten(F.transform("turns", lambda t: F.array(piece(t["head"], F.lit(False)), piece(t["body"], t["loss"]), piece(t["tail"], F.lit(False)))))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), F.length(t["body"]).cast("long").alias("n")))
    return held.select("conv_id", pieces.alias("pieces"), spans.alias("spans")).select("conv_id", F.array_join("pieces.text", "").alias("formatted"), "pieces", "spans")


def read_back(rendered: DataFrame) -> DataFrame:
    """Turns and learnt text as they stand in render()'s rows: conv_id, roles, texts, learnt."""
    parts = lambda k: F.regexp_extract_all("formatted", F.lit(TURN), F.lit(k))
    learnt = unescape(F.array_join(F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: p["text"]), ""))
    return rendered.select("conv_id", "formatted", parts(1).alias("roles"), parts(2).alias("texts"), learnt.alias("learnt"))


def format_chats(turns: DataFrame) -> DataFrame:
    """render()'s rows of a table of turns."""
    return render(reconstruct(as_events(turns)))


def digests(rendered: DataFrame) -> DataFrame:
    """The contract's columns, read back from render()'s rows."""
    lines = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda t: F.concat(t["roles"], F.lit("\n"), t["texts"], F.lit("\n"))), "")
    return read_back(rendered).select(
        "conv_id", F.size("roles").cast("long").alias("n_turns"), F.sha2(unescape(lines), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns and conversation -7, whose two turns consist of control strings."""
    probe = turns.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


ORACLE = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -7, t, r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) v(t, r)
), sized as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as no,
    list_sum([length(s) + length(s) - length(replace(s, '\', '')) + list_sum([(length(s) - length(replace(s, c, ''))) // length(c) for c in ['<|', '|>', '<s>', '</s>', '[INST]', '[/INST]']]) for s in [role, text]]) as chars
  from turns
)
select conv_id, count(*)::BIGINT as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by no)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::BIGINT as loss_chars, sha256(coalesce(string_agg(text, '' order by no) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(chars + 10)::BIGINT as formatted_chars
from sized group by conv_id
"""
