"""Chat formatting by event-sourced reconstruction (native expressions only).

A log holds events of conversations: ``message`` (the first text), ``delta`` (more
of a message), ``edit`` (a new text for a message) and ``regenerate`` (a new text
for a message; what followed the message up to the event is void, later
regenerations of void messages with it). The log is partitioned by conversation, events are
folded per message in sequence order, messages are ordered per conversation
by their first event, rendered with turn marks and a loss mask over the
assistant's texts, and can be read back exactly.

Template: ``<|role|>\\n`` text ``<|end|>\\n`` per turn. In texts ``&``, ``<`` and ``[`` are
escaped (so no mark of this or another template survives inside a text), in
roles also ``|`` and newline; unescaping restores every text.

Defined results: a null text or role is empty; messages with equal sequence
numbers are ordered by role and text; repeated rows without message id are
separate turns; an empty log gives no conversations; other columns are
ignored; events of equal sequence number are folded ``message`` first, then by name
and text; messages without sequence number come first and are never void. A
conversation becomes one row, so its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET_ROLE = "assistant"
_TEXT_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
_ROLE_ESCAPES = (*_TEXT_ESCAPES, ("|", "&#124;"), ("\n", "&#10;"))


def _swap(x: Column, pairs) -> Column:
    for a, b in pairs:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def escape(x: Column) -> Column:
    return _swap(x, _TEXT_ESCAPES)


def unescape(x: Column) -> Column:
    return _swap(x, [(b, a) for a, b in reversed(_TEXT_ESCAPES)])


def _unescape_role(x: Column) -> Column:
    return _swap(x, [(b, a) for a, b in reversed(_ROLE_ESCAPES)])


def messages(events: DataFrame) -> DataFrame:
    """``conv_id, seq, op, msg_id, role, text`` -> final messages ``conv_id, seq, role,
    text``. A ``message`` event without msg_id is a message of its own."""
    # all events of a conversation meet once; the folds below need no other exchange
    ev = events.select("conv_id", "seq", "op", "msg_id", F.coalesce("role", F.lit("")).alias("role"),
                       F.coalesce("text", F.lit("")).alias("text")).repartition("conv_id")
    own = F.coalesce(F.col("msg_id"), F.concat(F.lit("\n"), F.monotonically_increasing_id().cast("string")))
    event = F.struct("seq", (F.col("op") != "message").alias("later"), "op", "role", "text")
    log = F.sort_array(F.collect_list(event))
    text = F.aggregate("log", F.lit(""), lambda acc, e: F.when(e["op"] == "delta", F.concat(acc, e["text"]))
                       .otherwise(e["text"]))
    folded = (ev.withColumn("msg", own).groupBy("conv_id", "msg")
              .agg(log.alias("log"), F.max(F.when(F.col("op") == "regenerate", F.col("seq"))).alias("regen"))
              .select("conv_id", F.col("log")[0]["seq"].alias("seq"), F.col("log")[0]["role"].alias("role"),
                      text.alias("text"), "regen"))
    # the stretches that live messages' regenerations void, earliest message first: a message
    # inside one is void, and so are its own regenerations
    again = F.when(F.col("regen").isNotNull() & F.col("seq").isNotNull(),
                   F.struct(F.col("seq").alias("after"), F.col("regen").alias("upto")))
    inside = lambda spans, at: F.exists(spans, lambda s: (at > s["after"]) & (at <= s["upto"]))
    spans = F.aggregate(F.sort_array(F.col("again")), F.filter("again", lambda s: F.lit(False)),
                        lambda live, s: F.when(inside(live, s["after"]), live).otherwise(F.concat(live, F.array(s))))
    return (folded.withColumn("again", F.collect_list(again).over(Window.partitionBy("conv_id")))
            .withColumn("spans", spans)
            .filter(F.col("seq").isNull() | ~inside(F.col("spans"), F.col("seq")))
            .select("conv_id", "seq", "role", "text"))


def render(turns: DataFrame) -> DataFrame:
    """``conv_id, seq, role, text`` -> ``conv_id, formatted, mask``; ``mask`` lists the
    ``start, length`` (code points) of the assistant's texts in ``formatted``."""
    head = F.concat(F.lit("<|"), _swap(F.col("role"), _ROLE_ESCAPES), F.lit("|>\n"))
    body = escape(F.col("text"))
    order = Window.partitionBy("conv_id").orderBy("seq", "role", "text")
    rows = (turns.select("conv_id", "seq", "role", "text", head.alias("head"), body.alias("body"))
            .withColumn("at", F.row_number().over(order))
            .withColumn("upto", F.sum(F.char_length("head") + F.char_length("body") + 8)
                        .over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    start = F.col("upto") - 8 - F.char_length("body")
    span = F.when(F.col("role") == TARGET_ROLE, F.struct(F.col("at"), start.alias("start"),
                                                         F.char_length("body").alias("length")))
    piece = F.struct("at", F.concat("head", "body", F.lit("<|end|>\n")).alias("piece"))
    return (rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("pieces"),
                                        F.sort_array(F.collect_list(span)).alias("spans"))
            .select("conv_id", F.array_join(F.col("pieces")["piece"], "").alias("formatted"),
                    F.transform("spans", lambda s: F.struct(s["start"], s["length"])).alias("mask")))


def read_back(formatted: DataFrame) -> DataFrame:
    """``render``'s output -> ``conv_id, turns (role, text), loss_text, formatted``."""
    parts = F.split("formatted", r"<\|end\|>\n", -1)
    turn = lambda p: F.struct(
        _unescape_role(F.substring_index(F.substr(p, F.lit(3)), "|>\n", 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, "|>\n") + 3)).alias("text"))
    loss = F.transform("mask", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"),
                                                           s["length"].cast("int"))))
    return formatted.select("conv_id", F.transform(F.slice(parts, 1, F.size(parts) - 1), turn).alias("turns"),
                            F.array_join(loss, "").alias("loss_text"), "formatted")
