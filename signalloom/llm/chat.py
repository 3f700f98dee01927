r"""Chat formatting from event logs.

A log holds events of messages, in sequence: ``open`` (a message begins; role, first text), ``delta`` (streamed text
is appended), ``edit`` (the text is replaced), ``regenerate`` (the text so far is dropped; deltas follow), ``delete``.
Events are first folded message by message, so drafts and superseded texts never reach a conversation's group; only
final messages are gathered, in order, and rendered.

Template: ``<turn:ROLE>TEXT</turn>`` and a line feed per turn. Inside roles and texts, ``\`` is written ``\b``, ``<``
is ``\l`` and ``>`` is ``\g``; no mark of the template can occur there, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Fixed template.
OPEN, MIDDLE, CLOSE = "<turn:", ">", "</turn>\n"


def escaped(text: Column) -> Column:
    for raw, code in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for raw, code in ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def final_messages(events: DataFrame) -> DataFrame:
    """``conv_id, message, role, text`` of the messages that stay.

    ``events``: conv_id, message (order of messages), seq, kind, role, text; other columns are not read. Repeated
    deliveries of a (conv_id, message, seq) count once (the least kind, role, text). The role is that of the last event
    that names one. Null ids form a conversation; null texts are empty, null roles are empty; unknown kinds are ignored.
    """
    key = ["conv_id", "message"]
    once = events.select(*key, "seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text")).where(
        F.col("kind").isin("open", "delta", "edit", "regenerate", "delete"))
    once = once.groupBy(*key, "seq").agg(F.min(F.struct("kind", "role", "text")).alias("e")).select(*key, "seq", "e.*")
    resets = F.col("kind").isin("open", "edit", "regenerate", "delete")
    marked = once.withColumn("since", F.max(F.when(resets, F.col("seq"))).over(Window.partitionBy(*key)))
    kept = F.col("since").isNull() | (F.col("seq") >= F.col("since"))
    pieces = F.array_sort(F.collect_list(F.when(kept, F.struct("seq", F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text")).alias("text")))))
    return (
        marked.groupBy(*key).agg(
            F.coalesce(F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))), F.lit("")).alias("role"),
            F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"),
            F.coalesce(F.max((F.col("kind") == "delete") & (F.col("seq") == F.col("since"))), F.lit(False)).alias("gone"))
        .where("not gone").drop("gone"))


def formatted(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans``: the rendered conversation, and the code point ranges [start, end) of the
    texts of role ``learn``, which alone carry loss.

    Null roles and texts were made empty before (``final_messages``); equal messages are rendered each, in order of
    ``message``. A conversation's text is one value, whatever its length. No rows in, no rows out; other columns are not
    read."""
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(MIDDLE))
    body = escaped(F.col("text"))
    parts = messages.select("conv_id", "message", "role", F.length(head).alias("head"), F.length(body).alias("body"),
                            F.concat(head, body, F.lit(CLOSE)).alias("turn"))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.col("head")
    parts = parts.withColumn("span", F.when(F.col("role") == learn, F.struct(at.alias("start"), (at + F.col("body")).alias("end"))))
    turns = F.array_sort(F.collect_list(F.struct("message", "turn")))
    return parts.groupBy("conv_id").agg(
        F.array_join(F.transform(turns, lambda t: t["turn"]), "").alias("formatted"),
        F.array_sort(F.collect_list("span")).alias("loss_spans"))


def read_back(rendered: DataFrame) -> DataFrame:
    """``conv_id, turns`` (role, text), ``loss_text``, ``formatted_chars`` from ``formatted`` alone.

    Whatever texts hold comes back as it was, control strings and empty texts included; a conversation without turns has
    none. No rows in, no rows out; other columns are not read."""
    pieces = F.split("formatted", CLOSE, -1)
    turns = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda t: F.struct(
        unescaped(F.substring_index(F.substr(t, F.lit(len(OPEN) + 1)), MIDDLE, 1)).alias("role"),
        unescaped(F.substring_index(t, MIDDLE, -1)).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(
        F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return rendered.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def events_of_turns(conversations: DataFrame) -> DataFrame:
    """The log of a table of finished turns: each turn opens and streams its text. Turns sort by turn, then role and
    text; repeated rows stay separate turns."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = conversations.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(order).alias("message"))
    two = F.explode(F.array(
        F.struct(F.lit(0).alias("seq"), F.lit("open").alias("kind"), F.col("role").alias("role"), F.lit("").alias("text")),
        F.struct(F.lit(1).alias("seq"), F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"), F.col("text").alias("text"))))
    return turns.select("conv_id", "message", two.alias("e")).select("conv_id", "message", "e.*")


def digests(conversations: DataFrame) -> DataFrame:
    """One row per conversation: what reading back the rendered conversation gives, as counts and digests.

    Null texts count as empty, null roles too; null conv_ids form one conversation; no rows in, no rows out. Other
    columns are not read.
    """
    back = read_back(formatted(final_messages(events_of_turns(conversations))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")
