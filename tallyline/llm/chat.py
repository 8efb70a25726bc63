"""Chat logs folded into final conversations and rendered with a loss mask.

A log holds one event per row: a message opens a turn, deltas add to it, an edit or a
regeneration replaces what it said, a deletion removes it. Events are grouped by message and
folded in sequence; messages are then grouped by conversation and rendered. A rendered
conversation is a list of segments, each trained on or not, whose texts joined are the
formatted conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
TRAINED_ROLE = "assistant"
# Kinds of events in the order in which those with one sequence number apply; the first three start a message's text anew.
KINDS = ["message", "edit", "regenerate", "delta", "delete"]
RESETS = KINDS[:3]
# Strings that steer a model or this template. One more backslash follows each backslash and the first
# character of each of these, so an escaped text holds none of them.
_CONTROL = r"\\|<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])\\", "$1")


def folded(events: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, copies) of every message that is left after all its events.

    Events have conv_id, message_id, seq, kind, role and text. Ties in seq apply in the order of
    KINDS, then by role and text. A null text adds nothing; the role is the first one given. Events of a
    message that was never opened open it. Repeated opening events with the last opening's seq
    are ``copies`` of the message. Unknown kinds count as deltas.
    """
    rank = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")), F.lit(0))
    rank = F.when(rank == 0, KINDS.index("delta") + 1).otherwise(rank)
    event = F.struct("seq", rank.cast("int").alias("rank"), F.col("role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = events.groupBy("conv_id", "message_id").agg(F.array_sort(F.collect_list(event)).alias("e"))
    resets = F.transform("e", lambda x, i: F.when(x["rank"] <= len(RESETS), i))
    begin = F.coalesce(F.array_max(resets), F.lit(0))
    opens = F.filter("e", lambda x: x["rank"] == 1)
    last_open = F.array_max(F.transform(opens, lambda x: x["seq"]))
    text = F.array_join(F.transform(F.slice("e", begin + 1, F.size("e")), lambda x: x["text"]), "")
    return grouped.filter(F.element_at("e", -1)["rank"] != len(KINDS)).select(
        "conv_id",
        F.coalesce(F.array_min(F.transform(opens, lambda x: x["seq"])), F.element_at("e", 1)["seq"]).alias("position"),
        F.coalesce(F.get(F.filter(F.transform("e", lambda x: x["role"]), lambda r: r.isNotNull()), F.lit(0)), F.lit("")).alias("role"),
        text.alias("text"),
        F.greatest(F.size(F.filter(opens, lambda x: x["seq"].eqNullSafe(last_open))), F.lit(1)).alias("copies"),
    )


def rendered(messages: DataFrame) -> DataFrame:
    """(conv_id, segments) of every conversation: array of (text, train), in order of position, then role and text."""
    turn = F.struct("position", "role", "text", "copies")
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def segments(t: Column) -> Column:
        head = F.concat(F.lit(TURN), escaped(t["role"]), F.lit(TEXT))
        one = F.array(
            F.struct(head.alias("text"), F.lit(False).alias("train")),
            F.struct(escaped(t["text"]).alias("text"), (t["role"] == TRAINED_ROLE).alias("train")),
            F.struct(F.lit(END).alias("text"), F.lit(False).alias("train")),
        )
        return F.flatten(F.array_repeat(one, t["copies"]))

    return turns.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"))


def read_back(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss_text) of rendered conversations, from the segments alone.

    Turns are parsed from the formatted text by its marks; loss_text is what the segments to be
    trained on say, unescaped.
    """
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["train"]), lambda s: unescaped(s["text"])), "")
    pieces = F.filter(F.split("formatted", r"<\|end\|>\n", -1), lambda p: p.startswith(TURN))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece.substr(F.lit(len(TURN) + 1), F.length(piece)), TEXT, 1)
        start = F.length(role) + len(TURN) + len(TEXT) + 1
        return F.struct(unescaped(role).alias("role"), unescaped(piece.substr(start, F.length(piece))).alias("text"))

    parsed = conversations.select("conv_id", formatted.alias("formatted"), loss.alias("loss_text"))
    return parsed.select("conv_id", "formatted", F.transform(pieces, turn).alias("turns"), "loss_text")


def as_events(conversations: DataFrame) -> DataFrame:
    """Finished conversations (conv_id, turn, role, text) as a log: one message per row, in order of turn.

    Rows that share conversation and turn are separate messages; equal ones are copies.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.concat_ws("|", F.coalesce(F.col("turn").cast("string"), F.lit("")), F.sha2(F.concat_ws("|", F.length(role).cast("string"), role, text), 256)).alias("message_id"),
        F.col("turn").cast("long").alias("seq"),
        F.lit("message").alias("kind"),
        role.alias("role"),
        text.alias("text"),
    )


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of rendered conversations, read back."""
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(conversations).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def formatted(conversations: DataFrame) -> DataFrame:
    """Rendered conversations of a table of finished turns.

    A null role or text is empty; every row is a turn, repeated rows included; a null
    conversation id is a conversation of its own. An empty table gives no conversations; other
    columns are ignored.
    """
    return rendered(folded(as_events(conversations)))
