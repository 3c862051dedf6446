"""Chat formatting: conversations rebuilt from an event log, rendered under a template, and read back.

The log has one row per event: ``conv_id, turn, message, seq, kind, role, text``. A turn holds one message, or
several that ``message`` tells apart (it may be null). Kinds are

* ``message``: the message begins with this role and text,
* ``delta``: the text is appended to the message,
* ``edit``: the text takes the place of all that the message held,
* ``regenerate``: the message is emptied; the deltas that follow are its new text.

A message's text is that of its last ``message``, ``edit`` or ``regenerate`` event and all later deltas, by ``seq``
(ties: by kind, role, text). Later events may also name a role; the last one named counts.

Everything is expressed with DataFrame functions. Two grouped aggregations do the work: one folds a message, one
renders a conversation, so what meets in one task is one message, then one conversation (which is one output row).

Rows without ``conv_id`` form a conversation of their own, a null ``turn`` sorts first, null texts are empty,
a null role renders as the empty role. Empty input gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, ESCAPE = "<|im_start|>", "<|im_end|>", "<|"
#: The template: start, role, line feed, text, end, line feed. Inside texts and roles every ``<|`` is written
#: as ``<\|`` and a backslash is doubled, so that control strings can occur nowhere but in the template. Line feeds
#: in a role are written as a backslash and ``n``.


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Undo :func:`escape`: a backslash stands for the character behind it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def stream(conversations: DataFrame, chunk: int = 400) -> DataFrame:
    """An event log that yields the given turns: every text arrives as deltas of at most ``chunk`` characters.

    Each row becomes a message of its own, so repeated rows and rows of the same turn are all kept; they are
    ordered by role and text.
    """
    rows = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.monotonically_increasing_id().alias("message"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?s).{1,%d}" % chunk), F.lit(0)).alias("parts"),
    )
    events = rows.select("conv_id", "turn", "message", "role", F.posexplode(F.concat(F.array(F.lit("")), "parts")).alias("seq", "text"))
    kind = F.when(F.col("seq") == 0, "message").otherwise("delta")
    return events.select("conv_id", "turn", "message", F.col("seq").cast("long").alias("seq"), kind.alias("kind"), "role", "text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages: ``conv_id, turn, role, text``, one row for each message of the log."""
    item = F.struct(
        F.col("seq"),
        F.col("kind"),
        F.col("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = events.groupBy("conv_id", "turn", "message").agg(F.sort_array(F.collect_list(item)).alias("log"))
    # The fold starts behind the last event that sets the whole text; scanning for it keeps the fold linear.
    sets = F.transform("log", lambda e, i: F.when(e["kind"] != "delta", i + 1).otherwise(0))
    turns = turns.withColumn("from", F.greatest(F.array_max(sets), F.lit(1)))
    live = F.slice("log", F.col("from"), F.size("log") - F.col("from") + 1)
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    text = F.array_join(F.transform(live, lambda e: F.when(e["kind"] == "regenerate", "").otherwise(e["text"])), "")
    return turns.select("conv_id", "turn", F.element_at(roles, -1).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, formatted``, with its turns by ``turn``."""
    turn = F.concat(
        F.lit(START), _escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"), escape(F.coalesce("text", F.lit(""))), F.lit(END), F.lit("\n")
    )
    grouped = messages.select("conv_id", "turn", turn.alias("rendered")).groupBy("conv_id")
    rows = grouped.agg(F.sort_array(F.collect_list(F.struct("turn", "rendered"))).alias("turns"))
    return rows.select("conv_id", F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("formatted"))


def parse(formatted: DataFrame) -> DataFrame:
    """Read rendered conversations back: adds ``turns``, an array of (role, text, loss) structs.

    ``loss`` marks the text of assistant turns: those characters are trained on.
    """
    pieces = F.split("formatted", r"<\|im_start\|>")
    bodies = F.transform(
        F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.substring(p, F.lit(1), F.length(p) - len(END) - 1),
    )
    turns = F.transform(
        bodies,
        lambda b: F.struct(
            _unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
            unescape(F.substring(b, F.locate("\n", b) + 1, F.length(b))).alias("text"),
            (F.substring_index(b, "\n", 1) == "assistant").alias("loss"),
        ),
    )
    return formatted.withColumn("turns", turns)


def format_chats(events: DataFrame) -> DataFrame:
    """Fold the log, render each conversation and read the result back: ``conv_id, formatted, turns``."""
    return parse(render(fold(events)))
