"""Chat formatting from event logs, in DataFrame functions throughout.

A log holds events of conversations: ``message`` and ``edit`` set a turn's text, ``delta`` appends to it, ``regenerate``
sets it anew and drops the later turns logged before, which answered what it replaces. A turn is rendered as

    <turn>### role: text</turn>

and a line feed. Inside roles and texts the characters that begin control strings are written as escapes, so no text can
open or close a turn, and reading an output back gives roles and texts exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<turn>### ", ": ", "</turn>\n"
#: Each character that is escaped, and the letter that stands for it after a backslash.
ESCAPES = {"#": "h", "<": "l", ":": "c"}


def escape(text: Column, marks: str = "#<") -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in marks:
        out = F.replace(out, F.lit(mark), F.lit("\\" + ESCAPES[mark]))
    return out


def unescape(text: Column) -> Column:
    """Inverse of ``escape``: what stands between double backslashes holds whole escapes only."""

    def part(x: Column) -> Column:
        for mark, letter in ESCAPES.items():
            x = F.replace(x, F.lit("\\" + letter), F.lit(mark))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def reconstruct(events: DataFrame) -> DataFrame:
    """Fold events (conv_id, seq, turn, op, role, text) into final messages (conv_id, turn, role, text).

    Events of a conversation apply by ``seq``; of equal ``seq``, those that set a text come first, then ties go by text. A
    regeneration removes what later turns had so far; what comes for them afterwards starts from nothing. A null text is
    empty; a turn's role is that of its last event that has one, of those removed if no other has, or empty; an event
    without ``seq`` comes before all others; unknown or null ops count as ``message``; null conv_id is a conversation of
    its own and null turn its first turn."""
    sets = ~F.col("op").eqNullSafe("delta")
    event = F.struct(
        F.col("seq").cast("long").alias("seq"), (~sets).alias("later"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("role").cast("string").alias("role")
    )
    again = F.when(F.col("op").eqNullSafe("regenerate"), F.col("seq").cast("long"))
    turns = events.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(event)).alias("log"), F.max(again).alias("regenerated"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("cut", F.max("regenerated").over(before))
    stands = F.filter("log", lambda e: F.col("cut").isNull() | F.coalesce(e["seq"] > F.col("cut"), F.lit(False)))
    turns = turns.withColumn("own", stands).where(F.size("own") > 0)
    turns = turns.withColumn("start", F.array_max(F.filter("own", lambda e: ~e["later"])))
    said = F.filter("own", lambda e: F.col("start").isNull() | (e >= F.col("start")))
    last = lambda log: F.try_element_at(F.transform(F.filter(log, lambda e: e["role"].isNotNull()), lambda e: e["role"]), F.lit(-1))
    role = F.coalesce(last("own"), last("log"), F.lit(""))
    return turns.select("conv_id", "turn", role.alias("role"), F.array_join(F.transform(said, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, and the segments (text, loss) that make it up; ``loss`` is the mask.

    ``messages`` has one row per (conv_id, turn). Texts of the roles in ``learn`` are under the loss mask. A rendered
    conversation is one string, so a conversation must fit a task; nothing else is gathered by key."""
    head = F.concat(F.lit(OPEN), escape(F.col("role"), "#<:"), F.lit(MIDDLE))
    body = escape(F.col("text"))
    rows = messages.select("conv_id", "turn", head.alias("head"), body.alias("body"), F.col("role").isin(*learn).alias("loss"))
    whole = F.sort_array(F.collect_list(F.struct("turn", "head", "body", "loss")))
    out = rows.groupBy("conv_id").agg(whole.alias("turns"))
    parts = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(t["head"].alias("text"), F.lit(False).alias("loss")),
                F.struct(t["body"].alias("text"), t["loss"].alias("loss")),
                F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    return out.select("conv_id", parts.alias("segments")).select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments"
    )


def read_back(formatted: Column) -> Column:
    """Array of (role, text) in a formatted conversation."""
    turns = F.split(formatted, CLOSE)
    turns = F.slice(turns, 1, F.greatest(F.size(turns) - 1, F.lit(0)))

    def turn(t: Column) -> Column:
        rest = F.substr(t, F.lit(len(OPEN) + 1))
        role = F.substring_index(rest, MIDDLE, 1)
        text = F.substr(rest, F.length(role) + len(MIDDLE) + 1)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(turns, turn)


def table_events(conversations: DataFrame) -> DataFrame:
    """Events of a table with one finished row per turn; rows that repeat a turn are turns of their own, by role and text."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("at"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("at", "role", "text")).cast("long")
    return rows.select("conv_id", number.alias("seq"), number.alias("turn"), F.lit("message").alias("op"), "role", "text")
