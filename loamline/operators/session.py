"""Session state over tool calls: counters, repeated expansions, batching nudges and savings.

Calls have session, ts, seq, tool and item; the batch results here are what the streaming versions must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counters(calls: DataFrame) -> DataFrame:
    """(session, tool, calls, items)."""
    return calls.groupBy("session", "tool").agg(F.count("*").alias("calls"), F.countDistinct("item").alias("items"))


def favourites(calls: DataFrame, column: str, limit: int = 5) -> DataFrame:
    """Most frequent values of a column in each session; ties go by value."""
    own = calls.groupBy("session", column).agg(F.count("*").alias("n"))
    order = Window.partitionBy("session").orderBy(F.desc("n"), column)
    return own.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def first_expansions(expansions: DataFrame) -> DataFrame:
    """Expansions (session, seq, path, line, mtime) with ``shown``: not shown again while the file is the same."""
    order = Window.partitionBy("session", "path", "line").orderBy("seq")
    before = F.lag("mtime").over(order)
    return expansions.withColumn("shown", before.isNull() | (before != F.col("mtime")))


def nudges(calls: DataFrame, most: int = 2) -> DataFrame:
    """Calls that follow one of the same tool with another item, the first ``most`` of each tool in a session; repeats break no streak and do not count."""
    order = Window.partitionBy("session").orderBy("ts", "seq")
    again = (F.lag("tool").over(order) == F.col("tool")) & (F.lag("item").over(order) != F.col("item"))
    marked = calls.withColumn("again", F.coalesce(again, F.lit(False))).where("again")
    count = F.row_number().over(Window.partitionBy("session", "tool").orderBy("ts", "seq"))
    return marked.withColumn("nth", count).where(F.col("nth") <= most).select("session", "ts", "seq", "tool", "item", "nth")


def savings(calls: DataFrame) -> DataFrame:
    """(session, baseline, saved): tokens without the tool, and those that it spared."""
    return calls.groupBy("session").agg(F.sum("baseline").alias("baseline"), F.sum(F.greatest(F.col("baseline") - F.col("returned"), F.lit(0))).alias("saved"))
