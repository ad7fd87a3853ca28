"""Streaming versions of the session operators: the batch results over all events are their specification."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def counters(calls: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Calls of each session window and tool; a window ends after ``gap`` without a call and is final ``late`` after that."""
    return calls.withWatermark("ts", late).groupBy("session", "tool", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("calls")).select("session", "tool", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "calls")


def first_expansions(expansions: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (session, path, line, mtime) once; state goes with the watermark."""
    return expansions.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session", "path", "line", "mtime"])


NUDGE = "session long, ts timestamp, seq long, tool string, item string, nth int"
STATE = "last_tool string, last_item string, counts string, last_ms long"


def nudges(calls: DataFrame, most: int = 2, idle_ms: int = 86_400_000, late: str = "1 hour") -> DataFrame:
    """Calls that follow one of the same tool with another item, the first ``most`` of each tool; rows of a batch go in time order.

    A session's state is its last call and a count for each tool. It goes when the watermark is ``idle_ms`` past the session's last call,
    and a session that goes on after that begins anew. A call before the watermark is late: it is left out and changes no state."""
    import json

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            now = state.getCurrentWatermarkMs()
            last_tool, last_item, counts, last_ms = state.get if state.exists else (None, None, "{}", 0)
            counts = json.loads(counts)
            rows = pd.concat(batches).sort_values(["ts", "seq"])
            rows = rows[rows["ts"].map(lambda t: t.timestamp() * 1000) >= now]
            for r in rows.itertuples():
                if r.tool == last_tool and r.item != last_item and counts.get(r.tool, 0) < most:
                    counts[r.tool] = counts.get(r.tool, 0) + 1
                    out.append((key[0], r.ts, r.seq, r.tool, r.item, counts[r.tool]))
                last_tool, last_item, last_ms = r.tool, r.item, max(last_ms, int(r.ts.timestamp() * 1000))
            if len(rows):
                state.update((last_tool, last_item, json.dumps(counts), last_ms))
                state.setTimeoutTimestamp(max(last_ms + idle_ms, now + 1))
            elif state.exists:
                state.setTimeoutTimestamp(max(last_ms + idle_ms, now + 1))
        yield pd.DataFrame(out, columns=["session", "ts", "seq", "tool", "item", "nth"])

    held = calls.withWatermark("ts", late)
    return held.groupBy("session").applyInPandasWithState(step, NUDGE, STATE, "append", GroupStateTimeout.EventTimeTimeout)
