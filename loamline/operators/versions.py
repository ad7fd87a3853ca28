"""Versions of texts that a session has seen, and edits that are made on one of them after the text has moved on.

A session keeps the last versions of the paths that it used last, within bounds of versions, paths and bytes, and for each
version the lines that were shown of it, as intervals. An edit names the version that it means by a tag: it is applied, merged
into the text as it now is by exact context, made on a later version where its lines are the same, or refused."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.operators import edit

# The bounds of a session's store.
MOST_VERSIONS, MOST_PATHS, MOST_BYTES, FILE_BYTES = 4, 30, 64 << 20, 4 << 20
CONTEXT = 3

EVENT = "session string, seq long, kind string, path string, text string, tag string, lines array<int>, target string"
LOG = "session string, seq long, kind string, path string, tag string, versions int, seen int, paths int, bytes long"
VERSION = "session string, path string, place int, recorded_at long, tag string, text string, seen array<struct<first:int,past:int>>"

Intervals = list[tuple[int, int]]


def united(a: Intervals, b: Intervals) -> Intervals:
    """Union of intervals from first to before past, in order and apart from each other."""
    out: Intervals = []
    for first, past in sorted([*a, *b]):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(past, out[-1][1]))
        elif first < past:
            out.append((first, past))
    return out


def of_lines(lines: list[int] | None) -> Intervals:
    return united([], [(x, x + 1) for x in lines or [] if x is not None])


@dataclass
class Version:
    text: str
    tag: str
    recorded_at: int
    seen: Intervals = field(default_factory=list)

    def weight(self) -> int:
        return len(self.text.encode()) + 4 * sum(past - first for first, past in self.seen)


class Store:
    """One session's paths, the least recently used first; a streaming version keeps the same in state."""

    def __init__(self):
        self.held: dict[str, list[Version]] = {}
        self.used: dict[str, int] = {}
        self.clock = 0

    def get(self, path: str) -> list[Version]:
        return self.held.get(path, [])

    def put(self, path: str, versions: list[Version], used: int) -> None:
        self.held[path], self.used[path] = versions, used

    def drop(self, path: str) -> None:
        self.held.pop(path, None)
        self.used.pop(path, None)

    def paths(self) -> list[tuple[int, str, int]]:
        """(last use, path, bytes), the least recently used first."""
        return sorted((self.used[p], p, 1 + sum(v.weight() for v in vs)) for p, vs in self.held.items())

    def tagged(self, tag: str) -> list[str]:
        """Texts of any path that have a tag."""
        return [v.text for vs in self.held.values() for v in vs if v.tag == tag]

    def tick(self) -> int:
        self.clock += 1
        return self.clock


def minted(store: Store, text: str) -> str:
    """The tag of a text: of as many digits as set it apart from every other text that the session holds, trailing white space left out."""
    plain, digits = edit.plain(text), 4
    while digits < edit.DIGITS and any(edit.plain(t) != plain for t in store.tagged(edit.tag(text, digits))):
        digits += 1
    return edit.tag(text, digits)


def step(store: Store, kind: str, path: str, text: str | None, tag: str | None, lines: list[int] | None, target: str | None) -> tuple[str | None, int, int, int, int]:
    """What one event does to a store: (tag minted or named, versions of the path, lines seen of its newest, paths, bytes).

    A text over the bound for a file is not kept and gets no tag; a text that is known is the newest version again and keeps what was
    seen of it. Events that name nothing known, or are of no known kind, change nothing."""
    own = store.get(path)
    if kind == "record":
        text = text or ""
        if len(text.encode()) > FILE_BYTES:
            tag = None
        else:
            now, same = store.tick(), next((v for v in own if v.text == text), None)
            tag = same.tag if same else minted(store, text)
            new = Version(text, tag, now, united(same.seen if same else [], of_lines(lines)))
            own = [new, *(v for v in own if v is not same)][:MOST_VERSIONS]
            store.put(path, own, now)
    elif kind == "seen" and own:
        found = next((v for v in own if v.tag == tag), None)
        if found is not None:
            found.seen = united(found.seen, of_lines(lines))
        store.put(path, own, store.tick())
    elif kind == "invalidate":
        store.drop(path)
        own = []
    elif kind == "relocate" and own and target:
        both: dict[str, Version] = {}
        for v in [*own, *(store.get(target) if target != path else [])]:
            both.setdefault(v.tag, v)
        store.drop(path)
        own = list(both.values())[:MOST_VERSIONS]
        store.put(target, own, store.tick())
    order = store.paths()
    total = sum(b for _, _, b in order)
    while len(order) > MOST_PATHS or total > MOST_BYTES and len(order) > 1:
        _, last, size = order.pop(0)
        total -= size
        store.drop(last)
    return tag, len(own), sum(b - a for a, b in own[0].seen) if own else 0, len(order), total


def _sorted_events(events: DataFrame) -> DataFrame:
    own = events.select(*[c.split()[0] for c in EVENT.split(", ")])
    return own.repartition("session").sortWithinPartitions("session", "seq")


def _folded(batches: Iterator[pa.RecordBatch], each, last) -> Iterator[list[tuple]]:
    """Rows of ``each(store, row, result)`` after every event and of ``last(session, store)`` after a session's last one."""
    store, session, began = Store(), None, False
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if not began or row["session"] != session:
                if began:
                    out += last(session, store)
                store, session, began = Store(), row["session"], True
            out += each(row, step(store, *(row[c] for c in ("kind", "path", "text", "tag", "lines", "target"))))
        yield out
    if began:
        yield last(session, store)


def _typed(kinds: list[tuple[str, pa.DataType]]):
    schema = pa.schema(kinds)
    return lambda rows: pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)


STRING, INT, LONG = pa.string(), pa.int32(), pa.int64()


def replay(events: DataFrame) -> DataFrame:
    """The log of all events (``EVENT``): after each, what ``step`` says. Sessions are folded in the order of seq, in memory bounded by one store."""
    batch = _typed([("session", STRING), ("seq", LONG), ("kind", STRING), ("path", STRING), ("tag", STRING), ("versions", INT), ("seen", INT), ("paths", INT), ("bytes", LONG)])

    def run(batches):
        for rows in _folded(batches, lambda r, result: [(r["session"], r["seq"], r["kind"], r["path"], *result)], lambda session, store: []):
            yield batch(rows)

    return _sorted_events(events).mapInArrow(run, LOG)


def current(events: DataFrame) -> DataFrame:
    """The versions that sessions hold after all events, place 0 the newest of its path."""
    spans = pa.list_(pa.struct([("first", INT), ("past", INT)]))
    batch = _typed([("session", STRING), ("path", STRING), ("place", INT), ("recorded_at", LONG), ("tag", STRING), ("text", STRING), ("seen", spans)])

    def last(session, store):
        return [(session, p, k, v.recorded_at, v.tag, v.text, [{"first": a, "past": b} for a, b in v.seen]) for p, vs in store.held.items() for k, v in enumerate(vs)]

    def run(batches):
        for rows in _folded(batches, lambda r, result: [], last):
            yield batch(rows)

    return _sorted_events(events).mapInArrow(run, VERSION)


# -- recovery


def line_diff(a: list[str], b: list[str], most: int = 1000) -> list[tuple[int, int, int, int]]:
    """(i, j, k, l): a[i:j] becomes b[k:l], a shortest script by the greedy O(ND) method; one block where that takes over ``most`` changes."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return [(head, head + len(a), head, head + len(b))] if a or b else []
    reach, trail = {1: 0}, []
    for d in range(min(len(a) + len(b), most) + 1):
        trail.append(dict(reach))
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or k != d and reach[k - 1] < reach[k + 1] else reach[k - 1] + 1
            while x < len(a) and x - k < len(b) and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= len(a) and x - k >= len(b):
                break
        else:
            continue
        break
    else:
        return [(head, head + len(a), head, head + len(b))]
    x, y, out = len(a), len(b), []
    for d in range(len(trail) - 1, 0, -1):
        before, k = trail[d], x - y
        from_k = k + 1 if k == -d or k != d and before[k - 1] < before[k + 1] else k - 1
        px = before[from_k]
        py = px - from_k
        step_x, step_y = (px, py + 1) if from_k == k + 1 else (px + 1, py)
        if out and out[-1][0] == step_x and out[-1][2] == step_y:
            out[-1] = (px, out[-1][1], py, out[-1][3])
        else:
            out.append((px, step_x, py, step_y))
        x, y = px, py
    return [(i + head, j + head, k + head, m + head) for i, j, k, m in reversed(out)]


def split_lines(text: str) -> list[str]:
    """Lines with their line feeds."""
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def carried(recorded: str, edited: str, live: str) -> str | None:
    """The change from recorded to edited, made on live: each hunk where its lines and ``CONTEXT`` lines around them stand exactly, nearest
    to where they would be; None where one stands nowhere, or nothing changes."""
    a, b, now = split_lines(recorded), split_lines(edited), split_lines(live)
    hunks: list[list[tuple[int, int, int, int]]] = []
    for change in line_diff(a, b):
        if hunks and change[0] - hunks[-1][-1][1] <= 2 * CONTEXT:
            hunks[-1].append(change)
        else:
            hunks.append([change])
    free, shift = [True] * len(now), 0
    for hunk in hunks:
        first, past = max(0, hunk[0][0] - CONTEXT), min(len(a), hunk[-1][1] + CONTEXT)
        new_first, new_past = hunk[0][2] - (hunk[0][0] - first), hunk[-1][3] + (past - hunk[-1][1])
        wanted, new = a[first:past], b[new_first:new_past]
        guess, limit = min(new_first, len(now)), len(now) - len(wanted)
        fits = lambda at: now[at : at + len(wanted)] == wanted and all(free[at : at + len(wanted)])  # noqa: E731, B023
        places = (p for d in range(len(now) + 1) for p in ((guess - d, guess + d) if d else (guess,)) if 0 <= p <= limit)
        at = next((p for p in places if fits(p)), None)
        if at is None:
            return None
        now[at : at + len(wanted)], free[at : at + len(wanted)] = new, [False] * len(new)
    out = "".join(now)
    return None if out == live else out


def anchors(ops: list[edit.Op]) -> Intervals:
    """Lines that the ops name: those replaced or deleted, and those that something is put before or after."""
    return united([], [(o.start, o.end + 1) for o in ops if o.kind in ("replace", "delete", "insert_before", "insert_after")])


def unseen(seen: Intervals, ops: list[edit.Op]) -> int | None:
    """The first line that the ops name and that was not shown; None where nothing is known of what was."""
    if not seen:
        return None
    for first, past in anchors(ops):
        at = first
        for a, b in seen:
            if a <= at < b:
                at = b
        if at < past:
            return at
    return None


def settled(section: str, live: str, text: str | None, newest: bool | None, known: bool, seen: Intervals) -> tuple[str, str, str | None]:
    """(content, outcome, reason) of a section on the live text; ``text`` is the version of the path that it names.

    Outcomes are applied, merged, replayed, and of the refused ones unseen, drift, fabricated and rejected, which leave the text as it is."""
    try:
        _, wanted, ops = edit.parse_section(section)
        if wanted is None:
            return edit.apply(live, ops), "applied", None
        if text is None:
            return live, "drift" if known else "fabricated", f"tag {wanted}"
        if edit.tag(live, len(wanted)) == wanted and live == text:
            if (line := unseen(seen, ops)) is not None:
                return live, "unseen", f"line {line}"
            return edit.apply(live, ops), "applied", None
        try:
            merged = carried(text, edit.apply(text, ops), live)
        except edit.EditRejected:
            merged = None
        if merged is not None:
            return merged, "merged", None
        before, now = text.split("\n"), live.split("\n")
        if not newest and len(before) == len(now):
            named = [n for first, past in anchors(ops) for n in range(first - 1, past - 1)]
            if all(n < len(now) and before[n] == now[n] for n in named) and (out := edit.apply(live, ops)) != live:
                return out, "replayed", None
        return live, "drift", f"tag {wanted} is now {edit.tag(live, len(wanted))}"
    except edit.EditRejected as error:
        return live, "rejected", str(error)


def recover(edits: DataFrame, versions: DataFrame) -> DataFrame:
    """(edit_id, session, path, content, outcome, reason) of ``edits`` (edit_id, session, path, section, content) on ``versions`` (``VERSION``).

    Versions meet edits by session, path and tag in a shuffle; a null content is an empty text, an edit whose section cannot be read is
    rejected, and one failing edit never stops others. Extra columns are left out."""
    own = edits.select("edit_id", "session", "path", F.coalesce("section", F.lit("")).alias("section"), F.coalesce("content", F.lit("")).alias("content"))
    own = own.withColumn("tag", F.nullif(F.regexp_extract("section", r"^\n*@\s+\S[^\n]*?\s+#([0-9a-f]{4,24})(?:\n|$)", 1), F.lit("")))
    newest = Window.partitionBy("session", "path", "tag").orderBy("place")
    named = versions.withColumn("nth", F.row_number().over(newest)).where("nth = 1").select("session", "path", "tag", "text", "seen", (F.col("place") == 0).alias("newest"))
    known = versions.select("session", "tag").distinct().withColumn("known", F.lit(True))
    met = own.join(named, ["session", "path", "tag"], "left").join(known, ["session", "tag"], "left").drop("tag")
    batch = _typed([("edit_id", met.schema["edit_id"].dataType.typeName() == "string" and STRING or LONG), ("session", STRING), ("path", STRING), ("content", STRING), ("outcome", STRING), ("reason", STRING)])

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                spans = [(s["first"], s["past"]) for s in r["seen"] or []]
                rows.append((r["edit_id"], r["session"], r["path"], *settled(r["section"], r["content"], r["text"], r["newest"], bool(r["known"]), spans)))
            yield batch(rows)

    return met.mapInArrow(run, f"edit_id {met.schema['edit_id'].dataType.simpleString()}, session string, path string, content string, outcome string, reason string")


def to_state(versions: list[Version]) -> str:
    """Versions of a path as they are kept in streaming state."""
    return json.dumps([[v.text, v.tag, v.recorded_at, v.seen] for v in versions])


def of_state(value: str) -> list[Version]:
    return [Version(text, tag, at, [tuple(s) for s in seen]) for text, tag, at, seen in json.loads(value)]
