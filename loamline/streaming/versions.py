"""The version store of sessions as a streaming operator; the batch replay of all events is its specification."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loamline.operators.versions import EVENT, LOG, Store, Version, of_state, step, to_state


class StateStore(Store):
    """A session's store in keyed state: a path's versions are read when an event names it, of other paths only use and size."""

    def __init__(self, versions, uses, tags, clock):
        self.versions, self.uses, self.tags, self.time = versions, uses, tags, clock

    def get(self, path: str) -> list[Version]:
        return of_state(self.versions.getValue((path,))[0]) if self.versions.containsKey((path,)) else []

    def put(self, path: str, versions: list[Version], used: int) -> None:
        self.versions.updateValue((path,), (to_state(versions),))
        self.uses.updateValue((path,), (used, 1 + sum(v.weight() for v in versions)))
        self.tags.updateValue((path,), (" ".join(v.tag for v in versions),))

    def drop(self, path: str) -> None:
        for state in (self.versions, self.uses, self.tags):
            if state.containsKey((path,)):
                state.removeKey((path,))

    def paths(self) -> list[tuple[int, str, int]]:
        return sorted((used, path, size) for (path,), (used, size) in self.uses.iterator())

    def tagged(self, tag: str) -> list[str]:
        paths = [path for (path,), (tags,) in self.tags.iterator() if tag in tags.split()]
        return [v.text for path in paths for v in self.get(path) if v.tag == tag]

    def tick(self) -> int:
        now = (self.time.get()[0] if self.time.exists() else 0) + 1
        self.time.update((now,))
        return now


class VersionProcessor(StatefulProcessor):
    """Folds the events of a session, in the order of seq within a batch; state of a session ends ``ttl_ms`` after its last use of a path."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.versions = handle.getMapState("versions", "path string", "versions string", self.ttl_ms)
        self.uses = handle.getMapState("uses", "path string", "used long, bytes long", self.ttl_ms)
        self.tags = handle.getMapState("tags", "path string", "tags string", self.ttl_ms)
        self.clock = handle.getValueState("clock", "now long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq").astype(object)
        events = events.where(events.notna(), None) if len(events) else events
        store, out = StateStore(self.versions, self.uses, self.tags, self.clock), []
        for r in events.itertuples(index=False):
            lines = None if r.lines is None else [int(x) for x in r.lines]
            out.append((key[0], r.seq, r.kind, r.path, *step(store, r.kind, r.path, r.text, r.tag, lines, r.target)))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in LOG.split(", ")])
        yield frame.astype({"seq": "int64", "versions": "int32", "seen": "int32", "paths": "int32", "bytes": "int64"})

    def close(self) -> None:
        pass


def version_log(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """The log of a stream of events (``EVENT``), as ``operators.versions.replay`` gives it.

    Needs ``spark.sql.streaming.stateStore.providerClass`` to be the RocksDB provider. Events of one session that arrive in a later
    batch with a lower seq are folded when they arrive."""
    own = events.select(*[c.split()[0] for c in EVENT.split(", ")])
    mode = "ProcessingTime" if ttl_ms else "None"
    return own.groupBy("session").transformWithStateInPandas(VersionProcessor(ttl_ms), LOG, "Append", mode)
