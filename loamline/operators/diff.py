"""Structural diffs: unified diff text as lines, changed symbols matched in three phases, moves, attribution and conflicts."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions import text
from loamline.operators.graph import MERGE, in_spans

RATIO, DICE = 0.8, 0.8
LINES = "patch string, file_no int, path string, old_path string, status string, is_binary boolean, hunk_no int, seq int, kind string, old_line int, new_line int, content string"


def parse_patch(patch: str, body: str) -> list[tuple]:
    """Rows of a unified diff: one per line of a hunk, and one without a hunk for a file that has none."""
    out: list[tuple] = []
    file_no, hunk_no, seq = -1, 0, 0
    now: dict = {}
    old = new = left_old = left_new = 0
    rows_of_file = 0

    def close() -> None:
        if now and not rows_of_file:
            out.append((patch, file_no, now["path"], now["old_path"], now["status"], now["binary"], None, None, None, None, None, None))

    def begin(path: str | None, old_path: str | None) -> None:
        nonlocal file_no, hunk_no, seq, now, rows_of_file
        close()
        file_no, hunk_no, seq, rows_of_file = file_no + 1, 0, 0, 0
        now = {"path": path, "old_path": old_path, "status": "modified", "binary": False}

    for line in body.split("\n"):
        if left_old > 0 or left_new > 0:  # inside a hunk every line is its content, whatever it looks like
            kind = line[:1] or " "
            if kind == "\\":
                continue
            if kind in " +-":
                out.append((patch, file_no, now["path"], now["old_path"], now["status"], now["binary"], hunk_no, seq, kind, old if kind != "+" else None, new if kind != "-" else None, line[1:]))
                seq, rows_of_file = seq + 1, rows_of_file + 1
                old, left_old = old + (kind != "+"), left_old - (kind != "+")
                new, left_new = new + (kind != "-"), left_new - (kind != "-")
                continue
            left_old = left_new = 0
        if m := re.match(r'diff --git "?a/(.*?)"? "?b/(.*?)"?$', line):
            begin(m[2], m[1])
        elif line.startswith("--- "):
            if not now or rows_of_file:
                begin(None, None)
            source = re.sub(r"\t.*$", "", line[4:]).strip('"')
            now["status"] = "added" if source == "/dev/null" else now["status"]
            now["old_path"] = now["old_path"] or source.removeprefix("a/")
        elif line.startswith("+++ ") and now:
            target = re.sub(r"\t.*$", "", line[4:]).strip('"')
            if target == "/dev/null":
                now["status"], now["path"] = "deleted", now["old_path"]
            else:
                now["path"] = target.removeprefix("b/")
        elif line.startswith("new file mode") and now:
            now["status"] = "added"
        elif line.startswith("deleted file mode") and now:
            now["status"] = "deleted"
        elif line.startswith("rename from ") and now:
            now["status"], now["old_path"] = "renamed", line[12:]
        elif line.startswith("rename to ") and now:
            now["path"] = line[10:]
        elif (line.startswith("Binary files ") or line.startswith("GIT binary patch")) and now:
            now["binary"] = True
        elif (m := re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line)) and now:
            hunk_no, seq = hunk_no + 1, 0
            old, new = int(m[1]), int(m[3])
            left_old, left_new = int(m[2] if m[2] is not None else 1), int(m[4] if m[4] is not None else 1)
    close()
    return out


def diff_lines(patches: DataFrame) -> DataFrame:
    """Lines of ``patches`` (patch, body) with old and new line numbers; malformed hunks end where they stop making sense."""
    names = [c.split()[0] for c in LINES.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [r for p, b in zip(batch["patch"], batch["body"], strict=True) for r in parse_patch(p, b or "")]
            frame = pd.DataFrame(rows, columns=names)
            yield frame.astype({c: "Int32" for c in ("file_no", "hunk_no", "seq", "old_line", "new_line")} | {"is_binary": "boolean"})

    return patches.select("patch", "body").mapInPandas(run, LINES)


def file_changes(lines: DataFrame) -> DataFrame:
    """(patch, file_no, path, old_path, status, is_binary, added, removed)."""
    keys = ["patch", "file_no", "path", "old_path", "status", "is_binary"]
    return lines.groupBy(*keys).agg(F.count_if(F.col("kind") == "+").alias("added"), F.count_if(F.col("kind") == "-").alias("removed"))


def renumbered(lines: DataFrame, hunks: DataFrame) -> DataFrame:
    """Line numbers from hunk starts (file_no, hunk_no, old_start, new_start) by running counts over ``lines`` (file_no, hunk_no, seq, kind)."""
    before = Window.partitionBy("file_no", "hunk_no").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    run = lambda skip: F.coalesce(F.sum((F.col("kind") != skip).cast("int")).over(before), F.lit(0))
    own = lines.join(hunks, ["file_no", "hunk_no"])
    return own.withColumns({"old_no": F.when(F.col("kind") != "+", F.col("old_start") + run("+")), "new_no": F.when(F.col("kind") != "-", F.col("new_start") + run("-"))})


def bodies(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with body, content hash and structural hash."""
    each = files.select("path", F.split("content", "\n").alias("lines"))  # a content is split once, not for each of its symbols
    body = F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    own = symbols.join(each.hint(MERGE), "path").withColumn("body", body).drop("lines")

    own = own.select("path", "lang", "kind", "name", F.coalesce("parent", F.lit("")).alias("parent"), "start_line", "end_line", "signature", "body", "shape")
    content = F.xxhash64("body")
    return own.withColumns({"content_hash": content, "structure_hash": F.coalesce("shape", content)}).drop("shape")


def bigrams(value: str) -> Counter:
    value = re.sub(r"\s+", "", value)
    return Counter(value[k : k + 2] for k in range(len(value) - 1))


def dice(a: str, b: str, kept: dict[str, Counter] | None = None) -> float:
    """Share of character pairs in common, white space left out; equal texts are 1. ``kept`` holds pairs of texts met before."""
    kept = {} if kept is None else kept
    x, y = (kept[t] if t in kept else kept.setdefault(t, bigrams(t)) for t in (a, b))
    total = x.total() + y.total()
    return 2 * (x & y).total() / total if total else float(a.split() == b.split())


CHANGES = "path string, kind string, parent string, name string, change string, old_name string, confidence string, score double, count int, line int, old_signature string, new_signature string"


def match_file(old: list[dict], new: list[dict]) -> list[dict]:
    """Changes between the symbols of one file: by identity, then by structure, then by likeness of the text.

    Every symbol of either side is in one change."""
    out: list[dict] = []

    def add(change: str, a: dict | None, b: dict | None, confidence: str = "exact", score: float | None = None, count: int | None = None) -> None:
        s = b or a
        out.append({
            "path": s["path"], "kind": s["kind"], "parent": s["parent"], "name": s["name"], "change": change, "old_name": a["name"] if a and b and a["name"] != b["name"] else None, "confidence": confidence,
            "score": score, "count": count, "line": s["start_line"], "old_signature": a["signature"] if a else None, "new_signature": b["signature"] if b else None,
        })

    def keyed(rows: list[dict], key) -> dict:
        groups: dict = {}
        for r in rows:
            groups.setdefault(key(r), []).append(r)
        return groups

    identity = lambda s: (s["kind"], s["parent"], s["name"])
    befores, afters = keyed(old, identity), keyed(new, identity)
    loose_old, loose_new = [], []
    for key in sorted(befores.keys() | afters.keys()):
        a, b = list(befores.get(key, [])), list(afters.get(key, []))
        twins = []
        equal = keyed(reversed(b), lambda s: s["content_hash"])
        for x in a:  # overloads: equal bodies first, others by position
            if equal.get(x["content_hash"]):
                twins.append((x, equal[x["content_hash"]].pop()))
        done = {id(s) for pair in twins for s in pair}
        a, b = [x for x in a if id(x) not in done], [y for y in b if id(y) not in done]
        for x, y in twins + list(zip(a, b, strict=False)):
            same = x["content_hash"] == y["content_hash"]
            add("unchanged" if same else "signature_changed" if x["signature"] != y["signature"] else "body_changed", x, y)
        n = min(len(a), len(b))
        loose_old += a[n:]
        loose_new += b[n:]
    shape = lambda s: (s["kind"], s["structure_hash"])
    befores, afters = keyed(loose_old, shape), keyed(loose_new, shape)
    met: set[int] = set()
    for key in befores.keys() & afters.keys():
        a, b = befores[key], afters[key]
        if len(a) == len(b) == 1:
            add("renamed", a[0], b[0], "structural")
        else:
            count = max(len(a), len(b))
            for x in a:
                add("deleted", x, None, "ambiguous", count=count)
            for y in b:
                add("added", None, y, "ambiguous", count=count)
        met.update(id(s) for s in a + b)
    loose_old, loose_new = [x for x in loose_old if id(x) not in met], [y for y in loose_new if id(y) not in met]
    scored, kept = [], {}
    size = lambda s: len(s["body"].encode())
    by_size = sorted((x["kind"], size(x), i) for i, x in enumerate(loose_old))
    for j, y in enumerate(loose_new):
        n = size(y)
        low = bisect_left(by_size, (y["kind"], math.ceil(n * RATIO - 1e-9), -1))
        for kind, m, i in by_size[low:]:  # only bodies of a kind and of about the same size
            if kind != y["kind"] or n < m * RATIO:
                break
            if n and (s := dice(loose_old[i]["body"], y["body"], kept)) >= DICE:
                scored.append((-s, i, j))
    used_old, used_new = set(), set()
    for s, i, j in sorted(scored):
        if i not in used_old and j not in used_new:
            used_old.add(i)
            used_new.add(j)
            x, y = loose_old[i], loose_new[j]
            add("renamed" if x["name"] != y["name"] else "body_changed", x, y, "fuzzy", -s)
    for i, x in enumerate(loose_old):
        if i not in used_old:
            add("deleted", x, None)
    for j, y in enumerate(loose_new):
        if j not in used_new:
            add("added", None, y)
    return out


def symbol_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes between the symbols (see ``bodies``) of two versions, file by file; a file's symbols are one group."""
    both = old.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1)))
    kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in CHANGES.split(", "))])

    def run(batches):
        path, held = None, []

        def found() -> list[dict]:
            rows = sorted(held, key=lambda r: (r["start_line"], r["end_line"]))
            return match_file([r for r in rows if r["side"] == 0], [r for r in rows if r["side"] == 1])

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["path"] != path and held:
                    out += found()
                    held = []
                path = row["path"]
                held.append(row)
            yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist(found(), schema)

    parts = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number, as the work is not in proportion to the bytes
    # by a hash of the path: Spark 4.1 takes the union of two sides dealt by path to be dealt so itself, which adaptive execution can undo
    return both.repartition(parts, F.xxhash64("path")).sortWithinPartitions("path").mapInArrow(run, CHANGES)


def moves(changes: DataFrame) -> DataFrame:
    """(kind, name, old_path, path): symbols deleted from one file and added to one other."""
    key = ["kind", "name"]
    gone = changes.where("change = 'deleted'").groupBy(*key).agg(F.count("*").alias("n"), F.min("path").alias("old_path")).where("n = 1").drop("n")
    came = changes.where("change = 'added'").groupBy(*key).agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").drop("n")
    return gone.join(came.hint(MERGE), key).where("old_path <> path")


def signature_warnings(changes: DataFrame) -> DataFrame:
    """Names whose signature changed in more than one place."""
    return changes.where("change = 'signature_changed'").groupBy("name").agg(F.count("*").alias("places"), F.array_sort(F.collect_set("path")).alias("paths")).where("places > 1")


def blast(changes: DataFrame, calls: DataFrame) -> DataFrame:
    """(name, callers): call sites of each name whose signature changed."""
    named = changes.where("change = 'signature_changed'").select("name").distinct()
    return named.join(calls.hint(MERGE), named["name"] == calls["callee"], "left").groupBy("name").agg(F.count("callee").alias("callers"))


def attributed(lines: DataFrame, symbols: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """Changed diff lines with the innermost symbol that they are in: of the new version, or for removed lines of ``gone``, the
    symbols of the old version that are deleted. Other removed lines go by where they stood between new ones."""
    near = F.coalesce("new_line", F.last("new_line", ignorenulls=True).over(Window.partitionBy("patch", "path", "hunk_no").orderBy("seq")))
    own = lines.withColumn("line", near).where("kind IN ('+', '-')").select("patch", "path", "hunk_no", "seq", "kind", "content", "line", "old_line")

    def innermost(rows: DataFrame, of: DataFrame, name: str) -> DataFrame:
        spans = of.select("path", "name", F.col("start_line").alias("first"), F.col("end_line").alias("last"))
        best = F.max_by("name", F.struct("first", (-F.col("last")).alias("e")))
        return in_spans(rows.distinct(), spans).groupBy("path", "line").agg(best.alias(name))

    out = own.join(innermost(own.select("path", "line"), symbols, "symbol").hint(MERGE), ["path", "line"], "left")
    if gone is not None:
        removed = own.where("kind = '-'").select("path", F.col("old_line").alias("line"))
        old = innermost(removed, gone, "_old").select(F.col("path"), F.col("line").alias("old_line"), "_old")
        out = out.join(old.hint(MERGE), ["path", "old_line"], "left").withColumn("symbol", F.when(F.col("kind") == "-", F.coalesce("_old", "symbol")).otherwise(F.col("symbol")))
    return out.select("patch", "path", "hunk_no", "seq", "kind", "content", "symbol")


def conflicts(lines: DataFrame) -> DataFrame:
    """(path, line, ours, theirs) of conflict markers in ``lines`` (path, line, text); unclosed conflicts are left out."""
    order = Window.partitionBy("path").orderBy("line")
    mark = F.when(F.col("text").startswith("<<<<<<<"), 1).when(F.col("text").rlike("^=======$"), 2).when(F.col("text").startswith(">>>>>>>"), 3).when(F.col("text").startswith("|||||||"), 4)
    own = lines.withColumn("mark", mark).withColumn("no", F.count_if(F.col("mark") == 1).over(order)).where("no > 0")
    part = F.last("mark", ignorenulls=True).over(Window.partitionBy("path", "no").orderBy("line"))
    own = own.withColumn("part", part).where("part <> 3 OR mark = 3")
    side = lambda k: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("mark").isNull() & (F.col("part") == k), F.struct("line", "text")))), lambda x: x["text"]), "\n")
    out = own.groupBy("path", "no").agg(F.min("line").alias("line"), side(1).alias("ours"), side(2).alias("theirs"), F.max(F.col("mark") == 3).alias("closed"))
    return out.where("closed").select("path", "line", "ours", "theirs")


def matching_changes(changes: DataFrame, lines: DataFrame, term: str) -> DataFrame:
    """Changes of symbols whose name, or whose attributed lines (path, symbol, content), hold a term in any case."""
    by_line = lines.where(F.lower("content").contains(term.lower()) & F.col("symbol").isNotNull()).select("path", F.col("symbol").alias("name"))
    by_name = changes.where(F.lower("name").contains(term.lower())).select("path", "name")
    return changes.join(by_line.union(by_name).distinct().hint(MERGE), ["path", "name"], "left_semi")


def in_scope(rows: DataFrame, scope: str) -> DataFrame:
    """Rows of a path, of what is under it, or of paths that end with it."""
    scope = scope.removeprefix("./").rstrip("/")
    return rows.where((F.col("path") == scope) | F.col("path").startswith(f"{scope}/") | F.col("path").endswith(f"/{scope}"))


def marker(change: Column, moved: Column | None = None) -> Column:
    # The marks of changes in a report.
    marks = {"added": "[+]", "deleted": "[-]", "body_changed": "[~]", "signature_changed": "[~:sig]", "renamed": "[→]", "unchanged": "[ ]"}
    own = F.element_at(F.create_map(*[F.lit(x) for pair in marks.items() for x in pair]), change)
    return own if moved is None else F.when(moved, "[↦]").otherwise(own)


def age_label(seconds: Column) -> Column:
    out = F.lit("just now")
    for size, unit in ((60, "m"), (3600, "h"), (86_400, "d"), (604_800, "w"), (31_536_000, "y")):
        out = F.when(seconds >= size, F.concat(F.floor(seconds / size).cast("string"), F.lit(f"{unit} ago"))).otherwise(out)
    return out


def line_pairs(files: DataFrame) -> DataFrame:
    """Distinct lines of ``files`` (path, content) with the files they are in: the base of line-level comparison of near copies."""
    return text.lines(files, "path").where(F.length("text") > 0).select(F.xxhash64("text").alias("line_hash"), "path").distinct()
