"""Corpora: directory trees, document tables, JSON run records, event streams and git history as DataFrames.

Spark's own file sources pass over names that begin with a dot or an underscore; a source tree is full of those, so the
driver lists paths (names only) and executors read the contents."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamline.functions import names, text

FILES = "path string, size long, mtime timestamp, content string"
IGNORE_FILE = ".loamignore"
READ_BYTES = 2_000_000


def walk(root: str) -> Iterator[tuple[str, int, float]]:
    """(path relative to root, size, modification time) of files; follows links once, stays on one file system, skips build folders."""
    device, seen = os.stat(root).st_dev, set()
    for folder, folders, files in os.walk(root, followlinks=True):
        real = os.path.realpath(folder)
        if real in seen or os.stat(folder).st_dev != device:
            folders[:] = []
            continue
        seen.add(real)
        # links come last, so that a folder is walked by its own name
        folders[:] = sorted((d for d in folders if d not in names.SKIPPED_DIRS), key=lambda d: (os.path.islink(os.path.join(folder, d)), d))
        for name in sorted(files):
            path = os.path.join(folder, name)
            if os.path.isfile(path):
                info = os.stat(path)
                yield os.path.relpath(path, root), info.st_size, info.st_mtime


def ignore_rules(root: str) -> list[tuple[str, int, str, bool]]:
    """(directory, order, glob, ignored) of every ignore file; a rule with ``!`` takes a path back in."""
    rules = []
    for path, _, _ in walk(root):
        if os.path.basename(path) == IGNORE_FILE:
            with open(os.path.join(root, path), errors="replace") as lines:
                for order, line in enumerate(x.strip() for x in lines):
                    if line and not line.startswith("#"):
                        rules.append((os.path.dirname(path), order, line.removeprefix("!").rstrip("/"), not line.startswith("!")))
    return rules


def ignored(paths: DataFrame, rules: list[tuple[str, int, str, bool]]) -> DataFrame:
    """``paths`` (path, ...) with ``ignored``: the decision of the deepest ignore file with a rule that fits, its last such rule."""
    decision = F.lit(None).cast("boolean")
    for folder, _, glob, deny in sorted(rules, key=lambda r: (r[0].count("/") + bool(r[0]), r[1])):
        inside = F.col("path").startswith(folder + "/") if folder else F.lit(True)
        rest = F.substr("path", F.lit(len(folder) + 2)) if folder else F.col("path")
        pattern = text.glob_regex(glob if "/" in glob else f"**/{glob}").removesuffix("$") + "(?:/.*)?$"
        decision = F.when(inside & rest.rlike(pattern), deny).otherwise(decision)
    return paths.withColumn("ignored", F.coalesce(decision, F.lit(False)))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime) of a tree; names and sizes only."""
    return spark.createDataFrame(list(walk(root)), "path string, size long, seconds double").select("path", "size", F.timestamp_seconds("seconds").alias("mtime"))


def read_tree(spark: SparkSession, root: str, partitions: int | None = None) -> DataFrame:
    """Files of a tree as (path, size, mtime, content, is_binary); bytes that are no UTF-8 are replaced, binary contents are null."""
    root = os.path.abspath(root)
    rows = listing(spark, root).where(names.enters_walk(F.col("path"), F.col("size")))
    rows = rows.repartition(partitions or spark.sparkContext.defaultParallelism, "path")

    def load(batches):
        for batch in batches:
            content, binary = [], []
            for path in batch.column("path").to_pylist():
                with open(os.path.join(root, path), "rb") as file:
                    data = file.read(READ_BYTES)
                binary.append(b"\0" in data[:512])
                content.append(None if binary[-1] else data.decode("utf-8", "replace"))
            columns = [*batch.columns, pa.array(content, pa.string()), pa.array(binary)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "content", "is_binary"])

    return rows.mapInArrow(load, FILES + ", is_binary boolean")


def from_documents(documents: DataFrame) -> DataFrame:
    """A document table as files: path source/lang/doc_id.txt, and a time that goes by the id as the table has none."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    content = F.coalesce("text", F.lit(""))
    when = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id"))
    return documents.select(path.alias("path"), F.octet_length(content).cast("long").alias("size"), when.alias("mtime"), content.alias("content"), "doc_id")


# The layout of run records.
RUN = """task string, repo string, mode string, model string, model_alias string, capability string, repetition int,
num_turns int, num_tool_calls int, tool_calls map<string,int>, total_cost_usd double, duration_ms long, context_tokens long,
output_tokens long, input_tokens long, cache_creation_tokens long, cache_creation_5m_tokens long, cache_creation_1h_tokens long,
cache_read_tokens long, per_turn_context_tokens array<long>, per_turn_output_tokens array<long>,
per_turn_token_usage array<struct<input_tokens:long,cache_creation_tokens:long,cache_creation_5m_tokens:long,cache_creation_1h_tokens:long,cache_read_tokens:long,output_tokens:long>>,
correct boolean, correctness_reason string, result_text string, error string, available_tools array<string>,
batch_sizes map<string,array<int>>, arm_order array<string>, arm_order_index int, arm_order_seed long"""


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records, one JSON object a line; blank lines are passed over."""
    return spark.read.schema(RUN).json(path)


EVENT = """type string, message struct<id:string,usage:struct<input_tokens:long,output_tokens:long,cache_read_input_tokens:long,cache_creation_input_tokens:long>,
content:array<struct<type:string,text:string,id:string,name:string,input:string>>>, result string, total_cost_usd double, num_turns int, duration_ms long, error string, subtype string"""


def agent_events(rows: DataFrame) -> DataFrame:
    """Parse rows (session, line_no, text) of agent event streams, a JSON object each; malformed lines are passed over."""
    return rows.select("session", "line_no", F.from_json("text", EVENT).alias("e")).where("e.type IS NOT NULL").select("session", "line_no", "e.*")


def agent_turns(events: DataFrame) -> DataFrame:
    """Turns of a stream: fragments with one message id are one turn, numbered by first line, with the usage stated last."""
    own = events.where("type = 'assistant'").select("session", "line_no", F.coalesce("message.id", F.concat(F.lit("line-"), F.col("line_no"))).alias("id"), "message.usage", "message.content")
    turns = own.groupBy("session", "id").agg(
        F.min("line_no").alias("line_no"), F.max_by("usage", F.when(F.col("usage").isNotNull(), F.col("line_no"))).alias("usage"),
    )
    return turns.withColumn("turn", F.row_number().over(Window.partitionBy("session").orderBy("line_no"))).select("session", "turn", "line_no", "usage.*")


def agent_tool_calls(events: DataFrame) -> DataFrame:
    """(session, call_id, tool, line_no, order): a call id counts once, where it is first seen."""
    calls = events.select("session", "line_no", F.posexplode("message.content").alias("pos", "c")).where("c.type = 'tool_use'")
    order = Window.partitionBy("session", "call_id").orderBy("line_no", "pos")
    named = calls.select("session", "line_no", "pos", F.coalesce("c.id", F.concat_ws("-", "line_no", "pos")).alias("call_id"), F.regexp_replace("c.name", r"^(mcp__[^_]+__)\1", "$1").alias("tool"))
    return named.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


# Events of the two other kinds of streams: items within turns, and parts within steps.
ITEM_EVENT = """type string, thread_id string, item struct<type:string,id:string,text:string,command:string,tool:string,arguments:string,file_path:string>,
usage struct<input_tokens:long,cached_input_tokens:long,cache_write_input_tokens:long,cache_write_tokens:long,output_tokens:long>"""
PART_EVENT = """type string, sessionID string, part struct<tool:string,callID:string,id:string,text:string,cost:double,state:struct<input:string>,
tokens:struct<input:long,output:long,cache:struct<write:long,read:long>>>"""
ITEM_TOOLS = {"command_execution": "Bash", "file_edit": "Edit", "file_write": "Write"}
TURN = "session turn input_tokens output_tokens cache_creation_tokens cache_read_tokens".split()


def item_stream(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, calls) of streams of items (session, line_no, text): a turn's items follow its start, usages go to turns in order.

    Cached tokens and tokens written to the cache are parts of the input stated, and are taken off it."""
    order = Window.partitionBy("session").orderBy("line_no")
    events = rows.select("session", "line_no", F.from_json("text", ITEM_EVENT).alias("e")).where("e.type IS NOT NULL").select("session", "line_no", "e.*")
    events = events.withColumns({"turn": F.count_if(F.col("type") == "turn.started").over(order), "ended": F.count_if(F.col("type") == "turn.completed").over(order)})
    turns = events.where("type = 'turn.started'").select("session", "turn")
    zero = lambda *cs: F.coalesce(*[F.when(F.col(f"usage.{c}") != 0, F.col(f"usage.{c}")) for c in cs], F.lit(0).cast("long"))
    cached, written = zero("cached_input_tokens"), zero("cache_write_input_tokens", "cache_write_tokens")
    usage = events.where("type = 'turn.completed'").select(
        "session", F.col("ended").alias("turn"), F.greatest(zero("input_tokens") - cached - written, F.lit(0)).alias("input_tokens"), zero("output_tokens").alias("output_tokens"),
        written.alias("cache_creation_tokens"), cached.alias("cache_read_tokens"),
    )
    turns = turns.join(usage, ["session", "turn"], "left").select("session", "turn", *[F.coalesce(c, F.lit(0)).alias(c) for c in TURN[2:]])
    tools = F.create_map(*[F.lit(x) for pair in ITEM_TOOLS.items() for x in pair])
    tool = F.when(F.col("item.type") == "mcp_tool_call", F.coalesce("item.tool", F.lit("unknown"))).otherwise(tools[F.col("item.type")])
    given = F.when(F.col("item.type") == "mcp_tool_call", F.col("item.arguments")).otherwise(F.coalesce("item.command", "item.file_path"))
    calls = events.where("type = 'item.completed' AND turn > 0").select("session", "turn", "line_no", F.coalesce("item.id", F.lit("")).alias("call_id"), tool.alias("tool"), given.alias("input"))
    return turns, calls.where("tool IS NOT NULL")


def part_stream(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, calls) of streams of parts (session, line_no, text): a finished step is a turn, which has the tools used since the step before.

    A server's name that a tool has twice before its own stands once; tools after the last finished step belong to no turn."""
    order = Window.partitionBy("session").orderBy("line_no")
    events = rows.select("session", "line_no", F.from_json("text", PART_EVENT).alias("e")).where("e.type IS NOT NULL").select("session", "line_no", "e.*")
    done = F.count_if(F.col("type") == "step_finish")
    events = events.withColumns({"turn": F.coalesce(done.over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1, "turns": done.over(Window.partitionBy("session"))})
    count = lambda c: F.coalesce(f"part.tokens.{c}", F.lit(0).cast("long"))
    turns = events.where("type = 'step_finish'").select(
        "session", "turn", count("input").alias("input_tokens"), count("output").alias("output_tokens"), count("cache.write").alias("cache_creation_tokens"), count("cache.read").alias("cache_read_tokens"),
        F.coalesce("part.cost", F.lit(0.0)).alias("cost"),
    )
    tool = F.regexp_replace(F.coalesce("part.tool", F.lit("unknown")), r"^([^_]+_)\1", "$1")
    calls = events.where("type = 'tool_use' AND turn <= turns").select("session", "turn", "line_no", F.coalesce("part.callID", "part.id", F.lit("")).alias("call_id"), tool.alias("tool"), F.col("part.state.input").alias("input"))
    return turns, calls


def stream_errors(events: DataFrame) -> DataFrame:
    """Last error of each session."""
    return events.where("error IS NOT NULL").groupBy("session").agg(F.max_by(F.concat_ws(": ", F.coalesce("subtype", F.lit("error")), "error"), "line_no").alias("error"))


def git(root: str, *args: str) -> str:
    """Output of git, run on the driver; arguments that a caller supplies may not begin with a dash."""
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=60, check=False)
    if done.returncode > 1:
        raise ValueError(done.stderr.strip() or f"git {args[0]} failed")
    return done.stdout


def no_option(value: str) -> str:
    if value.startswith("-"):
        raise ValueError(f"{value!r} looks like an option")
    return value


def diff_text(root: str, *, patch: str | None = None, log: str | None = None, a: str | None = None, b: str | None = None, named: str | None = None) -> str:
    """Unified diff by the first that is given: a patch file, a commit range, two paths, a named source, else what is not committed."""
    if patch is not None:
        with open(patch, errors="replace") as file:
            return file.read()
    if log is not None:
        return git(root, "log", "-p", "--format=commit %H", no_option(log))
    if a is not None and b is not None:
        return git(root, "diff", "--no-index", "--", a, b)
    if named == "staged":
        return git(root, "diff", "--cached")
    return git(root, "diff", no_option(named)) if named not in (None, "uncommitted") else git(root, "diff", "HEAD")


def commits(spark: SparkSession, root: str, span: str) -> DataFrame:
    """(hash, epoch, parents, subject, author) of a range, newest first."""
    out = git(root, "log", "--format=%H%x1f%ct%x1f%P%x1f%s%x1f%an%x1e", no_option(span))
    rows = [x.strip("\n").split("\x1f") for x in out.split("\x1e") if x.strip()]
    data = [(n, h, int(e), p.split(), s, w) for n, (h, e, p, s, w) in enumerate(rows)]
    return spark.createDataFrame(data, "ord int, hash string, epoch long, parents array<string>, subject string, author string")


def package_root(files: DataFrame, path: Column | str = "path") -> DataFrame:
    """(path, package): the nearest directory at or above each file's that holds a build manifest."""
    dirs = files.select(names.basename(F.col("path")).alias("name"), names.parent(F.col("path")).alias("dir")).where(F.col("name").isin(names.MANIFESTS)).select("dir").distinct()
    above = files.select("path", F.explode(names.ancestors(F.col("path"))).alias("dir"))
    return above.join(dirs, "dir").groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("package"))
