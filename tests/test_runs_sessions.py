import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.operators import runs, session
from loamline.sources import corpus
from loamline.streaming import session as streams


def test_intervals():
    assert runs.bootstrap(np.array([])) == (0.0, 0.0) and runs.bootstrap(np.array([3.0])) == (3.0, 3.0) and runs.bootstrap(np.array([2.0, 2.0])) == (2.0, 2.0)
    x = np.random.default_rng(1).normal(5, 1, 400)
    low, high = runs.bootstrap(x)
    assert low < x.mean() < high and abs((high - low) / 2 - 1.96 / 20) < 0.02
    assert runs.bootstrap(x) == runs.bootstrap(x[::-1])
    assert runs.ratio_bootstrap([], []) == (float("inf"), float("inf")) and runs.ratio_bootstrap([3], [2]) == (1.5, 1.5) and runs.ratio_bootstrap([1, 2], [0, 0])[0] == float("inf")
    low, high = runs.ratio_bootstrap(np.ones(50), [1, 0] * 25)
    assert low < 2 < high
    with pytest.raises(ValueError):
        runs.bootstrap(x, "mode")


def test_wilson_and_effect(spark):
    row = spark.range(1).select(*runs.wilson(F.lit(8), F.lit(10)), *runs.wilson(F.lit(0), F.lit(0)), runs.minimum_effect(F.lit(100), F.lit(0.5)), runs.minimum_effect(F.lit(0), F.lit(0.5))).first()
    assert list(row) == pytest.approx([0.49016, 0.94332, 0, 1, 0.14008, 1.0], abs=1e-4)


def test_records(spark, tmp_path):
    path = tmp_path / "runs.jsonl"
    path.write_text('{"task": "a", "mode": "baseline", "model": "m", "repetition": 1, "correct": true, "total_cost_usd": 0.5, "per_turn_output_tokens": [10, 12, 14]}\n\n{"task": "a", "mode": "new", "model": "m", "repetition": 1, "correct": false, "error": "Timeout", "total_cost_usd": 1.5, "tool_calls": {"x": 3}}\n')
    own = corpus.read_runs(spark, str(path)).where("task IS NOT NULL")
    assert own.count() == 2
    assert {(r["flag"], r["mode"]) for r in runs.flags(own).collect()} == {("token_snowball", "baseline"), ("budget_exhausted", "new"), ("timeout", "new")}
    pairs = runs.paired(own.withColumn("n", F.monotonically_increasing_id()), "baseline", "new", ["task", "model", "repetition"], ["correct", "total_cost_usd"], "n")
    assert runs.transitions(pairs).first().asDict() == {"both": 0, "lost": 1, "gained": 0, "neither": 0}
    assert runs.failure(own).first()["detail"] == "timeout"
    known = runs.capability(own, spark.createDataFrame([("a", "fix")], "task string, capability string"))
    assert {r["capability"] for r in known.collect()} == {"fix"}


def test_small_helpers(spark):
    assert runs.comparison_pairs(["new", "baseline", "x"]) == [("new", "baseline"), ("x", "baseline")] and runs.comparison_pairs([]) == []
    assert runs.planned_cells(2, 3, 2, 5) == 60
    with pytest.raises(ValueError):
        runs.planned_cells(2, 3, 2, 5, 59)
    row = spark.range(1).select(runs.sparkline(F.array(F.lit(1.0), F.lit(5.0), F.lit(9.0))), runs.delta_label(F.lit(2.0), F.lit(3.0)))
    assert list(row.first()) == [" ▄█", "+50%"]


def test_agent_streams(spark):
    lines = [
        '{"type": "system"}', "broken {", '{"type": "assistant", "message": {"id": "m1", "usage": {"output_tokens": 3}, "content": [{"type": "tool_use", "id": "t1", "name": "read"}]}}',
        '{"type": "assistant", "message": {"id": "m1", "usage": {"output_tokens": 7}, "content": [{"type": "tool_use", "id": "t1", "name": "read"}, {"type": "text", "text": "x"}]}}',
        '{"type": "assistant", "message": {"id": "m2", "usage": {"output_tokens": 5}}}', '{"type": "result", "error": "late", "subtype": "timeout"}',
    ]
    events = corpus.agent_events(spark.createDataFrame([("s", k, x) for k, x in enumerate(lines)], "session string, line_no int, text string"))
    assert [(r["turn"], r["output_tokens"]) for r in corpus.agent_turns(events).orderBy("turn").collect()] == [(1, 7), (2, 5)]
    assert [(r["call_id"], r["tool"]) for r in corpus.agent_tool_calls(events).collect()] == [("t1", "read")]
    assert corpus.stream_errors(events).first()["error"] == "timeout: late"


def test_streams_give_the_batch_results(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 5)), 1_700_000_000 + k * 10, k, ["read", "search"][int(rng.integers(0, 2))], str(int(rng.integers(0, 4)))) for k in range(200)]
    calls = spark.createDataFrame(rows, "session long, s long, seq long, tool string, item string").select("session", F.timestamp_seconds("s").alias("ts"), "seq", "tool", "item")
    calls.where("seq < 100").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    calls.where("seq >= 100").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = streams.nudges(stream).writeStream.format("memory").queryName("nudged").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("nudged").collect())) == sorted(map(tuple, session.nudges(calls).collect()))
    query = streams.counters(stream).writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", f"{tmp_path}/d").trigger(availableNow=True).start()
    query.awaitTermination(120)
    # windows end after 30 minutes without a call and are final an hour later: the calls of 2000 seconds are still open
    assert spark.table("counted").count() == 0


def in_batches(spark, folder, batches):
    schema = "session long, ts timestamp, seq long, tool string, item string"
    for k, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "session long, s long, seq long, tool string, item string")
        frame.select("session", F.timestamp_seconds("s").alias("ts"), "seq", "tool", "item").coalesce(1).write.parquet(f"{folder}/b={k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def finished(frame, name, folder):
    query = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return query


def test_windows_of_calls_end(spark, tmp_path):
    day = 1_700_000_000
    batches = [[(1, day + 60 * k, k, "read", "a") for k in range(5)] + [(2, day, 50, "search", "b")], [(1, day + 7200, 60, "read", "a"), (3, day + 36_000, 61, "read", "c")], [(4, day + 72_000, 70, "read", "z")], [(1, day + 30, 71, "read", "late"), (5, day + 90_000, 72, "read", "y")]]
    finished(streams.counters(in_batches(spark, tmp_path / "in", batches)), "ended", tmp_path / "c")
    got = sorted((r["session"], r["tool"], r["calls"], (r["end"] - r["start"]).total_seconds()) for r in spark.table("ended").collect())
    assert got == [(1, "read", 1, 1800.0), (1, "read", 5, 2040.0), (2, "search", 1, 1800.0), (3, "read", 1, 1800.0), (4, "read", 1, 1800.0)]  # the late call changes none


def test_state_of_idle_sessions_goes(spark, tmp_path):
    day = 1_700_000_000
    call = lambda s, at, seq, item: (s, day + at, seq, "read", item)
    batches = [[call(1, 0, 1, "a"), call(1, 10, 2, "b")], [call(2, 20_000, 3, "x")], [call(2, 40_000, 4, "y")], [call(1, 41_000, 5, "c"), call(1, 30, 6, "late"), call(1, 41_010, 7, "d")], [call(3, 50_000, 8, "q")]]
    stream = streams.nudges(in_batches(spark, tmp_path / "in", batches), idle_ms=3_600_000)
    query = finished(stream, "idle", tmp_path / "c")
    got = sorted((r["session"], r["seq"], r["nth"]) for r in spark.table("idle").collect())
    # session 1 went after an hour: its call of 41 000 follows none, and counts begin anew
    assert got == [(1, 2, 1), (1, 7, 1), (2, 4, 1)]  # that of session 2 went on, as the watermark had not passed its end
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert held[-1] == 1  # of three sessions, that of the last call


def test_sequences_and_drift(spark):
    calls = spark.createDataFrame([("s", 2, "read", "x" * 90), ("s", 1, "list", None)], "session string, ord int, tool string, args string")
    assert runs.tool_sequence(calls).first()["sequence"] == ["list()", "read(" + "x" * 80 + "...)"]
    own = spark.createDataFrame([("a", "h1"), ("a", "h2"), ("b", None)], "mode string, hash string")
    plan = spark.createDataFrame([("a", "h1"), ("b", None)], "mode string, hash string")
    assert [tuple(r) for r in runs.manifest_drift(own, plan, ["hash"]).collect()] == [("a", "hash", "h1", "h2", 1)]
    row = spark.range(1).select(runs.context_total(F.array(F.lit(1), F.lit(2)).cast("array<long>")), runs.stale_prices("2024-01-01", F.lit("2024-02-15").cast("date")), runs.stale_prices("2024-01-01", F.lit("2024-01-15").cast("date"))).first()
    assert tuple(row) == (3, "prices of 2024-01-01 are 45 days old", None)
