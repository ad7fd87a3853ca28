"""Run, session and report queries over the driver's tables, each with the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.operators import runs, session
from loamline.sources import corpus

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Line items as runs of an experiment: arms by return flag, correct by line status.
RUNS_SQL = """WITH runs AS (SELECT 't' || (l_partkey % 50) AS task, CASE l_returnflag WHEN 'A' THEN 'baseline' WHEN 'N' THEN 'forced' ELSE 'mixed' END AS mode, 'm' || (l_suppkey % 3) AS model, l_linenumber AS repetition,
  l_extendedprice / 50000 AS total_cost_usd, l_linestatus = 'F' AS correct, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS run_id, CAST(l_quantity * 10 AS BIGINT) AS output_tokens, CAST(l_quantity AS INTEGER) % 23 AS num_tool_calls,
  CASE WHEN l_orderkey % 97 = 0 THEN 'Timeout after 90 s' WHEN l_orderkey % 89 = 0 THEN 'budget gone' WHEN l_orderkey % 83 = 0 THEN 'crash' END AS error,
  CASE l_orderkey % 6 WHEN 0 THEN 'Missing: alpha' WHEN 1 THEN 'Contains forbidden: beta' WHEN 2 THEN 'Test failed: gamma' WHEN 3 THEN 'No changes in target file' WHEN 4 THEN '' ELSE 'odd' END AS correctness_reason,
  [CAST(l_quantity AS BIGINT), CAST(l_quantity AS BIGINT) * 12 // 10, CAST(l_quantity AS BIGINT) * 12 // 10 + CAST(l_quantity AS BIGINT) * l_linenumber // 20] AS turns FROM lineitem)
"""
_CELLS = "(SELECT *, row_number() OVER (PARTITION BY task, model, repetition, mode ORDER BY run_id DESC) AS latest FROM runs WHERE mode IN ('baseline', 'forced'))"
_PAIRS = f"""p AS (SELECT a.task, a.model, a.repetition, a.correct AS ac, b.correct AS bc, a.total_cost_usd AS acost, b.total_cost_usd AS bcost
  FROM {_CELLS} a JOIN {_CELLS} b ON a.task = b.task AND a.model = b.model AND a.repetition = b.repetition AND a.mode = 'baseline' AND b.mode = 'forced' AND a.latest = 1 AND b.latest = 1)"""


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def all_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, q = F.col, F.col("l_quantity")
    order, whole = c("l_orderkey"), q.cast("long")
    reasons = F.array(*[F.lit(x) for x in ("Missing: alpha", "Contains forbidden: beta", "Test failed: gamma", "No changes in target file", "", "odd")])
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.concat(F.lit("t"), (c("l_partkey") % 50).cast("string")).alias("task"), F.when(c("l_returnflag") == "A", "baseline").when(c("l_returnflag") == "N", "forced").otherwise("mixed").alias("mode"),
        F.concat(F.lit("m"), (c("l_suppkey") % 3).cast("string")).alias("model"), F.lit(None).cast("string").alias("model_alias"), c("l_linenumber").alias("repetition"),
        (c("l_extendedprice") / 50000).alias("total_cost_usd"), (c("l_linestatus") == "F").alias("correct"), (((order * 10 + c("l_linenumber")) * 100_000 + c("l_partkey")) * 10_000 + c("l_suppkey")).alias("run_id"), (q * 10).cast("long").alias("output_tokens"),
        (q.cast("int") % 23).alias("num_tool_calls"), F.create_map(F.lit("read"), q.cast("int") % 7, F.lit("search"), q.cast("int") % 5).alias("tool_calls"),
        F.when(order % 97 == 0, "Timeout after 90 s").when(order % 89 == 0, "budget gone").when(order % 83 == 0, "crash").alias("error"), F.element_at(reasons, (order % 6 + 1).cast("int")).alias("correctness_reason"),
        F.array(whole, F.floor(whole * 12 / 10), F.floor(whole * 12 / 10) + F.floor(whole * c("l_linenumber") / 20)).alias("per_turn_output_tokens"),
        F.create_map(F.lit("read"), F.array(q.cast("int") % 4, q.cast("int") % 3), F.lit("search"), F.array(q.cast("int") % 2)).alias("batch_sizes"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.paired(all_runs(spark, sf_dir), "baseline", "forced", ["task", "model", "repetition"], ["correct", "total_cost_usd"], "run_id")


@query(
    "run_summary",
    RUNS_SQL + """SELECT task, mode, count(*) AS n, round(median(total_cost_usd), 6) AS median, round(avg(total_cost_usd), 6) AS mean, round(coalesce(stddev_samp(total_cost_usd), 0), 6) AS stdev,
  round(min(total_cost_usd), 6) AS least, round(max(total_cost_usd), 6) AS most FROM runs WHERE error IS NULL GROUP BY task, mode""",
)
def run_summary(spark, sf_dir):
    out = runs.summary(all_runs(spark, sf_dir), "total_cost_usd", "task", "mode")
    return out.select("task", "mode", "n", *[F.round(c, 6).alias(c) for c in ("median", "mean", "stdev", "least", "most")])


@query("median_run", RUNS_SQL + "SELECT task, mode, run_id FROM (SELECT *, row_number() OVER (PARTITION BY task, mode ORDER BY total_cost_usd, run_id) AS n, count(*) OVER (PARTITION BY task, mode) AS size FROM runs) WHERE n = size // 2 + 1")
def median_run(spark, sf_dir):
    return runs.median_run(all_runs(spark, sf_dir), "total_cost_usd", ["task", "mode"], "run_id").select("task", "mode", "run_id")


@query("median_of_medians", RUNS_SQL + "SELECT mode, round(median(m), 6) AS median_of_medians FROM (SELECT mode, task, median(output_tokens) AS m FROM runs GROUP BY mode, task) GROUP BY mode")
def median_of_medians(spark, sf_dir):
    return runs.median_of_medians(all_runs(spark, sf_dir), "output_tokens", ["mode"], ["task"]).select("mode", F.round("median_of_medians", 6).alias("median_of_medians"))


_WILSON = "(p + z * z / (2 * n)) / (1 + z * z / n)", "z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)"


@query(
    "accuracy",
    RUNS_SQL + f"""SELECT task, mode, n, n_correct, round(100 * p, 6) AS pct, round(100 * greatest(0, {_WILSON[0]} - {_WILSON[1]}), 6) AS low, round(100 * least(1, {_WILSON[0]} + {_WILSON[1]}), 6) AS high
FROM (SELECT *, CAST(n_correct AS DOUBLE) / n AS p, 1.959963984540054 AS z FROM (SELECT task, mode, count(*) AS n, count(*) FILTER (correct) AS n_correct FROM runs GROUP BY task, mode))""",
)
def accuracy(spark, sf_dir):
    out = runs.accuracy(all_runs(spark, sf_dir), "task", "mode")
    return out.select("task", "mode", "n", "n_correct", *[F.round(c, 6).alias(c) for c in ("pct", "low", "high")])


@query("cost_per_correct", RUNS_SQL + "SELECT task, mode, round(sum(total_cost_usd), 6) AS cost, count(*) FILTER (correct) AS n_correct, CASE WHEN count(*) FILTER (correct) = 0 THEN 'inf' ELSE printf('%.5f', sum(total_cost_usd) / count(*) FILTER (correct)) END AS cost_per_correct FROM runs GROUP BY task, mode")
def cost_per_correct(spark, sf_dir):
    out = runs.cost_per_correct(all_runs(spark, sf_dir), "task", "mode")
    label = F.when(F.col("cost_per_correct") == float("inf"), "inf").otherwise(F.format_string("%.5f", "cost_per_correct"))
    return out.select("task", "mode", F.round("cost", 6).alias("cost"), "n_correct", label.alias("cost_per_correct"))


@query("task_deltas", RUNS_SQL + f", {_PAIRS} SELECT task, count(*) AS pairs, round(avg(bc::INT - ac::INT), 6) AS delta FROM p GROUP BY task")
def task_deltas(spark, sf_dir):
    return runs.task_deltas(pairs(spark, sf_dir)).select("task", "pairs", F.round("delta", 6).alias("delta"))


@query("cost_deltas", RUNS_SQL + f", {_PAIRS} SELECT task, round(a, 4) AS a, round(b, 4) AS b, round((b - a) / a, 4) AS delta FROM (SELECT task, sum(acost) / nullif(count(*) FILTER (ac), 0) AS a, sum(bcost) / nullif(count(*) FILTER (bc), 0) AS b FROM p GROUP BY task)")
def cost_deltas(spark, sf_dir):
    return runs.cost_deltas(pairs(spark, sf_dir)).select("task", *[F.round(c, 4).alias(c) for c in ("a", "b", "delta")])


@query("transitions", RUNS_SQL + f", {_PAIRS} SELECT count(*) FILTER (ac AND bc) AS both, count(*) FILTER (ac AND NOT bc) AS lost, count(*) FILTER (NOT ac AND bc) AS gained, count(*) FILTER (NOT ac AND NOT bc) AS neither FROM p")
def transitions(spark, sf_dir):
    return runs.transitions(pairs(spark, sf_dir))


@query(
    "failure_table",
    RUNS_SQL + """, f AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'runner_error' WHEN correctness_reason LIKE 'Missing: %' THEN 'missing_required_literal' WHEN correctness_reason LIKE 'Contains forbidden: %' THEN 'forbidden_literal'
  WHEN correctness_reason LIKE 'Test failed: %' THEN 'test_failed' WHEN correctness_reason = 'No changes in target file' THEN 'missing_edit' ELSE 'grader_failure' END AS kind,
  CASE WHEN error LIKE 'Timeout%' THEN 'timeout' WHEN error LIKE 'budget%' THEN 'budget_exhausted' WHEN error IS NOT NULL THEN error WHEN contains(correctness_reason, ': ') THEN split_part(correctness_reason, ': ', 2)
  WHEN correctness_reason = '' THEN 'unspecified' ELSE correctness_reason END AS detail FROM runs WHERE NOT correct)
SELECT kind, detail, mode, count(*) AS n, string_agg(DISTINCT task, ',' ORDER BY task) AS tasks FROM f GROUP BY kind, detail, mode""",
)
def failure_table(spark, sf_dir):
    return runs.failure_table(all_runs(spark, sf_dir)).withColumn("tasks", F.array_join("tasks", ","))


@query(
    "tool_totals",
    RUNS_SQL + """, e AS (SELECT mode, 'read' AS tool, (output_tokens // 10) % 7 AS n FROM runs UNION ALL SELECT mode, 'search', (output_tokens // 10) % 5 FROM runs)
SELECT tool, mode, CAST(sum(n) AS BIGINT) AS calls, CAST(grouping(mode) AS BIGINT) AS is_total FROM e GROUP BY GROUPING SETS ((tool, mode), (tool))""",
)
def tool_totals(spark, sf_dir):
    return runs.tool_totals(all_runs(spark, sf_dir)).withColumn("is_total", F.col("is_total").cast("long"))


@query(
    "batch_table",
    RUNS_SQL + """, q AS (SELECT mode, output_tokens // 10 AS q FROM runs), e AS (SELECT mode, 'read' AS tool, q % 4 AS n FROM q UNION ALL SELECT mode, 'read', q % 3 FROM q UNION ALL SELECT mode, 'search', q % 2 FROM q)
SELECT mode, tool, count(*) AS calls, count(*) FILTER (n > 1) AS multi, round(count(*) FILTER (n > 1) / count(*), 6) AS share, max(n) AS most FROM e GROUP BY mode, tool""",
)
def batch_table(spark, sf_dir):
    return runs.batch_table(all_runs(spark, sf_dir)).withColumns({"share": F.round("share", 6), "most": F.col("most").cast("long")})


@query(
    "report_tables",
    RUNS_SQL + """SELECT mode, CASE WHEN grouping(task) = 0 THEN 'task' WHEN grouping(model) = 0 THEN 'model' ELSE 'all' END AS level, coalesce(task, model) AS "group", count(*) AS n, count(*) FILTER (correct) AS n_correct, round(sum(total_cost_usd), 5) AS cost
FROM runs GROUP BY GROUPING SETS ((mode), (mode, task), (mode, model))""",
)
def report_tables(spark, sf_dir):
    return runs.report_tables(all_runs(spark, sf_dir), "task", "model").withColumn("cost", F.round("cost", 5))


@query(
    "run_flags",
    RUNS_SQL
    + """, t AS (SELECT quantile_cont(output_tokens, 0.95) AS talk, quantile_cont(num_tool_calls, 0.95) AS storm FROM runs)
SELECT 'token_snowball' AS flag, task, mode, count(*) AS n FROM runs WHERE turns[1] > 0 AND turns[2] > turns[1] AND turns[2] >= turns[1] * 1.1 AND turns[2] > 0 AND turns[3] > turns[2] AND turns[3] >= turns[2] * 1.1 GROUP BY task, mode
UNION ALL SELECT 'talkative_failure', task, mode, count(*) FROM runs, t WHERE NOT correct AND output_tokens > talk GROUP BY task, mode
UNION ALL SELECT 'tool_storm', task, mode, count(*) FROM runs, t WHERE NOT correct AND num_tool_calls > storm GROUP BY task, mode
UNION ALL SELECT 'budget_exhausted', task, mode, count(*) FROM runs WHERE total_cost_usd >= 1 GROUP BY task, mode
UNION ALL SELECT 'timeout', task, mode, count(*) FROM runs WHERE contains(lower(error), 'timeout') GROUP BY task, mode""",
)
def run_flags(spark, sf_dir):
    return runs.flags(all_runs(spark, sf_dir)).groupBy("flag", "task", "mode").agg(F.count("*").alias("n"))


@query(
    "power_readout",
    RUNS_SQL + """, o AS (SELECT mode, count(*) AS n, avg(correct::INT) AS rate FROM runs GROUP BY mode), e AS (SELECT *, least(1, (1.959963984540054 + 0.8416212335729143) * sqrt(rate * (1 - rate) / n)) AS least_effect,
  abs(rate - (SELECT max(rate) FROM o WHERE mode = 'baseline')) AS gap FROM o)
SELECT mode, n, round(rate, 6) AS rate, round(least_effect, 6) AS least_effect, CASE WHEN gap >= least_effect THEN 'detectable' ELSE 'underpowered' END AS verdict FROM e""",
)
def power_readout(spark, sf_dir):
    out = runs.power_readout(all_runs(spark, sf_dir))
    return out.select("mode", "n", F.round("rate", 6).alias("rate"), F.round("least_effect", 6).alias("least_effect"), "verdict")


PRICES = [("m0", 3.0, 6.0, 3.75, 6.0, 0.3, 15.0, None, None), ("m1", 1.25, 1.25, None, None, 0.125, 10.0, None, None), ("m2", 5.0, 6.25, None, None, 0.5, 30.0, 2000, (10.0, 12.5, None, None, 1.0, 45.0))]


@query(
    "cost_breakdown",
    """WITH r AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS run_id, 'm' || (l_suppkey % 3) AS model, l_quantity * 40 AS i, l_quantity * 12 AS c, l_quantity * 4 AS s, l_quantity * 5 AS h, l_quantity * 20 AS d, l_quantity * 9 AS o FROM lineitem),
w AS (SELECT *, i + greatest(c, s + h) + d > 2000 AND model = 'm2' AS long FROM r)
SELECT run_id, round((CASE model WHEN 'm0' THEN greatest(c - s - h, 0) * 6 + s * 3.75 + h * 6 WHEN 'm1' THEN (greatest(c - s - h, 0) + s + h) * 1.25 ELSE (greatest(c - s - h, 0) + s + h) * (CASE WHEN long THEN 12.5 ELSE 6.25 END) END) / 1e6, 9) AS cache_creation_cost,
  round(d * (CASE model WHEN 'm0' THEN 0.3 WHEN 'm1' THEN 0.125 ELSE (CASE WHEN long THEN 1.0 ELSE 0.5 END) END) / 1e6, 9) AS cache_read_cost,
  round(o * (CASE model WHEN 'm0' THEN 15 WHEN 'm1' THEN 10 ELSE (CASE WHEN long THEN 45 ELSE 30 END) END) / 1e6, 9) AS output_cost,
  round(i * (CASE model WHEN 'm0' THEN 3 WHEN 'm1' THEN 1.25 ELSE (CASE WHEN long THEN 10 ELSE 5 END) END) / 1e6, 9) AS input_cost FROM w""",
)
def cost_breakdown(spark, sf_dir):
    q = F.col("l_quantity")
    usage = {"input_tokens": 40, "cache_creation_tokens": 12, "cache_creation_5m_tokens": 4, "cache_creation_1h_tokens": 5, "cache_read_tokens": 20, "output_tokens": 9}
    own = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("run_id"), F.concat(F.lit("m"), (F.col("l_suppkey") % 3).cast("string")).alias("model"), F.lit(None).cast("string").alias("model_alias"),
        *[(q * k).alias(n) for n, k in usage.items()], F.array(F.struct(*[(q * k).cast("long").alias(n) for n, k in usage.items()])).alias("per_turn_token_usage"),
    )
    out = runs.cost_breakdown(own, runs.prices(spark, PRICES), "run_id")
    return out.select("run_id", *[F.round(c, 9).alias(c) for c in ("cache_creation_cost", "cache_read_cost", "output_cost", "input_cost")])


@query(
    "regrade",
    """WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, quality FROM documents JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN (quality = 1) = ok THEN 'same' WHEN ok THEN 'recovered' ELSE 'regressed' END AS change FROM (SELECT *, (contains(lower(text), 'the') OR contains(lower(text), 'und')) AND contains(lower(text), 'an') AS ok FROM d WHERE lang IN ('en', 'de'))""",
)
def regrade(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("lang").alias("task"), F.col("text").alias("result_text"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (F.col("quality") == 1).alias("correct"))
    tasks = spark.createDataFrame([("en", ["The | und", "an"]), ("de", ["the|UND ", "AN"])], "task string, required array<string>")
    marks = runs.graded(own, tasks).select("doc_id", "regrade")  # texts are graded where they are read, and only marks meet labels
    return marks.join(labels, "doc_id").select("doc_id", runs.grade_change().alias("change"))


@query(
    "schedule_faults",
    """WITH r AS (SELECT DISTINCT 't' || (l_partkey % 7) AS task, 'm' || (l_suppkey % 2) AS model, l_orderkey % 30 AS repetition, CASE l_returnflag WHEN 'A' THEN 'a' WHEN 'N' THEN 'b' ELSE 'c' END AS mode FROM lineitem),
b AS (SELECT task, model, repetition, string_agg(mode, '' ORDER BY mode) AS modes FROM r GROUP BY ALL), p AS (SELECT 't' || t AS task, 'm' || m AS model, n AS repetition FROM range(6) x(t), range(2) y(m), range(29) z(n))
SELECT task, model, repetition, CASE WHEN modes IS NULL THEN 'missing' WHEN p.task IS NULL THEN 'unplanned' ELSE 'arms' END AS fault FROM (SELECT *, 1 AS planned FROM p) p FULL JOIN b USING (task, model, repetition) WHERE modes IS NULL OR planned IS NULL OR modes <> 'abc'"""
    .replace("p.task IS NULL", "planned IS NULL"),
)
def schedule_faults(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    own = item.select(
        F.concat(F.lit("t"), (F.col("l_partkey") % 7).cast("string")).alias("task"), F.concat(F.lit("m"), (F.col("l_suppkey") % 2).cast("string")).alias("model"), (F.col("l_orderkey") % 30).alias("repetition"),
        F.when(F.col("l_returnflag") == "A", "a").when(F.col("l_returnflag") == "N", "b").otherwise("c").alias("mode"),
    ).distinct()
    own = own.withColumns({"arm_order": F.array(F.lit("a"), F.lit("b"), F.lit("c")), "arm_order_index": F.ascii("mode") - 97})
    plan = spark.range(6 * 2 * 29).select(F.concat(F.lit("t"), (F.col("id") % 6).cast("string")).alias("task"), F.concat(F.lit("m"), (F.floor(F.col("id") / 6) % 2).cast("string")).alias("model"), F.floor(F.col("id") / 12).alias("repetition"))
    return runs.schedule_faults(own, plan, ["a", "b", "c"])


@query("cost_intervals")
def cost_intervals(spark, sf_dir):
    """Bootstrap intervals of paired cost differences: resampling has no SQL."""
    own = pairs(spark, sf_dir).select("task", (F.col("b_total_cost_usd") - F.col("a_total_cost_usd")).alias("delta"))
    return runs.bootstrap_intervals(own, ["task"], "delta")


@query("ratio_intervals")
def ratio_intervals(spark, sf_dir):
    return runs.ratio_intervals(all_runs(spark, sf_dir), ["mode", "task"], "total_cost_usd", "correct")


_EVENTS = "WITH e AS (SELECT user_id AS session, ts, event_id AS seq, event_type AS tool, CAST(json_extract(props, '$.k') AS VARCHAR) AS item, value FROM events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/events.parquet")
    return own.select(F.col("user_id").alias("session"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("tool"), F.get_json_object("props", "$.k").alias("item"), "value")


@query("session_counters", f"{_EVENTS} SELECT session, tool, count(*) AS calls, count(DISTINCT item) AS items FROM e GROUP BY session, tool")
def session_counters(spark, sf_dir):
    return session.counters(events(spark, sf_dir))


@query("session_favourites", f"{_EVENTS}, c AS (SELECT session, item, count(*) AS n FROM e GROUP BY session, item) SELECT session, item, n, CAST(row_number() OVER (PARTITION BY session ORDER BY n DESC, item) AS INTEGER) AS place FROM c QUALIFY place <= 5")
def session_favourites(spark, sf_dir):
    return session.favourites(events(spark, sf_dir), "item")


@query(
    "session_nudges",
    f"""{_EVENTS}, l AS (SELECT *, lag(tool) OVER w AS t, lag(item) OVER w AS i FROM e WINDOW w AS (PARTITION BY session ORDER BY ts, seq)), n AS (SELECT *, row_number() OVER (PARTITION BY session, tool ORDER BY ts, seq) AS nth FROM l WHERE t = tool AND i <> item)
SELECT session, ts, seq, tool, item, CAST(nth AS INTEGER) AS nth FROM n WHERE nth <= 2""",
)
def session_nudges(spark, sf_dir):
    return session.nudges(events(spark, sf_dir))


@query("session_expansions", f"{_EVENTS}, x AS (SELECT session, seq, tool AS path, seq % 3 AS line, CAST(item AS BIGINT) // 20 AS mtime FROM e) SELECT session, seq, coalesce(lag(mtime) OVER (PARTITION BY session, path, line ORDER BY seq) <> mtime, true) AS shown FROM x")
def session_expansions(spark, sf_dir):
    own = events(spark, sf_dir).select("session", "seq", F.col("tool").alias("path"), (F.col("seq") % 3).alias("line"), F.floor(F.col("item").cast("long") / 20).alias("mtime"))
    return session.first_expansions(own).select("session", "seq", "shown")


@query("session_savings", f"{_EVENTS} SELECT session, CAST(sum(CAST(item AS BIGINT)) AS BIGINT) AS baseline, CAST(sum(greatest(CAST(item AS BIGINT) - seq % 60, 0)) AS BIGINT) AS saved FROM e GROUP BY session")
def session_savings(spark, sf_dir):
    return session.savings(events(spark, sf_dir).select("session", F.col("item").cast("long").alias("baseline"), (F.col("seq") % 60).alias("returned")))


@query(
    "tool_sequences",
    f"""{_EVENTS}, c AS (SELECT session, seq, tool || '(' || CASE WHEN length(a) > 6 THEN left(a, 6) || '...' ELSE a END || ')' AS call FROM (SELECT *, coalesce(item, '') || '/' || seq AS a FROM e))
SELECT session, string_agg(call, ' ' ORDER BY seq) AS sequence FROM c GROUP BY session""",
)
def tool_sequences(spark, sf_dir):
    own = events(spark, sf_dir).select("session", F.col("seq").alias("ord"), "tool", F.concat(F.coalesce("item", F.lit("")), F.lit("/"), F.col("seq").cast("string")).alias("args"))
    return runs.tool_sequence(own, 6).select("session", F.array_join("sequence", " ").alias("sequence"))


@query(
    "manifest_drift",
    RUNS_SQL + """, m(mode, model, task) AS (VALUES ('baseline', 'm0', 't1'), ('mixed', 'm2', 't2')), b AS (SELECT m.mode, 'model' AS "column", m.model AS expected, r.model AS found FROM runs r JOIN m ON r.mode = m.mode
  UNION ALL SELECT m.mode, 'task', m.task, r.task FROM runs r JOIN m ON r.mode = m.mode) SELECT mode, "column", expected, found, count(*) AS n FROM b WHERE found IS DISTINCT FROM expected GROUP BY ALL""",
)
def manifest_drift(spark, sf_dir):
    manifest = spark.createDataFrame([("baseline", "m0", "t1"), ("mixed", "m2", "t2")], "mode string, model string, task string")
    return runs.manifest_drift(all_runs(spark, sf_dir), manifest, ["model", "task"])


@query(
    "known_capabilities",
    RUNS_SQL + """SELECT task, model, CASE WHEN model = 'm1' THEN '{0}' WHEN CAST(task[2:] AS INTEGER) % 2 = 0 THEN '{1}' ELSE 'unknown' END AS capability, count(*) AS n FROM runs GROUP BY ALL""".replace("{0}", sorted(runs.CAPABILITIES)[0]).replace("{1}", sorted(runs.CAPABILITIES)[1]),
)
def known_capabilities(spark, sf_dir):
    first, second = sorted(runs.CAPABILITIES)[:2]
    own = all_runs(spark, sf_dir).withColumn("capability", F.when(F.col("model") == "m1", first).when(F.col("model") == "m2", "no such"))
    registry = spark.createDataFrame([(f"t{k}", second if k % 2 == 0 else "none") for k in range(50)], "task string, capability string")
    return runs.capability(own, registry).groupBy("task", "model", "capability").agg(F.count("*").alias("n"))


@query("model_names", RUNS_SQL + "SELECT CASE model WHEN 'm0' THEN 'large' WHEN 'm1' THEN 'small' ELSE model END AS model, count(*) AS n FROM runs GROUP BY 1")
def model_names(spark, sf_dir):
    return all_runs(spark, sf_dir).groupBy(runs.model_name({"m0": "large", "m1": "small"}).alias("model")).agg(F.count("*").alias("n"))


@query(
    "sparklines",
    RUNS_SQL + """, s AS (SELECT run_id, turns, list_min(turns) AS low, list_max(turns) AS high FROM runs)
SELECT run_id, array_to_string(list_transform(turns, lambda x: (' ▁▂▃▄▅▆▇█')[1 + CASE WHEN high = low THEN 4 ELSE CAST(floor((x - low) / (high - low) * 8) AS INTEGER) END]), '') AS line, CAST(list_sum(turns) AS BIGINT) AS total FROM s""",
)
def sparklines(spark, sf_dir):
    turns = F.col("per_turn_output_tokens")
    return all_runs(spark, sf_dir).select("run_id", runs.sparkline(turns).alias("line"), runs.context_total(turns).alias("total"))


@query("flag_counts", RUNS_SQL + """SELECT 'timeout' AS flag, mode, count(*) AS n FROM runs WHERE contains(lower(error), 'timeout') GROUP BY mode""")
def flag_counts(spark, sf_dir):
    return runs.flag_counts(runs.flags(all_runs(spark, sf_dir)).where("flag = 'timeout'"))


_STREAM = "WITH e AS (SELECT user_id AS session, event_id AS line_no, event_type AS tool, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id % 5 AS way FROM events)"


def stream_rows(spark, sf_dir, make) -> DataFrame:
    own = events(spark, sf_dir).select("session", F.col("seq").alias("line_no"), "tool", F.col("item").cast("long").alias("k"), (F.col("seq") % 5).alias("way"))
    return own.select("session", "line_no", make(F.col("tool"), F.col("k"), F.col("way"), F.col("line_no")).alias("text"))


def _message(tool, k, way, n):
    call = F.format_string('{"type":"tool_use","id":"c%d","name":"%s","input":{}}', F.floor(n / 2), tool)
    said = F.format_string('{"type":"assistant","message":{"id":"m%d","usage":{"input_tokens":%d,"output_tokens":7},"content":[%s]}}', F.floor(n / 3), k, call)
    return F.when(way == 4, F.format_string('{"type":"result","subtype":"limit","error":"stopped at %d"}', k)).when(way == 3, F.lit("  ")).otherwise(said)


@query(
    "message_turns",
    f"""{_STREAM}, t AS (SELECT session, line_no // 3 AS id, min(line_no) AS line_no, arg_max(k, line_no) AS input_tokens FROM e WHERE way < 3 GROUP BY ALL)
SELECT session, CAST(row_number() OVER (PARTITION BY session ORDER BY line_no) AS INTEGER) AS turn, line_no, input_tokens, CAST(7 AS BIGINT) AS output_tokens FROM t""",
)
def message_turns(spark, sf_dir):
    return corpus.agent_turns(corpus.agent_events(stream_rows(spark, sf_dir, _message))).select("session", "turn", "line_no", "input_tokens", "output_tokens")


@query("message_calls", f"{_STREAM} SELECT session, 'c' || line_no // 2 AS call_id, arg_min(tool, line_no) AS tool, min(line_no) AS line_no FROM e WHERE way < 3 GROUP BY session, line_no // 2")
def message_calls(spark, sf_dir):
    return corpus.agent_tool_calls(corpus.agent_events(stream_rows(spark, sf_dir, _message))).select("session", "call_id", "tool", "line_no")


@query("last_errors", f"{_STREAM} SELECT session, 'limit: stopped at ' || arg_max(k, line_no) AS error FROM e WHERE way = 4 GROUP BY session")
def last_errors(spark, sf_dir):
    return corpus.stream_errors(corpus.agent_events(stream_rows(spark, sf_dir, _message)))


def _item(tool, k, way, n):
    use = F.format_string('{"type":"turn.completed","usage":{"input_tokens":%d,"cached_input_tokens":10,"output_tokens":3}}', k)
    item = F.format_string('{"type":"item.completed","item":{"type":"mcp_tool_call","id":"i%d","tool":"%s"}}', n, tool)
    return F.when(way == 0, '{"type":"turn.started"}').when(way == 4, use).otherwise(item)


_ITEMS = f"{_STREAM}, n AS (SELECT *, count(*) FILTER (way = 0) OVER w AS turn, count(*) FILTER (way = 4) OVER w AS ended FROM e WINDOW w AS (PARTITION BY session ORDER BY line_no))"


@query(
    "item_turns",
    f"""{_ITEMS} SELECT t.session, t.turn, coalesce(greatest(u.k - 10, 0), 0) AS input_tokens, CASE WHEN u.k IS NULL THEN 0 ELSE 3 END AS output_tokens, CASE WHEN u.k IS NULL THEN 0 ELSE 10 END AS cache_read_tokens
FROM (SELECT session, turn FROM n WHERE way = 0) t LEFT JOIN (SELECT session, ended AS turn, k FROM n WHERE way = 4) u USING (session, turn)""",
)
def item_turns(spark, sf_dir):
    return corpus.item_stream(stream_rows(spark, sf_dir, _item))[0].select("session", "turn", "input_tokens", "output_tokens", "cache_read_tokens")


@query("item_calls", f"{_ITEMS} SELECT session, turn, 'i' || line_no AS call_id, tool FROM n WHERE way IN (1, 2, 3) AND turn > 0")
def item_calls(spark, sf_dir):
    return corpus.item_stream(stream_rows(spark, sf_dir, _item))[1].select("session", "turn", "call_id", "tool")


def _part(tool, k, way, n):
    done = F.format_string('{"type":"step_finish","part":{"cost":0.25,"tokens":{"input":%d,"output":2}}}', k)
    return F.when(way == 4, done).otherwise(F.format_string('{"type":"tool_use","part":{"tool":"own_own_%s","callID":"p%d"}}', tool, n))


_PARTS = f"{_STREAM}, n AS (SELECT *, 1 + coalesce(count(*) FILTER (way = 4) OVER (PARTITION BY session ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn, count(*) FILTER (way = 4) OVER (PARTITION BY session) AS turns FROM e)"


@query("step_turns", f"{_PARTS} SELECT session, turn, k AS input_tokens, CAST(2 AS BIGINT) AS output_tokens, 0.25 AS cost FROM n WHERE way = 4")
def step_turns(spark, sf_dir):
    return corpus.part_stream(stream_rows(spark, sf_dir, _part))[0].select("session", "turn", "input_tokens", "output_tokens", "cost")


@query("step_calls", f"{_PARTS} SELECT session, turn, 'p' || line_no AS call_id, 'own_' || tool AS tool FROM n WHERE way < 4 AND turn <= turns")
def step_calls(spark, sf_dir):
    return corpus.part_stream(stream_rows(spark, sf_dir, _part))[1].select("session", "turn", "call_id", "tool")
