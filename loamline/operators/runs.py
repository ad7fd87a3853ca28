"""Statistics of run records: summaries, intervals, paired comparisons, flags, failures, costs and schedules."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamline.operators import ranks

Z, Z_POWER = 1.959963984540054, 0.8416212335729143
RESAMPLES, SEED = 10_000, 0
GROWTH, BUDGET_USD = 1.10, 1.00
# Prefixes of grading reasons with the failure that each names, and what an arm is called in order.
REASONS = {"Missing: ": "missing_required_literal", "Contains forbidden: ": "forbidden_literal", "Diff missing: ": "diff_missing_literal", "Test failed: ": "test_failed"}
REFERENCE_ARMS = ["baseline"]
CAPABILITIES = ["locate", "trace", "fix", "debug", "control"]


def good(runs: DataFrame) -> DataFrame:
    """Runs without an error."""
    return runs.where(F.col("error").isNull())


def summary(runs: DataFrame, metric: str, *keys: str) -> DataFrame:
    """Median, mean, sample deviation (0 for one run), least and most of a metric for each group; zeros for no values."""
    own = good(runs) if "error" in runs.columns else runs
    value = F.col(metric).cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    each = own.groupBy(*keys).agg(
        F.count(value).alias("n"), zero(F.avg(value)).alias("mean"), zero(F.stddev_samp(value)).alias("stdev"), zero(F.min(value)).alias("least"), zero(F.max(value)).alias("most"),
    )
    middle = ranks.medians(own, list(keys), value, "median").select(*[F.col(k).alias(f"_{k}") for k in keys], "median")
    same = F.lit(True)
    for k in keys:
        same = same & each[k].eqNullSafe(middle[f"_{k}"])
    return each.join(middle, same, "left").select(*keys, "n", zero(F.col("median")).alias("median"), "mean", "stdev", "least", "most")


def median_run(runs: DataFrame, metric: str, keys: list[str], tie: str) -> DataFrame:
    """The run in the middle of each group by a metric, a missing one as 0; of an even number, the upper one."""
    return ranks.middle_rows(runs, keys, F.coalesce(metric, F.lit(0)), tie)


def median_of_medians(runs: DataFrame, metric: str, outer: list[str], inner: list[str]) -> DataFrame:
    each = ranks.medians(runs, [*outer, *inner], F.col(metric), "m")
    return ranks.medians(each, outer, F.col("m"), "median_of_medians")


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """Wilson interval of a proportion; (0, 1) for no trials."""
    n, zz = F.nullif(n.cast("double"), F.lit(0.0)), Z * Z
    p = successes / n
    middle = (p + zz / (2 * n)) / (1 + zz / n)
    half = F.lit(Z) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.coalesce(F.greatest(F.lit(0.0), middle - half), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), middle + half), F.lit(1.0))


def accuracy(runs: DataFrame, *keys: str) -> DataFrame:
    """Runs, correct runs, and the share of these with its interval, in percent."""
    own = runs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"))
    low, high = wilson(F.col("n_correct"), F.col("n"))
    pct = lambda c: 100 * c
    return own.select(*keys, "n", "n_correct", pct(F.coalesce(F.col("n_correct") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))).alias("pct"), pct(low).alias("low"), pct(high).alias("high"))


def cost_per_correct(runs: DataFrame, *keys: str, drop_costless: bool = False) -> DataFrame:
    """Sum of costs over the number of correct runs, infinite without any; a missing cost is 0, or leaves its run out."""
    own = runs.where(F.col("total_cost_usd").isNotNull()) if drop_costless else runs
    cost, correct = F.sum(F.coalesce("total_cost_usd", F.lit(0.0))), F.count_if("correct")
    return own.groupBy(*keys).agg(F.coalesce(cost, F.lit(0.0)).alias("cost"), correct.alias("n_correct"), F.when(correct == 0, float("inf")).otherwise(cost / correct).alias("cost_per_correct"))


def minimum_effect(n: Column, rate: Column) -> Column:
    """Least gap in a share that a two-sided test at 5 % finds with 80 % power."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), rate))
    return F.when(n <= 0, 1.0).otherwise(F.least(F.lit(1.0), (Z + Z_POWER) * F.sqrt(p * (1 - p) / n)))


def bootstrap(values: np.ndarray, statistic: str = "mean", resamples: int = RESAMPLES, seed: int = SEED) -> tuple[float, float]:
    """Percentile interval of a mean or median: (0, 0) for nothing, the point for one value or equal ones."""
    if statistic not in ("mean", "median"):
        raise ValueError(f"unknown statistic {statistic!r}")
    x = np.sort(np.asarray(values, float))
    if not len(x):
        return 0.0, 0.0
    if len(x) < 2 or x[0] == x[-1]:
        point = float(getattr(np, statistic)(x))
        return point, point
    return _interval(len(x), lambda index: getattr(np, statistic)(x[index], axis=1), resamples, seed)


def ratio_bootstrap(over: np.ndarray, under: np.ndarray, resamples: int = RESAMPLES, seed: int = SEED) -> tuple[float, float]:
    """Percentile interval of a ratio of sums over pairs: infinite where the sum below is 0, the point for one pair.

    Equal pairs are counted, and samples are drawn as counts of the different ones."""
    pairs = np.stack([np.asarray(over, float), np.asarray(under, float)], axis=1)
    top, bottom = pairs.sum(axis=0) if len(pairs) else (0.0, 0.0)
    if not bottom:
        return float("inf"), float("inf")
    if len(pairs) == 1:
        return float(top / bottom), float(top / bottom)
    different, counts = np.unique(pairs, axis=0, return_counts=True)
    sums = ranks.weighted_sums(different, counts.astype(float), np.full(resamples, len(pairs)), np.random.default_rng(seed))
    ratios = np.full(resamples, np.inf)
    np.divide(sums[:, 0], sums[:, 1], out=ratios, where=sums[:, 1] > 0)
    low, high = np.percentile(ratios, [2.5, 97.5], method="lower" if np.isinf(ratios).any() else "linear")
    return float(low), float(high)


def _interval(n: int, statistic, resamples: int, seed: int) -> tuple[float, float]:
    """2.5 % and 97.5 % of a statistic over resamples, drawn in steps of bounded size."""
    rng, out, step = np.random.default_rng(seed), [], max(1, 2_000_000 // n)
    for first in range(0, resamples, step):
        out.append(statistic(rng.integers(0, n, (min(step, resamples - first), n))))
    low, high = np.percentile(np.concatenate(out), [2.5, 97.5])
    return float(low), float(high)


def bootstrap_intervals(rows: DataFrame, keys: list[str], value: str, statistic: str = "mean") -> DataFrame:
    """(keys, n, low, high) of each group's values, of cells of any size for a mean; for a median one cell's values go to one task."""
    own = rows.select(*keys, F.col(value).cast("double").alias(value))
    if statistic == "mean":
        held = own.where(F.col(value).isNotNull())
        each = own.groupBy(*keys).agg(F.count(value).alias("n"), F.coalesce(F.avg(value), F.lit(0.0)).alias("_point"), F.coalesce(F.max(value) > F.min(value), F.lit(False)).alias("_spread"))
        drawn = ranks.resampled_sums(ranks._beside(held, each.where("_spread").select(*keys, "n"), keys), keys, [value, "n"], RESAMPLES, SEED)
        # n is summed over as many rows as there are, so that its sum is n squared
        found = ranks.intervals(drawn, keys, lambda: F.col(value) / F.sqrt("n"))
        return _or_point(each, found, keys).select(*keys, "n", "low", "high")
    schema = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys) + ", n long, low double, high double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf[value].dropna().to_numpy()
        low, high = bootstrap(values, statistic)
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), len(values), low, high]], columns=[*keys, "n", "low", "high"])

    return own.groupBy(*keys).applyInPandas(run, schema)


def _or_point(each: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``each`` with the interval of its keys, or its ``_point`` at both ends where none was drawn."""
    own = found.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("low").alias("_low"), F.col("high").alias("_high"))
    out = each.join(own, ranks._same(each, own, keys), "left")
    return out.withColumns({"low": F.coalesce("_low", "_point"), "high": F.coalesce("_high", "_point")})


def ratio_intervals(rows: DataFrame, keys: list[str], over: str, under: str) -> DataFrame:
    """(keys, value, low, high) of each group's ratio of sums: infinite where the sum below is 0, the point for one row."""
    own = rows.select(*keys, F.coalesce(F.col(over).cast("double"), F.lit(0.0)).alias("_over"), F.coalesce(F.col(under).cast("double"), F.lit(0.0)).alias("_under"))
    ratio = lambda a, b: F.when(b > 0, a / F.nullif(b, F.lit(0.0))).otherwise(float("inf"))
    top, bottom = F.sum("_over"), F.sum("_under")
    each = own.groupBy(*keys).agg(F.when(bottom == 0, float("inf")).otherwise(top / F.nullif(bottom, F.lit(0.0))).alias("_point"), ((F.count("*") > 1) & (bottom != 0)).alias("_spread"))
    drawn = ranks.resampled_sums(own, keys, ["_over", "_under"], RESAMPLES, SEED, cells=each.where("_spread").select(*keys))
    found = ranks.intervals(drawn, keys, lambda: ratio(F.col("_over"), F.col("_under")))
    return _or_point(each, found, keys).select(*keys, F.col("_point").alias("value"), "low", "high")


def paired(runs: DataFrame, first: str, second: str, keys: list[str], values: list[str], line: str) -> DataFrame:
    """(keys, a_*, b_*) of cells that both modes have; of repeated cells the last line counts.

    The modes are aggregated side by side, so pairing costs one shuffle and no join."""
    own = runs.where(F.col("mode").isin(first, second))
    each = [F.max_by(F.when(F.col("mode") == m, F.col(v)), F.when(F.col("mode") == m, F.col(line))).alias(f"{side}_{v}") for side, m in (("a", first), ("b", second)) for v in values]
    have = [F.max(F.col("mode") == m).alias(f"_{side}") for side, m in (("a", first), ("b", second))]
    return own.groupBy(*keys).agg(*each, *have).where("_a AND _b").drop("_a", "_b")


def task_deltas(pairs: DataFrame, task: str = "task") -> DataFrame:
    """(task, pairs, delta): mean of b_correct - a_correct in each task, so that tasks weigh alike."""
    each = F.col("b_correct").cast("int") - F.col("a_correct").cast("int")
    return pairs.groupBy(task).agg(F.count("*").alias("pairs"), F.avg(each).alias("delta"))


def cost_deltas(pairs: DataFrame, task: str = "task") -> DataFrame:
    """(task, a, b, delta): costs per correct run and their relative difference, null where either has none correct."""
    side = lambda s: F.sum(f"{s}_total_cost_usd") / F.nullif(F.count_if(F.col(f"{s}_correct")), F.lit(0))
    own = pairs.groupBy(task).agg(side("a").alias("a"), side("b").alias("b"))
    return own.withColumn("delta", (F.col("b") - F.col("a")) / F.nullif(F.col("a"), F.lit(0.0)))


def transitions(pairs: DataFrame) -> DataFrame:
    """One row: pairs in which both, the first, the second or neither is correct."""
    a, b = F.col("a_correct"), F.col("b_correct")
    return pairs.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("lost"), F.count_if(~a & b).alias("gained"), F.count_if(~a & ~b).alias("neither"))


def failure(runs: DataFrame) -> DataFrame:
    """Runs that failed with (kind, detail): the error first, then the grading reason."""
    error, reason = F.nullif(F.col("error"), F.lit("")), F.coalesce(F.nullif(F.col("correctness_reason"), F.lit("")), F.lit("unspecified"))
    low = F.lower(error)
    kind, detail = F.lit("grader_failure"), reason
    kind, detail = F.when(reason == "No changes in target file", "missing_edit").otherwise(kind), detail
    for prefix, name in REASONS.items():
        kind, detail = F.when(reason.startswith(prefix), name).otherwise(kind), F.when(reason.startswith(prefix), F.substr(reason, F.lit(len(prefix) + 1))).otherwise(detail)
    told = F.when(low.contains("timeout"), "timeout").when(low.contains("budget"), "budget_exhausted").otherwise(error)
    failed = runs.where(~F.coalesce("correct", F.lit(False)))
    return failed.withColumns({"kind": F.when(error.isNotNull(), "runner_error").otherwise(kind), "detail": F.when(error.isNotNull(), told).otherwise(detail)})


def failure_table(runs: DataFrame) -> DataFrame:
    """(kind, detail, mode, n, tasks) of failures."""
    return failure(runs).groupBy("kind", "detail", "mode").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("task")).alias("tasks"))


def tool_totals(runs: DataFrame) -> DataFrame:
    """(tool, mode, calls); a null mode has the total of all."""
    each = runs.select("mode", F.explode("tool_calls").alias("tool", "n"))
    return each.groupingSets([["tool", "mode"], ["tool"]], "tool", "mode").agg(F.sum("n").alias("calls"), F.grouping("mode").alias("is_total"))


def batch_table(runs: DataFrame) -> DataFrame:
    """(mode, tool, calls, multi, share, most) of batch sizes."""
    each = runs.select("mode", F.explode("batch_sizes").alias("tool", "sizes")).select("mode", "tool", F.explode("sizes").alias("n"))
    multi = F.count_if(F.col("n") > 1)
    return each.groupBy("mode", "tool").agg(F.count("*").alias("calls"), multi.alias("multi"), (multi / F.count("*")).alias("share"), F.max("n").alias("most"))


def report_tables(runs: DataFrame, *dimensions: str) -> DataFrame:
    """Accuracy and cost for each mode by each dimension alone and in all, in one pass: ``level`` names the dimension."""
    sets = [["mode"], *[["mode", d] for d in dimensions]]
    own = runs.groupingSets(sets, "mode", *dimensions).agg(
        F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), F.sum(F.coalesce("total_cost_usd", F.lit(0.0))).alias("cost"),
        *[F.grouping(d).alias(f"_{d}") for d in dimensions],
    )
    level, group = F.lit("all"), F.lit(None).cast("string")
    for d in dimensions:
        level, group = F.when(F.col(f"_{d}") == 0, d).otherwise(level), F.when(F.col(f"_{d}") == 0, F.col(d).cast("string")).otherwise(group)
    return own.select("mode", level.alias("level"), group.alias("group"), "n", "n_correct", "cost")


def capability(runs: DataFrame, registry: DataFrame) -> DataFrame:
    """Runs with a known capability: their own, else that of the task in ``registry`` (task, capability), else unknown."""
    known = registry.select("task", F.col("capability").alias("_registered"))
    valid = lambda c: F.when(F.col(c).isin(CAPABILITIES), F.col(c))
    return runs.join(known, "task", "left").withColumn("capability", F.coalesce(valid("capability"), valid("_registered"), F.lit("unknown"))).drop("_registered")


def power_readout(runs: DataFrame, key: str = "mode") -> DataFrame:
    """(mode, n, rate, least_effect, verdict): whether the gap to the reference arm is more than what n runs can show."""
    own = runs.groupBy(key).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("int")).alias("rate"))
    base = own.where(F.col(key).isin(REFERENCE_ARMS)).agg(F.max("rate")).scalar()
    out = own.withColumns({"least_effect": minimum_effect(F.col("n"), F.col("rate")), "gap": F.abs(F.col("rate") - base)})
    return out.withColumn("verdict", F.when(F.col("gap").isNull(), "no reference").when(F.col("gap") >= F.col("least_effect"), "detectable").otherwise("underpowered"))


def tool_count(runs: DataFrame) -> Column:
    total = F.aggregate(F.map_values("tool_calls"), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.coalesce("num_tool_calls", total)


def is_snowball(turns: Column) -> Column:
    """Each turn's tokens are at least 10 % over the one before; two turns or more, all but the last above 0."""
    pairs = F.arrays_zip(F.slice(turns, F.lit(1), F.size(turns) - 1).alias("a"), F.slice(turns, F.lit(2), F.size(turns) - 1).alias("b"))
    return (F.size(turns) >= 2) & F.coalesce(F.forall(pairs, lambda p: (p["a"] > 0) & (p["b"] > p["a"]) & (p["b"] >= p["a"] * GROWTH)), F.lit(False))


def percentiles_of(rows: DataFrame, columns: list[str], share: float) -> list[Column]:
    """Exact percentiles of columns as scalar subqueries of one scan: equal values are counted where they are, and only different ones come together."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("double").alias("v")) for k, c in enumerate(columns)]))
    counted = rows.select(each.alias("x")).where("x.v IS NOT NULL").groupBy("x.k", "x.v").agg(F.count("*").alias("n"))
    of = lambda k: F.percentile(F.when(F.col("k") == k, F.col("v")), share, F.col("n"))
    one = counted.agg(F.struct(*[of(k).alias(f"p{k}") for k in range(len(columns))]).alias("p")).scalar()
    return [one[f"p{k}"] for k in range(len(columns))]


def flags(runs: DataFrame) -> DataFrame:
    """(flag, task, model, repetition, mode, measured): runs that grow turn by turn, talk or call much and fail, use up the budget, or time out.

    Thresholds are 95th percentiles over all runs; the flags of a run come from one pass."""
    own = runs.withColumn("_tools", tool_count(runs).cast("double"))
    talk, storm = percentiles_of(own, ["output_tokens", "_tools"], 0.95)
    wrong = ~F.coalesce("correct", F.lit(False))
    no = lambda c: F.coalesce(c, F.lit(False))
    rules = [
        ("token_snowball", no(is_snowball(F.col("per_turn_output_tokens"))), F.size("per_turn_output_tokens")),
        ("talkative_failure", no(wrong & (F.col("output_tokens") > talk)), F.col("output_tokens")),
        ("tool_storm", no(wrong & (F.col("_tools") > storm)), F.col("_tools")),
        ("budget_exhausted", no(F.col("total_cost_usd") >= BUDGET_USD), F.col("total_cost_usd")),
        ("timeout", no(F.lower("error").contains("timeout")), F.lit(None)),
    ]
    each = F.array(*[F.struct(F.lit(n).alias("flag"), t.alias("is"), v.cast("double").alias("measured")) for n, t, v in rules])
    out = own.select("task", F.coalesce("model", "model_alias").alias("model"), "repetition", "mode", F.explode(each).alias("f")).where("f.is")
    return out.select("f.flag", "task", "model", "repetition", "mode", "f.measured")


def flag_counts(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("flag", "mode").agg(F.count("*").alias("n"))


def usage_cost(u, rates, prefix: str = "") -> dict[str, Column]:
    """Costs of one usage by category, in dollars: cache writes by their tier, all by the long-context rates above the threshold."""
    get = lambda name: F.coalesce(u(name), F.lit(0)).cast("double")
    fresh, made, short, hour, read, out = (get(n) for n in ("input_tokens", "cache_creation_tokens", "cache_creation_5m_tokens", "cache_creation_1h_tokens", "cache_read_tokens", "output_tokens"))
    context = fresh + F.greatest(made, short + hour) + read
    is_long = F.coalesce(context > F.col("long_context_threshold"), F.lit(False))
    rate = lambda name: F.when(is_long, F.coalesce(F.col(f"long_context.{name}"), F.lit(0.0))).otherwise(F.coalesce(F.col(name), F.lit(0.0)))
    tier = lambda name: F.when(is_long, F.coalesce(F.col(f"long_context.{name}"), F.col("long_context.cache_creation"), F.lit(0.0))).otherwise(F.coalesce(F.col(name), F.col("cache_creation"), F.lit(0.0)))
    writes = F.greatest(made - short - hour, F.lit(0.0)) * rate("cache_creation") + short * tier("cache_creation_5m") + hour * tier("cache_creation_1h")
    return {"cache_creation_cost": writes / 1e6, "cache_read_cost": read * rate("cache_read") / 1e6, "output_cost": out * rate("output") / 1e6, "input_cost": fresh * rate("input") / 1e6}


PRICES = (
    "model string, input double, cache_creation double, cache_creation_5m double, cache_creation_1h double, cache_read double, output double, "
    "long_context_threshold long, long_context struct<input:double,cache_creation:double,cache_creation_5m:double,cache_creation_1h:double,cache_read:double,output:double>"
)


def cost_breakdown(runs: DataFrame, prices: DataFrame, run_id: str) -> DataFrame:
    """(run_id, costs by category); turn by turn where the model's rate depends on the context. Models without a price have nulls."""
    rated = runs.withColumn("model", F.coalesce("model", "model_alias")).join(F.broadcast(prices.withColumnRenamed("input", "input")), "model", "left")  # a price list of at most some hundred models
    whole = rated.where("long_context_threshold IS NULL OR per_turn_token_usage IS NULL")
    turns = rated.where("long_context_threshold IS NOT NULL AND per_turn_token_usage IS NOT NULL")
    first = whole.select(run_id, *[c.alias(n) for n, c in usage_cost(F.col, None).items()])
    second = turns.select(run_id, *[F.col(f) for f in prices.columns if f != "model"], F.explode("per_turn_token_usage").alias("u"))
    second = second.select(run_id, *[c.alias(n) for n, c in usage_cost(lambda n: F.col(f"u.{n}"), None).items()]).groupBy(run_id).agg(*[F.sum(n).alias(n) for n in ("cache_creation_cost", "cache_read_cost", "output_cost", "input_cost")])
    return first.unionByName(second)


def graded(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Text-graded runs with ``regrade``: every required literal of ``tasks``, a stated list, is there, each with ``|`` between alternatives.

    Every task has the list, so texts stay where they are."""
    low = F.lower(F.coalesce("result_text", F.lit("")))
    passes = F.forall("required", lambda r: F.exists(F.split(r, r"\|"), lambda a: F.contains(low, F.lower(F.trim(a)))))
    return runs.join(F.broadcast(tasks.select("task", "required")), "task").withColumn("regrade", passes).drop("required")


def grade_change() -> Column:
    """What a new grade, ``regrade``, is to the one before, ``correct``."""
    was = F.coalesce("correct", F.lit(False))
    return F.when(was == F.col("regrade"), "same").when(F.col("regrade"), "recovered").otherwise("regressed")


def regraded(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Text-graded runs with ``regrade`` (see ``graded``) and what has changed."""
    return graded(runs, tasks).withColumn("change", grade_change())


def schedule_faults(runs: DataFrame, plan: DataFrame, arms: list[str]) -> DataFrame:
    """(task, model, repetition, fault) where a block of ``plan`` is missing, unplanned, or has not each arm once in order."""
    keys = ["task", "model", "repetition"]
    blocks = runs.groupBy(*keys).agg(F.array_sort(F.collect_list("mode")).alias("modes"), F.count_if(F.col("arm_order")[F.col("arm_order_index")] != F.col("mode")).alias("moved"), F.countDistinct("arm_order").alias("orders"))
    both = plan.select(*keys, F.lit(True).alias("planned")).distinct().join(blocks, keys, "full")
    expected = F.array(*[F.lit(a) for a in sorted(arms)])
    fault = (
        F.when(F.col("modes").isNull(), "missing").when(F.col("planned").isNull(), "unplanned").when(F.col("modes") != expected, "arms")
        .when((F.col("moved") > 0) | (F.col("orders") > 1), "order")
    )
    return both.select(*keys, fault.alias("fault")).where("fault IS NOT NULL")


def planned_cells(tasks: int, models: int, arms: int, repetitions: int, ceiling: int | None = None) -> int:
    cells = tasks * models * arms * repetitions
    if ceiling is not None and cells > ceiling:
        raise ValueError(f"{cells} planned runs are more than {ceiling}")
    return cells


def model_name(aliases: dict[str, str], column: str = "model") -> Column:
    """A model's name by its alias."""
    if not aliases:
        return F.col(column)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in sorted(aliases.items()) for x in p]), F.col(column)), F.col(column))


def comparison_pairs(modes: list[str]) -> list[tuple[str, str]]:
    """(mode, reference) of each mode but the reference: the first known reference arm, else the first mode."""
    reference = next((m for m in REFERENCE_ARMS if m in modes), modes[0] if modes else None)
    return [(m, reference) for m in modes if m != reference]


def sparkline(values: Column) -> Column:
    """Nine heights of a series, scaled to its range."""
    glyphs = F.array(*[F.lit(g) for g in " ▁▂▃▄▅▆▇█"])
    low, high = F.array_min(values), F.array_max(values)
    level = lambda x: F.when(high == low, 4).otherwise(F.floor((x - low) / (high - low) * 8)).cast("int")
    return F.array_join(F.transform(values, lambda x: F.element_at(glyphs, level(x) + 1)), "")


def delta_label(old: Column, new: Column) -> Column:
    return F.when(old == 0, "n/a").otherwise(F.format_string("%+.0f%%", (new - old) / old * 100))


def prices(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, PRICES)


def tool_sequence(calls: DataFrame, most: int = 80) -> DataFrame:
    """(session, sequence): a session's calls (session, ord, tool, args) in order, arguments cut to ``most`` characters."""
    short = F.when(F.length("args") > most, F.concat(F.left("args", F.lit(most)), F.lit("..."))).otherwise(F.coalesce("args", F.lit("")))
    each = F.sort_array(F.collect_list(F.struct("ord", F.concat("tool", F.lit("("), short, F.lit(")")).alias("call"))))
    return calls.groupBy("session").agg(F.transform(each, lambda x: x["call"]).alias("sequence"))


def context_total(turns: Column) -> Column:
    """Tokens of context over all turns."""
    return F.aggregate(F.coalesce(turns, F.array().cast("array<long>")), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))


def stale_prices(as_of: str, today: Column, days: int = 30) -> Column:
    """A warning where a price list is older than ``days``."""
    age = F.datediff(today, F.lit(as_of).cast("date"))
    return F.when(age > days, F.format_string(f"prices of {as_of} are %d days old", age))


def manifest_drift(runs: DataFrame, manifest: DataFrame, columns: list[str]) -> DataFrame:
    """(mode, column, expected, found, n): values of runs that are not those which the manifest (mode, columns) has for their mode.

    Runs are counted by value before they meet the manifest, a stated list: a mode's runs never come together in one task."""
    each = lambda side: F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c).cast("string") for c in columns]))).alias("column", side)
    counted = runs.groupBy("mode", *columns).agg(F.count("*").alias("n")).select("mode", "n", each("found"))
    both = counted.join(F.broadcast(manifest.select("mode", each("expected"))), ["mode", "column"])
    return both.where(~F.col("found").eqNullSafe(F.col("expected"))).groupBy("mode", "column", "expected", "found").agg(F.sum("n").alias("n"))
