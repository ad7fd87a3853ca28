"""What lets the code queries grow: work dealt over cores, nothing broadcast that grows, and no squares of a folder's files."""

import pytest
from pyspark.sql import functions as F

from loamline.operators import graph
from loamline.plans import code_queries, form_queries
from loamline.sources import extract

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("files", [code_queries.code_files, form_queries.form_files])
def test_files_of_few_bytes_are_dealt_over_cores(spark, files):
    """The table is one small file with one row group, which one task would read and extract alone."""
    own = files(spark, FOLDER)
    sizes = own.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == max(4, spark.sparkContext.defaultParallelism) and own.count() == 200


@pytest.mark.parametrize("name", ["code_definitions", "project_summary", "patch_symbols", "form_imports", "form_calls", "form_definitions"])
def test_no_filter_is_carried_before_the_deal(spark, name):
    """The task or two that read the small table would make every path and content, to see whether they are wanted."""
    frame = (code_queries.QUERIES | form_queries.QUERIES)[name](spark, FOLDER)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    before = [part.split("FileScan")[0] for part in plan.split("REPARTITION_BY_NUM")[1:]]
    assert before and not any("Filter" in part for part in before)


@pytest.mark.parametrize(("name", "piece"), [("form_imports", "macro_rules!"), ("form_calls", "macro_rules!"), ("code_definitions", "self.cost(x)"), ("equal_parts", "// again")])
def test_contents_are_made_once(spark, name, piece):
    """A filter on them is evaluated before the projection that makes them, and makes them once more."""
    plan = (code_queries.QUERIES | form_queries.QUERIES)[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(piece) == plan.count("MapInArrow")


def test_files_without_code_or_content_have_no_rows(spark):
    files = spark.createDataFrame([("a.py", "import os"), ("b.py", None), ("c.txt", "import os"), ("d", "import os"), (None, "import os"), ("e.go", "")], "path string, content string")
    assert [r["path"] for r in extract.code_rows(files).collect()] == ["a.py"] and extract.equal_parts(files).count() == 0


@pytest.mark.parametrize("name", ["project_summary", "usage_groups", "definition_search", "import_targets", "external_modules", "call_scopes", "outline_context", "caller_impact"])
def test_rows_seen_from_several_sides_are_extracted_once(spark, name):
    plan = code_queries.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan


def test_only_what_is_asked_for(spark):
    files = spark.createDataFrame([("a.py", "import os\ndef f():\n    g()\n"), ("b.go", "package b\nimport \"fmt\"\nfunc F() { g() }\n")], "path string, content string")
    whole, shape = extract.code_rows(files), F.col("shape")
    for row in ("symbol", "import", "call"):
        own = extract.code_rows(files, [row], shapes=False)
        assert own.drop("shape").collect() == whole.where(F.col("row") == row).drop("shape").collect() and own.where(shape.isNotNull()).isEmpty()
    assert whole.where("row = 'symbol'").where(shape.isNull()).isEmpty()


GROWING = "changed_callers changes_of_term expanded_definitions symbol_changes symbol_moves call_chain lookup_outcomes outline_context call_scopes definition_search callee_targets".split()


@pytest.mark.parametrize("name", GROWING)
def test_no_side_that_grows_is_broadcast(spark, name):
    """Sizes of extracted rows are guessed at a fraction of what they are, so a threshold does not keep them from the driver."""
    frame = code_queries.QUERIES[name](spark, FOLDER)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


@pytest.mark.parametrize("name", ["caller_impact", "callers"])
def test_calls_meet_the_few_names_where_they_are(spark, name):
    """Of two sides of unknown size the calls can be taken for the smaller, and pass whole through the driver."""
    from loamline.plans import corpus_queries

    plan = (corpus_queries.QUERIES | code_queries.QUERIES)[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan


def test_second_hop_of_few_and_of_many_callers(spark):
    def hop(n):
        rows = [(f"a{k:02}", 1, "goal", f"f{k}") for k in range(n)] + [("b", 2, "f1", "g"), ("b", 9, "f0", "g"), ("a00", 1, "f1", "f0"), ("c", 3, "f1", None), ("d", 4, "other", "h")]
        calls = spark.createDataFrame(rows, "path string, line int, callee string, caller string").withColumn("owner", F.lit(None).cast("string"))
        hits = graph.callers(calls, spark.createDataFrame([(1, "goal")], "ord int, target string"))
        own = graph.second_hop(calls, hits)
        assert "BuildLeft" not in own._jdf.queryExecution().executedPlan().toString()
        return [tuple(r) for r in own.collect()]

    assert hop(graph.SECOND_HOP_FROM) == [("g", "b", 2, "f0")] and hop(graph.SECOND_HOP_FROM + 1) == []


def test_two_definitions_of_a_folder_are_enough(spark):
    rows = [("d", "Cost", f"d/m{k}.go", line) for k in range(50) for line in (9, 4)] + [("e", "Cost", "e/a.go", 3)]
    own = graph.folder_definitions(spark.createDataFrame(rows, "folder string, callee string, target_path string, target_line int"))
    assert {tuple(r) for r in own.collect()} == {("d", "Cost", "d/m0.go", 4), ("d", "Cost", "d/m1.go", 4), ("e", "Cost", "e/a.go", 3)}


def test_runs_meet_stated_lists_where_they_are(spark):
    """A list made on the driver has no known size: without a word it is joined by a shuffle on two or three hot keys."""
    from loamline.plans import run_queries

    plans = {n: run_queries.QUERIES[n](spark, FOLDER)._jdf.queryExecution().executedPlan().toString() for n in ("manifest_drift", "regrade")}
    assert all("BroadcastHashJoin" in p for p in plans.values()) and "SortMergeJoin" not in plans["manifest_drift"]
    assert "hashpartitioning(task" not in plans["regrade"] and "hashpartitioning(lang" not in plans["regrade"]


def test_resampling_is_dealt_by_a_stated_number(spark):
    from loamline.plans import run_queries

    plan = run_queries.QUERIES["ratio_intervals"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2  # few bytes and much work: not by what adaptive execution takes for one task
