import subprocess

import pytest
from pyspark.sql import functions as F

from loamline.engine import Engine, InvalidQuery, NotFound, register_functions
from loamline.sources import corpus

FILES = {
    "a/core.py": "import os\n\n\ndef build(x):\n    return tidy(x)\n\n\ndef tidy(x):\n    return x\n",
    "a/use.py": "from .core import build\n\n\ndef go():\n    return build(1)\n",
    "a/tests/t.py": "from a.core import build\n\n\ndef test_it():\n    build(2)\n",
    "notes.md": "# Build plan\n\nfast search flow here\n",
}


def frame(spark, files):
    rows = [(p, len(c), c) for p, c in files.items()]
    return spark.createDataFrame(rows, "path string, size long, content string").withColumn("mtime", F.lit("2024-01-01").cast("timestamp"))


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(frame(spark, FILES))


def test_queries_of_each_kind(engine):
    found = lambda q, **o: engine.query(q, as_of="2024-01-01", **o)
    assert found("build").kind == "symbol" and found("build").rows.first()["path"] == "a/core.py"
    assert found("*.md").rows.first()["path"] == "notes.md" and found("a/core.py").rows.first()["mode"] == "full"
    assert found("/ti.+y/").kind == "regex" and found("fast search").kind == "content" and found("flow fast").kind == "words"
    assert found("return x").rows.first()["total_found"] == 1
    with pytest.raises(NotFound) as error:
        found("a/cor")
    assert "a/core.py" in error.value.suggestions
    with pytest.raises(InvalidQuery):
        found(" ")
    assert set(engine.multi(["build", "nowhere_"])) == {"build", "nowhere_"}


def test_bundle(engine):
    out = engine.grok("a/core.py:5")
    assert out["definition"]["name"] == "build" and out["body"] == ["def build(x):", "    return tidy(x)"]
    assert out["callees"] == [{"callee": "tidy", "target_path": "a/core.py"}] and [c["path"] for c in out["callers"]] == ["a/use.py"] and [t["path"] for t in out["tests"]] == ["a/tests/t.py"]
    with pytest.raises(NotFound):
        engine.grok("Nope::build")
    assert [r["caller"] for r in engine.callers("build").collect()] == ["go", "test_it"] and "nowhere" in engine.why_no_callers("zzz")
    assert {r["query_no"]: r["total_found"] for r in engine.batch(["build", "tidy"]).collect()} == {1: 5, 2: 2}


def test_diff_of_two_versions(spark, engine):
    newer = Engine(frame(spark, FILES | {"a/core.py": FILES["a/core.py"].replace("def tidy(x)", "def tidy(x, y)")}))
    assert {(r["name"], r["change"]) for r in newer.diff_against(engine).where("change <> 'unchanged'").collect()} == {("tidy", "signature_changed")}


def test_diff_of_a_working_tree(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "m.py").write_text("def f():\n    return 1\n")
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "m.py").write_text("def f():\n    return 2\n")
    out = Engine.of_tree(spark, str(tmp_path)).diff(str(tmp_path))
    assert [(r["path"], r["status"], r["added"], r["removed"]) for r in out["files"].collect()] == [("m.py", "modified", 1, 1)]
    assert {(r["kind"], r["symbol"]) for r in out["attributed"].collect()} == {("-", "f"), ("+", "f")}
    assert [(r["subject"], r["author"]) for r in corpus.commits(spark, str(tmp_path), "HEAD").collect()] == [("one", "a")]
    with pytest.raises(ValueError):
        corpus.diff_text(str(tmp_path), named="--output=x")


def test_functions(spark):
    register_functions(spark)
    row = spark.sql("SELECT dice('night', 'nacht') AS d, truncate_bytes('aé', 2) AS t, lex_identifiers('x = y # z', 'python') AS i").first()
    assert tuple(row) == (0.25, "a", ["x", "y"])
    assert [tuple(r) for r in spark.sql("SELECT * FROM corpus_symbols('a.py', 'python', 'def f():\n  pass')").collect()] == [("f", "function", 1, 2)]
