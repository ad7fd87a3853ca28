from pyspark.sql import functions as F

from loamline.operators import render
from loamline.plans import run_queries
from loamline.sources import manifests


def test_manifests(spark):
    files = {
        "package.json": '{"name": "web", "version": "1.2", "dependencies": {"b": "1", "a": "2"}}', "go.mod": "module ex.org/m\n\nrequire (\n\tgithub.com/x/y v1.2.0\n)\nrequire gopkg.in/z v2.0.0\n",
        "Cargo.toml": '[package]\nname = "c"\nversion = "0.1"\n[dependencies]\nserde = "1"\n', "pyproject.toml": '[project]\nname = "p"\ndependencies = ["numpy>=1", "pandas"]\n', "sub/package.json": "broken",
    }
    frame = spark.createDataFrame(list(files.items()), "path string, content string")
    out = {r["path"]: (r["name"], r["version"], r["dependencies"]) for r in manifests.manifests(frame).collect()}
    assert out == {
        "package.json": ("web", "1.2", ["a", "b"]), "go.mod": ("ex.org/m", None, ["github.com/x/y", "gopkg.in/z"]), "Cargo.toml": ("c", "0.1", ["serde"]), "pyproject.toml": ("p", None, ["numpy", "pandas"]),
        "sub/package.json": (None, None, []),
    }
    assert manifests.first_manifest(frame).first()["path"] == "Cargo.toml"


def test_texts(spark):
    hits = spark.createDataFrame([("a.py", 3, "def f():", True, 2), ("b.py", 9, " f()", False, 2)], "path string, line int, text string, is_definition boolean, total_found long")
    assert render.hits("f", hits).split("\n")[:6] == ['# "f" in .: 2/2 shown', "", "## a.py", "def 3: def f():", "", "## b.py"]
    assert render.tree([("a/b.py", 10), ("a/c/d.py", 2000), ("z", 1)]) == "a/ (~2.0k)\n  c/ (~2.0k)\n    d.py (~2.0k)\n  b.py (~10)\nz (~1)"
    assert render.numbered([(9, "x"), (12, "y")]) == " 9 x\n   ...\n12 y" and render.size_label(2048) == "2.0KB"
    assert "nothing found" in render.search_header("q", "", 0, 0) and "[full]" in render.file_header("a", 1, 2, "full")
    row = [("p", "function", "n", "renamed", "o", "fuzzy", 0.9, 1)]
    changed = spark.createDataFrame(row, "path string, kind string, name string, change string, old_name string, confidence string, score double, line int")
    assert render.changes(changed) == "## p\n[→] function n (was o) [fuzzy 0.90]\n1 renamed"


def test_report(spark):
    text = render.report(run_queries.all_runs(spark, "/root/testdata/sf0.001").where(F.col("task").isin("t1", "t2")))
    assert "## Accuracy" in text and "| baseline |" in text and "token_snowball" in text
