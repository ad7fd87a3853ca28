"""Identifier filters: no name that is in a file is denied, few others pass, and stale filters deny nothing."""

import random
import re

from pyspark.sql import functions as F

from loamline.engine import Engine
from loamline.operators import filters, search
from loamline.sources import extract

SCHEMA = "path string, mtime timestamp, size long, content string"


def files_of(spark, contents, at="2024-01-01"):
    rows = [(f"src/f{k}.py", c) for k, c in enumerate(contents)]
    return spark.createDataFrame(rows, "path string, content string").select("path", F.lit(at).cast("timestamp").alias("mtime"), F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("size"), "content")


def test_no_name_is_denied_and_few_others_pass(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdef_") for _ in range(rng.randint(3, 6))) + str(rng.randrange(40))
    contents = [" ".join(word() for _ in range(rng.choice([5, 50, 500, 9000]))) + "(é1x 9abc)" for _ in range(30)] + [None, "", "123 !"]
    files = files_of(spark, contents)
    made = filters.identifier_filters(files)
    assert made.agg(F.max("bitmaps")).first()[0] > 1
    names = [word() for _ in range(150)] + ["x1", "abc", "absent_name", "1x", "_"]
    out = {r["name"]: r for r in filters.misses(files, made, spark.createDataFrame([(n,) for n in set(names)], "name string")).collect()}
    wrong = asked = 0
    for name in set(names):
        held = sum(name in set(re.findall(filters.IDENTIFIER, c or "")) for c in contents)
        assert out[name]["files"] == len(contents) and out[name]["held"] == held and out[name]["passed"] - out[name]["wrong"] == held
        wrong, asked = wrong + out[name]["wrong"], asked + len(contents) - held
    assert wrong < 0.03 * asked


def test_searches_give_the_same_from_fewer_files(spark):
    contents = ["def open_store(x):\n    return 1\n", "reopen_store = 2\n", "# open_store in a comment\n", "nothing\n", "open_store9\n", "9open_store open_store\n", None]
    files = files_of(spark, contents)
    made = filters.identifier_filters(files)
    left = filters.narrowed(files, made, "open_store")
    assert [r["path"] for r in left.orderBy("path").collect()] == ["src/f0.py", "src/f2.py", "src/f5.py"]
    assert files.where(F.col("content").contains("open_store")).count() == 5  # split without filters
    key = lambda df: sorted((r["path"], r["line"]) for r in df.collect())
    assert key(search.usage_hits(left, "open_store")) == key(search.usage_hits(files, "open_store"))
    assert filters.narrowed(files, made, "a.b").count() == len(contents)


def test_definitions_and_callers_from_fewer_files(spark):
    engine = Engine(files_of(spark, ["def alpha():\n    return beta()\n", "def gamma():\n    return alpha()\n", "def delta():\n    pass\n"]))
    rows = engine.code_naming("alpha")
    assert {r["path"] for r in rows.collect()} == {"src/f0.py", "src/f1.py"}
    assert [(r["path"], r["caller"]) for r in extract.calls(rows).where("callee = 'alpha'").collect()] == [("src/f1.py", "gamma")]
    assert [r["path"] for r in extract.symbols(rows).where("name = 'alpha'").collect()] == ["src/f0.py"]


def test_stale_and_missing_filters_deny_nothing(spark):
    old, new = files_of(spark, ["a", "b"], "2024-01-01"), files_of(spark, ["a", "zeta"], "2024-06-01")
    made = filters.identifier_filters(old)
    assert filters.narrowed(new, made, "zeta").count() == 2 and filters.narrowed(old, made, "zeta").count() == 0
    assert filters.narrowed(old, made.limit(0), "zeta").count() == 2


def test_filters_of_a_folder(spark):
    files = files_of(spark, ["alpha beta", "gamma"])
    one = filters.merged(filters.identifier_filters(files))
    held = one.select(*[filters._has(F.col("bits"), F.lit(n)).alias(n) for n in ("alpha", "gamma", "delta")]).first()
    assert tuple(held) == (True, True, False)


def test_bits_are_those_of_the_hashes_and_no_identifier_is_sorted(spark):
    """A row for each bit, sorted by file, took most of the time of the queries; a search read the filters twice."""
    words = " ".join(f"w{k}" for k in range(8000))
    files = files_of(spark, ["a _b C9 9abc é1x a", None, "", "123", words]).unionByName(files_of(spark, ["other"])).unionByName(files_of(spark, [None], "2024-02-01"))
    made = filters.identifier_filters(files)
    found = F.array_distinct(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(filters.IDENTIFIER), F.lit(0)))
    own = files.select("path", "mtime", found.alias("found")).select("path", "mtime", F.greatest(F.ceil(F.size("found") / filters.PER_BITMAP), F.lit(1)).cast("int").alias("bitmaps"), F.explode_outer("found").alias("name"))
    bits = F.explode_outer(F.when(F.col("name").isNotNull(), filters._bits(F.col("name")))).alias("bit")
    placed = own.select("path", "mtime", "bitmaps", F.coalesce(filters._bitmap(F.col("name"), F.col("bitmaps")), F.lit(0)).alias("bitmap"), bits)
    plain = placed.groupBy("path", "mtime", "bitmaps", "bitmap").agg(F.bitmap_construct_agg("bit").alias("bits"))
    rows = lambda df: sorted((r["path"], str(r["mtime"]), r["bitmaps"], r["bitmap"], bytes(r["bits"])) for r in df.collect())
    assert rows(made) == rows(plain) and made.schema.simpleString() == plain.schema.simpleString()
    one = files_of(spark, ["a"])
    plan = filters.narrowed(one, filters.identifier_filters(one), "a")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") == 1
