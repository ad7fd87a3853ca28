"""Sources, extraction, search and the code graph over a small tree in several languages."""

import os

import pytest
from pyspark.sql import functions as F

from loamline.functions import names, queries, rank, text
from loamline.operators import graph, search, views
from loamline.sources import corpus, extract

TREE = {
    "pyproject.toml": '[project]\nname = "shop"\n',
    "shop/__init__.py": "",
    "shop/models.py": 'class Item:\n    """A thing."""\n\n    def price(self):\n        return self.tax() + 1\n\n    def tax(self):\n        return 0\n\n\nLIMIT = 3\n',
    "shop/store.py": "import os\nfrom .models import Item\nfrom shop import util\n\n\ndef open_store(path):\n    # open_store in a comment\n    item = Item()\n    return helper(item)\n\n\ndef helper(x):\n    return x.price()\n",
    "shop/util.py": "def spare():\n    pass\n",
    "tests/store.test.py": "from shop.store import open_store\n\n\ndef test_open():\n    open_store('x')\n",
    "_hidden/.settings.py": "def open_store():\n    return 1\n",
    "node_modules/x.py": "def open_store():\n    pass\n",
    "web/app.ts": "import { load } from './api'\n\nexport class View implements Shown {\n  draw() {\n    return load('a(b)') // load(1)\n  }\n}\n\nexport const start = () => load('b')\n",
    "web/api.ts": "export function load(name) {\n  return name\n}\n",
    "go/a.go": 'package a\n\nimport "fmt"\n\ntype Cart struct {\n\tn int\n}\n\nfunc (c *Cart) Add(n int) {\n\tc.n = helperGo(n)\n\tfmt.Println(c.n)\n}\n',
    "go/b.go": "package a\n\nfunc helperGo(n int) int {\n\treturn n\n}\n",
    "rs/src/lib.rs": "use crate::kit::tool;\n\npub struct Box2;\n\nimpl Shape for Box2 {\n    fn area(&self) -> u32 {\n        tool('a')\n    }\n}\n",
    "rs/src/kit.rs": "pub fn tool(c: char) -> u32 {\n    c as u32\n}\n",
    "docs/guide.md": "# Guide\n\ntext\n\n```\n# no heading\n```\n\n## open_store\n\nbody\n\n# Last\n",
    "conf/.env": "open_store=secret\n",
    "web/app.min.js": "open_store()",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, content in TREE.items():
        os.makedirs(root / os.path.dirname(path), exist_ok=True)
        (root / path).write_text(content)
    (root / "bin.dat").write_bytes(b"ab\0cd")
    (root / "bad.txt").write_bytes(b"\xff\xfe text")
    os.symlink(root / "shop", root / "again")
    (root / ".loamignore").write_text("*.md\n!guide.md\nconf\n")
    return str(root)


@pytest.fixture(scope="module")
def files(spark, tree):
    return corpus.read_tree(spark, tree).cache()


@pytest.fixture(scope="module")
def code(files):
    return extract.code_rows(files).cache()


def test_walk_sees_hidden_names_and_skips_build_folders(files, tree):
    paths = {r["path"] for r in files.collect()}
    assert {"shop/__init__.py", "_hidden/.settings.py", "conf/.env", "bin.dat"} <= paths
    assert not any("node_modules" in p or p.endswith("app.min.js") for p in paths)
    assert sum(p.endswith("models.py") for p in paths) == 1  # a link to a folder is not walked twice
    content = {r["path"]: (r["content"], r["is_binary"]) for r in files.collect()}
    assert content["bin.dat"] == (None, True) and "text" in content["bad.txt"][0]
    rules = corpus.ignored(files.select("path"), corpus.ignore_rules(tree))
    assert {r["path"] for r in rules.where("ignored").collect()} == {"conf/.env"}


def test_definitions(code):
    found = {(r["path"], r["kind"], r["name"], r["parent"], r["start_line"], r["end_line"]) for r in extract.symbols(code).collect()}
    assert {
        ("shop/models.py", "class", "Item", None, 1, 8), ("shop/models.py", "method", "price", "Item", 4, 5), ("shop/models.py", "assignment", "LIMIT", None, 11, 11), ("web/app.ts", "class", "View", None, 3, 7), ("web/app.ts", "method", "draw", "View", 4, 6),
        ("web/app.ts", "function", "start", None, 9, 9), ("go/a.go", "struct", "Cart", None, 5, 7), ("go/a.go", "method", "Add", "Cart", 9, 12), ("rs/src/lib.rs", "impl", "Box2", None, 5, 9), ("rs/src/lib.rs", "method", "area", "Box2", 6, 8),
    } <= found


def test_calls_leave_comments_and_strings_out(code):
    found = [(r["path"], r["caller"], r["callee"], r["line"]) for r in extract.calls(code).collect()]
    assert ("shop/store.py", "open_store", "helper", 9) in found and ("go/a.go", "Add", "helperGo", 10) in found
    assert [x for x in found if x[0] == "web/app.ts"] == [("web/app.ts", "draw", "load", 5), ("web/app.ts", "start", "load", 9)]


def test_imports_resolve(files, code):
    links = {(r["path"], r["source"]): r["target"] for r in graph.resolved_imports(extract.imports(code), files).collect()}
    assert links["shop/store.py", ".models"] == "shop/models.py" and links["tests/store.test.py", "shop.store"] == "shop/store.py"
    assert links["web/app.ts", "./api"] == "web/api.ts" and links["rs/src/lib.rs", "crate::kit::tool"] == "rs/src/kit.rs"
    assert links["shop/store.py", "os"] is None and links["go/a.go", "fmt"] is None


def test_callees_resolve_by_priority(files, code):
    resolved = graph.resolved_imports(extract.imports(code), files)
    edges = graph.resolved_callees(extract.calls(code), extract.symbols(code), resolved)
    found = {(r["path"], r["callee"]): r["target_path"] for r in edges.collect()}
    assert found["shop/store.py", "helper"] == "shop/store.py" and found["shop/store.py", "Item"] == "shop/models.py"
    assert found["go/a.go", "helperGo"] == "go/b.go" and found["go/a.go", "Println"] is None
    hops = {(r["hop"], r["callee"]) for r in graph.two_hops(edges, "shop/store.py", "open_store").collect()}
    assert hops == {(1, "Item"), (1, "helper"), (2, "price")}


def test_callers_and_impact(spark, code):
    calls = extract.calls(code)
    hits = graph.callers(calls, spark.createDataFrame([(1, "price"), (2, "tax")], "ord int, target string"))
    assert [(r["target"], r["path"], r["caller"]) for r in hits.collect()] == [("price", "shop/store.py", "helper"), ("tax", "shop/models.py", "price")]
    assert [(r["caller"], r["path"]) for r in graph.second_hop(calls, hits.where("target = 'price'")).collect()] == [("open_store", "shop/store.py")]


def test_dependencies(files, code):
    resolved = graph.resolved_imports(extract.imports(code), files)
    out = graph.dependencies("shop/store.py", resolved, extract.calls(code), extract.symbols(code))
    local = {r["target_path"]: r["names"] for r in out["local"].collect()}
    assert local["shop/models.py"] == ["Item", "price"] and out["external"].count() == 0 or "shop" in {r["source"] for r in out["external"].collect()}
    assert [(r["path"], r["names"], r["total"]) for r in out["dependents"].collect()] == [("tests/store.test.py", ["open_store"], 1)]
    assert [r["name"] for r in out["exports"].collect()] == ["open_store", "helper"]


def test_scopes_owners_and_siblings(spark, code):
    symbols = extract.symbols(code)
    hits = spark.createDataFrame([("shop/models.py", 5), ("shop/models.py", 4), ("shop/models.py", 2), ("shop/models.py", 11), ("shop/util.py", 9)], "path string, line int")
    inner = {(r["path"], r["line"]): r["in_name"] for r in graph.enclosing(hits, symbols).collect()}
    assert inner == {("shop/models.py", 5): "price", ("shop/models.py", 4): "Item", ("shop/models.py", 2): "Item", ("shop/models.py", 11): "LIMIT", ("shop/util.py", 9): None}
    assert [r["path"] for r in graph.by_owner(symbols, "Cart::Add").collect()] == ["go/a.go"] and graph.by_owner(symbols, "Item.Add").count() == 0
    assert [r["parent"] for r in graph.owners(symbols, "area").collect()] == ["Box2"]
    assert [r["name"] for r in graph.siblings(symbols, "shop/models.py", "Item", "price", "return self.tax() + 1").collect()] == ["tax"]


def test_symbol_search_ranks_definitions_first(files, code):
    symbols = extract.symbols(code)
    hits = search.ranked(search.symbol_hits(files, symbols, "open_store"), "open_store", F.current_timestamp())
    out = search.top(hits, 20).collect()
    assert [r["is_definition"] for r in out] == sorted([r["is_definition"] for r in out], reverse=True)
    assert out[0]["def_weight"] == 100 and {r["path"] for r in out if r["is_definition"]} == {"shop/store.py", "_hidden/.settings.py", "docs/guide.md"}
    assert out[0]["total_found"] == len(out) == len({(r["path"], r["line"]) for r in out})
    assert search.redacted(hits).where("path = 'conf/.env'").first()["text"] == "(redacted)"
    marked = search.expanded(hits, 2)
    assert marked.where("expand").count() == 2 and marked.where("expand").select("path").distinct().count() == 2
    shown = search.definition_hits(files, symbols, "Shown").collect()
    assert [(r["def_name"], r["impl_target"], r["def_weight"]) for r in shown] == [("View", "Shown", 80)]


def test_headings(files):
    out = [(r["line"], r["level"], r["title"], r["end_line"]) for r in search.headings(files.where("path = 'docs/guide.md'")).orderBy("line").collect()]
    assert out == [(1, 1, "Guide", 12), (9, 2, "open_store", 12), (13, 1, "Last", 13)]


def test_bad_pattern_is_a_literal(spark, files):
    assert search.content_hits(files, "load('a(b", is_regex=True).count() == 1
    assert queries.java_pattern(spark, "a(")[1] and queries.java_pattern(spark, "a.b") == ("a.b", None)


def test_map_and_fingerprint(files, code):
    out = {r["dir"]: (r["files"], r["bytes"]) for r in graph.directory_totals(files).collect()}
    assert out["shop"][0] == 4 and out[""][0] == files.count()
    summary = graph.fingerprint(files, graph.resolved_imports(extract.imports(code), files))
    assert summary["languages"][0] == ("python", 6) and ("shop", 4) in summary["modules"]
    assert {r["path"]: r["names"] for r in graph.code_map(files, extract.symbols(code)).collect()}["shop/store.py"] == ["open_store", "helper"]
    assert corpus.package_root(files).where("path = 'shop/util.py'").first()["package"] == ""


def test_globs(spark):
    rows = spark.createDataFrame([("a/b.py",), ("a/c/d.py",), ("x.rs",), ("a/[z].py",)], "path string")
    hits = lambda g: {r["path"] for r in rows.where(text.matches_glob(F.col("path"), g)).collect()}
    assert hits("*.py") == {"a/b.py", "a/c/d.py", "a/[z].py"} and hits("a/*.py") == {"a/b.py", "a/[z].py"} and hits("**/d.{py,rs}") == {"a/c/d.py"}
    assert hits("!*.py") == {"x.rs"} and hits("[x-z].rs") == {"x.rs"} and hits("?.rs") == {"x.rs"}


def test_classification(spark):
    cases = {"/a.*b/": "regex", "/src/": "fallthrough", "*.py": "glob", "import { X }": "content", "./a": "fallthrough", "404": "content", "handleAuth": "symbol", "Auth": "symbol", "alias": "concept", "cli mode": "concept", "a b c d e": "content", "foo!": "content"}
    rows = spark.createDataFrame([(q,) for q in cases], "q string")
    assert {r["q"]: r["k"] for r in rows.select("q", queries.classify(F.col("q")).alias("k")).collect()} == cases
    exists = rows.select("q", queries.classify(F.col("q"), F.col("q").isin("./a", "Auth")).alias("k")).collect()
    assert {r["q"]: r["k"] for r in exists}["./a"] == "path"
    specs = spark.createDataFrame([("a/b.py:12",), ("name:3",), ("a.py#3-9",), ("a.md##Top",)], "q string")
    assert [tuple(r["t"]) for r in specs.select(queries.target_spec(F.col("q")).alias("t")).collect()][:2] == [("a/b.py", 12), (None, None)]
    assert [r["s"] for r in specs.select(queries.section_suffix(F.col("q")).alias("s")).collect()][2:] == ["range", "heading"]


def test_score_terms(spark):
    row = spark.createDataFrame([("src/user.py", "pub struct User {"), ("a/b/x.py", "foo // user here"), ("a/b/x.py", "http://user"), ("a/b/x.py", "# user")], "path string, text string")
    line = F.col("text")
    assert [r[0] for r in row.select(rank.intent_boost(line, "User")).collect()] == [90, 0, 0, 0]
    assert [r[0] for r in row.select(rank.comment_penalty(F.col("path"), line, F.lit(False), "user")).collect()] == [0, 100, 0, 150]
    assert [r[0] for r in row.select(rank.basename_boost(F.col("path"), "user")).collect()] == [500, 0, 0, 0]
    assert [r[0] for r in row.select(rank.words_boost(F.col("path"), line, "foo user")).collect()] == [120, 300, 120, 120]
    assert [r[0] for r in row.select(rank.scope_proximity(F.col("path"))).collect()] == [160, 140, 140, 140]
    assert [r[0] for r in row.select(rank.context_boost(F.col("path"), "a/b/y.py")).collect()] == [0, 100, 100, 100]


def test_registered_language(spark):
    extract.register_language("make", lambda path, content: [{"row": "symbol", "kind": "function", "name": x.split(":")[0], "start_line": k + 1} for k, x in enumerate(content.split("\n")) if ":" in x])
    try:
        assert [r["name"] for r in extract.extract("Makefile", "make", "all: x\n\tcc\nx:") if True] == ["all", "x"]
    finally:
        extract.REGISTERED.clear()


def test_views(spark, files, code):
    modes = {r["path"]: r["mode"] for r in views.read_mode(files).collect()}
    assert modes["shop/__init__.py"] == "empty" and modes["bin.dat"] == "binary" and modes["shop/store.py"] == "full"
    kept = {r["line"] for r in views.stripped(files.where("path = 'shop/store.py'")).collect()}
    assert 7 not in kept and 5 not in kept and 4 in kept
    outline = {r["path"]: r["outline"] for r in views.code_outline(extract.symbols(code)).collect()}
    assert outline["shop/models.py"] == ["[1-8] class Item", "  [4-5] def price(self)", "  [7-8] def tax(self)", "[11-11] LIMIT = 3"]
    assert {r["entry"]: r["tokens"] for r in views.directory_listing(files, "web").collect()}.keys() == {"app.ts", "api.ts"}
    structured = views.structured_text("a.json", '{"a": {"x": 1, "y": 2}, "b": [1], "c": "text"}')
    assert structured == ["a: {2 keys} x, y", "  x: 1 (int)", "  y: 2 (int)", "b: [1 items] [int]", 'c: "text" (str)']
    assert views.structured_text("a.toml", "not = = toml\nk = 1") == ["not = = toml", "k = 1"]
    yaml = spark.createDataFrame([("a.yaml", "top:\n  mid: 1\n    deep:\n      deeper: 2\n# c: d\n- item: x\n")], "path string, content string")
    assert [(r["line"], r["level"], r["key"]) for r in views.yaml_outline(yaml).collect()] == [(1, 0, "top"), (2, 1, "mid"), (3, 2, "deep"), (6, 0, "item")]
    tests = spark.createDataFrame([("a.test.js", "describe('x', () => {\n  it('y', () => {})\n})")], "path string, content string")
    assert [(r["level"], r["kind"], r["name"]) for r in views.test_outline(tests).collect()] == [(0, "describe", "x"), (1, "it", "y")]


def test_budgets(spark):
    body = "head\n" + "\n\n".join(f"## part {k}\n" + "x" * 400 for k in range(10))
    cut, is_cut = views.cut_to_budget(body, 300)
    assert is_cut and len(cut.encode()) <= 1200 and cut.startswith("head\n## part 0") and cut.endswith("x")
    assert views.cut_to_budget("short", 10) == ("short", False) and views.cut_to_budget("é" * 1000, 60)[0].encode().decode() is not None
    assert views.item_budget(100, 0) == 100 and views.item_budget(1, 5) == 1 and text.truncate_bytes("aé", 2) == "a"
    rows = [("o", 1, 50, 0, True), ("o", 2, 60, 9, False), ("o", 3, 30, 5, False), ("o", 4, 10, 1, False)]
    kept = views.packed(spark.createDataFrame(rows, "owner string, ord int, bytes int, worth int, structural boolean"), 95).first()["kept"]
    assert kept == [1, 3, 4]


def test_names(spark):
    rows = spark.createDataFrame([(".env.local", True), (".env.example", False), ("id_rsa.pub", False), ("x/server.pem", True), ("a/credentials.yaml", True)], "path string, secret boolean")
    assert rows.where(names.is_secret_name(F.col("path")) != F.col("secret")).count() == 0


def test_reading_many_and_expansion(spark, files, code):
    wanted = spark.createDataFrame([(2, "shop/store.py"), (1, "nowhere.py"), (3, "bin.dat")], "ord int, path string")
    out = [(r["ord"], r["path"], r["found"], r["mode"]) for r in views.read_many(files, wanted).collect()]
    assert out == [(1, "nowhere.py", False, None), (2, "shop/store.py", True, "full"), (3, "bin.dat", True, "binary")]
    with pytest.raises(ValueError):
        views.read_many(files, wanted.limit(0))
    hits = spark.createDataFrame([("shop/store.py", 9, 6, 9)], "path string, line int, start_line int, end_line int")
    # the imports before the definition, the comment in it and the second of two blank lines are left out
    assert [r["line"] for r in views.expanded_hits(files, hits).orderBy("line").collect()] == [6, 8, 9, 10, 12, 13]
    assert [r["line"] for r in views.expanded_hits(files, hits, whole_below=0).orderBy("line").collect()] == [6, 8, 9]
    usage = hits.select("path", "line", F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"))
    assert [r["line"] for r in views.expanded_hits(files, usage).orderBy("line").collect()] == [1, 2, 3, 4, 6, 8, 9, 10, 12, 13]
    assert [r["signature"] for r in views.signatures(extract.symbols(code), "shop/store.py").collect()] == ["def open_store(path)", "def helper(x)"]


def rows_of(lang, content, row):
    keys = {"symbol": ("kind", "name", "parent", "start_line", "end_line"), "import": ("source", "start_line"), "call": ("name", "parent", "start_line")}[row]
    return [tuple(r.get(k) for k in keys) for r in extract.extract("x", lang, content) if r["row"] == row]


def test_heads_and_imports_over_several_lines():
    go = 'package a\nimport (\n\t"fmt"\n\t// "no"\n\tx "net/http"\n)\nfunc (s *Store) Get(\n\tid int,\n) int {\n\treturn fmt.Sprint(id)\n}\n'
    assert rows_of("go", go, "import") == [("fmt", 3), ("net/http", 5)]
    assert rows_of("go", go, "symbol") == [("method", "Get", "Store", 7, 11)] and rows_of("go", go, "call") == [("Sprint", "Get", 10)]
    script = "import {\n  a,\n} from './mod';\nexport class A extends B {\n  run(\n    x: number,\n  ): void {\n    go(x);\n  }\n}\n"
    assert rows_of("typescript", script, "import") == [("./mod", 1)]
    assert rows_of("typescript", script, "symbol") == [("class", "A", None, 4, 10), ("method", "run", "A", 5, 9)] and rows_of("typescript", script, "call") == [("go", "run", 8)]
    rust = "use std::{\n  fs,\n};\nmod m { fn inner() { helper(); } }\npub fn long(\n    a: u32,\n) -> u32 {\n    inner(a)\n}\n"
    assert rows_of("rust", rust, "import") == [("std", 1)]
    assert rows_of("rust", rust, "symbol") == [("module", "m", None, 4, 4), ("method", "inner", "m", 4, 4), ("function", "long", None, 5, 9)]
    assert rows_of("rust", rust, "call") == [("helper", "inner", 4), ("inner", "long", 8)]
    java = "public class K {\n  public int f(int a,\n      int b) {\n    return g(a);\n  }\n  private static void h() { g(1); }\n}\n"
    assert rows_of("java", java, "symbol") == [("class", "K", None, 1, 7), ("method", "f", "K", 2, 5), ("method", "h", "K", 6, 6)]
    assert rows_of("java", java, "call") == [("g", "f", 4), ("g", "h", 6)]
    c = "int add(int a, int b) { return a + b; }\nstatic int sub(\n  int a,\n  int b)\n{\n  return add(a, -b);\n}\n"
    assert rows_of("c", c, "symbol") == [("function", "add", None, 1, 1), ("function", "sub", None, 2, 7)] and rows_of("c", c, "call") == [("add", "sub", 6)]


def test_outcome_of_lookups(spark, files, code):
    wanted = spark.createDataFrame([("shop/store.py", "helper"), ("shop/store.py", "gone"), ("docs/guide.md", "x"), ("none.py", "x"), ("shop/__init__.py", "x")], "path string, name string")
    out = {(r["path"], r["name"]): (r["outcome"], r["start_line"], r["end_line"], r["lines"]) for r in graph.lookup(wanted, files, extract.symbols(code)).collect()}
    assert out == {
        ("shop/store.py", "helper"): ("found", 12, 13, 13), ("shop/store.py", "gone"): ("missing", None, None, 13), ("docs/guide.md", "x"): ("unavailable", None, None, None),
        ("none.py", "x"): ("unavailable", None, None, None), ("shop/__init__.py", "x"): ("missing", None, None, 0),
    }


def test_streams_of_items_and_parts(spark):
    items = [
        '{"type":"thread.started","thread_id":"t"}', '{"type":"item.completed","item":{"type":"command_execution","command":"early"}}', '{"type":"turn.started"}',
        '{"type":"item.completed","item":{"type":"command_execution","id":"c1","command":"ls"}}', '{"type":"item.completed","item":{"type":"mcp_tool_call","id":"c2","tool":"search","arguments":{"q":1}}}',
        '{"type":"item.completed","item":{"type":"agent_message","text":"hi"}}', '{"type":"turn.completed","usage":{"input_tokens":100,"cached_input_tokens":30,"cache_write_tokens":20,"output_tokens":7}}',
        "no json", '{"type":"turn.started"}', '{"type":"item.completed","item":{"type":"file_edit","id":"c3","file_path":"a.py"}}',
    ]
    rows = spark.createDataFrame([("s", k, x) for k, x in enumerate(items)], "session string, line_no int, text string")
    turns, calls = corpus.item_stream(rows)
    assert [tuple(r) for r in turns.orderBy("turn").collect()] == [("s", 1, 50, 7, 20, 30), ("s", 2, 0, 0, 0, 0)]
    assert [tuple(r)[1:] for r in calls.orderBy("line_no").collect()] == [(1, 3, "c1", "Bash", "ls"), (1, 4, "c2", "search", '{"q":1}'), (2, 9, "c3", "Edit", "a.py")]
    parts = [
        '{"type":"tool_use","sessionID":"x","part":{"tool":"own_own_read","callID":"k1","state":{"input":{"p":"a"}}}}', '{"type":"text","part":{"text":"t"}}',
        '{"type":"step_finish","part":{"cost":0.5,"tokens":{"input":5,"output":2,"cache":{"write":1,"read":9}}}}', '{"type":"tool_use","part":{"tool":"bash","id":"k2"}}', '{"type":"step_finish","part":{}}', '{"type":"tool_use","part":{"tool":"late"}}',
    ]
    turns, calls = corpus.part_stream(spark.createDataFrame([("s", k, x) for k, x in enumerate(parts)], "session string, line_no int, text string"))
    assert [tuple(r) for r in turns.orderBy("turn").collect()] == [("s", 1, 5, 2, 1, 9, 0.5), ("s", 2, 0, 0, 0, 0, 0.0)]
    assert [(r["turn"], r["call_id"], r["tool"]) for r in calls.orderBy("line_no").collect()] == [(1, "k1", "own_read"), (2, "k2", "bash")]
