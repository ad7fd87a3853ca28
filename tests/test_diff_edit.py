import random

import pytest

from loamline.operators import diff, edit
from loamline.sources import extract

PATCH = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -1,4 +1,4 @@
 a
--- looks like a header
+++ so does this
 b
\\ No newline at end of file
@@ -10 +10,2 @@
-old
+new
+more
diff --git a/old.py b/new.py
similarity index 90%
rename from old.py
rename to new.py
diff --git a/gone.py b/gone.py
deleted file mode 100644
--- a/gone.py
+++ /dev/null
@@ -1 +0,0 @@
-x
diff --git a/pic.png b/pic.png
Binary files a/pic.png and b/pic.png differ
diff --git a/made.py b/made.py
new file mode 100644
--- /dev/null
+++ b/made.py
@@ -0,0 +1 @@
+y
"""


def test_patch(spark):
    lines = diff.diff_lines(spark.createDataFrame([("p", PATCH), ("empty", ""), ("bad", "@@ -1 +1 @@\n+x\n--- a\n+++ b\n@@ -1,9 +1,9 @@\n x\nnonsense")], "patch string, body string"))
    files = {(r["patch"], r["path"]): (r["status"], r["added"], r["removed"], r["is_binary"]) for r in diff.file_changes(lines).collect()}
    assert {k[1]: v for k, v in files.items() if k[0] == "p"} == {
        "x.py": ("modified", 3, 2, False), "new.py": ("renamed", 0, 0, False), "gone.py": ("deleted", 0, 1, False), "pic.png": ("modified", 0, 0, True), "made.py": ("added", 1, 0, False),
    }
    own = [(r["hunk_no"], r["kind"], r["old_line"], r["new_line"], r["content"]) for r in lines.where("path = 'x.py'").orderBy("hunk_no", "seq").collect()]
    assert own[:4] == [(1, " ", 1, 1, "a"), (1, "-", 2, None, "-- looks like a header"), (1, "+", None, 2, "++ so does this"), (1, " ", 3, 3, "b")]
    assert own[-1] == (2, "+", None, 11, "more")


def test_random_patches_never_fail():
    rng = random.Random(1)
    for _ in range(500):
        body = "\n".join(rng.choice(["diff --git a/x b/x", "--- a/x", "+++ b/x", "@@ -1,2 +1,2 @@", "+a", "-b", " c", "\\ No", "", "Binary files", "rename to y", "@@ bad"]) for _ in range(rng.randint(0, 12)))
        diff.parse_patch("p", body)


OLD = "def same():\n    return 1\n\n\ndef body():\n    return 1\n\n\ndef sig(a):\n    return a\n\n\ndef before_name(x, y):\n    # why\n    total = x + y\n    return total * 2\n\n\ndef fuzzy_old(values):\n    out = []\n    for v in values:\n        out.append(v + 1)\n    return out\n\n\ndef gone():\n    raise KeyError('gone')\n"
NEW = "def same():\n    return 1\n\n\ndef body():\n    return 2\n\n\ndef sig(a, b):\n    return a\n\n\ndef after_name(x, y):\n    total = x + y\n    return total * 2\n\n\ndef fuzzy_new(values):\n    out = []\n    for v in values:\n        out.append(v + 2)\n    return out\n\n\ndef fresh(q):\n    yield from q\n"


def version(spark, content, path="m.py"):
    files = spark.createDataFrame([(path, content)], "path string, content string")
    return diff.bodies(extract.symbols(extract.code_rows(files)), files)


def shapes(lang, content):
    return {r["name"]: r["shape"] for r in extract.extract("x", lang, content) if r["row"] == "symbol"}


def test_shapes():
    one = lambda lang, content: next(iter(shapes(lang, content).values()))
    assert one("rust", "fn foo(x: i32) -> i32 { x + 1 }") == one("rust", "fn bar(x: i32)->i32 { // why\n  x + 1\n}")
    assert one("rust", "fn foo() { 1 + 2 }") != one("rust", "fn foo() { 3 * 4 }")
    assert one("go", "func A(n int) int { return B(n) }") != one("go", "func A(n int) int { return B((n)) }")
    assert one("rust", "fn foo(n: u8) { foo(n) }") != one("rust", "fn bar(n: u8) { foo2(n) }")  # what is called counts, the own head's name does not
    nested = "def a(x):\n    if x:\n        y()\n{}z()\n"
    assert one("python", nested.format("    ")) != one("python", nested.format("        "))
    assert one("python", nested.format("    ")) == one("python", "\n\ndef b(x):  # c\n    if x:\n        y()\n\n    z()\n")
    members = "class {} {{\n  m() {{ return 1 }}\n  n() {{ return 2 }}\n}}"
    assert one("typescript", members.format("A")) == one("typescript", members.format("B"))


def test_renames_reorders_and_comments(spark):
    old = "fn a(x: u8) -> u8 { x + 1 }\nfn b(y: u8) -> u8 { y * 2 }\nfn c(z: u8) -> u8 { z - 3 }\nfn t1() { go(1) }\nfn t2() { go(1) }\n"
    new = "fn c(z: u8) -> u8 { z - 3 }\nfn a(x: u8) -> u8 { /* note */ x + 1 }\nfn bb(y: u8) -> u8 {\n    // moved and renamed\n    y * 2\n}\nfn t3() { go(1) }\n"
    changes = diff.symbol_changes(version(spark, old, "m.rs"), version(spark, new, "m.rs"))
    found = {(r["name"], r["change"], r["old_name"], r["confidence"], r["count"]) for r in changes.collect()}
    assert found == {
        ("c", "unchanged", None, "exact", None), ("a", "body_changed", None, "exact", None), ("bb", "renamed", "b", "structural", None),
        ("t1", "deleted", None, "ambiguous", 2), ("t2", "deleted", None, "ambiguous", 2), ("t3", "added", None, "ambiguous", 2),
    }


def test_overloads_keep_their_twins(spark):
    old = "class A {\n int f(int a) { return a; }\n int f(long b) { return 2; }\n}"
    new = "class A {\n int f(long b) { return 2; }\n int f(int a) { return a + 1; }\n}"
    changes = diff.symbol_changes(version(spark, old, "A.java"), version(spark, new, "A.java")).where("kind = 'method'")
    assert sorted(r["change"] for r in changes.collect()) == ["body_changed", "unchanged"]
    assert diff.symbol_changes(version(spark, "", "A.java"), version(spark, "", "A.java")).count() == 0


def test_equal_parts(spark):
    body = "{ a(1); b(2); c(3); d(4); e(5); }"
    files = spark.createDataFrame([("x.rs", f"fn f() {body}\nfn g() {body}"), ("y.go", f"func f() {body}"), ("z.md", body), ("n.rs", None), ("e.rs", "")], "path string, content string")
    assert {(r["path"], r["start_line"], r["copies"]) for r in extract.equal_parts(files).collect()} == {("x.rs", 1, 3), ("x.rs", 2, 3), ("y.go", 1, 3)}


def test_three_phases(spark):
    changes = diff.symbol_changes(version(spark, OLD), version(spark, NEW))
    found = {(r["name"], r["change"], r["old_name"], r["confidence"]) for r in changes.collect()}
    assert found == {
        ("same", "unchanged", None, "exact"), ("body", "body_changed", None, "exact"), ("sig", "signature_changed", None, "exact"), ("after_name", "renamed", "before_name", "structural"),
        ("fuzzy_new", "renamed", "fuzzy_old", "fuzzy"), ("gone", "deleted", None, "exact"), ("fresh", "added", None, "exact"),
    }
    calls = extract.calls(extract.code_rows(spark.createDataFrame([("u.py", "sig(1)\nsig(2)\n")], "path string, content string")))
    assert [tuple(r) for r in diff.blast(changes, calls).collect()] == [("sig", 2)]
    apart = changes.sparkSession.createDataFrame([("a.py", "function", "", "f", "deleted"), ("b.py", "function", "", "f", "added"), ("a.py", "function", "", "g", "deleted"), ("b.py", "function", "", "g", "added"), ("c.py", "function", "", "g", "added")], "path string, kind string, parent string, name string, change string")
    assert [(r["name"], r["old_path"], r["path"]) for r in diff.moves(apart).collect()] == [("f", "a.py", "b.py")]


def test_every_symbol_is_in_one_change():
    rng = random.Random(2)
    for _ in range(200):

        def side():
            return [{"path": "p", "kind": "function", "parent": "", "name": rng.choice("abc"), "signature": rng.choice("st"), "body": rng.choice(["x y z w", "x y z v", "q"]), "content_hash": rng.randint(0, 3), "structure_hash": rng.randint(0, 3), "start_line": k, "end_line": k} for k in range(rng.randint(0, 5))]

        old, new = side(), side()
        found = diff.match_file(old, new)
        assert sum(f["old_signature"] is not None for f in found) == len(old) and sum(f["new_signature"] is not None for f in found) == len(new)


def test_attribution_and_search(spark):
    lines = diff.diff_lines(spark.createDataFrame([("p", "diff --git a/m.py b/m.py\n--- a/m.py\n+++ b/m.py\n@@ -5,2 +5,2 @@\n def body():\n-    return 1\n+    return 2\n")], "patch string, body string"))
    own = diff.attributed(lines, version(spark, NEW))
    assert {(r["kind"], r["symbol"]) for r in own.collect()} == {("-", "body"), ("+", "body")}
    changes = diff.symbol_changes(version(spark, OLD), version(spark, NEW))
    assert {r["name"] for r in diff.matching_changes(changes, own, "RETURN 2").collect()} == {"body"}
    assert diff.in_scope(changes, "./m.py").count() == changes.count() and diff.in_scope(changes, "other").count() == 0
    assert diff.dice("a b c", "abc") == 1.0 and diff.dice("night", "nacht") == 0.25


def test_conflicts(spark):
    rows = [("f", k + 1, t) for k, t in enumerate("a,<<<<<<< x,o1,o2,||||||| base,b,=======,t1,>>>>>>> y,z,<<<<<<< open,q".split(","))]
    out = diff.conflicts(spark.createDataFrame(rows, "path string, line int, text string")).collect()
    assert [tuple(r) for r in out] == [("f", 2, "o1\no2", "t1")]


def test_edits():
    text = "a\nb\nc\nd\n"
    section = f"@ x.py #{edit.tag(text)}\nreplace 2-3\n+ B\n+ C\ninsert_before 1\n+ top\nappend\n+ end\n"
    assert edit.edited(text, section) == "top\na\nB\nC\nd\nend\n"
    assert edit.tag("a  \nb") == edit.tag("a\nb") != edit.tag("a\nc")
    live = "new first\n" + text
    assert edit.edited(live, section.replace("insert_before 1\n+ top\n", ""), recorded=text) == "new first\na\nB\nC\nd\nend\n"
    for bad in ("@ x\nreplace 2-3\n+ x\ndelete 3", "@ x\ndelete 9", "@ x\nappend", "@ x\ndelete_file\ndelete 1", "x", "@ x #0000\ndelete 1", "@ x\nreplace 2-4\n+ q\ninsert_before 3\n+ r"):
        with pytest.raises(edit.EditRejected):
            edit.edited(text, bad, recorded="other")
    with pytest.raises(edit.EditRejected):
        edit.merged("a\nb", "a\nB", "a\nx")


def test_one_bad_section_stops_no_other(spark):
    rows = [("a", "x\ny", "@ a\ndelete 1", None), ("b", "x", "@ b\ndelete 5", None), ("c", None, None, None)]
    out = {r["path"]: (r["content"], r["error"]) for r in edit.apply_edits(spark.createDataFrame(rows, "path string, content string, section string, recorded string")).collect()}
    assert out["a"] == ("y", None) and out["b"][0] == "x" and out["b"][1] and out["c"][1]
    assert edit.block_span([(1, 9), (3, 5)], 3) == (3, 5) and edit.block_span([(1, 9), (3, 5)], 6) == (1, 9) and edit.block_span([], 1) is None


def test_edits_in_json():
    text = '[{"path": "a", "tag": "#00FF", "ops": [{"op": "replace", "start": 2, "end": 3, "content": "x\\ny\\n"}, {"op": "insert_after_block", "at": "#run", "content": "z"}, {"op": "append", "content": "end"}]}, {"path": "b", "ops": [{"op": "move_file", "dest": "c"}]}]'
    (path, wanted, ops), (other, none, moved) = edit.sections_of_json(text, lambda path, at: (1, 4) if at == "run" else None)
    assert (path, wanted, other, none) == ("a", "00ff", "b", None)
    assert [(o.kind, o.start, o.end, o.lines) for o in ops] == [("replace", 2, 3, ["x", "y"]), ("insert_after", 4, 4, ["z"]), ("append", 0, 0, ["end"])]
    assert edit.apply("1\n2\n3\n4\n5\n", ops) == "1\nx\ny\n4\nz\n5\nend\n" and moved[0].target == "c"
    bad = ["{", "{}", "[1]", '[{"path": "a", "ops": [{"op": "swap"}]}]', '[{"path": "a", "ops": [{"op": "replace", "start": "2", "end": 3, "content": ""}]}]', '[{"path": "a", "tag": "xyz", "ops": []}]', '[{"path": "a", "ops": [{"op": "delete_block", "at": "#"}]}]', str([{}] * 21).replace("'", '"')]
    for text in bad:
        with pytest.raises(edit.EditRejected):
            edit.sections_of_json(text)
