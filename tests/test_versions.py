"""The version store, its streaming version, and edits on versions that are no longer the text."""

import random

import pytest

from loamline.operators import edit
from loamline.operators import versions as v
from loamline.streaming.versions import version_log


def swap(line, to, tag=None):
    return f"@ r.rs{f' #{tag}' if tag else ''}\nreplace {line}\n+ {to}"


def section(tag, body):
    return f"@ r.rs #{tag}\n{body}"


def outcome(events, body, live, tag_of=0, tag=None):
    """What becomes of an edit on the version that event ``tag_of`` recorded."""
    store = v.Store()
    tags = [v.step(store, *e)[0] for e in events]
    tag = tag or tags[tag_of]
    own = store.get("r.rs")
    found = next((k for k, x in enumerate(own) if x.tag == tag), None)
    known = any(x.tag == tag for vs in store.held.values() for x in vs)
    return v.settled(section(tag, body), live, own[found].text if found is not None else None, found == 0, known, own[found].seen if found is not None else [])


def record(text, lines=(), path="r.rs"):
    return ("record", path, text, None, list(lines), None)


def test_a_block_that_moved_is_found():
    got = outcome([record("line1\nline2\nTARGET\nline4\nline5\n")], "replace 3\n+ CHANGED", "PREPENDED\nline1\nline2\nTARGET\nline4\nline5\n")
    assert got == ("PREPENDED\nline1\nline2\nCHANGED\nline4\nline5\n", "merged", None)


def test_what_changed_all_over_is_refused():
    live = "totally\ndifferent\ncontent\nhere\n"
    assert outcome([record("a\nb\nTARGET\nd\n")], "replace 3\n+ NEW", live)[:2] == (live, "drift")
    assert outcome([record("a\nb\nTARGET\nd\n")], "replace 3\n+ NEW", "a\nX\nTARGET\nd\n")[1] == "drift"  # the newest version: no replay past its context
    assert outcome([], "replace 1\n+ x", "a\nb\n", tag="beef")[1] == "fabricated"
    other = edit.tag("q\n")
    assert outcome([record("a\nb\n"), record("q\n", path="other.rs")], "replace 1\n+ x", "a\nb\n", tag=other)[1] == "drift"


def test_an_older_version_is_replayed_where_its_lines_are_the_same():
    both = [record("a\nb\nTARGET\nd\n"), record("a\nMODIFIED\nTARGET\nd\n")]
    assert outcome(both, "replace 3\n+ NEW", "a\nMODIFIED\nTARGET\nd\n")[:2] == ("a\nMODIFIED\nNEW\nd\n", "replayed")
    assert outcome(both, "replace 2\n+ NEW", "a\nMODIFIED\nTARGET\nd\n")[1] == "drift"


def test_lines_that_were_not_shown():
    text = "l1\nl2\nl3\nl4\nl5\n"
    assert outcome([record(text, [1, 2, 3])], "replace 5\n+ x", text)[1:] == ("unseen", "line 5")
    assert outcome([record(text, [1, 2, 3])], "replace 2\n+ x", text)[:2] == ("l1\nx\nl3\nl4\nl5\n", "applied")
    assert outcome([record(text, [1, 2])], "insert_before 3\n+ x", text)[1:] == ("unseen", "line 3")
    assert outcome([record(text, [1, 2, 5])], "delete 1-5", text)[1:] == ("unseen", "line 3")
    assert outcome([record(text)], "replace 2\n+ x", text)[1] == "applied"
    assert outcome([record(text, [1])], "append\n+ x", text)[1] == "applied"  # names no line
    tag = edit.tag(text)
    assert outcome([record(text, [1]), ("seen", "r.rs", None, tag, [4, 5], None)], "replace 5\n+ x", text)[1] == "applied"
    assert outcome([record(text, [1])], "replace 4-2\n+ x", text)[1] == "rejected"


def test_line_diff_is_a_shortest_script():
    rng = random.Random(4)
    for _ in range(400):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        script, out, at = v.line_diff(a, b), [], 0
        for i, j, k, m in script:
            out += a[at:i] + b[k:m]
            at = j
        assert out + a[at:] == b
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert sum(j - i + m - k for i, j, k, m in script) == len(a) + len(b) - 2 * table[-1][-1]


def test_changes_are_carried_as_by_hand():
    rng = random.Random(6)
    for _ in range(300):
        base = [f"line {k}\n" for k in range(rng.randint(8, 30))]
        at = rng.randrange(len(base))
        edited = [*base[:at], "new\n", *base[at + 1 :]]
        far = [k for k in range(len(base)) if abs(k - at) > v.CONTEXT]
        live, shift = list(base), 0
        if far:
            k = rng.choice(far)
            live[k : k + 1] = ["x\n"] * rng.randint(0, 3)
            shift = len(live) - len(base) if k < at else 0
        expected = list(live)
        expected[at + shift] = "new\n"
        assert v.carried("".join(base), "".join(edited), "".join(live)) == "".join(expected)
        near = list(base)
        near[max(0, at - 1) if at else 1] = "touched\n"
        assert v.carried("".join(base), "".join(edited), "".join(near)) is None


def test_bounds_of_a_store(monkeypatch):
    store = v.Store()
    for k in range(6):
        result = v.step(store, *record(f"text {k}\n", [k + 1]))
    assert result[1] == v.MOST_VERSIONS and [x.text for x in store.get("r.rs")] == ["text 5\n", "text 4\n", "text 3\n", "text 2\n"]
    assert v.step(store, *record("text 3\n", [9]))[1:3] == (4, 2)  # known: the newest again, and seen lines are merged
    assert v.step(store, *record("x" * (v.FILE_BYTES + 1)))[0] is None
    for k in range(40):
        result = v.step(store, *record("t\n", path=f"p{k}"))
    assert result[3] == v.MOST_PATHS and not store.get("r.rs") and store.get("p39") and not store.get("p9")
    assert v.step(store, "relocate", "p39", None, None, None, "p38")[1] == 1 and not store.get("p39")
    assert v.step(store, "invalidate", "p38", None, None, None, None)[1] == 0
    monkeypatch.setattr(v, "MOST_BYTES", 300)
    for k in range(5):
        result = v.step(store, *record("y" * 100, path=f"q{k}"))
    assert result[3] == 2 and result[4] <= 300


def random_events(rng, n):
    out = []
    for seq in range(n):
        path, kind = f"f{rng.randrange(5)}", rng.choice(["record"] * 6 + ["seen", "seen", "invalidate", "relocate", "unknown"])
        text = f"text {rng.randrange(6)}\nmore\n"
        out.append((f"s{rng.randrange(3)}", seq, kind, path, text if kind == "record" else None, edit.tag(f"text {rng.randrange(6)}\nmore\n") if kind == "seen" else None, [rng.randint(1, 9) for _ in range(rng.randrange(3))] if rng.random() < 0.8 else None, f"f{rng.randrange(5)}" if kind == "relocate" else None))
    return out


def test_replay(spark):
    events = random_events(random.Random(1), 200)
    log = {(r["session"], r["seq"]): tuple(r)[4:] for r in v.replay(spark.createDataFrame(events, v.EVENT)).collect()}
    held = {}
    for session, seq, *rest in events:
        assert log[session, seq] == v.step(held.setdefault(session, v.Store()), *rest)
    got = {(r["session"], r["path"], r["place"], r["text"], tuple(map(tuple, r["seen"]))) for r in v.current(spark.createDataFrame(events, v.EVENT)).collect()}
    assert got == {(s, p, k, x.text, tuple(x.seen)) for s, store in held.items() for p, vs in store.held.items() for k, x in enumerate(vs)}
    assert v.replay(spark.createDataFrame([], v.EVENT)).count() == 0


def test_stream_equals_replay(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        events = random_events(random.Random(2), 120)
        source = str(tmp_path / "in")
        for k in range(3):  # three batches, in order
            spark.createDataFrame(events[40 * k : 40 * k + 40], v.EVENT).coalesce(1).write.mode("append").parquet(f"{source}/part={k}")
        stream = spark.readStream.schema(v.EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
        query = version_log(stream).writeStream.format("memory").queryName("versions_log").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        got = sorted(map(tuple, spark.table("versions_log").collect()))
        assert len({r[0] for r in got}) == 3 and got == sorted(map(tuple, v.replay(spark.createDataFrame(events, v.EVENT)).collect()))
    finally:
        spark.conf.unset(provider)


def test_recover(spark):
    texts = {"a": "l1\nl2\nl3\n", "b": "m1\nm2\nm3\n"}
    events = [("s", 1, "record", "a", texts["a"], None, [1, 2], None), ("s", 2, "record", "b", texts["b"], None, None, None)]
    versions = v.current(spark.createDataFrame(events, v.EVENT))
    ta, tb = edit.tag(texts["a"]), edit.tag(texts["b"])
    edits = [
        (1, "s", "a", f"@ a #{ta}\nreplace 1\n+ x", texts["a"]), (2, "s", "a", f"@ a #{ta}\nreplace 3\n+ x", texts["a"]), (3, "s", "a", f"@ a #{tb}\nreplace 1\n+ x", texts["a"]), (4, "s", "a", "@ a #0000\nreplace 1\n+ x", texts["a"]),
        (5, "t", "a", f"@ a #{ta}\nreplace 1\n+ x", texts["a"]), (6, "s", "b", f"@ b #{tb}\nreplace 1\n+ x", "top\n" + texts["b"]), (7, "s", "b", None, None), (8, "s", "b", "@ b\nappend\n+ z", "y\n"), (8, "s", "b", "@ b\nappend\n+ z", "y\n"),
    ]
    frame = spark.createDataFrame(edits, "edit_id long, session string, path string, section string, content string").selectExpr("*", "1 AS text", "2 AS known")
    got = sorted((r["edit_id"], r["outcome"], r["content"]) for r in v.recover(frame, versions).collect())
    assert got == [
        (1, "applied", "x\nl2\nl3\n"), (2, "unseen", texts["a"]), (3, "drift", texts["a"]), (4, "fabricated", texts["a"]), (5, "fabricated", texts["a"]), (6, "merged", "top\nx\nm2\nm3\n"),
        (7, "rejected", ""), (8, "applied", "y\nz\n"), (8, "applied", "y\nz\n"),
    ]
    assert v.recover(frame.limit(0), versions).count() == 0


def colliding():
    """Two texts whose first four digits of the hash are the same."""
    known: dict[str, str] = {}
    for k in range(10_000):
        text = f"line {k}\nend"
        if (other := known.setdefault(edit.tag(text), text)) != text:
            return other, text
    raise AssertionError


def test_texts_of_one_session_with_equal_digits_have_tags_of_their_own(spark):
    first, second = colliding()
    assert edit.tag(first) == edit.tag(second)
    rows = [(s, n, "record", p, t, None, [1, 2], None) for s, n, p, t in (("one", 1, "a", first), ("one", 2, "a", second), ("two", 1, "a", first), ("two", 2, "b", second))]
    held = v.current(spark.createDataFrame(rows, v.EVENT)).cache()
    tags = {(r["session"], r["text"]): r["tag"] for r in held.collect()}
    assert len({tags["one", first], tags["one", second]}) == len({tags["two", first], tags["two", second]}) == 2 and tags["one", first] == edit.tag(first)
    asked = [("old", "one", "a", f"@ a #{tags['one', first]}\nreplace 2\n+ x", second), ("now", "one", "a", f"@ a #{tags['one', second]}\nreplace 2\n+ x", second), ("else", "two", "a", f"@ a #{tags['two', second]}\nreplace 2\n+ x", first)]
    edits = spark.createDataFrame(asked, "edit_id string, session string, path string, section string, content string")
    found = {r["edit_id"]: (r["outcome"], r["content"]) for r in v.recover(edits, held).collect()}
    assert found == {"old": ("replayed", second.split("\n")[0] + "\nx"), "now": ("applied", second.split("\n")[0] + "\nx"), "else": ("drift", first)}
