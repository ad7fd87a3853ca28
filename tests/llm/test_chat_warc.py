import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from loamline.llm import chat, queries, warc

EVENTS = "conv_id long, seq long, turn long, op string, role string, text string, turns int, segments int"


def fold(spark, rows):
    out = chat.reconstruct(spark.createDataFrame([(*r, 1, 2) for r in rows], EVENTS))
    return sorted(((r["conv_id"], r["turn"], r["role"], r["text"]) for r in out.collect()), key=str)


def test_events_fold(spark):
    rows = [
        (1, 1, 0, "message", "user", "hi"), (1, 2, 1, "message", "assistant", "He"), (1, 3, 1, "delta", None, "llo"), (1, 4, 0, "edit", "user", "hey"), (1, 5, 2, "message", "user", "more"),
        (1, 6, 1, "regenerate", None, ""), (1, 7, 1, "delta", None, "Bye"), (1, 8, 1, "delta", None, None), (2, 1, 0, "delta", None, "only"), (3, 1, 0, None, None, None), (None, 1, 0, "message", "user", "x"),
    ]
    want = [(1, 0, "user", "hey"), (1, 1, "assistant", "Bye"), (2, 0, "", "only"), (3, 0, "", ""), (None, 0, "user", "x")]
    assert fold(spark, rows) == sorted(want, key=str)


def test_regeneration_drops_what_later_turns_had(spark):
    rows = [(1, 1, 2, "message", "user", "old"), (1, 2, 1, "regenerate", "assistant", "again"), (1, 3, 2, "delta", None, "new"), (1, 4, 2, "delta", None, "er")]
    assert fold(spark, rows) == [(1, 1, "assistant", "again"), (1, 2, "user", "newer")]


def replay(rows):
    """One event after another, by sequence."""
    now = {}
    for conv, _, turn, op, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[3] == "delta", r[5] or "")):
        turns = now.setdefault(conv, {})
        said, of = turns.get(turn, (None, None))
        turns[turn] = ((said or "") + (text or "") if op == "delta" else text or "", role if role is not None else of)
        if op == "regenerate":
            now[conv] = {t: v for t, v in turns.items() if t <= turn}
    return sorted(((c, t, r or "", x) for c, turns in now.items() for t, (x, r) in turns.items()), key=str)


def test_fold_is_the_replay_of_random_logs(spark):
    rng = random.Random(4)
    for _ in range(3):
        rows = []
        for conv in range(60):
            for seq in range(rng.randint(1, 14)):
                turn = rng.randint(0, 4)
                rows.append((conv, seq, turn, rng.choice(["message", "delta", "delta", "edit", "regenerate"]), ["user", "assistant"][turn % 2], rng.choice(["", "a", "bc", "d#", None])))
        rng.shuffle(rows)
        assert fold(spark, rows) == replay(rows)


def test_texts_come_back_from_the_output(spark):
    rng = random.Random(1)
    pieces = ["\\", "\\\\", "#", "###", "</turn>\n", "<turn>### user: ", "h", "l", "c", ":", ": ", "\n", "é", "漢", "", " "]
    rows = [(k, t, rng.choice(["user", "assistant", "sys:tem #1", ""]), "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))) for k in range(40) for t in range(rng.randint(1, 5))]
    out = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in out.select("conv_id", "formatted", "segments", chat.read_back(F.col("formatted")).alias("turns")).collect():
        own = [(x[2], x[3]) for x in rows if x[0] == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == own
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert r["formatted"].count("<turn>") == r["formatted"].count("</turn>") == len(own)
        assert sum(s["loss"] for s in r["segments"]) == sum(x[0] == "assistant" for x in own)


def test_table_with_repeated_and_null_rows(spark, tmp_path):
    rows = [(1, 0, "user", "a", 1), (1, 0, "user", "a", 1), (1, None, None, None, 1), (1, 1, "assistant", "b", 1), (None, 0, "user", None, 1)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int").write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r["conv_id"]: r for r in queries.op8_chat(spark, str(tmp_path)).collect()}
    said = "\n\nuser\na\nuser\na\nassistant\nb\n"
    assert out[1]["n_turns"] == 4 and out[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and out[1]["loss_chars"] == 1
    assert out[None]["n_turns"] == 1 and out[-7]["loss_chars"] == len(queries.CONTROL)


PAGES = "page_id long, url string, html string, sha string, first int"


def test_archives_round_trip(spark):
    rng = random.Random(2)
    rows = [(k, f"http://e.org/{k}\n?", f"<p>page {rng.randint(0, 40)}</p>" * rng.randint(0, 30), "s", 1) for k in range(300)]
    rows += [(500, None, None, None, None), (None, "u", "<p>lone</p>", None, None), (None, "u", rows[5][2], None, None), (rows[7][0], "again", rows[7][2], None, None)]
    archives = warc.write_archives(spark.createDataFrame(rows, PAGES))
    back = [r.asDict() for r in warc.read_archives(archives).collect()]
    assert len(back) == len(rows) == sum(r["records"] for r in archives.collect())
    least = {}
    for i, _, html, *_ in rows:
        if i is not None:
            least[html or ""] = min(i, least.get(html or "", i))
    for r in back:
        if r["record_type"] == "response":
            assert r["refers_to"] is None and hashlib.sha1(r["payload"]).digest() == __import__("base64").b32decode(r["payload_digest"])
            assert least.get(r["payload"].decode(), r["page_id"]) == r["page_id"]
        else:
            assert r["payload"] is None and r["refers_to"] != r["page_id"]
    want = sorted((str(i), len((h or "").encode()), least.get(h or "") if least.get(h or "") != i else None) for i, _, h, *_ in rows)
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["refers_to"]) for r in back) == want
    path = archives.first()["path"].removeprefix("file:")
    assert struct.unpack("<I", open(path, "rb").read(4))[0] == warc.DICTIONARY_MAGIC


def test_archives_are_the_same_where_digests_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    rows = [(k, None, f"page {k % 7}" * (k % 7), None, None) for k in range(50)]
    back = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, PAGES))).collect()
    assert sorted((r["page_id"], r["refers_to"]) for r in back) == [(k, k % 7 if k >= 7 else None) for k in range(50)]


def test_small_payloads_may_all_be_responses(spark):
    rows = [(1, "u", "ab", None, None), (2, "u", "ab", None, None), (3, "u", "abcdef", None, None), (4, "u", "abcdef", None, None)]
    back = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, PAGES), min_bytes=4)).collect()
    assert sorted((r["page_id"], r["record_type"]) for r in back) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], PAGES))).count() == 0


def test_damage_is_noticed():
    record = warc.encode_record(1, "u", b"payload", "d", None)
    assert warc.decode_record(record)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.decode_record(record.replace(b"payload", b"paylaod"))
