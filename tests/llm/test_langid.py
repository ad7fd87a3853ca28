import itertools

import numpy as np
import pyarrow as pa
import pytest
from conftest import prose

from loamline.llm import langid

GERMAN = "der die das ung keit schen lich aus zu ein ver en".split()


@pytest.fixture
def model(spark, rng):
    rows = [(k, prose(rng, 60), "en") for k in range(30)]
    rows += [(100 + k, " ".join("".join(rng.choice(GERMAN) for _ in range(2)) for _ in range(60)), "de") for k in range(30)]
    rows += [(200 + k, "слово речь это так " * 10, "ru") for k in range(5)] + [(300, None, "en"), (301, "x", None), (302, "und", "und")]
    return langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def brute(scores, penalty):
    best = None
    for path in itertools.product(range(scores.shape[1]), repeat=len(scores)):
        total = sum(scores[k, x] for k, x in enumerate(path)) - penalty * sum(a != b for a, b in itertools.pairwise(path))
        best = total if best is None else max(best, total)
    return best


def test_viterbi_is_optimal_across_blocks(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 3)
    rng = np.random.default_rng(0)
    sizes = [0, 1, 2, 3, 4, 7, 8, 0, 6]
    scores = rng.normal(size=(sum(sizes), 3)).astype(np.float32)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    labels = langid.viterbi(scores, offsets, 1.0)
    for a, b in itertools.pairwise(offsets):
        if a < b:
            own, path = scores[a:b], labels[a:b]
            total = sum(own[k, x] for k, x in enumerate(path)) - sum(x != y for x, y in itertools.pairwise(path))
            assert total == pytest.approx(brute(own, 1.0), abs=1e-4)


def test_viterbi_has_room_for_many_languages():
    scores = np.zeros((6, 300), np.float32)
    scores[:3, 299] = scores[3:, 200] = 9
    assert langid.viterbi(scores, np.array([0, 6]), 1.0).tolist() == [299] * 3 + [200] * 3


def test_spans_of_mixed_text(model, rng):
    english, german = prose(rng, 30), " ".join("".join(rng.choice(GERMAN) for _ in range(2)) for _ in range(20))
    found = langid.label_texts(model, pa.array([f"{english} {german} слово речь"]), 8.0)
    text, first, past, lang = found.spans
    assert [(model.langs[x], a, b) for x, a, b in zip(lang, first, past, strict=True)] == [("en", 0, 30), ("de", 30, 50), ("ru", 50, 52)]
    assert found.pred == ["en"] and 0.3 < found.score[0] < 0.9


def test_script_narrows(model):
    found = langid.label_texts(model, pa.array(["речь", "漢字"]), 8.0)
    assert found.pred[0] == "ru" and found.pred[1] in model.langs


def test_scripts_that_no_language_uses_are_no_evidence(spark, model, rng):
    latin = langid.Model(model.langs[:2], model.logp[:, :2], model.allowed[:, :2])  # de, en
    english = prose(rng, 20)
    letters = sum(map(str.isalpha, english))
    texts = ["слово речь это так", "漢字 漢字", english + " " + "я" * letters, english + " " + "я" * 3 * letters, "ქართული " + english]
    found = langid.label_texts(latin, pa.array(texts), 8.0)
    assert set(found.pred) <= {"de", "en"} and found.pred[2:] == ["en"] * 3
    assert found.score[:2].tolist() == [0, 0] and found.score[2] == pytest.approx(0.5) and found.score[3] == pytest.approx(0.25) and 0.9 < found.score[4] < 1
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in langid.keep_identified(docs, latin).collect()) == [2, 4]


def test_one_very_long_text_among_short_ones():
    import time

    rng = np.random.default_rng(2)
    sizes = [1] * 5000 + [250_000] + [1] * 4999
    scores, offsets = rng.normal(size=(sum(sizes), 4)).astype(np.float32), np.concatenate([[0], np.cumsum(sizes)])
    began = time.process_time()
    labels = langid.viterbi(scores, offsets, 2.0)
    assert time.process_time() - began < 5
    own = scores[offsets[5000] : offsets[5001]]
    value, total = own[0].astype(float), None
    for row in own[1:]:
        value = np.maximum(value, value.max() - 2.0) + row
    path = labels[offsets[5000] : offsets[5001]]
    total = own[np.arange(len(own)), path].astype(float).sum() - 2.0 * (path[1:] != path[:-1]).sum()
    assert total == pytest.approx(value.max(), rel=1e-5)


def test_odd_rows(spark, model, odd_documents, no_documents):
    out = {(r["doc_id"], r["lang_pred"]) for r in langid.label(odd_documents, model).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (6, "und"), (None, "und"), (1, "en"), (9, "en")} <= out
    assert langid.label(odd_documents, model).count() == odd_documents.count()
    assert langid.label(no_documents, model).count() == 0
    kept = langid.keep_identified(odd_documents, model)
    assert kept.columns == odd_documents.columns and not {2, 3, 4, 6} & {r["doc_id"] for r in kept.collect()}
    nothing = langid.fit(no_documents)
    assert {r["lang_pred"] for r in langid.label(odd_documents, nothing).collect()} == {"und"}


def test_query_labels_every_row_and_learns_from_none_held_out(spark, rng, tmp_path):
    from zlib import crc32

    from loamline.llm import queries

    german = lambda: " ".join("".join(rng.choice(GERMAN) for _ in range(2)) for _ in range(40))
    rows = [(k, prose(rng, 40) if k % 2 else german(), "en" if k % 2 else "de") for k in range(200)]
    # a held-out label that no other row has is never learned
    rows = [(k, t, "xx" if crc32(str(k).encode()) % 4 == 2 and k % 3 == 0 else lang) for k, t, lang in rows] + [(900, None, "en"), (901, "42 --", None), (902, "", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in queries.op5_langid(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows)
    for k, _, _ in rows:
        assert out[k]["held_out"] == (crc32(str(k).encode()) % 4 == 2) and 0 <= out[k]["score"] <= 1
    assert all(out[k]["lang_pred"] == ("en" if k % 2 else "de") for k in range(200))
    assert [out[k]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3
