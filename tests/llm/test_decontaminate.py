import random

import numpy as np
import pyarrow as pa
from conftest import prose

from loamline.llm import decontaminate as dec


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = prose(rng, 1)
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, prose(rng, 1))
    return words


def test_distances_are_exact():
    rng = random.Random(1)
    for _ in range(200):
        a, b = [rng.randrange(4) for _ in range(rng.randint(1, 8))], [rng.randrange(4) for _ in range(rng.randint(1, 12))]
        whole = dec.edit_rows(np.array([a]), np.array([len(a)]), np.array([b]), False)[0]
        assert whole[-1] == distance(a, b)
        ends = dec.edit_rows(np.array([a]), np.array([len(a)]), np.array([b]), True)[0]
        for j in range(len(b) + 1):
            assert ends[j] == min(distance(a, b[i:j]) for i in range(j + 1))


def test_recall_at_the_limit():
    rng = random.Random(2)
    items = [(k, prose(rng, rng.randint(12, 55))) for k in range(60)]
    ready = dec.prepare(items, 0.2, 0.99)
    texts, want = [], set()
    for n in range(300):
        k, text = rng.choice(items)
        words = text.split()
        edits = int(0.2 * len(words) + 1e-9) if n % 2 else 0
        texts.append(" ".join([prose(rng, rng.randint(0, 60)), *edited(rng, words, edits), prose(rng, rng.randint(0, 60))]))
        want.add((n, k))
    text, item, found, first, past = dec.matches(ready, pa.array(texts))
    got = {(int(a), ready.ids[b]) for a, b in zip(text, item, strict=True)}
    assert {(n, k) for n, k in want if n % 2 == 0} <= got  # exact passages are always found
    assert len(want & got) >= 0.97 * len(want)
    for a, b, d, x, y in zip(text, item, found, first, past, strict=True):
        own = texts[a].lower().split()
        assert distance(items[ready.ids[b]][1].lower().split(), own[x:y]) == d <= ready.edits[b]


def test_clean_texts_stay(spark):
    rng = random.Random(3)
    items = spark.createDataFrame([(k, prose(rng, 30)) for k in range(20)] + [(90, None), (91, ""), (92, "two words"), (None, prose(rng, 30))], "item_id long, text string")
    clean = spark.createDataFrame([(k, prose(rng, 200)) for k in range(50)], "doc_id long, text string")
    assert dec.find_leaks(clean, items).count() == 0
    leak = items.where("item_id = 4").first()["text"]
    dirty = spark.createDataFrame([(1, "before " + leak.upper() + " after"), (2, "with two words in it"), (3, "nothing")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"], r["distance"], r["first_word"]) for r in dec.find_leaks(dirty, items).collect()) == [(1, 4, 0, 1), (2, 92, 0, 1)]
    assert [r["doc_id"] for r in dec.remove_leaks(dirty, items).collect()] == [3]


def test_odd_rows(spark, odd_documents, no_documents, monkeypatch):
    items = spark.createDataFrame([(1, odd_documents.where("doc_id = 9").first()["text"]), (2, "x")], "item_id long, text string")
    monkeypatch.setattr(dec, "BLOCK_BYTES", 200)  # items in several passes
    found = [(r["doc_id"], r["item_id"]) for r in dec.find_leaks(odd_documents, items).collect()]
    assert sorted(found) == [(1, 1)] * 3 + [(7, 2), (9, 1)]
    kept = dec.remove_leaks(odd_documents, items)
    assert kept.columns == odd_documents.columns and not {1, 7, 9} & {r["doc_id"] for r in kept.collect()}
    assert dec.find_leaks(no_documents, items).count() == 0
    assert dec.find_leaks(odd_documents, items.limit(0)).count() == 0 and dec.remove_leaks(odd_documents, items.limit(0)).count() == odd_documents.count()


def found_items(items, texts, share=0.2, recall=0.99):
    ready = dec.prepare(items, share, recall)
    text, item, *_ = dec.matches(ready, pa.array(texts))
    return {(int(a), ready.ids[b]) for a, b in zip(text, item, strict=True)}


def test_short_items_are_found_wherever_the_edit_is():
    rng = random.Random(5)
    items = [(k, prose(rng, n)) for k, n in enumerate(n for n in range(5, 15) for _ in range(4))]
    texts, want = [], set()
    for k, item in items:
        words = item.split()
        for at in range(len(words)):
            for copy in (words[:at] + words[at + 1 :], words[:at] + ["zzz"] + words[at + 1 :], words[:at] + ["zzz"] + words[at:]):
                want.add((len(texts), k))
                texts.append(" ".join([prose(rng, 6), *copy, prose(rng, 6)]))
    assert want <= found_items(items, texts)


def test_each_length_reaches_the_target():
    rng = random.Random(6)
    for n in (15, 20, 35, 50):
        items = [(k, prose(rng, n)) for k in range(40)]
        texts = [" ".join([prose(rng, 20), *edited(rng, items[k % 40][1].split(), n // 5), prose(rng, 20)]) for k in range(800)]
        assert len({(k, k % 40) for k in range(800)} & found_items(items, texts)) >= 0.985 * 800, n


def test_too_few_repetitions_fall_back_to_exact_search(monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(dec, "MOST_REPETITIONS", 1)
    items = [(k, prose(rng, 40)) for k in range(20)]
    texts = [" ".join(edited(rng, items[k % 20][1].split(), 8)) for k in range(200)]
    assert {(k, k % 20) for k in range(200)} <= found_items(items, texts)


def test_a_window_across_two_texts_counts_for_both():
    words = "a b c d e f g h i j k l m n o".split()
    assert found_items([(1, " ".join(words))], [" ".join(words[:3]), " ".join(words[3:])]) == {(1, 1)}


def test_verification_keeps_to_its_cells(monkeypatch):
    monkeypatch.setattr(dec, "VERIFY_CELLS", 1000)
    widths = np.random.default_rng(1).integers(1, 3000, 500)
    runs = list(dec.batches_of(widths))
    assert sorted(np.concatenate(runs).tolist()) == list(range(500))
    assert all(len(r) == 1 or widths[r].max() * len(r) <= 1000 for r in runs)


def nearest_substring(item, words):
    """Least word edits of an item against any part of a text."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(words, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_query_finds_what_brute_force_finds(spark, tmp_path):
    rng = random.Random(12)
    vocabulary = prose(rng, 400).split()
    items = [(k, [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 6, 9, 14, 15, 22, 35, 60]))]) for k in range(30)]
    docs = []
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 2)):
            item = rng.choice(items)[1]
            at = rng.randint(0, len(words))
            words[at:at] = edited(rng, item, rng.randint(0, len(item) // 5 + 1))
        docs.append((k, words))
    spark.createDataFrame([(k, " ".join(w).upper() if k % 3 else " ".join(w)) for k, w in docs], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    low = lambda words: [w.lower() for w in words]
    want = {}
    for k, words in docs:
        for i, item in items:
            d = nearest_substring(low(item), low(words))
            if d <= len(item) // 5 and d < len(item):
                want[k, i] = d
    from loamline.llm import queries

    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in queries.op7_decontaminate(spark, str(tmp_path)).collect()}
    assert got == want
