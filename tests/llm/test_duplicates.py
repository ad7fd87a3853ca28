import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import prose

from loamline.llm import minhash, suffixes
from loamline.llm.components import components


def near_copy(rng, text, share):
    return " ".join(w if rng.random() > share else prose(rng, 1) for w in text.split())


def corpus(rng):
    texts = [prose(rng, rng.randint(1, 150)) for _ in range(60)]
    texts += [near_copy(rng, texts[k % 20], 0.02) for k in range(60)] + [texts[3]] * 5 + [near_copy(rng, texts[1], 0.002) for _ in range(40)]
    shared = prose(rng, 70)
    texts += [prose(rng, 30) + " " + shared + " " + prose(rng, rng.randint(0, 40)) for _ in range(6)]
    texts += ["short one", "short one", "  ", ""]
    return list(enumerate(texts))


def test_components_are_those_of_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 450)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    want = {(x, root(x)) for a, b in edges if a != b for x in (a, b)}
    assert set(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect())) == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.999), (0.5, 0.95)):
        bands, rows = minhash.choose_bands(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall


def test_join_against_brute_force(spark, monkeypatch):
    rows = corpus(random.Random(4))
    grams = {}
    for i, t in rows:
        w = t.lower().split()
        if w:
            grams[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    links, parent = Counter(), {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in grams:
        for b in grams:
            if a < b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (256, 7):  # one block holds a group, or many do
        monkeypatch.setattr(minhash, "BLOCK", block)
        out = {r["doc_id"]: r for r in minhash.similarity_join(table).collect()}
        assert {i: (r["class_id"], r["n_links"]) for i, r in out.items()} == {i: (root(i), links[i]) for i, _ in rows}
    kept = {r["doc_id"] for r in minhash.keep_one(table).collect()}
    assert kept == {root(i) for i, _ in rows}


def test_intersections():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 5000, 300).astype(np.uint64)) for _ in range(30)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert minhash._compare(sets, sets).tolist() == want


def test_join_of_odd_rows(odd_documents, no_documents):
    out = minhash.similarity_join(odd_documents).collect()
    assert len(out) == odd_documents.count()
    assert {(r["class_id"], r["n_links"]) for r in out if r["doc_id"] in (1, 9)} == {(1, 3)}
    assert all(r["n_links"] == 0 and r["class_id"] == r["doc_id"] for r in out if r["doc_id"] in (2, 3, 4, 7))
    kept = minhash.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, 4, 5, 5, 6, None, 7, 8, None])
    assert minhash.similarity_join(no_documents).count() == 0 and minhash.keep_one(no_documents).count() == 0


def brute_spans(rows, size):
    count, first = Counter(), {}
    words = {i: t.split() for i, t in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - size + 1):
            g = tuple(words[i][k : k + size])
            count[g] += 1
            first.setdefault(g, (i, k))
    out = {}
    for i, w in words.items():
        each = [[k for k in range(len(w) - size + 1) if count[tuple(w[k : k + size])] > 1]]
        each.append([k for k in each[0] if first[tuple(w[k : k + size])] != (i, k)])
        spans = []
        for starts in each:
            own = []
            for k in starts:
                if own and k <= own[-1][1]:
                    own[-1][1] = k + size
                else:
                    own.append([k, k + size])
            spans.append([tuple(s) for s in own])
        if spans[0]:
            out[i] = tuple(spans)
    return out


@pytest.mark.parametrize("hot", [suffixes.HOT_CLASSES, 0, 2])
def test_repeats_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT_CLASSES", hot)  # k-grams beyond it meet by windows
    rng = random.Random(6)
    rows = corpus(rng)
    rows.append((500, "a b c d e f g h i j " * 30))  # repeats within one text, and ties between its k-grams
    rows.append((501, "z " * 200))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (50, 20):
        found = {r["doc_id"]: tuple([(s["first"], s["past"]) for s in r[c]] for c in ("spans", "cuts")) for r in suffixes.repeated_spans(table, size).collect()}
        assert found == brute_spans(rows, size)


def test_cutting_leaves_each_passage_once(spark):
    rng = random.Random(8)
    shared = prose(rng, 60)
    rows = [(k, prose(rng, 20) + "\n" + shared + "\n" + prose(rng, 20), k) for k in range(4)] + [(9, shared, 9), (10, prose(rng, 30), 10)]
    out = {r["doc_id"]: r["text"] for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, _key int")).collect()}
    assert out[0] == rows[0][1] and out[10] == rows[5][1] and 9 not in out
    for k in (1, 2, 3):
        assert out[k] == rows[k][1].replace(shared + "\n", "")


def test_repeats_of_odd_rows(odd_documents, no_documents):
    found = defaultdict(list)
    for r in suffixes.repeated_spans(odd_documents).collect():
        found[r["doc_id"]].append([(s["first"], s["past"]) for s in r["spans"]])
    assert dict(found) == {1: [[(0, 80)]], 9: [[(0, 80)]]}
    out = suffixes.remove_repeats(odd_documents)
    assert out.columns == odd_documents.columns and 9 not in {r["doc_id"] for r in out.collect()}
    assert suffixes.repeated_spans(no_documents).count() == 0 and suffixes.remove_repeats(no_documents).count() == 0
