"""Ranked lexical search against scoring every document, and the query against its SQL."""

import math
import re

import duckdb
import numpy as np
import pytest

from loamline.llm import lexical
from loamline.llm.queries import SQL_LEXICAL, op11_lexical

FOLDER = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def prose(rng, n):
    return " ".join("".join(rng.choice("the of and tion erly ing hand with ther to".split()) for _ in range(rng.randint(1, 3))) for _ in range(n))


def terms_of(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def by_hand(docs, items, k=20):
    held = [(d, t) for d, text in docs if (t := terms_of(text))]
    n, total = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for d, t in held:
            m = 75 + 25 * len(t) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 12 * m)) for x in terms_of(text) if x in df)
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k], 1)]
    return out


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize(("shard", "rounds"), [(256, (8, 64)), (4, (1, 3)), (2, (2,))])
def test_every_document(spark, rng, shard, rounds):
    docs = [(k, prose(rng, rng.randint(1, 40))) for k in range(150)]
    docs += [(200 + k, docs[k % 7][1]) for k in range(40)] + [(None, docs[0][1]), (5, docs[3][1]), (300, None), (301, " -- \n"), (302, "Ünï ñ漢 x9 X9\x7fx9")]
    items = [(k, prose(rng, rng.randint(1, 12))) for k in range(20)] + [(50, docs[0][1]), (50, "the the THE"), (51, None), (52, ""), (None, "hand with"), (53, "x9 Ünï absent"), (54, "ünï")]
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string"), shard, 40)
    found = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), 20, rounds)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert key(found.collect()) == key(by_hand(docs, items))


def test_order_puts_like_documents_together():
    rng = np.random.default_rng(4)
    topic = rng.integers(0, 4, 800)
    doc = np.repeat(np.arange(800), 20)
    term = topic[doc] * 100 + rng.integers(0, 100, len(doc))
    pairs = np.unique(doc * 400 + term)
    ranked = lexical.order(pairs // 400, pairs % 400, 800, 50)
    assert sorted(ranked) == list(range(800))
    pure = [np.bincount(topic[ranked[k : k + 50]]).max() / 50 for k in range(0, 800, 50)]
    assert np.mean(pure) > 0.85


def test_tree_tells_topics_apart(spark, rng):
    words = [["".join(rng.choice("abcdefgh"[t : t + 5]) for _ in range(4)) + str(t) for _ in range(60)] for t in range(4)]
    docs = [(k, " ".join(rng.choice(words[k % 4]) for _ in range(30))) for k in range(400)]
    tree = lexical.fit_tree(spark.createDataFrame(docs, "doc_id long, text string"))
    assert tree.weights.shape[1] <= lexical.MODEL_TERMS
    leaves = {}
    for k, text in docs:
        own = lexical.word_hashes(lexical.pa.array(sorted(set(text.split()))))
        leaf = int(tree.leaves(np.zeros(len(own), np.int64), own, 1)[0])
        leaves.setdefault(leaf >> lexical.LEVELS - 2, []).append(k % 4)
    assert all(max(map(own.count, range(4))) > 0.9 * len(own) for own in leaves.values())


def test_odd_rows(spark, odd_documents, no_documents):
    items = spark.createDataFrame([(1, "漢字 the кириллица"), (2, "x")], "item_id long, text string")
    docs = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    expected = by_hand(docs, [(1, "漢字 the кириллица"), (2, "x")])
    assert key(lexical.search(lexical.build_index(odd_documents), items.withColumn("term", items["item_id"])).collect()) == key(expected)
    assert lexical.search(lexical.build_index(no_documents), items).count() == 0
    assert lexical.search(lexical.build_index(odd_documents), items.limit(0)).count() == 0


def test_blocks_of_queries(spark, rng, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 3)
    docs = [(k, prose(rng, 20)) for k in range(60)]
    items = [(k, prose(rng, 5)) for k in range(10)]
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string"), 8)
    assert key(lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), 5).collect()) == key(by_hand(docs, items, 5))


def test_query_and_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    assert key(op11_lexical(spark, FOLDER).collect()) == key(con.execute(SQL_LEXICAL).fetchall())
