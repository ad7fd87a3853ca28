"""Byte-level BPE against the library on whole texts, against merging by hand, and as a round trip."""

import hashlib
import random

import public_tokenizers
import pytest
import regex

from loamline.llm import bytebpe
from loamline.llm.queries import BYTE_RANKS, op13_byte_bpe

FOLDER = "/root/testdata/sf0.001"


def merged(ranks, piece: bytes) -> list[int]:
    """The plainest merge: again and again the adjacent pair of least rank, leftmost first."""
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda k: ranks.get(parts[k] + parts[k + 1], 1 << 40))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


@pytest.fixture(scope="module")
def encoder():
    return bytebpe.encoding(BYTE_RANKS)


def test_by_hand(encoder):
    ranks = encoder._mergeable_ranks
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["the", "él", " ", "  ", "\n", "'s", "'", "漢", "12", "!?", " ", "Ж", "x" * 30, "\x1c"]) for _ in range(rng.randint(0, 30)))
        expected = [i for m in regex.findall(public_tokenizers.PATTERN, text) for i in merged(ranks, m.encode())]
        assert bytebpe.encode_text(encoder, text) == expected


def test_blocks_change_nothing(encoder, monkeypatch):
    monkeypatch.setattr(bytebpe, "BLOCK_CHARS", 7)
    monkeypatch.setattr(bytebpe, "LONG_SPACE", regex.compile(r"\s{7,}"))
    rng = random.Random(2)
    pieces = ["the", "él", " ", "  ", "\n\n", "'s", "'", "'re", "漢字", "12", "!?", " ", "a1b2", "x.y", " " * 9, "\t" * 8, " " * 8, "\x1c", "́", "don't"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        assert "".join(p for p, _ in bytebpe.blocks(text)) == text
        assert bytebpe.encode_text(encoder, text) == encoder.encode_ordinary(text), text


def test_long_texts(encoder):
    for text in ("a" * 300_000, "word " * 60_000, " " * 3_000_000 + "x", "x" + "\n " * 1_000_000, "漢" * 100_000, "a1" * 100_000, "'s" * 100_000):
        ids = bytebpe.encode_text(encoder, text)
        assert encoder.decode_bytes(ids) == text.encode()
    spaced = "one two, three " * 20_000 + "\n" * 500
    assert bytebpe.encode_text(encoder, spaced) == encoder.encode_ordinary(spaced)


def test_odd_rows(spark, odd_documents, no_documents, encoder):
    docs = odd_documents.withColumnRenamed("node", "ids")
    out = bytebpe.decode(bytebpe.encode(docs, BYTE_RANKS), BYTE_RANKS).collect()
    texts = sorted((r["doc_id"] or -1, (r["text"] or "")) for r in docs.collect())
    assert sorted((r["doc_id"] or -1, bytes(r["decoded"]).decode()) for r in out) == texts
    assert all(r["ids"] == encoder.encode_ordinary(bytes(r["decoded"]).decode()) for r in out)
    assert bytebpe.encode(no_documents, BYTE_RANKS).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [220, 129])], "doc_id long, ids array<int>")
    assert [r["decoded"] and bytes(r["decoded"]) for r in bytebpe.decode(nulls, BYTE_RANKS).orderBy("doc_id").collect()] == [None, encoder.decode_bytes([220, 129])]


def test_query(spark, encoder):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    expected = set()
    for d in docs:
        ids, text = encoder.encode_ordinary(d["text"] or ""), (d["text"] or "").encode()
        expected.add((d["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
    assert {tuple(r) for r in op13_byte_bpe(spark, FOLDER).collect()} == expected
