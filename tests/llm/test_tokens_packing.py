import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loamline.llm import packing, tokencount, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_chunked_ids_are_the_tokenizers():
    rng, plain = random.Random(1), Tokenizer.from_file(PATH)
    letters = list("aAbBéÉñ'sStTİß  \n\t.,!#*123_-Σσς漢字é") + ["<|endoftext|>", "'LL", " ", "\x85", "\x1c", "ǅ", "Å", "ﬁ", "\xa0", "ª"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    ids, at = tokens.tokenizer(PATH).encode(pa.array([*texts, None]))
    for k, text in enumerate(texts):
        assert list(ids[at[k] : at[k + 1]]) == plain.encode(text, add_special_tokens=False).ids
    assert at[-1] == at[-2]


def test_every_letter_of_the_block_and_every_case_pair_has_the_tokenizers_ids():
    plain = Tokenizer.from_file(PATH)
    points = [c for c in map(chr, range(0x250)) if c not in "\n "]
    points += [c for c in map(chr, range(0x250, 0x110000)) if not 0xD800 <= ord(c) < 0xE000 and (c.lower() != c or c.upper() != c)]
    texts = [f"{c}" for c in points] + [f"a{c}b {c}{c}1" for c in points]
    ids, at = tokens.tokenizer(PATH).encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert list(ids[at[k] : at[k + 1]]) == plain.encode(text, add_special_tokens=False).ids, ascii(text)


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 20 * tokens.WORD_BYTES)
    own = tokens.ChunkTokenizer(PATH)
    for k in range(30):
        own.encode(pa.array([f"word{k} other{k}"]))
    assert len(own.known) <= 25


def best_fill(counts, room):
    reach = {0}
    for n, c in counts.items():
        reach = {r + n * k for r in reach for k in range(c + 1) if r + n * k <= room}
    return max(reach)


def test_minimum_bin_slack_fills_best():
    rng = random.Random(2)
    for _ in range(40):
        counts = {rng.randint(1, 30): rng.randint(1, 5) for _ in range(6)}
        left = dict(counts)
        for use, repeats in packing.minimum_bin_slack(counts, 32):
            for k in range(repeats):
                if k == 0:
                    seed = max(n for n, c in left.items() if c)
                    rest = dict(left)
                    rest[seed] -= 1
                    assert sum(n * c for n, c in use.items()) == seed + best_fill(rest, 32 - seed)
                for n, c in use.items():
                    left[n] -= c
        assert not any(left.values())
    with pytest.raises(ValueError):
        packing.minimum_bin_slack({33: 1}, 32)


def test_pack_round_trip(spark, odd_documents):
    rows = [r.asDict() for r in packing.pack(odd_documents, PATH, capacity=64).collect()]
    plain = Tokenizer.from_file(PATH)
    by_sequence: dict = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by_sequence) <= sum(r["length"] for r in rows) / 64 + 2
    want = sorted(tuple(plain.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in odd_documents.collect() if r["doc_id"] != 1)
    got: dict = {}
    for r in rows:
        if r["doc_id"] not in (1, None, 5):
            got.setdefault(r["doc_id"], {})[r["start"]] = list(np.frombuffer(r["ids"], "<u4"))
    for d, pieces in got.items():
        assert tuple(x for s in sorted(pieces) for x in pieces[s]) in want, d
    assert sum(r["length"] for r in rows) == sum(len(plain.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in odd_documents.collect())


def test_empty_tables(no_documents):
    assert packing.pack(no_documents, PATH).count() == 0
    assert tokencount.token_counts(no_documents, PATH, 49407).count() == 0


def test_token_counts_by_separator_scan(odd_documents):
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    want = sorted((r["doc_id"] or -1, len(plain.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd_documents.collect())
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in tokencount.token_counts(odd_documents, PATH, 49407).collect()) == want


def test_scan_stitches_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokencount, "SCAN_GROUP", 3)
    rng, files, want = np.random.default_rng(0), [], []
    for k, n in enumerate([0, 1, 5, 100, 400]):
        ids = rng.integers(0, 4, n).astype("<u2")
        path = str(tmp_path / f"{k}.ids")
        ids.tofile(path)
        files.append((path, n))
        start = ordinal = 0
        for i in np.flatnonzero(ids == 3):
            want.append((path, ordinal, start, int(i) - start, True))
            start, ordinal = int(i) + 1, ordinal + 1
        if start < n:
            want.append((path, ordinal, start, n - start, False))
    found = tokencount.scan(spark.createDataFrame(files, "path string, ids long"), 3, block_ids=7)
    assert sorted(map(tuple, found.collect())) == sorted(want)
