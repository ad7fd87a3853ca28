"""Byte-level BPE of whole texts by a rank file, with the tiktoken library, and decoding back to raw bytes.

A text is cut where no match of the pattern can cross, so that a long one is encoded in bounded blocks; a run of white
space that would exhaust the pattern's backtracking is one match by rule and is merged without the pattern. Null text
is empty text and has no ids; every row of the input has one row of output, repeated rows as often as they come."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from loamline.llm.common import slices, tidy

BLOCK_CHARS = 1 << 16
#: Between a letter, digit or ASCII sign and plain white space, and between letters, digits and signs other than the apostrophe, no match crosses.
CUT = regex.compile(r"(?<=[\p{L}\p{N}!-~])(?=[ \t\r\n])|(?<=\p{L})(?=[\p{N}!-&(-/:-@\[-`{-~])|(?<=\p{N})(?=[\p{L}!-&(-/:-@\[-`{-~])")
LONG_SPACE = regex.compile(r"\s{%d,}" % BLOCK_CHARS)
_open: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    """The process's encoder of a rank file (a base64 token and its rank a line); workers are reused, and so is it."""
    if path not in _open:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _open[path] = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _open[path]


def blocks(text: str) -> Iterator[tuple[str, bool]]:
    """(part, whether it is a single match) of a text, in order."""
    at = 0
    for run in LONG_SPACE.finditer(text):
        past = run.end() - (run.end() < len(text))  # a run before other characters leaves its last one to the next match
        yield from ((part, False) for part in _cut(text[at : run.start()]))
        yield text[run.start() : past], True
        at = past
    yield from ((part, False) for part in _cut(text[at:]))


def _cut(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > BLOCK_CHARS and (found := CUT.search(text, at + BLOCK_CHARS)):
        yield text[at : found.start()]
        at = found.start()
    if at < len(text):
        yield text[at:]


def encode_text(encoder: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of a text, the same as of the library on the text as a whole where that can do it."""
    if len(text) <= BLOCK_CHARS:
        return encoder.encode_ordinary(text)
    return [i for part, single in blocks(text) for i in (encoder._encode_single_piece(part) if single else encoder.encode_ordinary(part))]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every document; other columns of ``docs``, whatever their names, are left out."""
    source = docs.select("doc_id", "text")
    out = StructType([source.schema["doc_id"], StructField("ids", ArrayType(IntegerType(), False))])

    @tidy
    def run(batches):
        encoder = encoding(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [encode_text(encoder, t) if t else [] for t in part.column("text").to_pylist()]
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate([np.array(x, np.int32) for x in ids]) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "ids"])

    return source.mapInArrow(run, out)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` (doc_id, ids) with ``decoded``, the raw bytes of the ids, which need not be valid text; null ids give null, an id without a rank fails."""
    source = rows.select("doc_id", "ids")
    out = StructType([*source.schema.fields, StructField("decoded", BinaryType())])

    @tidy
    def run(batches):
        encoder = encoding(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                decoded = [None if x is None else encoder.decode_bytes(x) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    return source.mapInArrow(run, out)
