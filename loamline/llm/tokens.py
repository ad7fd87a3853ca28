"""Exact, cached tokenisation of Arrow text batches.

The vocabulary used here lowers case, drops white space and never lets a token cross it, so a text's ids are those of
its white-space separated chunks, one after another. Chunks are split into pre-tokens, each of which is encoded once per process, and ids are gathered by code.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from loamline.llm.common import ragged

CACHE_BYTES = 64 << 20
WORD_BYTES = 200  #: what a kept pre-token takes besides its characters: string and number objects, a place in the table
#: The vocabulary's own split pattern (a line feed ends a chunk), and the characters that byte-level vocabularies write bytes as.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n")
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Letters of the block whose lower case lies beyond it.
LEAVING = "".join(c for c in map(chr, range(0x80, 0x250)) if max(map(ord, c.lower())) > 0x24F)
#: Beyond this block normal forms and case mapping need the tokenizer itself; so may the strings of special tokens.
UNSURE = np.isin(np.arange(0x251), [0x250, *map(ord, LEAVING)])
SPECIAL = "<|"


def unsure_lines(joined: str) -> list[int]:
    """Numbers of the lines of a text that need the whole tokenizer."""
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    odd = UNSURE[np.minimum(points, 0x250)]
    if SPECIAL in joined:
        odd[:-1] |= (points[:-1] == ord(SPECIAL[0])) & (points[1:] == ord(SPECIAL[1]))
    at = np.flatnonzero(odd)
    return np.unique(np.searchsorted(np.flatnonzero(points == 10), at)).tolist() if len(at) else []


def _byte_chars() -> dict[int, str]:
    hidden = iter(range(0x100, 0x200))
    one = [chr(b) if b in PRINTED else chr(next(hidden)) for b in range(256)]
    return {c: "".join(one[b] for b in chr(c).encode()) for c in range(0x250)}


BYTE_CHARS = _byte_chars()
_open: dict[tuple[str, bool], ChunkTokenizer] = {}


class ChunkTokenizer:
    """Ids of many texts at once. Ids of pre-tokens are kept, in about ``CACHE_BYTES``, beyond which the store begins anew."""

    def __init__(self, path: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain  # strings of special tokens in a text are then ordinary text
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {"\n": 0}
        self.flat = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)
        self.lengths = np.zeros(1, np.int64)
        self.held = 0

    def _keep_only(self, pieces: set[str]) -> None:
        """Begin the store anew with those of ``pieces`` that are in it."""
        kept = [p for p in pieces if p != "\n" and p in self.known]
        index = np.fromiter(map(self.known.__getitem__, kept), np.int64, len(kept))
        lengths = self.lengths[index]
        ends = np.cumsum(lengths)
        flat = self.flat[np.repeat(self.starts[index] - (ends - lengths), lengths) + np.arange(ends[-1] if len(kept) else 0)]
        self.reset()
        self.known |= {p: k for k, p in enumerate(kept, 1)}
        self.flat, self.starts, self.lengths = flat, np.append(self.starts, ends - lengths), np.append(self.lengths, lengths)
        self.held = WORD_BYTES * len(kept) + sum(map(len, kept)) + 4 * len(flat)

    def _add(self, pieces: list[str], encode) -> None:
        ids, lengths = [], np.zeros(len(pieces), np.int64)
        for k, piece in enumerate(pieces):
            own = encode(piece)
            ids += own
            lengths[k] = len(own)
            self.known[piece] = len(self.known)
            self.held += WORD_BYTES + len(piece) + 4 * len(own)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, np.array(ids, np.uint32)])

    def _word(self, word: str) -> list[int]:
        plain = word.isascii() and word.isprintable()  # such bytes are written as themselves
        return [t.id for t in self.tokenizer.model.tokenize(word if plain else word.translate(BYTE_CHARS))]

    def _whole(self, chunk: str) -> list[int]:
        """Of a chunk that needs the whole tokenizer; it is kept under its text and a line feed, which no pre-token has."""
        return self.tokenizer.encode(chunk[:-1], add_special_tokens=False).ids

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of the chunks, lengths)."""
        joined = "\n".join(chunks) + "\n"
        odd = {k: chunks[k] + "\n" for k in unsure_lines(joined)}
        if odd:
            for k in odd:
                chunks[k] = ""
            joined = "\n".join(chunks) + "\n"
        pieces = WORDS.findall(joined.lower())
        distinct = set(pieces)
        if self.held > CACHE_BYTES:
            self._keep_only(distinct)
        new = distinct.difference(self.known)
        self._add(list(new), self._word)
        self._add(list(set(odd.values()).difference(self.known)), self._whole)
        index = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        ends = np.flatnonzero(index == 0)
        if odd:
            index[ends[list(odd)]] = [self.known[c] for c in odd.values()]
        lengths = self.lengths[index]
        upto = np.cumsum(lengths)
        source = np.repeat(self.starts[index] - (upto - lengths), lengths) + np.arange(upto[-1])
        return self.flat[source], np.diff(upto[ends], prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets of each text in them); null is empty text."""
        spaced = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        codes, names, offsets = ragged(pc.split_pattern(spaced, " "))
        if not len(names):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        flat, sizes = self._chunks(names.to_pylist())
        lengths = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        source = np.repeat((np.cumsum(sizes) - sizes)[codes] - ends[:-1], lengths) + np.arange(ends[-1])
        return flat[source], ends[offsets]


def tokenizer(path: str, plain: bool = False) -> ChunkTokenizer:
    """The process's tokenizer for a vocabulary file; workers are reused, and so is its cache."""
    if (path, plain) not in _open:
        _open[path, plain] = ChunkTokenizer(path, plain)
    return _open[path, plain]
