"""Structure of token streams as Merkle hashes: a bracket's hash is that of what is in it, each part hashed once.

Comments are no tokens and white space between tokens does not count, so they change no hash; a definition's hash leaves out its own
name where it first stands, so a renamed definition keeps its hash, and one whose name it also uses inside does not."""

from __future__ import annotations

import bisect

import xxhash

from loamline.sources.lexer import Tokens

WIDTH = 64  #: bits of a hash


class Shapes:
    """Hashes over one file's tokens; in languages with blocks by indentation, how far a line is indented counts as a token."""

    def __init__(self, tokens: Tokens, content: str, indented: bool = False):
        self.t = tokens
        known: dict[str, bytes] = {}
        self.leaf = [known[x] if x in known else known.setdefault(x, xxhash.xxh64(x.encode()).digest()) for x in tokens.texts]
        self.group: dict[int, bytes] = {}  #: of each opening bracket, with what is in it
        self.indent: dict[int, int] = {}
        if indented:
            for i, start in enumerate(tokens.starts):
                if i == 0 or tokens.lines[i] > tokens.end_lines[i - 1]:
                    self.indent[i] = start - content.rfind("\n", 0, start) - 1
        open_: list[tuple[int, list[bytes]]] = []
        for i, kind in enumerate(tokens.kinds):
            if kind == "open" and tokens.close[i] > i:
                open_.append((i, [self.leaf[i]]))
                continue
            if open_:
                open_[-1][1].append(self.leaf[i])
            while open_ and tokens.close[open_[-1][0]] <= i:
                at, parts = open_.pop()
                self.group[at] = xxhash.xxh64(b"".join(parts)).digest()
                if open_:
                    open_[-1][1].append(self.group[at])

    def of(self, first: int, last: int, name: str | None) -> int:
        """Signed 64-bit hash of the tokens from first to last, brackets by their own hashes."""
        parts, i, base = [], first, self.indent.get(first, 0)
        while i <= last:
            if i in self.indent:
                parts.append(b"%d" % (self.indent[i] - base))
            if name is not None and self.t.texts[i] == name:
                name, i = None, i + 1
                parts.append(b"@")
                continue
            close = self.t.close[i]
            inside = i < close <= last and i in self.group and not self._names(i, close, name)
            parts.append(self.group[i] if inside else self.leaf[i])
            i = close + 1 if inside else i + 1
        value = xxhash.xxh64(b"\0".join(parts)).intdigest()
        return value - (1 << WIDTH) if value >> (WIDTH - 1) else value

    def _names(self, first: int, last: int, name: str | None) -> bool:
        """Whether a definition's name first stands in a bracket, such as the parts of a group; only short brackets before the name are looked into."""
        return name is not None and last - first < 64 and name in self.t.texts[first:last]

    def of_lines(self, first: int, last: int, name: str | None) -> int:
        """Hash of the tokens on some lines."""
        a, b = bisect.bisect_left(self.t.lines, first), bisect.bisect_right(self.t.lines, last)
        return self.of(a, b - 1, name)

    def groups(self, least: int) -> list[tuple[int, int, int, int, int | None]]:
        """(hash, first line, last line, tokens, hash of the group around) of the brackets of at least so many tokens."""
        out, around = [], []
        signed = lambda d: int.from_bytes(d, "big", signed=True)
        for i in sorted(self.group):
            while around and self.t.close[around[-1]] < i:
                around.pop()
            size = self.t.close[i] - i + 1
            if size >= least:
                out.append((signed(self.group[i]), self.t.lines[i], self.t.end_lines[self.t.close[i]], size, signed(self.group[around[-1]]) if around else None))
                around.append(i)
        return out
