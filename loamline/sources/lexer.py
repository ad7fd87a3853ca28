"""Tokens of source files: one pass from left to right, with a stack of brackets that also ends strings with code inside."""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from dataclasses import dataclass, field

HASH_COMMENTS = {"python", "ruby", "bash", "elixir", "php", "make", "dockerfile"}
SLASH_COMMENTS_TOO = {"php"}
NESTED_COMMENTS = {"rust", "swift", "kotlin", "scala"}
SCRIPTS = {"javascript", "typescript", "tsx"}
PARTNER = {")": "(", "]": "[", "}": "{"}

# Forms of strings by language, tried in order; a string that may not run over a line ends with it.
LINE_STRING = r'"(?:\\.|[^"\\\n])*"'
TEXT_STRING = r'"(?:\\[\s\S]|[^"\\])*"'
STRINGS = {
    "rust": [r'[bc]?r(?P<h>#*)"[\s\S]*?"(?P=h)', "[bc]?" + TEXT_STRING, r"b?'(?:\\[^\n]{1,10}?|[^'\\\n])'"],
    "go": [r"`[^`]*`", LINE_STRING, r"'(?:\\[^\n]{1,10}?|[^'\\\n])'"],
    "python": [r"(?:[rRbBuUfF]{0,3})(?P<h>\"\"\"|''')[\s\S]*?(?P=h)", r"[rRbBuUfF]{0,3}" + LINE_STRING, r"[rRbBuUfF]{0,3}'(?:\\.|[^'\\\n])*'"],
    "c": [r'(?:u8|[uUL])?R"(?P<h>[^\s()\\]{0,16})\([\s\S]*?\)(?P=h)"', LINE_STRING, r"'(?:\\[^\n]{1,10}?|[^'\\\n])'"],
    "csharp": [r'"""[\s\S]*?"""', r'(?:\$@|@\$|@)"(?:""|[^"])*"', r"\$?" + LINE_STRING, r"'(?:\\[^\n]{1,10}?|[^'\\\n])'"],
    "java": [r'"""[\s\S]*?"""', LINE_STRING, r"'(?:\\[^\n]{1,10}?|[^'\\\n])'"],
    "swift": [r'(?P<h>#*)"""[\s\S]*?"""(?P=h)', r'(?P<i>#+)"[^\n]*?"(?P=i)', LINE_STRING],
    "elixir": [r'"""[\s\S]*?"""', TEXT_STRING, r"'(?:\\[\s\S]|[^'\\])*'", r"~[a-zA-Z](?:\"[^\"]*\"|'[^']*'|/(?:\\.|[^/\\])*/|\([^)]*\)|\[[^\]]*\]|\{[^}]*\})"],
    "ruby": [r"<<[-~](?P<h>['\"]?)(?P<i>[A-Z_]\w*)(?P=h)[^\n]*\n(?:[^\n]*\n)*?[ \t]*(?P=i)\b", TEXT_STRING, r"'(?:\\[\s\S]|[^'\\])*'", r"`[^`]*`"],
    "bash": [r"<<-?[ \t]*(?P<h>['\"]?)(?P<i>\w+)(?P=h)[^\n]*\n(?:[^\n]*\n)*?[ \t]*(?P=i)\b", TEXT_STRING, r"'[^']*'"],
    "php": [r"<<<[ \t]*(?P<h>['\"]?)(?P<i>\w+)(?P=h)[^\n]*\n(?:[^\n]*\n)*?[ \t]*(?P=i)\b", TEXT_STRING, r"'(?:\\[\s\S]|[^'\\])*'"],
    "javascript": [LINE_STRING, r"'(?:\\(?:.|\n)|[^'\\\n])*'"],
}
SAME_STRINGS = {"typescript": "javascript", "tsx": "javascript", "kotlin": "java", "scala": "java", "cpp": "c"}
NAMES = {"php": r"\$?[A-Za-z_]\w*", "ruby": r"[@$]{0,2}[A-Za-z_]\w*[?!]?(?!=[^=~>])|[@$]{0,2}[A-Za-z_]\w*", "elixir": r"@?[A-Za-z_]\w*[?!]?", "bash": r"[A-Za-z_][\w-]*"}
OPERATOR = r"\.\.\.|=>|->|::|\?\.|&&|\|\||[=!<>]=|[-+*/%&|^]=|\.\.|[^\s]"
PATTERN_LITERAL = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
TEMPLATE = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])*(`|\$\{|\Z)")
#: After these words a slash begins a pattern, not a division.
BEFORE_VALUE = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield", "instanceof"}


DIRECTIVES = {"c", "cpp", "csharp"}
DIRECTIVE = re.compile(r"(?:\\\r?\n|[^\n])*")
LINE_FEED, SPACE = re.compile("\n"), re.compile(r"\s*")


@dataclass
class Tokens:
    """Kind, text and place of each token; ``close`` has the partner of an opening bracket, the last token where it has none."""

    kinds: list[str] = field(default_factory=list)  #: name, number, string, pre (a directive), open, close, op
    texts: list[str] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    lines: list[int] = field(default_factory=list)  #: from 1, where a token begins
    end_lines: list[int] = field(default_factory=list)  #: where it ends
    close: list[int] = field(default_factory=list)
    hidden: list[tuple[int, int]] = field(default_factory=list)  #: spans of comments and strings


@functools.cache
def _pattern(lang: str) -> re.Pattern:
    strings = STRINGS.get(SAME_STRINGS.get(lang, lang), [LINE_STRING, r"'(?:\\.|[^'\\\n])*'"])
    numbered = [re.sub(r"\(\?P([<=])(\w)", lambda m, k=k: f"(?P{m[1]}{m[2]}{k}", s) for k, s in enumerate(strings)]
    comments = []
    if lang in HASH_COMMENTS:
        comments.append(r"#(?!\[)[^\n]*" if lang == "php" else r"(?<!\$)(?<!\$\{)#[^\n]*" if lang == "bash" else "#[^\n]*")
    if lang not in HASH_COMMENTS or lang in SLASH_COMMENTS_TOO:
        comments += [r"//[^\n]*", r"/\*" if lang in NESTED_COMMENTS else r"/\*[\s\S]*?(?:\*/|\Z)"]
    name = NAMES.get(lang, r"#?[A-Za-z_$\u0080-\U0010ffff][\w$]*" if lang in SCRIPTS else r"[A-Za-z_$\u0080-\U0010ffff][\w$]*")
    word, quoted = f"(?P<name>{name})", f"(?P<string>{'|'.join(numbered)})"
    prefixed = lang in ("rust", "python", "c", "cpp", "elixir")  # a string may begin with letters there
    lifetime = r"|(?P<lifetime>'\w+)" if lang == "rust" else ""
    template = "|(?P<template>`)" if lang in SCRIPTS else ""
    return re.compile(
        rf"(?:(?P<open>[(\[{{])|(?P<close>[)\]}}])|(?P<mark>[,;])|{quoted if prefixed else word}|(?P<comment>{'|'.join(comments)})|{word if prefixed else quoted}"
        rf"{template}{lifetime}|(?P<number>\d[\w.]*)|(?P<op>{OPERATOR}))\s*"
    )


def _nested_comment(content: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(content, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(content)


def tokens(content: str, lang: str) -> Tokens:
    """Tokens of a file; what the language's forms do not know is an operator of one character, so every text has tokens."""
    out, matches, pos, size = Tokens(), _pattern(lang).finditer, 0, len(content)
    stack: list[int] = []  # places of open brackets; a template's are counted as -1 - place
    kinds, texts, starts, ends, hidden, close = out.kinds, out.texts, out.starts, out.ends, out.hidden, {}
    scripts, directives, slashes = lang in SCRIPTS, lang in DIRECTIVES, lang in SCRIPTS or lang in DIRECTIVES

    def add(kind: str, start: int, end: int) -> None:
        kinds.append(kind)
        texts.append(content[start:end])
        starts.append(start)
        ends.append(end)

    def template(start: int, at: int) -> int:
        """Text of a template from ``at`` on, as one string; code in it opens a bracket."""
        m = TEMPLATE.match(content, at)
        code = m[1] == "${"
        past = m.end() - 2 if code else m.end()
        add("string", start, past)
        hidden.append((start, past))
        if code:
            stack.append(-1 - len(kinds))
            add("open", past, past + 2)
            texts[-1] = "{"
        return m.end()

    while (pos := SPACE.match(content, pos).end()) < size:
        for m in matches(content, pos):
            kind, group = m.lastgroup, m.lastindex
            start, pos = m.span(group)
            if kind == "name":
                kinds.append(kind)
                texts.append(m[group])
                starts.append(start)
                ends.append(pos)
            elif kind == "mark":
                kinds.append("op")
                texts.append(m[group])
                starts.append(start)
                ends.append(pos)
            elif kind == "op":
                text = m[group]
                if slashes:
                    if scripts and text in ("/", "/=") and (not kinds or kinds[-1] in ("op", "open") or kinds[-1] == "name" and texts[-1] in BEFORE_VALUE) and (found := PATTERN_LITERAL.match(content, start)):
                        pos = found.end()
                        hidden.append((start, pos))
                        add("string", start, pos)
                        break  # tokens go on behind it
                    if directives and text == "#" and not content[content.rfind("\n", 0, start) + 1 : start].strip():
                        pos = DIRECTIVE.match(content, start).end()
                        add("pre", start, pos)
                        break
                kinds.append(kind)
                texts.append(text)
                starts.append(start)
                ends.append(pos)
            elif kind == "open":
                stack.append(len(kinds))
                add(kind, start, pos)
            elif kind == "close":
                partner = PARTNER[m[group]]
                at = len(stack) - 1 if stack and stack[-1] >= 0 and texts[stack[-1]] == partner else next((k for k in range(len(stack) - 1, max(-1, len(stack) - 4), -1) if texts[stack[k] if stack[k] >= 0 else -1 - stack[k]] == partner), None)
                add(kind, start, pos)
                if at is not None:  # brackets that were left open inside end here too
                    inside = stack[at] < 0
                    for k in stack[at:]:
                        close[k if k >= 0 else -1 - k] = len(kinds) - 1
                    del stack[at:]
                    if inside:
                        pos = template(pos, pos)
                        break
            elif kind == "number":
                add(kind, start, pos)
            elif kind == "string":
                hidden.append((start, pos))
                add(kind, start, pos)
            elif kind == "comment":
                nested = m[group] == "/*"
                if nested:
                    pos = _nested_comment(content, start)
                hidden.append((start, pos))
                if nested:
                    break
            elif kind == "template":
                pos = template(start, pos)
                break
            else:
                add("op", start, pos)  # a lifetime
        else:
            break
    for k in stack:
        close[k if k >= 0 else -1 - k] = len(kinds) - 1
    out.close = [-1] * len(kinds)
    for k, partner in close.items():
        out.close[k] = partner
    breaks = [m.start() for m in LINE_FEED.finditer(content)]
    out.lines = [bisect_left(breaks, k) + 1 for k in starts]
    out.end_lines = out.lines.copy()
    for i, kind in enumerate(kinds):
        if (kind == "string" or kind == "pre") and "\n" in texts[i]:
            out.end_lines[i] = bisect_left(breaks, ends[i]) + 1
    return out


def blank(content: str, lang: str) -> str:
    """The content with comments and strings replaced by spaces; line feeds stay, so lines keep their numbers."""
    parts, at = [], 0
    for start, end in tokens(content, lang).hidden:
        parts += [content[at:start], re.sub(r"[^\n]", " ", content[start:end])]
        at = max(at, end)
    return "".join([*parts, content[at:]])


def identifiers(content: str, lang: str) -> list[str]:
    """Distinct identifiers of a content, comments and strings left out."""
    return sorted(set(re.findall(r"[A-Za-z_$][\w$]*", blank(content, lang))))
