"""Definitions, imports and calls of a token stream: one pass with a stack of open scopes, in time linear in the tokens.

At each place where a statement may begin the reader tries the heads that the language has; a head that opens a block pushes a
scope, which its closing bracket ends. Nothing is read twice: brackets are jumped by their partners."""

from __future__ import annotations

from collections.abc import Collection
from typing import NamedTuple

from loamline.sources.lexer import SCRIPTS, tokens
from loamline.sources.shapes import Shapes

# Words of the languages that begin definitions, with the kinds that they define, and words before these.
KEYWORDS = {
    "rust": {"fn": "function", "struct": "struct", "union": "struct", "enum": "enum", "trait": "trait", "impl": "impl", "mod": "module", "const": "constant", "static": "constant", "type": "type"},
    "go": {"func": "function", "type": "type", "const": "constant", "var": "constant"},
    "javascript": {"function": "function", "class": "class", "interface": "interface", "enum": "enum", "type": "type", "namespace": "module", "module": "module", "const": "variable", "let": "variable", "var": "variable"},
    "java": {"class": "class", "record": "class", "interface": "interface", "enum": "enum"},
    "kotlin": {"class": "class", "object": "class", "interface": "interface", "fun": "function", "val": "property", "var": "property", "typealias": "type"},
    "scala": {"class": "class", "object": "class", "trait": "trait", "enum": "enum", "def": "function", "val": "property", "var": "property", "type": "type"},
    "csharp": {"class": "class", "record": "class", "struct": "struct", "interface": "interface", "enum": "enum", "namespace": "module"},
    "c": {"struct": "struct", "enum": "enum", "union": "struct"},
    "cpp": {"struct": "struct", "enum": "enum", "union": "struct", "class": "class", "namespace": "module"},
    "php": {"function": "function", "class": "class", "interface": "interface", "trait": "trait", "enum": "enum", "const": "constant"},
    "swift": {"func": "function", "init": "function", "deinit": "function", "class": "class", "actor": "class", "extension": "class", "struct": "struct", "enum": "enum", "protocol": "interface", "var": "property", "let": "property", "typealias": "type"},
    "ruby": {"def": "function", "class": "class", "module": "module"},
    "elixir": {"def": "function", "defp": "function", "defmacro": "function", "defmacrop": "function", "defmodule": "module", "defprotocol": "interface", "defimpl": "impl"},
    "bash": {"function": "function"},
}
MODIFIERS = {
    "rust": "pub default async unsafe extern",
    "go": "",
    "javascript": "export default declare abstract async public private protected static readonly override accessor get set",
    "java": "public private protected static final abstract sealed default synchronized native strictfp transient volatile",
    "kotlin": "public private protected internal open abstract final sealed data inner enum annotation companion override suspend inline tailrec operator infix external const lateinit value expect actual",
    "scala": "private protected implicit lazy final sealed abstract override case inline given open",
    "csharp": "public private protected internal static abstract sealed partial override virtual async readonly extern unsafe new file required",
    "c": "typedef static extern inline const",
    "cpp": "typedef static extern inline constexpr virtual explicit friend const",
    "php": "public private protected static abstract final readonly",
    "swift": "public private internal open fileprivate static final override mutating nonmutating class lazy weak required convenience indirect",
    "ruby": "",
    "elixir": "",
    "bash": "",
}
MODIFIERS = {k: set(v.split()) for k, v in MODIFIERS.items()}
INDENTED = {"python"}
NEWLINE_ENDS = {"go", "javascript", "kotlin", "scala", "swift", "bash", "ruby", "elixir"}
#: Languages whose members have no word in front of their names.
BARE_MEMBERS = {"java", "csharp", "c", "cpp", "javascript"}
CONTAINERS = {"class", "struct", "enum", "trait", "impl", "module", "interface"}
NOT_CALLS = set(
    "if for while switch match return catch function fn def func elif else in and or not with assert except lambda typeof sizeof await yield new class struct enum impl pub use let const var async super case when unless until end loop unsafe where throw delete do using lock foreach instanceof alignof decltype elsif defined synchronized".split()
)
GOES_ON = set("= + - * / % & | ^ ! ~ < > , . ? : ( [ && || -> => :: ?. == != <= >= += -= *= /= %= &= |= ^= .. in of instanceof extends implements with where as else return".split())
CONTINUES = set("= + - * / % & | ^ > . ? : && || -> => :: ?. == != <= >= += -= ) ] , extends implements with where else instanceof".split())
MARKS = set("# @ [ template".split())  #: what attributes and annotations begin with
BEFORE_FRESH = set("{ } ; , )".split())  #: tokens that a statement may follow on a line
BEFORE_CALLED = set("( ! :: < ?.".split())  #: tokens that may follow the name in a call
RUBY_OPENERS, RUBY_LOOPS = {"if", "unless", "case", "begin"}, {"while", "until", "for"}


ALL_ROWS = frozenset(("symbol", "import", "call"))


class Scope(NamedTuple):
    past: int  #: token that ends it
    kind: str  #: file, container, function, or block
    name: str | None


class Reader:
    """One file's rows; ``lang`` is a language of ``KEYWORDS`` or one that shares its forms."""

    def __init__(self, content: str, lang: str, shapes: bool = True, wanted: Collection[str] = ALL_ROWS):
        self.content, self.lang, self.wanted = content, lang, wanted
        self.kin = "javascript" if lang in SCRIPTS else lang
        self.t = tokens(content, lang)
        self.kinds, self.texts, self.lines, self.close = self.t.kinds, self.t.texts, self.t.lines, self.t.close
        self.n = len(self.kinds)
        self.shapes = Shapes(self.t, content, lang in INDENTED) if shapes else None
        self.scopes = [Scope(self.n, "file", None)]
        self.symbols: list[dict] = []
        self.imports: list[dict] = []
        self.named = bytearray(self.n + 1)  # names that are no calls
        self.functions: list[tuple[int, int, str]] = []
        self.raw: list[str] | None = None
        self.angles: dict[int, int] = {}
        self.marked = -1  # a statement may begin here, after a mark such as an attribute

    # -- tokens

    def text(self, i: int) -> str:
        return self.texts[i] if 0 <= i < self.n else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < self.n and self.kinds[i] == "name"

    def past(self, i: int) -> int:
        """Token after the one at i, or after the bracket that it opens."""
        return (self.close[i] if self.close[i] >= i else i) + 1

    def past_angles(self, i: int) -> int:
        """Token after a list in angle brackets that begins at i; i where none does. What is found for lists inside is kept."""
        if i >= self.n or i < 0 or self.texts[i] != "<":
            return i
        if i in self.angles:
            return self.angles[i]
        open_, j = [], i
        while j < self.n:
            x = self.texts[j]
            if x == "<":
                open_.append(j)
            elif x == ">":
                self.angles[open_.pop()] = j + 1
                if not open_:
                    return j + 1
            elif x in (";", "}", ")") or x == "{" and self.kin != "javascript":
                break
            j = self.past(j) if x in ("(", "[", "{") else j + 1
        self.angles.update(zip(open_, open_, strict=True))
        return i

    def find(self, i: int, stops: set[str] | tuple[str, ...]) -> int:
        """First token from i on that is one of ``stops``, brackets before it jumped."""
        while i < self.n and self.texts[i] not in stops:
            if self.kinds[i] == "close":
                return i
            i = self.past(i)
        return min(i, self.n)

    def breaks(self, i: int) -> bool:
        """Whether a line ends before the token at i and the statement with it."""
        if i <= 0 or i >= self.n or self.lines[i] == self.t.end_lines[i - 1]:
            return i >= self.n
        return not (self.kinds[i - 1] != "close" and self.texts[i - 1] in GOES_ON and self.kinds[i - 1] != "string") and self.texts[i] not in CONTINUES

    def statement_end(self, i: int) -> int:
        """Last token of the statement at i."""
        j = i
        while j < self.n:
            if self.kinds[j] == "close":
                return j - 1
            if self.texts[j] == ";":
                return j
            j = self.past(j)
            if self.kin in NEWLINE_ENDS and self.breaks(j):
                return j - 1
        return self.n - 1

    def fresh(self, i: int) -> bool:
        if i == 0 or i == self.marked or self.kinds[i - 1] == "pre":
            return True
        before = self.texts[i - 1]
        if before in ("{", "}", ";") and self.kinds[i - 1] != "string":
            return True
        if self.kin in NEWLINE_ENDS and self.lines[i] > self.t.end_lines[i - 1]:
            return self.breaks(i)
        if before == "," and self.kin == "javascript":
            return self.scopes[-1].kind == "block"
        if before == ")" and self.kin in ("c", "cpp"):  # after a macro's use without an end
            return self.scopes[-1].kind in ("file", "module") and self.kinds[i] == "name" and self.content[self.t.starts[i] - 1] == "\n"
        return False

    # -- rows

    def owner(self) -> str | None:
        return next((s.name for s in reversed(self.scopes) if s.kind in ("container", "module") and s.name), None)

    def inside_function(self) -> bool:
        return any(s.kind == "function" for s in self.scopes)

    def symbol(self, kind: str, name: str, first: int, last: int, at: int | None = None, owner: str | None = None, implements: list[str] | None = None, head: int | None = None, exported: bool | None = None) -> None:
        """A definition from token ``first`` to ``last``; its signature ends before token ``head``, else with the first line."""
        last = max(first, min(last, self.n - 1))
        if at is not None:
            self.named[at] = 1
        if kind in ("function", "method"):
            self.functions.append((first, last, name))
        if "symbol" not in self.wanted:
            self.symbols.append({"row": "symbol"})  # it has its place in the order of rows
            return
        start = self.t.starts[first]
        if head is None or head <= first:
            end = self.content.find("\n", start)
            end = min(len(self.content) if end < 0 else end, self.t.ends[last])
        else:
            end = self.t.ends[head - 1]
        if exported is None:
            words = self.texts[first : first + 4]
            exported = "pub" in words or "export" in words or "public" in words or self.kin == "go" and name[:1].isupper()
        doc, row = None, self.lines[first] - 1
        if row and not self.content[self.content.rfind("\n", 0, start) + 1 : start].strip():
            if self.raw is None:
                self.raw = self.content.split("\n")
            before = self.raw[row - 1].strip()
            doc = before if before.startswith(("///", "*/", "# ", "// ")) else None
        self.symbols.append({
            "row": "symbol", "kind": "method" if kind == "function" and owner else kind, "name": name, "parent": owner, "start_line": self.lines[first], "end_line": self.t.end_lines[last],
            "signature": " ".join(self.content[start:end].split()).rstrip("{ ").rstrip(), "exported": bool(exported), "implements": implements or [], "doc": doc,
            "shape": self.shapes.of(first, last, name) if self.shapes else None,
        })

    def define(self, kind: str, name: str, first: int, at: int, body: int, owner: str | None, implements: list[str] | None = None) -> int:
        """A definition whose block is at ``body``; the next token to look at is the first in it."""
        self.symbol(kind, name, first, self.close[body], at, owner, implements, body)
        if self.kin == "rust":
            self.named[first:body] = b"\1" * (body - first)  # types such as Fn(u8)
        what = "module" if kind == "module" else "container" if kind in CONTAINERS else "function"
        self.scopes.append(Scope(self.close[body], what, None if what == "function" or what == "module" and self.kin in ("cpp", "csharp", "php") else name))
        return body + 1

    def imported(self, source: str, first: int, last: int) -> int:
        self.imports.append({"row": "import", "source": source, "name": source, "start_line": self.lines[first]})
        self.named[first : last + 1] = b"\1" * (last + 1 - first)
        return last + 1

    # -- heads

    def run(self) -> list[dict]:
        head = {"rust": self.rust, "go": self.go, "javascript": self.script, "ruby": self.worded, "elixir": self.worded, "bash": self.shell}.get(self.kin, self.braced)
        i, n, scopes, texts, kinds, lines, end_lines = 0, self.n, self.scopes, self.texts, self.kinds, self.lines, self.t.end_lines
        by_line, blocks, script = self.kin in NEWLINE_ENDS, self.kin not in ("ruby", "elixir"), self.kin == "javascript"
        while i < n:
            while scopes[-1].past <= i and len(scopes) > 1:
                scopes.pop()
            may = i == 0 or i == self.marked or texts[i - 1] in BEFORE_FRESH or by_line and lines[i] > end_lines[i - 1] or kinds[i - 1] == "pre"
            if may and self.fresh(i) and (past := head(i)) is not None:
                i = max(past, i + 1)
                continue
            x = texts[i]
            if x == "class" and script and self.text(i - 1) in ("=", "(", "return", ",", ":") and (past := self.script_class(i, i)) is not None:
                i = past
                continue
            if x == "{" and blocks and kinds[i] == "open":
                scopes.append(Scope(self.close[i], "block", None))
            i += 1
        calls = self.calls() if "call" in self.wanted or script and "import" in self.wanted else []
        return [*self.symbols, *self.imports, *calls]

    def marks(self, i: int) -> int:
        """Token after attributes and annotations at i, the names in which are no calls."""
        while i < self.n and self.texts[i] in MARKS:
            j = i
            if self.text(i) == "#" and self.text(i + 1) in ("[", "!") and self.kin in ("rust", "php"):
                j = self.past(i + 1 + (self.text(i + 1) == "!"))
            elif self.text(i) == "@" and self.is_name(i + 1) and self.text(i + 1) != "interface":
                j = i + 2
                while self.text(j) == "." and self.is_name(j + 1):
                    j += 2
                self.named[j - 1] = 1
                if self.text(j) == "(" and self.lines[j] == self.t.end_lines[j - 1]:
                    j = self.past(j)
                return self.marks(j)
            elif self.text(i) == "[" and self.kin == "csharp" and self.kinds[i] == "open":
                j = self.past(i)
            elif self.text(i) == "template" and self.kin == "cpp":
                j = self.past_angles(i + 1)
            if j <= i:
                return i
            self.named[i:j] = b"\1" * (j - i)
            i = j
        return i

    def modifiers(self, i: int) -> int:
        own = MODIFIERS[self.kin]
        while True:
            j = self.marks(i)
            if j < self.n and self.texts[j] in own and self.kinds[j] == "name" and not (self.text(j + 1) in ("(", ":", "=", ",", ";") and self.texts[j] not in ("pub", "private", "protected")):
                following = self.text(j + 1)
                if self.kin == "swift" and self.texts[j] == "class" and following not in ("func", "var", "let"):
                    return j
                if self.kin == "javascript" and self.lines[j + 1 if j + 1 < self.n else j] > self.lines[j] and self.texts[j] in ("async", "get", "set", "static", "declare", "abstract"):
                    return j
                j += 1
                if self.text(j) == "(" and self.texts[j - 1] in ("pub", "private", "internal", "public", "fileprivate"):
                    j = self.past(j)
                elif self.text(j) == "[" and self.kin == "scala":
                    j = self.past(j)
                elif self.kinds[j] == "string" if j < self.n else False:  # extern "C"
                    j += self.texts[j - 1] == "extern"
            if j == i:
                return i
            i = j

    def bases(self, i: int, stop: int, words: tuple[str, ...]) -> list[str]:
        """Names, without type arguments, in the lists that ``words`` begin between i and stop; the last part of a dotted name."""
        out: list[str] = []
        on = False
        while i < stop:
            x = self.texts[i]
            if x in words:
                on = True
            elif x in ("where", "permits"):
                on = False
            elif on and self.kinds[i] == "name" and x not in ("public", "private", "protected", "virtual", "by", "extends", "implements", "with"):
                if self.text(i + 1) not in (".", "::"):
                    out.append(x)
                j = self.past_angles(i + 1)
                i = j - 1 if j > i + 1 else i
            i = self.past(i)
        return out

    def rust(self, i: int) -> int | None:
        first = self.marks(i)
        if first > i:
            self.marked = first
            return first
        j = self.modifiers(i)
        x = self.text(j)
        if x == "const" and self.text(j + 1) in ("fn", "unsafe", "async", "extern"):
            j = self.modifiers(j + 1)
            x = self.text(j)
        if x == "use":
            end = self.find(j, (";",))
            words = self.content[self.t.ends[j] : self.t.starts[end] if end < self.n else len(self.content)]
            return self.imported(" ".join(words.split("{")[0].split()).removesuffix("::").rstrip(), i, min(end, self.n - 1))
        if x == "macro_rules" and self.text(j + 1) == "!":
            end = self.find(j, ("{", "(", "[", ";"))
            end = self.past(end) if end < self.n else end
            self.named[i:end] = b"\1" * (end - i)
            return end
        kind = KEYWORDS["rust"].get(x)
        if kind is None:
            return None
        if x == "impl":
            k = self.past_angles(j + 1)
            body = self.find(k, ("{", ";"))
            target, trait = k, None
            m = k
            while m < body and self.texts[m] != "where":
                if self.texts[m] == "for" and self.text(m + 1) != "<":
                    trait = "".join(self.texts[k:m])
                    target = m + 1
                m = self.past_angles(m) if self.texts[m] == "<" and self.past_angles(m) > m else self.past(m)
            name = None
            while target < m:
                if self.kinds[target] == "name" and self.texts[target] not in ("dyn", "mut", "const"):
                    name, at = self.texts[target], target
                    if self.text(target + 1) != "::" or self.text(target + 2) == "<":
                        break
                elif name is None and self.texts[target] == "[":
                    name, at = "[]", target
                    break
                target += 1
            if name is None or self.text(body) != "{":
                return None
            trait = trait.split("<")[0].lstrip("!") if trait else None
            return self.define("impl", name, i, at, body, None, [trait] if trait else [])
        at = j + 1 + (self.text(j + 1) == "mut")
        if not self.is_name(at) or x == "union" and not self.is_name(at):
            return None
        name, owner = self.texts[at], self.owner()
        if kind in ("constant", "type"):
            end = self.find(at, (";",))
            if not (kind == "constant" and self.inside_function()):
                self.symbol(kind, name, i, end, at, owner)
            return None if kind == "constant" else end + 1
        body = self.find(at, ("{", ";"))
        if self.text(body) == "{":
            return self.define(kind, name, i, at, body, owner)
        self.symbol(kind, name, i, body, at, owner)
        return body + 1

    def go(self, i: int) -> int | None:
        x = self.text(i)
        if x in ("import", "type", "const", "var"):
            self.named[i] = 1
        if x == "import":
            if self.text(i + 1) == "(":
                end = self.close[i + 1]
                for k in range(i + 2, end):
                    if self.kinds[k] == "string":
                        self.imported(self.texts[k].strip('"`'), k, k)
                return end + 1
            at = next((k for k in range(i + 1, min(i + 4, self.n)) if self.kinds[k] == "string"), None)
            return None if at is None else self.imported(self.texts[at].strip('"`'), i, at)
        kind = KEYWORDS["go"].get(x)
        if kind is None:
            return None
        if x == "func":
            at, owner = i + 1, None
            if self.text(at) == "(":
                names = [k for k in range(at + 1, self.close[at]) if self.kinds[k] == "name"]
                inner = next((k for k in range(at + 1, self.close[at]) if self.texts[k] == "["), self.close[at])
                owner = next((self.texts[k] for k in reversed(names) if k < inner), None)
                at = self.past(at)
            if not self.is_name(at):
                return None
            params = at + 1 if self.text(at + 1) != "[" else self.past(at + 1)
            body = self.past(params) if self.text(params) == "(" else params
            while body < self.n and not (self.texts[body] == "{" and self.texts[body - 1] not in ("interface", "struct")) and not self.breaks(body):
                body = self.past(body)
            if self.text(body) != "{":
                self.symbol(kind, self.texts[at], i, body - 1, at, owner)
                return body
            return self.define(kind, self.texts[at], i, at, body, owner)
        if self.inside_function() and x in ("const", "var"):
            return None
        group = self.text(i + 1) == "("
        stop = self.close[i + 1] if group else self.n
        k = i + 2 if group else i + 1
        while k < stop and self.is_name(k):
            first = k if group else i
            if x == "type":
                body = k + 1
                if self.text(body) == "[" and self.is_name(body + 1) and self.text(self.past(body)) not in ("]",) and self.text(body + 2) != "]":
                    body = self.past(body)
                own = {"struct": "struct", "interface": "interface"}.get(self.text(body), "type")
                end = self.statement_end(k)
                self.symbol(own, self.texts[k], first, end, k, None)
                self.named[k : end + 1] = b"\1" * (end + 1 - k)
            else:
                end = self.statement_end(k)
                self.symbol(kind, self.texts[k], first, end, k, None)
                m = k
                while self.text(m + 1) == "," and self.is_name(m + 2):
                    m += 2
                    self.symbol(kind, self.texts[m], first, end, m, None)
            if not group:
                return end + 1 if x == "type" else k + 1
            k = end + 1 + (self.text(end + 1) == ";")
        return i + 2 if group else None

    def script(self, i: int) -> int | None:
        j = self.modifiers(i)
        x, scope = self.text(j), self.scopes[-1]
        if self.kinds[j] != "name" and x not in ("*", "[", "{") and (j >= self.n or self.kinds[j] != "string"):
            return None
        exported = "export" in self.texts[i:j]
        if x == "import" and self.text(j + 1) not in ("(", ".") or exported and x in ("{", "*") and "from" in self.texts[j : j + 1] + self.texts[self.past(j) : self.past(j) + 3]:
            end = self.statement_end(j)
            source = next((k for k in range(end, j, -1) if self.kinds[k] == "string"), None)
            if source is not None:
                while end > source and self.kinds[end] != "string" and self.text(source + 1) not in ("with", "assert"):
                    end -= 1
                return self.imported(self.texts[source].strip("\"'`"), i, end)
            return None
        if scope.kind == "container" or scope.kind == "block" and self.text(i - 1) in ("{", ","):
            if (past := self.script_member(i, j)) is not None:
                return past
        if scope.kind == "container":
            return None
        kind = KEYWORDS["javascript"].get(x)
        if kind is None or self.text(j + 1) in (".", "(", ":", ",", "=", ")") and x != "function":
            return None
        if x == "class" or x == "enum" or x == "const" and self.text(j + 1) == "enum":
            return self.script_class(i, j + (self.text(j + 1) == "enum"))
        at = j + 1 + (self.text(j + 1) == "*")
        if x == "function":
            if not self.is_name(at):
                return None
            params = self.past_angles(at + 1)
            end = self.statement_end(at)
            body = self.past(params) if self.text(params) == "(" else params
            if self.text(body) == ":":
                body = self.type_end(body + 1)
            if self.text(body) != "{":
                self.named[at] = 1
                return end + 1  # a declaration without a body
            return self.define("function", self.texts[at], i, at, body, self.owner())
        if not self.is_name(at) and not (x in ("module", "namespace") and at < self.n and self.kinds[at] == "string"):
            return None
        name = self.texts[at].strip("\"'")
        if x in ("namespace", "module"):
            body = self.find(at, ("{", ";"))
            return self.define("module", name, i, at, body, self.owner()) if self.text(body) == "{" and self.lines[body] == self.lines[at] else None
        if x == "interface":
            body = self.find(at, ("{",))
            if self.text(body) != "{":
                return None
            end = self.close[body]
            self.symbol("interface", name, i, end, at, self.owner(), self.bases(at + 1, body, ("extends",)), body)
            self.named[i:end] = b"\1" * (end - i)
            return end + 1
        end = self.statement_end(at)
        if x == "type":
            if self.text(self.past_angles(at + 1)) != "=":
                return None
            self.symbol("type", name, i, end, at, self.owner())
            self.named[i:end] = b"\1" * (end - i)
            return end + 1
        value = self.find(at, ("=", ";", ","))
        made = self.text(value) == "=" and value <= end and self.is_function(value + 1)
        if made:
            self.symbol("function", name, i, end, at, self.owner())
            body = self.find(value + 1, ("{", ";")) if value < end else end
            if self.text(body) == "{" and body <= end:
                self.scopes.append(Scope(self.close[body], "function", None))
                return body + 1
            return value + 1
        if not self.inside_function():
            self.symbol("variable", name, i, end, at, self.owner())
        return at + 1

    def is_function(self, i: int) -> bool:
        """Whether the value at i is a function or arrow function."""
        i += self.text(i) == "async"
        if self.text(i) == "function":
            return True
        i = self.past_angles(i)
        if self.text(i) == "(":
            after = self.past(i)
            if self.text(after) == ":":
                after = self.type_end(after + 1)
            return self.text(after) == "=>"
        return self.is_name(i) and self.text(i + 1) == "=>"

    def type_end(self, i: int) -> int:
        """Token after a type: the block, arrow, assignment or end that follows it."""
        while i < self.n:
            x = self.texts[i]
            if x == "{" and (self.text(i - 1) not in (":", "|", "&", "=>", "<", ",") or self.kinds[i - 1] == "string"):
                return i
            if x in (";", "=", ",") or self.kinds[i] == "close" or x == "=>" and self.text(i - 1) != ")":
                return i
            if x == "=>" and self.text(i + 1) == "{" or self.breaks(i) and x != "{":
                return i
            i = self.past_angles(i) if x == "<" and self.past_angles(i) > i else self.past(i)
        return i

    def script_class(self, first: int, j: int) -> int | None:
        at = j + 1
        own = self.is_name(at) and self.texts[at] not in ("extends", "implements")
        name = self.texts[at] if own else "<anonymous>"
        body = self.find(at, ("{", ";"))
        while self.text(body) == "{" and self.text(body - 1) in ("<", ",", ":", "|", "&"):  # a type in the arguments of a base
            body = self.find(self.past(body), ("{", ";"))
        if self.text(body) != "{":
            return None
        self.named[j : body + 1] = b"\1" * (body + 1 - j)
        if self.texts[j] == "enum":
            self.symbol("enum", name, first, self.close[body], at, self.owner(), [], body)
            return self.close[body] + 1
        return self.define("class", name, first, at if own else j, body, self.owner(), self.bases(at + own, body, ("extends", "implements")))

    def script_member(self, first: int, j: int) -> int | None:
        """A method of a class or object, with a body; signatures without one are no calls and no definitions."""
        j += self.text(j) == "*"
        x = self.text(j)
        inside = self.scopes[-1].kind == "container"
        if x == "[" and self.kinds[j] == "open":
            at, name, k = j, self.content[self.t.starts[j] : self.t.ends[self.close[j]]], self.past(j)
        elif self.is_name(j) or j < self.n and self.kinds[j] in ("string", "number"):
            at, name, k = j, x.strip("\"'"), j + 1
        else:
            return None
        k += self.text(k) in ("?", "!")
        k = self.past_angles(k)
        if self.text(k) != "(" or not inside and (x in NOT_CALLS or self.lines[k] != self.lines[at]):
            return None
        after = self.past(k)
        if self.text(after) == ":":
            after = self.type_end(after + 1)
        if self.text(after) == "{" and (inside or self.lines[after] == self.t.end_lines[after - 1]):
            self.symbol("method", name, first, self.close[after], at, self.owner() if inside else None, None, after)
            self.scopes.append(Scope(self.close[after], "function", None))
            return after + 1
        if inside:
            self.named[at] = 1
            return after
        return None

    def braced(self, i: int) -> int | None:
        """Heads of the languages that are alike in classes with blocks."""
        kin = self.kin
        if kin == "cpp" and self.text(i) in ("public", "private", "protected") and self.text(i + 1) == ":":
            self.marked = i + 2
            return i + 2
        if self.kinds[i] == "pre":
            if kin in ("c", "cpp") and (words := self.texts[i].lstrip("# \t")).startswith("include"):
                return self.imported(words.removeprefix("include").strip(), i, i)
            return i + 1
        j = self.modifiers(i)
        x, scope = self.text(j), self.scopes[-1]
        if (past := self.braced_import(i, j)) is not None:
            return past
        if kin == "php" and x == "<" and self.text(j + 1) == "?":
            self.marked = j + 3 if self.text(j + 2) == "php" else j + 2
            return self.marked
        if kin in ("c", "cpp") and x == "{" and self.texts[j - 1].startswith('"'):
            self.scopes.append(self.scopes[-1]._replace(past=self.close[j]))  # extern "C"
            return j + 1
        kind = KEYWORDS[kin].get(x)
        if kin == "java" and x == "@" and self.text(j + 1) == "interface":
            kind, j = "interface", j + 1
        if x == "enum" and self.text(j + 1) in ("class", "struct"):
            j += 1
        if x == "record" and (not self.is_name(j + 1) or self.text(j + 2) not in ("(", "<", "{", ":")):
            kind = None
        if kind is not None and (past := self.worded_definition(i, j, kind)) is not None:
            return past
        if kin in BARE_MEMBERS and (scope.kind == "container" or scope.kind in ("file", "module") and kin in ("c", "cpp")):
            return self.bare_member(i, j)
        return None

    def braced_import(self, i: int, j: int) -> int | None:
        kin, x = self.kin, self.text(j)
        if kin in ("java", "kotlin", "scala", "swift") and x == "import":
            k = j + 1 + (self.text(j + 1) == "static")
            end = k
            while end < self.n and (self.is_name(end) and self.texts[end] != "as" and (end == k or self.texts[end - 1] == ".") or self.texts[end] in (".", "*", "_")):
                end += 1
            last = self.statement_end(end - 1)
            return self.imported("".join(self.texts[k:end]).rstrip("."), i, last)
        if kin == "csharp" and x == "using" and self.text(j + 1) != "(" and not self.inside_function():
            end = self.find(j, (";",))
            words = [self.texts[k] for k in range(j + 1, end) if self.texts[k] != "static"]
            if "=" in words:
                words = words[words.index("=") + 1 :]
            return self.imported("".join(words), i, min(end, self.n - 1))
        if kin == "php" and x in ("use", "require", "include", "require_once", "include_once") and self.scopes[-1].kind != "container":
            end = self.find(j, (";",))
            quoted = next((self.texts[k] for k in range(j, end) if self.kinds[k] == "string"), None)
            own = self.content[self.t.ends[j] : self.t.starts[end] if end < self.n else len(self.content)].split("{")[0].split(" as ")[0]
            return self.imported(quoted.strip("\"'") if quoted else "".join(own.split()).rstrip("\\"), i, min(end, self.n - 1))
        return None

    def worded_definition(self, i: int, j: int, kind: str) -> int | None:
        kin, x, at = self.kin, self.texts[j], j + 1
        owner = self.owner()
        if kin == "swift" and x in ("init", "deinit"):
            at = j
        if kin in ("kotlin", "scala", "cpp", "c") and self.text(at) == "<":
            at = self.past_angles(at)
        if kin == "php" and self.text(at) == "&":
            at += 1
        if kin in ("c", "cpp"):
            while self.text(at) in ("alignas", "__attribute__", "[") or self.is_name(at) and self.text(at).isupper() and self.is_name(at + 1):
                at = self.past(at) if self.text(at) == "[" else self.past(at + 1) if self.text(at + 1) == "(" else at + 1
        if not self.is_name(at):
            if kin == "kotlin" and x == "object" and "companion" in self.texts[i:j] and (self.text(at) in ("{", ":")):
                body = self.find(at, ("{",))
                return self.define(kind, "Companion", i, j, body, owner) if self.text(body) == "{" else None
            if kin in ("c", "cpp") and "typedef" in self.texts[i:j] and self.text(at) == "{":
                name = self.past(at)
                if self.is_name(name):
                    self.symbol(kind, self.texts[name], i, name, name, owner)
                    return at + 1 if kind == "class" else name + 1
            return None
        if kin == "kotlin" and kind == "function":
            while True:
                k = self.past_angles(at + 1)
                k += self.text(k) == "?"
                if self.text(k) != "." or not self.is_name(k + 1):
                    break
                at = k + 1  # the receiver's name comes first
        name_at = at
        name = self.texts[at]
        while kind == "module" and self.text(at + 1) in (".", "::", "\\") and self.is_name(at + 2):
            at += 2
            name += self.texts[at - 1] + self.texts[at]
        if kind in ("property", "constant"):
            if self.inside_function() or self.scopes[-1].kind == "block":
                return None
            self.symbol(kind, name, i, self.property_end(at), at, owner)
            return at + 1
        if kind == "type":
            end = self.statement_end(at)
            self.symbol(kind, name, i, end, at, owner)
            return end + 1
        stops = ("{", ";", "=", ":=") if kind == "function" else ("{", ";")
        k = at + 1
        k = self.past(k) if self.text(k) == "[" else self.past_angles(k)
        if kind == "function":
            k += self.text(k) in ("?", "!")
            k = self.past_angles(k)
            while self.text(k) == "(" or self.text(k) == "[" and kin == "scala":
                k = self.past(k)
        elif kin in ("c", "cpp") and self.text(k) not in ("{", ":", "final"):
            return None  # a declaration, or a type in front of a name
        body = k
        while body < self.n and self.texts[body] not in stops and self.kinds[body] != "close" and not (kin in NEWLINE_ENDS and self.breaks(body)):
            body = self.past_angles(body) if self.texts[body] == "<" and self.past_angles(body) > body else self.past(body)
        self.named[name_at] = 1
        words = {"kotlin": (":",), "scala": ("extends", "with"), "csharp": (":",), "cpp": (":",), "swift": (":",)}.get(kin, ("extends", "implements"))
        bases = self.bases(k, body, words) if kind not in ("function", "module", "enum") or kin == "java" and kind == "enum" else []
        if kind == "class" or kind == "struct" or kind == "interface":
            for m in range(k, body):
                self.named[m] = 1  # bases that are called
        if self.text(body) == "{":
            past = self.define(kind, name, i, at, body, owner, bases)
            if kind == "enum" and kin in ("java", "csharp", "kotlin", "c", "cpp"):
                return self.enum_values(past)
            return past
        if self.text(body) == "=" and kind == "function":
            end = self.statement_end(body)
            self.symbol(kind, name, i, end, at, owner, None, body)
            value = self.text(body + 1) == "{"
            if value:
                self.scopes.append(Scope(self.close[body + 1], "function", None))
                return body + 2
            return body + 1
        last = body if self.text(body) == ";" else body - 1
        if kin == "csharp" and kind == "module" or kin == "php" and kind == "module":
            self.symbol(kind, name, i, self.n - 1, at, owner)
            return last + 1
        self.symbol(kind, name, i, last, at, owner, bases, last + (self.text(last) != ";"))
        return last + 1

    def property_end(self, at: int) -> int:
        end = self.statement_end(at)
        body = self.find(at, ("{", "=", ";"))
        return self.close[body] if self.text(body) == "{" and self.lines[body] == self.t.end_lines[body - 1] else end

    def enum_values(self, k: int) -> int:
        """Token after the values of an enumeration, which are no calls."""
        while self.is_name(k) or self.text(k) in ("@", "[", ","):
            k = self.marks(k)
            self.named[k] = 1
            k += 1
            while self.text(k) in ("(", "{"):
                k = self.past(k)
            if self.text(k) == "=":
                k = self.find(k, (",", ";", "}"))
        return k

    def bare_member(self, i: int, j: int) -> int | None:
        """A method, constructor, property or field of a class, or a function of C: types and a name before brackets, a block or an end."""
        k, name_at = j, None
        container = self.scopes[-1].kind == "container"
        if self.text(k) == "<":
            k = self.past_angles(k)
        while k < self.n:
            x = self.texts[k]
            if self.kinds[k] == "name":
                if x in NOT_CALLS and x not in ("new", "const", "struct", "enum", "class", "unsafe", "async", "operator"):
                    return None
                name_at = k
                if x == "operator" and self.kin in ("cpp", "csharp"):
                    k = self.find(k + 1 + (self.text(k + 1) == "("), ("(",))
                    break
                past = self.past_angles(k + 1)
                if past > k + 1:
                    k = past
                    if self.text(k) == "(":
                        break
                    continue
            elif x in ("(", "{", ";", "=", "=>", ",") or self.kinds[k] == "close":
                break
            elif x not in (".", "::", "*", "&", "[", "]", "?", "~", "<", ">", "&&", ":", "..."):
                return None
            k = self.past(k) if x == "[" else k + 1
        if name_at is None or k >= self.n:
            return None
        x, name, owner = self.texts[k], self.texts[name_at], self.owner()
        if name == "operator":
            name = "".join(self.texts[name_at:k])
        elif self.text(name_at - 1) == "~":
            name = "~" + name
        if x == "(":
            if name_at == j and not (container and name == owner) and self.kin not in ("c", "cpp"):
                return None
            if name_at == j and self.kin in ("c", "cpp") and not container:
                return None  # a macro's use
            if self.text(name_at - 1) == "::" and self.is_name(name_at - 2):
                owner = self.texts[name_at - 2]
            body = self.past(k)
            while body < self.n and self.texts[body] not in ("{", ";", "=", "=>", ",") and self.kinds[body] != "close":
                if self.texts[body] == ":" and self.kin == "cpp":  # values of members
                    body += 1
                    while self.is_name(body):
                        self.named[body] = 1
                        body = self.past(self.past_angles(body + 1))
                        body += self.text(body) == ","
                    continue
                if self.kin == "csharp" and self.texts[body] == ":":
                    self.named[body + 1] = 1
                body = self.past(body)
            self.named[name_at] = 1
            if self.text(body) == "{":
                kind = "method" if container or owner else "function"
                self.symbol(kind, name, i, self.close[body], name_at, owner, None, body)
                self.scopes.append(Scope(self.close[body], "function", None))
                return body + 1
            end = self.find(body, (";",))
            if self.text(body) == "=>" or container and self.kin in ("java", "csharp"):
                self.symbol("method", name, i, end, name_at, owner, None, body)
                return body
            return body
        if not container or x in (",",) and name_at == j or self.kinds[k] == "close" or name_at == j:
            return None
        if self.kin == "csharp" and x in ("{", "=>"):
            end = self.close[k] if x == "{" else self.find(k, (";",))
            self.symbol("property", name, i, end, name_at, owner, None, k)
            return k
        if x == "{" or self.kin == "c" or name in ("struct", "enum", "class"):
            return None
        end = self.find(k, (";",))
        self.symbol("field", name, i, end, name_at, owner)
        while self.text(k) != ";" and k < end:  # more names after commas
            k = self.find(k + 1, (",", ";"))
            if self.text(k) == "," and self.is_name(k + 1):
                self.symbol("field", self.texts[k + 1], i, end, k + 1, owner)
        return name_at + 1

    def worded(self, i: int) -> int | None:
        """Heads of the languages whose blocks end with a word; blocks were matched before."""
        if not hasattr(self, "ends"):
            self.ends = self.word_blocks()
        x = self.text(i)
        if self.kin == "ruby" and x in ("require", "require_relative", "load") and self.kinds[min(i + 1, self.n - 1)] == "string":
            return self.imported(self.texts[i + 1].strip("\"'"), i, i + 1)
        if self.kin == "elixir" and x in ("alias", "import", "use", "require") and self.is_name(i + 1):
            end = self.statement_end(i)
            words = self.content[self.t.ends[i] : self.t.ends[end]]
            return self.imported(words.split(",")[0].split("{")[0].strip().rstrip("."), i, end)
        kind = KEYWORDS[self.kin].get(x)
        if kind is None:
            return None
        at = i + 1
        if self.kin == "ruby" and self.text(at) == "<":
            return None  # the class of an object
        if self.kin == "ruby" and kind == "function" and self.text(at + 1) == "." and self.is_name(at + 2):
            at += 2
        if not self.is_name(at):
            return None
        name, k = self.texts[at], at + 1
        while kind != "function" and self.text(k) in ("::", ".") and self.is_name(k + 1):
            name, k = name + self.texts[k] + self.texts[k + 1], k + 2
        last = self.ends.get(i)
        own = last is not None
        if not own:
            last = self.statement_end(at)
        bases = [self.texts[k + 1]] if self.kin == "ruby" and kind == "class" and self.text(k) == "<" and self.is_name(k + 1) else []
        self.symbol(kind, name, i, last, at, self.owner(), bases, exported=x not in ("defp", "defmacrop"))
        if own:
            self.scopes.append(Scope(last, "container" if kind in CONTAINERS else "function", name if kind in CONTAINERS else None))
        return at + 1

    def word_blocks(self) -> dict[int, int]:
        """Token that ends each block, by the word that begins the definition; ``end`` closes what was opened last."""
        out: dict[int, int] = {}
        stack: list[int] = []
        head = None  # a loop or definition whose ``do`` belongs to it
        for i, x in enumerate(self.texts):
            if self.kinds[i] != "name" or self.text(i - 1) == "." or self.text(i + 1) == ":" and self.text(i + 2) != ":":
                continue
            starts = i == 0 or self.lines[i] > self.t.end_lines[i - 1] or self.texts[i - 1] in (";", "=", "(", "then", "else", "||", "&&", "return", "do")
            if x == "end":
                if stack:
                    out[stack.pop()] = i
            elif self.kin == "ruby":
                if x in RUBY_LOOPS and starts:
                    stack.append(i)
                    head = self.lines[i]
                elif x in KEYWORDS["ruby"] and starts or x in RUBY_OPENERS and starts:
                    bare = x == "def" and self.text(self.past(i + 2) if self.text(i + 2) == "(" else i + 2) == "=" and self.lines[i] == self.lines[min(i + 2, self.n - 1)]
                    if not bare:
                        stack.append(i)
                elif x == "do" and head != self.lines[i]:
                    stack.append(i)
            elif x in KEYWORDS["elixir"] and starts:
                head = i
            elif x == "fn":
                stack.append(i)
            elif x == "do":
                stack.append(head if head is not None else i)
                head = None
        return out

    def shell(self, i: int) -> int | None:
        x = self.text(i)
        if x in ("source", ".") and i + 1 < self.n and self.lines[i + 1] == self.lines[i]:
            end = self.content.find("\n", self.t.starts[i])
            words = self.content[self.t.ends[i] : end if end >= 0 else len(self.content)].split(";")[0].strip()
            last = i
            while last + 1 < self.n and self.lines[last + 1] == self.lines[i] and self.texts[last + 1] != ";":
                last += 1
            return self.imported("" if "$" in words else words.strip("\"'"), i, last)
        at = i + (x == "function")
        if not self.is_name(at) or not (x == "function" or self.text(at + 1) == "(" and self.close[at + 1] == at + 2):
            return None
        body = at + 1 if self.text(at + 1) != "(" else self.past(at + 1)
        if self.text(body) not in ("{", "("):
            return None
        return self.define("function", self.texts[at], i, at, body, None)

    # -- calls

    def calls(self) -> list[dict]:
        out: list[dict] = []
        spans, k, open_ = sorted(self.functions, key=lambda f: (f[0], -f[1])), 0, []
        generic = self.lang in ("typescript", "tsx", "java", "cpp", "csharp", "kotlin", "swift")
        chains = (".", "::", "?.", "->") if self.kin in ("c", "cpp", "php") else (".", "::", "?.")
        n, texts, named = self.n, self.texts, self.named
        for i, kind in enumerate(self.kinds):
            if kind != "name" or named[i]:
                continue
            j = i + 1
            follows = texts[j] if j < n else ""
            if follows not in BEFORE_CALLED:
                continue
            x = texts[i]
            if follows == "!" and self.kin == "rust" and self.text(j + 1) in ("(", "[", "{"):
                j += 1
            elif follows == "::" and self.kin == "rust" and self.text(j + 1) == "<":
                j = self.past_angles(j + 1)
            elif follows == "<" and generic:
                j = self.past_angles(j)
            elif follows == "?." and self.text(j + 1) == "(":
                j += 1
            if self.text(j) != "(" and not (self.kin == "rust" and self.text(j - 1) == "!" and j > i + 1):
                continue
            before = self.text(i - 1)
            if x in NOT_CALLS and before not in chains or before in ("@", "fn", "func", "function", "def", "fun"):
                continue
            if self.kin == "kotlin" and x in ("get", "set") and before not in chains and self.text(self.past(j)) in ("=", "{", ":"):
                continue  # of a property
            if self.kin in ("ruby", "elixir") and self.t.ends[i] != self.t.starts[j]:
                continue
            while open_ and open_[-1][1] < i:
                open_.pop()
            while k < len(spans) and spans[k][0] <= i:
                if spans[k][1] >= i:
                    open_.append(spans[k])
                k += 1
            first = i
            while self.text(first - 1) in chains and self.is_name(first - 2):
                first -= 2
            owner = "".join(self.texts[first : i - 1]) if first < i and self.text(first - 1) not in chains else None
            out.append({"row": "call", "name": x, "owner": owner, "parent": open_[-1][2] if open_ else None, "start_line": self.lines[i]})
            if self.kin == "javascript" and x in ("require", "import") and owner is None and self.kinds[min(j + 1, self.n - 1)] == "string" and self.text(j + 2) == ")":
                source = self.texts[j + 1].strip("\"'`")
                self.imports.append({"row": "import", "source": source, "name": source, "start_line": self.lines[i]})
                if x == "import":
                    out.pop()
        return out


def read(content: str, lang: str, shapes: bool = True, wanted: Collection[str] = ALL_ROWS) -> list[dict]:
    """Rows of a file in a language that has forms here, else none; without ``shapes`` no structure is hashed.

    Rows that are not ``wanted`` may lack all but their kind, or be left out behind the last that is."""
    if (lang if lang not in SCRIPTS else "javascript") not in KEYWORDS:
        return []
    return Reader(content, lang, shapes, wanted).run()
