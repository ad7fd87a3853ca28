"""The reader of token streams: forms in several languages, time in the size of a file, and odd input."""

import time

import pytest

from loamline.sources import extract, lexer, parser


def rows(lang, content, row="symbol"):
    keys = {"symbol": ("kind", "name", "parent", "start_line", "end_line"), "import": ("source", "start_line"), "call": ("name", "owner", "parent", "start_line")}[row]
    return [tuple(r.get(k) for k in keys) for r in extract.extract("x", lang, content) if r["row"] == row]


def test_traits_are_told_from_types_with_arrows():
    found = [r for r in extract.extract("x", "rust", "impl<T: Fn(u8) -> u8> Tr for S<T> {\n  fn go(&self) {}\n}\n") if r["row"] == "symbol"]
    assert [(r["name"], r["implements"], r["parent"]) for r in found] == [("S", ["Tr"], None), ("go", [], "S")]
    assert rows("rust", "macro_rules! mk { ($n:ident) => { fn $n() { x() } } }\nfn a() {}") == [("function", "a", None, 2, 2)]


def test_classes_without_names_and_their_bases():
    found = [r for r in extract.extract("x", "typescript", "export default class extends ns.A<B> implements C, D<{ x: number }> {\n}\n") if r["row"] == "symbol"]
    assert [(r["name"], r["implements"], r["exported"]) for r in found] == [("<anonymous>", ["A", "C", "D"], True)]


def test_long_heads_and_groups():
    head = "func F(\n" + "".join(f"\ta{k} int,\n" for k in range(500)) + ") int {\n\treturn g(a0)\n}\n"
    assert rows("go", head) == [("function", "F", None, 1, 504)] and rows("go", head, "call") == [("g", None, "F", 503)]
    many = "import {\n" + "".join(f"  n{k},\n" for k in range(1000)) + "} from './m';\n"
    assert rows("typescript", many, "import") == [("./m", 1)]


def test_code_inside_templates_and_nested_comments():
    assert rows("javascript", "const t = `a ${f(`b ${g(1)} }`)} h(2)`; /* k(3) */", "call") == [("f", None, None, 1), ("g", None, None, 1)]
    assert rows("rust", "/* a /* b */ fn no() {} */ fn yes() {}") == [("function", "yes", None, 1, 1)]
    assert lexer.blank("x = 'a' # b\n", "python") == "x =        \n" and lexer.blank("f(`a${b}c`)", "typescript") == "f(  ${b}  )"


@pytest.mark.parametrize("content", ["(" * 30000, "{" * 30000, "<" * 30000, "impl " + "<" * 30000, "class A { x: " + "Y<" * 20000, "a.b." * 30000, "`${" * 5000, "'" * 20001, "/*" * 20000, "\\" * 1000, "\0", "", "}" * 100 + ")" * 100, "def " * 10000, "x(" * 20000])
def test_odd_files_take_no_time(content):
    for lang in ("rust", "go", "typescript", "java", "kotlin", "scala", "csharp", "cpp", "php", "swift", "ruby", "elixir", "bash", "c"):
        began = time.process_time()
        extract.extract("x", lang, content)
        assert time.process_time() - began < 3, (lang, content[:20])


@pytest.mark.parametrize(("lang", "unit"), [("go", "func F{} (a int) int {{\n\treturn G(a, \"x\") + 1\n}}\n\n"), ("typescript", "export function f{}(a: number): number {{\n  return g(a + 1, 'x');\n}}\n"), ("rust", "pub fn f{}(a: u32) -> u32 {{\n    g(a)\n}}\n"), ("java", "class K{} {{\n  int f(int a) {{\n    return g(a);\n  }}\n}}\n"), ("cpp", "int f{}(int a) {{\n  return g(a);\n}}\n"), ("ruby", "def f{}(a)\n  g(a)\nend\n")])
def test_time_is_linear(lang, unit):
    def seconds(size):
        content = "".join(unit.format(k) for k in range(size // len(unit)))
        began = time.process_time()
        found = extract.extract("x", lang, content)
        assert sum(r["row"] == "call" for r in found) == size // len(unit)
        return time.process_time() - began

    small, large = min(seconds(125_000) for _ in range(2)), seconds(500_000)
    assert large < 10 * small and large < 4


def test_rows_that_are_not_asked_for_are_not_made(monkeypatch):
    """They keep their places in the order of rows."""
    content = "package a\nimport \"fmt\"\nfunc F() {\n\tg()\n}\nfunc G() {\n\th.F()\n}\n"
    whole = extract.extract("x", "go", content, False)
    for row in ("symbol", "import", "call"):
        assert extract.extract("x", "go", content, False, {row}) == [r for r in whole if r["row"] == row]
    monkeypatch.setattr(parser.Reader, "calls", None)
    assert [r["ord"] for r in extract.extract("x", "go", content, False, {"symbol"})] == [0, 1]
    assert [r["ord"] for r in extract.extract("x", "go", content, False, {"import"})] == [2]


def test_imports_that_are_calls_are_read_without_calls():
    content = "const a = require('./a');\nfunction f() { import('./b'); g(); }\n"
    assert [(r["source"], r["ord"]) for r in extract.extract("x", "javascript", content, False, {"import"})] == [("./a", 2), ("./b", 3)]


def test_white_space_at_the_end_is_no_token():
    assert lexer.tokens("\u2003a b \u2003\n", "go").texts == ["a", "b"]
