"""Predicates and scores of contents and single lines, globs, and sizes, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the predicates look for.
GENERATED_MARKERS = [
    "@generated",
    "DO NOT EDIT",
    "Do not edit",
    "do not edit",
    "auto-generated",
    "Auto-generated",
    "AUTO-GENERATED",
    "this file is generated",
    "This file is generated",
    "THIS FILE IS GENERATED",
    "automatically generated",
    "Automatically generated",
]
TEST_PATHS = ["_test.", "/test/", "/tests/", "_spec.", "/spec/"]
TEST_TEXTS = ["#[test]", "#[cfg(test)]", "@Test", "def test_", 'it("', "it('", 'describe("', "describe('", "func Test"]
KEEP_MARKERS = ["TODO", "FIXME", "NOTE", "HACK", "SAFETY", "WARN"]
FAMILY_OF_EXTENSION = {
    "rust": "rs",
    "python": "py pyi rb",
    "go": "go",
    "script": "js jsx ts tsx mjs cjs",
    "managed": "java kt kts cs scala sc",
    "c": "c h cpp hpp cc cxx",
    "shell": "sh bash bats",
}
DEBUG_LOGS = {
    "rust": ["log::debug!", "log::trace!", "tracing::debug!", "tracing::trace!", "debug!(", "trace!(", "dbg!("],
    "python": ["logger.debug(", "logging.debug(", "print(", "pprint(", "pprint.pprint("],
    "go": ["log.Printf(", "log.Println(", "log.Print(", "fmt.Printf(", "fmt.Println(", "fmt.Print("],
    "script": ["console.log(", "console.debug(", "console.trace("],
    "managed": ["System.out.print", "logger.debug(", "log.debug(", "Log.d(", "println("],
    "c": ["printf(", "std::cout", "cout ", "cout<<"],
    "shell": ['echo "DEBUG', "echo 'DEBUG"],
}
#: Comment opening of each family, and openings that begin documentation instead.
COMMENTS = {
    "rust": ("//", ["///", "//!"]),
    "python": ("#", []),
    "go": ("//", []),
    "script": ("//", []),
    "managed": ("//", ["///"]),
    "c": ("//", ["///", "//!"]),
    "shell": ("#", ["#!"]),
}


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def begins(text: Column, prefixes: list[str]) -> Column:
    return text.rlike("^(?:" + "|".join(map(re.escape, prefixes)) + ")")


def holds(text: Column, pieces: list[str]) -> Column:
    return text.rlike("|".join(map(re.escape, pieces)))


def lines(files: DataFrame, *keep: str, content: str = "content") -> DataFrame:
    """Rows (keep..., line from 1, text): a line feed at the end of a content ends its last line and begins no other."""
    parts = F.split(F.col(content), "\n")
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return files.select(*keep, F.posexplode(whole).alias("_n", "text")).select(*keep, (F.col("_n") + 1).alias("line"), F.regexp_replace("text", "\r$", "").alias("text"))


def tokens_of_bytes(size: Column) -> Column:
    return F.ceil(size / 4).cast("long")


def tokens(text: Column) -> Column:
    """Estimated tokens of a text: a token for each four bytes begun."""
    return tokens_of_bytes(F.octet_length(text))


def token_label(n: Column) -> Column:
    """``~950``, ``~1.2k`` or ``~1.0M``."""
    n = n.cast("double")
    return (
        F.when(n < 1000, F.format_string("~%d", n.cast("long")))
        .when(n < 999_950, F.format_string("~%.1fk", n / 1000))
        .otherwise(F.format_string("~%.1fM", n / 1_000_000))
    )


def size_label(n: Column) -> Column:
    n = n.cast("double")
    return F.when(n < 1024, F.format_string("%dB", n.cast("long"))).when(n < 1024 * 1024, F.format_string("%.1fKB", n / 1024)).otherwise(F.format_string("%.1fMB", n / 1024 / 1024))


def is_binary(content: Column) -> Column:
    """A zero byte among the first 512 of a binary column."""
    return F.locate("00", F.regexp_replace(F.hex(F.substring(content, 1, 512)), "(..)", "$1 ")) > 0


def is_generated_text(content: Column) -> Column:
    return holds(F.left(content, F.lit(512)), GENERATED_MARKERS)


def is_minified_text(content: Column) -> Column:
    """Fewer than two line feeds in the first 2048 characters; meant for contents of 100 000 bytes or more."""
    return F.length(F.regexp_replace(F.left(content, F.lit(2048)), "[^\n]", "")) < 2


def flanked(text: Column, word: str) -> Column:
    """Whether a word is in a text with no ASCII word character on either side."""
    return text.rlike("(?:^|[^A-Za-z0-9_])" + re.escape(word) + "(?:$|[^A-Za-z0-9_])")


def is_test_hit(path: Column, text: Column) -> Column:
    return holds(path, TEST_PATHS) | holds(text, TEST_TEXTS)


def is_definition_line(line: Column) -> Column:
    """Lines that begin with a definition keyword; what may stand before it depends on the keyword."""
    rules = [
        r"(?:pub(?:\(crate\))? )?fn ", r"(?:pub )?async fn ", r"(?:export (?:default |async )?|async )?function ",
        r"(?:export )?(?:const|let|var|class|interface|type) ", r"(?:pub )?(?:struct|enum|trait) ", r"impl ", r"(?:async )?def ", r"func ",
    ]
    return trimmed(line).rlike("^(?:" + "|".join(rules) + ")")


def is_comment_only(line: Column) -> Column:
    return line.rlike(r"^(?://|#|/\*|\* |\*/$|\*$)")


def is_control_flow(line: Column) -> Column:
    return line.rlike(r"^(?:if |\} else|else(?: |\{|$)|match |switch |case |for |while |loop(?: |\{|$)|return(?: |;|$))")


def is_error_handling(line: Column) -> Column:
    return line.rlike(r"\?;?$|\.unwrap\(\)|\.expect\(|^catch[ (]|^except[ :]|panic!\(|bail!\(|anyhow!\(")


def is_variable(line: Column) -> Column:
    return line.rlike(r"^(?:let|const|var|mut) ")


def line_score(line: Column, is_edge: Column) -> Column:
    """Importance of a trimmed line in a span: 100 at its edges, 10 for control, errors and calls, 5 for opening a block, 1 for assigning."""
    return (
        F.when(is_edge, 100)
        .when((line == "") | is_comment_only(line), 0)
        .when(is_control_flow(line) | is_error_handling(line) | line.contains("("), 10)
        .when(line.endswith("{") & (F.length(line) > 1), 5)
        .when(line.contains("=") | is_variable(line), 1)
        .otherwise(0)
    )


def family(path: Column) -> Column:
    """Comment family of a path's extension, null if it has none."""
    from loamline.functions.names import extension, inverted, lookup

    return lookup(extension(path), inverted(FAMILY_OF_EXTENSION))


def by_family(kind: Column, make) -> Column:
    """A boolean column that depends on the family; false where there is none."""
    out = F.lit(False)
    for name in COMMENTS:
        out = F.when(kind == name, make(name)).otherwise(out)
    return out


def is_debug_log(line: Column, kind: Column) -> Column:
    return by_family(kind, lambda name: begins(line, DEBUG_LOGS[name]))


def is_plain_comment(line: Column, kind: Column) -> Column:
    """A comment that is no documentation and has no marker such as TODO."""

    def rule(name: str) -> Column:
        opening, documentation = COMMENTS[name]
        out = line.startswith(opening)
        return out & ~begins(line, documentation) if documentation else out

    return by_family(kind, rule) & ~holds(F.upper(line), KEEP_MARKERS)


def with_meta(header: dict[str, Column], body: Column, as_of: Column | None = None) -> Column:
    """A text under one line of JSON with its header, and the time it holds for; without either the text alone."""
    fields = [value.alias(name) for name, value in header.items()]
    if as_of is not None:
        fields.append(F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("if_modified_since"))
    return F.concat(F.to_json(F.struct(*fields)), F.lit("\n\n"), body) if fields else body


def truncate_bytes(text: str | None, most: int) -> str | None:
    """The longest prefix of at most ``most`` bytes that ends between characters."""
    return None if text is None else text.encode("utf-8", "surrogatepass")[:most].decode("utf-8", "ignore")


def glob_regex(glob: str) -> str:
    """A regular expression for a glob: ``*`` and ``?`` stop at slashes, ``**`` does not, ``{a,b}`` and ``[..]`` as usual."""
    out, depth, k = "", 0, 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 2
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 1
        elif c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[k + 2 :]:
            end = glob.index("]", k + 2)
            inner = glob[k + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]"
            k = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and k + 1 < len(glob):
            out, k = out + re.escape(glob[k + 1]), k + 1
        else:
            out += re.escape(c)
        k += 1
    return f"^{out}{')' * depth}$"


def matches_glob(path: Column, glob: str) -> Column:
    """Whether a glob fits a path or its name; a leading ``!`` negates."""
    from loamline.functions.names import basename

    pattern = glob_regex(glob.removeprefix("!"))
    hit = path.rlike(pattern) | basename(path).rlike(pattern)
    return ~hit if glob.startswith("!") else hit
