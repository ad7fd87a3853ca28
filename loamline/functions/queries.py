"""Classification of query strings, on the driver and as a column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names without extension that are file names all the same.
KNOWN_NAMES = (
    "README LICENSE Makefile GNUmakefile Dockerfile Containerfile Vagrantfile Rakefile Gemfile Procfile Justfile Taskfile CHANGELOG CONTRIBUTING AUTHORS CODEOWNERS"
).split()
METACHARACTERS = r"[()\[\]{}*+?|\\^$]"
IDENTIFIER = r"^[A-Za-z_$@][A-Za-z0-9_$.-]*$"


def has_metacharacter(q: Column) -> Column:
    return q.rlike(METACHARACTERS)


def is_identifier(q: Column) -> Column:
    return q.rlike(IDENTIFIER)


def is_exact_symbol(q: Column) -> Column:
    """Marks of a symbol rather than a concept: upper case first, ``::``, ``.``, ``_``, ``-``, ``$`` or ``@`` first, or camel case."""
    return q.rlike(r"^[A-Z$@]|::|[._-]|^[a-z].*[A-Z]")


def is_file_name(q: Column) -> Column:
    return ~q.rlike("[ /]") & (q.rlike(r"^.+\.[^.]+$") | q.isin(KNOWN_NAMES))


def inner_pattern(q: Column) -> Column:
    """``p`` of ``/p/``, else null."""
    found = F.regexp_extract(q, r"(?s)^/(.+)/$", 1)
    return F.when(found != "", found)


def classify(q: Column, exists: Column | None = None) -> Column:
    """regex, glob, path, fallthrough, content, symbol or concept, by the first rule that fits. ``exists``: whether q is a file of the corpus."""
    exists = F.lit(False) if exists is None else F.coalesce(exists, F.lit(False))
    inner = inner_pattern(q)
    words = F.filter(F.split(q, r"\s+"), lambda w: w != "")
    simple = q.contains(" ") & (F.size(words) <= 4) & F.forall(words, lambda w: w.rlike("^[A-Za-z0-9_-]+$"))
    return (
        F.when(inner.isNotNull() & has_metacharacter(inner), "regex")
        .when(~q.contains(" ") & q.rlike(r"[*?{\[]"), "glob")
        .when(q.rlike(r"^\.\.?/") | (q.contains("/") & ~q.contains(" ")), F.when(exists, "path").otherwise("fallthrough"))
        .when(q.startswith(".") & exists, "path")
        .when(q.rlike("^[0-9]*$"), "content")
        .when(is_file_name(q) & exists, "path")
        .when(is_identifier(q), F.when(is_exact_symbol(q), "symbol").otherwise("concept"))
        .when(simple, "concept")
        .otherwise("content")
    )


def target_spec(q: Column) -> Column:
    """(path, line) of ``path:12`` if the path has a slash or a dot, else (null, null)."""
    path, line = F.regexp_extract(q, r"^(.*[/.].*):([0-9]+)$", 1), F.regexp_extract(q, r"^(.*[/.].*):([0-9]+)$", 2)
    return F.struct(F.when(path != "", path).alias("path"), F.when(line != "", line.cast("long")).alias("line"))


def section_suffix(q: Column) -> Column:
    """Kind of what follows the first ``#`` of a path: range, line, heading, words, symbol, or null if there is none."""
    rest = F.regexp_extract(q, r"(?s)^[^#]+#(.*)$", 1)
    return (
        F.when(rest == "", None).when(rest.rlike(r"^\d+-\d+$"), "range").when(rest.rlike(r"^\d+$"), "line")
        .when(rest.startswith("#"), "heading").when(rest.contains(" "), "words").otherwise("symbol")
    )


def java_pattern(spark, pattern: str) -> tuple[str, str | None]:
    """(pattern, None), or for one that does not compile (the literal, why), so that a plan never fails when it runs."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
        return pattern, None
    except Exception as error:
        return re.escape(pattern), str(error).strip().splitlines()[-1]
