"""Ranking of search hits: one integer column per term, and their sum.

Hits have path, text, is_definition, exact, def_name, def_weight, impl_target, est_lines and mtime."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamline.functions import names, text

# Weights of definition kinds, and line openings that suit a type's or a function's name.
DEFINITION_WEIGHTS = {
    100: "function method class struct interface trait enum type decorated",
    90: "impl object",
    80: "constant static",
    70: "module namespace property",
    60: "assignment",
    40: "variable",
    30: "export heading",
}
TYPE_LINE = r"^(?:(?:pub )?(?:struct|enum|trait) |(?:export )?(?:interface|type|class) |impl )"
FUNCTION_LINE = r"^(?:(?:pub(?:\(crate\))? )?fn |(?:pub )?async fn |(?:export (?:default |async )?)?function )"
HASH_COMMENT_EXTENSIONS = "py rb sh bash zsh yaml yml toml pl r R".split()
AGES = [(3600, 100), (86_400, 80), (604_800, 50), (2_592_000, 20)]


def definition_weight(kind: Column) -> Column:
    out = F.lit(50)
    for weight, kinds in DEFINITION_WEIGHTS.items():
        out = F.when(kind.isin(kinds.split()), weight).otherwise(out)
    return out


def name_boost(name: Column, impl_target: Column, q: str) -> Column:
    low = F.lower(name)
    return (
        F.when(name.isNull(), 0).when(name == q, 220).when(low == q.lower(), 180).when(F.coalesce(impl_target == q, F.lit(False)), 120)
        .when(low.startswith(q.lower()), 80).when(low.contains(q.lower()), 40).otherwise(0)
    )


def basename_boost(path: Column, q: str) -> Column:
    if not q:
        return F.lit(0)
    stem, low = F.lower(names.stem(path)), q.lower()
    return (
        F.when(stem == low, 500).when(stem.startswith(low) & stem.substr(len(low) + 1, 1).isin("_", ".", "-"), 350)
        .when(stem.endswith(low), 250).when(stem.contains(low), 180).when(F.lower(names.basename(names.parent(path))) == low, 200).otherwise(0)
    )


def scope_proximity(path: Column) -> Column:
    """Nearer the top is better; ``path`` is relative to the scope."""
    return F.greatest(F.lit(0), F.lit(200) - 20 * names.depth(path))


def recency(mtime: Column, as_of: Column) -> Column:
    age = F.greatest(F.lit(0), F.unix_timestamp(as_of) - F.unix_timestamp(mtime))
    out = F.lit(0)
    for seconds, points in reversed(AGES):
        out = F.when(age <= seconds, points).otherwise(out)
    return out


def intent_boost(line: Column, q: str) -> Column:
    line = F.ltrim(line)
    if q[:1].isupper():
        return F.when(line.rlike(TYPE_LINE), 90).otherwise(0)
    return F.when(line.rlike(FUNCTION_LINE), 70).otherwise(0) if q[:1].islower() else F.lit(0)


def export_boost(line: Column) -> Column:
    line = F.ltrim(line)
    return F.when(line.startswith("export default "), 90).when(line.startswith("export "), 75).when(line.startswith("pub "), 60).otherwise(0)


def words_boost(path: Column, line: Column, q: str) -> Column:
    """Of a query of several words: how many are whole words of the path or line."""
    words = [w.lower() for w in re.split(r"[^\w]+", q) if w] if " " in q else []
    if len(words) < 2:
        return F.lit(0)
    own = F.split(F.lower(F.concat(path, F.lit(" "), line)), r"(?U)[^\w]+")
    found = sum((F.array_contains(own, w).cast("int") for w in words), F.lit(0))
    return F.when(found == len(words), 300).when(found >= len(words) - 1, 120).otherwise(0)


def prose_penalty(path: Column) -> Column:
    ext = F.coalesce(names.extension(path), F.lit(""))
    docs = ext.isin("md", "mdx", "txt", "rst") | names.any_part(path, ["docs", "doc"])
    sample = names.any_part(path, "example examples sample samples template templates".split()) & ext.isin("md", "txt", "rst")
    points = lambda test, n: F.when(test, n).otherwise(0)
    return points(docs, 250) + points(sample, 80) + points(path.contains("generated"), 150)


def comment_penalty(path: Column, line: Column, is_definition: Column, q: str) -> Column:
    """Hits that are in a comment only: the whole line, or after a ``//`` that is no part of an address."""
    line = text.trimmed(line)
    low = F.lower(line)
    hash_comment = line.startswith("#") & F.coalesce(names.extension(path), F.lit("")).isin(HASH_COMMENT_EXTENSIONS)
    at = F.locate("//", low)
    before = F.substring(low, F.lit(1), at - 1)
    after = F.substr(low, F.greatest(at, F.lit(1)))
    trailing = (at > 1) & ~before.endswith(":") & after.contains(q.lower()) & ~before.contains(q.lower())
    return F.when(is_definition, 0).when(line.rlike(r"^(?://(?!/)|/\*|<!--)") | hash_comment, 150).when(trailing, 100).otherwise(0)


def test_penalty(path: Column, q: str) -> Column:
    low = q.lower()
    wanted = "test" in low or "spec" in low or low.startswith("should")
    return F.lit(0) if wanted else F.when(names.is_test_path(path), 120).otherwise(0)


def fixture_penalty(path: Column) -> Column:
    return F.when(names.any_part(F.lower(path), names.FIXTURE_DIRS), 90).otherwise(0)


def vendor_penalty(path: Column) -> Column:
    return F.when(names.any_part(path, names.VENDOR_DIRS), 200).otherwise(0)


def context_boost(path: Column, context: str | None) -> Column:
    """Nearness to a file in view: its directory, or two leading parts in common."""
    if context is None:
        return F.lit(0)
    above = [p for p in context.split("/")[:-1] if p]
    same = names.parent(path) == "/".join(above)
    own = names.parts(names.parent(path))
    near = (F.slice(own, 1, 2) == F.array(*[F.lit(p) for p in above[:2]])) if len(above) >= 2 else F.lit(False)
    return F.when(same, 100).when(near, 40).otherwise(0)


def score(q: str, as_of: Column, context: str | None = None) -> Column:
    """Sum of all terms over the hit columns."""
    c = F.col
    definition = F.when(c("is_definition"), c("def_weight") * 10 + name_boost(c("def_name"), c("impl_target"), q)).otherwise(0)
    short = F.when((c("est_lines") > 0) & (c("est_lines") < 200), 50).otherwise(0)
    good = [
        definition, F.when(c("exact"), 500).otherwise(0), intent_boost(c("text"), q), words_boost(c("path"), c("text"), q), scope_proximity(c("path")),
        recency(c("mtime"), as_of), short, context_boost(c("path"), context), basename_boost(c("path"), q), export_boost(c("text")),
    ]
    bad = [prose_penalty(c("path")), comment_penalty(c("path"), c("text"), c("is_definition"), q), test_penalty(c("path"), q), fixture_penalty(c("path")), vendor_penalty(c("path"))]
    return (sum(good, F.lit(0)) - sum(bad, F.lit(0))).cast("int")


def stratum() -> Column:
    """Definitions of weight 60 or more come first, then other definitions, then usages."""
    return F.when(~F.col("is_definition"), 2).when(F.col("def_weight") >= 60, 0).otherwise(1)
