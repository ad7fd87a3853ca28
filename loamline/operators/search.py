"""Search over lines and symbols: hits, ranking, strata, facets, cascades and suggestions.

Inputs are files (path, size, mtime, content) and, for definitions, symbols (see ``sources.extract``). Results are exact:
all hits are ranked and counted, and limits only cut what is shown."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions import names, queries, rank, text
from loamline.operators import graph

SHOWN, SHOWN_IN_FULL = 10, 100
HIT = "path line text is_definition exact def_name def_weight impl_target start_line end_line est_lines mtime".split()


def searchable(files: DataFrame, glob: str | None = None) -> DataFrame:
    """Files that a search looks into; a glob narrows them before any content is read."""
    out = files.where(names.enters_walk(F.col("path"), F.col("size"))).where(F.col("content").isNotNull())
    out = out.where((F.col("size") < names.MINIFIED_FROM) | ~text.is_minified_text(F.col("content")))
    return out.where(text.matches_glob(F.col("path"), glob)) if glob else out


def file_lines(files: DataFrame) -> DataFrame:
    return text.lines(files.withColumn("est_lines", names.estimated_lines(F.col("size"))), "path", "mtime", "est_lines")


def _usage(rows: DataFrame, exact: Column) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    return rows.select(
        "path", "line", "text", F.lit(False).alias("is_definition"), exact.alias("exact"), none("string").alias("def_name"), F.lit(0).alias("def_weight"),
        none("string").alias("impl_target"), none("int").alias("start_line"), none("int").alias("end_line"), "est_lines", "mtime",
    )


def content_hits(files: DataFrame, pattern: str, is_regex: bool = False, glob: str | None = None) -> DataFrame:
    """Lines that hold a literal, or match a regular expression; one that does not compile is taken as a literal."""
    rows = searchable(files, glob)
    if is_regex:
        pattern, error = queries.java_pattern(files.sparkSession, pattern)
        if error is None:
            return _usage(file_lines(rows).where(F.col("text").rlike(pattern)), F.lit(False))
        pattern = re.sub(r"\\(.)", r"\1", pattern)
    # a file without the literal has no line with it: most contents are never split
    return _usage(file_lines(rows.where(F.col("content").contains(pattern))).where(F.col("text").contains(pattern)), F.lit(False))


def usage_hits(files: DataFrame, name: str, glob: str | None = None) -> DataFrame:
    """Lines that hold an identifier as a whole word."""
    rows = searchable(files, glob).where(F.col("content").contains(name))
    return _usage(file_lines(rows).where(text.flanked(F.col("text"), name)), F.lit(True))


def definition_hits(files: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """Definitions of a name, and implementations that name it; weights go by kind."""
    info = files.select("path", "mtime", names.estimated_lines(F.col("size")).alias("est_lines"))
    target = F.when(F.array_contains("implements", name), F.lit(name))
    own = symbols.where((F.col("name") == name) | F.array_contains("implements", name))
    weight = F.when(F.col("name") == name, rank.definition_weight(F.col("kind"))).otherwise(80)
    return own.join(info.hint(graph.MERGE), "path").select(
        "path", F.col("start_line").alias("line"), F.col("signature").alias("text"), F.lit(True).alias("is_definition"), F.lit(True).alias("exact"),
        F.col("name").alias("def_name"), weight.alias("def_weight"), F.when(F.col("name") != name, target).alias("impl_target"), "start_line", "end_line", "est_lines", "mtime",
    )


def heuristic_definition_hits(files: DataFrame, name: str) -> DataFrame:
    """Definition lines of files that no extractor reads: a keyword first, and the name as a whole word."""
    rows = searchable(files).where(F.col("content").contains(name))
    line = F.col("text")
    own = file_lines(rows).where(text.is_definition_line(line) & text.flanked(line, name))
    return _usage(own, F.lit(True)).withColumns({"is_definition": F.lit(True), "def_name": F.lit(name), "def_weight": F.lit(60), "start_line": F.col("line"), "end_line": F.col("line")})


def headings(files: DataFrame) -> DataFrame:
    """Markdown headings (path, line, level, title, end_line) outside of fenced code; a section ends before the next heading of its level or above."""
    rows = text.lines(files, "path")
    order = Window.partitionBy("path").orderBy("line")
    fence = F.col("text").rlike(r"^ {0,3}(?:```|~~~)")
    inside = F.sum(fence.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fenced", fence | (F.coalesce(inside, F.lit(0)) % 2 == 1))
    mark = F.regexp_extract("text", r"^ {0,3}(#{1,6})(?:\s|$)", 1)
    last = F.max(F.when(F.trim("text") != "", F.col("line"))).over(Window.partitionBy("path"))
    rows = rows.withColumns({"level": F.when(~F.col("fenced") & (mark != ""), F.length(mark)), "last": last})
    heads = rows.where("level IS NOT NULL").select("path", "line", "level", F.regexp_replace("text", r"^\s*#+\s*|\s*#*\s*$", "").alias("title"), "last")
    following = Window.partitionBy("path").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    nexts = [F.min(F.when(F.col("level") <= level, F.col("line"))).over(following) for level in range(1, 7)]
    ends = heads.withColumns({f"_n{k + 1}": n for k, n in enumerate(nexts)})
    own = F.lit(None).cast("int")
    for level in range(1, 7):
        own = F.when(F.col("level") == level, F.col(f"_n{level}")).otherwise(own)
    return ends.select("path", "line", "level", "title", F.coalesce(own - 1, F.greatest("last", "line")).alias("end_line"))


def heading_hits(files: DataFrame, name: str) -> DataFrame:
    """Markdown headings that hold a name, as definitions of weight 30."""
    docs = files.where(names.file_kind(F.col("path")) == "markdown").where(F.col("content").contains(name))
    info = docs.select("path", "mtime", names.estimated_lines(F.col("size")).alias("est_lines"))
    own = headings(docs).where(text.flanked(F.col("title"), name)).join(info, "path")
    return own.select(
        "path", "line", F.col("title").alias("text"), F.lit(True).alias("is_definition"), F.lit(True).alias("exact"), F.lit(name).alias("def_name"), F.lit(30).alias("def_weight"),
        F.lit(None).cast("string").alias("impl_target"), F.col("line").alias("start_line"), "end_line", "est_lines", "mtime",
    )


def without_definition_lines(usages: DataFrame, definitions: DataFrame) -> DataFrame:
    """Usages that are not on the line of a definition."""
    return usages.join(definitions.select("path", "line").distinct(), ["path", "line"], "left_anti")


def symbol_hits(files: DataFrame, symbols: DataFrame, name: str, glob: str | None = None) -> DataFrame:
    """Definitions, headings and usages of a name."""
    definitions = definition_hits(files, symbols, name).unionByName(heading_hits(files, name))
    return definitions.unionByName(without_definition_lines(usage_hits(files, name, glob), definitions))


def ranked(hits: DataFrame, q: str, as_of: Column, context: str | None = None) -> DataFrame:
    """Hits with score and stratum, the keys of the total order."""
    return hits.withColumns({"score": rank.score(q, as_of, context), "stratum": rank.stratum()})


ORDER = [F.asc, F.desc, F.asc, F.asc]
KEYS = ["stratum", "score", "path", "line"]


def top(hits: DataFrame, limit: int = SHOWN) -> DataFrame:
    """First ``limit`` of ranked hits, with ``place`` and ``total_found``; Spark keeps the best of each partition and merges these."""
    best = hits.orderBy(*[make(key) for make, key in zip(ORDER, KEYS, strict=True)]).limit(limit)
    place = F.row_number().over(Window.orderBy(*[make(key) for make, key in zip(ORDER, KEYS, strict=True)]))  # of ``limit`` rows
    return best.withColumn("place", place).withColumn("total_found", hits.agg(F.count("*")).scalar())


def facets(hits: DataFrame, packages: DataFrame) -> DataFrame:
    """Hits with their facet: implementation, definition, test, local or other, by the package of the first definition in rank order."""
    owned = hits.join(packages, "path", "left")
    order = F.struct("stratum", (-F.col("score")).alias("s"), "path", "line")
    local = F.col("package") == owned.where("is_definition").agg(F.min_by("package", order)).scalar()
    facet = (
        F.when(F.col("is_definition") & F.col("impl_target").isNotNull(), "implementation").when(F.col("is_definition"), "definition")
        .when(text.is_test_hit(F.col("path"), F.col("text")), "test").when(F.coalesce(local, F.lit(False)), "local").otherwise("other")
    )
    return owned.withColumn("facet", facet)


def facet_totals(faceted: DataFrame) -> DataFrame:
    return faceted.groupBy("facet").agg(F.count("*").alias("hits"))


def first_filled(*branches: tuple[str, DataFrame]) -> tuple[str, DataFrame] | None:
    """First branch that has rows: a cascade runs no later branch."""
    for name, rows in branches:
        if not rows.isEmpty():
            return name, rows
    return None


def multi_word_pattern(q: str) -> str:
    """Regular expression for a query of several words: two in either order on a line, or any of three and more."""
    words = [re.escape(w) for w in q.split()]
    return f"{words[0]}.*{words[1]}|{words[1]}.*{words[0]}" if len(words) == 2 else "|".join(words)


def batch_hits(files: DataFrame, wanted: DataFrame, limit: int = SHOWN) -> DataFrame:
    """Hits of many literals in one pass: ``wanted`` has (query_no, query); the first ``limit`` of each by path and line, with totals.

    Contents without any of the literals are not split. Queries are at most ten, and so is what the driver sees of them."""
    asked = [tuple(r) for r in wanted.select("query_no", "query").limit(11).collect()]
    if len(asked) > 10:
        raise ValueError("a batch has at most ten queries")
    literals = [q for _, q in asked if q is not None]
    rows = file_lines(searchable(files).where(text.holds(F.col("content"), literals) if literals else F.lit(False)))
    hit = F.array_compact(F.array(*[F.when(F.col("text").contains(q), F.lit(n)) for n, q in asked if q is not None])) if literals else F.array().cast("array<int>")
    found = rows.select(F.explode(hit).alias("query_no"), "path", "line", "text").withColumn("query_no", F.col("query_no").cast(wanted.schema["query_no"].dataType))
    totals = found.groupBy("query_no").agg(F.count("*").alias("total_found"))
    order = Window.partitionBy("query_no").orderBy("path", "line")
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    return best.join(F.broadcast(totals), "query_no")  # at most ten rows


def boost_term(hits: DataFrame) -> DataFrame:
    """Hits with the term that lines of their expansion are weighed by: what is implemented, else what is defined."""
    return hits.withColumn("boost", F.coalesce("impl_target", "def_name"))


def markdown_scopes(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Hits (path, line) with the heading of the deepest section that they are in, or null; a heading's line is in its own section."""
    spans = headings(files.where(names.file_kind(F.col("path")) == "markdown")).select("path", F.col("line").alias("first"), F.col("end_line").alias("last"), "title", "level")
    found = graph.in_spans(hits.select("path", "line").distinct(), spans).groupBy("path", "line").agg(F.max_by("title", "first").alias("title"))
    return hits.join(found, ["path", "line"], "left")


def grouped_lines(hits: DataFrame) -> DataFrame:
    """(path, label) with the runs of a file's lines: 50,55-58; two lines in a row stay two."""
    order = Window.partitionBy("path").orderBy("line")
    island = hits.select("path", "line").distinct().withColumn("island", F.col("line") - F.row_number().over(order))
    runs = island.groupBy("path", "island").agg(F.min("line").alias("a"), F.max("line").alias("b"))
    label = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).when(F.col("b") == F.col("a") + 1, F.concat_ws(",", "a", "b")).otherwise(F.concat_ws("-", "a", "b"))
    each = F.sort_array(F.collect_list(F.struct("a", label.alias("label"))))
    return runs.groupBy("path").agg(F.array_join(F.transform(each, lambda x: x["label"]), ",").alias("label"))


def glob_files(files: DataFrame, *globs: str, depth: int | None = None, limit: int = 20) -> DataFrame:
    """Paths that any glob fits, in order, with their number; at most twenty globs."""
    if not 1 <= len(globs) <= 20:
        raise ValueError("between one and twenty globs")
    some = F.lit(False)
    for glob in globs:
        some = some | text.matches_glob(F.col("path"), glob)
    hits = files.where(some & ~names.in_skipped_dir(F.col("path")))
    hits = hits.where(names.depth(F.col("path")) <= depth) if depth else hits
    return hits.select("path", "size").orderBy("path").limit(limit).withColumn("total_found", hits.agg(F.count("*")).scalar())


def extensions(files: DataFrame, limit: int = 10) -> DataFrame:
    """Extensions that there are, for a glob that fits nothing."""
    return files.select(names.extension(F.col("path")).alias("ext")).where("ext IS NOT NULL").distinct().orderBy("ext").limit(limit)


def similar_names(files: DataFrame, folder: str, name: str, most: int = 3) -> DataFrame:
    """Names in a folder within a few edits of one, nearest first."""
    base = names.basename(F.col("path"))
    near = files.where(names.parent(F.col("path")) == folder).select(base.alias("name"), F.levenshtein(base, F.lit(name), most).alias("distance"))
    return near.where(F.col("distance") >= 0).orderBy("distance", "name").limit(1)


def subsequence_score(candidate: Column, q: str) -> Column:
    """How well the characters of q run through a text in order: null if they do not, else more for fewer and shorter gaps and for a match in the name."""
    low = F.lower(candidate)
    pattern = ".*?".join(re.escape(c) for c in q.lower())
    found = F.regexp_extract(low, f"({pattern})", 1)
    in_name = names.basename(low).rlike(pattern)
    return F.when(found != "", 100 - F.least(F.lit(80), F.length(found) - len(q)) + F.when(in_name, 20).otherwise(0) - F.least(F.lit(10), F.floor(F.length(candidate) / 20)))


def suggested(candidates: DataFrame, column: str, q: str, limit: int = 3) -> DataFrame:
    """Best candidates for a query that found nothing; ties go by name."""
    scored = candidates.select(column).distinct().withColumn("score", subsequence_score(F.col(column), q))
    return scored.where("score IS NOT NULL").orderBy(F.desc("score"), column).limit(limit)


def suggested_headings(files: DataFrame, title: str, limit: int = 5) -> DataFrame:
    return headings(files).select("title", F.levenshtein(F.lower("title"), F.lit(title.lower())).alias("distance")).distinct().orderBy("distance", "title").limit(limit)


def basename_file(files: DataFrame, q: str) -> DataFrame:
    """The file that a query names by its stem: the best kind of source, then the first path."""
    ext = F.coalesce(names.extension(F.col("path")), F.lit(""))
    code = names.file_kind(F.col("path")).startswith("code:")
    priority = F.when(ext.isin("ts", "tsx"), 10).when(ext.isin("js", "jsx", "mjs", "cjs"), 7).when(code, 9).otherwise(3)
    return files.where(F.lower(names.stem(F.col("path"))) == q.lower()).select("path", priority.alias("priority")).orderBy(F.desc("priority"), "path").limit(1)


def seen_anywhere(files: DataFrame, literal: str) -> DataFrame:
    """One row: whether any content holds a literal."""
    return files.agg(F.coalesce(F.bool_or(F.col("content").contains(literal)), F.lit(False)).alias("seen"))


def changed_since(hits: DataFrame, since: Column) -> DataFrame:
    """Hits whose text is redacted in files that have not changed; files without a time count as changed."""
    changed = F.coalesce(F.col("mtime") > since, F.lit(True))
    return hits.withColumns({"changed": changed, "text": F.when(changed, F.col("text")).otherwise("(unchanged)")})


def redacted(hits: DataFrame) -> DataFrame:
    """Hits without the text of files that commonly hold secrets; their paths stay."""
    return hits.withColumn("text", F.when(names.is_secret_name(F.col("path")), "(redacted)").otherwise(F.col("text")))


def expanded(hits: DataFrame, budget: int) -> DataFrame:
    """Ranked hits with ``expand``: the best of each file, up to ``budget`` files."""
    order = [make(key) for make, key in zip(ORDER, KEYS, strict=True)]
    best = hits.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(*order))).where("_n = 1")
    chosen = best.orderBy(*order).limit(budget).select("path", "line", F.lit(True).alias("expand"))
    return hits.join(F.broadcast(chosen), ["path", "line"], "left").withColumn("expand", F.coalesce("expand", F.lit(False)))  # ``budget`` rows
