"""Code graph: callers, callees, imports, dependencies, impact, enclosing scopes, maps and fingerprints."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions import names, text

SECOND_HOP_FROM, SECOND_HOP_SHOWN = 10, 15
EXPORTS, DEPENDENTS, RELATED = 25, 15, 8
# Names of the standard libraries that dependencies leave out.
PYTHON_LIBRARY = "os sys re json math time datetime pathlib typing collections functools itertools abc io logging unittest dataclasses enum copy hashlib subprocess threading asyncio".split()
GO_LIBRARY = (
    "archive bufio bytes cmp compress container context crypto database debug embed encoding errors flag fmt go hash html image index io log maps math mime net os path plugin "
    "reflect regexp runtime slices sort strconv strings sync syscall testing text time unicode unsafe"
).split()
RUST_LIBRARY = ["std::", "core::", "alloc::"]


def callers(calls: DataFrame, targets: DataFrame, context: str | None = None) -> DataFrame:
    """Call sites of ``targets`` (target, ord), the few names of a request, in request order, then a context file first, then shallow paths first."""
    found = calls.join(F.broadcast(targets), calls["callee"] == targets["target"])  # without a word the calls can be guessed to be the smaller side
    near = (F.col("path") != context) if context else F.lit(False)
    return found.select("ord", "target", "path", "line", "caller", "owner", near.alias("_far"), names.depth(F.col("path")).alias("_depth")).orderBy("ord", "_far", "_depth", "path", "line").drop("_far", "_depth")


def second_hop(calls: DataFrame, hits: DataFrame, limit: int = SECOND_HOP_SHOWN) -> DataFrame:
    """Callers of the callers, if these are few: distinct (caller, path), without call sites of the first hop."""
    first = hits.where("caller IS NOT NULL").select("caller").distinct()
    start = first.where(first.agg(F.count("*") <= SECOND_HOP_FROM).scalar()).select(F.col("caller").alias("via"))
    found = calls.join(F.broadcast(start), calls["callee"] == start["via"])  # at most SECOND_HOP_FROM names
    found = found.join(hits.select("path", "line").distinct().hint(MERGE), ["path", "line"], "left_anti")
    return found.where("caller IS NOT NULL").groupBy("caller", "path").agg(F.min("line").alias("line"), F.min("via").alias("via")).orderBy("path", "line", "caller").limit(limit)


#: Joins of sides that both grow with the corpus are told to be merges: sizes of what code makes are guessed far too low, and a side
#: that is taken for small would pass whole through the driver.
MERGE = "merge"
SPAN_BLOCK = 256  #: spans and lines meet by path and block of so many lines, so a long file is many small groups


def in_spans(lines: DataFrame, spans: DataFrame, *keys: str, few: bool = False) -> DataFrame:
    """Pairs of ``lines`` (path, line, ...) and ``spans`` (path, first, last, ...) with the line in the span; columns must differ but for the path and ``keys``.

    Spans that a request states are ``few``, and may be held by every task."""
    block = lambda c: F.floor(F.col(c) / SPAN_BLOCK)
    held = spans.where("first <= last").withColumn("_block", F.explode(F.sequence(block("first"), block("last"))))
    return lines.withColumn("_block", block("line")).join(held if few else held.hint(MERGE), ["path", *keys, "_block"]).where("line BETWEEN first AND last").drop("_block")


def enclosing(hits: DataFrame, symbols: DataFrame, strict_header: bool = True) -> DataFrame:
    """Innermost definition around each (path, line), with its parent; null outside of any.

    With ``strict_header`` the first line of a member belongs to what is around it."""
    first = F.when(F.col("parent").isNotNull() & F.lit(strict_header), F.col("start_line") + 1).otherwise(F.col("start_line"))
    spans = symbols.select("path", "name", "kind", "parent", "start_line", first.alias("first"), F.col("end_line").alias("last"))
    found = in_spans(hits.select("path", "line").distinct(), spans)
    best = F.max_by(F.struct("name", "kind", "parent"), F.struct("start_line", (-F.col("last")).alias("e")))
    inner = found.groupBy("path", "line").agg(best.alias("in")).select("path", "line", F.col("in.name").alias("in_name"), F.col("in.kind").alias("in_kind"), F.col("in.parent").alias("in_parent"))
    return hits.join(inner.hint(MERGE), ["path", "line"], "left")


def outline_entries(symbols: DataFrame) -> DataFrame:
    """Entries (path, entry, entry_name, first, last) of each file's outline, numbered in order."""
    number = F.row_number().over(Window.partitionBy("path").orderBy("start_line", "ord"))
    return symbols.select("path", number.alias("entry"), F.col("name").alias("entry_name"), F.col("start_line").alias("first"), F.col("end_line").alias("last"))


def entry_of(hits: DataFrame, entries: DataFrame) -> DataFrame:
    """``hits`` (path, line, ...) with ``entry``, the first outline entry that the line is in, or null."""
    found = in_spans(hits.select("path", "line").distinct(), entries).groupBy("path", "line").agg(F.min("entry").alias("entry"))
    return hits.join(found.hint(MERGE), ["path", "line"], "left")


def outline_context(hits: DataFrame, symbols: DataFrame, around: int = 2) -> DataFrame:
    """(path, line, entry, entry_name, here): outline entries around the one that holds each hit, which ``here`` marks."""
    entries = outline_entries(symbols)
    own = entry_of(hits.select("path", "line").distinct(), entries).where("entry IS NOT NULL").withColumnRenamed("entry", "at")
    near = own.withColumn("entry", F.explode(F.sequence(F.col("at") - around, F.col("at") + around)))
    return near.join(entries.hint(MERGE), ["path", "entry"]).select("path", "line", "entry", "entry_name", (F.col("entry") == F.col("at")).alias("here"))


def usage_groups(shown: DataFrame, symbols: DataFrame, least_lines: int = 50) -> DataFrame:
    """``shown`` hits (place, path, line, is_definition, impl_target, def_name, start_line, end_line, est_lines) in groups, in display order.

    Neighbours in display order that are usages in one entry of a file of ``least_lines`` or more are one group; a definition
    is a group of its own, and is shown once. What is shown is bounded, and so is the window over it."""
    own = F.col("is_definition") | F.col("impl_target").isNotNull()
    same = Window.partitionBy(own, "path", "line", "start_line", "end_line", "def_name", "impl_target").orderBy("place")
    once = shown.withColumn("_n", F.row_number().over(same)).where(~own | (F.col("_n") == 1))
    rows = entry_of(once.drop("_n"), outline_entries(symbols))
    before = lambda c: F.lag(c).over(Window.orderBy("place"))
    joins = ~own & ~F.coalesce(before(own), F.lit(True)) & (before("path") == F.col("path")) & (F.col("est_lines") >= least_lines) & (before("entry") == F.col("entry"))
    begins = rows.withColumn("_begins", (~F.coalesce(joins, F.lit(False))).cast("int"))
    grouped = begins.withColumn("group", F.sum("_begins").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    out = grouped.groupBy("group").agg(F.min("place").alias("place"), F.first("path").alias("path"), F.array_sort(F.collect_list("line")).alias("lines"), F.bool_or(own).alias("is_definition"))
    return out.orderBy("group")


def lookup(wanted: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Outcome of each of ``wanted`` (path, name): found with the first such definition's span, missing, or unavailable where no code can be read."""
    code = files.where(names.file_kind(F.col("path")).startswith("code:") & F.col("content").isNotNull())
    lines = F.when(F.col("content") == "", 0).otherwise(F.length(F.regexp_replace("content", "[^\n]", "")) + F.when(F.col("content").endswith("\n"), 0).otherwise(1))
    there = code.select("path", lines.alias("lines"))
    spans = symbols.groupBy("path", "name").agg(F.min_by(F.struct("start_line", "end_line"), F.struct("start_line", "ord")).alias("at"))
    own = wanted.join(there.hint(MERGE), "path", "left").join(spans.hint(MERGE), ["path", "name"], "left")
    outcome = F.when(F.col("lines").isNull(), "unavailable").when(F.col("at").isNull(), "missing").otherwise("found")
    return own.select("path", "name", outcome.alias("outcome"), F.col("at.start_line").alias("start_line"), F.col("at.end_line").alias("end_line"), "lines")


def import_candidates(imports: DataFrame) -> DataFrame:
    """(path, source, line, ord, place, candidate): paths that an import may mean, in the order in which they are tried."""
    folder, src = names.parent(F.col("path")), F.col("source")
    joined = lambda a, b: F.when(a == "", b).otherwise(F.concat(a, F.lit("/"), b))
    dots = F.length(F.regexp_extract(src, r"^(\.*)", 1))
    tail = F.replace(F.regexp_replace(src, r"^\.+", ""), F.lit("."), F.lit("/"))
    up = F.array_join(F.slice(F.split(folder, "/"), F.lit(1), F.greatest(F.size(F.split(folder, "/")) - (dots - 1), F.lit(0))), "/")
    at = F.when(dots > 0, F.when(tail == "", up).otherwise(joined(up, tail))).otherwise(tail)
    python = F.array(F.concat(at, F.lit(".py")), F.concat(at, F.lit("/__init__.py")))
    relative = joined(folder, F.regexp_replace(src, r"^\./", ""))
    script = F.concat(F.array(relative), *[F.array(F.concat(relative, F.lit(e))) for e in (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")])
    own = F.regexp_replace(F.regexp_replace(src, r"^(?:crate|self|super)::", ""), "::", "/")
    root = F.regexp_extract("path", r"^(.*?src)/", 1)
    base = F.when(src.startswith("crate::"), root).when(src.startswith("super::"), names.parent(folder)).otherwise(folder)
    shorter = F.regexp_replace(own, "/[^/]+$", "")
    rust = F.array(*[joined(base, F.concat(x, F.lit(e))) for x in (own, shorter) for e in (".rs", "/mod.rs")])
    quoted = F.regexp_extract(src, '^"(.*)"$', 1)
    lang = F.col("lang")
    local = src.rlike(r"^\.")
    tried = (
        F.when(lang == "python", python).when(lang.isin("javascript", "typescript", "tsx") & local, script)
        .when((lang == "rust") & src.rlike("^(?:crate|self|super)::"), rust).when(lang.isin("c", "cpp") & (quoted != ""), F.array(joined(folder, quoted), quoted))
        .when((lang == "bash") & local, F.array(relative)).otherwise(F.array().cast("array<string>"))
    )
    return imports.select("path", "lang", "source", "line", "ord", F.posexplode(tried).alias("place", "candidate"))


def normal_path(path: Column) -> Column:
    """A path with ``.`` parts dropped and ``..`` parts applied."""
    step = lambda done, p: F.when(p == ".", done).when((p == "..") & (F.size(done) > 0), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(p)))
    return F.array_join(F.aggregate(names.parts(path), F.array().cast("array<string>"), step), "/")


def resolved_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports with ``target``: the first candidate that is a file of the corpus, else null."""
    tried = import_candidates(imports).withColumn("candidate", normal_path(F.col("candidate")))
    there = tried.join(files.select(F.col("path").alias("candidate")).distinct().hint(MERGE), "candidate")
    first = there.groupBy("path", "source", "line", "ord").agg(F.min_by("candidate", "place").alias("target"))
    return imports.join(first.hint(MERGE), ["path", "source", "line", "ord"], "left")


def related_files(resolved: DataFrame, path: str, limit: int = RELATED) -> DataFrame:
    """First files that a file imports, in order."""
    own = resolved.where((F.col("path") == path) & F.col("target").isNotNull()).groupBy("target").agg(F.min("ord").alias("ord"))
    return own.orderBy("ord").limit(limit)


def folder_definitions(definitions: DataFrame) -> DataFrame:
    """Of the files of each folder that define a name, the first two by path: a caller means the first that is not its own file.

    All of them beside each caller would be the square of a folder's files for a name that each of these defines."""
    each = definitions.groupBy("folder", "callee", "target_path").agg(F.min("target_line").alias("target_line"))
    order = Window.partitionBy("folder", "callee").orderBy("target_path")
    return each.withColumn("_n", F.row_number().over(order)).where("_n <= 2").drop("_n")


def resolved_callees(calls: DataFrame, symbols: DataFrame, resolved: DataFrame) -> DataFrame:
    """(path, caller, callee, line, target_path, target_line): the definition that a call means, in its own file first, then in
    imported files in import order, then in Go files of its folder; calls without one are external and have nulls."""
    definitions = symbols.select(F.col("path").alias("target_path"), F.col("name").alias("callee"), F.col("start_line").alias("target_line"))
    wanted = calls.select("path", "lang", "callee").distinct()
    own = wanted.join(definitions.hint(MERGE), (wanted["path"] == definitions["target_path"]) & (wanted["callee"] == definitions["callee"])).select("path", wanted["callee"], "target_path", "target_line", F.lit(0).alias("by"), F.lit(0).alias("ord"))
    links = resolved.where("target IS NOT NULL").groupBy("path", F.col("target").alias("target_path")).agg(F.min("ord").alias("ord"))
    through = wanted.join(links.hint(MERGE), "path").join(definitions.hint(MERGE), ["target_path", "callee"]).select("path", "callee", "target_path", "target_line", F.lit(1).alias("by"), "ord")
    folder = lambda c: names.parent(F.col(c))
    go = definitions.where(F.col("target_path").endswith(".go") & ~F.col("target_path").endswith("_test.go")).withColumn("folder", folder("target_path"))
    beside = wanted.where("lang = 'go'").withColumn("folder", folder("path")).join(folder_definitions(go).hint(MERGE), ["folder", "callee"]).where("path <> target_path").select("path", "callee", "target_path", "target_line", F.lit(2).alias("by"), F.lit(0).alias("ord"))
    order = F.struct("by", "ord", "target_path", "target_line")
    best = own.union(through).union(beside).groupBy("path", "callee").agg(F.min(order).alias("t"))
    found = calls.join(best.hint(MERGE), ["path", "callee"], "left")
    return found.select("path", "caller", "callee", "line", F.col("t.target_path").alias("target_path"), F.col("t.target_line").alias("target_line"))


def callee_names(calls: DataFrame, path: str, start: int, end: int) -> DataFrame:
    """Distinct names called in a span, sorted."""
    return calls.where((F.col("path") == path) & F.col("line").between(start, end)).select("callee").distinct().orderBy("callee")


def two_hops(edges: DataFrame, path: str, caller: str, limit: int = 15) -> DataFrame:
    """(hop, path, callee, line) of what a definition calls and what these call in turn, without going back to it; hop two is limited in order."""
    start = edges.where((F.col("path") == path) & (F.col("caller") == caller) & F.col("target_path").isNotNull())
    first = start.groupBy("callee", "target_path", "target_line").agg(F.min("line").alias("line"))
    near = first.select(F.lit(1).alias("hop"), F.col("target_path").alias("path"), "callee", F.col("target_line").alias("line"))
    again = first.select(F.col("callee").alias("caller"), F.col("target_path").alias("path"), F.col("line").alias("first_line"))
    seen = first.select("target_path", "target_line")
    second = edges.where("target_path IS NOT NULL").join(again.hint(MERGE), ["path", "caller"]).join(seen.hint(MERGE), ["target_path", "target_line"], "left_anti")
    second = second.where(~((F.col("target_path") == path) & (F.col("callee") == caller)))
    far = second.groupBy("callee", "target_path", "target_line").agg(F.min(F.struct("first_line", "line")).alias("o")).orderBy("o", "target_path", "callee").limit(limit)
    return near.union(far.select(F.lit(2), "target_path", "callee", "target_line"))


def is_external(lang: Column, source: Column) -> Column:
    """Whether an import names something from outside by its form alone, which languages that need a build to tell always do."""
    return (
        F.when(lang == "rust", ~text.begins(source, ["crate::", "self::", "super::"])).when(lang.isin("javascript", "typescript", "tsx"), ~text.begins(source, [".", "@/", "~/"]))
        .when(lang.isin("python", "bash"), ~source.startswith(".")).when(lang.isin("c", "cpp"), ~source.startswith('"')).otherwise(True)
    )


def is_library(lang: Column, source: Column) -> Column:
    root = lambda sep: F.substring_index(source, sep, 1)
    return (
        F.when(lang == "python", root(".").isin(PYTHON_LIBRARY)).when(lang == "go", root("/").isin(GO_LIBRARY))
        .when(lang == "rust", text.begins(source, RUST_LIBRARY)).otherwise(False)
    )


def is_module_name(source: Column) -> Column:
    return source.rlike(r"^[\w@./:\-<>\"]+$") & ~source.rlike(r"^\W*$")


def external_modules(resolved: DataFrame) -> DataFrame:
    """(path, source): modules from outside of the corpus, standard libraries left out."""
    own = resolved.where(F.col("target").isNull() & ~is_library(F.col("lang"), F.col("source")) & is_module_name(F.col("source")))
    return own.select("path", "source").distinct()


def dependencies(path: str, resolved: DataFrame, calls: DataFrame, symbols: DataFrame) -> dict[str, DataFrame]:
    """What a file uses and what uses it: local (target, names), external (source), exports (name), dependents (path, names, total)."""
    edges = resolved_callees(calls, symbols, resolved)
    local = edges.where((F.col("path") == path) & (F.col("target_path") != path)).groupBy("target_path").agg(F.array_sort(F.collect_set("callee")).alias("names"))
    imported = resolved.where((F.col("path") == path) & F.col("target").isNotNull()).select(F.col("target").alias("target_path")).distinct()
    local = imported.join(local, "target_path", "full").select("target_path", F.coalesce("names", F.array().cast("array<string>")).alias("names"))
    exports = symbols.where((F.col("path") == path) & F.col("parent").isNull() & ~is_placeholder(F.col("name"))).select("name").distinct().orderBy(F.desc(F.length("name")), "name").limit(EXPORTS)
    using = edges.where((F.col("target_path") == path) & (F.col("path") != path)).groupBy("path").agg(F.array_sort(F.collect_set("callee")).alias("names"))
    importing = resolved.where((F.col("target") == path) & (F.col("path") != path)).select("path").distinct()
    using = importing.join(using, "path", "full").select("path", F.coalesce("names", F.array().cast("array<string>")).alias("names"))
    here = "/".join(path.split("/")[:-1])
    order = [names.parent(F.col("path")) != here, names.is_test_path(F.col("path")), F.col("path")]
    dependents = using.orderBy(*order).limit(DEPENDENTS).withColumn("total", using.agg(F.count("*")).scalar())
    return {"local": local, "external": external_modules(resolved.where(F.col("path") == path)), "exports": exports, "dependents": dependents}


def is_placeholder(name: Column) -> Column:
    return name.startswith("<") | name.startswith("impl ") | (F.length(name) <= 1)


def siblings(symbols: DataFrame, path: str, parent: str, name: str, body: str, limit: int = 6) -> DataFrame:
    """Members of a parent that a body refers to through ``self``, ``this`` or a receiver: functions first, then by name."""
    referred = sorted(set(re.findall(r"\b(?:self|this|[a-z])\s*\.\s*([A-Za-z_]\w*)", body)))
    own = symbols.where((F.col("path") == path) & (F.col("parent") == parent) & (F.col("name") != name) & F.col("name").isin(referred))
    first = own.groupBy("name").agg(F.min(F.struct("start_line", "kind", "signature")).alias("s")).select("name", "s.*")
    return first.orderBy(~F.col("kind").isin("function", "method"), "name").limit(limit)


def by_owner(symbols: DataFrame, spec: str) -> DataFrame:
    """Definitions that ``Owner::name``, ``Owner.name`` or a plain name means."""
    parts = [p for p in re.split(r"::|\.", spec) if p]
    own = symbols.where(F.col("name") == parts[-1])
    return own if len(parts) == 1 else own.where(F.substring_index(F.coalesce("parent", F.lit("")), ".", -1) == parts[-2])


def owners(symbols: DataFrame, name: str) -> DataFrame:
    """Owners that do have a member of a name, for a lookup that found none."""
    return symbols.where((F.col("name") == name) & F.col("parent").isNotNull()).select("parent").distinct().orderBy("parent")


def directory_totals(files: DataFrame) -> DataFrame:
    """(dir, files, bytes, tokens, tokens_of_files) of every directory: tokens of the sum, and the sum of each file's tokens."""
    each = files.select("size", F.explode(names.ancestors(F.col("path"))).alias("dir"))
    out = each.groupBy("dir").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum(text.tokens_of_bytes(F.col("size"))).alias("tokens_of_files"))
    return out.withColumn("tokens", text.tokens_of_bytes(F.col("bytes")))


def code_map(files: DataFrame, symbols: DataFrame, depth: int = 3) -> DataFrame:
    """(dir, path, tokens, names) of files down to a depth, with top-level definitions in order."""
    tops = symbols.where("parent IS NULL").groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("start_line", "name"))), lambda x: x["name"]).alias("names"))
    own = files.where((names.depth(F.col("path")) <= depth) & ~names.in_skipped_dir(F.col("path")))
    return own.join(tops.hint(MERGE), "path", "left").select(names.parent(F.col("path")).alias("dir"), "path", text.tokens_of_bytes(F.col("size")).alias("tokens"), F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def import_groups(imports: DataFrame, limit: int = 5) -> DataFrame:
    """Sources that a file imports, with counts, in the order in which they are first seen."""
    own = imports.groupBy("path", "source").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    return own.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("line", "source"))).where(F.col("place") <= limit)


def hot_files(resolved: DataFrame, least: int = 2, limit: int = 5) -> DataFrame:
    """Files that most others import."""
    return resolved.where("target IS NOT NULL AND target <> path").groupBy("target").agg(F.countDistinct("path").alias("imported_by")).where(F.col("imported_by") >= least).orderBy(F.desc("imported_by"), "target").limit(limit)


def languages(files: DataFrame) -> DataFrame:
    """Code files by language, most first."""
    kind = names.file_kind(F.col("path"))
    return files.where(kind.startswith("code:")).groupBy(F.substr(kind, F.lit(6)).alias("lang")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "lang")


def modules(files: DataFrame, lang: str, least: int = 2, limit: int = 10) -> DataFrame:
    """Top-level folders with at least two files of a language; a folder that all are in is looked into."""
    own = files.where(names.file_kind(F.col("path")) == f"code:{lang}").select(names.parts(names.parent(F.col("path"))).alias("p"))
    shared = own.agg(F.min("p").alias("a"), F.max("p").alias("b")).first()
    common = 0
    while shared and shared["a"] and shared["b"] and common < min(len(shared["a"]), len(shared["b"])) and shared["a"][common] == shared["b"][common]:
        common += 1
    place = own.select(F.try_element_at("p", F.lit(common + 1)).alias("module")).where("module IS NOT NULL")
    return place.groupBy("module").agg(F.count("*").alias("files")).where(F.col("files") >= least).orderBy(F.desc("files"), "module").limit(limit)


def fingerprint(files: DataFrame, resolved: DataFrame) -> dict[str, list]:
    """Summary of a project: languages, modules of the first, whether tests are in files of their own, hot files."""
    langs = [tuple(r) for r in languages(files).limit(5).collect()]
    first = langs[0][0] if langs else ""
    tests = files.where(names.is_test_path(F.col("path")) | F.col("path").rlike(r"(?:^|/)tests?/|_test\.")).count()
    return {"languages": langs, "modules": [tuple(r) for r in modules(files, first).collect()] if langs else [], "test_files": [tests], "hot": [tuple(r) for r in hot_files(resolved).collect()]}
