"""Views of contents: read modes, spans, outlines, noise stripping, line selection and budgets."""

from __future__ import annotations

import json
import re
import tomllib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions import names, text
from loamline.operators.graph import MERGE, in_spans

OUTLINE_FROM, FULL_BYTES = 6000, 2_000_000
DIVERSE_FROM, DIVERSE_LINES = 80, 40
DEFAULT_BUDGET = 24_000


def read_mode(files: DataFrame, full: bool = False) -> DataFrame:
    """Files with ``mode``: empty, binary, generated, minified, too large, full or outline, by the first rule that fits."""
    path, size, content = F.col("path"), F.col("size"), F.col("content")
    binary = F.col("is_binary") if "is_binary" in files.columns else F.lit(False)
    minified = names.is_minified_name(path) | ((size >= names.MINIFIED_FROM) & F.coalesce(text.is_minified_text(content), F.lit(False)))
    mode = (
        F.when(size == 0, "empty").when(binary, "binary").when(names.is_lock_file(path) | F.coalesce(text.is_generated_text(content), F.lit(False)), "generated")
        .when(minified, "minified").when(F.lit(full) & (size > FULL_BYTES), "too_large").when(F.lit(full) | (text.tokens_of_bytes(size) <= OUTLINE_FROM), "full").otherwise("outline")
    )
    return files.withColumn("mode", mode)


def read_ranges(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lines of ``ranges`` (ord, path, first, last) in request order; overlaps are given each time."""
    wanted = ranges.join(files.select("path", "size"), "path").withColumn("last", F.least("last", F.col("size") + 1)).drop("size")
    return in_spans(text.lines(files, "path"), wanted, few=True).select("ord", "path", "line", "text").orderBy("ord", "line")


def skipped_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (path, line, text) with ``skip``: all but the first of blank lines in a row, debug logs, and plain comments.

    Files whose comment family is unknown keep all lines."""
    line, kind = text.trimmed(F.col("text")), text.family(F.col("path"))
    order = Window.partitionBy("path").orderBy("line")
    blank = F.col("text").rlike(r"^\s*$")
    again = blank & F.coalesce(F.lag(blank).over(order), F.lit(False))
    noise = ~blank & (text.is_debug_log(line, kind) | text.is_plain_comment(line, kind))
    return lines.withColumn("skip", F.when(kind.isNull(), False).otherwise(again | noise))


def stripped(files: DataFrame) -> DataFrame:
    """(path, line, text) without noise."""
    return skipped_lines(text.lines(files, "path")).where("NOT skip").drop("skip")


def strip_counts(files: DataFrame) -> DataFrame:
    return skipped_lines(text.lines(files, "path")).groupBy("path").agg(F.count("*").alias("lines"), F.count_if("skip").alias("skipped"))


def diverse_lines(lines: DataFrame, q: str | None = None, least: int = DIVERSE_FROM, most: int = DIVERSE_LINES) -> DataFrame:
    """The most important lines of each path in order: all if fewer than ``least``; hits of ``q`` get 50 more, their neighbours 5."""
    whole = Window.partitionBy("path")
    order = whole.orderBy("line")
    edge = (F.col("line") == F.min("line").over(whole)) | (F.col("line") == F.max("line").over(whole))
    points = text.line_score(text.trimmed(F.col("text")), edge)
    if q:
        hit = F.lower("text").contains(q.lower())
        beside = F.coalesce(F.lag(hit).over(order), F.lit(False)).cast("int") + F.coalesce(F.lead(hit).over(order), F.lit(False)).cast("int")
        points = points + F.when(hit, 50).otherwise(0) + 5 * beside
    scored = lines.withColumns({"score": points, "n": F.count("*").over(whole)})
    place = F.row_number().over(whole.orderBy(F.desc("score"), "line"))
    return scored.withColumn("place", place).where((F.col("n") < least) | (F.col("place") <= most)).select("path", "line", "text", "score")


def gaps(kept: DataFrame) -> DataFrame:
    """Kept lines with ``gap``: how many lines are left out before, where more than three are."""
    before = F.lag("line").over(Window.partitionBy("path").orderBy("line"))
    return kept.withColumn("gap", F.when(F.col("line") - before > 4, F.col("line") - before - 1))


def head_tail(lines: DataFrame, head: int = 10, tail: int = 5) -> DataFrame:
    """First and last lines of each path; all where these meet."""
    own = lines.withColumn("n", F.count("*").over(Window.partitionBy("path")))
    return own.where((F.col("line") <= head) | (F.col("line") > F.col("n") - tail))


def tabular_outline(files: DataFrame) -> DataFrame:
    """(path, header, rows, shown): number of rows below the header, the first five and the last three."""
    lines = text.lines(files, "path")
    own = lines.groupBy("path").agg(F.max(F.when(F.col("line") == 1, F.col("text"))).alias("header"), (F.count("*") - 1).alias("rows"))
    body = lines.where("line > 1").join(own, "path").where("line <= 6 OR line > rows - 2")
    shown = body.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]).alias("shown"))
    return own.join(shown, "path", "left").select("path", "header", "rows", F.coalesce("shown", F.array().cast("array<string>")).alias("shown"))


def yaml_outline(files: DataFrame, depth: int = 2) -> DataFrame:
    """(path, line, level, key) of keys no deeper than ``depth``, two spaces a level."""
    lines = text.lines(files, "path")
    key = F.regexp_extract("text", r"^\s*(?:- )?([^\s#:'\"\[{-][^:]*):(?:\s|$)", 1)
    level = F.floor(F.length(F.regexp_extract("text", r"^( *)", 1)) / 2).cast("int")
    return lines.select("path", "line", level.alias("level"), key.alias("key")).where((F.col("key") != "") & (F.col("level") <= depth))


def json_lines(value, depth: int = 2, indent: int = 0) -> list[str]:
    """Outline of a parsed JSON or TOML value: keys to a depth, sizes of what is below, short scalars."""
    out = []
    entries = value.items() if isinstance(value, dict) else []
    for key, v in entries:
        pad = "  " * indent
        if isinstance(v, dict):
            shown = ", ".join(list(v)[:5]) + (", ..." if len(v) > 5 else "")
            out.append(f"{pad}{key}: {{{len(v)} keys}} {shown}".rstrip())
            out += json_lines(v, depth, indent + 1) if indent + 1 < depth else []
        elif isinstance(v, list):
            kind = type(v[0]).__name__ if v else ""
            out.append(f"{pad}{key}: [{len(v)} items]" + (f" [{kind}]" if kind else ""))
        else:
            plain = json.dumps(v) if not hasattr(v, "isoformat") else v.isoformat()
            out.append(f"{pad}{key}: {plain[:40]}{'...' if len(plain) > 40 else ''} ({type(v).__name__})")
    return out or ([f"[{len(value)} items]"] if isinstance(value, list) else [str(value)[:40]] if not isinstance(value, dict) else [])


def structured_text(path: str, content: str) -> list[str]:
    """Outline of a JSON or TOML file; one that does not parse gives its ``key: value`` or ``key = value`` lines."""
    try:
        return json_lines(tomllib.loads(content) if path.endswith(".toml") else json.loads(content))
    except (ValueError, RecursionError):
        return [m[0].strip()[:80] for m in re.finditer(r"^\s*[\w.-]+\s*[:=].*$", content, re.M)][:100]


def structured_outline(files: DataFrame) -> DataFrame:
    """(path, outline) of JSON and TOML files."""

    def run(batches):
        for batch in batches:
            yield batch.assign(outline=[structured_text(p, c or "") for p, c in zip(batch["path"], batch["content"], strict=True)])[["path", "outline"]]

    return files.where(F.col("path").rlike(r"\.(?:json|toml)$")).select("path", "content").mapInPandas(run, "path string, outline array<string>")


def code_outline(symbols: DataFrame) -> DataFrame:
    """(path, outline): a line for each definition in order, members indented."""
    depth = F.when(F.col("parent").isNull(), 0).otherwise(F.size(F.split("parent", r"\.")))
    line = F.concat(F.repeat(F.lit("  "), depth), F.lit("["), F.concat_ws("-", "start_line", "end_line"), F.lit("] "), F.col("signature"))
    each = F.sort_array(F.collect_list(F.struct("start_line", "ord", line.alias("line"))))
    return symbols.groupBy("path").agg(F.transform(each, lambda x: x["line"]).alias("outline"))


def test_outline(files: DataFrame) -> DataFrame:
    """(path, line, level, kind, name) of describe, it and test calls, nested by indent."""
    lines = text.lines(files, "path")
    pattern = r"^(\s*)(describe|it|test)(?:\.\w+)?\(\s*[\"'`]([^\"'`]*)"
    found = lines.select("path", "line", *[F.regexp_extract("text", pattern, k).alias(n) for k, n in ((1, "pad"), (2, "kind"), (3, "name"))]).where("kind <> ''")
    return found.select("path", "line", F.floor(F.length("pad") / 2).cast("int").alias("level"), "kind", "name")


def directory_listing(files: DataFrame, folder: str) -> DataFrame:
    """Entries of one folder: folders with a slash, files with their tokens."""
    prefix = f"{folder}/" if folder else ""
    rest = F.substr("path", F.lit(len(prefix) + 1))
    own = files.where(F.col("path").startswith(prefix)) if prefix else files
    entry = F.when(rest.contains("/"), F.concat(F.substring_index(rest, "/", 1), F.lit("/"))).otherwise(rest)
    return own.groupBy(entry.alias("entry")).agg(text.tokens_of_bytes(F.sum("size")).alias("tokens")).orderBy("entry")


def cut_to_budget(content: str, budget: int) -> tuple[str, bool]:
    """Text of at most ``budget`` tokens: the first line stays whole, the rest ends at a section, paragraph, line or character."""
    size = lambda s: -(-len(s.encode()) // 4)
    if size(content) <= budget:
        return content, False
    head, line_feed, body = content.partition("\n")
    room = max(0, budget - 50) * 4
    if len(body.encode()) <= room:
        return content, False
    kept = text.truncate_bytes(body, room)
    for mark in ("\n\n##", "\n\n", "\n"):
        if (at := kept.rfind(mark)) > 0:
            kept = kept[:at]
            break
    return f"{head}{line_feed}{kept}", True


def item_budget(budget: int, items: int) -> int:
    return max(1, budget // max(items, 1))


def packed(blocks: DataFrame, room: int) -> DataFrame:
    """(owner, kept: array of ord) of ``blocks`` (owner, ord, bytes, worth, structural): structural blocks stay, others by worth
    while they fit; one that does not fit is passed over, and smaller ones after it may still fit."""
    order = F.sort_array(F.collect_list(F.struct((~F.col("structural")).alias("later"), (-F.col("worth")).alias("less"), "ord", "bytes")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))

    def step(done: Column, b: Column) -> Column:
        fits = ~b["later"] | (done["used"] + b["bytes"] <= room)
        return F.when(fits, F.struct((done["used"] + b["bytes"]).alias("used"), F.concat(done["kept"], F.array(b["ord"])).alias("kept"))).otherwise(done)

    each = blocks.select("owner", F.col("ord").cast("int").alias("ord"), F.col("bytes").cast("long").alias("bytes"), "worth", "structural")
    return each.groupBy("owner").agg(F.array_sort(F.aggregate(order, start, step)["kept"]).alias("kept"))


def smallest_that_fits(versions: list[str], budget: int) -> str:
    """First of ever shorter versions that fits a budget, else the last, cut."""
    for version in versions:
        if -(-len(version.encode()) // 4) <= budget:
            return version
    return cut_to_budget(versions[-1], budget)[0]


def read_many(files: DataFrame, wanted: DataFrame, budget: int = DEFAULT_BUDGET) -> DataFrame:
    """(ord, path, found, mode, body, is_cut) of ``wanted`` (ord, path) in request order, at most twenty; the budget is shared evenly.

    Paths that are no file have ``found`` false."""
    n = wanted.limit(21).count()
    if not 1 <= n <= 20:
        raise ValueError("between one and twenty paths")
    own = read_mode(files).select("path", "mode", "content", F.lit(True).alias("found"))
    joined = wanted.join(own, "path", "left").select("ord", "path", F.coalesce("found", F.lit(False)).alias("found"), "mode", "content")
    share = item_budget(budget, n)

    def run(batches):
        for batch in batches:
            cut = [cut_to_budget(c, share) if isinstance(c, str) and m in ("full", "outline") else (None, False) for c, m in zip(batch["content"], batch["mode"], strict=True)]
            yield batch.drop(columns="content").assign(body=[c[0] for c in cut], is_cut=[c[1] for c in cut])

    return joined.mapInPandas(run, f"ord {dict(wanted.dtypes)['ord']}, path string, found boolean, mode string, body string, is_cut boolean").orderBy("ord")


def expanded_hits(files: DataFrame, hits: DataFrame, around: int = 10, whole_below: int = 800) -> DataFrame:
    """Lines shown for each expanded hit (path, line, start_line, end_line): the file if it is small, else the definition or some lines around.

    Where a definition is shown from one of the first five lines of its file, imports and blank lines before any other are left
    out, and everywhere debug logs, plain comments and all but the first of blank lines in a row; ``gap`` says how many lines
    are left out before a line, where more than three are."""
    own = hits.join(files.select("path", "size").hint(MERGE), "path")
    whole = text.tokens_of_bytes(F.col("size")) < whole_below
    first = F.when(whole, 1).otherwise(F.coalesce("start_line", F.greatest(F.col("line") - around, F.lit(1))))
    last = F.when(whole, F.col("size") + 1).otherwise(F.least(F.coalesce("end_line", F.col("line") + around), F.col("size") + 1))
    spans = own.select("path", F.col("line").alias("hit_line"), first.alias("first"), last.alias("last"), (F.col("start_line").isNotNull() & (first <= 5)).alias("_heads"))
    lines = skipped_lines(text.lines(files.join(spans.select("path").distinct().hint(MERGE), "path", "left_semi"), "path"))
    shown = in_spans(lines, spans)
    head = F.ltrim("text").rlike(r"^(?:use |import |from |#include|require[( ]|const .*= require\(|\s*$)")
    order = Window.partitionBy("path", "hit_line").orderBy("line")
    leading = F.col("_heads") & (F.count_if(~head).over(order) == 0) & (F.count_if(~head).over(Window.partitionBy("path", "hit_line")) > 0)
    out = shown.withColumn("_leads", leading).where((~F.col("skip") & ~F.col("_leads")) | (F.col("line") == F.col("hit_line")))
    before = F.col("line") - F.lag("line").over(order) - 1
    return out.select("path", "hit_line", "line", "text", F.when(before > 3, before).alias("gap"))


def is_import_line(lang: Column, line: Column) -> Column:
    """Whether a line begins an import of a language."""
    t = F.ltrim(line)
    return F.coalesce(
        F.when(lang == "rust", t.startswith("use ")).when(lang.isin("javascript", "typescript", "tsx"), text.begins(t, ["import ", "import{"])).when(lang == "python", text.begins(t, ["import ", "from "]))
        .when(lang.isin("go", "java", "scala", "kotlin"), t.startswith("import ")).when(lang.isin("c", "cpp"), t.startswith("#include"))
        .when(lang == "elixir", text.begins(t, ["alias ", "import ", "use ", "require "])).when(lang == "bash", t.rlike(r"^(?:source|\.)\s")), F.lit(False),
    )


def signatures(symbols: DataFrame, path: str) -> DataFrame:
    """Definitions of one file as their first lines."""
    return symbols.where(F.col("path") == path).select("start_line", "end_line", "kind", "signature").orderBy("start_line")
