"""Definitions, imports and calls of source files.

Python goes through the standard parser, other languages through a lexer and a reader with a stack of scopes. The result has
one row per definition, import or call; a grammar library could take the place of ``extract`` without a change elsewhere."""

from __future__ import annotations

import ast
from collections.abc import Callable, Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.functions import names
from loamline.sources import lexer, parser
from loamline.sources.shapes import Shapes

ROWS = "path string, lang string, row string, kind string, name string, parent string, owner string, start_line int, end_line int, signature string, exported boolean, ord int, source string, implements array<string>, doc string, shape bigint"

LEAVES = (ast.expr_context, ast.operator, ast.Name, ast.Constant)  #: parts of a tree in which nothing is defined or called

REGISTERED: dict[str, Callable[[str, str], list[dict]]] = {}


def register_language(lang: str, extractor: Callable[[str, str], list[dict]]) -> None:
    """Take ``extractor(path, content)`` for a language; its rows have any of the columns of ``ROWS``."""
    REGISTERED[lang] = extractor


def _python(path: str, content: str, shaped: bool = True, wanted: Collection[str] = parser.ALL_ROWS) -> list[dict]:
    tree = ast.parse(content)
    source, out, called = content.split("\n"), [], "call" in wanted

    def visit(node, owner: str, call_owner: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, LEAVES):
                continue
            inner, caller = owner, call_owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                bases = [b.id if isinstance(b, ast.Name) else ast.unparse(b) for b in child.bases] if is_class else []
                doc = (ast.get_docstring(child) or "").split("\n")[0]
                kind = "class" if is_class else "method" if owner and isinstance(node, ast.ClassDef) else "function"
                out.append({"row": "symbol", "kind": kind, "name": child.name, "parent": owner or None, "start_line": first, "end_line": child.end_lineno, "signature": source[child.lineno - 1].strip().rstrip(":"), "exported": not child.name.startswith("_"), "implements": bases, "doc": doc or None})
                inner, caller = (f"{owner}.{child.name}" if owner else child.name), child.name
            elif isinstance(child, (ast.Assign, ast.AnnAssign)) and isinstance(node, ast.Module):
                for target in child.targets if isinstance(child, ast.Assign) else [child.target]:
                    if isinstance(target, ast.Name):
                        out.append({"row": "symbol", "kind": "assignment", "name": target.id, "parent": None, "start_line": child.lineno, "end_line": child.end_lineno, "signature": source[child.lineno - 1].strip(), "exported": not target.id.startswith("_"), "implements": []})
            elif isinstance(child, ast.Import):
                out.extend({"row": "import", "name": a.asname or a.name, "source": a.name, "start_line": child.lineno} for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                out.append({"row": "import", "name": ",".join(a.name for a in child.names), "source": "." * child.level + (child.module or ""), "start_line": child.lineno})
            elif isinstance(child, ast.Call):
                f = child.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    own = f.value.id if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) else ast.unparse(f.value) if isinstance(f, ast.Attribute) and called else None
                    out.append({"row": "call", "name": name, "owner": own, "parent": call_owner or None, "start_line": child.lineno})
            visit(child, inner, caller)

    visit(tree, "", "")
    if not shaped:
        return out
    shapes = Shapes(lexer.tokens(content, "python"), content, indented=True)
    for row in out:
        if row["row"] == "symbol":
            row["shape"] = shapes.of_lines(row["start_line"], row["end_line"], row["name"])
    return out


def extract(path: str, lang: str, content: str, shapes: bool = True, wanted: Collection[str] = parser.ALL_ROWS) -> list[dict]:
    """Rows of one file that are ``wanted``, numbered among all of it; a Python file that does not parse has none.

    Without ``shapes`` definitions need have no structure hash."""
    if lang in REGISTERED:
        rows = REGISTERED[lang](path, content)
    elif lang == "python":
        try:
            rows = _python(path, content, shapes, wanted)
        except (SyntaxError, ValueError, RecursionError):
            rows = []
    else:
        rows = parser.read(content, lang, shapes, wanted)
    out = []
    for n, row in enumerate(rows):
        if row["row"] in wanted:
            row["path"], row["lang"], row["ord"] = path, lang, n
            row["end_line"] = row.get("end_line") or row.get("start_line")
            out.append(row)
    return out


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all cores by ``keys``, which tell them apart: what is read of few bytes can be much work.

    Narrow rows are dealt best, before contents are made of them or read. The condition holds for every row: no filter is carried
    past it, as it goes by the task, while the optimizer would evaluate others, with all that their columns are made of, before the deal."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, F.xxhash64(*keys)).where(F.spark_partition_id() >= 0)


def _code(files: DataFrame) -> DataFrame:
    """(path, lang, content) of the files, the last two null where there is no code to read.

    A filter would be evaluated before the projection that makes paths and contents, and make them once more."""
    kind = names.file_kind(F.col("path"))
    own = files.select("path", F.when(kind.startswith("code:"), F.substr(kind, F.lit(6))).alias("lang"), "content")
    return own.select("path", "lang", F.when(F.col("lang").isNotNull(), F.col("content")).alias("content"))


def _contents(batch: pa.RecordBatch) -> Iterator[tuple[str, str, str]]:
    rows = zip(*(batch.column(c).to_pylist() for c in ("path", "lang", "content")), strict=True)
    return (row for row in rows if row[2] is not None)


OUT_ROWS = 1 << 14  #: rows that are held before they leave a task


def code_rows(files: DataFrame, only: Collection[str] = ("symbol", "import", "call"), shapes: bool = True) -> DataFrame:
    """Definitions, imports and calls of the code files among ``files`` (path, content), or ``only`` some of these.

    Where no structure hashes are wanted, ``shapes`` false saves their work."""
    code = _code(files)
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ROWS.split(", "))])
    wanted = frozenset(only)

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        columns = [[r.get(c) for r in rows] if c != "implements" else [r.get(c, []) for r in rows] for c in schema.names]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches):
        for batch in batches:
            rows: list[dict] = []
            for path, lang, content in _contents(batch):
                rows += extract(path, lang, content, shapes, wanted)
                if len(rows) >= OUT_ROWS:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    return code.mapInArrow(run, ROWS)


def equal_parts(files: DataFrame, least: int = 20) -> DataFrame:
    """(path, start_line, end_line, tokens, shape, copies) of the bracketed parts of at least ``least`` tokens that are in the code files
    more than once, comments and spacing left out; parts of a larger one that is in as many places are not repeated.

    Copies are found by a shuffle on the hash, which counts before it."""
    code = _code(files)
    fields = ["shape", "start_line", "end_line", "tokens", "around"]

    def run(batches):
        for batch in batches:
            for path, lang, content in _contents(batch):
                groups = Shapes(lexer.tokens(content, lang), content, lang in parser.INDENTED).groups(least)
                columns = list(zip(*groups, strict=True)) or [()] * len(fields)
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(groups), pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["path", *fields])

    parts = code.mapInArrow(run, "path string, shape long, start_line int, end_line int, tokens int, around long")
    copies = parts.groupBy("shape").agg(F.count("*").alias("copies")).where("copies > 1")
    outer = copies.select(F.col("shape").alias("around"), F.col("copies").alias("outer_copies"))
    own = parts.join(copies.hint("merge"), "shape").join(outer.hint("merge"), "around", "left")
    return own.where("outer_copies IS NULL OR outer_copies < copies").select("path", "start_line", "end_line", "tokens", "shape", "copies")


def symbols(rows: DataFrame) -> DataFrame:
    return rows.where("row = 'symbol'").select("path", "lang", "kind", "name", "parent", "start_line", "end_line", "signature", "exported", "implements", "doc", "ord", "shape")


def calls(rows: DataFrame) -> DataFrame:
    return rows.where("row = 'call'").select("path", "lang", F.col("name").alias("callee"), "owner", F.col("parent").alias("caller"), F.col("start_line").alias("line"))


def imports(rows: DataFrame) -> DataFrame:
    return rows.where("row = 'import'").select("path", "lang", "source", "name", F.col("start_line").alias("line"), "ord")
