"""What a caller can ask of a corpus: queries of any kind, callers, dependencies, bundles, maps, diffs and batches."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.functions import names, queries, text
from loamline.operators import diff, filters, graph, search, views
from loamline.sources import corpus, extract, lexer

MULTI_SYMBOLS = 5
# How many rows each part of a bundle shows, by default and in full.
BUNDLE = {"callees": (5, 30), "callers": (5, 50), "siblings": (8, 30), "tests": (8, 30), "body": (60, 200)}


class NotFound(LookupError):
    """Nothing answers a query; ``suggestions`` may."""

    def __init__(self, message: str, suggestions: list[str]):
        super().__init__(message)
        self.suggestions = suggestions


class InvalidQuery(ValueError):
    """A query that makes no sense as it is."""


@dataclass
class Answer:
    """Kind of an answer and its rows."""

    kind: str
    rows: DataFrame


class Engine:
    """A corpus of ``files`` (path, size, mtime, content) and what is extracted from it, each once."""

    def __init__(self, files: DataFrame):
        self.files, self.spark = files, files.sparkSession

    @classmethod
    def of_tree(cls, spark: SparkSession, root: str) -> Engine:
        return cls(corpus.read_tree(spark, root))

    @classmethod
    def of_documents(cls, documents: DataFrame) -> Engine:
        return cls(corpus.from_documents(documents))

    @cached_property
    def filters(self) -> DataFrame:
        """Identifiers of each file, by which searches for a name leave files out."""
        return filters.identifier_filters(self.files).persist()

    @cached_property
    def code(self) -> DataFrame:
        return extract.code_rows(self.files).persist()

    def code_naming(self, name: str) -> DataFrame:
        """Definitions, imports and calls of the files that may have a name; others are not extracted."""
        return extract.code_rows(filters.narrowed(self.files, self.filters, name))

    @cached_property
    def symbols(self) -> DataFrame:
        return extract.symbols(self.code)

    @cached_property
    def calls(self) -> DataFrame:
        return extract.calls(self.code)

    @cached_property
    def imports(self) -> DataFrame:
        return graph.resolved_imports(extract.imports(self.code), self.files).persist()

    @cached_property
    def edges(self) -> DataFrame:
        return graph.resolved_callees(self.calls, self.symbols, self.imports).persist()

    def query(self, q: str, *, glob: str | None = None, context: str | None = None, full: bool = False, as_of=None) -> Answer:
        """Answer a query by its class; words that are no symbol are looked for in contents, then as usages, then suggested."""
        if not q.strip():
            raise InvalidQuery("an empty query")
        when = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
        limit = search.SHOWN_IN_FULL if full else search.SHOWN
        exists = not self.files.where(F.col("path") == q.removeprefix("./")).isEmpty()
        kind = self.spark.range(1).select(queries.classify(F.lit(q), F.lit(exists))).first()[0]
        shown = lambda hits: search.redacted(search.top(search.ranked(hits, q, when, context), limit))
        if kind == "path":
            return Answer("file", views.read_mode(self.files.where(F.col("path") == q.removeprefix("./")), full))
        if kind == "glob":
            return Answer("glob", search.glob_files(self.files, q))
        if kind == "regex":
            return Answer("regex", shown(search.content_hits(self.files, q[1:-1], True, glob)))
        if kind == "content":
            return Answer("content", shown(search.content_hits(self.files, q, False, glob)))
        branches = []
        if " " in q:
            branches += [("content", search.content_hits(self.files, q, False, glob)), ("words", search.content_hits(self.files, search.multi_word_pattern(q), True, glob))]
        else:
            symbols = search.symbol_hits(filters.narrowed(self.files, self.filters, q), self.symbols, q, glob)
            branches += [("symbol", symbols if kind == "fallthrough" else symbols.where(F.lit(not symbols.where("is_definition").isEmpty())))]
            branches += [("content", search.content_hits(self.files, q, False, glob)), ("usages", symbols)]
        found = search.first_filled(*branches)
        if found is None:
            raise NotFound(f"nothing answers {q!r}", self.suggestions(q.split()[0]))
        return Answer(found[0], shown(found[1]))

    def suggestions(self, q: str) -> list[str]:
        """Paths and names that look like a query."""
        paths = [r["path"] for r in search.suggested(self.files, "path", q).collect()]
        return paths + [r["name"] for r in search.suggested(self.symbols, "name", q).collect()]

    def multi(self, symbols: list[str], **options) -> dict[str, Answer | NotFound]:
        """Answers for up to five symbols."""
        if not 1 <= len(symbols) <= MULTI_SYMBOLS:
            raise InvalidQuery(f"between one and {MULTI_SYMBOLS} symbols")
        out: dict = {}
        for s in symbols:
            try:
                out[s] = self.query(s, **options)
            except NotFound as error:
                out[s] = error
        return out

    def batch(self, literals: list[str], limit: int = search.SHOWN) -> DataFrame:
        """Hits of up to ten literals in one pass."""
        return search.batch_hits(self.files, self.spark.createDataFrame(list(enumerate(literals, 1)), "query_no int, query string"), limit)

    def callers(self, *targets: str, context: str | None = None) -> DataFrame:
        """Call sites of names, in the order of the names."""
        return graph.callers(self.calls, self.spark.createDataFrame(list(enumerate(targets, 1)), "ord int, target string"), context)

    def why_no_callers(self, target: str) -> str:
        seen = search.seen_anywhere(self.files, target).first()[0]
        return f"{target} occurs, but no call of it was found: it may be called indirectly" if seen else f"{target} occurs nowhere: {', '.join(self.suggestions(target)) or 'no similar name'}"

    def impact(self, target: str) -> DataFrame:
        """Callers of the callers of a name."""
        return graph.second_hop(self.calls, self.callers(target))

    def deps(self, path: str) -> dict[str, DataFrame]:
        return graph.dependencies(path, self.imports, self.calls, self.symbols)

    def map(self, depth: int = 3) -> DataFrame:
        return graph.code_map(self.files, self.symbols, depth)

    def overview(self) -> dict[str, list]:
        return graph.fingerprint(self.files, self.imports)

    def grok(self, spec: str, full: bool = False) -> dict:
        """A bundle about one definition: itself, its body, callees, callers, siblings, tests, and totals before the caps."""
        at = self.spark.range(1).select(queries.target_spec(F.lit(spec)).alias("t")).first()["t"]
        if at["path"]:
            inside = self.symbols.where((F.col("path") == at["path"]) & F.lit(at["line"]).between(F.col("start_line"), F.col("end_line")))
            own = inside.orderBy(F.desc("start_line"), "end_line").limit(1)
        else:
            own = graph.by_owner(self.symbols, spec).orderBy(names.is_test_path(F.col("path")), names.depth(F.col("path")), "path", "start_line").limit(1)
        found = own.first()
        if found is None:
            name = spec.replace("::", ".").split(".")[-1]
            raise NotFound(f"no definition of {spec!r}", [r[0] for r in graph.owners(self.symbols, name).collect()] or self.suggestions(name))
        cap = {k: v[full] for k, v in BUNDLE.items()}
        span = (F.col("path") == found["path"]) & F.col("line").between(found["start_line"], found["end_line"])
        lines = text.lines(self.files.where(F.col("path") == found["path"]), "path").where(span).orderBy("line")
        body = [r["text"] for r in lines.limit(cap["body"]).collect()]
        callees = self.edges.where(span & (F.col("callee") != found["name"])).groupBy("callee").agg(F.min("target_path").alias("target_path"))
        callers = self.calls.where((F.col("callee") == found["name"]) & ~span)
        tests = F.col("path").rlike(r"(?:^|/)tests?/|_test\.") | names.is_test_path(F.col("path"))
        sides = graph.siblings(self.symbols, found["path"], found["parent"] or "", found["name"], "\n".join(body), cap["siblings"])
        take = lambda rows, n, *order: [r.asDict() for r in rows.orderBy(*order).limit(n).collect()]
        return {
            "definition": found.asDict(), "body": body, "callees": take(callees, cap["callees"], F.col("target_path").isNull(), "callee"), "callees_total": callees.count(),
            "callers": take(callers.where(~tests), cap["callers"], "path", "line"), "callers_total": callers.where(~tests).count(), "tests": take(callers.where(tests), cap["tests"], "path", "line"),
            "siblings": [r.asDict() for r in sides.collect()],
        }

    def diff_against(self, older: Engine) -> DataFrame:
        """Changes of symbols from an older version of the corpus to this one."""
        return diff.symbol_changes(diff.bodies(older.symbols, older.files), diff.bodies(self.symbols, self.files))


    def diff(self, root: str, **source) -> dict[str, DataFrame]:
        """A textual diff (see ``corpus.diff_text`` for its sources) as files, lines, and lines with the definition that they are in."""
        body = corpus.diff_text(root, **source)
        lines = diff.diff_lines(self.spark.createDataFrame([("diff", body)], "patch string, body string"))
        return {"files": diff.file_changes(lines), "lines": lines, "attributed": diff.attributed(lines, self.symbols)}


def register_functions(spark: SparkSession) -> None:
    """SQL functions: dice(a, b), truncate_bytes(s, n), lex_identifiers(content, lang), and the table function corpus_symbols(path, content)."""
    from pyspark.sql.functions import pandas_udf, udtf

    @pandas_udf("double")
    def dice(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else diff.dice(x, y) for x, y in zip(a, b, strict=True)])

    @pandas_udf("string")
    def truncate_bytes(s: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([text.truncate_bytes(x, int(k)) for x, k in zip(s, n, strict=True)])

    @pandas_udf("array<string>")
    def lex_identifiers(content: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series([lexer.identifiers(c or "", x or "") for c, x in zip(content, lang, strict=True)])

    @udtf(returnType="name string, kind string, start_line int, end_line int")
    class CorpusSymbols:
        def eval(self, path: str, lang: str, content: str):
            for r in extract.extract(path, lang, content or ""):
                if r["row"] == "symbol":
                    yield r["name"], r["kind"], r["start_line"], r["end_line"]

    for name, f in (("dice", dice), ("truncate_bytes", truncate_bytes), ("lex_identifiers", lex_identifiers)):
        spark.udf.register(name, f)
    spark.udtf.register("corpus_symbols", CorpusSymbols)
