"""Queries of the code operators over source files made from the ``part`` table, each with the SQL that it must agree with.

Every part is a file in Python, TypeScript or Go that defines a type, two members and a function, and imports and calls what
the file of the part 15 before defines. The SQL states definitions, calls and imports by rule and knows nothing of
extraction. A second version of the files changes each in one of six ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamline.functions import names, text
from loamline.operators import diff, graph, search, views
from loamline.operators.ranks import cut
from loamline.sources import extract

QUERIES: dict = {}
SQL: dict[str, str] = {}

PYTHON = """import os
from app.d{jd}.m{j} import run_{j}

class Item{k}(Base{b}):
    def price(self,
              x):
        return run_{j}(
            self.cost(x))

    def {cost}(self, x):
        return x * {s}

"""
PYTHON_RUN = """def run_{k}({a}):
    helper_{h}(a)
    return Item{k}(run_{j}(a))
"""
SCRIPT = """import {
  run_{j},
} from '../d{jd}/m{j}';
import os from 'os';
export class Item{k} extends Base{b} {
  price(
    x: number,
  ): number {
    return run_{j}(this.cost(x));
  }
  {cost}(x: number): number { return x * {s}; }
}
"""
SCRIPT_RUN = """export function run_{k}({a}: number) {
  helper_{h}(a);
  return new Item{k}(run_{j}(a));
}
"""
GO = """package d{d5}

import (
\t"os"
\t"fmt"
)

type Item{k} struct {
\tn int
}

func (it *Item{k}) Price(
\tx int,
) int {
\treturn Run{j}(it.Cost(x))
}

func (it *Item{k}) {Cost}(x int) int { return x * {s} }

"""
GO_RUN = """func Run{k}({a} int) int {
\thelper{h}(a)
\treturn Run{j}(a)
}
"""
#: What takes the place of the function in one kind of new version.
FRESH = [
    "def fresh_{k}():\n    for line in open('{k}'):\n        print(line.strip().upper(), end='')\n",
    "export function fresh_{k}() {\n  while (true) { console.log('{k}', Date.now()); break; }\n}\n",
    'func Fresh{k}() {\n\tfor i := range 10 { fmt.Println("{k}", i, os.Args) }\n}\n',
]


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def _filled(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


def _by_language(values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("l") + 1).cast("int"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") + 1
    own = extract.spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size"), "p_partkey")
    own = own.select(k.alias("k"), F.greatest(k - 15, F.lit(0)).alias("j"), (F.col("p_size") % 3).alias("s"), (k % 3).alias("l"), (k % 6).alias("way"))
    folder = F.when(F.col("l") == 2, F.col("k") % 5).otherwise(F.col("k") % 10).cast("string")
    at = F.concat(_by_language(["app", "web", "srv"]), F.lit("/d"), folder, F.lit("/"))
    end = _by_language([".py", ".ts", ".go"])
    return own.withColumns({"path": F.concat(at, F.lit("m"), F.col("k").cast("string"), end), "moved": F.concat(at, F.lit("moved"), F.col("k").cast("string"), end)})


def _files(own: DataFrame, path: str, content: Column) -> DataFrame:
    values = {"k": F.col("k"), "jd": F.col("j") % 10, "j": F.col("j"), "b": F.col("k") % 7, "h": F.col("k") % 5, "d5": F.col("k") % 5}
    rows = own.select(F.col(path).alias("path"), _filled(content, values).alias("content"))
    return rows.select("path", F.octet_length("content").cast("long").alias("size"), F.lit("2024-01-01").cast("timestamp").alias("mtime"), "content")


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = parts(spark, sf_dir)
    whole = F.concat(_by_language([PYTHON, SCRIPT, GO]), _by_language([PYTHON_RUN, SCRIPT_RUN, GO_RUN]))
    return _files(own, "path", _filled(whole, {"cost": F.lit("cost"), "Cost": F.lit("Cost"), "a": F.lit("a"), "s": F.col("s")}))


def new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files' second version: as they were, another body, another head, another name, another function, or the function elsewhere."""
    own, way = parts(spark, sf_dir), F.col("way")
    values = {
        "cost": F.when(way == 3, "spend").otherwise("cost"), "Cost": F.when(way == 3, "Spend").otherwise("Cost"), "a": F.when(way == 2, F.when(F.col("l") == 1, "a: number, b").otherwise("a, b")).otherwise("a"),
        "s": F.when(way == 1, F.col("s") + 10).otherwise(F.col("s")),
    }
    run = _by_language([PYTHON_RUN, SCRIPT_RUN, GO_RUN])
    last = F.when(way == 4, _by_language(FRESH)).when(way == 5, "").otherwise(run)
    stay = _files(own, "path", _filled(F.concat(_by_language([PYTHON, SCRIPT, GO]), last), values))
    return stay.union(_files(own.where(way == 5), "moved", _filled(run, values)))


def rows_of(files: DataFrame, *only: str) -> DataFrame:
    """What is in the files, all of it or ``only`` some kinds of rows, without structure hashes."""
    return extract.code_rows(files, only or ("symbol", "import", "call"), shapes=False)


def once(files: DataFrame, *only: str) -> DataFrame:
    """``rows_of``, extracted once, for queries that look at the rows from several sides."""
    return cut(rows_of(files, *only))


def shaped(files: DataFrame) -> DataFrame:
    """Definitions with structure hashes."""
    return extract.symbols(extract.code_rows(files, ["symbol"]))


PARTS_SQL = """p AS (SELECT *, CASE l WHEN 0 THEN 'app/d' || k % 10 WHEN 1 THEN 'web/d' || k % 10 ELSE 'srv/d' || k % 5 END AS folder, ([ '.py', '.ts', '.go'])[1 + l] AS ending
  FROM (SELECT k, greatest(k - 15, 0) AS j, s, k % 3 AS l, k % 6 AS way FROM (SELECT p_partkey + 1 AS k, p_size % 3 AS s FROM part))),
f AS (SELECT *, folder || '/m' || k || ending AS path, folder || '/moved' || k || ending AS moved FROM p)"""
SYMBOLS_SQL = """made(l, kind, pattern, owner, a, b, exported, base) AS (VALUES (0, 'class', 'Item{k}', NULL, 4, 11, true, true), (0, 'method', 'price', 'Item{k}', 5, 8, true, false), (0, 'method', 'cost', 'Item{k}', 10, 11, true, false),
  (0, 'function', 'run_{k}', NULL, 13, 15, true, false), (1, 'class', 'Item{k}', NULL, 5, 12, true, true), (1, 'method', 'price', 'Item{k}', 6, 10, false, false), (1, 'method', 'cost', 'Item{k}', 11, 11, false, false), (1, 'function', 'run_{k}', NULL, 13, 16, true, false),
  (2, 'struct', 'Item{k}', NULL, 8, 10, true, false), (2, 'method', 'Price', 'Item{k}', 12, 16, true, false), (2, 'method', 'Cost', 'Item{k}', 18, 18, true, false), (2, 'function', 'Run{k}', NULL, 20, 23, true, false)),
symbols AS (SELECT path, kind, replace(pattern, '{k}', k::VARCHAR) AS name, replace(owner, '{k}', k::VARCHAR) AS parent, a AS start_line, b AS end_line, exported, CASE WHEN base THEN 'Base' || k % 7 END AS implements, k, f.l, s, way FROM f JOIN made USING (l))"""
CALLS_SQL = """used(l, pattern, owner, caller, line) AS (VALUES (0, 'run_{j}', NULL, 'price', 7), (0, 'cost', 'self', 'price', 8), (0, 'helper_{h}', NULL, 'run_{k}', 14), (0, 'Item{k}', NULL, 'run_{k}', 15), (0, 'run_{j}', NULL, 'run_{k}', 15),
  (1, 'run_{j}', NULL, 'price', 9), (1, 'cost', 'this', 'price', 9), (1, 'helper_{h}', NULL, 'run_{k}', 14), (1, 'Item{k}', NULL, 'run_{k}', 15), (1, 'run_{j}', NULL, 'run_{k}', 15),
  (2, 'Run{j}', NULL, 'Price', 15), (2, 'Cost', 'it', 'Price', 15), (2, 'helper{h}', NULL, 'Run{k}', 21), (2, 'Run{j}', NULL, 'Run{k}', 22)),
calls AS (SELECT path, f.l, k, j, folder, replace(replace(replace(pattern, '{k}', k::VARCHAR), '{j}', j::VARCHAR), '{h}', (k % 5)::VARCHAR) AS callee, owner, replace(caller, '{k}', k::VARCHAR) AS caller, line FROM f JOIN used USING (l))"""
IMPORTS_SQL = """taken(l, pattern, line) AS (VALUES (0, 'os', 1), (0, 'app.d{d}.m{j}', 2), (1, '../d{d}/m{j}', 1), (1, 'os', 4), (2, 'os', 4), (2, 'fmt', 5)),
imports AS (SELECT path, f.l, k, j, replace(replace(pattern, '{d}', (j % 10)::VARCHAR), '{j}', j::VARCHAR) AS source, line,
  CASE WHEN j > 0 AND contains(pattern, '{j}') THEN (CASE f.l WHEN 0 THEN 'app' ELSE 'web' END) || '/d' || j % 10 || '/m' || j || ending END AS target FROM f JOIN taken USING (l))"""
#: The definition that a call means: in its own file, in an imported file, or in the same folder for Go.
TARGETS_SQL = """targets AS (SELECT c.path, c.caller, c.callee, c.line, coalesce(o.path, t.path) AS target_path, coalesce(o.start_line, t.start_line) AS target_line, c.k, c.j
  FROM calls c LEFT JOIN symbols o ON o.path = c.path AND o.name = c.callee LEFT JOIN symbols t ON t.k = c.j AND t.name = c.callee AND o.path IS NULL)"""
CODE = f"WITH {PARTS_SQL}, {SYMBOLS_SQL}, {CALLS_SQL}, {IMPORTS_SQL}, {TARGETS_SQL}"


@query("code_definitions", f"{CODE} SELECT path, kind, name, parent, start_line, end_line, exported, coalesce(implements, '') AS implements FROM symbols")
def code_definitions(spark, sf_dir):
    own = extract.symbols(rows_of(code_files(spark, sf_dir), "symbol"))
    return own.select("path", "kind", "name", "parent", "start_line", "end_line", "exported", F.array_join("implements", ",").alias("implements"))


@query("code_calls", f"{CODE} SELECT path, callee, owner, caller, line FROM calls")
def code_calls(spark, sf_dir):
    return extract.calls(rows_of(code_files(spark, sf_dir), "call")).select("path", "callee", "owner", "caller", "line")


@query("code_imports", f"{CODE} SELECT path, source, line FROM imports")
def code_imports(spark, sf_dir):
    return extract.imports(rows_of(code_files(spark, sf_dir), "import")).select("path", "source", "line")


@query(
    "definition_search",
    f"""{CODE}, w AS (SELECT path, start_line AS line, name AS def_name, CASE WHEN kind IN ('class', 'struct') THEN 100 WHEN kind IN ('function', 'method') THEN 100 END AS def_weight, CAST(NULL AS VARCHAR) AS impl_target FROM symbols WHERE name = 'price'
UNION ALL SELECT path, start_line, name, 80, 'Base3' FROM symbols WHERE implements = 'Base3') SELECT * FROM w""",
)
def definition_search(spark, sf_dir):
    own = code_files(spark, sf_dir)
    symbols = extract.symbols(once(own, "symbol"))
    found = search.definition_hits(own, symbols, "price").unionByName(search.definition_hits(own, symbols, "Base3"))
    return found.select("path", "line", "def_name", "def_weight", "impl_target")


@query("import_targets", f"{CODE} SELECT path, source, line, target FROM imports")
def import_targets(spark, sf_dir):
    own = code_files(spark, sf_dir)
    return graph.resolved_imports(extract.imports(once(own, "import")), own).select("path", "source", "line", "target")


def code_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(symbols, calls, resolved imports, calls with the definitions that they mean) of the made files."""
    own = code_files(spark, sf_dir)
    rows = once(own)
    symbols, calls, resolved = extract.symbols(rows), extract.calls(rows), graph.resolved_imports(extract.imports(rows), own)
    return symbols, calls, resolved, graph.resolved_callees(calls, symbols, resolved)


@query("callee_targets", f"{CODE} SELECT path, caller, callee, line, target_path, target_line FROM targets")
def callee_targets(spark, sf_dir):
    return code_graph(spark, sf_dir)[3]


@query(
    "caller_impact",
    f"""{CODE}, one AS (SELECT path, line, caller FROM calls WHERE callee = 'run_33'), v AS (SELECT DISTINCT caller AS via FROM one)
SELECT caller, path, CAST(min(line) AS INTEGER) AS line, min(via) AS via FROM calls JOIN v ON callee = via ANTI JOIN one USING (path, line) GROUP BY caller, path ORDER BY path, line, caller LIMIT 15""",
)
def caller_impact(spark, sf_dir):
    calls = extract.calls(once(code_files(spark, sf_dir), "call"))
    hits = graph.callers(calls, spark.createDataFrame([(1, "run_33")], "ord int, target string"))
    return graph.second_hop(calls, hits, 15)


@query(
    "call_chain",
    f"""{CODE}, a AS (SELECT DISTINCT callee, target_path, target_line FROM targets WHERE k = 63 AND caller = 'run_63' AND target_path IS NOT NULL),
b AS (SELECT DISTINCT t.callee, t.target_path, t.target_line FROM targets t JOIN a ON t.path = a.target_path AND t.caller = a.callee WHERE t.target_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a x WHERE x.target_path = t.target_path AND x.target_line = t.target_line))
SELECT 1 AS hop, target_path AS path, callee, target_line AS line FROM a UNION ALL SELECT 2, target_path, callee, target_line FROM b WHERE callee <> 'run_63'""",
)
def call_chain(spark, sf_dir):
    return graph.two_hops(code_graph(spark, sf_dir)[3], "app/d3/m63.py", "run_63")


@query(
    "file_dependencies",
    f"""{CODE}, me AS (SELECT 'app/d8/m48.py' AS path) SELECT 'local' AS section, target_path AS name, string_agg(DISTINCT callee, ',' ORDER BY callee) AS uses FROM targets JOIN me USING (path) WHERE target_path <> path GROUP BY ALL
UNION ALL SELECT 'export', name, '' FROM symbols JOIN me USING (path) WHERE parent IS NULL
UNION ALL SELECT 'external', source, '' FROM imports JOIN me USING (path) WHERE target IS NULL AND source <> 'os'
UNION ALL SELECT 'dependent', t.path, string_agg(DISTINCT callee, ',' ORDER BY callee) FROM targets t JOIN me ON t.target_path = me.path WHERE t.path <> me.path GROUP BY t.path""",
)
def file_dependencies(spark, sf_dir):
    symbols, calls, resolved, _ = code_graph(spark, sf_dir)
    own = graph.dependencies("app/d8/m48.py", resolved, calls, symbols)
    none = F.lit("")
    rows = own["local"].select(F.lit("local").alias("section"), F.col("target_path").alias("name"), F.array_join("names", ",").alias("uses"))
    rows = rows.union(own["exports"].select(F.lit("export"), "name", none)).union(own["external"].select(F.lit("external"), "source", none))
    return rows.union(own["dependents"].select(F.lit("dependent"), "path", F.array_join("names", ",")))


@query("external_modules", f"{CODE} SELECT DISTINCT path, source FROM imports WHERE target IS NULL AND NOT (l = 0 AND source = 'os') AND NOT (l = 2 AND source IN ('os', 'fmt'))")
def external_modules(spark, sf_dir):
    own = code_files(spark, sf_dir)
    return graph.external_modules(graph.resolved_imports(extract.imports(once(own, "import")), own))


@query(
    "code_map",
    f"""{CODE} SELECT regexp_replace(path, '/[^/]*$', '') AS dir, path, string_agg(name, ',' ORDER BY start_line) FILTER (parent IS NULL) AS names FROM symbols GROUP BY path""",
)
def code_map(spark, sf_dir):
    own = code_files(spark, sf_dir)
    return graph.code_map(own, extract.symbols(rows_of(own, "symbol"))).select("dir", "path", F.array_join("names", ",").alias("names"))


@query(
    "project_summary",
    f"""{CODE}, g AS (SELECT (['python', 'typescript', 'go'])[1 + l] AS name, count(*) AS n FROM f GROUP BY 1), m AS (SELECT folder AS name, count(*) AS n FROM f WHERE l = 0 GROUP BY 1 HAVING n >= 2),
h AS (SELECT target AS name, count(DISTINCT path) AS n FROM imports WHERE target IS NOT NULL GROUP BY 1 HAVING n >= 2)
SELECT 'language' AS section, name, n FROM g UNION ALL SELECT 'module', regexp_extract(name, '[^/]*$'), n FROM (SELECT * FROM m ORDER BY n DESC, name LIMIT 10) UNION ALL SELECT 'hot', name, n FROM (SELECT * FROM h ORDER BY n DESC, name LIMIT 5)""",
)
def project_summary(spark, sf_dir):
    own = code_files(spark, sf_dir)
    resolved = graph.resolved_imports(extract.imports(once(own, "import")), own)
    rows = graph.languages(own).select(F.lit("language").alias("section"), F.col("lang").alias("name"), F.col("files").alias("n"))
    return rows.union(graph.modules(own, "python").select(F.lit("module"), "module", "files")).union(graph.hot_files(resolved).select(F.lit("hot"), "target", "imported_by"))


@query("member_siblings", f"{CODE} SELECT name, start_line, kind FROM symbols WHERE path = 'app/d8/m48.py' AND name = 'cost'")
def member_siblings(spark, sf_dir):
    own = extract.symbols(rows_of(code_files(spark, sf_dir), "symbol"))
    return graph.siblings(own, "app/d8/m48.py", "Item48", "price", "return run_33(self.cost(x) + self.gone)").select("name", "start_line", "kind")


@query("owned_members", f"{CODE} SELECT path, name, parent, start_line FROM symbols WHERE name = 'Price' AND parent = 'Item50' UNION ALL SELECT '', '', parent, 0 FROM (SELECT DISTINCT parent FROM symbols WHERE name = 'cost')")
def owned_members(spark, sf_dir):
    own = extract.symbols(rows_of(code_files(spark, sf_dir), "symbol"))
    found = graph.by_owner(own, "Item50::Price").select("path", "name", "parent", "start_line")
    return found.union(graph.owners(own, "cost").select(F.lit(""), F.lit(""), "parent", F.lit(0)))


@query(
    "call_scopes",
    f"""{CODE}, s AS (SELECT c.path, c.line, arg_max(s.name, s.start_line) AS in_name, arg_max(s.parent, s.start_line) AS in_parent FROM (SELECT DISTINCT path, line FROM calls) c JOIN symbols s ON s.path = c.path AND c.line BETWEEN s.start_line AND s.end_line GROUP BY ALL)
SELECT * FROM s""",
)
def call_scopes(spark, sf_dir):
    rows = once(code_files(spark, sf_dir))
    return graph.enclosing(extract.calls(rows).select("path", "line").distinct(), extract.symbols(rows), strict_header=False).select("path", "line", "in_name", "in_parent")


_CHANGES = f"""{CODE}, c AS (SELECT path, kind, name, coalesce(parent, '') AS parent, CASE
    WHEN way = 1 AND name IN ('cost', 'Cost') THEN 'body_changed' WHEN way = 1 AND kind = 'class' THEN 'body_changed'
    WHEN way = 2 AND kind = 'function' THEN 'signature_changed' WHEN way = 3 AND kind = 'class' THEN 'body_changed' WHEN way = 3 AND name IN ('cost', 'Cost') THEN 'renamed'
    WHEN way IN (4, 5) AND kind = 'function' THEN 'deleted' ELSE 'unchanged' END AS change, k, l FROM symbols),
n AS (SELECT path, kind, CASE change WHEN 'renamed' THEN (CASE name WHEN 'cost' THEN 'spend' ELSE 'Spend' END) ELSE name END AS name, parent, change, CASE change WHEN 'renamed' THEN name END AS old_name FROM c
  UNION ALL SELECT path, 'function', (CASE l WHEN 2 THEN 'Fresh' ELSE 'fresh_' END) || k, '', 'added', NULL FROM f WHERE way = 4
  UNION ALL SELECT moved, 'function', (CASE l WHEN 2 THEN 'Run' ELSE 'run_' END) || k, '', 'added', NULL FROM f WHERE way = 5)"""


def code_changes(spark, sf_dir) -> DataFrame:
    old, new = code_files(spark, sf_dir), new_files(spark, sf_dir)
    return diff.symbol_changes(diff.bodies(shaped(old), old), diff.bodies(shaped(new), new))


@query("symbol_changes", f"{_CHANGES} SELECT path, kind, name, parent, change, old_name FROM n")
def symbol_changes(spark, sf_dir):
    return code_changes(spark, sf_dir).select("path", "kind", "name", "parent", "change", "old_name")


@query("symbol_moves", f"{_CHANGES} SELECT 'function' AS kind, (CASE l WHEN 2 THEN 'Run' ELSE 'run_' END) || k AS name, path AS old_path, moved AS path FROM f WHERE way = 5")
def symbol_moves(spark, sf_dir):
    return diff.moves(code_changes(spark, sf_dir))


@query("changed_callers", f"{_CHANGES}, g AS (SELECT DISTINCT name FROM n WHERE change = 'signature_changed') SELECT name, count(callee) AS callers FROM g LEFT JOIN calls ON callee = name GROUP BY name")
def changed_callers(spark, sf_dir):
    return diff.blast(code_changes(spark, sf_dir), extract.calls(rows_of(code_files(spark, sf_dir), "call")))


@query("signature_warnings", f"{_CHANGES} SELECT name, count(*) AS places FROM n WHERE change = 'signature_changed' GROUP BY name HAVING count(*) > 1")
def signature_warnings(spark, sf_dir):
    return diff.signature_warnings(code_changes(spark, sf_dir)).select("name", "places")


_LINES = f"""{CODE}, h AS (SELECT DISTINCT path, line FROM calls), e AS (SELECT path, name, start_line, end_line, row_number() OVER (PARTITION BY path ORDER BY start_line) AS entry FROM symbols),
a AS (SELECT h.path, h.line, min(e.entry) AS entry FROM h JOIN e ON e.path = h.path AND h.line BETWEEN e.start_line AND e.end_line GROUP BY ALL)"""


@query(
    "usage_groups",
    f"""{_LINES}, s AS (SELECT *, row_number() OVER (ORDER BY path, line) AS place FROM a QUALIFY place <= 100)
SELECT CAST(min(place) AS INTEGER) AS place, path, string_agg(line, ',' ORDER BY line) AS lines FROM s GROUP BY path, entry""",
)
def usage_groups(spark, sf_dir):
    """Calls of the first hundred lines shown, as they are grouped for display."""
    rows = once(code_files(spark, sf_dir))
    symbols, none = extract.symbols(rows), F.lit(None)
    first = extract.calls(rows).select("path", "line").distinct().orderBy("path", "line").limit(100)
    shown = first.select(
        F.row_number().over(Window.orderBy("path", "line")).alias("place"), "path", "line", F.lit(False).alias("is_definition"), none.cast("string").alias("impl_target"), none.cast("string").alias("def_name"),
        none.cast("int").alias("start_line"), none.cast("int").alias("end_line"), F.lit(50).alias("est_lines"),
    )
    return graph.usage_groups(shown, symbols).select("place", "path", F.array_join("lines", ",").alias("lines"))


@query("outline_context", f"{_LINES} SELECT a.path, a.line, CAST(e.entry AS INTEGER) AS entry, e.name AS entry_name, e.entry = a.entry AS here FROM a JOIN e ON e.path = a.path AND e.entry BETWEEN a.entry - 2 AND a.entry + 2")
def outline_context(spark, sf_dir):
    rows = once(code_files(spark, sf_dir))
    return graph.outline_context(extract.calls(rows), extract.symbols(rows))


@query(
    "lookup_outcomes",
    f"""{CODE}, w AS (SELECT path, k, l, CASE k % 3 WHEN 0 THEN 'price' WHEN 1 THEN 'run_' || k ELSE 'gone' END AS name FROM f UNION ALL SELECT path || '.txt', k, l, 'price' FROM f)
SELECT w.path, w.name, CASE WHEN contains(w.path, '.txt') THEN 'unavailable' WHEN s.path IS NULL THEN 'missing' ELSE 'found' END AS outcome, start_line, end_line,
  CASE WHEN NOT contains(w.path, '.txt') THEN ([15, 16, 23])[1 + w.l] END AS lines FROM w LEFT JOIN symbols s ON s.path = w.path AND s.name = w.name""",
)
def lookup_outcomes(spark, sf_dir):
    own, k = code_files(spark, sf_dir), F.col("k") % 3
    named = parts(spark, sf_dir).select("path", F.when(k == 0, "price").when(k == 1, F.concat(F.lit("run_"), F.col("k").cast("string"))).otherwise("gone").alias("name"))
    wanted = named.union(named.select(F.concat("path", F.lit(".txt")), F.lit("price")))
    return graph.lookup(wanted, own, extract.symbols(rows_of(own, "symbol")))


@query("expanded_definitions", f"{CODE} SELECT path, CAST(unnest(range(([4, 2, 1])[1 + l], ([16, 17, 24])[1 + l])) AS INTEGER) AS line FROM f")
def expanded_definitions(spark, sf_dir):
    """Lines shown for the function of each file: the whole file, as it is small, without its leading imports."""
    own = code_files(spark, sf_dir)
    hits = extract.symbols(rows_of(own, "symbol")).where("kind = 'function'").select("path", F.col("start_line").alias("line"), "start_line", "end_line")
    return views.expanded_hits(own, hits).select("path", "line")


@query("import_lines", f"{CODE} SELECT path, unnest(CASE l WHEN 0 THEN [1, 2] WHEN 1 THEN [1, 4] ELSE [3] END) AS line FROM f")
def import_lines(spark, sf_dir):
    own = text.lines(code_files(spark, sf_dir), "path")
    return own.where(views.is_import_line(F.substr(names.file_kind(F.col("path")), F.lit(6)), F.col("text"))).select("path", "line")


@query("external_imports", f"{CODE} SELECT path, source, NOT (l = 1 AND starts_with(source, '.')) AS is_external FROM imports")
def external_imports(spark, sf_dir):
    own = extract.imports(rows_of(code_files(spark, sf_dir), "import"))
    return own.select("path", "source", graph.is_external(F.col("lang"), F.col("source")).alias("is_external"))


@query("file_signatures", f"{CODE} SELECT start_line, end_line, kind FROM symbols WHERE path = 'app/d8/m48.py'")
def file_signatures(spark, sf_dir):
    return views.signatures(extract.symbols(rows_of(code_files(spark, sf_dir), "symbol")), "app/d8/m48.py").select("start_line", "end_line", "kind")


@query(
    "code_outlines",
    f"""{CODE}, o AS (SELECT path, start_line, CASE WHEN parent IS NULL THEN '' ELSE '  ' END || '[' || start_line || '-' || end_line || '] ' ||
  CASE WHEN l = 0 THEN CASE WHEN kind = 'class' THEN 'class ' || name || '(' || implements || ')' WHEN name = 'price' THEN 'def price(self,' WHEN name = 'cost' THEN 'def cost(self, x)' ELSE 'def ' || name || '(a)' END
    WHEN l = 1 THEN CASE WHEN kind = 'class' THEN 'export class ' || name || ' extends ' || implements WHEN name = 'price' THEN 'price( x: number, ): number' WHEN name = 'cost' THEN 'cost(x: number): number' ELSE 'export function ' || name || '(a: number)' END
    ELSE CASE WHEN kind = 'struct' THEN 'type ' || name || ' struct' WHEN name = 'Price' THEN 'func (it *' || parent || ') Price( x int, ) int' WHEN name = 'Cost' THEN 'func (it *' || parent || ') Cost(x int) int' ELSE 'func ' || name || '(a int) int' END END AS row FROM symbols)
SELECT path, string_agg(row, chr(10) ORDER BY start_line) AS outline FROM o GROUP BY path""",
)
def code_outlines(spark, sf_dir):
    own = views.code_outline(extract.symbols(rows_of(code_files(spark, sf_dir), "symbol")))
    return own.select("path", F.array_join("outline", "\n").alias("outline"))


#: Patches: a change of one line in a member, a new file, a file that goes, and a renamed file with a change.
PATCHES = [
    "diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n@@ -{c},{n} +{c},{n} @@\n {head}\n-{old}\n+{new}\n",
    "diff --git a/{path}.new b/{path}.new\nnew file mode 100644\n--- /dev/null\n+++ b/{path}.new\n@@ -0,0 +1,2 @@\n+one\n+--- two\n",
    "diff --git a/{path} b/{path}\ndeleted file mode 100644\n--- a/{path}\n+++ /dev/null\n@@ -1 +0,0 @@\n-one\n\\ No newline at end of file\n",
    "diff --git a/{path}.old b/{path}\nsimilarity index 90%\nrename from {path}.old\nrename to {path}\n--- a/{path}.old\n+++ b/{path}\n@@ -{c},{n} +{c},{n} @@\n {head}\n-{old}\n+{new}\n@@ -40,0 +41 @@\n+last\n",
]


def patches(spark, sf_dir) -> DataFrame:
    own = parts(spark, sf_dir)
    body = F.element_at(F.array(*[F.lit(p) for p in PATCHES]), (F.col("k") % 4 + 1).cast("int"))
    at = F.element_at(F.array(F.lit(10), F.lit(10), F.lit(21)), (F.col("l") + 1).cast("int"))
    values = {"path": F.col("path"), "c": at, "n": F.lit(2), "head": F.lit("head"), "old": F.lit("was"), "new": F.concat(F.lit("is "), F.col("s").cast("string"))}
    return own.select(F.col("path").alias("patch"), _filled(body, values).alias("body"))


@query(
    "patch_files",
    f"""{CODE} SELECT path AS patch, path || CASE k % 4 WHEN 1 THEN '.new' ELSE '' END AS path, (['modified', 'added', 'deleted', 'renamed'])[1 + k % 4] AS status, CAST(([1, 2, 0, 2])[1 + k % 4] AS BIGINT) AS added, CAST(([1, 0, 1, 1])[1 + k % 4] AS BIGINT) AS removed FROM f""",
)
def patch_files(spark, sf_dir):
    return diff.file_changes(diff.diff_lines(patches(spark, sf_dir))).select("patch", "path", "status", "added", "removed")


@query(
    "patch_lines",
    f"""{CODE}, c AS (SELECT *, ([10, 10, 21])[1 + l] AS c FROM f), r(m, hunk_no, seq, kind, old_line, new_line) AS (VALUES (0, 1, 0, ' ', 0, 0), (0, 1, 1, '-', 1, NULL), (0, 1, 2, '+', NULL, 1), (3, 1, 0, ' ', 0, 0), (3, 1, 1, '-', 1, NULL), (3, 1, 2, '+', NULL, 1))
SELECT path AS patch, hunk_no, seq, kind, c + old_line AS old_line, c + new_line AS new_line FROM c JOIN r ON k % 4 = m
UNION ALL SELECT path, 2, 0, '+', NULL, 41 FROM c WHERE k % 4 = 3 UNION ALL SELECT path, 1, i - 1, '+', NULL, i FROM c, range(1, 3) x(i) WHERE k % 4 = 1 UNION ALL SELECT path, 1, 0, '-', 1, NULL FROM c WHERE k % 4 = 2""",
)
def patch_lines(spark, sf_dir):
    return diff.diff_lines(patches(spark, sf_dir)).select("patch", "hunk_no", "seq", "kind", "old_line", "new_line")


@query(
    "patch_symbols",
    f"""{CODE} SELECT path, kind, CASE l WHEN 0 THEN 'cost' WHEN 1 THEN CASE kind WHEN '-' THEN 'price' ELSE 'cost' END ELSE 'Run' || k END AS symbol FROM f, (VALUES ('-'), ('+')) x(kind) WHERE k % 4 IN (0, 3)
UNION ALL SELECT path, '+', NULL FROM f WHERE k % 4 = 3 UNION ALL SELECT path || '.new', '+', NULL FROM f, range(2) WHERE k % 4 = 1 UNION ALL SELECT path, '-', NULL FROM f WHERE k % 4 = 2""",
)
def patch_symbols(spark, sf_dir):
    """Changed lines of all patches with the definitions that they are in."""
    symbols = extract.symbols(rows_of(code_files(spark, sf_dir), "symbol"))
    return diff.attributed(diff.diff_lines(patches(spark, sf_dir)), symbols).select("path", "kind", "symbol")


@query(
    "changes_of_term",
    f"""{_CHANGES} SELECT path, name, change FROM n WHERE contains(lower(name), 'spend') OR (name IN ('cost', 'Cost') AND path IN (SELECT path FROM f WHERE k % 4 IN (0, 3) AND s = 2 AND l < 2))
  OR (starts_with(name, 'Run') AND path IN (SELECT path FROM f WHERE k % 4 IN (0, 3) AND s = 2 AND l = 2))""",
)
def changes_of_term(spark, sf_dir):
    """Changes of definitions whose names hold a term, or with a changed line that holds it."""
    changes, symbols = code_changes(spark, sf_dir), extract.symbols(rows_of(code_files(spark, sf_dir), "symbol"))
    lines = diff.attributed(diff.diff_lines(patches(spark, sf_dir)), symbols)
    named = diff.matching_changes(changes, lines.limit(0), "spend")
    return named.unionByName(diff.matching_changes(changes, lines, "IS 2")).dropDuplicates(["path", "kind", "parent", "name"]).select("path", "name", "change")
