"""Definitions, calls and imports of source files whose forms a scanner by lines reads wrongly, each with the SQL that it must agree with.

Every row of ``part`` makes one file in one of twelve languages; what is right in it stands beside the file, by line, as D (kind name
parent first last), C (callee owner caller line) and I (source line)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.plans.code_queries import PARTS_SQL, new_files
from loamline.sources import extract

QUERIES: dict = {}
SQL: dict[str, str] = {}

RUST = r"""impl<T: Fn(u8) -> u8> Tr{k} for S{k}<T> {
    pub fn go{k}(&self) -> u8 { let v = vec![1]; self.f.call::<u8>(1) }
}
macro_rules! mk { ($n:ident) => { fn $n() { x() } } }
impl fmt::Display for &'a Foo{k}<'a> { }
pub(crate) struct P{k}<const N: usize>(u8);
pub const fn k{k}() -> char { '}' }
use a::{b{k},
  c};
trait Q{k} { fn sig(&self); fn def(&self) { go{k}() } } /* fn no() { /* nested */ } */
fn w{k}<F>(f: F) where F: Fn() { f(r#"fn no() { "x" }"#) }
"""
RUST_ROWS = """D impl S{k} - 1 3|D method go{k} S{k} 2 2|D impl Foo{k} - 5 5|D struct P{k} - 6 6|D function k{k} - 7 7|D trait Q{k} - 10 10|D method sig Q{k} 10 10|D method def Q{k} 10 10|D function w{k} - 11 11
C vec - go{k} 2|C call self.f go{k} 2|C go{k} - def 10|C f - w{k} 11|I a 8"""
SCRIPT = r"""export default class extends A{k}<B> implements C {
  #p() {}
  static async s{k}<T>() { return this.#p() }
  abstract q(a: string): void
  r(x: { a: number }): { b: string } { return k{k}(x) }
}
const o{k} = { m() { go{k}() }, async n(a) { } };
interface I{k} extends J { a(): void; b: (x) => void }
export { a } from "./a{k}";
const r = require("./r{k}");
export const h{k} = async (x: T): Promise<T> => { return go(`${f(`{${x}`)} function no() {`) }
function over(a: string): void;
const re = /function no\(\) \{/;
"""
SCRIPT_ROWS = """D class <anonymous> - 1 6|D method #p <anonymous> 2 2|D method s{k} <anonymous> 3 3|D method r <anonymous> 5 5|D variable o{k} - 7 7|D method m - 7 7|D method n - 7 7|D interface I{k} - 8 8|D variable r - 10 10|D function h{k} - 11 11|D variable re - 13 13
C #p this s{k} 3|C k{k} - r 5|C go{k} - m 7|C require - - 10|C go - h{k} 11|C f - h{k} 11|I ./a{k} 9|I ./r{k} 10"""
JAVA = r"""package p{k};
import static a.b.C{k}.*;
import java.util.List;
public class K{k}<T extends Comparable<T>> extends Base<T> implements I1, I2<T> {
  private final Map<String, List<Integer>> m = new HashMap<>(), n;
  public K{k}(int a) { super(a); this.m = go(); }
  @Override public <R> R f{k}(int a,
      int b) throws E { return g(a, "{"); }
  abstract void abs();
  enum Color { RED(1), GREEN; Color(int a) {} }
  interface N { void sig(); default int d() { return 1; } }
  static { init(); }
  int[] arr = {1, 2};
}
@interface Mark { String value() default ""; }
"""
JAVA_ROWS = """D class K{k} - 4 14|D field m K{k} 5 5|D field n K{k} 5 5|D method K{k} K{k} 6 6|D method f{k} K{k} 7 8|D method abs K{k} 9 9|D enum Color K{k} 10 10|D method Color Color 10 10|D interface N K{k} 11 11|D method sig N 11 11|D method d N 11 11|D field arr K{k} 13 13|D interface Mark - 15 15|D method value Mark 15 15
C HashMap - - 5|C go - K{k} 6|C g - f{k} 8|C init - - 12|I a.b.C{k}.* 2|I java.util.List 3"""
GO = r"""package a
import x "y{k}/z"
type (
	A{k} struct { n int }
	B interface { M(int) error }
	C[T any] []T
	D = map[string]struct{}
)
const (
	K{k} = iota
	L
)
var a, b = f{k}(1), 2
func (s *Stack[T]) Push{k}(v T) (ok bool) { go func() { s.run(v) }(); return }
func Map[T any](x []T) map[string]struct{} {
	return g(`func no() {`) }
func i() interface{} { return nil }
"""
GO_ROWS = """D struct A{k} - 4 4|D interface B - 5 5|D type C - 6 6|D type D - 7 7|D constant K{k} - 10 10|D constant L - 11 11|D constant a - 13 13|D constant b - 13 13|D method Push{k} Stack 14 14|D function Map - 15 16|D function i - 17 17
C f{k} - - 13|C run s Push{k} 14|C g - Map 16|I y{k}/z 2"""
KOTLIN = r"""package a
import a.b.C{k} as D
class A{k}(val x: Int) : Base(x), Face {
  val y: Int get() = f(x)
  fun <T> List<T>.go{k}(a: Int): Int = h(a)
  companion object { fun make() = A{k}(1) }
  override fun z() {
    list.map { x -> k(x) }
  }
}
object O{k}
fun top{k}() = 1
"""
KOTLIN_ROWS = """D class A{k} - 3 10|D property y A{k} 4 4|D method go{k} A{k} 5 5|D class Companion A{k} 6 6|D method make Companion 6 6|D method z A{k} 7 9|D class O{k} - 11 11|D function top{k} - 12 12
C f - - 4|C h - go{k} 5|C A{k} - make 6|C k - z 8|I a.b.C{k} 2"""
SCALA = r"""import a.b{k}.{C, D}
case class A{k}[T](x: Int) extends B(x) with C {
  def f{k}(a: Int)(b: Int): Int = {
    g(a)
  }
  val q = 1
}
trait T{k} { def s: Int }
object O extends App { def m = h(1) }
"""
SCALA_ROWS = """D class A{k} - 2 7|D method f{k} A{k} 3 5|D property q A{k} 6 6|D trait T{k} - 8 8|D method s T{k} 8 8|D class O - 9 9|D method m O 9 9
C g - f{k} 4|C h - m 9|I a.b{k} 1"""
CSHARP = r"""using System.Text{k};
namespace A.B{k};
public class K{k} : Base, IFace {
  public int X { get; set; }
  private readonly List<int> y = new List<int>();
  public K{k}(int a) : base(a) { F(a); }
  public async Task<int> F<T>(int a) where T : class => await G(a, @"c:\");
  int Z => 3;
}
public enum E{k} { A = 1 }
"""
CSHARP_ROWS = """D module A.B{k} - 2 10|D class K{k} - 3 9|D property X K{k} 4 4|D field y K{k} 5 5|D method K{k} K{k} 6 6|D method F K{k} 7 7|D property Z K{k} 8 8|D enum E{k} - 10 10
C List - - 5|C F - K{k} 6|C G - F 7|I System.Text{k} 1"""
CPP = r"""#include <vector>
#include "a{k}.h"
namespace n { namespace m {
template <typename T>
class A{k} : public B<T> {
 public:
  A{k}(int x) : x_(x), y_(f(x)) {}
  virtual ~A{k}();
  int get() const override { return g(x_, R"(})"); }
  bool operator==(const A{k}& o) const { return true; }
};
}}
int n::m::A{k}::run(std::vector<int> v) { return make<int>(v); }
struct S s;
static int *sub{k}(
 int a)
{
 return add(a);
}
int proto(int);
extern "C" { void c_fn(void) {} }
typedef struct { int q; } Named{k};
"""
CPP_ROWS = """D module n - 3 12|D module m - 3 12|D class A{k} - 4 11|D method A{k} A{k} 7 7|D method get A{k} 9 9|D method operator== A{k} 10 10|D method run A{k} 13 13|D function sub{k} - 15 19|D function c_fn - 21 21|D struct Named{k} - 22 22
C f - A{k} 7|C g - get 9|C make - run 13|C add - sub{k} 18|I <vector> 1|I "a{k}.h" 2"""
PHP = r"""<?php
namespace A\B;
use X\Y{k} as Z;
require_once 'lib{k}.php';
abstract class K{k} extends B implements I {
  const C = 1;
  public static function f{k}($a) { return $this->g($a); } // function no() {
}
function h{k}() { K::f(1); }
interface Q { function s(); }
"""
PHP_ROWS = """D class K{k} - 5 8|D constant C K{k} 6 6|D method f{k} K{k} 7 7|D function h{k} - 9 9|D interface Q - 10 10|D method s Q 10 10
C g $this f{k} 7|C f K h{k} 9|I X\\Y{k} 3|I lib{k}.php 4"""
SWIFT = r"""import Foundation{k}
public class A{k}: B, P {
  var x: Int { get { f() } }
  init(a: Int) { g(a) }
  func go{k}<T>(_ a: T) -> Int where T: Q {
    return h(a)
  }
}
extension A{k} { static func s() {} }
protocol P { func q() }
"""
SWIFT_ROWS = """D class A{k} - 2 8|D property x A{k} 3 3|D method init A{k} 4 4|D method go{k} A{k} 5 7|D class A{k} - 9 9|D method s A{k} 9 9|D interface P - 10 10|D method q P 10 10
C f - - 3|C g - init 4|C h - go{k} 6|I Foundation{k} 1"""
RUBY = r"""require 'a{k}'
module M{k}
  class A{k} < B
    def self.f{k}(a)
      if a then g(a) end
      [1].each do |x| p(x) end
      return 1 if a
      while x do y() end
    end
    def one = 1
    def q?
      case a
      when 1 then h("#{1} end")
      end
    end
  end
end
"""
RUBY_ROWS = """D module M{k} - 2 17|D class A{k} M{k} 3 16|D method f{k} A{k} 4 9|D method one A{k} 10 10|D method q? A{k} 11 15
C g - f{k} 5|C p - f{k} 6|C y - f{k} 8|C h - q? 13|I a{k} 1"""
ELIXIR = r"""defmodule A.B{k} do
  use GenServer{k}, x: 1
  alias C.D
  def f{k}(a) do
    if a do g(a) end
    Enum.map(a, fn x -> h(x) end)
  end
  defp p(x), do: x
end
defimpl P{k}, for: T do
  def z(_), do: 1
end
"""
ELIXIR_ROWS = """D module A.B{k} - 1 9|D method f{k} A.B{k} 4 7|D method p A.B{k} 8 8|D impl P{k} - 10 12|D method z P{k} 11 11
C g - f{k} 5|C map Enum f{k} 6|C h - f{k} 6|I GenServer{k} 2|I C.D 3"""

FORMS = [
    (".rs", RUST, RUST_ROWS), (".ts", SCRIPT, SCRIPT_ROWS), (".java", JAVA, JAVA_ROWS), (".go", GO, GO_ROWS), (".kt", KOTLIN, KOTLIN_ROWS), (".scala", SCALA, SCALA_ROWS), (".cs", CSHARP, CSHARP_ROWS),
    (".cpp", CPP, CPP_ROWS), (".php", PHP, PHP_ROWS), (".swift", SWIFT, SWIFT_ROWS), (".rb", RUBY, RUBY_ROWS), (".ex", ELIXIR, ELIXIR_ROWS),
]


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"), "p_partkey")


def form_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of each row of ``part``, in the language that its key chooses."""
    k, n = F.col("p_partkey"), len(FORMS)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    content = F.replace(pick([f[1] for f in FORMS]), F.lit("{k}"), k.cast("string"))
    return _keys(spark, sf_dir).select(F.concat(F.lit("f/m"), k.cast("string"), pick([f[0] for f in FORMS])).alias("path"), content.alias("content"))


def _expected(letter: str, columns: str) -> str:
    """SQL of the rows of one letter: the words of each, for every part of its language."""
    rows = []
    for l, (end, _, text) in enumerate(FORMS):
        for row in text.replace("\n", "|").split("|"):
            if row.startswith(letter + " "):
                words = ["NULL" if w == "-" else "'" + w.replace("\\\\", "\\").replace("'", "''") + "'" for w in row.split(" ")[1:]]
                rows.append(f"({l}, '{end}', {', '.join(words)})")
    return f"""WITH rows(l, ending, {columns}) AS (VALUES {", ".join(rows)}), made AS (
SELECT 'f/m' || p_partkey || ending AS path, p_partkey::VARCHAR AS k, rows.* FROM part JOIN rows ON l = p_partkey % {len(FORMS)}) """


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return register


_NAMED = lambda c: f"replace({c}, '{{k}}', k) AS {c}"


@query("form_definitions", _expected("D", "kind, name, parent, first, last") + f"SELECT path, kind, {_NAMED('name')}, {_NAMED('parent')}, CAST(first AS INTEGER) AS start_line, CAST(last AS INTEGER) AS end_line FROM made")
def form_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of all files."""
    return extract.symbols(extract.code_rows(form_files(spark, sf_dir), ["symbol"], shapes=False)).select("path", "kind", "name", "parent", "start_line", "end_line")


@query("form_calls", _expected("C", "callee, owner, caller, line") + f"SELECT path, {_NAMED('callee')}, {_NAMED('owner')}, {_NAMED('caller')}, CAST(line AS INTEGER) AS line FROM made")
def form_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of all files."""
    return extract.calls(extract.code_rows(form_files(spark, sf_dir), ["call"], shapes=False)).select("path", "callee", "owner", "caller", "line")


@query("form_imports", _expected("I", "source, line") + f"SELECT path, {_NAMED('source')}, CAST(line AS INTEGER) AS line FROM made")
def form_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of all files."""
    return extract.imports(extract.code_rows(form_files(spark, sf_dir), ["import"], shapes=False)).select("path", "source", "line")


@query(
    "import_groups",
    """WITH p AS (SELECT p_partkey AS k, CAST(p_partkey % 1000 + 1 AS INTEGER) AS n FROM part), g AS (SELECT k, n, unnest(range(n)) AS i FROM p WHERE k % 2 = 0)
SELECT 'g/m' || k || '.go' AS path, 'lib' || i AS source, CAST(i + 2 AS INTEGER) AS line FROM g
UNION ALL SELECT 'g/m' || k || '.ts', './lib' || k, 1 FROM p WHERE k % 2 = 1""",
)
def import_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of files with one group of up to 1000 lines each."""
    k = F.col("p_partkey")
    lines = lambda form: F.array_join(F.transform(F.sequence(F.lit(0), (k % 1000).cast("int")), lambda i: F.format_string(form, i)), "\n")
    go = F.concat(F.lit("import (\n"), lines('\t"lib%d"'), F.lit("\n)\n"))
    script = F.concat(F.lit("import {\n"), lines("  name%d,"), F.lit("\n} from './lib"), k.cast("string"), F.lit("';\n"))
    path = F.concat(F.lit("g/m"), k.cast("string"), F.when(k % 2 == 0, ".go").otherwise(".ts"))
    files = _keys(spark, sf_dir).select(path.alias("path"), F.when(k % 2 == 0, go).otherwise(script).alias("content"))
    return extract.imports(extract.code_rows(files, ["import"], shapes=False)).select("path", "source", "line")


@query(
    "structure_copies",
    f"""WITH {PARTS_SQL}, c AS (SELECT path, l, CASE WHEN way = 1 THEN s + 10 ELSE s END AS s, CASE WHEN way = 3 THEN 'spend' ELSE 'cost' END AS low FROM f)
SELECT path, CASE WHEN l = 2 THEN upper(low[1]) || low[2:] ELSE low END AS name, count(*) OVER (PARTITION BY l, s, CASE WHEN l = 2 THEN path END) AS copies FROM c""",
)
def structure_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many methods of the made files' second version have a method's structure, whatever their names are.

    Those of Go name their type in the receiver, so they have no copies."""
    own = extract.symbols(extract.code_rows(new_files(spark, sf_dir), ["symbol"])).where(F.lower("name").isin("cost", "spend"))
    copies = own.groupBy("shape").agg(F.count("*").alias("copies"))
    return own.join(copies.hint("merge"), "shape").select("path", "name", "copies")


@query(
    "equal_parts",
    """WITH m AS (SELECT p_partkey AS k, p_partkey % 7 AS g, p_partkey % 2 = 0 AS noted FROM part), n AS (SELECT *, count(*) OVER (PARTITION BY g) AS copies FROM m)
SELECT 'e/m' || k || '.ts' AS path, CASE WHEN noted THEN 2 ELSE 1 END AS start_line, CASE WHEN noted THEN 8 ELSE 6 END AS end_line, 35 AS tokens, copies FROM n WHERE copies > 1""",
)
def equal_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies that are the same but for comments and spacing, in files of seven kinds; what is in such a body is not named again."""
    k = F.col("p_partkey")
    noted = F.lit("// body {k}\nfunction f{k}(a) {\n  // again\n  const b = [1, 2, a];\n  if (a) {\n    go(b, {g}, a + b);\n  }\n  return a * b; /* end */ }\n")
    plain = F.lit("function f{k}(a) {\n  const b = [1,2,a];\n  if (a) {\n    go( b, {g}, a + b);\n  }\n  return a*b; }\n")
    content = F.replace(F.replace(F.when(k % 2 == 0, noted).otherwise(plain), F.lit("{k}"), k.cast("string")), F.lit("{g}"), (k % 7).cast("string"))
    files = _keys(spark, sf_dir).select(F.concat(F.lit("e/m"), k.cast("string"), F.lit(".ts")).alias("path"), content.alias("content"))
    return extract.equal_parts(files).drop("shape")
