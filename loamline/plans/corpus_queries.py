"""Corpus queries over the driver's tables, each with the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.functions import names, queries, rank, text
from loamline.operators import diff, edit, filters, graph, search, views
from loamline.sources.corpus import from_documents, ignored

QUERIES: dict = {}
SQL: dict[str, str] = {}
AS_OF = "2024-01-01 00:10:00"

FILES_SQL = """files AS (SELECT coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id || '.txt' AS path, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS mtime, coalesce(text, '') AS content, doc_id FROM documents)"""
SPLIT_SQL = """split AS (SELECT *, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS q FROM (SELECT *, string_split(content, chr(10)) AS p FROM files)),
lines AS (SELECT path, doc_id, size, mtime, unnest(q) AS text, CAST(unnest(range(1, len(q) + 1)) AS INTEGER) AS line FROM split)"""
BASE = f"WITH {FILES_SQL}, {SPLIT_SQL}"

# Names of every kind, dealt out to documents by id so that name rules have something to work on.
NAMES = (
    "src/main.rs src/lib/util.py web/app.min.js web/app-min.js web/.min.config web/app.test.ts lib/core.spec.js __tests__/a.js docs/guide.md README package-lock.json "
    "go.sum src/Cargo.lock .env .env.local .env.example conf/id_rsa conf/id_rsa.pub keys/server.pem conf/credentials.json .netrc data/table.csv logs/run.log a/b/c/d/e.go "
    "node_modules/x/i.js pkg/target/out.c Makefile Dockerfile .bashrc img/logo.PNG img/logo.png img/photo.jpeg bin/a.tar.gz fonts/x.woff2 conf/app.yaml conf/app.toml x.tsx "
    "examples/sample.txt fixtures/data.json generated/api.ts mocks/user.py vendor/lib.go src/noext src/dot. a.b.c.kt Sources/App.swift lib/app.ex spec/x_spec.rb"
).split()
NAMES_SQL = f"named AS (SELECT doc_id, ([{', '.join(repr(n) for n in NAMES)}])[1 + doc_id % {len(NAMES)}] AS path, CAST(strlen(coalesce(text, '')) AS BIGINT) * (1 + doc_id % 400) AS size FROM documents)"

# Openings that make code of prose, for the line rules.
OPENINGS = [
    "", "// ", "/// ", "# ", "#!", "/* ", "* ", "if ", "} else ", "for ", "return ", "match ", "let x = ", "const y = ", "print(", "console.log(", "log::debug!(", "fmt.Println(", "fn ", "pub fn ", "def ", "class ",
    "export default function ", "impl ", "catch (", "except: ", "x.unwrap() ", "bail!(", "call(", "type ", "// TODO ", "# note ", "    ", "System.out.println(", "echo 'DEBUG", "printf(", "export const ", "async def ",
]
EXTENSIONS = ["rs", "py", "go", "js", "java", "c", "sh", "txt", "mjs", "rb"]
_OPENING_SQL = "([" + ", ".join("'" + o.replace("'", "''") + "'" for o in OPENINGS) + f"])[1 + (doc_id * 7 + line * 3) % {len(OPENINGS)}]"
#: Each line of a document, opened and closed as code, and up to two blank lines after it.
CODE_SQL = f"""opened AS (SELECT *, unnest(range(1 + CASE (doc_id + line) % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 - doc_id % 2 ELSE 0 END)) AS nth FROM lines),
code AS (SELECT 'f' || doc_id || '.' || ([{", ".join(repr(e) for e in EXTENSIONS)}])[1 + doc_id % {len(EXTENSIONS)}] AS path, doc_id, CAST(line * 3 - 2 + nth AS INTEGER) AS line,
  CASE WHEN nth > 0 THEN '' ELSE {_OPENING_SQL} || text || CASE WHEN line % 4 = 0 THEN ' {{' WHEN line % 11 = 0 THEN '?;' ELSE '' END END AS text FROM opened)"""


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_documents(documents(spark, sf_dir))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.lines(files(spark, sf_dir), "path", "doc_id")


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.lit(1) + F.col("doc_id") % len(NAMES)).cast("int"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") * (1 + F.col("doc_id") % 400)
    return documents(spark, sf_dir).select("doc_id", path.alias("path"), size.alias("size"))


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = F.col("doc_id"), F.col("line")
    at = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (F.lit(1) + k).cast("int"))
    blanks = F.when((d + n) % 5 == 0, 2).when((d + n) % 5 == 1, (1 - d % 2).cast("int")).otherwise(0)
    end = F.when(n % 4 == 0, " {").when(n % 11 == 0, "?;").otherwise("")
    made = F.concat(at(OPENINGS, (d * 7 + n * 3) % len(OPENINGS)), F.col("text"), end)
    path = F.concat(F.lit("f"), d.cast("string"), F.lit("."), at(EXTENSIONS, d % len(EXTENSIONS)))
    own = doc_lines(spark, sf_dir).select(path.alias("path"), "doc_id", "line", made.alias("text"), F.explode(F.sequence(F.lit(0), blanks)).alias("nth"))
    return own.select("path", "doc_id", (F.col("line") * 3 - 2 + F.col("nth")).alias("line"), F.when(F.col("nth") > 0, "").otherwise(F.col("text")).alias("text"))


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


_BASE = "regexp_extract(path, '[^/]*$')"
_EXT = f"nullif(regexp_extract({_BASE}, '^.+\\.([^.]*)$', 1), '')"
_LANGS = " ".join(f"WHEN ext IN {_in(w.split())} THEN 'code:{k}'" for k, w in names.LANGUAGE_OF_EXTENSION.items())
_KINDS = " ".join(f"WHEN ext IN {_in(w.split())} THEN '{k}'" for k, w in names.KIND_OF_EXTENSION.items())
_BY_NAME = " ".join(f"WHEN base IN {_in(w.split())} THEN 'code:{k}'" for k, w in names.LANGUAGE_OF_NAME.items())
_MIMES = " ".join(f"WHEN ext IN {_in(w.split())} THEN '{k}'" for k, w in names.MIME.items())


@query(
    "file_kinds",
    f"""WITH {NAMES_SQL}, n AS (SELECT *, {_BASE} AS base, {_EXT} AS ext, lower({_BASE}) AS low FROM named)
SELECT doc_id, path, CASE {_LANGS} {_KINDS} WHEN ext IS NULL AND base IN {_in(' '.join(names.LANGUAGE_OF_NAME.values()).split())} THEN (CASE {_BY_NAME} END)
    WHEN ext IS NULL AND base LIKE '.env%' THEN 'structured' ELSE 'other' END AS kind,
  CASE {_MIMES} ELSE 'application/octet-stream' END AS mime,
  base IN {_in(names.LOCK_FILES)} AS is_lock,
  (low LIKE '%-min.%' AND regexp_matches(low, '-min\\.[^.]*$')) OR regexp_matches(low, '^.+\\.min\\.[^.]*$') AS is_minified,
  NOT low LIKE '%.pub' AND (low = '.env' OR (low LIKE '.env.%' AND low[6:] NOT IN {_in(names.ENV_TEMPLATES)}) OR (low NOT LIKE '.env%' AND (low IN {_in(names.SECRET_NAMES)}
    OR low LIKE 'credentials%' OR (low LIKE '%.%' AND regexp_extract(low, '[^.]*$') IN {_in(names.SECRET_EXTENSIONS)}) OR regexp_matches(low, '_(rsa|dsa|ecdsa|ed25519)')))) AS is_secret,
  path LIKE '%.test.%' OR path LIKE '%.spec.%' OR contains(path, '__tests__/') AS is_test
FROM n""",
)
def file_kinds(spark, sf_dir):
    p = F.col("path")
    return named(spark, sf_dir).select(
        "doc_id", "path", names.file_kind(p).alias("kind"), names.mime_type(p).alias("mime"), names.is_lock_file(p).alias("is_lock"), names.is_minified_name(p).alias("is_minified"),
        names.is_secret_name(p).alias("is_secret"), names.is_test_path(p).alias("is_test"),
    )


@query(
    "walk_filter",
    f"""WITH {NAMES_SQL}, n AS (SELECT *, {_EXT} AS ext, NOT (list_has_any(string_split(path, '/')[1:-2], {list(names.SKIPPED_DIRS)!r})
    OR regexp_matches(lower({_BASE}), '^(.+\\.min|.*-min)\\.[^.]*$')) AND size <= 500000 AS enters FROM named)
SELECT coalesce(ext, '') AS ext, count(*) AS files, count(*) FILTER (enters) AS entered, CAST(sum(greatest(size // 40, 1)) FILTER (enters) AS BIGINT) AS est_lines FROM n GROUP BY 1""",
)
def walk_filter(spark, sf_dir):
    own = named(spark, sf_dir).withColumn("enters", names.enters_walk(F.col("path"), F.col("size")))
    return own.groupBy(F.coalesce(names.extension(F.col("path")), F.lit("")).alias("ext")).agg(
        F.count("*").alias("files"), F.count_if("enters").alias("entered"), F.sum(F.when(F.col("enters"), names.estimated_lines(F.col("size")))).alias("est_lines")
    )


@query(
    "package_roots",
    f"""WITH {NAMES_SQL}, f AS (SELECT DISTINCT path FROM named UNION SELECT unnest(['src/Cargo.toml', 'web/package.json', 'a/b/go.mod', 'setup.py'])),
m AS (SELECT DISTINCT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir FROM f WHERE {_BASE} IN {_in(names.MANIFESTS)}),
d AS (SELECT path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir FROM f)
SELECT d.path, arg_max(m.dir, length(m.dir)) AS package FROM d JOIN m ON d.dir = m.dir OR starts_with(d.dir, m.dir || '/') OR m.dir = '' GROUP BY d.path""",
)
def package_roots(spark, sf_dir):
    from loamline.sources.corpus import package_root

    extra = spark.createDataFrame([(p,) for p in ("src/Cargo.toml", "web/package.json", "a/b/go.mod", "setup.py")], "path string")
    return package_root(named(spark, sf_dir).select("path").union(extra).distinct())


@query(
    "content_classes",
    f"""{BASE} SELECT path, regexp_matches(left(content, 512), '{"|".join(["generated", "DO NOT EDIT", "[Dd]o not edit", "THIS FILE IS"])}') AND regexp_matches(left(content, 512), '{"|".join(text.GENERATED_MARKERS)}') AS is_generated,
  length(regexp_replace(left(content, 2048), '[^' || chr(10) || ']', '', 'g')) < 2 AS is_minified, CAST(ceil(size / 4) AS BIGINT) AS tokens,
  CASE WHEN size = 0 THEN 'empty' WHEN size >= 100000 AND length(regexp_replace(left(content, 2048), '[^' || chr(10) || ']', '', 'g')) < 2 THEN 'minified' WHEN ceil(size / 4) <= 6000 THEN 'full' ELSE 'outline' END AS mode
FROM files""",
)
def content_classes(spark, sf_dir):
    own = views.read_mode(files(spark, sf_dir))
    c = F.col("content")
    return own.select("path", text.is_generated_text(c).alias("is_generated"), text.is_minified_text(c).alias("is_minified"), text.tokens(c).alias("tokens"), "mode")


@query(
    "size_labels",
    f"""{BASE} SELECT path, CASE WHEN n < 1000 THEN format('~{{}}', n) WHEN n < 999950 THEN printf('~%.1fk', round(n / 100.0) / 10) ELSE printf('~%.1fM', round(n / 100000.0) / 10) END AS token_label,
  CASE WHEN size < 1024 THEN format('{{}}B', size) WHEN size < 1048576 THEN printf('%.1fKB', round(size / 102.4) / 10) ELSE printf('%.1fMB', round(size / 104857.6) / 10) END AS size_label
FROM (SELECT *, CAST(ceil(size / 4) AS BIGINT) AS n FROM files)""",
)
def size_labels(spark, sf_dir):
    return files(spark, sf_dir).select("path", text.token_label(text.tokens_of_bytes(F.col("size"))).alias("token_label"), text.size_label(F.col("size")).alias("size_label"))


_DECORATED = ["{w}", "/{w}.*/", "/{w}/", "src/{w}.*", "{w}_x", "{w} {v}", "{w} {v} {w} {v} {w}", "$ref{w}", "./{w}", "a/b {w}", "42", "{w}.rs", "Makefile", "{W}", "{w}::{v}", "fix: {w}!", "*.py", ".{w}", "{w}-{v}", "get{W}"]
_DECORATED_SQL = "CASE " + " ".join(
    f"WHEN doc_id % {len(_DECORATED)} = {k} THEN " + " || ".join(f"'{p}'" if p not in ("{w}", "{v}", "{W}") else {"{w}": "w", "{v}": "v", "{W}": "upper(w)"}[p] for p in __import__("re").split(r"(\{[wvW]\})", d) if p)
    for k, d in enumerate(_DECORATED)
) + " END"


@query(
    "query_classes",
    f"""WITH d AS (SELECT doc_id, lower(regexp_extract(coalesce(text, ''), '[A-Za-z]+')) AS w, coalesce(lang, 'xx') AS v FROM documents), q AS (SELECT doc_id, {_DECORATED_SQL} AS q FROM d WHERE w <> ''),
s AS (SELECT *, list_filter(regexp_split_to_array(q, '\\s+'), lambda x: x <> '') AS words FROM q)
SELECT doc_id, q, CASE WHEN q LIKE '/_%/' AND regexp_matches(q[2:-2], '[][(){{}}*+?|\\\\^$]') THEN 'regex' WHEN NOT contains(q, ' ') AND regexp_matches(q, '[*?{{\\[]') THEN 'glob'
  WHEN q LIKE './%' OR q LIKE '../%' OR (contains(q, '/') AND NOT contains(q, ' ')) THEN 'fallthrough' WHEN regexp_full_match(q, '[0-9]*') THEN 'content'
  WHEN regexp_full_match(q, '[A-Za-z_$@][A-Za-z0-9_$.-]*') THEN (CASE WHEN regexp_matches(q, '^[A-Z$@]|[._-]|^[a-z].*[A-Z]') THEN 'symbol' ELSE 'concept' END)
  WHEN contains(q, ' ') AND len(words) <= 4 AND len(list_filter(words, lambda x: NOT regexp_full_match(x, '[A-Za-z0-9_-]+'))) = 0 THEN 'concept' ELSE 'content' END AS kind FROM s""",
)
def query_classes(spark, sf_dir):
    import re

    own = documents(spark, sf_dir).select("doc_id", F.lower(F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z]+", 0)).alias("w"), F.coalesce("lang", F.lit("xx")).alias("v")).where("w <> ''")
    made = F.lit(None).cast("string")
    for k, d in enumerate(_DECORATED):
        parts = [{"{w}": F.col("w"), "{v}": F.col("v"), "{W}": F.upper("w")}.get(p, F.lit(p)) for p in re.split(r"(\{[wvW]\})", d) if p]
        made = F.when(F.col("doc_id") % len(_DECORATED) == k, F.concat(*parts)).otherwise(made)
    return own.select("doc_id", made.alias("q")).withColumn("kind", queries.classify(F.col("q")))


_TRIM = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
_FLOW = "(starts_with(t, 'if ') OR starts_with(t, '} else') OR regexp_matches(t, '^(else|loop)( |\\{|$)') OR regexp_matches(t, '^(match|switch|case|for|while) ') OR regexp_matches(t, '^return( |;|$)'))"
_ERR = "(t LIKE '%?;' OR t LIKE '%?' OR contains(t, '.unwrap()') OR contains(t, '.expect(') OR regexp_matches(t, '^catch[ (]|^except[ :]|(panic|bail|anyhow)!\\('))"
_COMMENT = "(t LIKE '//%' OR t LIKE '#%' OR t LIKE '/*%' OR t LIKE '* %' OR t IN ('*', '*/'))"
_DEFINES = "regexp_matches(t, '^((pub(\\(crate\\))? )?fn |(pub )?async fn |(export (default |async )?|async )?function |(export )?(const|let|var|class|interface|type) |(pub )?(struct|enum|trait) |impl |(async )?def |func )')"


@query(
    "line_rules",
    f"""{BASE}, {CODE_SQL}, c AS (SELECT *, {_TRIM} AS t FROM code)
SELECT path, count(*) AS lines, count(*) FILTER ({_DEFINES}) AS definitions, count(*) FILTER ({_COMMENT}) AS comments, count(*) FILTER ({_FLOW}) AS control, count(*) FILTER ({_ERR}) AS errors,
  count(*) FILTER (regexp_matches(t, '^(let|const|var|mut) ')) AS variables FROM c GROUP BY path""",
)
def line_rules(spark, sf_dir):
    t = F.col("t")
    own = code_lines(spark, sf_dir).withColumn("t", text.trimmed(F.col("text")))
    return own.groupBy("path").agg(
        F.count("*").alias("lines"), F.count_if(text.is_definition_line(t)).alias("definitions"), F.count_if(text.is_comment_only(t)).alias("comments"), F.count_if(text.is_control_flow(t)).alias("control"),
        F.count_if(text.is_error_handling(t)).alias("errors"), F.count_if(text.is_variable(t)).alias("variables"),
    )


_FAMILY = "CASE " + " ".join(f"WHEN ext IN {_in(w.split())} THEN '{k}'" for k, w in text.FAMILY_OF_EXTENSION.items()) + " END"
_LOGS = " OR ".join(f"(family = '{k}' AND (" + " OR ".join("starts_with(t, '" + p.replace("'", "''") + "')" for p in v) + "))" for k, v in text.DEBUG_LOGS.items())
_PLAIN = " OR ".join(f"(family = '{k}' AND starts_with(t, '{o}')" + "".join(f" AND NOT starts_with(t, '{x}')" for x in docs) + ")" for k, (o, docs) in text.COMMENTS.items())


@query(
    "strip_noise",
    f"""{BASE}, {CODE_SQL}, c AS (SELECT *, {_TRIM} AS t, regexp_extract(path, '[^.]*$') AS ext FROM code), f AS (SELECT *, {_FAMILY} AS family, t = '' AS blank FROM c),
s AS (SELECT *, blank AND coalesce(lag(blank) OVER (PARTITION BY path ORDER BY line), false) AS again FROM f)
SELECT path, line, text FROM s WHERE family IS NULL OR NOT (again OR (NOT blank AND (coalesce({_LOGS}, false) OR (coalesce({_PLAIN}, false) AND NOT regexp_matches(upper(t), 'TODO|FIXME|NOTE|HACK|SAFETY|WARN')))))""",
)
def strip_noise(spark, sf_dir):
    return views.skipped_lines(code_lines(spark, sf_dir)).where("NOT skip").select("path", "line", "text")


@query(
    "diverse_lines",
    f"""{BASE}, {CODE_SQL}, c AS (SELECT *, {_TRIM} AS t, contains(lower(text), 'the') AS hit, min(line) OVER w AS a, max(line) OVER w AS b, count(*) OVER w AS n FROM code WINDOW w AS (PARTITION BY path)),
p AS (SELECT *, CASE WHEN line = a OR line = b THEN 100 WHEN t = '' OR {_COMMENT} THEN 0 WHEN {_FLOW} OR {_ERR} OR contains(t, '(') THEN 10 WHEN t LIKE '_%{{' THEN 5 WHEN contains(t, '=') OR regexp_matches(t, '^(let|const|var|mut) ') THEN 1 ELSE 0 END
  + CASE WHEN hit THEN 50 ELSE 0 END + 5 * (coalesce(lag(hit) OVER o, false)::INT + coalesce(lead(hit) OVER o, false)::INT) AS score FROM c WINDOW o AS (PARTITION BY path ORDER BY line)),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, line) AS place FROM p)
SELECT path, line, text, CAST(score AS INTEGER) AS score FROM r WHERE n < 30 OR place <= 12""",
)
def diverse_lines(spark, sf_dir):
    return views.diverse_lines(code_lines(spark, sf_dir), "the", least=30, most=12)


def _words_sql(words):
    return " + ".join(f"list_contains(words, '{w}')::INT" for w in words)


def _rank_sql(hits: str, q: str, where: str, exact: bool, limit: str = "") -> str:
    """Ranking terms that usages in text files can have, in SQL."""
    words = [w.lower() for w in q.split()] if " " in q else []
    own = (
        f"CASE WHEN {_words_sql(words)} = {len(words)} THEN 300 WHEN {_words_sql(words)} >= {len(words) - 1} THEN 120 ELSE 0 END" if len(words) > 1 else "0"
    )
    return f"""{BASE}, h AS (SELECT *, regexp_split_to_array(lower(path || ' ' || text), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+') AS words, greatest(size // 40, 1) AS est FROM lines WHERE size <= 500000 AND {where}),
s AS (SELECT *, {500 if exact else 0} + {own} + greatest(0, 200 - 20 * 3) + CASE WHEN age <= 3600 THEN 100 WHEN age <= 86400 THEN 80 WHEN age <= 604800 THEN 50 WHEN age <= 2592000 THEN 20 ELSE 0 END
  + CASE WHEN est < 200 THEN 50 ELSE 0 END + CASE WHEN lower(regexp_extract(path, '([^/]*)/[^/]*$', 1)) = '{q.lower()}' THEN 200 ELSE 0 END - 250
  - CASE WHEN regexp_matches(ltrim(text), '^(//([^/]|$)|/\\*|<!--)') THEN 150 ELSE 0 END AS score
  FROM (SELECT *, greatest(0, epoch(TIMESTAMP '{AS_OF}') - epoch(mtime)) AS age FROM h))
{hits}{limit}"""


@query("content_search", _rank_sql("SELECT path, line, text, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (ORDER BY score DESC, path, line) AS INTEGER) AS place, (SELECT count(*) FROM s) AS total_found FROM s QUALIFY place <= 10", "and the", "contains(text, 'and the')", False))
def content_search(spark, sf_dir):
    hits = search.ranked(search.content_hits(files(spark, sf_dir), "and the"), "and the", F.lit(AS_OF).cast("timestamp"))
    return search.top(hits).select("path", "line", "text", "score", "place", "total_found")


@query("usage_search", _rank_sql("SELECT path, line, CAST(score AS INTEGER) AS score FROM s", "tion", "regexp_matches(text, '(^|[^A-Za-z0-9_])tion($|[^A-Za-z0-9_])')", True))
def usage_search(spark, sf_dir):
    return search.ranked(search.usage_hits(files(spark, sf_dir), "tion"), "tion", F.lit(AS_OF).cast("timestamp")).select("path", "line", "score")


@query("filtered_usages", SQL["usage_search"])
def filtered_usages(spark, sf_dir):
    """The same usages, looked for only in files whose identifier filter does not deny the name."""
    own = files(spark, sf_dir)
    hits = search.usage_hits(filters.narrowed(own, filters.identifier_filters(own), "tion"), "tion")
    return search.ranked(hits, "tion", F.lit(AS_OF).cast("timestamp")).select("path", "line", "score")


@query(
    "filter_answers",
    """WITH names AS (SELECT DISTINCT regexp_extract(text, '[A-Za-z_][A-Za-z0-9_]*') AS name FROM benchmark), found AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM documents)
SELECT name, (SELECT count(*) FROM documents) AS files, count(doc_id) AS held, 0::BIGINT AS missed FROM names LEFT JOIN found USING (name) WHERE name <> '' GROUP BY name""",
)
def filter_answers(spark, sf_dir):
    """How many files have the first identifier of each benchmark item, and how many of these their filters deny."""
    own = files(spark, sf_dir)
    named = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.regexp_extract("text", filters.IDENTIFIER, 0).alias("name")).where("name <> ''").distinct()
    out = filters.misses(own, filters.identifier_filters(own), named)
    return out.select("name", "files", "held", (F.col("held") + F.col("wrong") - F.col("passed")).alias("missed"))


@query("regex_search", f"{BASE} SELECT path, CAST(count(*) AS BIGINT) AS hits FROM lines WHERE size <= 500000 AND regexp_matches(text, '[0-9]{{3}}|##[a-z]') GROUP BY path")
def regex_search(spark, sf_dir):
    return search.content_hits(files(spark, sf_dir), "[0-9]{3}|##[a-z]", is_regex=True).groupBy("path").agg(F.count("*").alias("hits"))


@query("two_word_search", f"{BASE} SELECT path, line FROM lines WHERE size <= 500000 AND regexp_matches(text, 'with.*from|from.*with')")
def two_word_search(spark, sf_dir):
    return search.content_hits(files(spark, sf_dir), search.multi_word_pattern("with from"), is_regex=True).select("path", "line")


@query(
    "batch_search",
    f"""{BASE}, q(query_no, query) AS (VALUES (1, 'ther'), (2, 'ation'), (3, 'der die')), h AS (SELECT query_no, path, line, text, row_number() OVER (PARTITION BY query_no ORDER BY path, line) AS place, count(*) OVER (PARTITION BY query_no) AS total_found
  FROM lines JOIN q ON contains(text, query) WHERE size <= 500000) SELECT query_no, path, line, text, CAST(place AS INTEGER) AS place, total_found FROM h WHERE place <= 10""",
)
def batch_search(spark, sf_dir):
    wanted = spark.createDataFrame([(1, "ther"), (2, "ation"), (3, "der die")], "query_no int, query string")
    return search.batch_hits(files(spark, sf_dir), wanted)


_SYMBOLS_SQL = """symbols AS (SELECT path, regexp_extract(text, '^[A-Z][a-z]+') AS name, line AS start_line, line + 3 + length(text) % 4 AS end_line FROM lines WHERE regexp_matches(text, '^[A-Z][a-z]{2,} '))"""


def symbols(spark, sf_dir) -> DataFrame:
    """Lines that begin with a capital word, as definitions of it that last some lines."""
    own = text.lines(files(spark, sf_dir), "path").where(F.col("text").rlike("^[A-Z][a-z]{2,} "))
    none = lambda t: F.lit(None).cast(t)
    return own.select(
        "path", F.lit("prose").alias("lang"), F.lit("function").alias("kind"), F.regexp_extract("text", "^[A-Z][a-z]+", 0).alias("name"), none("string").alias("parent"), F.col("line").alias("start_line"),
        (F.col("line") + 3 + F.length("text") % 4).alias("end_line"), F.col("text").alias("signature"), F.lit(True).alias("exported"), F.array().cast("array<string>").alias("implements"), none("string").alias("doc"), F.col("line").alias("ord"),
    )


@query(
    "symbol_search",
    f"""{BASE}, {_SYMBOLS_SQL}, d AS (SELECT path, start_line AS line FROM symbols WHERE name = 'The'), u AS (SELECT path, line FROM lines WHERE size <= 500000 AND regexp_matches(text, '(^|[^A-Za-z0-9_])The($|[^A-Za-z0-9_])'))
SELECT path, line, true AS is_definition FROM d UNION ALL SELECT path, line, false FROM u ANTI JOIN d USING (path, line)""",
)
def symbol_search(spark, sf_dir):
    return search.symbol_hits(files(spark, sf_dir), symbols(spark, sf_dir), "The").select("path", "line", "is_definition")


@query(
    "facet_totals",
    f"""{BASE}, {_SYMBOLS_SQL}, d AS (SELECT path, start_line AS line FROM symbols WHERE name = 'The'), u AS (SELECT path, line, text FROM lines WHERE size <= 500000 AND regexp_matches(text, '(^|[^A-Za-z0-9_])The($|[^A-Za-z0-9_])')),
a AS (SELECT 'definition' AS facet FROM d UNION ALL SELECT CASE WHEN regexp_matches(path, '_test\\.|/tests?/|_spec\\.|/spec/') OR contains(text, '@Test') THEN 'test' ELSE 'other' END FROM u ANTI JOIN d USING (path, line))
SELECT facet, count(*) AS hits FROM a GROUP BY facet""",
)
def facet_totals(spark, sf_dir):
    own = files(spark, sf_dir)
    hits = search.ranked(search.symbol_hits(own, symbols(spark, sf_dir), "The"), "The", F.lit(AS_OF).cast("timestamp"))
    return search.facet_totals(search.facets(hits, own.select("path", F.lit(None).cast("string").alias("package"))))


@query(
    "enclosing_scopes",
    f"""{BASE}, {_SYMBOLS_SQL}, h AS (SELECT path, line FROM lines WHERE contains(text, 'tion')), j AS (SELECT h.path, h.line, s.name, row_number() OVER (PARTITION BY h.path, h.line ORDER BY s.start_line DESC NULLS LAST, s.end_line) AS n
  FROM h LEFT JOIN symbols s ON h.path = s.path AND h.line BETWEEN s.start_line AND s.end_line) SELECT path, line, name AS in_name FROM j WHERE n = 1""",
)
def enclosing_scopes(spark, sf_dir):
    hits = search.file_lines(files(spark, sf_dir)).where(F.col("text").contains("tion")).select("path", "line")
    return graph.enclosing(hits, symbols(spark, sf_dir)).select("path", "line", "in_name")


_CALLS_SQL = "calls AS (SELECT path, line, regexp_extract(text, '([A-Za-z]+)[.,]? *$', 1) AS callee, regexp_extract(text, '^[A-Za-z]+') AS caller FROM lines WHERE regexp_matches(text, '[A-Za-z]+[.,]? *$') AND regexp_matches(text, '^[A-Za-z]+'))"


def prose_calls(spark, sf_dir) -> DataFrame:
    """Lines as calls of their last word by their first."""
    own = text.lines(files(spark, sf_dir), "path").where(F.col("text").rlike("[A-Za-z]+[.,]? *$") & F.col("text").rlike("^[A-Za-z]+"))
    last = F.regexp_extract("text", "([A-Za-z]+)[.,]? *$", 1)
    return own.select("path", F.lit("prose").alias("lang"), last.alias("callee"), F.lit(None).cast("string").alias("owner"), F.regexp_extract("text", "^[A-Za-z]+", 0).alias("caller"), "line")


@query("callers", f"{BASE}, {_CALLS_SQL}, t(ord, target) AS (VALUES (1, 'the'), (2, 'die')) SELECT ord, target, path, line, caller FROM calls JOIN t ON callee = target")
def callers(spark, sf_dir):
    targets = spark.createDataFrame([(1, "the"), (2, "die")], "ord int, target string")
    return graph.callers(prose_calls(spark, sf_dir), targets).select("ord", "target", "path", "line", "caller")


@query(
    "import_ranks",
    f"""{BASE}, {_CALLS_SQL}, g AS (SELECT path, callee AS source, count(*) AS n, min(line) AS line FROM calls GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line, source) AS place FROM g)
SELECT path, source, n, line, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5""",
)
def import_ranks(spark, sf_dir):
    own = prose_calls(spark, sf_dir).select("path", F.col("callee").alias("source"), "line")
    return graph.import_groups(own)


@query(
    "directory_totals",
    f"""{BASE}, a AS (SELECT size, unnest(['', regexp_extract(path, '^[^/]*'), regexp_extract(path, '^[^/]*/[^/]*')]) AS dir FROM files)
SELECT dir, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(ceil(size / 4)) AS BIGINT) AS tokens_of_files, CAST(ceil(sum(size) / 4) AS BIGINT) AS tokens FROM a GROUP BY dir""",
)
def directory_totals(spark, sf_dir):
    return graph.directory_totals(files(spark, sf_dir))


@query(
    "line_runs",
    f"""{BASE}, h AS (SELECT DISTINCT path, line FROM lines WHERE contains(text, 'an')), i AS (SELECT *, line - row_number() OVER (PARTITION BY path ORDER BY line) AS g FROM h), r AS (SELECT path, min(line) AS a, max(line) AS b FROM i GROUP BY path, g)
SELECT path, string_agg(CASE WHEN a = b THEN a::VARCHAR WHEN b = a + 1 THEN a || ',' || b ELSE a || '-' || b END, ',' ORDER BY a) AS label FROM r GROUP BY path""",
)
def line_runs(spark, sf_dir):
    return search.grouped_lines(doc_lines(spark, sf_dir).where(F.col("text").contains("an")))


@query("glob_list", f"{BASE}, g AS (SELECT path, size FROM files WHERE regexp_matches(path, '^src1[^/]*/(en|fr)/[^/]*1\\.txt$')) SELECT path, size, (SELECT count(*) FROM g) AS total_found FROM g ORDER BY path LIMIT 20")
def glob_list(spark, sf_dir):
    return search.glob_files(files(spark, sf_dir), "src1*/{en,fr}/*1.txt")


@query("similar_names", "SELECT c_name AS name, levenshtein(c_name, 'Customer#00000x42') AS distance FROM customer WHERE levenshtein(c_name, 'Customer#00000x42') <= 3 ORDER BY distance, name LIMIT 1")
def similar_names(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("people/"), "c_name").alias("path"))
    return search.similar_names(own, "people", "Customer#00000x42").select("name", F.col("distance").cast("long").alias("distance"))


@query(
    "head_tail",
    f"{BASE}, n AS (SELECT *, max(line) OVER (PARTITION BY path) AS n FROM lines) SELECT path, line, text FROM n WHERE line <= 10 OR line > n - 5",
)
def head_tail(spark, sf_dir):
    return views.head_tail(text.lines(files(spark, sf_dir), "path")).select("path", "line", "text")


@query(
    "tabular_outline",
    f"""{BASE}, o AS (SELECT path, max(text) FILTER (line = 1) AS header, count(*) - 1 AS n FROM lines GROUP BY path),
s AS (SELECT l.path, string_agg(text, chr(10) ORDER BY line) AS shown FROM lines l JOIN o ON l.path = o.path WHERE line > 1 AND (line <= 6 OR line > n - 2) GROUP BY l.path)
SELECT o.path, header, n AS rows, coalesce(shown, '') AS shown FROM o LEFT JOIN s ON o.path = s.path""",
)
def tabular_outline(spark, sf_dir):
    return views.tabular_outline(files(spark, sf_dir)).withColumn("shown", F.array_join("shown", "\n"))


@query(
    "read_ranges",
    f"{BASE}, r AS (SELECT doc_id AS ord, path, 2 + doc_id % 3 AS first, 4 + doc_id % 5 AS last FROM files) SELECT ord, l.path, line, text FROM r JOIN lines l ON r.path = l.path AND line BETWEEN first AND last",
)
def read_ranges(spark, sf_dir):
    own = files(spark, sf_dir)
    ranges = own.select(F.col("doc_id").alias("ord"), "path", (2 + F.col("doc_id") % 3).alias("first"), (4 + F.col("doc_id") % 5).alias("last"))
    return views.read_ranges(own, ranges)


_HEADED = "CASE WHEN line % 4 = 1 THEN repeat('#', CAST(1 + (doc_id + line) % 3 AS INTEGER)) || ' ' || text WHEN line % 9 = 0 THEN '```' ELSE text END"


@query(
    "headings",
    f"""{BASE}, m AS (SELECT path, line, {_HEADED} AS text FROM lines), f AS (SELECT *, coalesce(sum(CASE WHEN text = '```' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS fenced,
  max(CASE WHEN trim(text) <> '' THEN line END) OVER (PARTITION BY path) AS last FROM m),
h AS (SELECT path, line, length(regexp_extract(text, '^#+')) AS level, last FROM f WHERE NOT fenced AND regexp_matches(text, '^#{{1,6}}(\\s|$)'))
SELECT a.path, a.line, CAST(a.level AS INTEGER) AS level, CAST(coalesce(min(b.line) - 1, greatest(any_value(a.last), a.line)) AS INTEGER) AS end_line FROM h a LEFT JOIN h b ON a.path = b.path AND b.line > a.line AND b.level <= a.level GROUP BY a.path, a.line, a.level""",
)
def headings(spark, sf_dir):
    return search.headings(headed_files(spark, sf_dir)).select("path", "line", "level", "end_line")


def headed_files(spark, sf_dir) -> DataFrame:
    """Documents with a heading in every fourth line and fences between."""
    own = doc_lines(spark, sf_dir)
    marks = F.repeat(F.lit("#"), (1 + (F.col("doc_id") + F.col("line")) % 3).cast("int"))
    line = F.when(F.col("line") % 4 == 1, F.concat(marks, F.lit(" "), F.col("text"))).when(F.col("line") % 9 == 0, "```").otherwise(F.col("text"))
    whole = own.withColumn("text", line).groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("content"))
    return whole.withColumn("content", F.concat("content", F.lit("\n")))


_CONFLICT = "CASE line % 12 WHEN 2 THEN '<<<<<<< ours' WHEN 5 THEN '=======' WHEN 8 THEN '>>>>>>> theirs' ELSE text END"


@query(
    "conflicts",
    f"""{BASE}, m AS (SELECT path, line, line // 12 AS no, line % 12 AS k, text FROM lines)
SELECT path, CAST(min(line) FILTER (k = 2) AS INTEGER) AS line, string_agg(text, chr(10) ORDER BY line) FILTER (k IN (3, 4)) AS ours, string_agg(text, chr(10) ORDER BY line) FILTER (k IN (6, 7)) AS theirs FROM m GROUP BY path, no HAVING bool_or(k = 8)""",
)
def conflicts(spark, sf_dir):
    k = F.col("line") % 12
    line = F.when(k == 2, "<<<<<<< ours").when(k == 5, "=======").when(k == 8, ">>>>>>> theirs").otherwise(F.col("text"))
    return diff.conflicts(doc_lines(spark, sf_dir).select("path", "line", line.alias("text")))


@query(
    "hunk_numbers",
    f"""{BASE}, l AS (SELECT doc_id AS file_no, line // 8 AS hunk_no, line AS seq, ([' ', '+', '-'])[1 + (doc_id + line * line) % 3] AS kind FROM lines),
n AS (SELECT *, coalesce(sum(CASE WHEN kind <> '+' THEN 1 ELSE 0 END) OVER w, 0) AS o, coalesce(sum(CASE WHEN kind <> '-' THEN 1 ELSE 0 END) OVER w, 0) AS m FROM l WINDOW w AS (PARTITION BY file_no, hunk_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT file_no, CAST(hunk_no AS BIGINT) AS hunk_no, seq, kind, CAST(CASE WHEN kind <> '+' THEN hunk_no * 10 + 1 + o END AS BIGINT) AS old_no, CAST(CASE WHEN kind <> '-' THEN hunk_no * 11 + 1 + m END AS BIGINT) AS new_no FROM n""",
)
def hunk_numbers(spark, sf_dir):
    kinds = F.array(F.lit(" "), F.lit("+"), F.lit("-"))
    own = doc_lines(spark, sf_dir).select(F.col("doc_id").alias("file_no"), F.floor(F.col("line") / 8).alias("hunk_no"), F.col("line").alias("seq"), F.element_at(kinds, (1 + (F.col("doc_id") + F.col("line") * F.col("line")) % 3).cast("int")).alias("kind"))
    hunks = own.select("file_no", "hunk_no").distinct().select("file_no", "hunk_no", (F.col("hunk_no") * 10 + 1).alias("old_start"), (F.col("hunk_no") * 11 + 1).alias("new_start"))
    return diff.renumbered(own, hunks).select("file_no", "hunk_no", "seq", "kind", "old_no", "new_no")


@query("secret_hits", f"""WITH {NAMES_SQL}, n AS (SELECT doc_id, path FROM named) SELECT doc_id, CASE WHEN regexp_matches(path, '(^|/)(\\.env(\\.local)?|id_rsa|server\\.pem|credentials\\.json|\\.netrc)$') THEN '(redacted)' ELSE path END AS text FROM n""")
def secret_hits(spark, sf_dir):
    own = named(spark, sf_dir).withColumn("text", F.col("path"))
    return search.redacted(own).select("doc_id", "text")


@query("changed_files", f"{BASE} SELECT path, mtime > TIMESTAMP '2024-01-01 00:05:00' AS changed, CASE WHEN mtime > TIMESTAMP '2024-01-01 00:05:00' THEN content ELSE '(unchanged)' END AS text FROM files")
def changed_files(spark, sf_dir):
    own = files(spark, sf_dir).withColumn("text", F.col("content"))
    return search.changed_since(own, F.lit("2024-01-01 00:05:00").cast("timestamp")).select("path", "changed", "text")


@query(
    "packed_blocks",
    f"""WITH RECURSIVE {FILES_SQL}, {SPLIT_SQL}, b AS (SELECT path AS owner, line AS ord, strlen(text) AS bytes, row_number() OVER (PARTITION BY path ORDER BY line % 10 <> 1, -(line * 7 % 13), line) AS n, line % 10 = 1 AS stays FROM lines),
r(owner, n, used, kept) AS (SELECT DISTINCT owner, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS INTEGER[]) FROM b
  UNION ALL SELECT r.owner, b.n, CASE WHEN stays OR used + bytes <= 4000 THEN used + bytes ELSE used END, CASE WHEN stays OR used + bytes <= 4000 THEN list_append(kept, ord) ELSE kept END FROM r JOIN b ON b.owner = r.owner AND b.n = r.n + 1)
SELECT owner, array_to_string(list_sort(arg_max(kept, n)), ',') AS kept FROM r GROUP BY owner""",
)
def packed_blocks(spark, sf_dir):
    """First fit by worth."""
    own = doc_lines(spark, sf_dir).select(F.col("path").alias("owner"), F.col("line").alias("ord"), F.octet_length("text").cast("long").alias("bytes"), (F.col("line") * 7 % 13).alias("worth"), (F.col("line") % 10 == 1).alias("structural"))
    return views.packed(own, 4000).select("owner", F.array_join("kept", ",").alias("kept"))


@query(
    "path_suggestions",
    f"""{BASE}, c AS (SELECT DISTINCT path, regexp_extract(lower(path), 's.*?1.*?e.*?4') AS m FROM files)
SELECT path, CAST(100 - least(80, length(m) - 4) + CASE WHEN regexp_matches(regexp_extract(lower(path), '[^/]*$'), 's.*?1.*?e.*?4') THEN 20 ELSE 0 END - least(10, length(path) // 20) AS BIGINT) AS score FROM c WHERE m <> '' ORDER BY score DESC, path LIMIT 3""",
)
def path_suggestions(spark, sf_dir):
    return search.suggested(files(spark, sf_dir), "path", "s1e4")


@query(
    "score_terms",
    f"""WITH {NAMES_SQL} SELECT doc_id, CASE WHEN regexp_matches(lower(path), '(^|/)(mock|mocks|fixture|fixtures|stub|stubs|fake|fakes|example|examples)(/|$)') THEN 90 ELSE 0 END AS fixture,
  CASE WHEN regexp_matches(path, '(^|/)(node_modules|vendor|dist|build|\\.git|target|__pycache__|\\.venv|venv|pkg|out)(/|$)') THEN 200 ELSE 0 END AS vendor,
  greatest(0, 200 - 20 * len(string_split(path, '/'))) AS proximity,
  CASE WHEN s = 'app' THEN 500 WHEN regexp_matches(s, '^app[_.-]') THEN 350 WHEN s LIKE '%app' THEN 250 WHEN contains(s, 'app') THEN 180 WHEN regexp_matches(lower(path), '(^|/)app/[^/]*$') THEN 200 ELSE 0 END AS basename,
  CASE WHEN regexp_matches(path, '\\.(md|mdx|txt|rst)$|(^|/)docs?(/|$)') THEN 250 ELSE 0 END + CASE WHEN regexp_matches(path, '(^|/)(examples?|samples?|templates?)/.*\\.(md|txt|rst)$') THEN 80 ELSE 0 END + CASE WHEN contains(path, 'generated') THEN 150 ELSE 0 END AS prose,
  CASE WHEN path LIKE '%.test.%' OR path LIKE '%.spec.%' OR contains(path, '__tests__/') THEN 120 ELSE 0 END AS test
FROM (SELECT *, lower(CASE WHEN regexp_matches(b, '^.+\\.[^.]*$') THEN regexp_replace(b, '\\.[^.]*$', '') ELSE b END) AS s FROM (SELECT *, {_BASE} AS b FROM named))""",
)
def score_terms(spark, sf_dir):
    p = F.col("path")
    return named(spark, sf_dir).select(
        "doc_id", rank.fixture_penalty(p).alias("fixture"), rank.vendor_penalty(p).alias("vendor"), rank.scope_proximity(p).alias("proximity"), rank.basename_boost(p, "app").alias("basename"),
        rank.prose_penalty(p).alias("prose"), rank.test_penalty(p, "app").alias("test"),
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_search(spark, sf_dir)


_SPEC = "CASE doc_id % 8 WHEN 0 THEN path || ':' || doc_id WHEN 1 THEN path || '#' || doc_id || '-' || (doc_id + 5) WHEN 2 THEN path || '#' || doc_id WHEN 3 THEN path || '###Title' WHEN 4 THEN path || '#words here' WHEN 5 THEN path || '#symbol' WHEN 6 THEN 'name:' || doc_id ELSE path END"


@query(
    "target_specs",
    f"""WITH {NAMES_SQL}, q AS (SELECT doc_id, {_SPEC} AS q FROM named)
SELECT doc_id, nullif(regexp_extract(q, '^(.*[/.].*):([0-9]+)$', 1), '') AS path, CAST(nullif(regexp_extract(q, '^(.*[/.].*):([0-9]+)$', 2), '') AS BIGINT) AS line,
  CASE WHEN NOT contains(q, '#') THEN NULL ELSE ([NULL, 'range', 'line', 'heading', 'words', 'symbol'])[1 + doc_id % 8] END AS suffix FROM q""",
)
def target_specs(spark, sf_dir):
    d, p = F.col("doc_id"), F.col("path")
    made = F.concat(p, F.element_at(F.array(
        F.concat(F.lit(":"), d.cast("string")), F.concat(F.lit("#"), d.cast("string"), F.lit("-"), (d + 5).cast("string")), F.concat(F.lit("#"), d.cast("string")), F.lit("###Title"), F.lit("#words here"), F.lit("#symbol"), F.lit(""), F.lit(""),
    ), (d % 8 + 1).cast("int")))
    own = named(spark, sf_dir).select("doc_id", F.when(d % 8 == 6, F.concat(F.lit("name:"), d.cast("string"))).otherwise(made).alias("q"))
    return own.select("doc_id", queries.target_spec(F.col("q")).alias("t"), queries.section_suffix(F.col("q")).alias("suffix")).select("doc_id", "t.path", "t.line", "suffix")


@query("pattern_list", f"{BASE}, g AS (SELECT path, size FROM files WHERE regexp_matches(path, '^[^/]*/de/[^/]*7\\.txt$') OR regexp_matches(path, '(^|/)[^/]*00\\.txt$')) SELECT path, size, (SELECT count(*) FROM g) AS total_found FROM g ORDER BY path LIMIT 20")
def pattern_list(spark, sf_dir):
    return search.glob_files(files(spark, sf_dir), "*/de/*7.txt", "*00.txt", depth=3)


@query("folder_list", f"{BASE}, e AS (SELECT regexp_extract(path, '^[^/]*') || '/' AS entry, size FROM files) SELECT entry, CAST(ceil(sum(size) / 4) AS BIGINT) AS tokens FROM e GROUP BY entry")
def folder_list(spark, sf_dir):
    return views.directory_listing(files(spark, sf_dir), "")


@query("stem_file", f"{BASE} SELECT path, 3 AS priority FROM files WHERE doc_id = 42")
def stem_file(spark, sf_dir):
    return search.basename_file(files(spark, sf_dir), "42")


@query("binary_files", "SELECT doc_id, doc_id % 3 = 0 AS is_binary FROM documents")
def binary_files(spark, sf_dir):
    data = F.concat(F.coalesce("text", F.lit("")).cast("binary"), F.lit("").cast("binary"))
    zero = F.concat(F.unhex(F.lit("610062")), data)
    return documents(spark, sf_dir).select("doc_id", text.is_binary(F.when(F.col("doc_id") % 3 == 0, zero).otherwise(data)).alias("is_binary"))


@query("seen_literals", f"{BASE} SELECT bool_or(contains(content, 'tion')) AS seen FROM files")
def seen_literals(spark, sf_dir):
    return search.seen_anywhere(files(spark, sf_dir), "tion")


@query("kept_gaps", f"""{BASE}, k AS (SELECT path, line FROM lines WHERE contains(text, 'tion')) SELECT path, line, CAST(CASE WHEN line - lag(line) OVER w > 4 THEN line - lag(line) OVER w - 1 END AS INTEGER) AS gap FROM k WINDOW w AS (PARTITION BY path ORDER BY line)""")
def kept_gaps(spark, sf_dir):
    return views.gaps(doc_lines(spark, sf_dir).where(F.col("text").contains("tion")).select("path", "line")).select("path", "line", "gap")


@query("meta_headers", f"""{BASE} SELECT path, '{{"tokens":' || CAST(ceil(size / 4) AS BIGINT) || ',"if_modified_since":"' || strftime(mtime, '%Y-%m-%dT%H:%M:%SZ') || '"}}' || chr(10) || chr(10) || content AS text FROM files""")
def meta_headers(spark, sf_dir):
    own = files(spark, sf_dir)
    return own.select("path", text.with_meta({"tokens": text.tokens(F.col("content"))}, F.col("content"), F.col("mtime")).alias("text"))


@query("heading_suggestions", f"{BASE}, m AS (SELECT DISTINCT 'Part ' || doc_id % 40 AS title FROM files) SELECT title, levenshtein(lower(title), 'port 12') AS distance FROM m ORDER BY distance, title LIMIT 5")
def heading_suggestions(spark, sf_dir):
    own = files(spark, sf_dir).select("path", F.concat(F.lit("# Part "), (F.col("doc_id") % 40).cast("string"), F.lit("\n")).alias("content"))
    return search.suggested_headings(own, "port 12")


@query(
    "section_scopes",
    f"""{BASE}, m AS (SELECT path, doc_id, line, {_HEADED} AS text FROM lines), f AS (SELECT *, coalesce(sum(CASE WHEN text = '```' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS fenced,
  max(CASE WHEN trim(text) <> '' THEN line END) OVER (PARTITION BY path) AS last FROM m),
h AS (SELECT path, line, length(regexp_extract(text, '^#+')) AS level, last FROM f WHERE NOT fenced AND regexp_matches(text, '^#{{1,6}}(\\s|$)')),
s AS (SELECT a.path, a.line, coalesce(min(b.line) - 1, greatest(any_value(a.last), a.line)) AS past FROM h a LEFT JOIN h b ON a.path = b.path AND b.line > a.line AND b.level <= a.level GROUP BY a.path, a.line, a.level)
SELECT m.path, m.line, count(s.line) AS depth FROM (SELECT path, line FROM m WHERE contains(text, 'an')) m LEFT JOIN s ON s.path = m.path AND m.line BETWEEN s.line AND s.past GROUP BY ALL HAVING count(s.line) > 0""".replace("count(s.line) AS depth", "max(s.line) AS heading_line"),
)
def section_scopes(spark, sf_dir):
    """Lines with the heading of the section that they are in; a title here is its line's number."""
    own = headed_files(spark, sf_dir)
    hits = text.lines(own, "path").where(F.col("text").contains("an")).select("path", "line")
    spans = search.headings(own).select("path", F.col("line").alias("first"), F.col("end_line").alias("last"), F.col("line").cast("string").alias("title"))
    inner = graph.in_spans(hits, spans).groupBy("path", "line").agg(F.max(F.col("title").cast("int")).alias("heading_line"))
    return inner


@query(
    "edited_texts",
    r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (SELECT *, string_split(t, chr(10)) AS p FROM d), n AS (SELECT *, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS q FROM s)
SELECT doc_id, CASE WHEN len(q) < 1 THEN t ELSE array_to_string(list_concat(['top', 'new'], list_concat(q[2:], ['end'])), chr(10)) || CASE WHEN p[len(p)] = '' THEN chr(10) ELSE '' END END AS content, len(q) < 1 AS failed FROM n""",
)
def edited_texts(spark, sf_dir):
    """Each text with its first line replaced and one added at either end."""
    section = "@ x\nreplace 1\n+ new\nprepend\n+ top\nappend\n+ end"
    own = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("content"), F.lit(section).alias("section"), F.lit(None).cast("string").alias("recorded"))
    return edit.apply_edits(own).select(F.col("path").cast("long").alias("doc_id"), "content", F.col("error").isNotNull().alias("failed"))


@query("cut_texts", "SELECT doc_id, (list_filter([left(text, i) FOR i IN range(0, 101)], lambda x: strlen(x) <= 100))[-1] AS head FROM documents")
def cut_texts(spark, sf_dir):
    from loamline.engine import register_functions

    register_functions(spark)
    return documents(spark, sf_dir).select("doc_id", F.call_function("truncate_bytes", F.col("text"), F.lit(100)).alias("head"))


@query("ignored_paths", f"""WITH {NAMES_SQL}, p AS (SELECT DISTINCT path FROM named) SELECT path, regexp_matches(path, '(^|/)[^/]*\\.md$') OR regexp_matches(path, '^web/') AND NOT regexp_matches(path, '^web/app[^/]*$') OR starts_with(path, 'conf/') AND path <> 'conf/app.yaml' AS ignored FROM p""")
def ignored_paths(spark, sf_dir):
    rules = [("", 0, "*.md", True), ("", 1, "web", True), ("web", 0, "app*", False), ("", 2, "/conf".removeprefix("/"), True), ("conf", 0, "app.yaml", False)]
    return ignored(named(spark, sf_dir).select("path").distinct(), rules).select("path", "ignored")


@query("json_outlines", "SELECT 'e' || event_id || '.json' AS path, 'k: ' || json_extract_string(props, '$.k') || ' (int)' AS outline FROM events")
def json_outlines(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"), F.col("props").alias("content"))
    return views.structured_outline(own).select("path", F.array_join("outline", "\n").alias("outline"))


@query(
    "yaml_outlines",
    """SELECT 'c' || c_custkey || '.yaml' AS path, line, level, key FROM customer, (VALUES (1, 0, 'name'), (2, 0, 'place'), (3, 1, 'nation'), (4, 1, 'segment'), (6, 2, 'deep')) x(line, level, key)""",
)
def yaml_outlines(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    content = F.format_string("name: %s\nplace:\n  nation: %d\n  segment: %s\n  # note: none\n    deep: 1\n      deeper: 2\n", "c_name", "c_nationkey", "c_mktsegment")
    own = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".yaml")).alias("path"), content.alias("content"))
    return views.yaml_outline(own)


@query("test_outlines", """SELECT 's' || s_suppkey || '.test.ts' AS path, line, level, kind, CASE kind WHEN 'describe' THEN s_name ELSE 'works ' || s_nationkey END AS name FROM supplier, (VALUES (1, 0, 'describe'), (2, 1, 'it'), (5, 1, 'test')) x(line, level, kind)""")
def test_outlines(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    content = F.format_string("describe('%s', () => {\n  it('works %d', () => {\n    run('it(')\n  })\n  test.only(\"works %d\", f)\n})\n", "s_name", "s_nationkey", "s_nationkey")
    return views.test_outline(own.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".test.ts")).alias("path"), content.alias("content")))


@query("age_labels", """SELECT event_id, CASE WHEN s >= 31536000 THEN s // 31536000 || 'y ago' WHEN s >= 604800 THEN s // 604800 || 'w ago' WHEN s >= 86400 THEN s // 86400 || 'd ago' WHEN s >= 3600 THEN s // 3600 || 'h ago' WHEN s >= 60 THEN s // 60 || 'm ago' ELSE 'just now' END AS label
FROM (SELECT event_id, (event_id * event_id * 37) % 100000000 AS s FROM events)""")
def age_labels(spark, sf_dir):
    n = F.col("event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", diff.age_label((n * n * 37) % 100_000_000).alias("label"))


@query("expanded_hits", _rank_sql("SELECT path, line, row_number() OVER (PARTITION BY path ORDER BY score DESC, line) = 1 AND path IN (SELECT path FROM (SELECT path, max(score) AS best FROM s GROUP BY path ORDER BY best DESC, path LIMIT 5)) AS expand FROM s", "and the", "contains(text, 'and the')", False))
def expanded_hits(spark, sf_dir):
    hits = search.ranked(search.content_hits(files(spark, sf_dir), "and the"), "and the", F.lit(AS_OF).cast("timestamp"))
    return search.expanded(hits, 5).select("path", "line", "expand")


@query("read_files", f"{BASE} SELECT CAST(ord AS INTEGER) AS ord, w.path, f.path IS NOT NULL AS found, CASE WHEN f.path IS NOT NULL AND f.size > 0 THEN content END AS body FROM (SELECT 1 AS ord, 'gone.txt' AS path UNION ALL SELECT 2, path FROM files WHERE doc_id = 7 UNION ALL SELECT 3, path FROM files WHERE doc_id = 11) w LEFT JOIN files f USING (path)")
def read_files(spark, sf_dir):
    own = files(spark, sf_dir)
    wanted = own.where("doc_id IN (7, 11)").select(F.when(F.col("doc_id") == 7, 2).otherwise(3).alias("ord"), "path").union(spark.createDataFrame([(1, "gone.txt")], "ord int, path string"))
    return views.read_many(own, wanted, 3_000_000).select("ord", "path", "found", "body")
