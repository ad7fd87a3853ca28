"""Queries of the version store and of edits on stale versions, over texts made from the keys and lengths of ``documents``, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.operators import versions

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return register


def _events(rows: DataFrame, **columns: Column) -> DataFrame:
    """Events with the given columns, others null."""
    kinds = dict(c.split() for c in versions.EVENT.split(", "))
    return rows.select(*[columns.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in kinds.items()])


@query(
    "version_log",
    """WITH e AS (SELECT doc_id % 97 AS session, doc_id AS seq, doc_id % 3 AS path, doc_id % 5 AS seen, 5 + length(doc_id::VARCHAR) + 4 * (doc_id % 5) AS weight FROM documents),
w AS (SELECT *, least(row_number() OVER p, 4) AS versions, 1 + sum(weight) OVER (PARTITION BY session, path ORDER BY seq ROWS 3 PRECEDING) AS own FROM e WINDOW p AS (PARTITION BY session, path ORDER BY seq)),
l AS (SELECT *, last_value(CASE WHEN path = 0 THEN own END IGNORE NULLS) OVER s AS a, last_value(CASE WHEN path = 1 THEN own END IGNORE NULLS) OVER s AS b, last_value(CASE WHEN path = 2 THEN own END IGNORE NULLS) OVER s AS c
  FROM w WINDOW s AS (PARTITION BY session ORDER BY seq))
SELECT session::VARCHAR AS session, seq, 'p' || path AS path, versions::INTEGER AS versions, seen::INTEGER AS seen, ((a IS NOT NULL)::INTEGER + (b IS NOT NULL)::INTEGER + (c IS NOT NULL)::INTEGER)::INTEGER AS paths,
  (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0))::BIGINT AS bytes FROM l""",
)
def version_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session's store holds after each of its records of three paths."""
    doc = F.col("doc_id")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    lines = F.when(doc % 5 > 0, F.sequence(F.lit(1), (doc % 5).cast("int"))).otherwise(F.array().cast("array<int>"))
    events = _events(rows, session=doc % 97, seq=doc, kind=F.lit("record"), path=F.concat(F.lit("p"), (doc % 3).cast("string")), text=F.concat(F.lit("text "), doc.cast("string")), lines=lines)
    return versions.replay(events).select("session", "seq", "path", "versions", "seen", "paths", "bytes")


_TEXT = "list_transform(range(1, n + 1), lambda i: CASE WHEN {0} THEN '{1}' ELSE 'l' || i || ' of ' || doc_id END)"


@query(
    "edit_recovery",
    f"""WITH d AS (SELECT doc_id, doc_id % 7 AS way, n_chars % 30 + 10 AS n FROM documents), e AS (SELECT *, doc_id % (n - 4) + 3 AS m FROM d),
t AS (SELECT doc_id, way, array_to_string({_TEXT.format("false", "")}, chr(10)) AS plain, array_to_string({_TEXT.format("i = m", "NEW")}, chr(10)) AS swapped,
  array_to_string({_TEXT.format("i = m", "NEW").replace("CASE", "CASE WHEN i = m - 1 THEN 'MOD'")}, chr(10)) AS twice, array_to_string({_TEXT.format("true", "other")}, chr(10)) AS other FROM e)
SELECT doc_id, CASE way WHEN 0 THEN 'applied' WHEN 1 THEN 'unseen' WHEN 2 THEN 'merged' WHEN 3 THEN 'drift' WHEN 4 THEN 'fabricated' WHEN 5 THEN 'replayed' ELSE 'drift' END AS outcome,
  CASE way WHEN 0 THEN swapped WHEN 2 THEN 'top' || chr(10) || swapped WHEN 3 THEN other WHEN 5 THEN twice ELSE plain END AS content FROM t""",
)
def edit_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit of each document's lines that names a version by its tag: as it is, with the line not shown, moved, changed all over, with a tag that
    was never given, on an older version, or with the tag of another path."""
    doc, way = F.col("doc_id"), F.col("doc_id") % 7
    own = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.col("n_chars") % 30 + 10).cast("int").alias("n"))
    own = own.withColumn("m", (doc % (F.col("n") - 4) + 3).cast("int"))

    def text(*swaps: tuple[Column, str]) -> Column:
        def line(i: Column) -> Column:
            out = F.concat(F.lit("l"), i.cast("string"), F.lit(" of "), doc.cast("string"))
            for when, new in swaps:
                out = F.when(i == when, new).otherwise(out)
            return out

        return F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), line), "\n")

    plain, second = text(), text((F.col("m") - 1, "MOD"))
    session = doc.cast("string")
    shown = F.sequence(F.lit(1), F.when(way == 1, F.col("m") - 1).otherwise(F.col("m")))
    kind = F.lit("record")
    events = _events(own, session=session, seq=F.lit(1), kind=kind, path=F.lit("a"), text=plain, lines=shown)
    events = events.unionByName(_events(own.where(way == 5), session=session, seq=F.lit(2), kind=kind, path=F.lit("a"), text=second))
    events = events.unionByName(_events(own.where(way == 6), session=session, seq=F.lit(3), kind=kind, path=F.lit("b"), text=F.concat(F.lit("other "), session)))
    held = versions.current(events)
    tags = held.where("path = 'b' OR recorded_at = 1").groupBy("session").agg(F.max_by("tag", "path").alias("tag"))
    asked = own.withColumn("session", session).join(tags, "session")
    # a tag that was never given is that of the session with its last digit changed
    never = F.concat(F.substring("tag", 1, 3), F.when(F.substring("tag", 4, 1) == "0", "1").otherwise("0"))
    named = F.when(way == 4, never).otherwise(F.col("tag"))
    live = F.when(way == 2, F.concat(F.lit("top\n"), plain)).when(way == 3, F.regexp_replace(plain, "[^\n]+", "other")).when(way == 5, second).otherwise(plain)
    section = F.concat(F.lit("@ a #"), named, F.lit("\nreplace "), F.col("m").cast("string"), F.lit("\n+ NEW"))
    edits = asked.select(doc.alias("edit_id"), "session", F.lit("a").alias("path"), section.alias("section"), live.alias("content"))
    return versions.recover(edits, held).select(F.col("edit_id").alias("doc_id"), "outcome", "content")
