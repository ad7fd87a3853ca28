"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm import bytebpe, chat, decontaminate, html, langid, lexical, minhash, neighbours, packing, suffixes, tokencount, variants, warc

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


END_OF_TEXT = 49407


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, from flat token files."""
    return tokencount.token_counts(table(spark, sf_dir, "documents"), WORD_BPE, END_OF_TEXT)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of all pages."""
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "text")


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 ids."""
    out = packing.pack(table(spark, sf_dir, "documents"), WORD_BPE)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


CONTROL = r"\### Assistant: </turn> ok"


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents, a row per passage, with how many of its words are not the first occurrence."""
    found = suffixes.repeated_spans(table(spark, sf_dir, "documents"))
    rows = found.select("doc_id", "cuts", F.explode("spans").alias("span"))
    shared = F.transform("cuts", lambda c: F.greatest(F.least(c["past"], F.col("span.past")) - F.greatest(c["first"], F.col("span.first")), F.lit(0)))
    words = F.aggregate(shared, F.lit(0), lambda a, x: a + x)
    return rows.select("doc_id", F.col("span.first").alias("first_word"), F.col("span.past").alias("past_word"), words.alias("later_words"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in all documents, with their edit distances and places."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one with control strings in its texts; digests of what is read back."""
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.render(chat.reconstruct(chat.table_events(rows)))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["text"]))
    out = out.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), F.array_join(loss, "").alias("loss"))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as archives and read the archives back."""
    out = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")), payloads=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL_CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, length(role || text) + 20 + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(regexp_replace(text, '[^\\#<]', '', 'g')) AS n
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

SQL_WARC = """
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), firsts AS (
  SELECT payload, min(page_id) AS first_id FROM rows GROUP BY payload
), digests AS (
  SELECT payload, first_id, sha1(payload) AS hex FROM firsts
), named AS (
  SELECT payload, first_id, translate(array_to_string(list_transform(range(8), lambda i:
    lpad(to_base(CAST('0x' || substr(hex, 1 + 5 * CAST(i AS INTEGER), 5) AS BIGINT), 32), 4, '0')), ''),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
  FROM digests
)
SELECT page_id, CAST(strlen(rows.payload) AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM rows JOIN named ON rows.payload = named.payload
"""

def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def held_out():
    """Rows that the model may not learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of all documents by a model of those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return langid.label(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return minhash.similarity_join(table(spark, sf_dir, "documents")).drop("node", "stays")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents that rank highest for each benchmark item."""
    return lexical.search(lexical.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


SQL_LEXICAL = r"""
WITH terms AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM documents
), postings AS (
  SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term
), sizes AS (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY doc_id
), totals AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes
), held AS (
  SELECT term, count(*) AS df FROM postings GROUP BY term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM held, totals
), asked AS (
  SELECT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM benchmark
), repeats AS (
  SELECT item_id, term, count(*) AS r FROM asked GROUP BY item_id, term
), scores AS (
  SELECT item_id, doc_id, CAST(sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM repeats JOIN weights USING (term) JOIN postings USING (term) JOIN sizes USING (doc_id), totals
  GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents, with one word of 97 misspelled by checksum."""
    return variants.variants(variants.word_counts(table(spark, sf_dir, "documents"), slip_one_in=97))


SQL_VARIANTS = """
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), pairs AS (
  SELECT run, count(*) AS c, encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS raw FROM runs GROUP BY doc_id, run
), bits AS (
  SELECT run, c, list_transform(range(8 * octet_length(raw)), lambda k:
    CASE WHEN k % 8 = 0 THEN CAST('0x' || substr(hex(raw), CAST(k // 4 + 1 AS INTEGER), 2) AS BIGINT) ELSE 0 END) AS steps
  FROM pairs
), sums AS (
  SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295, steps), lambda x, b:
    xor(xor(x, b) >> 1, 3988292384 * (xor(x, b) & 1)))) AS h
  FROM bits
), slipped AS (
  SELECT c, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM sums
), words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM slipped GROUP BY word HAVING sum(c) >= 3 AND length(word) >= 5
), cuts AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), way AS (
  SELECT word, coalesce(form, word) AS at FROM forms
  UNION ALL SELECT way.word, f.form FROM way JOIN forms f ON f.word = way.at WHERE f.form IS NOT NULL AND way.word <> way.at
), ends AS (
  SELECT way.word, way.at AS root FROM way JOIN forms f ON f.word = way.at WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level ids of all documents and the bytes that they decode to, as digests."""
    rows = bytebpe.decode(bytebpe.encode(table(spark, sf_dir, "documents"), BYTE_RANKS), BYTE_RANKS)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_token_counts": op1_token_counts, "op2_html_text": op2_html_text, "op3_pack": op3_pack, "op4_neighbours": op4_neighbours, "op5_langid": op5_langid, "op6_suffix_dedup": op6_suffix_dedup, "op7_decontaminate": op7_decontaminate,
    "op8_chat": op8_chat,     "op9_jaccard_join": op9_jaccard_join, "op10_warc": op10_warc,
    "op11_lexical": op11_lexical, "op12_variants": op12_variants, "op13_byte_bpe": op13_byte_bpe,
}
SQL: dict[str, str] = {"op8_chat": SQL_CHAT, "op10_warc": SQL_WARC, "op11_lexical": SQL_LEXICAL, "op12_variants": SQL_VARIANTS}
