"""A training-data pipeline over ``documents``; each stage's rows are written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm import decontaminate, langid, minhash, packing, suffixes
from loamline.llm.common import stash
from loamline.llm.queries import WORD_BPE, held_out


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: texts without a language, or without one for half of their letters, go."""
    model = langid.fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return langid.keep_identified(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each class of near copies, the document with the least id stays."""
    return minhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: passages of 50 words or more that occur again are cut from all but their first place."""
    out = suffixes.remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def without_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a passage near a benchmark item go."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing by minimum bin slack: pieces of the documents in sequences of 2048 ids."""
    out = packing.pack(docs, WORD_BPE)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language ID", identify),
    ("n-gram Jaccard join", one_of_each),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", without_items),
    ("packing", pack),
]

#: No stage is expressible in SQL as a whole; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each on the written rows of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stash(docs, "stage")
    return docs
