"""Shared folder, cut lineage, and vectorised word splitting for Arrow batches."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 4 << 20
TIDY_BYTES = 160 << 20
BATCH_BYTES = 16 << 20


def resident_bytes() -> int:
    """Memory of this process, 0 where the system does not tell."""
    if not os.path.exists("/proc/self/statm"):
        return 0
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")


def tidy(run):
    """``run`` of a mapInArrow, after which the worker, which later tasks use again, gives free memory back to the system."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            if resident_bytes() > TIDY_BYTES:
                pa.default_memory_pool().release_unused()
                if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                    trim(0)

    return tidied


def bounded_batches(spark: SparkSession) -> None:
    """Let batches that go to Python workers hold ``BATCH_BYTES`` at most, on both sides, unless the session asks for less."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (spark.conf.get(name, None) or "").rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; where it is unset, one of our own on a local master, else an error.

    Also turns off a setting of Spark 4.1 under which a repartition of a union is dropped when adaptive execution has
    coalesced both sides to one partition, so that rows of one key reach two tasks, and bounds batches."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    bounded_batches(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="loamline-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints of rounds that are over, rather than when memory next runs short."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a Parquet table in the shared folder and read it back, so that later stages prune its columns."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**{"compression": "zstd", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES):
    """Slices of a batch whose texts hold about ``limit`` bytes each; a longer text comes alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        base = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def ragged(lists: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code of each item, dictionary of items, offsets of each list in the codes)."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    return flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary, offsets - offsets[0]


def words(texts: pa.Array, lower: bool = False, split=pc.utf8_split_whitespace) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words between Unicode white space (or what ``split`` cuts at), as ``ragged``; null counts as empty text."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.utf8_lower(texts)
    codes, names, offsets = ragged(split(texts))
    blank = pc.index(names, "").as_py()
    if blank >= 0:  # white space at an edge of a text gives empty words
        keep = codes != blank
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return codes, names, offsets


def word_hashes(names: pa.Array) -> np.ndarray:
    """64-bit hash of each dictionary word, the same in every process."""
    values = names.to_numpy(zero_copy_only=False)
    return pd.util.hash_array(values.astype(object)) if len(values) else np.zeros(0, np.uint64)


MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit multiplicative hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive hashes (mod 2**64); entry i covers i..i+n-1, and there are len-n+1 of them."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out *= MIX
        out += hashes[k : k + count]
    return mix(out)
