"""Token counts from flat token files: ids one after another, each document ended by one identifier, and no index.

Files are read in blocks. Each block is searched for the identifier in one vectorised comparison; a prefix scan over the
blocks' last hits and counts tells every block which document it begins in and where that document began.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.common import cut, fresh_path, slices, stash, tidy
from loamline.llm.tokens import tokenizer
from loamline.llm.warc import open_folder

BLOCK_IDS = 2 << 20
SCAN_GROUP = 1024  #: blocks that one step of the prefix scan takes together
FILE_BYTES = 1 << 30
FILE_DOCS = 1 << 20  #: so many documents end a file too: their ids are one row of the listing


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, dtype: str = "<u2") -> DataFrame:
    """Write ``docs`` (doc_id, text) as flat files of ``dtype`` ids; returns (path, ids, doc_ids: in the order of the file).

    Null or empty text is the end identifier alone; null ids stay null; rows that repeat are written each. Strings of
    special tokens in texts are ordinary text, so no text can hold the end identifier. Files of failed attempts are never
    listed."""
    folder = folder or fresh_path(docs.sparkSession, "tokens")

    def write(batches):
        encode = tokenizer(tokenizer_path, plain=True).encode
        fs, base = open_folder(folder)
        out, name, count, ids_of = None, "", 0, []

        def row():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([count]), pa.array([ids_of], pa.list_(pa.int64()))], ["path", "ids", "doc_ids"])

        for batch in batches:
            for some in slices(batch, "text"):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    name, count, ids_of = f"{uuid.uuid4().hex}.ids", 0, []
                    out = fs.open_output_stream(f"{base}/{name}")
                ids, offsets = encode(some.column("text"))
                if len(ids) and int(ids.max()) > np.iinfo(dtype).max:
                    raise ValueError("an id does not fit the file's type")
                ended = np.insert(ids, offsets[1:], end_id).astype(dtype)
                out.write(ended.tobytes())
                count += len(ended)
                ids_of += some.column("doc_id").to_pylist()
                if count * np.dtype(dtype).itemsize >= FILE_BYTES or len(ids_of) >= FILE_DOCS:
                    yield row()
                    out = None
        if out is not None:
            yield row()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stash(source.mapInArrow(tidy(write), "path string, ids long, doc_ids array<long>"), "token-files")


HITS = "path string, block long, hits array<long>, n long, last long"


def scan(files: DataFrame, end_id: int, dtype: str = "<u2", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Documents of flat token ``files`` (path, ids): (path, ordinal, start, n_tokens, closed), n_tokens without the end.

    Ids after a file's last end identifier are a document that is not closed; an empty file has none. Equal paths are read
    once. Only end identifiers and a row per block leave the scan."""

    def search(batches):
        for batch in batches:
            for path, block, ids in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "ids")), strict=True):
                fs, name = open_folder(path)
                size = np.dtype(dtype).itemsize
                with fs.open_input_file(name) as stream:
                    stream.seek(block * block_ids * size)
                    data = stream.read(min(block_ids, ids - block * block_ids) * size)
                hits = np.flatnonzero(np.frombuffer(data, dtype) == end_id) + block * block_ids
                last = pa.array([int(hits[-1]) if len(hits) else None], pa.int64())
                arrays = [pa.array([path]), pa.array([block]), pa.array([hits], pa.list_(pa.int64())), pa.array([len(hits)]), last]
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in HITS.split(", ")])

    files = files.groupBy("path").agg(F.max("ids").alias("ids"))
    blocks = files.where("ids > 0").select("path", "ids", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("ids") - 1) / block_ids))).alias("block"))
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stash(blocks.repartition(parts, "path", "block").mapInArrow(tidy(search), HITS), "hits")
    # the prefix scan, in two steps so that a file of any length is never one group: within groups of blocks, then over groups
    at = found.select("path", "block", "n", "last", F.floor(F.col("block") / SCAN_GROUP).alias("group"))
    totals = at.groupBy("path", "group").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    earlier = Window.partitionBy("path").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = totals.select("path", "group", F.sum("n").over(earlier).alias("group_n"), F.max("last").over(earlier).alias("group_last"))
    within = Window.partitionBy("path", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    at = at.select("path", "block", "group", F.sum("n").over(within).alias("own_n"), F.max("last").over(within).alias("own_last"))
    zero, none = F.lit(0).cast("long"), F.lit(-1).cast("long")
    carried = at.join(groups, ["path", "group"]).select(
        "path", "block", (F.coalesce("own_n", zero) + F.coalesce("group_n", zero)).alias("before"),
        (F.coalesce("own_last", "group_last", none) + 1).alias("begun"),
    )
    joined = found.select("path", "block", "hits").join(carried, ["path", "block"])

    def document(hit, k):
        start = F.when(k == 0, F.col("begun")).otherwise(F.col("hits")[k - 1] + 1)
        return F.struct((F.col("before") + k).alias("ordinal"), start.alias("start"), (hit - start).alias("n_tokens"))

    closed = joined.select("path", F.explode(F.transform("hits", document)).alias("d")).select("path", "d.*", F.lit(True).alias("closed"))
    ends = files.join(totals.groupBy("path").agg(F.sum("n").alias("n"), F.max("last").alias("last")), "path")
    start = F.coalesce("last", none) + 1
    opened = ends.select("path", F.col("n").alias("ordinal"), start.alias("start"), (F.col("ids") - start).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.union(opened.where("n_tokens > 0"))


def token_counts(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens) of each row of ``docs`` (doc_id, text), by way of flat token files; other columns are ignored."""
    files = write_token_files(docs, tokenizer_path, end_id)
    found = scan(files.select("path", "ids"), end_id)
    order = files.select("path", F.posexplode("doc_ids").alias("ordinal", "doc_id"))
    return order.withColumn("ordinal", F.col("ordinal").cast("long")).join(found, ["path", "ordinal"]).select("doc_id", "n_tokens")
