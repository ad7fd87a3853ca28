"""Bloom filters of the identifiers in each file, as rows that tell which files a search for a name need not look into.

A filter is a set of bitmaps of ``BITS`` bits. A file's identifiers are dealt over as many bitmaps as keep a share of about one in a hundred
wrong answers, so a file of any size has a filter. Every maximal run of A-Z, a-z, 0-9 and _ that begins with no digit counts, in comments and
strings too, as a search for whole words finds it there: a name that is in a file is never denied."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS, HASHES = 32768, 7  #: a bitmap takes 4 KB; seven bits for each identifier
PER_BITMAP = 3400  #: identifiers of a bitmap, 9.6 bits for each
SEED = 42  #: of F.xxhash64
OUT_ROWS = 1 << 10  #: bitmaps that are held before they leave a task
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"


def _bitmap(name: Column, bitmaps: Column) -> Column:
    return F.pmod(F.xxhash64(name, F.lit(-1)), bitmaps).cast("int")


def _bits(name: Column) -> Column:
    return F.array(*[F.pmod(F.xxhash64(name, F.lit(k)), F.lit(BITS)) for k in range(HASHES)])


def _hashes(names: np.ndarray, last: int) -> np.ndarray:
    """``F.xxhash64(name, F.lit(last))`` of names that are given by the hash of the name alone."""
    one, two, three, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    x = (names + five + np.uint64(4)) ^ (np.uint64(last & 0xFFFFFFFF) * one)
    x = ((x << np.uint64(23)) | (x >> np.uint64(41))) * two + three
    x = (x ^ (x >> np.uint64(33))) * two
    x = (x ^ (x >> np.uint64(29))) * three
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _bitmaps(content: str | None) -> tuple[int, list[tuple[int, bytes]]]:
    """How many bitmaps a content has, and those with a bit."""
    found = {*re.findall(IDENTIFIER, content or "")}
    if not found:
        return 1, [(0, bytes(BITS // 8))]
    with np.errstate(over="ignore"):
        names = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in found), np.uint64, len(found))
        count = -(-len(found) // PER_BITMAP)
        bitmap = _hashes(names, -1) % count
        places = np.stack([_hashes(names, k) % BITS for k in range(HASHES)], axis=1)
    out = []
    for k in np.unique(bitmap).tolist():
        bits = np.zeros(BITS, bool)
        bits[places[bitmap == k]] = True
        out.append((k, np.packbits(bits, bitorder="little").tobytes()))
    return count, out


def identifier_filters(files: DataFrame) -> DataFrame:
    """(path, mtime, bitmaps, bitmap, bits) of ``files`` (path, mtime, content): one row for each bitmap that has a bit.

    A row's bits are set where it is read, so that no identifier is shuffled or sorted; an aggregate unites rows of one path and time. A null
    content, and one without identifiers, has one empty bitmap."""
    own = files.select("path", "mtime", "content")
    kinds = {"bitmaps": pa.int32(), "bitmap": pa.int32(), "bits": pa.binary()}

    def run(batches):
        for batch in batches:
            rows: list[tuple[int, int, int, bytes]] = []
            for at, content in enumerate(batch.column("content")):
                count, found = _bitmaps(content.as_py())
                rows += [(at, count, k, bits) for k, bits in found]
                if len(rows) >= OUT_ROWS or at == batch.num_rows - 1:
                    places, *columns = zip(*rows, strict=True)
                    keys = [batch.column(c).take(pa.array(places)) for c in ("path", "mtime")]
                    yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True))], names=["path", "mtime", *kinds])
                    rows = []

    schema = T.StructType([own.schema["path"], own.schema["mtime"], T.StructField("bitmaps", T.IntegerType()), T.StructField("bitmap", T.IntegerType()), T.StructField("bits", T.BinaryType())])
    return own.mapInArrow(run, schema).groupBy("path", "mtime", "bitmaps", "bitmap").agg(F.bitmap_or_agg("bits").alias("bits"))


def merged(filters: DataFrame, *keys: str) -> DataFrame:
    """One filter for the files of each group, such as a folder; for files of one bitmap, others are kept as they are."""
    return filters.where("bitmaps = 1").groupBy(*keys).agg(F.bitmap_or_agg("bits").alias("bits"))


def _has(bits: Column, name: Column) -> Column:
    def bit(at: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))), F.lit(2)) == 1

    return F.forall(_bits(name), bit)


def may_hold(filters: DataFrame, name: str) -> DataFrame:
    """(path, mtime, may) of filtered files: false only where the file does not have the identifier."""
    value = F.lit(name)
    has = (_bitmap(value, F.col("bitmaps")) == F.col("bitmap")) & _has(F.col("bits"), value)  # a bitmap without a bit has no row
    return filters.groupBy("path", "mtime").agg(F.bool_or(has).alias("may"))


def narrowed(files: DataFrame, filters: DataFrame, name: str) -> DataFrame:
    """The files that a search for a name has to look into: all but those whose filter, of the same modification time, denies it.

    A name that is no identifier narrows nothing."""
    if not re.fullmatch(IDENTIFIER, name):
        return files
    denied = may_hold(filters, name).where(~F.col("may")).select("path", F.col("mtime").alias("_mtime"))
    return files.join(denied, (files["path"] == denied["path"]) & files["mtime"].eqNullSafe(denied["_mtime"]), "left_anti")


def misses(files: DataFrame, filters: DataFrame, names: DataFrame) -> DataFrame:
    """(name, files, held, passed, wrong) of ``names`` (name): how many files there are, have it, pass their filter, and pass without having it.

    Names are a stated list, and each is set against every filter."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(IDENTIFIER), F.lit(0)))
    holds = files.select("path", "mtime", F.explode(found).alias("name")).join(F.broadcast(names), "name").withColumn("holds", F.lit(True))
    pairs = filters.join(F.broadcast(names), _bitmap(F.col("name"), F.col("bitmaps")) == F.col("bitmap"))
    passed = pairs.where(_has(F.col("bits"), F.col("name"))).select("path", "mtime", "name", F.lit(True).alias("passes"))
    both = passed.join(holds, ["path", "mtime", "name"], "full").groupBy("name").agg(
        F.count_if("holds").alias("held"), F.count_if("passes").alias("passed"), F.count_if(F.coalesce("passes", F.lit(False)) & F.col("holds").isNull()).alias("wrong"))
    total = files.agg(F.count("*")).scalar()
    return names.join(both, "name", "left").select("name", total.alias("files"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("held", "passed", "wrong")])
