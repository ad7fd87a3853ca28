"""Sequence packing by minimum bin slack.

Documents are cut into full windows and a remainder. The multiset of remainder lengths is at most ``capacity`` counts,
so the driver plans on a histogram whose size does not depend on the data: the largest remaining length opens a window,
a bitset subset-sum over the other lengths finds the fill closest to capacity, and the pattern found is repeated as often
as the counts allow. Executors then turn (length, rank among pieces of that length) into (sequence, offset).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.common import slices, stash, tidy
from loamline.llm.tokens import tokenizer

PIECES = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary, part int, nth long"


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: copies}, repeats) that use up ``counts``; lengths are 1..capacity.

    Each pattern starts from the largest length left; ties between fills go to longer pieces."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be between 1 and the capacity")
    out = []
    while left:
        seed = max(left)
        room = capacity - seed
        mask, reach, steps = (1 << (room + 1)) - 1, 1, []
        for n in sorted((n for n in left if n <= room), reverse=True):
            have, copies = left[n] - (n == seed), 1
            have = min(have, room // n)
            while have > 0 and not reach >> room & 1:
                take = min(copies, have)
                steps.append((n, take, reach))
                reach |= reach << (n * take) & mask
                have -= take
                copies *= 2
            if reach >> room & 1:
                break
        total, use = reach.bit_length() - 1, {seed: 1}
        for n, take, before in reversed(steps):
            if not before >> total & 1:
                use[n] = use.get(n, 0) + take
                total -= n * take
        repeats = min(left[n] // c for n, c in use.items())
        out.append((use, repeats))
        for n, c in use.items():
            left[n] -= c * repeats
            if not left[n]:
                del left[n]
    return out


def placement(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, rank after the last, copies in a sequence, first sequence, offset there)."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for use, repeats in patterns:
        offset = 0
        for n in sorted(use, reverse=True):
            first = used.get(n, 0)
            used[n] = first + use[n] * repeats
            rows.append((n, first, used[n], use[n], sequence, offset))
            offset += n * use[n]
        sequence += repeats
    return rows


def _cut(path: str, capacity: int, end_id: int):
    def pieces(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        encode = tokenizer(path).encode
        for batch in batches:
            for some in slices(batch, "text"):
                ids, offsets = encode(some.column("text"))
                doc_ids = some.column("doc_id").to_pylist()
                rows = []
                for k, doc_id in enumerate(doc_ids):
                    own = np.append(ids[offsets[k] : offsets[k + 1]], np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(own), capacity):
                        data = own[start : start + capacity].tobytes()
                        n = len(data) // 4
                        rows.append((doc_id, start, n, len(own), zlib.crc32(data), data, part, int(seen[n])))
                        seen[n] += 1
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 5 + [pa.binary(), pa.int32(), pa.int64()]
                names = ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids", "part", "nth"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return pieces


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``capacity`` ids.

    One row per piece: doc_id, start, length, doc_tokens, ids_crc32, ids (little-endian unsigned 32-bit), sequence_id,
    offset. Null or empty text is one piece with the end id alone; a null doc_id stays null; repeated rows are packed
    each; an empty table gives no rows; other columns are ignored. Pieces of equal length are interchangeable, so ties
    go by scan partition and position. The cut pieces are one table in the shared folder.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stash(source.mapInArrow(tidy(_cut(tokenizer_path, capacity, end_id)), PIECES), "pieces")
    groups = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = groups.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    counts = {r[0]: r[1] for r in groups.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    rows = placement(minimum_bin_slack(counts, capacity))
    plan = spark.createDataFrame(rows, "length long, first long, past long, copies long, sequence long, at long")
    placed = pieces.join(ranked, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    inside = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past"))
    # ``plan`` has a few rows for each length up to the capacity, whatever the number of documents
    placed = placed.join(F.broadcast(plan.withColumnRenamed("length", "of")), (F.col("length") == F.col("of")) & inside)
    turn = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids",
        (F.col("sequence") + F.floor(turn / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("at") + turn % F.col("copies") * F.col("length")).cast("long").alias("offset"),
    )
