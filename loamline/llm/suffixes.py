"""Repeated passages by a sparse suffix array.

Of all suffixes of all texts only those at content-selected minimisers are kept: every window of ``min_words`` words has
exactly one minimiser among its k-grams, chosen by its content alone, so equal windows meet at equal suffixes. Suffixes
whose k-gram occurs once are dropped. The others, with the words around them, are sorted by k-gram and following words;
common prefixes of neighbours give the runs that agree to the right, and agreement to the left splits the runs. A window
repeats exactly if its run holds two or more; windows that repeat are joined into maximal spans.

Suffixes with the same surroundings are one row before they are sorted, so text that many documents share costs a task one
row per slice of input, and results return to the suffixes by a join. A k-gram with many different surroundings would still
fill a task: beyond ``HOT_CLASSES`` its suffixes meet by the words of each of their windows instead, spread over all tasks,
with the same result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import gram_hashes, mix, slices, stash, tidy, unused, word_hashes, words

GRAM = 15
HOT_CLASSES = 2048


class Windows:
    """Windows of ``size`` words inside texts and their minimisers, for concatenated word hashes."""

    def __init__(self, texts: pa.Array, size: int):
        codes, names, self.offsets = words(texts)
        self.hashes = word_hashes(names)[codes]
        span = size - GRAM + 1
        grams = gram_hashes(self.hashes, GRAM)
        self.grams = grams
        text = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))
        starts = np.arange(max(len(self.hashes) - size + 1, 0))
        self.starts = starts[text[starts] == text[starts + size - 1]] if len(starts) else starts
        least = np.arange(len(grams))
        done, step = least, 1  # ``done`` covers ``step`` grams; windows double, then two overlap
        while step * 2 <= span:
            done = np.where(grams[done[:-step]] <= grams[done[step:]], done[:-step], done[step:]) if len(done) > step else done[:0]
            step *= 2
        if step < span and len(done) > span - step:
            left, right = done[: len(done) - (span - step)], done[span - step :]
            done = np.where(grams[left] <= grams[right], left, right)
        at = done[self.starts] if len(self.starts) else self.starts
        self.minimiser = at
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        self.places = at[first]
        bits = np.uint64(1) << (at - self.starts).astype(np.uint64)
        self.masks = np.bitwise_or.reduceat(bits, first) if len(first) else np.zeros(0, np.uint64)
        self.text = text[self.places]


def _seeds(size: int):
    def run(batches):
        for batch in batches:
            for some in slices(batch, "text"):
                found = Windows(some.column("text"), size)
                key = some.column("key").to_numpy(zero_copy_only=False)[found.text]
                pos = (found.places - found.offsets[found.text]).astype(np.int32)
                seed = found.grams[found.places].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(pos), pa.array(seed)], ["key", "pos", "seed"])

    return run


SUFFIXES = "doc_id long, key long, pos int, seed long, class long, mask long, after binary, before binary, n long, first_doc long, first_pos int"


def _contexts(size: int):
    """Suffixes at the listed positions; the first of each class in a slice also has the class's words and totals."""
    left, right = size - GRAM, size

    def run(batches):
        for batch in batches:
            for some in slices(batch, "text"):
                found = Windows(some.column("text"), size)
                lists = some.column("places")
                counts = lists.value_lengths().to_numpy(zero_copy_only=False)
                wanted = lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(found.offsets[:-1], counts)
                at = np.flatnonzero(np.isin(found.places, wanted))
                place, mask, text = found.places[at], found.masks[at], found.text[at]
                seed = found.grams[place].view(np.int64)
                short = (found.hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                low = np.zeros(len(at), np.int64)  # least and greatest offset among the windows of a suffix
                high = np.zeros(len(at), np.int64)
                for a in range(left, -1, -1):
                    low = np.where(mask >> np.uint64(a) & np.uint64(1), a, low)
                for a in range(left + 1):
                    high = np.where(mask >> np.uint64(a) & np.uint64(1), a, high)
                step = np.arange(right)
                after = np.where(step < (right - low)[:, None], short[np.minimum(place[:, None] + step, len(short) - 1)], 0) if len(at) else np.zeros((0, right))
                step = np.arange(1, left + 1)
                before = np.where(step <= high[:, None], short[np.maximum(place[:, None] - step, 0)], 0) if len(at) else np.zeros((0, left))
                after, before = after.astype(">u4"), before.astype(">u4")
                total = mask.copy()
                for column in (*after.T, *before.T):
                    total = mix(total * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
                classes = total ^ seed.view(np.uint64)
                doc = some.column("doc_id").fill_null(ABSENT).to_numpy(zero_copy_only=False)[text]
                key = some.column("key").to_numpy(zero_copy_only=False)[text]
                pos = (place - found.offsets[text]).astype(np.int32)
                by = np.lexsort((pos, doc, classes))
                head = np.flatnonzero(np.concatenate([[True], classes[by][1:] != classes[by][:-1]])) if len(by) else by
                n = np.zeros(len(at), np.int64)
                n[by[head]] = np.diff(np.append(head, len(by)))
                shown = n > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc), pa.array(key), pa.array(pos), pa.array(seed), pa.array(classes.view(np.int64)), pa.array(mask.view(np.int64)),
                        _binary(after, shown), _binary(before, shown), pa.array(n), pa.array(doc), pa.array(pos),
                    ],
                    [x.split()[0] for x in SUFFIXES.split(", ")],
                )

    return run


def _binary(table: np.ndarray, shown: np.ndarray) -> pa.Array:
    """A binary value per row where ``shown``, else null."""
    data = np.ascontiguousarray(table[shown]).tobytes()
    width = table.shape[1] * 4
    ends = np.concatenate([[0], np.cumsum(shown * width)]).astype(np.int32)
    valid = np.packbits(shown, bitorder="little").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(table), [pa.py_buffer(valid), pa.py_buffer(ends), pa.py_buffer(data)])


ABSENT = -(1 << 63)
VERDICTS = "seed long, class long, repeats long, firsts long, first_doc long, first_pos int"


def _compare(size: int):
    """Sorted suffixes: windows (offset bits) of each class that repeat, and those of which the class has the first."""
    left, right = size - GRAM, size

    def decide(rows: pa.Table) -> pa.RecordBatch:
        seed = rows["seed"].to_numpy()
        mask = rows["mask"].to_numpy().view(np.uint64)
        n = rows["n"].to_numpy()
        doc, pos = rows["first_doc"].to_numpy(), rows["first_pos"].to_numpy()
        count = len(seed)
        table = lambda name, width: np.frombuffer(b"".join(rows[name].to_pylist()), ">u4").reshape(count, width)
        after, before = table("after", right), table("before", left)
        same = np.zeros((count, right), bool)
        same[1:] = (after[1:] == after[:-1]) & (seed[1:] == seed[:-1])[:, None]
        common = np.where(same.all(1), right, same.argmin(1))  # words in common with the suffix before
        rank = np.empty(count, np.int64)
        rank[np.lexsort((pos, doc))] = np.arange(count)
        repeats, firsts = np.zeros(count, np.uint64), np.zeros(count, np.uint64)
        to_left = np.zeros(count, np.uint64)
        for a in range(left + 1):
            if a:
                to_left = mix(to_left * np.uint64(0x9E3779B97F4A7C15) + before[:, a - 1].astype(np.uint64))
            bit = np.uint64(1) << np.uint64(a)
            own = np.flatnonzero(mask & bit)
            if not len(own):
                continue
            run = np.cumsum(common < right - a)[own]
            _, group = np.unique(mix(to_left[own] ^ mix(run.astype(np.uint64))), return_inverse=True)
            times = np.bincount(group, n[own])
            least = np.full(len(times), count)
            down = np.argsort(-rank[own])
            least[group[down]] = rank[own][down]
            again = times[group] > 1
            repeats[own[again]] |= bit
            firsts[own[again & (least[group] == rank[own])]] |= bit
        some = np.flatnonzero(repeats)
        columns = [seed[some], rows["class"].to_numpy()[some], repeats[some].view(np.int64), firsts[some].view(np.int64), doc[some], pos[some]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in VERDICTS.split(", ")])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            seed = batch.column("seed").to_numpy()
            if not len(seed):
                continue
            # suffixes of the last k-gram may go on in the next batch
            split = int(np.searchsorted(seed, seed[-1], side="left"))
            if split or (held and held[-1].column("seed")[-1].as_py() != seed[0]):
                held.append(batch.slice(0, split))
                yield decide(pa.Table.from_batches(held).combine_chunks())
                held = [batch.slice(split)]
            else:
                held.append(batch)
        if held:
            yield decide(pa.Table.from_batches(held).combine_chunks())

    return run


def _by_windows(classes: DataFrame, size: int) -> DataFrame:
    """What ``_compare`` finds, for k-grams with many classes: windows meet by a hash of all their words, and no task has a k-gram as a whole."""
    left, right = size - GRAM, size
    offsets = F.filter(F.sequence(F.lit(0), F.lit(left)), lambda a: F.call_function("getbit", F.col("mask"), a) == 1)
    windows = classes.withColumn("a", F.explode(offsets))
    words = [F.substring("before", F.lit(1), F.col("a") * 4), F.substring("after", F.lit(1), (F.lit(right) - F.col("a")) * 4)]
    first = F.struct("first_doc", "first_pos")
    windows = windows.select("seed", "class", "n", first.alias("own"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("a")).alias("bit"), F.xxhash64("seed", "a", *words).alias("window"))
    groups = windows.groupBy("window").agg(F.sum("n").alias("times"), F.min("own").alias("least")).where("times > 1").select("window", "least")
    # written first, so that a window that many classes have is a plain shuffle, which Spark can split
    again = windows.join(stash(groups, "windows"), "window")
    firsts = F.bit_or(F.when(F.col("own") == F.col("least"), F.col("bit")).otherwise(F.lit(0).cast("long")))
    out = again.groupBy("seed", "class").agg(F.bit_or("bit").alias("repeats"), firsts.alias("firsts"), F.min("own").alias("own"))
    return out.select("seed", "class", "repeats", "firsts", "own.*")


SPANS = "doc_id long, key long, spans array<struct<first:int,past:int>>, cuts array<struct<first:int,past:int>>"


def _join_windows(starts: np.ndarray, size: int) -> list[dict]:
    """Union of the windows at sorted starts, as spans."""
    if not len(starts):
        return []
    gap = np.flatnonzero(starts[1:] > starts[:-1] + size)
    first, last = starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)]
    return [{"first": int(a), "past": int(b) + size} for a, b in zip(first, last, strict=True)]


def _spans(size: int):
    def run(batches):
        for batch in batches:
            spans, cuts = [], []
            for hits in batch.column("hits"):
                hits = hits.values
                pos = hits.field("pos").to_numpy().astype(np.int64)
                both = []
                for name in ("repeats", "cut"):
                    mask = hits.field(name).to_numpy().view(np.uint64)
                    starts = [pos[(mask >> np.uint64(a) & np.uint64(1)).astype(bool)] - a for a in range(size - GRAM + 1)]
                    both.append(_join_windows(np.unique(np.concatenate(starts)), size))
                spans.append(both[0])
                cuts.append(both[1])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))
            arrays = [batch.column("doc_id"), batch.column("key"), pa.array(spans, kind), pa.array(cuts, kind)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "spans", "cuts"])

    return run


def text_key():
    return F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit("")))


def repeated_spans(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Passages of at least ``min_words`` words (split at white space, compared exactly) of ``docs`` (doc_id, text) that occur again.

    One row per text that has any: doc_id, key (a hash of id and text), spans (first and past-the-last word of each
    maximal run of repeated windows) and cuts, the part of the spans whose windows occur before, by (doc_id, position):
    what must go for each passage to occur once. Repeats count wherever they are, in the same text too. Null and short
    texts have no windows; a null doc_id comes first; a repeated row is one row of the result, and its windows repeat but
    both rows are the first; an empty table gives no rows; other columns are ignored."""
    if not GRAM < min_words <= GRAM + 63:
        raise ValueError(f"min_words must be in {GRAM + 1}..{GRAM + 63}")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", text_key())
    seeds = stash(base.select("key", "text").mapInArrow(tidy(_seeds(min_words)), "key long, pos int, seed long"), "seeds")
    # written first, so that both sides of the join are plain shuffles, of which Spark can split a partition with a hot k-gram
    again = stash(seeds.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed"), "again")
    places = seeds.join(again, "seed").groupBy("key").agg(F.collect_set("pos").alias("places"))
    near = base.join(places, "key").select("doc_id", "key", "text", "places")
    suffixes = stash(near.mapInArrow(tidy(_contexts(min_words)), SUFFIXES), "suffixes")
    classes = suffixes.where("after IS NOT NULL").select("seed", "class", "mask", "after", "before", "n", "first_doc", "first_pos")
    hot = stash(classes.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > HOT_CLASSES).select("seed"), "hot")
    some_hot = not hot.isEmpty()
    cold = classes.join(hot, "seed", "left_anti") if some_hot else classes
    ordered = cold.repartition("seed").sortWithinPartitions("seed", "after")
    verdicts = ordered.mapInArrow(tidy(_compare(min_words)), VERDICTS)
    if some_hot:
        verdicts = verdicts.unionByName(_by_windows(classes.join(hot, "seed", "left_semi"), min_words))
    # a class has a row for each slice that it is in; all agree on what repeats, and the one with the first has the firsts
    merged = verdicts.groupBy("seed", "class").agg(
        F.bit_or("repeats").alias("repeats"), F.bit_or("firsts").alias("firsts"), F.min(F.struct("first_doc", "first_pos")).alias("at")
    )
    merged = stash(merged, "verdicts")  # again so that the join can split a class that many suffixes have
    hits = suffixes.select("doc_id", "key", "pos", "seed", "class").join(merged, ["seed", "class"])
    first = (F.col("doc_id") == F.col("at.first_doc")) & (F.col("pos") == F.col("at.first_pos"))
    cut = F.when(first, F.col("repeats").bitwiseAND(F.bitwise_not(F.col("firsts")))).otherwise(F.col("repeats"))
    gathered = hits.select("doc_id", "key", F.struct("pos", "repeats", cut.alias("cut")).alias("hit")).groupBy("doc_id", "key")
    found = gathered.agg(F.collect_list("hit").alias("hits")).mapInArrow(tidy(_spans(min_words)), SPANS)
    return found.withColumn("doc_id", F.when(F.col("doc_id") != ABSENT, F.col("doc_id")))


def remove_repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` with all but the first occurrence of each repeated passage cut from ``text``; all other columns stay.

    Words go with the white space after them; texts without cuts stay as they are, texts left without words are dropped."""
    key, own = unused(docs, "_key", "_cuts")
    spans = repeated_spans(docs, min_words).where(F.size("cuts") > 0).select(F.col("key").alias(key), F.col("cuts").alias(own))
    # rows that repeat have one key and the same cuts
    spans = spans.dropDuplicates([key])
    rows = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    joined = rows.join(spans, key, "left")

    def cut(batches):
        for batch in batches:
            texts, cuts = batch.column("text").to_pylist(), batch.column(own).to_pylist()
            keep = []
            for k, some in enumerate(cuts):
                if some:
                    at = [m.start() for m in re.finditer(r"\S+", texts[k])] + [len(texts[k])]
                    parts, last = [], 0
                    for c in some:
                        parts.append(texts[k][last : at[c["first"]]])
                        last = at[c["past"]]
                    texts[k] = "".join([*parts, texts[k][last:]])
                keep.append(not some or bool(texts[k].strip()))
            columns = [pa.array(texts, pa.string()) if name == "text" else batch.column(name) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(keep))

    return joined.mapInArrow(tidy(cut), joined.schema).select(*docs.columns)
