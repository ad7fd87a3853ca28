"""Benchmark decontamination by the CGK embedding (Chakraborty, Goldenberg, Koucky, 2016).

A random walk over a window's words repeats a word or goes on by a random bit of the word and the step, so that windows a few
edits apart become strings a small Hamming distance apart. Each repetition has its own walk, its own place in the window
where the walk begins, and its own sample of the walk's coordinates; windows that agree with an item on all sampled
coordinates are candidates, verified by their exact word edit distance. The number of repetitions follows, for each length
of item, from the target recall and the collision rate measured on items of that length under as many random edits as the
threshold allows. Short items, and lengths that no number of repetitions serves, have exact keys instead: cut into one piece
more than the edits allowed, an item leaves at least one piece unchanged in every copy.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import MIX, mix, slices, tidy, word_hashes, words

STEPS = 8
SAMPLES = 4
MOST_REPETITIONS = 64
EXACT_BELOW = 15  #: items of fewer words have exact keys: their walks begin at too few places
TRIALS = 1000
TRIAL_CELLS = 1 << 20
BLOCK_BYTES = 8 << 20  #: items are taken in blocks of about so many bytes of text, each broadcast for one pass
VERIFY_CELLS = 1 << 17  #: tables of candidates under verification have about so many cells, whatever the items' length


@dataclass
class Items:
    """Items of a block: ids, word hashes of all, offsets, edits allowed in each, and repetitions of each (0: exact keys)."""

    ids: list
    hashes: np.ndarray
    offsets: np.ndarray
    edits: np.ndarray
    repetitions: np.ndarray

    def __len__(self):
        return len(self.ids)


def seeds(repetition: int) -> tuple[np.uint64, float, np.ndarray]:
    """(seed of the walk's bits, where in the window it begins, sampled coordinates; 0 is always one)."""
    rng = np.random.default_rng(7919 + repetition)
    coordinates = np.sort(np.concatenate([[0], 1 + rng.choice(STEPS - 1, SAMPLES - 1, replace=False)]))
    return np.uint64(rng.integers(1 << 63)), (repetition * 0.618033988749895) % 1.0, coordinates


def item_keys(hashes: np.ndarray, first: np.ndarray, steps: np.ndarray, repetition: int) -> list[np.ndarray]:
    """Symbols of each item's walk at the sampled coordinates (a row each), by the item's start and number of steps."""
    seed, _, coordinates = seeds(repetition)
    out, at = [], first.copy()
    for t in range(STEPS):
        if t in coordinates:
            out.append(hashes[at])
        bit = (mix(hashes[at] ^ seed) >> np.uint64(t)) & np.uint64(1)
        at = at + np.where(t + 1 < steps, bit.astype(np.int64), 0)
    return out


def begin(items: Items, repetition: int) -> tuple[np.ndarray, np.ndarray]:
    """(offset in its item where the walk begins, steps) of each item: a walk never leaves its item."""
    sizes = np.diff(items.offsets)
    steps = np.minimum(STEPS, sizes)
    return (seeds(repetition)[1] * (sizes - steps + 1)).astype(np.int64), steps


def edited(rng: random.Random, x: list[int], edits: int) -> list[int]:
    """A copy of ``x`` after so many random insertions, deletions and replacements."""
    y = list(x)
    for _ in range(edits):
        kind, at = rng.randrange(3), rng.randrange(max(len(y), 1))
        if kind == 0:
            y.insert(at, rng.getrandbits(62))
        elif kind == 1 and len(y) > 1:
            del y[at]
        elif y:
            y[at] = rng.getrandbits(62)
    return y


def trials(x: np.ndarray, edits: int, rng: random.Random) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(``TRIALS`` items drawn from rows of ``x``, an edited copy of each, padded, and the copies' sizes)."""
    own = x[[rng.randrange(len(x)) for _ in range(TRIALS)]]
    copies = [edited(rng, row, edits) for row in own.tolist()]
    width = own.shape[1] + edits
    return own, np.array([y + [0] * (width - len(y)) for y in copies], np.uint64), np.array([len(y) for y in copies])


def meets(own: np.ndarray, copies: np.ndarray, lengths: np.ndarray, edits: int, repetition: int) -> np.ndarray:
    """Whether each item (rows of equal size) and its copy meet: the walks agree, no further off than the edits can move it."""
    (count, size), width = own.shape, copies.shape[1]
    steps = min(STEPS, size)
    first = int(seeds(repetition)[1] * (size - steps + 1))
    starts = np.arange(max(first - edits, 0), first + edits + 1)
    met, each = np.zeros(count, bool), max(1, TRIAL_CELLS // len(starts))
    for low in range(0, count, each):
        x, y = own[low : low + each], copies[low : low + each]
        a = item_keys(x.ravel(), np.arange(len(x)) * size + first, np.full(len(x), steps), repetition)
        inside = starts <= (lengths[low : low + each] - steps)[:, None]
        at = np.arange(len(x))[:, None] * width + np.where(inside, starts, 0)
        b = item_keys(y.ravel(), at.ravel(), np.full(at.size, steps), repetition)
        same = np.logical_and.reduce([q.reshape(at.shape) == p[:, None] for p, q in zip(a, b, strict=True)])
        met[low : low + each] = (same & inside).any(1)
    return met


def repetitions_for(hashes: list[np.ndarray], edits: np.ndarray, recall: float) -> np.ndarray:
    """Repetitions of each item after which it and a copy with as many edits as allowed have met with probability ``recall``.

    Measured apart for each length (from 64 words on, for lengths within a sixteenth of an octave, at the hardest of them),
    with a standard error to spare. 0 stands for exact keys: short items, and lengths for which ``MOST_REPETITIONS`` are too few."""
    sizes, out = np.array([len(x) for x in hashes], np.int64), np.zeros(len(hashes), np.int64)
    enough = recall + np.sqrt(recall * (1 - recall) / TRIALS)
    group = np.where(sizes < 64, sizes, 64 + np.floor(16 * np.log2(np.maximum(sizes, 64) / 64)).astype(np.int64))
    for g in np.unique(group[sizes >= EXACT_BELOW]):
        own = np.flatnonzero(group == g)
        share = edits[own] / sizes[own]
        hardest = own[share == share.max()]
        size, most = sizes[hardest].max(), edits[hardest].max()
        x, y, lengths = trials(np.stack([hashes[k] for k in hardest if sizes[k] == size]), int(most), random.Random(int(g)))
        met = np.zeros(TRIALS, bool)
        for r in range(MOST_REPETITIONS):
            left = np.flatnonzero(~met)
            met[left] = meets(x[left], y[left], lengths[left], int(most), r)
            if met.mean() >= enough:
                out[own] = r + 1
                break
    return out


def prepare(rows: list[tuple], share: float, recall: float) -> Items:
    """Items of ``rows`` (id, text); items without words are left out, as nothing can match them."""
    codes, names, offsets = words(pa.array([r[1] for r in rows], pa.string()), lower=True)
    hashes, sizes = word_hashes(names)[codes], np.diff(offsets)
    some = np.flatnonzero(sizes)
    parts = [hashes[offsets[k] : offsets[k + 1]] for k in some]
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    edits = np.floor(share * sizes[some] + 1e-9).astype(np.int64)
    return Items([rows[k][0] for k in some], flat, np.concatenate([[0], np.cumsum(sizes[some])]), edits, repetitions_for(parts, edits, recall))


def agreeing(of: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index in ``of``, index in ``key``) of all pairs of equal values."""
    by = np.argsort(of, kind="stable")
    low, high = np.searchsorted(of[by], key, "left"), np.searchsorted(of[by], key, "right")
    times = high - low
    which = by[np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
    return which, np.repeat(np.arange(len(key)), times)


def exact_candidates(items: Items, own: np.ndarray, codes: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
    """(item, window start, anchor) of every place that holds one of an item's pieces, for the items ``own``."""
    count, sizes = items.edits[own] + 1, np.diff(items.offsets)[own]
    of_item, found = np.repeat(np.arange(len(own)), count), []
    piece = np.arange(len(of_item)) - np.repeat(np.cumsum(count) - count, count)
    first, past = piece * sizes[of_item] // count[of_item], (piece + 1) * sizes[of_item] // count[of_item]
    for length in np.unique(past - first):
        some = np.flatnonzero(past - first == length)
        begins = items.offsets[own[of_item[some]]] + first[some]
        active = np.arange(max(len(codes) - int(length) + 1, 0))
        of, key = np.zeros(len(some), np.uint64), np.zeros(len(active), np.uint64)
        for t in range(int(length)):
            want = items.hashes[begins + t]
            keep = np.isin(hashes, want)[codes[active + t]]
            active, key = active[keep], key[keep]
            of, key = mix(of * MIX + want), mix(key * MIX + hashes[codes[active + t]])
        which, at = agreeing(of, key)
        found.append(np.stack([own[of_item[some[which]]], active[at] - first[some[which]], active[at]]))
    return found


def candidates(items: Items, codes: np.ndarray, hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, window start, text) of windows that agree with an item in some repetition or piece; ``hashes`` are the dictionary's."""
    exact = np.flatnonzero(items.repetitions == 0)
    found = exact_candidates(items, exact, codes, hashes) if len(exact) else []
    for r in range(int(items.repetitions.max(initial=0))):
        seed, _, coordinates = seeds(r)
        offset, steps = begin(items, r)
        bits = mix(hashes ^ seed)
        going = items.repetitions > r
        for count in np.unique(steps[going]):
            own = np.flatnonzero(going & (steps == count))
            symbols = item_keys(items.hashes, items.offsets[own] + offset[own], steps[own], r)
            active, key, of = None, None, np.zeros(len(own), np.uint64)
            at = None
            for t in range(int(count)):
                if t in coordinates:
                    want = symbols[int(np.searchsorted(coordinates, t))]
                    of = mix(of * MIX + want)
                    fits = np.isin(hashes, want)
                    if active is None:
                        active = np.flatnonzero(fits[codes])
                        at, key = active, np.zeros(len(active), np.uint64)
                    else:
                        keep = fits[codes[at]]
                        active, at, key = active[keep], at[keep], key[keep]
                    key = mix(key * MIX + hashes[codes[at]])
                if t + 1 < count:
                    step = (bits[codes[at]] >> np.uint64(t)) & np.uint64(1)
                    at = np.minimum(at + step.astype(np.int64), len(codes) - 1)
            which, at = agreeing(of, key)
            found.append(np.stack([own[which], active[at] - offset[own[which]], active[at]]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    item, start, anchor = np.concatenate(found, axis=1)
    text = np.searchsorted(offsets, anchor, side="right") - 1
    # a window that lies across an edge of texts counts for each text that it was found from
    by = np.lexsort((text, start, item))
    item, start, text = item[by], start[by], text[by]
    first = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (start[1:] != start[:-1]) | (text[1:] != text[:-1])])[: len(item)])
    return item[first], start[first], text[first]


def edit_rows(left: np.ndarray, sizes: np.ndarray, right: np.ndarray, free: bool) -> np.ndarray:
    """Last rows of the edit distance tables of left (words, padded) against every prefix of right; ``free``: against every substring that ends there."""
    width = right.shape[1]
    ramp = np.arange(width + 1, dtype=np.int32)
    row = np.zeros((len(left), width + 1), np.int32) if free else np.tile(ramp, (len(left), 1))
    for j in range(int(sizes.max(initial=0))):
        new = np.empty_like(row)
        new[:, 0] = j + 1
        np.minimum(row[:, :-1] + (right != left[:, j : j + 1]), row[:, 1:] + 1, out=new[:, 1:])
        new = np.minimum.accumulate(new - ramp, axis=1) + ramp
        row = np.where((j < sizes)[:, None], new, row)
    return row


def batches_of(widths: np.ndarray):
    """Runs of candidates, in order of width, whose tables (rows times the widest) keep to ``VERIFY_CELLS``; a wider one comes alone."""
    by, a = np.argsort(widths, kind="stable"), 0
    while a < len(by):
        ahead = by[a : a + VERIFY_CELLS]
        fits = np.flatnonzero(widths[ahead] * np.arange(1, len(ahead) + 1) > VERIFY_CELLS)
        stop = max(1, int(fits[0]) if len(fits) else len(ahead))
        yield by[a : a + stop]
        a += stop


def plausible(items: Items, item: np.ndarray, low: np.ndarray, high: np.ndarray, codes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether enough of an item's words are between words low and high for its edits; hash collisions only add candidates."""
    slots = 1024
    word_slot, item_slot = (hashes % np.uint64(slots)).astype(np.int64)[codes], (items.hashes % np.uint64(slots)).astype(np.int64)
    sizes_of, out = np.diff(items.offsets), np.zeros(len(item), bool)
    for own in batches_of(np.maximum(high - low, slots) // 16):  # a byte a cell, of one table
        which, lo, sizes = item[own], low[own], sizes_of[item[own]]
        there = np.zeros((len(which), slots), bool)
        rows = np.arange(len(which))[:, None]
        column = np.arange((high[own] - lo).max())
        there[rows, word_slot[np.minimum(lo[:, None] + column, (high[own] - 1)[:, None])]] = True
        column = np.arange(sizes.max())
        hit = there[rows, item_slot[np.minimum(items.offsets[which][:, None] + column, len(item_slot) - 1)]]
        out[own] = (hit & (column < sizes[:, None])).sum(1) >= sizes - items.edits[which]
    return out


def verify(items: Items, item: np.ndarray, low: np.ndarray, high: np.ndarray, codes: np.ndarray, hashes: np.ndarray):
    """(distance, first, past) of each item's best place between words low and high: fewest edits, then the earliest end."""
    order = np.argsort(hashes)
    at = np.minimum(np.searchsorted(hashes[order], items.hashes), max(len(order) - 1, 0))
    item_codes = np.where(hashes[order][at] == items.hashes, order[at], -2)
    sizes_of = np.diff(items.offsets)
    distance, first, past = (np.zeros(len(item), np.int64) for _ in range(3))
    for own in batches_of(high - low + 1):
        which, lo, hi = item[own], low[own], high[own]
        sizes = sizes_of[which]
        column = np.arange(sizes.max())
        left = np.where(column < sizes[:, None], item_codes[np.minimum(items.offsets[which][:, None] + column, len(item_codes) - 1)], -3)
        column = np.arange((hi - lo).max())
        inside = column < (hi - lo)[:, None]
        right = np.where(inside, codes[np.minimum(lo[:, None] + column, len(codes) - 1)], -4)
        row = edit_rows(left, sizes, right, True)
        end = row.argmin(1)
        best = row[np.arange(len(which)), end]
        # from the best end backwards: the substring's start
        turned = np.arange(sizes.max())[None]
        back_left = np.where(turned < sizes[:, None], np.take_along_axis(left, np.maximum(sizes[:, None] - 1 - turned, 0), 1), -3)
        back = end[:, None] - 1 - column
        back_right = np.where(back >= 0, np.take_along_axis(right, np.maximum(back, 0), 1), -4)
        row = edit_rows(back_left, sizes, back_right, False)
        row = np.where(np.arange(row.shape[1]) <= end[:, None], row, 1 << 20)
        length = row.argmin(1)
        distance[own], first[own], past[own] = best, lo + end - length, lo + end
    return distance, first, past


def matches(items: Items, texts: pa.Array):
    """(text, item, distance, first word, past-the-last word) of every text's best match with every item within its edits."""
    codes, names, offsets = words(texts, lower=True)
    none = (np.zeros(0, np.int64),) * 5
    if not len(items) or not len(codes):
        return none
    hashes = word_hashes(names)
    item, start, text = candidates(items, codes, hashes, offsets)
    sizes = np.diff(items.offsets)[item]
    low = np.maximum(start - items.edits[item], offsets[text])
    high = np.minimum(start + sizes + items.edits[item], offsets[text + 1])
    some = np.flatnonzero(high - low >= sizes - items.edits[item])
    some = some[plausible(items, item[some], low[some], high[some], codes, hashes)] if len(some) else some
    item, text, low, high = item[some], text[some], low[some], high[some]
    if not len(item):
        return none
    distance, first, past = verify(items, item, low, high, codes, hashes)
    good = np.flatnonzero(distance <= items.edits[item])
    item, text, distance, first, past = item[good], text[good], distance[good], first[good], past[good]
    by = np.lexsort((first, distance, item, text))
    head = by[np.flatnonzero(np.concatenate([[True], (item[by][1:] != item[by][:-1]) | (text[by][1:] != text[by][:-1])]))] if len(by) else by
    return text[head], item[head], distance[head], first[head] - offsets[text[head]], past[head] - offsets[text[head]]


def item_blocks(benchmark: DataFrame, similarity: float, recall: float):
    """Blocks of items of bounded size, one after another."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES) or 1
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else rows
        yield prepare([tuple(r) for r in own.distinct().orderBy("item_id", "text").collect()], 1 - similarity, recall)


LEAKS = "doc_id long, item_id long, distance int, item_words int, first_word int, past_word int"


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """Passages of ``docs`` (doc_id, text) within a share of ``1 - similarity`` word edits of an item of ``benchmark`` (item_id, text).

    One row per document row and item: distance and place (words, lower case, split at white space) of the best match:
    fewest edits, then the first. Exact passages are always found, edited ones with probability ``recall`` at the edit
    limit and more below it, whatever the item's length; items under ``EXACT_BELOW`` words always. Null, empty and blank texts match nothing, nor do such items; null ids stay null; repeated
    rows are matched each, repeated items once; items of 1 to 4 words must match exactly; other columns are ignored."""
    spark, out = docs.sparkSession, None
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for items in item_blocks(benchmark, similarity, recall):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            items, sizes = shared.value, np.diff(shared.value.offsets)
            for batch in batches:
                for some in slices(batch, "text"):
                    text, item, distance, first, past = matches(items, some.column("text"))
                    columns = [some.column("doc_id").take(pa.array(text)), pa.array([items.ids[k] for k in item], pa.int64())]
                    columns += [pa.array(x.astype(np.int32)) for x in (distance, sizes[item] if len(item) else item, first, past)]
                    yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in LEAKS.split(", ")])

        found = base.mapInArrow(tidy(run), LEAKS)
        out = found if out is None else out.unionAll(found)
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """``docs`` without the rows in which ``find_leaks`` finds an item; all columns stay. One pass per block of items."""
    for items in item_blocks(benchmark, similarity, recall):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for batch in batches:
                for some in slices(batch, "text"):
                    keep = np.ones(some.num_rows, bool)
                    keep[matches(shared.value, some.column("text"))[0]] = False
                    yield some.filter(pa.array(keep))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
