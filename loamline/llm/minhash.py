"""Similarity join on word n-grams by MinHash banding, verified on the full n-gram sets.

Copies of a text are one node. Band hashes are grouped by an aggregate that leaves one row per bucket, and every member
is linked to its bucket's least node only, so a bucket of any size costs its own rows. The links' components are candidate
groups; all texts of a group are compared in blocks of bounded size, and each block returns counts of links and a
spanning forest rather than its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import cut, gram_hashes, mix, slices, stash, tidy, unused, word_hashes, words
from loamline.llm.components import components

BLOCK = 256
COLUMNS = 2048


def choose_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows) with the most rows, so the fewest false candidates, that reach ``recall`` at ``threshold`` within ``most`` hashes."""
    for rows in range(12, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no bands reach this recall")


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of word n-grams, offsets of each text in them): lower case; a text of 1 to n-1 words is one shingle."""
    codes, names, offsets = words(texts, lower=True)
    hashes = word_hashes(names)[codes]
    sizes = np.diff(offsets)
    if (short := np.flatnonzero((sizes > 0) & (sizes < n))).size:
        # pad short texts to n words with a mark of their length
        add = np.where((sizes > 0) & (sizes < n), n - sizes, 0)
        hashes = np.insert(hashes, np.repeat(offsets[1:][short], add[short]), mix(np.repeat(sizes[short], add[short]).astype(np.uint64)))
        sizes = sizes + add
        offsets = np.concatenate([[0], np.cumsum(sizes)])
    grams = gram_hashes(hashes, n)
    counts = np.maximum(sizes - n + 1, 0)
    ends = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(ends[-1]) + np.repeat(offsets[:-1] - ends[:-1], counts)
    return grams[at], ends


def _signatures(n: int, bands: int, rows: int):
    def run(batches):
        seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(-1, 2)
        for batch in batches:
            for some in slices(batch, "text"):
                grams, offsets = shingles(some.column("text"), n)
                has = np.flatnonzero(np.diff(offsets))
                out = np.zeros((bands, len(has)), np.uint64)
                buffer = np.empty_like(grams)
                for k in range(bands * rows if len(has) else 0):
                    np.bitwise_xor(grams, seeds[k, 0], out=buffer)
                    np.multiply(buffer, seeds[k, 1] | np.uint64(1), out=buffer)
                    out[k // rows] = mix(out[k // rows] ^ np.minimum.reduceat(buffer, offsets[:-1][has]))
                flat = pa.array(out.T.reshape(-1).view(np.int64))
                cuts = np.zeros(some.num_rows + 1, np.int32)
                cuts[1:][has] = bands
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(cuts).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("node"), lists], ["doc_id", "node", "bands"])

    return run


def _compare(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set of sorted hashes."""
    every = left + right
    if len(left) * len(right) <= 64:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left], np.float64)
    own = np.repeat(np.arange(len(every)), [len(x) for x in every])
    _, code, times = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    common = np.flatnonzero(times > 1)
    place = np.full(len(times), -1)
    place[common] = np.arange(len(common))
    column = place[code]
    keep = column >= 0
    own, column = own[keep], column[keep]
    by = np.argsort(column, kind="stable")
    own, column = own[by], column[by]
    out = np.zeros((len(left), len(right)))
    for first in range(0, len(common), COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        table = np.zeros((len(every), COLUMNS), np.float32)
        table[own[a:b], column[a:b] - first] = 1
        out += table[: len(left)] @ table[len(left) :].T
    return out


VERIFIED = "node binary, other binary, links long, copies long"


def _verify(n: int, threshold: float):
    """Rows of each (root, i, j) task come together: links of each node within the task, then a spanning forest (links null)."""

    def flush(rows):
        seen = {}
        for node, copies, block, text in rows:
            seen.setdefault(node, (copies, block, text))
        nodes = sorted(seen)
        i = min(v[1] for v in seen.values())
        groups = [[x for x in nodes if seen[x][1] == i], [x for x in nodes if seen[x][1] != i]]
        if not groups[1]:
            groups[1] = groups[0]
        sets = {}
        for x in nodes:
            sets[x] = np.unique(shingles(pa.array([seen[x][2]]), n)[0])
        both = _compare([sets[x] for x in groups[0]], [sets[x] for x in groups[1]])
        size = [np.array([len(sets[x]) for x in g], np.float64) for g in groups]
        alike = both >= threshold * (size[0][:, None] + size[1][None, :] - both) - 1e-9
        alike &= both > 0
        same = groups[0] is groups[1]
        if same:
            np.fill_diagonal(alike, False)
        out, weight = [], [np.array([seen[x][0] for x in g], np.int64) for g in groups]
        out += [(x, None, int(k), int(w)) for x, k, w in zip(groups[0], alike.sum(1), alike @ weight[1], strict=True) if k]
        if not same:
            out += [(x, None, int(k), int(w)) for x, k, w in zip(groups[1], alike.sum(0), weight[0] @ alike, strict=True) if k]
        parent = {}

        def root(x):
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        for a, b in np.argwhere(alike):
            x, y = root(groups[0][a]), root(groups[1][b])
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((groups[0][a], groups[1][b], None, None))
        return out

    def run(batches):
        key, rows = None, []

        def frame(out):
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["node", "other", "links", "copies"])

        for batch in batches:
            out = []
            cols = [batch.column(c).to_pylist() for c in ("root", "i", "j", "node", "copies", "block", "text")]
            for root, i, j, node, copies, block, text in zip(*cols, strict=True):
                if (root, i, j) != key:
                    if rows:
                        out += flush(rows)
                    key, rows = (root, i, j), []
                rows.append((node, copies, block, text))
            if out:
                yield frame(out)
        if rows:
            yield frame(flush(rows))

    return run


def text_node() -> Column:
    """Identity of a text: copies share it; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


ABSENT, LAST = -(1 << 63), (1 << 63) - 1


def similarity_join(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.999) -> DataFrame:
    """Near-duplicate classes of ``docs`` (doc_id, text): one row per row, (doc_id, node, class_id, n_links,
    text_links, stays).

    Two texts are linked if the Jaccard similarity of their sets of word n-grams (lower case, split at white space; fewer
    than n words are one gram) is at least ``threshold``. class_id is the least doc_id of all documents linked directly or
    through others. n_links counts the other documents linked to a document, copies included; text_links the different
    texts; stays marks the document with the class's id. Null, empty and blank texts have no n-grams and link to nothing: each is a class of its own. A null doc_id
    gives a null class_id unless its class has another id; repeated rows are copies; other columns are ignored."""
    bands, rows = choose_bands(threshold, recall)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.withColumn("node", text_node())
    signed = stash(base.mapInArrow(tidy(_signatures(n, bands, rows)), "doc_id long, node binary, bands array<long>"), "signatures")
    texts = cut(
        signed.where(F.size("bands") > 0).groupBy("node").agg(
            F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    )
    banded = texts.select("node", F.posexplode("bands").alias("band", "hash"))
    buckets = banded.groupBy("band", "hash").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
    stars = banded.join(buckets, ["band", "hash"]).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    groups = components(stars)
    sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = groups.join(sizes, "root").join(texts.select("node", "first", "copies"), "node")
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = members.select("root", "node", "first", "copies", "block", each.alias("with"))
    tasks = tasks.select("root", "node", "first", "copies", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    # a text comes once for each block that it is compared with; rows of one document and text are alike
    known = F.coalesce("doc_id", F.lit(ABSENT))
    source = base.select("node", known.alias("first"), "text")
    tasks = tasks.withColumn("first", F.coalesce("first", F.lit(ABSENT))).join(source, ["node", "first"])
    # the key is hashed anew: roots are least hashes
    spread = tasks.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    verified = cut(spread.select("root", "i", "j", "node", "copies", "block", "text").mapInArrow(tidy(_verify(n, threshold)), VERIFIED))
    links = verified.where("links IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"), F.sum("copies").alias("linked"))
    linked = components(verified.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    # a class goes by its least id, a text without id coming last, and by that id's least text
    order = F.struct(F.coalesce("first", F.lit(LAST)).alias("first"), "node")
    firsts = linked.join(texts.select("node", "first"), "node")
    heads = firsts.groupBy("root").agg(F.min(order).alias("head"))
    class_of = firsts.join(heads, "root").select("node", "head")
    info = texts.select("node", "first", "copies").join(class_of, "node", "left").join(links, "node", "left")
    info = info.where("copies > 1 OR links > 0").select(
        "node", F.coalesce("head", order).alias("head"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n"),
        F.coalesce("links", F.lit(0)).alias("t"),
    )
    out = signed.select("doc_id", "node").join(info, "node", "left")
    class_id = F.when(F.col("head").isNull(), F.col("doc_id")).when(F.col("head.first") != LAST, F.col("head.first"))
    is_head = (F.col("head.node") == F.col("node")) & (F.coalesce("doc_id", F.lit(LAST)) == F.col("head.first"))
    return out.select(
        "doc_id", "node", class_id.alias("class_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("t", F.lit(0)).cast("long").alias("text_links"), F.coalesce(is_head, F.lit(True)).alias("stays"),
    )


def keep_one(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.999) -> DataFrame:
    """``docs`` with one document of each class of ``similarity_join``, that with the least doc_id; all columns stay.

    Texts without words are kept; of rows with equal ids and texts, one."""
    key, node = unused(docs, "_id", "_node")
    gone = similarity_join(docs, threshold, n, recall).where(~F.col("stays")).select(F.coalesce("doc_id", F.lit(LAST)).alias(key), F.col("node").alias(node)).distinct()
    text = F.col("text").cast("string")
    rows = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), node: F.unhex(F.md5(F.coalesce(text, F.lit(""))))})
    return rows.join(gone, [key, node], "left_anti").dropDuplicates([key, node]).select(*docs.columns)
