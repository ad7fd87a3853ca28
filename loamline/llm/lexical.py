"""Ranked lexical search over a clustered index of reordered documents.

Documents are put in a new order by recursive graph bisection, so that those of like terms are neighbours: a tree of
bisections, fitted on a bounded sample, takes every document to one of its leaves, and the documents of a leaf, in slices of
bounded size, are bisected by themselves. Runs of ``SHARD_DOCS`` neighbours are the shards of the index; for each term a shard keeps the
postings and the greatest score that one of them gives. A query visits shards by the sum of these, the bound of the shard, and
stops when no bound left reaches its k-th score so far; so results are exact, whatever the order. A bound that equals that
score is visited too, since a document there may win the tie by its id.

Null and termless texts are in no index; a null item has no results; repeated documents and items are each their own row;
null ids come last in a tie. An empty table gives no rows, and other columns are not looked at."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from loamline.llm.common import slices, stash, tidy, word_hashes, words

SHARD_DOCS = 256
SLICE_DOCS = 4096  #: of a leaf's documents, about so many are bisected together
SLICE_BYTES = 24 << 20
SAMPLE_DOCS = 4096  #: the tree is fitted on about so many documents, by at most SAMPLE_TERMS terms of each
SAMPLE_TERMS = 128
MODEL_TERMS = 1 << 14  #: and knows at most so many terms: with LEVELS of 7 a model takes 8 MB
LEVELS = 7
ROUNDS = (8, 64)  #: shards of a query that are visited before its k-th score is looked at for the first and second time
QUERY_BLOCK = 1024
SWAPS = 8  #: rounds of swaps in a bisection

#: A byte of a text as a byte of its terms: A-Z in lower case, a-z, 0-9 and bytes of code points from U+0080 as they are, else a space.
TERM_BYTES = np.full(256, 32, np.uint8)
TERM_BYTES[0x30:0x3A] = np.arange(0x30, 0x3A)
TERM_BYTES[0x41:0x5B] = TERM_BYTES[0x61:0x7B] = np.arange(0x61, 0x7B)
TERM_BYTES[0x80:] = np.arange(0x80, 256)


def terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Terms of each text, as ``common.ragged``: maximal runs of letters and digits of ASCII and of code points from U+0080, A-Z in lower case."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    clean = pa.StringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(TERM_BYTES[raw]))
    return words(clean, split=pc.ascii_split_whitespace)


def _cost(held: np.ndarray, docs: float) -> np.ndarray:
    """Bits for the gaps of a term that ``held`` of ``docs`` documents hold, as recursive graph bisection estimates them."""
    return held * np.log2(docs / (held + 1.0))


def _degrees(term: np.ndarray, left: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    return np.bincount(term[left], minlength=n_terms).astype(float), np.bincount(term[~left], minlength=n_terms).astype(float)


def _pull(ours: np.ndarray, theirs: np.ndarray, n_ours: float, n_theirs: float) -> np.ndarray:
    """Bits that the terms save each when a document that holds them moves from ours to theirs."""
    less = np.maximum(ours - 1, 0)
    return _cost(ours, n_ours) + _cost(theirs, n_theirs) - _cost(less, n_ours) - _cost(theirs + 1, n_theirs)


def bisect(doc: np.ndarray, term: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Which of the documents go left: from halves of the given order, rounds in which the documents that gain most change sides in pairs.

    ``doc`` and ``term`` are the edges; documents without edges count too."""
    left = np.arange(n_docs) < (n_docs + 1) // 2
    n_left, n_right = float(left.sum()), float(n_docs - left.sum())
    for _ in range(SWAPS):
        dl, dr = _degrees(term, left[doc], n_terms)
        rightwards, leftwards = _pull(dl, dr, n_left, n_right), _pull(dr, dl, n_right, n_left)
        gain = np.bincount(doc, np.where(left[doc], rightwards[term], leftwards[term]), n_docs)
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b))
        swaps = int((gain[a[:m]] + gain[b[:m]] > 1e-9).sum())
        if not swaps:
            break
        left[a[:swaps]], left[b[:swaps]] = False, True
    return left


def _narrow(doc: np.ndarray, term: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Edges without the terms that say nothing about an order: those of one document and those of over half of all."""
    held = np.bincount(term)
    keep = (held[term] > 1) & (2 * held[term] <= n_docs + 1)
    names, code = np.unique(term[keep], return_inverse=True)
    return doc[keep], code, len(names)


def order(doc: np.ndarray, term: np.ndarray, n_docs: int, leaf: int) -> np.ndarray:
    """Documents in the order of recursive bisection down to ``leaf`` documents."""
    if n_docs <= leaf:
        return np.arange(n_docs)
    edges = _narrow(doc, term, n_docs)
    left = bisect(edges[0], edges[1], n_docs, edges[2])
    place = np.where(left, np.cumsum(left), np.cumsum(~left)) - 1
    sides = []
    for side in (left, ~left):
        own = side[doc]
        sides.append(np.flatnonzero(side)[order(place[doc[own]], term[own], int(side.sum()), leaf)])
    return np.concatenate(sides)


@dataclass
class Tree:
    """Hashes of the terms known, sorted, and for each inner node (children of k are 2k+1 and 2k+2) how much a term pulls to the left."""

    known: np.ndarray
    weights: np.ndarray

    def leaves(self, doc: np.ndarray, hashes: np.ndarray, n_docs: int) -> np.ndarray:
        """Leaf of each document, given the hash of the term of each edge."""
        node = np.zeros(n_docs, np.int64)
        if not len(self.known):
            return node
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        own = self.known[at] == hashes
        doc, at = doc[own], at[own]
        for _ in range(LEVELS):
            node = 2 * node + 1 + (np.bincount(doc, self.weights[node[doc], at], n_docs) <= 0)
        return node - (2**LEVELS - 1)


def fit_tree(docs: DataFrame, seed: int = 1) -> Tree:
    """Bisections of a sample of about ``SAMPLE_DOCS`` documents; the driver sees hashes of ``SAMPLE_TERMS`` terms of each at most."""

    @tidy
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                codes, names, offsets = terms(part.column("text"))
                hashes = word_hashes(names).view(np.int64)
                own = [np.sort(hashes[np.unique(codes[a:b])])[:SAMPLE_TERMS] for a, b in zip(offsets, offsets[1:], strict=False)]
                ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, np.concatenate(own))], names=["hashes"])

    total = docs.count()
    sample = docs.select("text").sample(min(1.0, SAMPLE_DOCS / max(total, 1)), seed)
    lists = sample.mapInArrow(run, "hashes array<long>").toArrow()["hashes"].combine_chunks()
    n_docs = len(lists)
    doc = np.repeat(np.arange(n_docs), pc.list_value_length(lists).to_numpy(zero_copy_only=False)) if n_docs else np.zeros(0, np.int64)
    known, term = np.unique(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), return_inverse=True)
    held = np.bincount(term, minlength=len(known))
    fit = np.flatnonzero((held > 1) & (2 * held <= n_docs))
    fit = np.sort(fit[np.argsort(-held[fit], kind="stable")][:MODEL_TERMS])
    code = np.full(len(known), -1)
    code[fit] = np.arange(len(fit))
    doc, term = doc[code[term] >= 0], code[term[code[term] >= 0]]
    weights = np.zeros((2**LEVELS - 1, len(fit)), np.float32)

    def grow(node: int, doc: np.ndarray, term: np.ndarray, n: int) -> None:
        if node >= len(weights) or n < 2:
            return
        left = bisect(doc, term, n, len(fit))
        dl, dr = _degrees(term, left[doc], len(fit))
        n_left, n_right = float(left.sum()), float(n - left.sum())
        weights[node] = (_cost(dr + 1, n_right) - _cost(dr, n_right)) - (_cost(dl + 1, n_left) - _cost(dl, n_left))
        weights[node][(dl == 0) & (dr == 0)] = 0
        place = np.where(left, np.cumsum(left), np.cumsum(~left)) - 1
        for child, side in ((2 * node + 1, left), (2 * node + 2, ~left)):
            own = side[doc]
            grow(child, place[doc[own]], term[own], int(side.sum()))

    grow(0, doc, term, n_docs)
    return Tree(known[fit], weights)


@dataclass
class Index:
    """``rows`` (shard, term, df, top, docs, impacts; under a null term the shard's doc_ids), N and L of the collection."""

    rows: DataFrame
    n: int
    total: int


INDEX = "shard long, term string, df long, top long, docs array<int>, impacts array<int>"


def build_index(docs: DataFrame, shard_docs: int = SHARD_DOCS, slice_docs: int = SLICE_DOCS) -> Index:
    """Index of all terms of all documents (doc_id, text), written as a table in the shared folder."""
    source = docs.select("doc_id", "text")
    tree = docs.sparkSession.sparkContext.broadcast(fit_tree(source))

    @tidy
    def place(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                codes, names, offsets = terms(part.column("text"))
                doc = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                pairs = np.unique(doc * max(len(names), 1) + codes)
                leaf = tree.value.leaves(pairs // max(len(names), 1), word_hashes(names)[pairs % max(len(names), 1)], part.num_rows)
                counts = np.diff(offsets)
                out = pa.RecordBatch.from_arrays([*part.columns, pa.array(counts), pa.array(leaf.astype(np.int32))], names=["doc_id", "text", "n", "leaf"])
                yield out.filter(pa.array(counts > 0))

    placed = stash(source.mapInArrow(place, StructType([*source.schema.fields, *StructType.fromDDL("n long, leaf int").fields])), "placed")
    leaves = placed.groupBy("leaf").agg(F.count("*").alias("docs"), F.sum("n").alias("terms"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    n, total = sum(r["docs"] for r in leaves), sum(r["terms"] for r in leaves)
    parts = {r["leaf"]: max(1, -(-r["docs"] // slice_docs), -(-r["bytes"] // SLICE_BYTES)) for r in leaves}
    before = {leaf: sum(parts[x] for x in parts if x < leaf) for leaf in parts}
    numbers = F.create_map(*[F.lit(x) for leaf in sorted(parts) for x in (leaf, F.struct(F.lit(before[leaf]).alias("first"), F.lit(parts[leaf]).alias("parts")))]) if parts else F.lit(None)
    own = F.element_at(numbers, F.col("leaf")) if parts else F.struct(F.lit(0).alias("first"), F.lit(1).alias("parts"))
    # numbers drawn from a seed over a written table are the same for a task that runs again
    sliced = placed.select("doc_id", "text", "n", (own["first"] + F.floor(F.rand(3) * own["parts"])).cast("long").alias("slice"))
    schema = StructType([*StructType.fromDDL(INDEX).fields, StructField("doc_ids", ArrayType(source.schema["doc_id"].dataType))])

    def cluster(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Shards of a slice: numbers from the slice's number times a bound, so that no two slices share one."""
        first = key[0].as_py() << 24
        texts = pa.concat_arrays([c.cast(pa.string()) for c in table["text"].chunks])
        codes, names, offsets = terms(texts)
        doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
        pairs, tf = np.unique(doc * len(names) + codes, return_counts=True)
        doc, term = pairs // len(names), pairs % len(names)
        ranked = order(doc, term, len(texts), shard_docs)
        place = np.empty(len(texts), np.int64)
        place[ranked] = np.arange(len(texts))
        m = 100 - 25 + (25 * table["n"].to_numpy() * n) // total
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
        shard, within = place[doc] // shard_docs, place[doc] % shard_docs
        rows = np.lexsort((within, term, shard))
        shard, term, within, impact = shard[rows], term[rows], within[rows], impact[rows]
        starts = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (term[1:] != term[:-1])]))
        ends = np.append(starts, len(shard)).astype(np.int32)
        postings = pa.table({
            "shard": first + shard[starts], "term": names.take(pa.array(term[starts])), "df": np.diff(ends).astype(np.int64), "top": np.maximum.reduceat(impact, starts),
            "docs": pa.ListArray.from_arrays(ends, within.astype(np.int32)), "impacts": pa.ListArray.from_arrays(ends, impact.astype(np.int32)),
        })
        ids = pa.concat_arrays(table["doc_id"].chunks).take(pa.array(ranked))
        cuts = np.append(np.arange(0, len(ids), shard_docs), len(ids)).astype(np.int32)
        members = pa.table({"shard": first + np.arange(len(cuts) - 1), "doc_ids": pa.ListArray.from_arrays(cuts, ids)})
        return pa.concat_tables([postings, members], promote_options="default").select(schema.names)

    rows = stash(sliced.groupBy("slice").applyInArrow(cluster, schema), "index")
    return Index(rows, n, total)


def query_terms(items: DataFrame) -> DataFrame:
    """(query, item_id, term, repeats) of the terms of ``items`` (item_id, text); every row is a query of its own."""
    source = stash(items.select(F.monotonically_increasing_id().alias("query"), "item_id", "text"), "items")

    @tidy
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                codes, names, offsets = terms(part.column("text"))
                item = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                pairs, repeats = np.unique(item * max(len(names), 1) + codes, return_counts=True)
                at, code = pa.array(pairs // max(len(names), 1)), pa.array(pairs % max(len(names), 1))
                yield pa.RecordBatch.from_arrays([part.column("query").take(at), part.column("item_id").take(at), names.take(code), pa.array(repeats.astype(np.int64))], names=["query", "item_id", "term", "repeats"])

    fields = [*source.drop("text").schema.fields, *StructType.fromDDL("term string, repeats long").fields]
    return source.mapInArrow(run, StructType(fields))


def search(index: Index, items: DataFrame, k: int = 20, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` documents of the highest scores above 0 of each item, equal scores by doc_id.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); a document's m is 75 + 25 n N div L; the score is the sum over the item's
    terms, repeats included, of the weight times 10^9 tf div (1000 tf + 12 m), in 64-bit integers."""
    asked = stash(query_terms(items), "asked")
    blocks = max(1, -(-asked.agg(F.count_distinct("query")).first()[0] // QUERY_BLOCK))
    postings = index.rows.where("term IS NOT NULL").join(asked.select("term").distinct(), "term")
    held = postings.groupBy("term").agg(F.sum("df").alias("held"))
    weight = F.floor(1000 * F.log((2.0 * index.n + 2) / (2 * F.col("held") + 1)))
    asked = stash(asked.join(held, "term").select("query", "item_id", "term", (F.col("repeats") * weight).alias("weight")).where("weight > 0"), "weighed")
    tops = index.rows.where("term IS NOT NULL").select("shard", "term", "top")
    bounds = stash(tops.join(asked, "term").groupBy("query", "shard").agg(F.sum(F.col("weight") * F.col("top")).alias("bound")), "bounds")
    best_first = Window.partitionBy("query").orderBy(F.desc("bound"), "shard")
    head = stash(bounds.withColumn("place", F.row_number().over(best_first)).where(F.col("place") <= rounds[-1]), "head")
    past = head.groupBy("query").agg(F.max(F.struct("place", "bound", "shard")).alias("last"), F.count("*").alias("n")).where(F.col("n") == rounds[-1])
    rest = bounds.join(past, "query").where("bound < last.bound OR (bound = last.bound AND shard > last.shard)").select("query", "shard", "bound")
    terms_of = asked.groupBy("query").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))

    found, before = None, 0
    for upto in (*rounds, None):
        visits = (head.where((F.col("place") > before) & (F.col("place") <= upto)) if upto else rest).select("query", "shard", "bound")
        if found is None:
            visits = visits.withColumn("least", F.lit(1).cast("long"))
        else:
            floors = found.groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("n")).select("query", F.when(F.col("n") >= k, F.col("least")).otherwise(1).alias("least"))
            visits = visits.join(floors, "query", "left").fillna(1, ["least"]).where("bound >= least")
        more = _visit(index, postings, visits.join(terms_of, "query"), blocks, k)
        place = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        merged = more if found is None else found.unionByName(more)
        found = stash(merged.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).drop("rank") if upto else merged, "found")
        before = upto
    place = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    names = asked.select("query", "item_id").distinct()
    return ranked.join(names, "query").select("item_id", "rank", "doc_id", "score")


def _visit(index: Index, postings: DataFrame, visits: DataFrame, blocks: int, k: int) -> DataFrame:
    """(query, doc_id, score) of the ``k`` best of each shard that a query visits, with scores of at least ``least``.

    A shard's postings meet its visits, in blocks of queries, in one task; both are bounded."""
    fields = index.rows.schema
    ids = fields["doc_ids"].dataType.elementType
    wanted = visits.select("shard").distinct()
    held = postings.select("shard", "term", "docs", "impacts", F.lit(None).cast(fields["doc_ids"].dataType).alias("doc_ids"))
    held = held.unionByName(index.rows.where("term IS NULL").select("shard", "term", "docs", "impacts", "doc_ids")).join(wanted, "shard", "left_semi")
    block = F.pmod(F.xxhash64("query"), F.lit(blocks))
    held = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    out = StructType([StructField("query", visits.schema["query"].dataType), StructField("doc_id", ids), *StructType.fromDDL("score long").fields])

    def score(shard: pa.Table, asked: pa.Table) -> pa.Table:
        members = shard["doc_ids"].drop_null()
        if not len(members) or not len(asked):
            return pa.table({"query": pa.array([], pa.int64()), "doc_id": pa.array([], shard.schema.field("doc_ids").type.value_type), "score": pa.array([], pa.int64())})
        doc_ids = members[0].values
        by_id = np.empty(len(doc_ids), np.int64)
        by_id[pc.sort_indices(doc_ids).to_numpy()] = np.arange(len(doc_ids))  # nulls come last
        lists = shard.filter(pc.is_valid(shard["term"]))
        docs, impacts = (pa.concat_arrays(lists[c].chunks) for c in ("docs", "impacts"))
        row = {t: i for i, t in enumerate(lists["term"].to_pylist())}
        dense = np.zeros((len(row), len(doc_ids)), np.int64)
        dense[np.repeat(np.arange(len(row)), pc.list_value_length(docs).to_numpy(zero_copy_only=False)), docs.flatten().to_numpy()] = impacts.flatten().to_numpy()
        picked: list[np.ndarray] = []
        scores: list[np.ndarray] = []
        for names, weights, least in zip(asked["terms"].to_pylist(), asked["weights"].to_pylist(), asked["least"].to_pylist(), strict=True):
            own = [(row[t], w) for t, w in zip(names, weights, strict=True) if t in row]
            at, by = (np.array(x, np.int64) for x in zip(*own, strict=True)) if own else (np.zeros(0, np.int64),) * 2
            total = by @ dense[at]
            enough = np.flatnonzero(total >= least)
            enough = enough[np.lexsort((by_id[enough], -total[enough]))][:k]
            picked.append(enough)
            scores.append(total[enough])
        query = np.repeat(np.arange(len(asked)), [len(x) for x in picked])
        return pa.table({"query": asked["query"].take(pa.array(query)), "doc_id": doc_ids.take(pa.array(np.concatenate(picked))), "score": np.concatenate(scores)})

    visited = visits.withColumn("block", block)
    return held.groupBy("shard", "block").cogroup(visited.groupBy("shard", "block")).applyInArrow(score, out)
