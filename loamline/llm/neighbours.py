"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

The graph holds one node per distinct vector. Random hyperplane leaves give first neighbours; then each round joins every
node's sampled neighbours, both ways, to the node, compares neighbours of neighbours there, and sends each node what
improves its list (Dong, Moses, Li, 2011). Vectors travel as bytes in the precision of their column, and graph and search
rank by distances of these in double precision, so near-equal vectors keep their order. A search keeps a beam of the best nodes for each query and, in rounds, joins the
beam's unexpanded nodes to the graph until none is left, so it ends as a sequential greedy search does.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.common import cut, release, tidy

LEAF = 256
PAIRS = 4096


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def precision(vectors: DataFrame) -> str:
    """NumPy type that holds the components of column ``embedding`` without loss."""
    return "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"


def to_codes(x: np.ndarray, kind: str) -> list[bytes]:
    """Each row as the bytes of its components."""
    return [row.tobytes() for row in x.astype(kind)]


def from_codes(values: list[bytes], kind: str) -> np.ndarray:
    """Rows again, in double precision."""
    if not values:
        return np.zeros((0, 0))
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1).astype(np.float64)


def squared_distances(x: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs of rows; pairs in which norms and product would cancel are measured by differences."""
    norm = (x * x).sum(1)
    sums = norm[:, None] + norm[None]
    d = sums - 2 * x @ x.T
    a, b = np.nonzero(np.triu(~(d >= 1e-6 * sums), 1))
    for k in range(0, len(a), PAIRS):
        i, j = a[k : k + PAIRS], b[k : k + PAIRS]
        d[i, j] = d[j, i] = ((x[i] - x[j]) ** 2).sum(1)
    np.fill_diagonal(d, 0)
    return d


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, vec array<double>) that take part: not null or zero, all components finite."""
    vec = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where("vec_id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0").where(finite & F.exists("vec", lambda x: x != 0))


def distinct_nodes(rows: DataFrame, keep: int, salts: int = 16) -> tuple[DataFrame, DataFrame]:
    """(nodes: node, vec; members: node, vec_id, the ``keep`` least of each). The least vec_id of equal vectors is the node.

    Members are cut to ``keep`` by salt first, so a vector that many rows hold meets no task as a whole."""
    same = F.xxhash64("vec")
    keyed = rows.withColumn("same", same)
    salted = Window.partitionBy("same", "vec", F.pmod(F.xxhash64("vec_id"), F.lit(salts))).orderBy("vec_id")
    some = keyed.withColumn("n", F.row_number().over(salted)).where(F.col("n") <= keep).drop("n")
    whole = Window.partitionBy("same", "vec").orderBy("vec_id")
    ranked = some.withColumns({"n": F.row_number().over(whole), "node": F.first("vec_id").over(whole)}).where(F.col("n") <= keep)
    ranked = cut(ranked.select("node", "vec_id", "vec", "n"))
    return ranked.where("n = 1").select("node", "vec"), ranked.select("node", "vec_id")


def _leaves(nodes: DataFrame, kind: str, count: int, trees: int, each: int) -> DataFrame:
    """First edges (v, u, d): the ``each`` nearest in the same leaf of random hyperplane trees; leaves are split at ``LEAF`` by id hash."""
    bits = max(0, int(np.log2(max(count, 1) / LEAF)))
    # planes go through the mean, a number for each dimension
    means = nodes.select(F.posexplode("vec").alias("at", "x")).groupBy("at").agg(F.avg("x")).collect()
    centre = np.array([m for _, m in sorted(map(tuple, means))])

    def assign(batches):
        for batch in batches:
            x = matrix(batch.column("vec"))
            node, codes = batch.column("node").to_numpy(), to_codes(x, kind)
            unit = (x - centre) / np.maximum(np.abs(x - centre).max(1, keepdims=True), 1e-300) if x.size else x
            for tree in range(trees):
                planes = np.random.default_rng([tree, x.shape[1] if x.size else 0]).normal(size=(x.shape[1], bits)).astype(np.float32)
                key = ((unit @ planes > 0) @ (1 << np.arange(bits))).astype(np.int64) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), tree, np.int32)), pa.array(key), pa.array(node), pa.array(codes)], ["tree", "leaf", "v", "code"])

    placed = nodes.mapInArrow(tidy(assign), "tree int, leaf long, v long, code binary")
    sizes = placed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / LEAF).cast("int").alias("parts"))
    # sizes have a row per leaf: two to the power of ``bits`` of them in each tree, a 256th of the nodes
    parts = placed.join(sizes, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("v", "tree"), F.col("parts")).cast("int"))

    def nearest(groups):
        for batch in groups:
            v, x = batch.column("v").to_numpy(), from_codes(batch.column("code").to_pylist(), kind)
            if len(v) < 2:
                continue
            d = squared_distances(x)
            np.fill_diagonal(d, np.inf)
            k = min(each, len(v) - 1)
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            far = np.take_along_axis(d, near, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(v, k)), pa.array(v[near].ravel()), pa.array(far.ravel())], ["v", "u", "d"])

    spread = parts.repartition("tree", "leaf", "part").sortWithinPartitions("tree", "leaf", "part").select("tree", "leaf", "part", "v", "code")
    return spread.mapInArrow(tidy(lambda batches: nearest(runs(batches, ["tree", "leaf", "part"]))), "v long, u long, d double")


def runs(batches, keys: list[str]):
    """Regroup sorted batches into one batch for each run of equal keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change), [batch.num_rows]])
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if held and (a > 0 or any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys)):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _nearest_lists(edges: DataFrame, degree: int) -> DataFrame:
    """(v, nb: array of (d, u, new)): the ``degree`` nearest of each v among edges (v, u, d, new); an edge seen before is not new."""
    own = edges.repartition("v").groupBy("v", "u").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    ranked = own.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("d", "u"))).where(F.col("n") <= degree)
    return ranked.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("d", "u", "new"))).alias("nb"))


def _local_join(kind: str):
    """Compare each centre's sampled members: pairs with a new one, in which one improves the other's list."""

    def run(batches):
        for batch in runs(batches, ["centre"]):
            member = batch.column("member").to_numpy()
            _, first = np.unique(member, return_index=True)
            if len(first) < 2:
                continue
            member, x = member[first], from_codes([batch.column("code")[int(i)].as_py() for i in first], kind)
            new = np.zeros(len(first), bool)
            new[np.searchsorted(member, batch.column("member").to_numpy()[batch.column("new").to_numpy(zero_copy_only=False)])] = True
            worst = batch.column("worst").to_numpy()[first]
            d = squared_distances(x)
            take = (new[:, None] | new[None]) & (d < worst[:, None])
            np.fill_diagonal(take, False)
            a, b = np.nonzero(take)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(member[a]), pa.array(member[b]), pa.array(d[a, b])], ["v", "u", "d"])

    return run


def coded(nodes: DataFrame, kind: str) -> DataFrame:
    """(id, code) of ``nodes``."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(to_codes(matrix(batch.column("vec")), kind), pa.binary())], ["id", "code"])

    return cut(nodes.mapInArrow(tidy(run), "id long, code binary"))


def build_graph(nodes: DataFrame, codes: DataFrame, kind: str, count: int, degree: int = 30, sample: int = 12, trees: int = 6, rounds: int = 4, least_share: float = 0.02) -> DataFrame:
    """Neighbour graph (v, nb: array of (d, u, new)) of ``nodes`` (node, vec): about the ``degree`` nearest of each.

    Rounds end after ``rounds``, or when they change fewer than ``least_share`` of the list entries."""
    first = _leaves(nodes, kind, count, trees, min(10, degree)).withColumn("new", F.lit(True))
    graph = cut(_nearest_lists(first, degree))
    for number in range(rounds):

        def drawn(wanted: bool, number=number):
            """A sample of the list's new or old entries, by hash, so that a task that runs again draws the same."""
            some = F.filter("nb", lambda e: e["new"] == F.lit(wanted))
            order = F.array_sort(F.transform(some, lambda e: F.struct(F.xxhash64("v", e["u"], F.lit(number)).alias("h"), e["u"].alias("u"))))
            return F.transform(F.slice(order, 1, sample), lambda e: F.struct(e["u"].alias("u"), F.lit(wanted).alias("new")))

        # a list that is not full takes any distance
        worst = F.when(F.size("nb") < degree, F.lit(float("inf"))).otherwise(F.element_at("nb", -1)["d"])
        drawn_rows = graph.select("v", "nb", worst.alias("worst"), drawn(True).alias("fresh"), drawn(False).alias("stale"))
        info = codes.join(drawn_rows.select(F.col("v").alias("id"), "worst"), "id", "left").withColumn("worst", F.coalesce("worst", F.lit(float("inf"))))
        links = drawn_rows.select("v", F.explode(F.concat("fresh", "stale")).alias("e")).select("v", F.col("e.u").alias("u"), F.col("e.new").alias("new"))
        back = Window.partitionBy("u", "new").orderBy(F.xxhash64("u", "v", F.lit(number)))
        back_links = links.withColumn("n", F.row_number().over(back)).where(F.col("n") <= sample)
        both = links.select(F.col("v").alias("centre"), F.col("u").alias("id"), "new").union(back_links.select("u", "v", "new"))
        members = both.join(info, "id").select("centre", F.col("id").alias("member"), "new", "code", "worst")
        spread = members.repartition("centre").sortWithinPartitions("centre")
        proposed = spread.mapInArrow(tidy(_local_join(kind)), "v long, u long, d double").withColumn("new", F.lit(True))
        taken = F.transform("fresh", lambda e: e["u"])
        kept = drawn_rows.select("v", F.explode("nb").alias("e"), taken.alias("taken")).select(
            "v", F.col("e.u").alias("u"), F.col("e.d").alias("d"), (F.col("e.new") & ~F.array_contains("taken", F.col("e.u"))).alias("new"),
            F.lit(False).alias("came"),
        )
        graph = cut(_nearest_lists(kept.drop("came").union(proposed), degree))
        release(nodes.sparkSession)
        fresh = graph.select(F.sum(F.size(F.filter("nb", lambda e: e["new"]))).alias("n")).first()[0] or 0
        if fresh < least_share * count * degree:
            break
    return graph


def adjacency(graph: DataFrame, degree: int) -> DataFrame:
    """(v, near: ids): lists with the nearest ``2 * degree`` reverse links added, which keeps far nodes reachable."""
    links = graph.select("v", F.explode("nb").alias("e")).select("v", F.col("e.u").alias("u"), F.col("e.d").alias("d"))
    order = Window.partitionBy("u").orderBy("d", "v")
    back = links.withColumn("n", F.row_number().over(order)).where(F.col("n") <= 2 * degree).select(F.col("u").alias("v"), F.col("v").alias("u"))
    return links.select("v", "u").union(back).groupBy("v").agg(F.collect_set("u").alias("near"))


STATE = "query long, code binary, ids array<long>, ds array<double>, open array<boolean>, seen array<long>, want array<long>"


def _merge(kind: str, beam: int, spread: int):
    """Measure a query's new nodes, keep the best ``beam``, and choose what to expand: the nearest ``spread`` unexpanded."""
    names = [c.split()[0] for c in STATE.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches):
        for batch in runs(batches, ["query"]):
            states = batch.column("ids").is_valid().to_numpy(zero_copy_only=False)
            at = int(np.flatnonzero(states)[0])
            code = batch.column("code")[at].as_py()
            take = lambda name, kind: np.array(batch.column(name)[at].as_py(), kind)
            ids, ds, free, seen = take("ids", np.int64), take("ds", np.float64), take("open", bool), take("seen", np.int64)
            more = batch.filter(pa.array(~states))
            node, first = np.unique(more.column("node").to_numpy(), return_index=True)
            some = ~np.isin(node, seen)
            node, first = node[some], first[some]
            if len(node):
                y = from_codes(more.column("code").take(pa.array(first)).to_pylist(), kind)
                ids, ds = np.concatenate([ids, node]), np.concatenate([ds, ((y - from_codes([code], kind)) ** 2).sum(1)])
                free, seen = np.concatenate([free, np.ones(len(node), bool)]), np.union1d(seen, node)
            best = np.lexsort((ids, ds))[:beam]
            ids, ds, free = ids[best], ds[best], free[best]
            want = np.flatnonzero(free)[:spread]
            free[want] = False
            row = [[batch.column("query")[at].as_py()], [code], [ids], [ds], [free], [seen], [ids[want]]]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(row, kinds, strict=True)], names)

    return run


def _begin(starts: list[tuple[int, bytes]], kind: str, spread: int):
    """States of queries (query, node, code) before their first step: their own nodes and ``starts`` (id, code), all measured."""
    names = [c.split()[0] for c in STATE.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    entry, y = np.array([x[0] for x in starts], np.int64), from_codes([x[1] for x in starts], kind)

    def run(batches):
        for batch in batches:
            rows = []
            for query, node, code in zip(*(batch.column(c).to_pylist() for c in ("query", "node", "code")), strict=True):
                ids, ds = entry, ((y - from_codes([code], kind)) ** 2).sum(1)
                if node is not None:
                    ids, ds = np.append(ids[entry != node], node), np.append(ds[entry != node], 0.0)
                by = np.lexsort((ids, ds))
                rows.append((query, code, ids[by], ds[by], np.arange(len(ids)) >= spread, np.sort(ids), ids[by][:spread]))
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def search(queries: DataFrame, codes: DataFrame, near: DataFrame, kind: str, beam: int = 192, spread: int = 192, entries: int = 32) -> DataFrame:
    """Greedy graph search: (query, ids) with the ``beam`` nearest nodes found for each of ``queries`` (query, node, code).

    A search begins at ``entries`` nodes drawn by hash, which all queries share and are shipped with the code, and at the
    query's own ``node`` if it has one. It goes on until its beam has no unexpanded node; queries that are done stay out
    of later rounds. Each round expands nodes that were not expanded before, so there is a last one."""
    starts = [tuple(r) for r in codes.select("id", "code").orderBy(F.xxhash64("id"), "id").limit(entries).collect()]
    state = cut(queries.select("query", "node", "code").mapInArrow(tidy(_begin(starts, kind, spread)), STATE))
    empty = {"ids": "array<long>", "ds": "array<double>", "open": "array<boolean>", "seen": "array<long>"}
    done = state.where(F.size("want") == 0).select("query", "ids")
    for number in itertools.count(1):
        going = state.where(F.size("want") > 0)
        if going.isEmpty():
            return done
        reached = going.select("query", F.explode("want").alias("v")).join(near, "v").select("query", F.explode("near").alias("node"))
        sets = reached.groupBy("query").agg(F.collect_set("node").alias("nodes")).join(going.select("query", "seen"), "query")
        asked = sets.select("query", F.explode(F.array_except("nodes", "seen")).alias("node"))
        measured = asked.join(codes, asked["node"] == codes["id"]).select("query", "code", *[F.lit(None).cast(t).alias(n) for n, t in empty.items()], "node")
        rows = going.select("query", "code", *empty, F.lit(None).cast("long").alias("node")).union(measured)
        state = cut(rows.repartition("query").sortWithinPartitions("query").mapInArrow(tidy(_merge(kind, beam, spread)), STATE))
        done = done.union(state.where(F.size("want") == 0).select("query", "ids"))
        if number % 4 == 0:
            release(queries.sparkSession)


def measured(found: DataFrame, nodes: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """(query, node, d): squared distances in double precision from the original vectors, the ``most`` nearest of each ``found`` list."""
    pairs = found.select("query", F.explode("ids").alias("node")).join(nodes, "node").select("query", "node", "vec", F.lit(False).alias("asks"))
    rows = pairs.union(queries.select("query", F.lit(None).cast("long"), "vec", F.lit(True)))

    def run(batches):
        for batch in runs(batches, ["query"]):
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            x, y = matrix(batch.filter(pa.array(asks)).column("vec"))[:1], batch.filter(pa.array(~asks))
            node, d = y.column("node").to_numpy(), ((matrix(y.column("vec")) - x) ** 2).sum(1) if y.num_rows else np.zeros(0)
            best = np.lexsort((node, d))[:most]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("query")[0].as_py(), len(best)), pa.int64()), pa.array(node[best], pa.int64()), pa.array(d[best])], ["query", "node", "d"])

    return rows.repartition("query").sortWithinPartitions("query").mapInArrow(tidy(run), "query long, node long, d double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, degree: int = 30, rounds: int = 4, beam: int = 192) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` (vec_id, embedding) for each row of ``queries`` (a subset of them): query_id, rank, vec_id, score.

    Score is the Euclidean distance in double precision; ties go to the smaller vec_id; a query's own row is no
    candidate. Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite components, take no
    part, on either side. Equal vectors are one node and all are found together. With fewer than k candidates all are
    returned. Repeated ids with equal vectors are one row; an id with different vectors is a candidate with each. Rows of
    another length than the most common are not comparable and raise an error; other columns are ignored."""
    rows = usable(vectors).distinct()
    nodes, members = distinct_nodes(rows, k + 1)
    count, kind = nodes.count(), precision(vectors)
    codes = coded(nodes, kind)
    near = cut(adjacency(build_graph(nodes, codes, kind, count, degree=degree, rounds=rounds), degree))
    release(vectors.sparkSession)
    asked = usable(queries).distinct().select(F.col("vec_id").alias("query_id"), "vec")
    known = asked.join(nodes.select("node", F.col("vec").alias("same")), asked["vec"] == F.col("same"), "left")
    # queries with equal vectors are searched once
    begun = cut(known.where("node IS NOT NULL").select(F.col("node").alias("query"), "node", "vec").dropDuplicates(["query"]))
    found = search(begun.join(codes, begun["query"] == codes["id"]).select("query", "node", "code"), codes, near, kind, beam=max(beam, 2 * k))
    pairs = measured(found, nodes, begun.select("query", "vec"), k + 1)
    hits = known.select("query_id", F.col("node").alias("query")).join(pairs, "query").join(members, "node").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy("d", "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.sqrt("d").alias("score"))
