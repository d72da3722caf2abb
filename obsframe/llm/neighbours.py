"""Approximate nearest neighbours: a graph by NN-descent, searched greedily."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.llm.tables import struct, written

#: Neighbours of a node (and links from others that it looks at besides) and nodes that a search keeps for each
#: query, up to FEW nodes; beyond, both grow with the 8th root of the number of nodes. Work in the graph serves all
#: queries, so its degree is large and the beam small.
DEGREE, BEAM, FEW = 32, 128, 10_000
#: Rows of a block in which the first graph is found, and orders in which blocks are cut.
BLOCK, ORDERS = 256, 8
#: A graph is done when under SETTLED of its links change in a turn; LIMIT turns without that are an error.
SETTLED, LIMIT = 0.01, 100
#: Edges that a task holds before it drops those that cannot be in the graph.
HELD = 2_000_000
PAIR = struct(query=T.LongType(), node=T.LongType(), distance=T.DoubleType())
EDGE = struct(node=T.LongType(), other=T.LongType(), distance=T.DoubleType())


def degree_of(nodes: int) -> int:
    return math.ceil(DEGREE * max(1.0, nodes / FEW) ** 0.125)


def beam_of(nodes: int) -> int:
    return math.ceil(BEAM * max(1.0, nodes / FEW) ** 0.125)


@F.arrow_udf(T.BinaryType())
def packed(vector: pa.Array) -> pa.Array:
    """Little-endian 64-bit floats of each vector; null for one that is null, zero or not finite throughout."""
    out = []
    for v in vector:
        x = np.array([np.nan if c is None else c for c in v.as_py()], "<f8") if v.is_valid else np.zeros(0)
        x = x + 0.0  # no negative zeros: equal vectors have equal bytes
        out.append(x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
    return pa.array(out, pa.binary())


@F.arrow_udf(T.BooleanType())
def short_enough(vector: pa.Array) -> pa.Array:
    """Whether 32-bit floats hold the vector without loss."""
    with np.errstate(over="ignore"):
        return pa.array([bool((x.astype("<f4") == x).all()) for x in (np.frombuffer(v, "<f8") for v in vector.to_pylist())], pa.bool_())


@F.arrow_udf(T.BinaryType())
def shortened(vector: pa.Array) -> pa.Array:
    """The same as 32-bit floats."""
    return pa.array([np.frombuffer(v, "<f8").astype("<f4").tobytes() for v in vector.to_pylist()], pa.binary())


def unpacked(rows: list[bytes], dims: int) -> np.ndarray:
    """Vectors of 32-bit or 64-bit floats in double precision."""
    kind = "<f4" if rows and len(rows[0]) == 4 * dims else "<f8"
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), dims).astype(float)


def squared(x: np.ndarray) -> np.ndarray:
    """Squared distances between all rows of one small block in double precision; where the expanded form cancels, by differences."""
    x = x - x[:1]
    norms = (x**2).sum(axis=1)
    sums = norms[:, None] + norms
    d = sums - 2 * x @ x.T
    a, b = np.nonzero(d < 1e-6 * sums)
    for i in range(0, len(a), 10_000):
        at = a[i : i + 10_000], b[i : i + 10_000]
        d[at] = ((x[at[0]] - x[at[1]]) ** 2).sum(axis=1)
    return np.maximum(d, 0)


def chance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each pair of ids, which decides between equal distances."""
    low, high = np.minimum(a, b).astype(np.uint64), np.maximum(a, b).astype(np.uint64)
    x = low * np.uint64(0x9E3779B97F4A7C15) ^ (high + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def nearest_in_block(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and squared distances of the ``k`` nearest other rows of each row, ties by chance."""
    d = squared(x)
    np.fill_diagonal(d, np.inf)
    k = min(k, len(ids) - 1)
    if not k:
        return np.zeros((len(ids), 0), int), np.zeros((len(ids), 0))
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    last = np.take_along_axis(d, near, 1).max(axis=1)
    for row in np.flatnonzero((d <= last[:, None]).sum(axis=1) > k):
        near[row] = np.lexsort((chance(ids[row], ids), d[row]))[:k]
    return near, np.take_along_axis(d, near, 1)


def pair_chance(a: str, b: str) -> Column:
    return F.xxhash64(F.least(a, b), F.greatest(a, b))


def projection(dims: int, seed: int) -> Column:
    """The place of a vector on one random line, inside one of the 16 cells that four others cut."""
    rng = np.random.default_rng(seed)
    cells, line = rng.standard_normal((dims, 4)), rng.standard_normal(dims)

    @F.arrow_udf(T.DoubleType())
    def place(vector: pa.Array) -> pa.Array:
        x = unpacked(vector.to_pylist(), dims)
        inside = x @ line
        return pa.array(((x @ cells > 0) * (1 << np.arange(4))).sum(axis=1) * 4.0 + np.tanh(inside / (np.abs(line).sum() + 1e-9) * 8))

    return place(F.col("vector"))


def block_edges(dims: int, degree: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The ``degree`` nearest of each row within its block of BLOCK rows (more if ``degree`` asks for it), which follow each other in order."""
    block = max(BLOCK, 4 * degree)

    def edges(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        near, d = nearest_in_block(ids, x, degree)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, near.shape[1])), pa.array(ids[near].ravel()), pa.array(d.ravel())], names=EDGE.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids, held = np.zeros(0, np.int64), []
        for batch in batches:
            held_ids = np.concatenate([held_ids, batch.column(0).to_numpy()])
            held += batch.column(1).to_pylist()
            while len(held) >= 2 * block:
                yield edges(held_ids[:block], unpacked(held[:block], dims))
                held_ids, held = held_ids[block:], held[block:]
        if held:
            yield edges(held_ids, unpacked(held, dims))

    return run


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest others of each node; ``fresh`` is kept true only for an edge that no earlier graph had."""
    once = edges.groupBy("node", "other").agg(F.min("distance").alias("distance"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("node").orderBy("distance", pair_chance("node", "other"), "other")
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")


def best(a: np.ndarray, b: np.ndarray, d: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``degree`` shortest different edges of each ``a``: no others of these can be in the graph."""
    order = np.lexsort((b, a))
    a, b, d = a[order], b[order], d[order]
    once = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    a, b, d = a[once], b[once], d[once]
    order = np.lexsort((chance(a, b), d, a))
    a, b, d = a[order], b[order], d[order]
    starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    place = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
    return a[place < degree], b[place < degree], d[place < degree]


def local_join(dims: int, degree: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges between the neighbours of one node that are shorter than the longest edge either has; rows come sorted by node."""

    def join(ids: np.ndarray, fresh: np.ndarray, worst: np.ndarray, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        if len(ids) < 2 or not fresh.any():
            return None
        d = squared(unpacked(rows, dims))
        useful = (fresh[:, None] | fresh) & (d < worst[:, None]) & (ids[:, None] != ids)
        a, b = np.nonzero(useful)
        return (ids[a], ids[b], d[a, b]) if len(a) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, tail = [], 0, []

        def drained() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in best(*(np.concatenate(x) for x in zip(*out)), degree)], names=EDGE.names)

        for batch in batches:
            node, ids, fresh, worst = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            rows = batch.column(4).to_pylist()
            if tail:
                node, ids, fresh, worst = (np.concatenate(x) for x in zip(tail[:4], (node, ids, fresh, worst)))
                rows = tail[4] + rows
            cuts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])).tolist()
            for a, b in zip(cuts, cuts[1:]):
                if found := join(ids[a:b], fresh[a:b], worst[a:b], rows[a:b]):
                    out.append(found)
                    held += len(found[0])
                if held > HELD:
                    yield from drained()
                    out, held = [], 0
            a = cuts[-1]
            tail = [node[a:], ids[a:], fresh[a:], worst[a:], rows[a:]]
        if tail and (found := join(*tail[1:])):
            out.append(found)
        yield from drained()

    return run


def with_back_links(graph: DataFrame, most: int) -> DataFrame:
    """(node, other, fresh): links of each node and up to ``most`` links to it, fresh and short ones first.

    A node that very many link to looks at a bounded number of them; each of those still has its link.
    """
    order = Window.partitionBy("node").orderBy(F.desc("fresh"), "distance", pair_chance("node", "other"), "other")
    back = graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "distance", "fresh")
    back = back.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    both = graph.select("node", "other", "fresh").unionByName(back.select("node", "other", "fresh"))
    return both.groupBy("node", "other").agg(F.max("fresh").alias("fresh"))


def build_graph(nodes: DataFrame, dims: int, degree: int) -> DataFrame:
    """(node, other, distance, fresh): about the ``degree`` nearest others of each of ``nodes`` (node, vector).

    The first graph comes from blocks of neighbours in several random orders, cut after a sort so
    that no block depends on how many vectors look alike. Each turn of NN-descent then joins every
    node's neighbours with each other, in both directions of links, where at least one link is new,
    and keeps what is shorter; turns end when under SETTLED of all links change.
    """
    first = None
    for seed in range(ORDERS):
        ordered = nodes.select("node", "vector", projection(dims, seed).alias("place")).repartitionByRange("place", "node").sortWithinPartitions("place", "node")
        found = ordered.select("node", "vector").mapInArrow(block_edges(dims, degree), EDGE)
        first = found if first is None else first.unionByName(found)
    graph = written(nearest(first.withColumn("fresh", F.lit(True)), degree))
    for _ in range(LIMIT):
        worst = graph.groupBy(F.col("node").alias("of")).agg(F.max("distance").alias("worst"), F.count(F.lit(1)).alias("links"))
        worst = worst.select("of", F.when(F.col("links") < degree, F.lit(float("inf"))).otherwise(F.col("worst")).alias("worst"))
        members = with_back_links(graph, degree).join(nodes.join(worst, F.col("node") == F.col("of")).select(F.col("of").alias("member"), "worst", "vector"), F.col("other") == F.col("member"))
        groups = members.select("node", "other", "fresh", "worst", "vector").repartition("node").sortWithinPartitions("node")
        better = groups.mapInArrow(local_join(dims, degree), EDGE).withColumn("fresh", F.lit(True))
        old = graph.withColumn("fresh", F.lit(False))
        observed = Observation()
        graph = written(nearest(old.unionByName(better), degree).observe(observed, F.count_if("fresh").alias("changed"), F.count(F.lit(1)).alias("links")))
        changed, links = observed.get["changed"], observed.get["links"]
        if changed <= SETTLED * links:
            return graph
    raise RuntimeError(f"the graph of neighbours still changes after {LIMIT} turns: {changed} of {links} links in the last")


def pair_distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, node, distance) of the pairs of one part after the other.

    Rows come sorted by part and kind: the part's node vectors, then query vectors, then pairs.
    """
    part, ids, rows = None, ([], []), ([], [])
    sets: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        parts, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], (parts[1:] != parts[:-1]) | (kinds[1:] != kinds[:-1])])).tolist() + [len(parts)]
        for a, b in zip(cuts, cuts[1:]) if len(parts) else ():
            if parts[a] != part:
                part, ids, rows, sets = parts[a], ([], []), ([], []), []
            if kinds[a] < 2:
                ids[kinds[a]].append(batch.column(2)[a:b].to_numpy())
                rows[kinds[a]].extend(batch.column(4)[a:b].to_pylist())
                continue
            if not sets:
                for own, vectors in zip(ids, rows):
                    own = np.concatenate(own)
                    order = np.argsort(own)
                    sets.append((own[order], np.frombuffer(b"".join(vectors), "<f8").reshape(len(own), -1)[order]))
            for c in range(a, b, 50_000):
                e = min(b, c + 50_000)
                query, node = batch.column(2)[c:e].to_numpy(), batch.column(3)[c:e].to_numpy()
                x, y = (x[np.searchsorted(own, k)] for (own, x), k in zip(sets, (node, query)))
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(node), pa.array(np.sqrt(((x - y) ** 2).sum(axis=1)))], names=PAIR.names)


def measured(pairs: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, node, distance) of ``pairs``, Euclidean in double precision.

    Pairs meet both vectors in a part of the nodes; a query's vector goes once to each part in which
    it has a pair, instead of once with every pair.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int").alias("part")
    asked = pairs.select(part, "query", "node")
    needed = asked.select("part", "query").distinct().join(queries, "query")
    blank = F.lit(None).cast("binary")
    rows = vectors.select(part, F.lit(0).alias("kind"), F.col("node").alias("a"), F.lit(0).cast("long").alias("b"), F.col("exact").alias("vector"))
    rows = rows.unionByName(needed.select("part", F.lit(1).alias("kind"), F.col("query").alias("a"), F.lit(0).cast("long").alias("b"), F.col("target").alias("vector")))
    rows = rows.unionByName(asked.select("part", F.lit(2).alias("kind"), F.col("query").alias("a"), F.col("node").alias("b"), blank.alias("vector")))
    return rows.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(pair_distances, PAIR)


def search(graph: DataFrame, vectors: DataFrame, starts: DataFrame, beam: int, degree: int) -> DataFrame:
    """(query, node, distance): the ``beam`` nearest nodes found for each query by greedy search.

    ``vectors``: (node, exact) of all nodes; ``starts``: (query, target, node), the query's vector and
    a node to begin at. In each turn the nearest half of a query's beam, of the nodes that were not
    looked at yet, is expanded together; a query ends when its beam holds none.
    """
    width = -(-beam // 2)
    links = written(with_back_links(graph, degree).select("node", "other"))
    queries = written(starts.groupBy("query").agg(F.first("target").alias("target")))
    order = Window.partitionBy("query").orderBy("distance", "node")
    nearest_first = Window.partitionBy("query").orderBy("seen", "distance", "node")

    def kept(found: DataFrame) -> tuple[DataFrame, int]:
        """The beams, and how many nodes of them are to be expanded next."""
        held = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= beam).drop("place")
        observed = Observation()
        held = held.withColumn("next", ~F.col("seen") & (F.row_number().over(nearest_first) <= width))
        held = written(held.observe(observed, F.count_if("next").alias("ahead")))
        return held, observed.get["ahead"]

    state, left = kept(measured(starts.select("query", "node").distinct(), vectors, queries).withColumn("seen", F.lit(False)))
    while left:
        ahead = state.filter("next").select("query", "node").join(links, "node").select("query", F.col("other").alias("node")).distinct()
        ahead = ahead.join(state.select("query", "node"), ["query", "node"], "left_anti")
        new = measured(ahead, vectors, queries).withColumn("seen", F.lit(False))
        state, left = kept(state.select("query", "node", "distance", (F.col("seen") | F.col("next")).alias("seen")).unionByName(new))
    return state.select("query", "node", "distance")


def nearest_rows(rows: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", beam: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest other rows found for each row that ``queries`` selects.

    Nearest first by Euclidean distance in double precision, ties to the smaller id; all rows if
    there are fewer. Vectors that are null, zero or hold a null or a non-finite component take no
    part, nor do rows without id or of another length than most; rows that share an id count as the
    one of least bytes; other columns are left out; an empty table gives no rows.

    Equal vectors are one node of the graph, so a vector that many rows share neither fills the
    lists of others nor hides ties: each node keeps its k + 1 smallest ids, all that a result can
    name. Links and beam grow with the number of nodes. Recall against brute force is measured in tests.
    """
    given = rows.select(F.col(id_col).cast("long").alias("id"), packed(F.col(vector_col).cast("array<double>")).alias("exact"), queries.alias("asked"))
    given = given.filter(F.col("id").isNotNull() & F.col("exact").isNotNull()).groupBy("id").agg(F.min("exact").alias("exact"), F.max("asked").alias("asked"))
    given = written(given)
    lengths = given.groupBy(F.length("exact").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    size = lengths[0]["size"] if lengths else 8
    given = given.filter(F.length("exact") == size)
    nodes = written(given.groupBy("exact").agg(F.min("id").alias("node")).select("node", "exact"))
    n, short = nodes.agg(F.count(F.lit(1)), F.bool_and(short_enough(F.col("exact")))).first()
    degree, beam = degree_of(n), beam or beam_of(n)
    vector = shortened(F.col("exact")) if short else F.col("exact")
    graph = build_graph(nodes.select("node", vector.alias("vector")), size // 8, degree)
    placed = given.join(nodes.select("node", F.col("exact").alias("same")), F.col("exact") == F.col("same")).select("id", "asked", "exact", "node")
    of_node = Window.partitionBy("node").orderBy("id")
    members = written(placed.select("node", "id").withColumn("place", F.row_number().over(of_node)).filter(F.col("place") <= k + 1).drop("place"))
    starts = placed.filter("asked").select(F.col("id").alias("query"), F.col("exact").alias("target"), "node")
    found = search(graph, nodes.select("node", "exact"), starts, beam, degree).join(members, "node").filter(F.col("id") != F.col("query"))
    order = Window.partitionBy("query").orderBy("distance", "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), F.col("distance").alias("score"))
