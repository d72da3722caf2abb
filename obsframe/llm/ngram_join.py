"""Exact Jaccard self-join of word shingles by vertical partitioning of the global n-gram order.

N-grams are ordered by the number of distinct sets that hold them, then by hash. Fragments of n-gram
space are counted apart, each from the segments that all sets have in it. A set then keeps the
n-grams that other sets hold too, and its prefix in that order: two sets that reach the threshold
share an n-gram of both prefixes. The overlap of such a pair is counted in each fragment of the order
by itself and summed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.llm.encode import ragged
from obsframe.llm.graphs import components
from obsframe.llm.shingles import SLICE, set_keys, shingle_sets
from obsframe.llm.tables import flat, forget_kept, slices, struct, written

SIZE, PERCENT = 5, 80
#: Words of 64 bits in the bitmap of a set, by which pairs are set aside without their n-grams.
BITMAP = 8
#: Fragments of the order for pairs: n-grams of 2-3, 4-7, 8-15, ... sets.
FRAGMENTS = 8
#: Bytes of text for each fragment of n-gram space; a fragment holds about three times as many.
FRAGMENT_BYTES = 16 << 20
#: N-grams of a set that lead it to pivots before the exact join.
PROBES = 3
#: N-grams of a fragment that are sorted at a time, to find those that several sets hold.
COUNTED = 1 << 18

SET = struct(n_shingles=T.LongType(), set_key=T.LongType())
SEGMENTS = struct(fragment=T.IntegerType(), keys=T.BinaryType(), sizes=T.BinaryType(), lengths=T.BinaryType(), grams=T.BinaryType(), counts=T.BinaryType())
KEPT = struct(key=T.LongType(), n=T.LongType(), shared=T.LongType(), prefix=T.IntegerType(), grams=T.ArrayType(T.LongType(), False), counts=T.ArrayType(T.LongType(), False), bits=T.ArrayType(T.LongType(), False))


def set_column(size: int) -> Callable[[Column], Column]:
    """A column function from text to its set's size and key; the key of an empty set is null."""

    @F.arrow_udf(SET)
    def of(text: pa.Array) -> pa.Array:
        counts, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part in slices(pa.RecordBatch.from_arrays([text], names=["text"]), 0, SLICE):
            grams, bounds = shingle_sets(*flat(part.column(0)), size)
            counts.append(np.diff(bounds))
            keys.append(set_keys(grams, bounds))
        n, key = np.concatenate(counts), np.concatenate(keys)
        return pa.StructArray.from_arrays([pa.array(n), pa.array(key, mask=n == 0)], names=SET.names)

    return of


def blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def dealt(part: np.ndarray, keys: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row per number in ``part``, with the segments that go there; ``part`` ascends."""
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist() + [len(part)]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    runs = list(zip(cuts, cuts[1:]))
    columns = [pa.array([int(part[a]) for a, _ in runs], pa.int32())]
    columns += [pa.array([blob(x[a:b]) for a, b in runs], pa.binary()) for x in (keys, sizes, lengths)]
    columns += [pa.array([blob(x[ends[a] : ends[b]]) for a, b in runs], pa.binary()) for x in (grams, counts)]
    return pa.RecordBatch.from_arrays(columns, names=SEGMENTS.names)


def segments(docs: DataFrame, size: int, parts: int) -> DataFrame:
    """Rows of segments: for each slice of texts and fragment of n-gram space, every set's n-grams in it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                grams, bounds = shingle_sets(*flat(part.column(0)), size)
                if not len(grams):
                    continue
                keys, n = set_keys(grams, bounds), np.diff(bounds)
                sets = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                fragment = ((grams >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
                order = np.argsort(fragment, kind="stable")
                fragment, sets, grams = fragment[order], sets[order], grams[order]
                first = np.flatnonzero(np.concatenate([[True], (sets[1:] != sets[:-1]) | (fragment[1:] != fragment[:-1])]))
                lengths = np.diff(np.append(first, len(sets)))
                yield dealt(fragment[first], keys[sets[first]], n[sets[first]].astype(np.int32), lengths.astype(np.int32), grams, np.zeros(0, np.int32))

    return docs.mapInArrow(cut, SEGMENTS)


def by_fragment(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(keys, sizes, lengths, grams, counts) of one fragment after the other; rows come sorted by fragment.

    Rows are views of their batch until a fragment is whole, and none is held beside the whole one.
    """
    kinds = (np.int64, np.int32, np.int32, np.uint64, np.int32)
    current, held = None, [[] for _ in kinds]

    def whole() -> Iterator[np.ndarray]:
        for h, kind in zip(held, kinds):
            yield np.concatenate([np.zeros(0, kind), *h])
            h.clear()

    for batch in batches:
        for k in range(batch.num_rows):
            fragment = batch.column(0)[k].as_py()
            if fragment != current and current is not None:
                yield tuple(whole())
            current = fragment
            for h, column, kind in zip(held, batch.columns[1:], kinds):
                h.append(np.frombuffer(column[k].as_buffer(), kind))
    if current is not None:
        yield tuple(whole())


def sets_of_each(grams: np.ndarray) -> np.ndarray:
    """How often each n-gram is there, worked out by ranges of the hashes, so that only one range is sorted at a time."""
    ranges = -(-len(grams) // COUNTED)
    place = ((grams & np.uint64(0xFFFFFFFF)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
    number = np.zeros(len(grams), np.int32)
    for k in range(ranges):
        at = np.flatnonzero(place == k)
        _, where, many = np.unique(grams[at], return_inverse=True, return_counts=True)
        number[at] = many[where]
    return number


def count_fragments(rows: DataFrame, parts: int) -> DataFrame:
    """The n-grams that at least two sets hold, with that number, as segments dealt by set; equal sets count once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for keys, sizes, lengths, grams, _ in by_fragment(batches):
            once = np.zeros(len(keys), bool)
            once[np.unique(keys, return_index=True)[1]] = True
            if not once.all():
                grams = grams[np.repeat(once, lengths)]
                keys, sizes, lengths = keys[once], sizes[once], lengths[once]
            number = sets_of_each(grams)
            shared = number > 1
            grams, number = grams[shared], number[shared]
            to = (keys.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            lengths = np.add.reduceat(shared, np.cumsum(lengths) - lengths, dtype=np.int32)
            order = np.argsort(to, kind="stable")
            order = order[lengths[order] > 0]
            if len(order):
                at = ragged((np.cumsum(lengths) - lengths)[order], lengths[order])
                yield dealt(to[order].astype(np.int32), keys[order], sizes[order], lengths[order], grams[at], number[at])

    return rows.repartition(parts, "fragment").sortWithinPartitions("fragment").mapInArrow(count, SEGMENTS)


def candidates_only(rows: DataFrame, percent: int, parts: int) -> DataFrame:
    """Sets that can have a partner: their shared n-grams in the global order, the length of the prefix among them, a bitmap.

    A set of n must share ceil(percent n / 100) n-grams with a partner, so the partner has one of its
    first n - that + 1. N-grams of no other set come first in the order and need not be looked at.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sizes, lengths, grams, counts in by_fragment(batches):
            key, n = np.repeat(keys, lengths), np.repeat(sizes, lengths)
            order = np.lexsort((grams, counts, key))
            key, n, grams, counts = key[order], n[order].astype(np.int64), grams[order], counts[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            shared = np.diff(np.append(starts, len(key)))
            size = n[starts]
            prefix = shared - (percent * size + 99) // 100 + 1
            kept = np.flatnonzero(prefix > 0)
            if not len(kept):
                continue
            at = ragged(starts[kept], shared[kept])
            grams, counts, shared = grams[at], counts[at], shared[kept]
            bits = np.zeros((len(kept), BITMAP), np.uint64)
            bit = grams % np.uint64(64 * BITMAP)
            np.bitwise_or.at(bits, (np.repeat(np.arange(len(kept)), shared), (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
            bounds = pa.array(np.concatenate([[0], np.cumsum(shared)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int64))) for x in (grams.view(np.int64), counts)]
            words = pa.ListArray.from_arrays(pa.array((np.arange(len(kept) + 1) * BITMAP).astype(np.int32)), pa.array(bits.view(np.int64).ravel()))
            columns = [pa.array(key[starts[kept]]), pa.array(size[kept]), pa.array(shared), pa.array(prefix[kept].astype(np.int32)), *lists, words]
            yield pa.RecordBatch.from_arrays(columns, names=KEPT.names)

    return rows.repartition(parts, "fragment").sortWithinPartitions("fragment").mapInArrow(keep, KEPT)


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether sizes and bitmaps let two sets reach the threshold: a bit of one alone is an n-gram that the other lacks."""
    n = F.col(f"{a}.n") + F.col(f"{b}.n")
    need = F.ceil((percent * n) / (100 + percent))  # 100 o >= percent (n - o)

    def missing(x: str, y: str) -> Column:
        out = F.lit(0)
        for k in range(BITMAP):
            out = out + F.bit_count(F.col(f"{x}.b{k}").bitwiseAND(F.bitwise_not(F.col(f"{y}.b{k}"))))
        return F.col(f"{x}.shared") - out

    return (missing(a, b) >= need) & (missing(b, a) >= need)


def order_cuts(sets: DataFrame) -> DataFrame:
    """Every set's n-grams in each fragment of the order: key, n, fragment and segment."""
    fragment = F.least(F.floor(F.log2("count")) - 1, F.lit(FRAGMENTS - 1))
    grams = sets.select("key", "n", F.explode(F.arrays_zip(F.col("grams").alias("gram"), F.col("counts").alias("count"))).alias("g")).select("key", "n", F.col("g.gram").alias("gram"), F.col("g.count").alias("count"))
    return grams.groupBy("key", "n", fragment.alias("fragment")).agg(F.collect_list("gram").alias("segment"))


def linked(pairs: DataFrame, cuts: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (u, v), those that reach the threshold: partial overlaps in each fragment of the order, summed."""
    left = cuts.select(F.col("key").alias("u"), F.col("n").alias("u_n"), "fragment", F.col("segment").alias("u_segment"))
    right = cuts.select(F.col("key").alias("v"), F.col("n").alias("v_n"), "fragment", F.col("segment").alias("v_segment"))
    partial = pairs.join(left, "u").join(right, ["v", "fragment"]).select("u", "v", "u_n", "v_n", F.size(F.array_intersect("u_segment", "v_segment")).alias("part"))
    overlap = partial.groupBy("u", "v", "u_n", "v_n").agg(F.sum("part").alias("overlap"))
    return overlap.filter(100 * F.col("overlap") >= percent * (F.col("u_n") + F.col("v_n") - F.col("overlap"))).select("u", "v")


def as_pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.greatest("a.key", "b.key").alias("u"), F.least("a.key", "b.key").alias("v")).distinct()


def mixed_lists(postings: DataFrame, found: DataFrame) -> DataFrame:
    """Postings of the n-grams whose sets lie in several components, with ``component`` and the list's most frequent one, ``main``."""
    placed = postings.join(found, F.col("key") == F.col("node"), "left").select(*postings.columns, F.coalesce("component", "key").alias("component"))
    held = placed.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("many"))
    mixed = held.groupBy(F.col("gram").alias("of")).agg(F.max_by("component", "many").alias("main"), F.count(F.lit(1)).alias("parts")).filter(F.col("parts") > 1)
    return placed.join(mixed, F.col("gram") == F.col("of")).select(*placed.columns, "main")


def first_shared(a: str, b: str) -> Column:
    """False only where the n-grams right before this one in the two prefixes show that the sets met at an earlier one."""
    one, two = F.col(f"{a}.before"), F.col(f"{b}.before")
    return ~(F.coalesce(one == two, F.lit(False)) | F.coalesce(one == F.col(f"{b}.before2"), F.lit(False)) | F.coalesce(F.col(f"{a}.before2") == two, F.lit(False)))


def joined_further(found: DataFrame, more: DataFrame) -> DataFrame:
    """Components that stay after further links (u, v); each old component counts as a star of its least node."""
    observed = Observation()
    more = written(more.observe(observed, F.count(F.lit(1)).alias("n")))
    if not observed.get["n"]:
        return found
    return components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))


def links(sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the sets that links reach, by the least key.

    Only links between components matter, so the copies of one text are joined first, without
    comparing all of them. Each set's PROBES least n-grams by hash, which near copies share, lead to
    three pivots (the smallest set that chose it, the largest, the least key). Then, in the list of
    each n-gram of the prefixes that still has several components, all sets outside the most frequent
    one meet two of its sets, other ones at each n-gram. Last, they meet every set of another
    component: no pair is left out that could still join two components.
    """
    bits = [F.col("bits")[k].alias(f"b{k}") for k in range(BITMAP)]
    fields = ["n", "key", "shared", *(f"b{k}" for k in range(BITMAP))]
    probes = sets.select("key", "n", "shared", *bits, F.explode(F.slice(F.array_sort("grams"), 1, PROBES)).alias("gram"))
    row = F.struct(*fields)
    pivots = probes.groupBy("gram").agg(F.count(F.lit(1)).alias("many"), F.array_distinct(F.array(F.min(row), F.max(row), F.min_by(row, F.col("key")))).alias("p")).filter(F.col("many") > 1)
    stars = pivots.select("gram", F.explode("p").alias("p")).select("gram", "p.*")
    met = probes.alias("a").join(stars.alias("b"), F.col("a.gram") == F.col("b.gram")).filter((F.col("a.key") != F.col("b.key")) & may_link("a", "b", percent))
    cuts = written(order_cuts(sets))
    found = components(written(linked(as_pairs(met), cuts, percent)))

    placed = sets.select("key", "n", "shared", *bits, "grams", F.posexplode(F.slice("grams", 1, F.col("prefix"))).alias("at", "gram"))
    postings = written(placed.select("gram", *fields, F.get("grams", F.col("at") - 1).alias("before"), F.get("grams", F.col("at") - 2).alias("before2")))
    lists = written(mixed_lists(postings, found))
    row, draw = F.struct(*fields, "component", "before", "before2"), F.xxhash64("key", "gram")
    mains = lists.filter(F.col("component") == F.col("main")).groupBy("gram").agg(F.array_distinct(F.array(F.min_by(row, draw), F.max_by(row, draw))).alias("p"))
    mains = mains.select("gram", F.explode("p").alias("p")).select("gram", "p.*")
    other = lists.filter(F.col("component") != F.col("main"))
    met = other.alias("a").join(mains.alias("b"), F.col("a.gram") == F.col("b.gram")).filter(first_shared("a", "b") & may_link("a", "b", percent))
    found = joined_further(found, linked(as_pairs(met), cuts, percent))

    lists = written(mixed_lists(postings, found))
    other = lists.filter(F.col("component") != F.col("main"))
    crossing = (F.col("a.component") != F.col("b.component")) & ((F.col("b.component") == F.col("b.main")) | (F.col("a.key") < F.col("b.key")))
    met = other.alias("a").join(lists.alias("b"), F.col("a.gram") == F.col("b.gram")).filter(crossing & first_shared("a", "b") & may_link("a", "b", percent))
    return joined_further(found, linked(as_pairs(met), cuts, percent))


def join_documents(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """doc_id, n_shingles, set_key and component_id (the least doc_id reachable by links) of every row.

    Two rows link when the Jaccard index of their sets of ``size``-word shingles (A-Z lower-cased,
    words being runs without ASCII white space) is ``percent`` / 100 or more; fewer words make one
    shingle. A null or wordless text has no shingle and links with nothing, its component is its own
    id. Equal sets link always, rows that share an id too if their sets do; a row without id joins
    its component but does not name it; other columns are left out; an empty table gives no rows.
    N-grams and sets are compared by 64-bit hashes.

    ``parts``: fragments of n-gram space, by default one for each FRAGMENT_BYTES of text, and the
    session's shuffle partitions at least, so that a task's memory does not grow with the table. Equal
    sets are one set throughout, so copies cost a row each; components are found by joins, never gathered.
    """
    if parts is None:
        held = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // FRAGMENT_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), set_column(size)(F.col(text_col)).alias("s")).select("doc_id", "s.*")
    sets = written(candidates_only(count_fragments(segments(docs.select(F.col(text_col).alias("text")), size, parts), parts), percent, parts))
    rows = written(rows)
    classes = rows.filter(F.col("n_shingles") > 0).groupBy("set_key").agg(F.min("doc_id").alias("least"))
    found = links(sets, percent)
    classes = classes.join(found, F.col("set_key") == F.col("node"), "left").select("set_key", "least", F.coalesce("component", "set_key").alias("component"))
    names = classes.groupBy(F.col("component").alias("named")).agg(F.min("least").alias("component_id"))
    named = classes.join(names, F.col("component") == F.col("named")).select(F.col("set_key").alias("of_set"), "component_id")
    joined = rows.join(named, F.col("set_key") == F.col("of_set"), "left")
    return joined.select("doc_id", "n_shingles", "set_key", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
