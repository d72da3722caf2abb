"""Packing documents into sequences of equal length by column generation over the histogram of lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.llm.encode import encoder, with_end
from obsframe.llm.tables import flat, slices, struct, written

CAPACITY = 2048
#: Tokens of a length class; lengths are rounded up to it for the linear program.
STEP = 4
PIECES = struct(doc_id=T.LongType(), start=T.LongType(), length=T.LongType(), ids=T.ArrayType(T.IntegerType(), False), doc_tokens=T.LongType())


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """A row per piece: whole sequences of a document from its start, and the rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                ids, offsets = with_end(*encoder(tokenizer).encode(*flat(part.column(1))), end_id)
                sizes = np.diff(offsets)
                each = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), each)
                starts = (np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)) * capacity
                bounds = np.append(offsets[row] + starts, len(ids)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32)))
                columns = [part.column(0).take(pa.array(row)), pa.array(starts), pa.array(np.diff(bounds).astype(np.int64)), lists, pa.array(sizes[row])]
                yield pa.RecordBatch.from_arrays(columns, names=PIECES.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def best_pattern(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Knapsack by dynamic programming: the counts of each size, within ``room``, of the highest total value."""
    useful = np.flatnonzero(values > 1e-12)
    worth, weight = values[useful], sizes[useful]
    total, choice = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(weight)
    useful, worth, weight = useful[order], worth[order], weight[order]
    fits = np.searchsorted(weight, np.arange(room + 1), "right")
    for c in range(1, room + 1):
        total[c] = total[c - 1]
        if fits[c]:
            sums = total[c - weight[: fits[c]]] + worth[: fits[c]]
            k = int(sums.argmax())
            if sums[k] > total[c] + 1e-12:
                total[c], choice[c] = sums[k], k
    counts, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[useful[choice[c]]] += 1
            c -= weight[choice[c]]
    return float(total[room]), counts


def fractional_patterns(sizes: np.ndarray, demand: np.ndarray, room: int, penalty: float, most: int) -> list[tuple[float, np.ndarray]]:
    """(sequences, counts by size) of the linear program: revised simplex, new columns priced by ``best_pattern``.

    A pattern costs one sequence; an item may instead be cut, at its share of a sequence and
    ``penalty`` more, so that only patterns with less waste than that are used. Ends when no pattern
    lowers the cost, or after ``most`` columns, with the best basis so far. Cut items are left out.
    """
    n = len(sizes)
    basis, inverse = np.eye(n, dtype=np.int64), np.eye(n)
    cost, amount, cut = sizes / room * (1 + penalty), demand.astype(float), np.ones(n, bool)
    for _ in range(most):
        value, column = best_pattern(cost @ inverse, sizes, room)
        if value <= 1 + 1e-9:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-10, amount / np.where(step > 1e-10, step, 1), np.inf)
        out = int(ratio.argmin())
        moved = ratio[out]
        amount = np.maximum(amount - moved * step, 0)
        amount[out] = moved
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        basis[:, out], cost[out], cut[out] = column, 1.0, False
    return [(float(amount[k]), basis[:, k].copy()) for k in np.argsort(-amount) if not cut[k]]


def whole_patterns(sizes: np.ndarray, demand: np.ndarray, room: int, penalty: float = 0.01, most: int = 4000) -> list[tuple[int, np.ndarray]]:
    """The fractional patterns rounded down; they never hold more than ``demand``."""
    left, out = demand.astype(np.int64).copy(), []
    for amount, column in fractional_patterns(sizes, demand, room, penalty, most) if len(sizes) else []:
        used = column > 0
        times = min(int(np.floor(amount + 1e-6)), int((left[used] // column[used]).min()))
        if times > 0:
            out.append((times, column))
            left -= times * column
    return out


def slots(sizes: np.ndarray, patterns: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ranks: (class and first rank in one key, items of the class in a sequence, first sequence).

    Ranks that no pattern takes are a run with no items and sequence -1.
    """
    rows, first, taken = [], 0, np.zeros(len(sizes), np.int64)
    for times, column in patterns:
        for k in np.flatnonzero(column):
            rows.append(((int(sizes[k]) << 44) + int(taken[k]), int(column[k]), first))
            taken[k] += times * column[k]
        first += times
    rows += [((int(size) << 44) + int(n), 0, -1) for size, n in zip(sizes, taken)]
    rows.sort()
    keys, each, base = zip(*rows) if rows else ((), (), ())
    return np.array(keys, np.int64), np.array(each, np.int64), np.array(base, np.int64)


def running(rows: DataFrame, key: Column, value: Column, salts: int) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over earlier rows of the same key, in an order of two levels.

    No key is gathered in one place: rows are dealt to ``salts`` parts, a part starts where the sums
    of the parts before it end, and inside a part rows follow piece_id.
    """
    parts = rows.withColumn("part", F.pmod(F.xxhash64("piece_id"), F.lit(salts))).withColumn("key", key)
    sums = parts.groupBy(F.col("key").alias("of_key"), F.col("part").alias("of_part")).agg(F.sum(value).alias("n"))
    earlier = Window.partitionBy("of_key").orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select("of_key", "of_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("key", "part").orderBy("piece_id").rowsBetween(Window.unboundedPreceding, -1)
    joined = parts.join(first, (F.col("key") == F.col("of_key")) & (F.col("part") == F.col("of_part")))
    return joined.select(*rows.columns, (F.col("first") + F.coalesce(F.sum(value).over(inside), F.lit(0))).alias("before"))


def cut_rest(rest: DataFrame, capacity: int, first: int, salts: int) -> DataFrame:
    """Pieces that no pattern took, laid end to end into sequences from ``first`` on and cut where one is full."""
    at = F.col("before")
    laid = running(rest, F.lit(0), F.col("length"), salts)
    parts = laid.withColumn("turn", F.explode(F.sequence(F.floor(at / capacity), F.floor((at + F.col("length") - 1) / capacity))))
    begin, end = F.greatest(at, F.col("turn") * capacity), F.least(at + F.col("length"), (F.col("turn") + 1) * capacity)
    return parts.select("piece_id", (begin - at).alias("skip"), (end - begin).alias("take"), (F.col("turn") + first).alias("sequence_id"), (begin - F.col("turn") * capacity).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, step: int = STEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every token of ``docs`` in exactly one piece of one sequence of at most ``capacity`` tokens.

    Returns doc_id, start, length, doc_tokens, ids, sequence_id and offset per piece. A document is
    its ids and ``end_id``; a null text is empty and is the end id alone; rows that share an id, or
    its absence, are packed one by one; other columns are left out; an empty table gives no rows.

    A document of a sequence's length or more fills whole sequences from its start on; its rest and
    shorter documents are items. Their lengths, rounded up to ``step``, make a histogram of at most
    capacity/step counts, all that the driver sees. A linear program over patterns (counts of each
    class that fit a sequence) is solved by column generation; patterns, rounded down, take the items
    of each class in order of rank; the items left over are laid end to end and cut.

    Texts are read once and their ids written; ranks and places are made of narrow rows, and the ids
    move once, to meet their places.
    """
    if capacity % step:
        raise ValueError("capacity must be a multiple of step")
    spark = docs.sparkSession
    pieces = cut_documents(docs, tokenizer, end_id, capacity, id_col, text_col)
    pieces = written(pieces.select("*", F.ceil(F.col("length") / step).cast("int").alias("class"), F.monotonically_increasing_id().alias("piece_id")), compression="zstd")
    narrow = pieces.select("piece_id", "class", "length")
    counts = sorted((r["class"], r["n"]) for r in narrow.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect())
    sizes, demand = (np.array([c[i] for c in counts], np.int64) for i in (0, 1))
    patterns = whole_patterns(sizes, demand, capacity // step)
    keys, each, base = slots(sizes, patterns)

    @F.arrow_udf(T.LongType())
    def sequence(kind: pa.Array, rank: pa.Array) -> pa.Array:
        want = (kind.to_numpy(zero_copy_only=False).astype(np.int64) << 44) + rank.to_numpy(zero_copy_only=False)
        run = np.searchsorted(keys, want, "right") - 1
        return pa.array(base[run] + (want - keys[run]) // np.maximum(each[run], 1) * (each[run] > 0))

    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written(running(narrow, F.col("class"), F.lit(1), salts).select("piece_id", "length", sequence(F.col("class"), F.col("before")).alias("sequence_id")))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "piece_id").rowsBetween(Window.unboundedPreceding, -1)
    whole = placed.filter(F.col("sequence_id") >= 0).select("piece_id", F.lit(0).cast("long").alias("skip"), F.col("length").alias("take"), "sequence_id", F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset"))
    rest = cut_rest(placed.filter(F.col("sequence_id") < 0), capacity, sum(times for times, _ in patterns), salts)
    joined = pieces.join(whole.unionByName(rest).withColumnRenamed("piece_id", "of_piece"), F.col("piece_id") == F.col("of_piece"))
    ids = F.slice("ids", (F.col("skip") + 1).cast("int"), F.col("take").cast("int"))
    return joined.select("doc_id", (F.col("start") + F.col("skip")).alias("start"), F.col("take").alias("length"), "doc_tokens", ids.alias("ids"), "sequence_id", "offset")
