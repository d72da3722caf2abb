"""The best tail codes of a digit's family and the best joint choices of a pair and two tails, by search in sorted factors."""

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe import layout as L

#: Shares are rounded to this many places before they are compared, so that shares that are equal up to rounding noise are ties.
PLACES = 12
CHOSEN = T.ArrayType(T.StructType([
    T.StructField("pair", T.StringType()), T.StructField("pair_prob", T.DoubleType()), T.StructField("first_tail", T.StringType()),
    T.StructField("first_prob", T.DoubleType()), T.StructField("second_tail", T.StringType()), T.StructField("second_prob", T.DoubleType()),
    T.StructField("joint_score", T.DoubleType()),
]))
RANKED = T.ArrayType(T.StructType([
    T.StructField("side", T.StringType()), T.StructField("digit", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("code", T.StringType()),
    T.StructField("prob", T.DoubleType()), T.StructField("family", T.IntegerType()), T.StructField("cum_prob", T.DoubleType()),
]))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of ten probabilities; a null row or probability is NaN."""
    if column.null_count == 0 and column.flatten().null_count == 0 and len(column.flatten()) == L.DIGITS * len(column):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, L.DIGITS)
    return np.array([(r or [np.nan] * L.DIGITS) for r in column.to_pylist()], float).reshape(-1, L.DIGITS)


def code_shares(factors: list[np.ndarray], codes: list[str]) -> np.ndarray:
    """Products of the digits' probabilities, (rows, codes)."""
    digits = np.array([[int(x) for x in c] for c in codes])
    out = factors[0][:, digits[:, 0]]
    for k, f in enumerate(factors[1:], 1):
        out = out * f[:, digits[:, k]]
    return out


class Families:
    """Codes by family, each in code order."""

    def __init__(self, tails: list[tuple[str, int]]) -> None:
        self.codes: list[list[str]] = [sorted(c for c, f in tails if f == family) for family in range(L.DIGITS)]

    def best(self, factors: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per family: places of its codes from best to worst (ties by code) and their shares of the family, for every row."""
        out = []
        for codes in self.codes:
            if not codes:
                out.append((np.zeros((len(factors[0]), 0), np.int64), np.zeros((len(factors[0]), 0))))
                continue
            shares = code_shares(factors, codes)
            shares = np.round(shares / shares.sum(axis=1, keepdims=True), PLACES)
            order = np.argsort(-shares, axis=1, kind="stable")
            out.append((order, np.take_along_axis(shares, order, axis=1)))
        return out


def k_best(pairs: list[tuple[str, float]], first: Callable, second: Callable, k: int) -> list[tuple]:
    """The ``k`` best (score, pair, place of the first tail, place of the second), ties by pair and then codes.

    A lazy search: the heap holds the best choice of every pair, and after a choice is taken its two
    neighbours in the sorted tails, which can only be worse. ``first(pair)`` and ``second(pair)`` give
    (codes, shares) from best to worst.
    """
    def entry(pair: str, p: float, i: int, j: int) -> tuple:
        (a, x), (b, y) = first(pair), second(pair)
        return (-(p * x[i] * y[j]), pair, a[i], b[j], i, j, p)

    heap = [entry(pair, p, 0, 0) for pair, p in pairs if len(first(pair)[0]) and len(second(pair)[0])]
    heapq.heapify(heap)
    pushed, out = {(pair, 0, 0) for pair, _ in pairs}, []
    while heap and len(out) < k:
        score, pair, a, b, i, j, p = heapq.heappop(heap)
        out.append((-score, pair, p, a, float(first(pair)[1][i]), b, float(second(pair)[1][j])))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(first(pair)[0]) and y < len(second(pair)[0]) and (pair, x, y) not in pushed:
                pushed.add((pair, x, y))
                heapq.heappush(heap, entry(pair, p, x, y))
    return out


def joint_choices(tails: list[tuple[str, int]], top_k: int):
    """A vectorised function of the two pair and three tail factors: the best (pair, first tail, second tail) of each row."""
    families, pairs = Families(tails), [f"{i:02d}" for i in range(100)]

    @F.arrow_udf(CHOSEN)
    def chosen(q4: pa.Array, q5: pa.Array, q6: pa.Array, q7: pa.Array, q8: pa.Array) -> pa.Array:
        pair_factors, tail_factors = [matrix(q4), matrix(q5)], [matrix(q6), matrix(q7), matrix(q8)]
        shares = code_shares(pair_factors, pairs)
        shares = np.round(shares / shares.sum(axis=1, keepdims=True), PLACES)
        best = families.best(tail_factors)
        out = []
        for row in range(len(shares)):
            if not np.isfinite(shares[row]).all() or not all(np.isfinite(x[row]).all() for _, x in best):
                out.append(None)
                continue
            lists = [([codes[i] for i in order[row]], x[row]) for codes, (order, x) in zip(families.codes, best)]
            found = k_best(list(zip(pairs, shares[row].tolist())), lambda p: lists[int(p[0])], lambda p: lists[int(p[1])], top_k)
            out.append([{"pair": pair, "pair_prob": p, "first_tail": a, "first_prob": x, "second_tail": b, "second_prob": y, "joint_score": s} for s, pair, p, a, x, b, y in found])
        return pa.array(out, pa.list_(pa.struct([(f.name, pa.string() if f.dataType == T.StringType() else pa.float64()) for f in CHOSEN.elementType.fields])))

    return chosen


def select_jointly(df: DataFrame, factors: list[str], tails: list[tuple[str, int]], keys, top_k: int = 5) -> DataFrame:
    """Ranked joint choices per row: rank, pair, both tails, their shares and the joint score.

    ``factors`` names the probability arrays of the two pair and the three tail digits. A tail must
    belong to the family of its pair digit, its share is that within the family. Scores are products
    of shares rounded to ``PLACES``; equal scores go by pair, first tail, second tail. Rows with a
    null factor give none. Everything stays in the row: no shuffle.
    """
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    chosen = joint_choices(tails, top_k)(*[F.col(f) for f in factors])
    return df.select(*keys, F.posexplode(chosen).alias("_i", "_c")).select(*keys, (F.col("_i") + 1).alias("rank"), "_c.*")


def rank_in_families(df: DataFrame, factors: list[str], tails: list[tuple[str, int]], keys, pair: Column | str = "pair", top_k: int = 5) -> DataFrame:
    """The best tails of the family of each digit of a known pair, with shares of the family and running sums.

    One product per row and code over the batch and one sort per family; a row with a null factor or a pair
    that is no two digits gives none.
    """
    families = Families(tails)

    @F.arrow_udf(RANKED)
    def ranked(pairs: pa.Array, q6: pa.Array, q7: pa.Array, q8: pa.Array) -> pa.Array:
        best = families.best([matrix(q6), matrix(q7), matrix(q8)])
        out = []
        for row, code in enumerate(pairs.to_pylist()):
            if code is None or len(code) != 2 or not code.isdigit():
                out.append(None)
                continue
            items = []
            for side, digit in (("first", code[0]), ("second", code[1])):
                order, shares = best[int(digit)]
                if not np.isfinite(shares[row]).all():
                    items = None
                    break
                running = np.cumsum(shares[row][:top_k])
                items += [
                    {"side": side, "digit": digit, "rank": r + 1, "code": families.codes[int(digit)][order[row, r]], "prob": float(shares[row, r]), "family": int(digit), "cum_prob": float(running[r])}
                    for r in range(len(running))
                ]
            out.append(items)
        kinds = {T.StringType(): pa.string(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64()}
        return pa.array(out, pa.list_(pa.struct([(f.name, kinds[f.dataType]) for f in RANKED.elementType.fields])))

    rows = ranked(F.col(pair) if isinstance(pair, str) else pair, *[F.col(f) for f in factors])
    return df.select(*keys, F.inline(rows))
