"""Rows of rates that relate the digits of a row to those of earlier rows, for the two stages of a prediction."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe import layout as L
from obsframe.operators.scans import history, prior
from obsframe.operators.trailing import lists, running, series_starts

# Windows of the rolling rates.
WINDOWS = (3, 7, 14)
HEAD, PAIR, TAIL = L.CODES["head"], L.CODES["pair"], L.CODES["tail"]
KEYS = ("entity_id", "obs_date")
#: Rows whose rates are worked out at a time.
STEP = 2_000


def share(count: Column, total: Column) -> Column:
    """A share rounded to eight places, 0 of nothing."""
    return F.when(total > 0, F.round(count / total, 8)).otherwise(F.lit(0.0))


def rates(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda c: share(c, total))


def _running(values, w) -> Column:
    """Ten running counts of a digit column as one array."""
    return F.array(*[F.count_if(values == d).over(w) for d in range(L.DIGITS)])


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``share`` of integer arrays: halves of the eighth place go up, worked out in integers."""
    some = np.maximum(total, 1)
    return np.where(total > 0, (2 * 10**8 * count + some) // (2 * some) / 1e8, 0.0)


class Before:
    """Counts over the earlier rows of a series that are in the same group as a row, over batches of rows sorted by series.

    What the series that goes on from a batch has counted in each group is carried over.
    """

    def __init__(self, groups: int, width: int):
        self.rows, self.sums = np.zeros(groups, np.int64), np.zeros((groups, width), np.int64)

    def count(self, group: np.ndarray, hits: np.ndarray, series: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, sums) before each row: how many rows of its group, and the sums of their ``hits`` (a flag per column).

        ``series`` numbers the series of the rows from 0, which is the one that goes on from the batch before.
        """
        key = series * len(self.rows) + group
        order = np.argsort(key, kind="stable")
        at = np.arange(len(key))
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        first = np.maximum.accumulate(np.where(new, at, 0))
        sums = running(hits[order].astype(np.int64))
        known = (series == 0)[order]
        n, out = np.empty(len(key), np.int64), np.empty(hits.shape, np.int64)
        n[order] = at - first + np.where(known, self.rows[group[order]], 0)
        out[order] = sums[:-1] - sums[first] + np.where(known[:, None], self.sums[group[order]], 0)
        if series[-1] != 0:
            self.rows[:], self.sums[:] = 0, 0
        own = series == series[-1]
        self.rows += np.bincount(group[own], minlength=len(self.rows))
        np.add.at(self.sums, group[own], hits[own])
        return n, out


def digit_hits(values: np.ndarray) -> np.ndarray:
    return values[:, None] == np.arange(L.DIGITS)


def stage1_columns(windows=WINDOWS) -> dict[str, str]:
    """Names and types of what ``stage1_rows`` works out in arrays."""
    return {
        **{f"lag1_{p}": "int" for p in L.POSITIONS}, "prior_count": "bigint", **{f"{t}_given_{p}": "array<double>" for p in HEAD for t in (*PAIR, *TAIL)},
        **{f"support_{p}": "bigint" for p in HEAD}, "tail_by_first": "array<double>", **{f"same_{p}": "double" for p in HEAD},
        **{f"rolling{n}_{p}": "double" for n in windows for p in HEAD}, **{f"temporal{n}": "array<double>" for n in windows},
    }


class Stage1:
    """The columns of ``stage1_columns`` for batches of rows sorted by entity and date."""

    def __init__(self, windows=WINDOWS):
        self.windows, self.longest = windows, max(windows)
        self.given = {p: Before(L.DIGITS + 1, L.DIGITS * len((*PAIR, *TAIL))) for p in HEAD}
        self.all = Before(1, L.DIGITS * (L.DIGITS + len(HEAD)))
        self.tail = {p: np.empty(0, np.int64) for p in L.POSITIONS}

    def columns(self, digits: dict[str, np.ndarray], series: np.ndarray) -> dict[str, pa.Array]:
        """``digits`` holds -1 for null; ``series`` numbers the rows' series from 0, which goes on from the batch before."""
        m, out = len(series), {}
        carried = len(self.tail[HEAD[0]]) if series[0] == 0 else 0
        values = {p: np.concatenate([self.tail[p][:carried], digits[p]]) for p in L.POSITIONS}
        at = np.arange(carried, carried + m)
        new = np.concatenate([[series[0] != 0], series[1:] != series[:-1]])
        start = np.maximum.accumulate(np.where(new, at, 0))
        for p in L.POSITIONS:
            last = np.where(at > start, values[p][at - 1], -1)
            out[f"lag1_{p}"] = pa.array(last.astype(np.int32), mask=last < 0)
        hits = {p: digit_hits(digits[p]) for p in L.POSITIONS}
        cells = (hits[PAIR[0]][:, :, None] & hits[TAIL[0]][:, None, :]).reshape(m, -1)
        n, sums = self.all.count(np.zeros(m, np.int64), np.concatenate([cells, *(hits[p] for p in HEAD)], axis=1), series)
        out["prior_count"] = pa.array(n)
        matrix = sums[:, : L.DIGITS**2].reshape(m, L.DIGITS, L.DIGITS)
        out["tail_by_first"] = lists(shares(matrix, matrix.sum(axis=2, keepdims=True)).reshape(m, -1))
        targets = np.concatenate([hits[t] for t in (*PAIR, *TAIL)], axis=1)
        for i, p in enumerate(HEAD):
            group = np.where(digits[p] < 0, L.DIGITS, digits[p])
            support, counts = self.given[p].count(group, targets, series)
            rate = shares(counts, support[:, None]).reshape(m, -1, L.DIGITS)
            out |= {f"{t}_given_{p}": lists(np.ascontiguousarray(rate[:, k])) for k, t in enumerate((*PAIR, *TAIL))}
            out[f"support_{p}"] = pa.array(support)
            same = (sums[:, L.DIGITS**2 + i * L.DIGITS :][:, : L.DIGITS] * hits[p]).sum(axis=1)
            out[f"same_{p}"] = pa.array(shares(same, n), mask=(digits[p] < 0) & (n > 0))
            totals = running(digit_hits(values[p]).astype(np.int64))
            for w in self.windows:
                count = totals[at] - totals[np.maximum(at - w, start)]
                seen = count.sum(axis=1)
                out[f"rolling{w}_{p}"] = pa.array(shares((count * hits[p]).sum(axis=1), seen))
                if i == 0:
                    out[f"temporal{w}"] = lists(shares(count, seen[:, None]))
        keep = max(start[-1], carried + m - self.longest)
        self.tail = {p: v[keep:] for p, v in values.items()}
        return out


def stage1_rows(df: DataFrame, windows=WINDOWS) -> DataFrame:
    """What is known before the pair: head digits, the last row, rates given the head digits, rolling rates, calendar.

    ``given_p1`` to ``given_p3`` hold ten rates of every pair and tail digit over the earlier rows of
    the entity with the same head digit; ``tail_by_first`` the rates of the first tail digit for each
    of the ten possible first pair digits (a 10 x 10 matrix, running from row to row), so that no
    feature depends on the pair that is to be predicted; ``temporal`` the ten rates of the first head
    digit in the rows just before. Lags are null in an entity's first row. Keys and digits move and
    are sorted once; all counts are worked out in arrays over batches of the sorted rows. A null digit
    counts for no digit and shares its row with other nulls; other numbers are an error.
    """
    rows = df.select(*KEYS, *L.POSITIONS).repartition("entity_id").sortWithinPartitions(*KEYS)
    types = stage1_columns(windows)
    schema = T.StructType([*(df.schema[c] for c in (*KEYS, *HEAD)), *T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in types.items())).fields])

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, stage = None, Stage1(windows)
        for whole in batches:
            for begin in range(0, whole.num_rows, STEP):
                batch = whole.slice(begin, STEP)
                series = np.cumsum(series_starts([batch.column("entity_id")], before))
                before = [batch.column("entity_id")[batch.num_rows - 1].as_py()]
                digits = {p: pc.fill_null(batch.column(p).cast(pa.int64()), -1).to_numpy(zero_copy_only=False) for p in L.POSITIONS}
                if any(((x >= L.DIGITS) | ((x < 0) & batch.column(p).is_valid().to_numpy(zero_copy_only=False))).any() for p, x in digits.items()):
                    raise ValueError("digits lie in 0..9")
                made = stage.columns(digits, series)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*KEYS, *HEAD)), *(made[n] for n in types)], names=schema.names)

    return rows.mapInArrow(worked, schema).withColumns({
        "day_of_week": F.weekday("obs_date"), "day_of_month": F.dayofmonth("obs_date"), "month": F.month("obs_date"), "quarter": F.quarter("obs_date"), "year": F.year("obs_date"),
    })


def stage2_rows(df: DataFrame) -> DataFrame:
    """What the first pair digit adds: it, the second one, and the rates of the tail over earlier rows with them.

    ``tail_given_first`` counts all three tail digits of the earlier rows with this first pair digit,
    ``first_tail_given_second`` the first tail digit of those with this second one.
    """
    by_first, by_second = prior(history("entity_id", PAIR[0])), prior(history("entity_id", PAIR[1]))
    any_tail = F.array(*[sum((F.count_if(F.col(p) == d).over(by_first) for p in TAIL[1:]), F.count_if(F.col(TAIL[0]) == d).over(by_first)) for d in range(L.DIGITS)])
    step = df.withColumns({
        "_f": any_tail, "_nf": F.count("*").over(by_first) * len(TAIL), "_s": _running(F.col(TAIL[0]), by_second), "_ns": F.count("*").over(by_second),
    })
    return step.select(
        *KEYS, F.col(PAIR[0]).alias("known_first"), F.col(PAIR[1]).alias("known_second"), rates(F.col("_f"), F.col("_nf")).alias("tail_given_first"),
        rates(F.col("_s"), F.col("_ns")).alias("first_tail_given_second"), F.col("_ns").alias("support_second"),
    )
