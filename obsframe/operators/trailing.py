"""Trailing digit counts and distances of series, worked out in arrays over sorted rows.

Spark brings the rows of a series together in date order; a batch of them, of many series at once, is
one pass in numpy. What a series needs from the batch before (its last values, its row number and
where each digit was last seen) is carried over, so memory is bounded by a batch, whatever the
length of a series.
"""

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from obsframe import layout as L

SERIES = ("entity_id", "position")


def lists(values: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """One list per row of a matrix; elements under ``null`` are null."""
    rows, width = values.shape
    offsets = pa.array(np.arange(0, rows * width + 1, width, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), mask=None if null is None else null.ravel()))


def cut(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    """Lists of one width, each only up to its size."""
    flat = values.flatten()
    width = len(flat) // len(values)
    inside = pa.array((np.arange(width) < sizes[:, None]).ravel())
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat.filter(inside))


class Trail:
    """What lies before each row of a batch in its series.

    ``values`` holds the carried values of the first series, then those of the batch's rows; ``start``
    is where the series of each of the batch's rows begins in it.
    """

    def __init__(self, values: np.ndarray, carried: int, start: np.ndarray, rn: np.ndarray, seen: np.ndarray, first: int, width: int = L.DIGITS):
        self.values, self.start, self.rn = values, start, rn
        self.at = np.arange(carried, len(values))
        self._seen, self._first, self.width = seen, first, width

    @cached_property
    def _hits(self) -> np.ndarray:
        return self.values[:, None] == np.arange(self.width)

    @cached_property
    def _running(self) -> np.ndarray:
        return running(self._hits.astype(np.int64))

    def _from(self, n: int) -> np.ndarray:
        return np.maximum(self.at - n, self.start)

    def _between(self, sums: np.ndarray, n: int) -> np.ndarray:
        return sums[self.at] - sums[self._from(n)]

    def rows(self, n: int) -> np.ndarray:
        """How many of the last ``n`` rows there are."""
        return np.minimum(self.rn - 1, n).astype(np.int32)

    def counts(self, n: int) -> np.ndarray:
        """Digit counts of the last ``n`` rows: a difference of one running count, for any ``n``."""
        return self._between(self._running, n)

    @cached_property
    def distance(self) -> np.ndarray:
        """Rows since each digit was last seen before a row, 0 for the row before, -1 if never."""
        place = np.arange(len(self.values))[:, None]
        last = np.maximum.accumulate(np.where(self._hits, place, -1), axis=0)
        last = np.concatenate([np.full((1, self.width), -1), last])[self.at]
        out = np.where(last >= self.start[:, None], self.at[:, None] - 1 - last, -1)
        head = out[: self._first]  # rows of the series that goes on from the batch before
        known = (head < 0) & (self._seen > 0)
        out[: self._first] = np.where(known, self.rn[: self._first, None] - 1 - self._seen, head)
        return out.astype(np.int32)

    def moments(self, n: int) -> dict[str, np.ndarray]:
        """Per digit over the last ``n`` rows: count, sum and sum of squares of the distances, the least and the largest."""
        place = np.arange(len(self.values), dtype=np.int64)[:, None]
        count, s, q = (self._between(running(np.where(self._hits, x, 0)), n) for x in (np.ones_like(place), place, place * place))
        after = np.minimum.accumulate(np.where(self._hits, place, len(place))[::-1], axis=0)[::-1]
        last = self.at[:, None] - 1
        # distance = last - place, so its sums follow from those of the places, exactly in integers
        return {"n": count, "s": count * last - s, "q": count * last * last - 2 * last * s + q, "lo": self.distance.astype(np.int64), "hi": last - after[np.minimum(self._from(n), len(place) - 1)]}


def running(x: np.ndarray) -> np.ndarray:
    """Column sums of all rows before each row, and of all rows at the end."""
    out = np.zeros((len(x) + 1, x.shape[1]), dtype=x.dtype)
    np.cumsum(x, axis=0, out=out[1:])
    return out


def series_starts(columns: list[pa.Array], key: list | None) -> np.ndarray:
    """Which rows have another key than the row before them; ``key`` is that of the row before the first."""
    m = len(columns[0])
    new = np.zeros(m, dtype=bool)
    new[0] = key != [c[0].as_py() for c in columns]
    for c in columns:
        a, b = c.slice(1), c.slice(0, m - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null()))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    return new


def trails(batches: Iterator[pa.RecordBatch], keys, longest: int, width: int = L.DIGITS) -> Iterator[tuple[pa.RecordBatch, Trail]]:
    """Batches of rows sorted by series and date, each with what lies before its rows.

    Values other than digits, and nulls, take a row of the series but count for no digit.
    """
    key, tail, rn, seen = None, np.empty(0, np.int64), 0, np.zeros(width, np.int64)
    for batch in batches:
        m = batch.num_rows
        if m == 0:
            continue
        columns = [batch.column(k) for k in keys]
        new = series_starts(columns, key)
        goes_on = not new[0]
        if not goes_on:
            tail, rn, seen = tail[:0], 0, np.zeros(width, np.int64)
        values = np.concatenate([tail, pc.fill_null(batch.column("value").cast(pa.int64()), -1).to_numpy(zero_copy_only=False)])
        at = np.arange(len(tail), len(values))
        start = np.maximum.accumulate(np.where(new, at, 0))
        first = int(np.argmax(new)) if new.any() else m
        number = at - start + 1
        number[:first] += rn - len(tail)
        trail = Trail(values, len(tail), start, number, seen, first, width)
        yield batch, trail
        key = [c[m - 1].as_py() for c in columns]
        rn = int(number[-1])
        distance = np.where(np.arange(width) == values[-1], 0, np.where(trail.distance[-1] < 0, -1, trail.distance[-1] + 1))
        seen = np.where(distance < 0, 0, rn - distance)
        tail = values[max(start[-1], len(values) - longest):]


def over_series(long: DataFrame, make: Callable[[Trail], dict[str, pa.Array]], types: dict[str, str], longest: int = 0, keys=SERIES, keep=(),
                form: Callable[[pa.Array], pa.Array] | None = None, width: int = L.DIGITS, size: str | None = None) -> DataFrame:
    """``keep`` columns of every row, and the columns that ``make`` works out from its trail; ``types`` are those of its columns.

    ``longest`` is the largest window that ``make`` asks for. The rows move and are sorted once.
    Lists pass through ``form``, where one is given, and are then strings: lists that are only to be
    written as text need not travel as such. Values are 0 to ``width`` - 1; the lists of a row end after as many
    of them as its column ``size`` says, if one is named.
    """
    arrays = {n for n, kind in types.items() if form is not None and kind.startswith("array<")}
    types = {n: "string" if n in arrays else kind for n, kind in types.items()}
    used = list(dict.fromkeys([*keys, "obs_date", "value", *keep, *([size] if size else [])]))
    rows = long.select(*used).repartition(*keys).sortWithinPartitions(*keys, "obs_date")
    made = T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in types.items()))
    schema = T.StructType([*(T.StructField(k, long.schema[k].dataType) for k in keep), *made.fields])

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, trail in trails(batches, keys, longest, width):
            columns = make(trail)
            if size:
                columns = {n: cut(c, batch.column(size).to_numpy(zero_copy_only=False)) if pa.types.is_list(c.type) else c for n, c in columns.items()}
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(form(columns[n]) if n in arrays else columns[n] for n in types)], names=[*keep, *types])

    return rows.mapInArrow(worked, schema)


class Steps:
    """Counts of the steps of one digit column from its last value, before each row, over batches of sorted rows."""

    def __init__(self):
        self.restart()

    def restart(self) -> None:
        self.last, self.counts = -1, np.zeros((L.DIGITS, L.DIGITS), np.int64)

    def before(self, values: np.ndarray, series: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, counts): the rows that have a value before them, and how often each digit had followed that value before.

        ``series`` numbers the series of the rows from 0, which is the one that goes on from the batch
        before. What is no digit is no row here.
        """
        at = np.flatnonzero((values >= 0) & (values < L.DIGITS))
        x, s = values[at], series[at]
        last = np.concatenate([[self.last], x[:-1]])[: len(x)]
        last[np.concatenate([[s[0] != 0], s[1:] != s[:-1]]) if len(s) else []] = -1
        known = np.flatnonzero(last >= 0)
        group = s[known] * L.DIGITS + last[known]
        order = known[np.argsort(group, kind="stable")]
        group = s[order] * L.DIGITS + last[order]
        sums = running((x[order][:, None] == np.arange(L.DIGITS)).astype(np.int64))
        first = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]])[: len(group)], np.arange(len(group)), 0)) if len(group) else group
        counts = sums[: len(group)] - sums[first]
        counts += np.where((s[order] == 0)[:, None], self.counts[last[order]], 0)
        if series[-1] != 0:
            self.restart()
        own = known[s[known] == series[-1]]
        self.counts = self.counts + np.bincount(last[own] * L.DIGITS + x[own], minlength=L.DIGITS**2).reshape(L.DIGITS, L.DIGITS)
        if len(s) and s[-1] == series[-1]:
            self.last = x[-1]
        return at[order], counts


def step_probabilities(df: DataFrame, columns: dict[str, str], smoothing: float = 1.0, keep=(), parts: int | None = None, key: str = "entity_id", date: str = "obs_date") -> DataFrame:
    """Smoothed probabilities of the next value of each digit column, from the steps of its series strictly before the row.

    ``columns`` names the result of each digit column: ten probabilities, null where no value is before
    the row; rows without any are left out. One pass over the rows of a key in order, which move once.
    """
    used = list(dict.fromkeys([key, date, *columns, *keep]))
    rows = df.select(*used).repartition(*([parts] if parts else []), key).sortWithinPartitions(key, date)
    schema = T.StructType([*(T.StructField(k, df.schema[k].dataType) for k in (key, date, *keep)), *(T.StructField(n, T.ArrayType(T.DoubleType())) for n in columns.values())])

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, steps = None, {c: Steps() for c in columns}
        for batch in batches:
            m = batch.num_rows
            if m == 0:
                continue
            series = np.cumsum(series_starts([batch.column(key)], before))
            before, some, out = [batch.column(key)[m - 1].as_py()], np.zeros(m, bool), []
            offsets = pa.array(np.arange(0, m * L.DIGITS + 1, L.DIGITS, dtype=np.int32))
            for c in columns:
                at, counts = steps[c].before(pc.fill_null(batch.column(c).cast(pa.int64()), -1).to_numpy(zero_copy_only=False), series)
                probs, none = np.zeros((m, L.DIGITS)), np.ones(m, bool)
                probs[at] = (counts + smoothing) / (counts.sum(axis=1, keepdims=True) + smoothing * L.DIGITS)
                none[at], some[at] = False, True
                out.append(pa.ListArray.from_arrays(offsets, pa.array(probs.ravel()), mask=pa.array(none)))
            made = pa.RecordBatch.from_arrays([*(batch.column(k) for k in (key, date, *keep)), *out], names=schema.names)
            yield made.filter(pa.array(some))

    return rows.mapInArrow(worked, schema)
