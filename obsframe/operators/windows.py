"""Point-in-time features: every frame ends on the row before the target.

Wide operators take observation rows and one (entity) window; long operators
take (entity, date, position, value) rows and an (entity, position) window.
A series has one row per date, so window partitions are bounded by the
calendar, and entities spread over the cluster.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsframe import layout as L
from obsframe.functions import stats as S
from obsframe.operators import trailing as TR
from obsframe.operators.scans import history, prior

IDS = ("entity_id", "obs_date")
SERIES = ("entity_id", "position")


def lag_features(df: DataFrame, lags=L.LAGS, positions=L.POSITIONS) -> DataFrame:
    w = history("entity_id")
    return df.select(
        *IDS, *[F.lag(p, k).over(w).alias(f"{p}_lag_{k}") for p in positions for k in lags]
    )


def rolling_features(df: DataFrame, windows=L.ROLLING_WINDOWS, positions=L.POSITIONS) -> DataFrame:
    """Mean, min and max of the last w prior rows (fewer when history is short)."""
    w = history("entity_id")
    cols = [F.count("*").over(prior(w, n)).alias(f"rows_{n}") for n in windows]
    for p in positions:
        for n in windows:
            frame = prior(w, n)
            cols += [
                F.avg(p).over(frame).alias(f"{p}_mean_{n}"),
                F.min(p).over(frame).alias(f"{p}_min_{n}"),
                F.max(p).over(frame).alias(f"{p}_max_{n}"),
            ]
    return df.select(*IDS, *cols)


def window_counts(long: DataFrame, windows=L.FREQUENCY_WINDOWS, keys=SERIES, keep=()) -> DataFrame:
    """Digit counts of the last w prior rows, for all w at once.

    Differences of one running count replace a recount per frame, so the cost
    per row does not depend on the window lengths and all windows share a sort.
    """
    kept = [*[k for k in keys if k != "position"], "obs_date", "position", "value"]
    types = {"rn": "int", **{f"counts_{n}": "array<bigint>" for n in windows}, **{f"rows_{n}": "int" for n in windows}}

    def make(t: TR.Trail) -> dict:
        return {"rn": _ints(t.rn), **{f"counts_{n}": TR.lists(t.counts(n)) for n in windows}, **{f"rows_{n}": pa.array(t.rows(n)) for n in windows}}

    out = TR.over_series(long, make, types, max(windows), keys, [*kept, *keep])
    return out.select(*kept, "rn", *keep, *[f"counts_{n}" for n in windows], *[f"rows_{n}" for n in windows])


def _ints(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int32))


def _pcts(counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.where(rows[:, None] > 0, counts * 100.0 / np.maximum(rows, 1)[:, None], 0.0)


def _over(counts: str, total: Column) -> Column:
    return F.transform(counts, lambda c: c / F.nullif(total, F.lit(0.0)))


def _equals(values: str, k: int) -> Column:
    return F.transform(values, lambda i: (i == k).cast("int"))


def frequency_features(long: DataFrame, windows=(L.FREQUENCY_WINDOW,), counts: bool = True,
                       keys=SERIES, form=None) -> DataFrame:
    """Digit counts and percentages per window as 10-vectors, passed through ``form`` where one is given."""
    types = {f"rows_{n}": "int" for n in windows}
    for n in windows:
        types |= ({f"counts_{n}": "array<bigint>"} if counts else {}) | {f"pct_{n}": "array<double>"}

    def make(t: TR.Trail) -> dict:
        out = {}
        for n in windows:
            c, rows = t.counts(n), t.rows(n)
            out |= {f"rows_{n}": pa.array(rows), f"counts_{n}": TR.lists(c), f"pct_{n}": TR.lists(_pcts(c, rows))}
        return out

    return TR.over_series(long, make, types, max(windows), keys, [*IDS, "position"], form)


def frequency_change(long: DataFrame, pairs=((3, 3), (5, 5))) -> DataFrame:
    """Older minus recent percentage of each (older, recent) window pair."""
    base = frequency_features(long, tuple(sorted({n for p in pairs for n in p})), counts=False)
    return base.select(
        *IDS, "position",
        *[
            F.zip_with(f"pct_{a}", f"pct_{b}", lambda x, y: x - y).alias(f"change_{a}_{b}")
            for a, b in pairs
        ],
    )


def regime(dominant_pct: Column, entropy: Column) -> Column:
    return (
        F.when(dominant_pct.isNull(), "INSUFFICIENT_DATA")
        .when(dominant_pct >= L.CONCENTRATED_PCT, "CONCENTRATED")
        .when(entropy >= L.DIVERSE_BITS, "DIVERSE")
        .otherwise("BALANCED")
    )


def _regimes(dominant_pct: np.ndarray, entropy: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``regime`` of many rows; no rows are too few."""
    return np.select(
        [rows == 0, dominant_pct >= L.CONCENTRATED_PCT, entropy >= L.DIVERSE_BITS],
        ["INSUFFICIENT_DATA", "CONCENTRATED", "DIVERSE"], "BALANCED",
    )


def _bits(counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Entropy of each row's counts, added up in the order of the digits."""
    total = np.zeros(len(rows))
    for d in range(L.DIGITS):
        p = counts[:, d] / rows
        total += np.where(p > 0, -p * np.log2(np.where(p > 0, p, 1.0)), 0.0)
    return total


def concentration_features(long: DataFrame, windows=L.FREQUENCY_WINDOWS) -> DataFrame:
    """Dominant digit, its share, entropy and regime of each trailing window."""
    kinds = {"dominant": "int", "dominant_pct": "double", "entropy": "double", "norm_entropy": "double", "regime": "string"}
    types = {f"{name}_{n}": kind for n in windows for name, kind in kinds.items()}

    def make(t: TR.Trail) -> dict:
        out = {}
        for n in windows:
            c, rows = t.counts(n), t.rows(n)
            none, total = rows == 0, np.maximum(rows, 1)
            share, entropy = c.max(axis=1) * 100.0 / total, _bits(c, total)
            out |= {
                f"dominant_{n}": pa.array(c.argmax(axis=1).astype(np.int32), mask=none),
                f"dominant_pct_{n}": pa.array(share, mask=none), f"entropy_{n}": pa.array(entropy, mask=none),
                f"norm_entropy_{n}": pa.array(entropy / np.log2(10.0), mask=none),
                f"regime_{n}": pa.array(_regimes(share, entropy, rows), pa.string()),
            }
        return out

    return TR.over_series(long, make, types, max(windows), keep=[*IDS, "position"])


def last_seen(long: DataFrame, keys=SERIES) -> DataFrame:
    """Rows since each digit was last seen (0 = previous row), NULL if never.

    One running maximum per digit serves every lookback.
    """
    def make(t: TR.Trail) -> dict:
        return {"rn": _ints(t.rn), "distance": TR.lists(t.distance, t.distance < 0)}

    return TR.over_series(long, make, {"rn": "int", "distance": "array<int>"}, keys=keys, keep=long.columns)


def _within(lookback: int) -> Column:
    return F.transform("distance", lambda d: F.when(d < lookback, d))


def recency_features(long: DataFrame, lookback: int = L.RECENCY_LOOKBACK) -> DataFrame:
    return last_seen(long).select(
        *IDS, "position", _within(lookback).alias("recency"),
        F.transform("distance", lambda d: F.coalesce((d < lookback).cast("int"), F.lit(0))).alias("seen"),
    )


def recency_expansion(long: DataFrame, lookbacks=L.RECENCY_LOOKBACKS, form=None) -> DataFrame:
    """Count, count / lookback, last distance and seen flag per lookback; lists pass through ``form`` where one is given."""
    kinds = {"count": "array<bigint>", "rate": "array<double>", "last": "array<int>", "seen": "array<int>"}
    types = {f"{name}_{n}": kind for n in lookbacks for name, kind in kinds.items()}

    def make(t: TR.Trail) -> dict:
        out, far = {}, t.distance
        for n in lookbacks:
            c = t.counts(n)
            out |= {
                f"count_{n}": TR.lists(c), f"rate_{n}": TR.lists(c / float(n)),
                f"last_{n}": TR.lists(far, (far < 0) | (far >= n)), f"seen_{n}": TR.lists((c > 0).astype(np.int32)),
            }
        return out

    return TR.over_series(long, make, types, max(lookbacks), keep=[*IDS, "position"], form=form)


def recency_distribution(long: DataFrame, lookback: int = L.RECENCY_LOOKBACK, form=None) -> DataFrame:
    """Mean, min, max, deviation and span of each digit's distances in the lookback.

    Sums of distances and their squares are exact integers. Lists pass through ``form`` where one is given.
    """
    types = {"count": "array<bigint>", "rate": "array<double>", "mean": "array<double>", "min": "array<bigint>", "max": "array<bigint>", "std": "array<double>", "span": "array<bigint>"}

    def make(t: TR.Trail) -> dict:
        m = t.moments(lookback)
        n, none = np.maximum(m["n"], 1).astype(float), m["n"] == 0
        std = np.sqrt(np.maximum(m["n"] * m["q"] - m["s"] * m["s"], 0) / (n * n))
        return {
            "count": TR.lists(m["n"]), "rate": TR.lists(m["n"] / float(lookback)), "mean": TR.lists(m["s"] / n, none), "min": TR.lists(m["lo"], none),
            "max": TR.lists(m["hi"], none), "std": TR.lists(std, none), "span": TR.lists(m["hi"] - m["lo"], none),
        }

    return TR.over_series(long, make, types, lookback, keep=[*IDS, "position"], form=form)


def bucket_labels(bounds=L.BUCKET_BOUNDS) -> list[str]:
    low = 0
    labels = []
    for b in bounds:
        labels.append(f"RECENT_{low}_{b}")
        low = b + 1
    return [*labels, f"STALE_{low}_PLUS", "UNSEEN"]


def recency_buckets(long: DataFrame, bounds=L.BUCKET_BOUNDS) -> DataFrame:
    """Bucket index and label of each digit's distance over all prior rows."""

    def index(d):
        out = F.when(d.isNull(), len(bounds) + 1)
        for i, b in enumerate(bounds):
            out = out.when(d <= b, i)
        return out.otherwise(len(bounds))

    labels = F.array(*[F.lit(x) for x in bucket_labels(bounds)])
    step = last_seen(long).withColumn("bucket", F.transform("distance", index))
    return step.select(
        *IDS, "position", "bucket",
        F.transform("bucket", lambda i: F.get(labels, i)).alias("label"),
        *[
            _equals("bucket", k).alias(f"is_{k}")
            for k in range(len(bounds) + 2)
        ],
    )


def change_features(df: DataFrame, positions=L.POSITIONS) -> DataFrame:
    """Last step of the history: change, size, direction, changed flag."""
    w = history("entity_id")
    cols = []
    for p in positions:
        change = F.lag(p, 1).over(w) - F.lag(p, 2).over(w)
        cols += [
            change.alias(f"{p}_change"), F.abs(change).alias(f"{p}_abs_change"),
            S.direction(change, "INCREASE", "DECREASE", "UNCHANGED").alias(f"{p}_direction"),
            (change != 0).cast("int").alias(f"{p}_changed"),
        ]
    return df.select(*IDS, *cols)


def trend_features(df: DataFrame, windows=L.TREND_WINDOWS, positions=L.POSITIONS) -> DataFrame:
    """Mean, range, deviation, net change and OLS slope of each trailing window.

    The slope does not depend on the origin of the index, so the running row
    number serves every window.
    """
    w = history("entity_id")
    step = df.withColumn("rn", F.row_number().over(w).cast("double"))
    cols = []
    for p in positions:
        for n in windows:
            f = prior(w, n)
            rows = F.count(p).over(f)
            slope = F.covar_pop("rn", p).over(f) / F.nullif(F.var_pop("rn").over(f), F.lit(0.0))
            cols += [
                F.avg(p).over(f).alias(f"{p}_mean_{n}"),
                F.min(p).over(f).alias(f"{p}_min_{n}"), F.max(p).over(f).alias(f"{p}_max_{n}"),
                (F.max(p).over(f) - F.min(p).over(f)).alias(f"{p}_range_{n}"),
                F.stddev_pop(p).over(f).alias(f"{p}_std_{n}"),
                F.when(rows >= 2, F.last(p).over(f) - F.first(p).over(f)).alias(f"{p}_net_{n}"),
                F.when(rows >= 2, slope).alias(f"{p}_slope_{n}"),
            ]
    return step.select(*IDS, *cols)


def interval_features(df: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Days since the last and first date, span, and gap statistics of the history."""
    w = history(entity)
    step = df.select(
        entity, "obs_date", F.datediff("obs_date", F.lag("obs_date").over(w)).alias("gap")
    )
    f = prior(w)
    first, last = F.min("obs_date").over(f), F.lag("obs_date").over(w)
    return step.select(
        entity, "obs_date",
        F.datediff("obs_date", last).alias("days_since_last"),
        F.datediff("obs_date", first).alias("days_since_first"),
        F.datediff(last, first).alias("span_days"),
        F.count("gap").over(f).alias("n_gaps"),
        F.avg("gap").over(f).alias("mean_gap"), F.min("gap").over(f).alias("min_gap"),
        F.max("gap").over(f).alias("max_gap"), F.stddev_pop("gap").over(f).alias("std_gap"),
    )


def density_features(df: DataFrame, days=L.DENSITY_DAYS, entity: str = "entity_id") -> DataFrame:
    """Observations in calendar windows [t − days, t), and density of all history."""
    step = df.select(
        entity, "obs_date",
        F.datediff("obs_date", F.lit("1970-01-01").cast("date")).alias("day"),
        F.datediff("obs_date", F.lag("obs_date").over(history(entity))).alias("gap"),
    )
    by_day = Window.partitionBy(entity).orderBy("day")
    every = prior(history(entity))
    cols = []
    for n in days:
        hits = F.count("*").over(by_day.rangeBetween(-n, -1))
        cols += [hits.alias(f"count_{n}"), (hits / float(n)).alias(f"rate_{n}")]
    total = F.nullif(F.count("*").over(every), F.lit(0))
    span = F.datediff(F.max("obs_date").over(every), F.min("obs_date").over(every))
    return step.select(
        entity, "obs_date", *cols,
        total.alias("total_count"), span.alias("span_days"),
        (total / F.nullif(span.cast("double"), F.lit(0.0))).alias("density_rate"),
        F.avg("gap").over(every).alias("average_interval"),
        F.stddev_pop("gap").over(every).alias("interval_std"),
    )


def sequence_features(long: DataFrame, window: int = L.ROLLING_WINDOWS[0]) -> DataFrame:
    """Previous and latest value, their transition, and its count in the window.

    ``window`` rows hold ``window − 1`` transitions.
    """
    w = history(*SERIES)
    step = long.select(
        *IDS, "position",
        F.lag("value", 2).over(w).alias("previous"), F.lag("value", 1).over(w).alias("latest"),
        *[F.lag("value", k + 1).over(w).alias(f"_v{k}") for k in range(window)],
    )
    pair = lambda k: F.struct(F.col(f"_v{k + 1}"), F.col(f"_v{k}"))
    latest = F.col("_v0").isNotNull() & F.col("_v1").isNotNull()
    hits, total = F.lit(0), F.lit(0)
    for k in range(window - 1):
        there = F.col(f"_v{k + 1}").isNotNull()
        hits = hits + (latest & there & (pair(k) == pair(0))).cast("int")
        total = total + there.cast("int")
    return step.select(
        *IDS, "position", "previous", "latest",
        F.concat(F.col("previous").cast("string"), F.lit("_to_"), F.col("latest").cast("string"))
        .alias("transition"),
        F.abs(F.col("latest") - F.col("previous")).alias("distance"),
        (F.col("latest") != F.col("previous")).cast("int").alias("changed"),
        hits.alias("transition_count"),
        S.pct(hits, total).alias("transition_pct"),
    )


def position_transitions(long: DataFrame) -> DataFrame:
    """(from, to) of every pair of consecutive rows of a position."""
    return long.select(
        *IDS, "position", F.lag("value").over(history(*SERIES)).alias("from_value"),
        F.col("value").alias("to_value"),
    ).where("from_value is not null")


def transition_frequency(long: DataFrame) -> DataFrame:
    """Transition counts of a series' whole history and their share."""
    counts = position_transitions(long).groupBy(*SERIES, "from_value", "to_value").agg(
        F.count("*").alias("n")
    )
    total = F.sum("n").over(Window.partitionBy(*SERIES))
    return counts.withColumn("pct", F.col("n") * 100.0 / total)


def prior_transition_counts(long: DataFrame) -> DataFrame:
    """How often each step had occurred before, point in time."""
    w = history(*SERIES, "from_value", "to_value")
    return position_transitions(long).withColumn("n_before", F.count("*").over(prior(w)))


def transition_stability(long: DataFrame) -> DataFrame:
    """Dominant transition (lowest from, then to, on ties) and its share.

    One aggregate over at most 100 counts per series; no window is needed.
    """
    return (
        position_transitions(long).groupBy(*SERIES, "from_value", "to_value")
        .agg(F.count("*").alias("n")).groupBy(*SERIES)
        .agg(
            F.sum("n").alias("n_transitions"),
            F.max(F.struct("n", (-F.col("from_value")).alias("f"), (-F.col("to_value")).alias("t"))).alias("d"),
        )
        .select(
            *SERIES, "n_transitions", (-F.col("d.f")).alias("dominant_from"),
            (-F.col("d.t")).alias("dominant_to"), F.col("d.n").alias("dominant_count"),
            (F.col("n_transitions") - F.col("d.n")).alias("n_changes"),
            (F.col("d.n") * 100.0 / F.col("n_transitions")).alias("stability_pct"),
        )
    )


def rolling_rates(long: DataFrame, windows=(3, 7, 14)) -> DataFrame:
    """Digit shares of the last w prior rows, rounded to 8 places."""
    base = window_counts(long, windows)
    return base.select(
        *IDS, "position",
        *[
            F.transform(
                _over(f"counts_{n}", F.col(f"rows_{n}").cast("double")),
                lambda x: F.round(F.coalesce(x, F.lit(0.0)), 8),
            ).alias(f"rate_{n}")
            for n in windows
        ],
    )


def sliding_windows(df: DataFrame, length: int, allow_incomplete: bool = False,
                    positions=L.POSITIONS) -> DataFrame:
    """Arrays of the last ``length`` rows, the current one included."""
    w = history("entity_id").rowsBetween(-(length - 1), 0)
    out = df.select(
        *IDS, F.row_number().over(history("entity_id")).alias("window_index"),
        F.collect_list(F.struct("obs_date", F.array(*positions).alias("positions"))).over(w).alias("rows"),
    )
    if not allow_incomplete:
        out = out.where(F.size("rows") == length).withColumn(
            "window_index", F.col("window_index") - (length - 1)
        )
    return out


# -- generic sequence helpers -------------------------------------------------


def competition_rank(df: DataFrame, metric: str, keys=()) -> DataFrame:
    """1, 1, 3 ranks, largest first; for already aggregated tables."""
    return df.withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(metric))))


def unique_rank(df: DataFrame, metric: str, tie: str, keys=()) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(metric), tie)
    return df.withColumn("rank", F.row_number().over(w))


def runs(df: DataFrame, keys, order: str, label: str) -> DataFrame:
    """Islands of equal labels: run number, label, length, first and last order."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = df.withColumn(
        "_new", F.when(F.col(label).eqNullSafe(F.lag(label).over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), 0)
        .otherwise(1)
    ).withColumn("run", F.sum("_new").over(w))
    return step.groupBy(*keys, "run").agg(
        F.first(label).alias(label), F.count("*").alias("length"),
        F.min(order).alias("first_order"), F.max(order).alias("last_order"),
    )


def direction_streaks(df: DataFrame, keys, order: str, label: str, flat: str = "UNCHANGED") -> DataFrame:
    """Longest run of one direction, and switches between adjacent moves."""
    longest = runs(df, keys, order, label).groupBy(*keys).agg(F.max("length").alias("max_streak"))
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(label).over(w)
    switch = (before != F.col(label)) & (before != flat) & (F.col(label) != flat)
    switches = df.select(*keys, switch.alias("s")).groupBy(*keys).agg(
        F.count_if("s").alias("n_switches")
    )
    return longest.join(switches, list(keys))


def trailing_run(df: DataFrame, keys, order: str, flag: str) -> DataFrame:
    """Length of the run of true flags that ends at the latest row.

    Counts the rows after the last false one: two combined aggregates, no sort.
    """
    last_false = df.groupBy(*keys).agg(
        F.max(F.when(~F.coalesce(F.col(flag), F.lit(False)), F.col(order))).alias("_last")
    )
    after = F.col("_last").isNull() | (F.col(order) > F.col("_last"))
    return df.join(last_false, list(keys)).groupBy(*keys).agg(
        F.count_if(after).alias("trailing_run")
    )


def row_windows(df: DataFrame, keys, size: int, date: str = "obs_date") -> DataFrame:
    """1-based tumbling windows of ``size`` consecutive rows; the last may be short."""
    rn = F.row_number().over(history(*keys, date=date))
    return df.withColumn("window_index", (F.floor((rn - 1) / size) + 1).cast("int"))


def periods(df: DataFrame, keys, days: int = L.PERIOD_DAYS, date: str = "target_date") -> DataFrame:
    """Calendar periods of ``days`` days anchored at the first date of each key.

    The anchor is a combined aggregate joined back (one row per key), not a
    window over the key's rows.
    """
    keys = list(keys)
    anchor = df.groupBy(*keys).agg(F.min(date).alias("_anchor"))
    if keys:
        out = df.join(anchor, keys)
    else:
        out = df.join(F.broadcast(anchor))
    index = F.floor(F.datediff(date, "_anchor") / days).cast("int")
    return out.withColumns(
        {
            "period_index": index,
            "period_start": F.date_add("_anchor", index * days),
            "period_end": F.date_add("_anchor", index * days + (days - 1)),
        }
    ).drop("_anchor")
