"""Temporal splits, fold tables and walk-forward evaluation."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsframe import layout as L
from obsframe.operators.scans import history, prior


def _dates(df: DataFrame, keys, date: str) -> DataFrame:
    """Distinct dates of each key with their index; bounded by the calendar."""
    d = df.select(*keys, date).distinct()
    w = Window.partitionBy(*keys)
    return d.withColumns(
        {"i": F.row_number().over(w.orderBy(date)).cast("int") - 1, "n": F.count("*").over(w)}
    )


def ratio_split(df: DataFrame, keys=("entity_id",), date: str = "obs_date", train: float = 0.7,
                validation: float = 0.15, min_train: int = 100) -> DataFrame:
    """Chronological train / validation / test label of every row.

    Training takes ``min_train`` dates at least, validation one; keys that leave no test date stay unsplit.
    """
    rows = df.join(_dates(df, keys, date), [*keys, date])
    i, n = F.col("i"), F.col("n")
    first = F.greatest(F.lit(min_train), F.floor(n * train))
    second = first + F.greatest(F.lit(1), F.floor(n * validation))
    label = F.when((n < min_train + 3) | (second >= n), "INSUFFICIENT").when(i < first, "TRAIN").when(i < second, "VALIDATION").otherwise("TEST")
    return rows.withColumn("split", label).drop("i", "n")


def expanding_folds(df: DataFrame, initial: int, size: int, step: int, keys=("entity_id",), date: str = "obs_date") -> DataFrame:
    """Fold table: train from the first date, test of ``size`` dates, ragged last fold."""
    dates = _dates(df, keys, date)
    packed = dates.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", date))), lambda x: x[date]).alias("d"), F.max("n").alias("n")
    ).where(F.col("n") > initial)
    starts = packed.select(
        *keys, "d", "n", F.posexplode(F.sequence(F.lit(initial), (F.col("n") - 1).cast("int"), F.lit(step))).alias("fold", "s")
    )
    return starts.select(
        *keys, (F.col("fold") + 1).alias("fold"), F.get("d", F.lit(0)).alias("train_start"),
        F.get("d", F.col("s") - 1).alias("train_end"), F.get("d", F.col("s")).alias("test_start"),
        F.get("d", F.least(F.col("s") + size, F.col("n").cast("int")) - 1).alias("test_end"),
    )


def assign_folds(df: DataFrame, folds: DataFrame, keys=("entity_id",), date: str = "obs_date") -> DataFrame:
    """Rows inside each fold's test dates, by equal key and date range."""
    return df.join(folds, list(keys)).where(F.col(date).between(F.col("test_start"), F.col("test_end")))


def split_at(df: DataFrame, date: str, cut) -> DataFrame:
    return df.withColumn("split", F.when(F.col(date) <= F.lit(cut).cast("date"), "TRAIN").otherwise("VALIDATION"))


def sequence_samples(df: DataFrame, length: int) -> DataFrame:
    """Full windows of ``length`` rows with the first row after them as target."""
    w = history("entity_id")
    rows = df.withColumn("positions", F.array(*L.POSITIONS))
    out = rows.select(
        "entity_id", F.col("obs_date").alias("window_end"),
        F.collect_list(F.struct("obs_date", "positions")).over(w.rowsBetween(-(length - 1), 0)).alias("rows"),
        F.lead("obs_date").over(w).alias("target_date"), F.lead("positions").over(w).alias("target"),
    )
    return out.where((F.size("rows") == length) & F.col("target_date").isNotNull())


def history_dataset(df: DataFrame, lags=L.LAGS, windows=(3, 7, 14)) -> DataFrame:
    """Per-row modelling table: zero-filled lags, rolling moments, dates, changes, targets."""
    w = history("entity_id")
    cols = {}
    for p in L.POSITIONS:
        for k in lags:
            cols[f"{p}_lag_{k}"] = F.coalesce(F.lag(p, k).over(w), F.lit(0))
    total = sum((F.col(p) for p in L.POSITIONS[1:]), F.col(L.POSITIONS[0]))
    step = df.withColumn("_total", total)
    for n in windows:
        f = prior(w, n)
        cols[f"rolling_mean_{n}"] = F.round(F.coalesce(F.avg(F.col("_total") / 8.0).over(f), F.lit(0.0)), 8)
        cols[f"rolling_sum_{n}"] = F.coalesce(F.sum("_total").over(f), F.lit(0))
    cols["change_sum"] = F.coalesce(sum(
        (F.abs(F.lag(p, 1).over(w) - F.lag(p, 2).over(w)) for p in L.POSITIONS[1:]),
        F.abs(F.lag("p1", 1).over(w) - F.lag("p1", 2).over(w)),
    ), F.lit(0))
    dates = {"day_of_week": F.weekday("obs_date"), "month": F.month("obs_date"), "quarter": F.quarter("obs_date"), "year": F.year("obs_date")}
    targets = {f"target_{p}": F.col(p) for p in ("p4", "p5", "p6", "p7", "p8")}
    return step.select(
        "entity_id", "obs_date", *[c.alias(n) for n, c in {**cols, **dates, **targets}.items()]
    )


def conditional_rates(df: DataFrame, source: str = "p1", target: str = "p4") -> DataFrame:
    """P(target = d | source digit of the row) from strictly earlier rows, as 10-vectors."""
    w = prior(history("entity_id", source))
    step = df.select(
        "entity_id", "obs_date", source, target, F.count("*").over(w).alias("_n"),
        *[F.count_if(F.col(target) == d).over(w).alias(f"_c{d}") for d in range(L.DIGITS)],
    )
    n = F.nullif(F.col("_n").cast("double"), F.lit(0.0))
    return step.select(
        "entity_id", "obs_date", source, F.col("_n").alias("support"),
        F.array(*[F.coalesce(F.col(f"_c{d}") / n, F.lit(0.0)) for d in range(L.DIGITS)]).alias("rates"),
    )
