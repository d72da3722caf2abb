"""Walk-forward evaluation of a user's predictor, and backtests of consensus rows."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsframe import layout as L

SERIES = ("entity_id", "position")
#: Rows (test observations) by ten probabilities, from the symbols of the training and of the test rows.
Predictor = Callable[[np.ndarray, np.ndarray], np.ndarray]
FOLDED = "fold int, train_end int, test_start int, test_end int, obs_date date, target int, probs array<double>"
CLIP = 1e-15


def smoothed_shares(train: np.ndarray, test: np.ndarray) -> np.ndarray:
    """The default predictor: add-one shares of the training symbols, for every test row."""
    counts = np.bincount(train, minlength=L.DIGITS) + 1.0
    return np.tile(counts / counts.sum(), (len(test), 1))


def predict_folds(long: DataFrame, predictor: Predictor, initial: int, size: int = 1, step: int = 1, keys=SERIES) -> DataFrame:
    """Probability rows of every test observation of every expanding fold, by ``predictor(train, test)``.

    Folds count rows of a series in date order: training takes the first ``initial`` rows and grows
    by ``step``; the next ``size`` rows are tested, fewer at the end. Series without a test row give
    none. A predictor must return one row of ten finite shares, none negative and summing to one,
    for each test row; otherwise the job fails.

    A series is one group, which the calendar bounds, and its folds are views of one array: the
    training rows are never copied for each fold.
    """
    if min(initial, size, step) < 1:
        raise ValueError("initial, size and step must be positive")

    def folds(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("obs_date", kind="stable")
        symbols, dates = pdf["value"].to_numpy(int), pdf["obs_date"].to_numpy()
        parts = []
        for fold, end in enumerate(range(initial, len(symbols), step)):
            stop = min(end + size, len(symbols))
            probs = np.asarray(predictor(symbols[:end], symbols[end:stop]), float)
            if probs.shape != (stop - end, L.DIGITS) or not np.isfinite(probs).all() or (probs < 0).any() or (abs(probs.sum(axis=1) - 1) > 1e-6).any():
                raise ValueError(f"fold {fold} of {key}: the predictor must return a row of ten shares for each test row")
            parts.append(pd.DataFrame({
                "fold": np.int32(fold), "train_end": np.int32(end), "test_start": np.int32(end), "test_end": np.int32(stop),
                "obs_date": dates[end:stop], "target": symbols[end:stop].astype("int32"), "probs": list(probs),
            }))
        out = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["fold", "train_end", "test_start", "test_end", "obs_date", "target", "probs"])
        for name, value in reversed(list(zip(keys, key))):
            out.insert(0, name, value)
        return out

    kinds = ", ".join(f"{k} {long.schema[k].dataType.simpleString()}" for k in keys)
    return long.select(*keys, "obs_date", "value").groupBy(*keys).applyInPandas(folds, f"{kinds}, {FOLDED}")


def scored_rows(rows: DataFrame, top_k: int = 3) -> DataFrame:
    """Per-row log loss, hit, top-k hit, Brier score and margin of the two best symbols (ties: the smaller symbol first)."""
    if not 1 <= top_k <= L.DIGITS:
        raise ValueError("top_k must lie in 1..10")
    p = F.get("probs", F.col("target"))
    each = [F.col("probs")[d] for d in range(L.DIGITS)]
    better = sum((F.when((x > p) | ((x == p) & (F.lit(d) < F.col("target"))), 1).otherwise(0) for d, x in enumerate(each)), F.lit(0))
    best = F.reverse(F.array_sort("probs"))
    gaps = [x - F.when(F.col("target") == d, 1.0).otherwise(0.0) for d, x in enumerate(each)]
    brier = sum((g * g for g in gaps), F.lit(0.0))
    return rows.withColumns({
        "log_loss": -F.ln(F.greatest(p, F.lit(CLIP))), "hit": (better == 0).cast("double"), "top_hit": (better < top_k).cast("double"),
        "brier": brier, "margin": F.get(best, F.lit(0)) - F.get(best, F.lit(1)),
    })


def _means() -> list:
    return [
        F.count("*").alias("n_obs"), F.avg("log_loss").alias("log_loss"), F.avg("hit").alias("accuracy"), F.avg("top_hit").alias("top_k_accuracy"),
        F.avg("brier").alias("brier"), F.avg("margin").alias("margin"),
    ]


def walk_forward_report(folded: DataFrame, top_k: int = 3, keys=SERIES) -> DataFrame:
    """Metrics of each fold, and of all folds' test rows pooled (fold is null) per series.

    One aggregate: fold and pooled rows come from the same pass over the rows.
    """
    rows = scored_rows(folded, top_k)
    sets = rows.select("*", F.explode(F.array(F.col("fold"), F.lit(None).cast("int"))).alias("_fold"))
    out = sets.groupBy(*keys, "_fold").agg(
        *_means(), F.when(F.col("_fold").isNotNull(), F.min("train_end")).alias("train_end"),
        F.when(F.col("_fold").isNotNull(), F.max("test_end")).alias("test_end"), F.count_distinct("fold").alias("n_folds"),
    )
    return out.withColumnRenamed("_fold", "fold")


def consensus_backtest(rows: DataFrame, agreement: DataFrame, top_k: int = 3, by: str = "consensus") -> DataFrame:
    """Metrics of each consensus with its agreement score, and of all of them pooled (``by`` is null).

    ``rows``: probability rows; ``agreement`` holds one score per consensus. Pooled metrics are over all rows,
    the pooled agreement is the plain mean of the scores.
    """
    own = scored_rows(rows, top_k).groupBy(by).agg(*_means()).join(agreement.select(by, "agreement"), by)
    n = F.sum("n_obs")
    mean = lambda c: (F.sum(F.col(c) * F.col("n_obs")) / n).alias(c)
    names = ("log_loss", "accuracy", "top_k_accuracy", "brier", "margin")
    pooled = own.agg(n.alias("n_obs"), *[mean(c) for c in names], F.avg("agreement").alias("agreement")).where("n_obs is not null")
    return own.unionByName(pooled.withColumn(by, F.lit(None).cast(rows.schema[by].dataType)))
