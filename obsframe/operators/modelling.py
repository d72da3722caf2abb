"""The modelling table of past digits, its walk-forward windows, and how a tree depends on groups of its features."""

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsframe import layout as L
from obsframe.operators.evaluation import row_scores
from obsframe.operators.models import score
from obsframe.operators.scans import history
from obsframe.operators.sequences import numbered, rotated, turned
from obsframe.session import cut_lineage

KEYS = ("entity_id", "obs_date")
#: The order in which columns are rotated.
ORDER = ["obs_date", "entity_id"]
# Windows, decimal places, tree and split of the table.
WINDOWS, PLACES = (3, 7, 14), 8
TREE = {"maxDepth": 12, "minInstancesPerNode": 3, "impurity": "gini"}
FIRST_SEED = 901
TRAIN, VALIDATION, LEAST_TRAIN, FOLDS = 0.70, 0.15, 100, 5
TARGETS = ("p4", "p5", "p6", "p7", "p8")
DATES = ("day_of_week", "day_of_month", "month", "quarter", "year")


def _digit_sums(positions) -> dict[str, Column]:
    """Sum, sum of squares and ten counts of the digits of one row."""
    out = {"s": sum((F.col(p) for p in positions[1:]), F.col(positions[0])), "q": sum((F.col(p) * F.col(p) for p in positions[1:]), F.col(positions[0]) * F.col(positions[0]))}
    return out | {f"c{d}": sum(((F.col(p) == d).cast("int") for p in positions[1:]), (F.col(positions[0]) == d).cast("int")) for d in range(L.DIGITS)}


def modelling_rows(df: DataFrame, lags=L.LAGS, windows=WINDOWS) -> DataFrame:
    """One row per observation: head digits, zero-filled lags, and mean, deviation, sum and digit rates of the rows before it.

    Rolling values are over all eight digits of up to 3, 7 and 14 rows before the current one, the
    deviation that of the population; without such a row they are 0. Changes are summed absolute
    differences of the last two rows by code, 0 with fewer than two. All windows share one sort.
    """
    w = history("entity_id")
    step = df.withColumns({f"_{n}": c for n, c in _digit_sums(L.POSITIONS).items()})
    cols = {f"current_{p}": F.col(p) for p in L.CODES["head"]}
    cols |= {f"lag_{k}_{p}": F.coalesce(F.lag(p, k).over(w), F.lit(0)) for k in lags for p in L.POSITIONS}
    share = lambda x, n: F.when(n > 0, F.round(x / n, PLACES)).otherwise(F.lit(0.0))
    for n in windows:
        f = w.rowsBetween(-n, -1)
        total = F.count("*").over(f) * len(L.POSITIONS)
        s, q = F.coalesce(F.sum("_s").over(f), F.lit(0)), F.coalesce(F.sum("_q").over(f), F.lit(0))
        cols[f"rolling_{n}_mean"] = share(s, total)
        cols[f"rolling_{n}_std"] = F.when(total > 0, F.round(F.sqrt(F.greatest((q * total - s * s).cast("double"), F.lit(0.0))) / total, PLACES)).otherwise(F.lit(0.0))
        cols[f"rolling_{n}_sum"] = s
        cols |= {f"rolling_{n}_digit_{d}_rate": share(F.coalesce(F.sum(f"_c{d}").over(f), F.lit(0)), total) for d in range(L.DIGITS)}
    for code, positions in L.CODES.items():
        change = [F.abs(F.lag(p, 1).over(w) - F.lag(p, 2).over(w)) for p in positions]
        cols[f"{code}_change_sum"] = F.coalesce(sum(change[1:], change[0]), F.lit(0))
    cols |= dict(zip(DATES, (F.weekday("obs_date"), F.dayofmonth("obs_date"), F.month("obs_date"), F.quarter("obs_date"), F.year("obs_date"))))
    return step.select(*KEYS, *[c.alias(n) for n, c in cols.items()], *[F.col(p).alias(f"target_{p}") for p in TARGETS])


def feature_columns(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in KEYS and not c.startswith("target_")]


def feature_groups(features) -> dict[str, list[str]]:
    """Groups of the features that are present: head digits now, lags, rolling values, dates, changes."""
    groups = {
        "current": [f for f in features if f.startswith("current_")], "lags": [f for f in features if f.startswith("lag_")],
        "rolling": [f for f in features if f.startswith("rolling_")], "date": [f for f in features if f in DATES],
        "transitions": [f for f in features if f.endswith("change_sum")],
    }
    return {name: own for name, own in groups.items() if own}


def walk_forward_windows(df: DataFrame, keys=("entity_id",), date: str = "obs_date", train: float = TRAIN, validation: float = VALIDATION,
                         least_train: int = LEAST_TRAIN, folds: int = FOLDS) -> DataFrame:
    """Up to ``folds`` windows per key: training up to a validation range that ends where the test range begins.

    The dates after the training and validation shares are cut into equal test ranges, the last one
    with the rest. Each validation range has as many dates as the split's, but begins after the
    training share; a window whose training would have fewer than ``least_train`` dates is left out.
    Keys with fewer than ``least_train`` + 3 dates, or without a test date, have none. Dates of a key
    are bounded by the calendar.
    """
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_set(date)).alias("d")).withColumn("n", F.size("d"))
    packed = packed.withColumns({"t": F.greatest(F.lit(least_train), F.floor(F.col("n") * F.lit(train)).cast("int")), "v": F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(validation)).cast("int"))})
    packed = packed.where((F.col("n") >= least_train + 3) & (F.col("n") - F.col("t") - F.col("v") >= 1))
    open_ = F.col("n") - F.col("t") - F.col("v")
    packed = packed.withColumn("k", F.least(F.lit(folds), open_)).withColumn("size", F.greatest(F.lit(1), F.floor(open_ / F.col("k")).cast("int")))
    rows = packed.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
    begin = F.col("t") + F.col("v") + F.col("i") * F.col("size")
    rows = rows.withColumns({"begin": begin, "end": F.when(F.col("i") == F.col("k") - 1, F.col("n")).otherwise(F.least(F.col("n"), begin + F.col("size"))), "check": F.greatest(F.col("t"), begin - F.col("v"))})
    at = lambda i: F.get("d", i)
    return rows.where((F.col("begin") < F.col("end")) & (F.col("check") >= least_train)).select(
        *keys, (F.col("i") + 1).alias("fold"), at(F.lit(0)).alias("train_start"), at(F.col("check") - 1).alias("train_end"), at(F.col("check")).alias("validation_start"),
        at(F.col("begin") - 1).alias("validation_end"), at(F.col("begin")).alias("test_start"), at(F.col("end") - 1).alias("test_end"),
        F.col("check").alias("train_count"), (F.col("begin") - F.col("check")).alias("validation_count"), (F.col("end") - F.col("begin")).alias("test_count"),
    )


MODES = ("baseline", "remove_current", "rotate_current", "rotate_history")


def perturbed_rows(rows: DataFrame, mode: str, features, fold: int, numbers: int | None = None) -> DataFrame:
    """``rows`` with the head digits set to 0, or columns rotated over all rows in (date, entity) order.

    A column's shift follows from the fold and the length of its name, so the result is the same in
    every run, and columns of different lengths are also moved against each other. ``numbers``: how many
    rows there are, if they have their numbers in that order as ``_number``.
    """
    current = [f for f in features if f.startswith("current_")]
    if mode == "baseline":
        return rows
    if mode == "remove_current":
        return rows.withColumns({f: F.lit(0).cast(rows.schema[f].dataType) for f in current})
    if mode == "rotate_current":
        shifts = {f: fold + len(f) for f in current}
    elif mode == "rotate_history":
        shifts = {f: fold + 3 * len(f) for f in features if f not in current}
    else:
        raise ValueError(f"unknown mode {mode}")
    return rotated(rows, shifts, ORDER) if numbers is None else turned(rows, numbers, shifts)


def fit_tree(rows: DataFrame, features, target: str, seed: int):
    labelled = rows.withColumn("label", F.col(f"target_{target}").cast("double"))
    stages = [VectorAssembler(inputCols=list(features), outputCol="features"), DecisionTreeClassifier(seed=seed, **TREE)]
    return Pipeline(stages=stages).fit(labelled)


def tree_hits(model, rows: DataFrame, ks=(1, 5, 10)) -> DataFrame:
    """One row: how many labelled rows, and how often the actual is among the k most likely digits."""
    scored = row_scores(score(model, rows, "tree"))
    return scored.agg(F.count("*").alias("test_count"), *[F.coalesce(F.avg((F.col("rank") <= k).cast("double")), F.lit(0.0)).alias(f"top{k}") for k in ks])


#: Fits that the driver starts side by side, and rows of a part of a training table, of which there are no more than cores.
PARALLEL, ROWS_PER_PART = 6, 25_000


def stability_report(rows: DataFrame, windows, target: str = "p4", modes=MODES, ablate: bool = True) -> DataFrame:
    """Hits of trees on perturbed rows, and of trees without a group of features, against the baseline of each fold.

    ``windows``: (fold, train_end, test_start, test_end), few and looped over. In a mode, training and
    test rows are perturbed alike and a new tree is fitted; an ablation leaves the group's columns out
    of the fit. ``delta_`` columns are differences to the fold's baseline.

    Rows are numbered in (date, entity) order and written once, as columns and as vectors; those of a range of dates lie
    behind each other in that order. The fits do not depend on each other, so the driver runs some of them side by side,
    and holds one row of hits of each. A fit sends the statistics of its open nodes once for each part of its rows.
    """
    features, day, session = feature_columns(rows), F.col("obs_date"), rows.sparkSession
    assembled = lambda part: VectorAssembler(inputCols=features, outputCol="features").transform(part).select(
        *KEYS, F.col(f"target_{target}").cast("double").alias("label"), "features")
    kept = cut_lineage(numbered(rows, ORDER, "_number"))
    vectors, cores = cut_lineage(assembled(kept)), session.sparkContext.defaultParallelism

    def hits_of(run) -> tuple:
        fold, kind, name, (train, first, n), (test, test_first, m), used = run
        if kind == "ablation" or name == "baseline":
            parts = [vectors.where(train), vectors.where(test)]
        else:
            parts = [assembled(perturbed_rows(kept.where(w).withColumn("_number", F.col("_number") - (at - 1)), name, features, fold, k))
                     for w, at, k in ((train, first, n), (test, test_first, m))]
            parts[0] = cut_lineage(parts[0])
        tree = DecisionTreeClassifier(seed=FIRST_SEED + fold, featuresCol="used", **TREE)
        stages = [VectorSlicer(inputCol="features", outputCol="used", indices=[features.index(f) for f in used]), tree]
        model = Pipeline(stages=stages).fit(parts[0].coalesce(max(1, min(cores, -(-n // ROWS_PER_PART)))))
        return (fold, kind, name, *tree_hits(model, parts[1]).first())

    def part(where) -> tuple:
        first, n = kept.where(where).agg(F.min("_number"), F.count("*")).first()
        return where, first or 1, n

    runs = []
    for fold, train_end, test_start, test_end in windows:
        train, test = part(day <= F.lit(train_end).cast("date")), part(day.between(F.lit(test_start).cast("date"), F.lit(test_end).cast("date")))
        runs += [(fold, "mode", m, train, test, features) for m in modes]
        if ablate:
            runs += [(fold, "ablation", g, train, test, [f for f in features if f not in own]) for g, own in feature_groups(features).items()]
    with ThreadPoolExecutor(PARALLEL) as pool:
        found = list(pool.map(hits_of, runs))
    out = session.createDataFrame(found, "fold int, kind string, name string, test_count long, top1 double, top5 double, top10 double")
    by_fold = Window.partitionBy("fold")
    base = lambda c: F.max(F.when(F.col("name") == "baseline", F.col(c))).over(by_fold)
    return out.withColumns({f"delta_{c}": F.col(c) - base(c) for c in ("top1", "top5", "top10")})


# -- explanation --------------------------------------------------------------

#: Features of a fold that are reported.
TOP_FEATURES = 15


def fold_importances(models: dict[int, object], features) -> list[tuple[int, str, float, float, int]]:
    """(fold, feature, importance, share, rank) of the most important features of each fold's tree; a tree has few of them."""
    rows = []
    for fold, model in models.items():
        values = sorted(zip(features, map(float, model.stages[-1].featureImportances.toArray())), key=lambda x: (-x[1], x[0]))
        total = sum(v for _, v in values)
        rows += [(fold, name, v, v / total if total else 0.0, i) for i, (name, v) in enumerate(values[:TOP_FEATURES], 1)]
    return rows


def importance_summary(importances: DataFrame) -> DataFrame:
    """Per feature: folds that report it, mean share and its deviation over them, share of all means, rank by mean."""
    means = importances.groupBy("feature").agg(F.count("*").alias("n_folds"), F.avg("share").alias("mean_share"), F.stddev_pop("share").alias("std_share"))
    everything = Window.partitionBy()  # features, not rows: as many as the table has columns
    return means.withColumns({
        "normalised": F.coalesce(F.col("mean_share") / F.nullif(F.sum("mean_share").over(everything), F.lit(0.0)), F.lit(0.0)),
        "rank": F.row_number().over(Window.orderBy(F.desc("mean_share"), "feature")),
    }).where(F.col("rank") <= TOP_FEATURES)


def digit_performance(scored: DataFrame, keys=("fold",)) -> DataFrame:
    """For each actual digit: how many rows, and how often it was the most likely and among the five most likely."""
    rows = row_scores(scored)
    counts = rows.groupBy(*keys).agg(F.array(*[
        F.struct(F.lit(d).alias("digit"), F.count_if(F.col("target") == d).alias("support"), F.count_if((F.col("target") == d) & (F.col("rank") == 1)).alias("top1_hits"),
                 F.count_if((F.col("target") == d) & (F.col("rank") <= 5)).alias("top5_hits")) for d in range(L.DIGITS)]).alias("c"))
    share = lambda c: F.coalesce(F.col(f"{c}_hits") / F.nullif(F.col("support"), F.lit(0)), F.lit(0.0)).alias(f"{c}_rate")
    return counts.select(*keys, F.inline("c")).select("*", share("top1"), share("top5"))


def explain_folds(rows: DataFrame, windows, target: str = "p4") -> tuple[DataFrame, DataFrame]:
    """(importance summary over the folds, performance per fold and digit) of one tree per fold; folds are few and looped over."""
    features, day = feature_columns(rows), F.col("obs_date")
    models, scored = {}, []
    for fold, train_end, test_start, test_end in windows:
        models[fold] = fit_tree(rows.where(day <= F.lit(train_end).cast("date")), features, target, FIRST_SEED + fold)
        test = rows.where(day.between(F.lit(test_start).cast("date"), F.lit(test_end).cast("date"))).withColumn("label", F.col(f"target_{target}").cast("double"))
        scored.append(score(models[fold], test, "tree").withColumn("fold", F.lit(fold)))
    schema = "fold int, feature string, importance double, share double, rank int"
    importances = rows.sparkSession.createDataFrame(fold_importances(models, features), schema)
    return importance_summary(importances), digit_performance(reduce(DataFrame.unionByName, scored))
