"""The dataset of a retraining: features with their targets, a split by date, and checks of what was trained on it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shares of the dates and the least number of dates of a dataset.
TRAIN, VALIDATION, LEAST_DATES = 0.70, 0.15, 3
SPLITS = ("TRAIN", "VALIDATION", "TEST")


def missing_targets(features: DataFrame, targets: DataFrame, keys=("entity_id", "obs_date"), target: str = "target") -> DataFrame:
    """Keys of feature rows without a target, or whose target is null, not a number or not finite."""
    kind = dict(targets.dtypes)[target]
    known = F.col(target).isNotNull()
    if kind in ("double", "float"):
        known = known & ~F.isnan(target) & (F.abs(F.col(target)) < float("inf"))
    return features.select(*keys).join(targets.where(known).select(*keys), list(keys), "left_anti")


def features_with_targets(features: DataFrame, targets: DataFrame, keys=("entity_id", "obs_date"), target: str = "target") -> DataFrame:
    """Feature rows with their targets; an error if any is missing, or if a key comes twice on either side.

    Whether one is missing is told while the rows are joined: the left join raises at the first such
    row, so completeness costs no second pass.
    """
    once = lambda df, side: df.groupBy(*keys).count().where("count > 1").limit(1).select(F.raise_error(F.lit(f"a key comes twice among the {side}")).alias("e"))
    for df, side in ((features, "features"), (targets, "targets")):
        once(df.select(*keys), side).collect()
    found = targets.select(*keys, F.col(target).alias("_target"), F.lit(True).alias("_found"))
    joined = features.join(found, list(keys), "left")
    checked = F.when(F.col("_found") & F.col("_target").isNotNull(), F.col("_target")).otherwise(F.raise_error(F.lit("a feature row has no target")).cast(dict(targets.dtypes)[target]))
    return joined.withColumn(target, checked).drop("_target", "_found")


def split_by_date(rows: DataFrame, keys=("entity_id",), date: str = "obs_date", train: float = TRAIN, validation: float = VALIDATION, least: int = LEAST_DATES) -> DataFrame:
    """TRAIN, VALIDATION or TEST of every row by the distinct dates of its key, in order.

    Shares are rounded down, with one date at least, and the rest is TEST; where that would leave no
    TEST date, validation has one and TEST one. Keys with fewer than ``least`` dates, or than three,
    are left out: they have no such split. Distinct dates of a key are bounded by the calendar.
    """
    dates = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(date)).alias("_d"))
    n = F.size("_d")
    first, second = F.greatest(F.lit(1), F.floor(n * F.lit(train)).cast("int")), F.greatest(F.lit(1), F.floor(n * F.lit(validation)).cast("int"))
    full = first + second >= n
    first, second = F.when(full, n - 2).otherwise(first), F.when(full, F.lit(1)).otherwise(second)
    cuts = dates.where(n >= max(least, 3)).select(*keys, F.get("_d", first - 1).alias("_a"), F.get("_d", first + second - 1).alias("_b"))
    label = F.when(F.col(date) <= F.col("_a"), "TRAIN").when(F.col(date) <= F.col("_b"), "VALIDATION").otherwise("TEST")
    return rows.join(cuts, list(keys)).withColumn("split", label).drop("_a", "_b")


def row_identity(columns) -> Column:
    """SHA-256 of a row's feature values with their names, in name order; nulls are kept apart from empty texts."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def retraining_dataset(features: DataFrame, targets: DataFrame, keys=("entity_id", "obs_date"), target: str = "target") -> DataFrame:
    """Complete, split rows with the identity of their features; ``keys`` end with the date."""
    names = [c for c in features.columns if c not in keys]
    rows = features_with_targets(features, targets, keys, target)
    return split_by_date(rows, keys[:-1], keys[-1]).withColumn("row_identity", row_identity(names))


def split_metrics(scored: DataFrame) -> DataFrame:
    """Rows, accuracy, macro F1 and log loss of each split; ``scored`` has split, target and probs.

    A split's confusion counts are at most a hundred rows; F1 is the mean over the digits that occur as target or prediction.
    """
    p = F.get("probs", F.col("target"))
    prediction = F.array_position("probs", F.array_max("probs")).cast("int") - 1
    cells = scored.select("split", "target", prediction.alias("prediction"), (-F.ln(F.greatest(p, F.lit(1e-15)))).alias("loss")).groupBy("split", "target", "prediction").agg(F.count("*").alias("n"), F.sum("loss").alias("loss"))
    sides = cells.select("split", "n", "loss", F.inline(F.array(
        F.struct(F.col("target").alias("digit"), F.lit(1).alias("actual"), F.lit(0).alias("said")), F.struct(F.col("prediction").alias("digit"), F.lit(0).alias("actual"), F.lit(1).alias("said")))),
        (F.col("target") == F.col("prediction")).cast("int").alias("right"))
    digits = sides.groupBy("split", "digit").agg(
        F.sum(F.col("n") * F.col("actual")).alias("actual"), F.sum(F.col("n") * F.col("said")).alias("said"), F.sum(F.col("n") * F.col("actual") * F.col("right")).alias("right"),
        F.sum(F.col("loss") * F.col("actual")).alias("loss"))
    n = F.sum("actual")
    return digits.groupBy("split").agg(
        n.alias("row_count"), (F.sum("right") / n).alias("accuracy"), F.avg(2 * F.col("right") / (F.col("actual") + F.col("said"))).alias("f1"), (F.sum("loss") / n).alias("log_loss"))


def retraining_checks(metrics: DataFrame, dataset: DataFrame, min_accuracy: float = 0.0, min_f1: float = 0.0, max_log_loss: float | None = None) -> DataFrame:
    """(check_id, status) of a retrained model: rows of each split as in the dataset, bounded metrics, and the thresholds that are set."""
    sizes = dataset.groupBy("split").agg(F.count("*").alias("_n"))
    names = dataset.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    rows = names.join(sizes, "split", "left").join(metrics, "split", "left")
    known = F.col("row_count").isNotNull()
    checks = {
        "ROWS": F.coalesce(F.col("row_count"), F.lit(0)) == F.coalesce(F.col("_n"), F.lit(0)), "REQUIRED": known,
        "METRIC_BOUNDS": known & F.col("accuracy").between(0, 1) & F.col("f1").between(0, 1) & (F.col("log_loss") >= 0),
    }
    if min_accuracy > 0:
        checks["MIN_ACCURACY"] = known & (F.col("accuracy") >= min_accuracy)
    if min_f1 > 0:
        checks["MIN_F1"] = known & (F.col("f1") >= min_f1)
    if max_log_loss is not None:
        checks["MAX_LOG_LOSS"] = known & (F.col("log_loss") <= max_log_loss)
    cells = F.array(*[F.struct(F.concat(F.col("split"), F.lit(f"_{n}")).alias("check_id"), F.when(c, "PASS").otherwise("FAIL").alias("status")) for n, c in checks.items()])
    return rows.select(F.inline(cells))
