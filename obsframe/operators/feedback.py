"""Feedback on predictions: outcome, source of an error, retraining decision and promotion of a challenger."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsframe.operators.scans import history

# Error sources in order of precedence, each with the flag that tells it, and the policy.
SOURCES = {
    "data_quality": "data_valid", "feature": "feature_stable", "model": "model_stable", "ensemble": "ensemble_stable",
    "ranking": "ranking_stable", "calibration": "calibration_stable", "distribution_shift": "distribution_stable",
}
UNKNOWN = "unknown"
TOP_K, MISS_STREAK, RECENT_ACCURACY, CANDIDATE_GAIN, VALIDATION_ACCURACY = 3, 2, 0.5, 0.01, 0.5
LOW_ACCURACY, LONG_STREAK, DIAGNOSED = "RECENT_ACCURACY_BELOW_THRESHOLD", "MISS_STREAK_THRESHOLD_REACHED", "DIAGNOSTIC_ERROR_SIGNAL"
FLOOR, VALIDATION, WALK_FORWARD, GAIN = "CHALLENGER_VALIDATION_FLOOR_NOT_MET", "CHALLENGER_VALIDATION_NOT_BETTER", "CHALLENGER_WALK_FORWARD_NOT_BETTER", "CANDIDATE_GAIN_BELOW_THRESHOLD"
PASSED, NO_COMPARISON, NOT_TRIGGERED = "CHALLENGER_PASSED_PROMOTION_GATES", "NO_CHALLENGER_COMPARISON_AVAILABLE", "RETRAINING_NOT_TRIGGERED"
ACTIONS = ("rebuild_point_in_time_training_dataset", "retrain_candidate_models", "run_validation", "run_walk_forward_evaluation", "compare_champion_vs_challenger")


def given(pairs: dict[str, Column]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in pairs.items()]))


def prediction_outcomes(rows: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """Outcome of each probability row: prediction, correctness, hit among the ``top_k``, signed error and rank of the actual."""
    p = F.get("probs", F.col("target"))
    rank = F.size(F.filter(F.transform("probs", lambda x, d: (x > p) | ((x == p) & (d < F.col("target")))), lambda b: b)) + 1
    prediction = F.array_position("probs", F.array_max("probs")).cast("int") - 1
    return rows.withColumns({"prediction": prediction, "actual_rank": rank}).withColumns({
        "correct": F.col("prediction") == F.col("target"), "top_k_hit": F.col("actual_rank") <= top_k,
        "prediction_error": F.col("prediction") - F.col("target"), "reciprocal_rank": 1.0 / F.col("actual_rank"),
    })


def diagnosed(outcomes: DataFrame, flags: dict[str, Column] | None = None) -> DataFrame:
    """``error_source`` of each outcome and all ``error_evidence``, from flags by name (true: sound; absent or null: sound).

    The first unsound flag in the order of SOURCES names the source of a miss; a miss without one,
    and every correct prediction, is "unknown". The rank of the actual plays no part.
    """
    flags = flags or {}
    if strange := set(flags) - set(SOURCES.values()):
        raise ValueError(f"unknown flags: {sorted(strange)}")
    bad = {source: ~F.coalesce(flags[flag], F.lit(True)) for source, flag in SOURCES.items() if flag in flags}
    evidence = given(bad) if bad else F.array().cast("array<string>")
    return outcomes.withColumn("error_evidence", F.when(F.col("correct"), F.array().cast("array<string>")).otherwise(evidence)).withColumn(
        "error_source", F.coalesce(F.get("error_evidence", F.lit(0)), F.lit(UNKNOWN)))


def retraining(outcomes: DataFrame, keys=("entity_id",), date: str = "obs_date", recent: int = 10, streak: int = MISS_STREAK, accuracy: float = RECENT_ACCURACY) -> DataFrame:
    """RETRAIN or HOLD after each outcome, with reasons and evidence, from it and the ``recent`` outcomes before it.

    Low accuracy over these, a streak of misses at their end, and a diagnosed miss each ask for it.
    """
    seen = F.collect_list("correct").over(history(*keys, date=date).rowsBetween(-recent, 0))
    step = outcomes.withColumn("_seen", F.reverse(seen))
    last = F.array_position("_seen", F.lit(True))
    step = step.withColumns({
        "recent_accuracy": F.size(F.filter("_seen", lambda c: c)) / F.size("_seen"),
        "miss_streak": F.when(last == 0, F.size("_seen")).otherwise(last.cast("int") - 1),
    }).drop("_seen")
    reasons = {
        LOW_ACCURACY: F.col("recent_accuracy") < accuracy, LONG_STREAK: F.col("miss_streak") >= streak,
        DIAGNOSED: ~F.col("correct") & (F.col("error_source") != UNKNOWN),
    }
    evidence = F.array_compact(F.array(
        F.when(~F.col("correct"), "CURRENT_PREDICTION_MISS"), F.when(~F.col("top_k_hit"), "CURRENT_TOP_K_MISS"),
        F.when(reasons[LOW_ACCURACY], F.format_string("RECENT_ACCURACY=%.6f", "recent_accuracy")), F.when(reasons[LONG_STREAK], F.format_string("MISS_STREAK=%d", "miss_streak")),
        F.when(reasons[DIAGNOSED], F.concat(F.lit("ERROR_SOURCE="), "error_source")),
    ))
    asked = F.size("reasons") > 0
    return step.withColumns({"reasons": given(reasons), "evidence": evidence}).withColumns({
        "decision": F.when(asked, "RETRAIN").otherwise("HOLD"), "actions": F.when(asked, F.array(*[F.lit(a) for a in ACTIONS])).otherwise(F.array().cast("array<string>")),
    })


def promotions(comparisons: DataFrame, need_walk_forward: bool = True, gain: float = CANDIDATE_GAIN, floor: float = VALIDATION_ACCURACY) -> DataFrame:
    """PROMOTE or REJECT of each challenger, its gain and the gates that it failed.

    ``comparisons`` has champion_ and challenger_ ``accuracy``, ``validation_accuracy`` and
    ``walk_forward_accuracy``, all shares. A value that is null, not finite or outside 0 to 1 is an error.
    """
    names = [f"{side}_{m}" for side in ("champion", "challenger") for m in ("accuracy", "validation_accuracy", "walk_forward_accuracy")]
    sound = lambda c: F.when(F.coalesce(F.col(c).between(0.0, 1.0) & ~F.isnan(c), F.lit(False)), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} must be a share")).cast("double"))
    step = comparisons.withColumns({c: sound(c) for c in names}).withColumn("gain", F.col("challenger_accuracy") - F.col("champion_accuracy"))
    gates = {
        FLOOR: F.col("challenger_accuracy") < floor, VALIDATION: F.col("challenger_validation_accuracy") < F.col("champion_validation_accuracy"),
        WALK_FORWARD: F.lit(need_walk_forward) & (F.col("challenger_walk_forward_accuracy") < F.col("champion_walk_forward_accuracy")), GAIN: F.col("gain") < gain,
    }
    failed = given(gates)
    return step.withColumn("promotion_reasons", failed).withColumns({
        "promotion": F.when(F.size("promotion_reasons") > 0, "REJECT").otherwise("PROMOTE"),
        "promotion_reasons": F.when(F.size("promotion_reasons") > 0, F.col("promotion_reasons")).otherwise(F.array(F.lit(PASSED))),
    })


def feedback_cycle(assessed: DataFrame, promoted: DataFrame | None = None, on=("entity_id",)) -> DataFrame:
    """Each assessed outcome with the promotion that follows: only a retraining looks at its comparison.

    ``promoted`` has one row per ``on``; an outcome without one is rejected for want of a comparison.
    """
    if promoted is None:
        joined = assessed.withColumns({"_promotion": F.lit(None).cast("string"), "_reasons": F.lit(None).cast("array<string>"), "_gain": F.lit(None).cast("double")})
    else:
        joined = assessed.join(promoted.select(*on, F.col("promotion").alias("_promotion"), F.col("promotion_reasons").alias("_reasons"), F.col("gain").alias("_gain")), list(on), "left")
    compared, asked = F.col("_promotion").isNotNull(), F.col("decision") == "RETRAIN"
    return joined.withColumns({
        "promotion": F.when(compared & asked, F.col("_promotion")).otherwise("REJECT"),
        "promotion_reasons": F.when(~compared, F.array(F.lit(NO_COMPARISON))).when(asked, F.col("_reasons")).otherwise(F.array(F.lit(NOT_TRIGGERED))),
        "gain": F.when(compared & asked, F.col("_gain")).otherwise(F.lit(0.0)),
    }).drop("_promotion", "_reasons", "_gain")


def error_breakdown(outcomes: DataFrame, keys=()) -> DataFrame:
    """Misses by source, zeros included, per key."""
    names = (*SOURCES, UNKNOWN)
    counts = outcomes.groupBy(*keys).agg(F.array(*[F.struct(F.lit(s).alias("error_source"), F.count_if(~F.col("correct") & (F.col("error_source") == s)).alias("n_misses")) for s in names]).alias("c"))
    return counts.select(*keys, F.inline("c"))
