"""Per-position series statistics, behaviour profiles and consolidation."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsframe import layout as L
from obsframe.functions import stats as S
from obsframe.operators.scans import history

SERIES = ("entity_id", "position")
MOVES = ("INCREASE", "DECREASE", "UNCHANGED")


def temporal_analysis(long: DataFrame, keys=SERIES) -> DataFrame:
    """First, last, range, moments and step changes; NULLs dropped before differencing."""
    rows = long.where("value is not null")
    step = rows.withColumn("change", F.col("value") - F.lag("value").over(history(*keys)))
    c = F.col("change")
    out = step.groupBy(*keys).agg(
        F.count("*").alias("n_obs"), F.min("obs_date").alias("first_date"), F.max("obs_date").alias("last_date"),
        F.min_by("value", "obs_date").alias("first_value"), F.max_by("value", "obs_date").alias("last_value"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.count(c).alias("n_changes"), F.count_if(c > 0).alias("n_increase"),
        F.count_if(c < 0).alias("n_decrease"), F.count_if(c == 0).alias("n_unchanged"),
        F.coalesce(F.avg(F.abs(c)), F.lit(0.0)).alias("mean_abs_step"),
        F.coalesce(F.max(F.abs(c)), F.lit(0)).alias("max_abs_step"),
    )
    net = F.col("last_value") - F.col("first_value")
    return out.withColumns(
        {
            "net_change": net, "abs_net_change": F.abs(net),
            **{f"{m.lower()}_pct": S.pct(F.col(f"n_{m.lower()}"), F.col("n_changes")) for m in MOVES},
        }
    )


def temporal_summary(analysis: DataFrame, keys=("entity_id",)) -> DataFrame:
    """Totals and averages of the per-position analyses."""
    return analysis.groupBy(*keys).agg(
        F.count("*").alias("n_positions"), F.sum("n_obs").alias("total_obs"),
        F.sum("n_changes").alias("total_changes"),
        *[F.sum(f"n_{m.lower()}").alias(f"total_{m.lower()}") for m in MOVES],
        F.avg("mean").alias("average_mean"), F.avg("std").alias("average_std"),
        F.avg("mean_abs_step").alias("average_abs_step"), F.max("max_abs_step").alias("max_abs_step"),
    )


def change_steps(long: DataFrame, keys=SERIES, low: float = L.LOW_CHANGE, high: float = L.HIGH_CHANGE) -> DataFrame:
    """Steps between consecutive rows with NULLs kept as MISSING, and their size class."""
    w = history(*keys)
    out = long.select(
        *keys, F.lag("obs_date").over(w).alias("previous_date"), "obs_date",
        F.lag("value").over(w).alias("previous_value"), "value",
    ).where("previous_date is not null")
    change = F.col("value") - F.col("previous_value")
    out = out.withColumns({"change": change, "abs_change": F.abs(change)})
    missing = F.when(F.col("change").isNull(), "MISSING")
    return out.withColumns(
        {
            "direction": missing.when(F.col("change") > 0, MOVES[0]).when(F.col("change") < 0, MOVES[1]).otherwise(MOVES[2]),
            "magnitude": missing.when(F.col("abs_change") == 0, "UNCHANGED").when(F.col("abs_change") < low, "LOW")
            .when(F.col("abs_change") < high, "MEDIUM").otherwise("HIGH"),
        }
    )


CLASSES = ("UNCHANGED", "LOW", "MEDIUM", "HIGH", "MISSING")


def change_summary(steps: DataFrame, keys=("entity_id",)) -> DataFrame:
    """Class counts and percentages per position and in total, by grouping sets."""
    out = steps.groupingSets([[*keys, "position"], [*keys]], *keys, "position").agg(
        F.count("*").alias("n_changes"),
        *[F.count_if(F.col("magnitude") == c).alias(f"n_{c.lower()}") for c in CLASSES],
    )
    return out.withColumns(
        {f"{c.lower()}_pct": S.pct(F.col(f"n_{c.lower()}"), F.col("n_changes")) for c in CLASSES}
    )


# -- behaviour profiles -------------------------------------------------------

NUMERIC = (
    "n_obs", "mean", "std", "entropy_bits", "n_changes", "mean_abs_step", "volatility", "consistency",
    "regime_stability",
)
CATEGORICAL = ("volatility_level", "consistency_level", "regime_level", "dominant_regime")


def behaviour_profiles(described: DataFrame, temporal: DataFrame, trends: DataFrame,
                       regime_stability: DataFrame, regime_summary: DataFrame, keys=SERIES) -> DataFrame:
    """One profile row per position from five already aggregated tables."""
    on = list(keys)
    moves = trends.groupBy(*on).agg(F.avg("mean_abs").alias("volatility"), F.avg("consistency_pct").alias("consistency"))
    label = F.when(F.greatest("n_concentrated", "n_balanced", "n_diverse") == F.col("n_concentrated"), "CONCENTRATED").when(
        F.greatest("n_balanced", "n_diverse") == F.col("n_balanced"), "BALANCED"
    ).otherwise("DIVERSE")
    return (
        described.select(*on, "n_obs", "mean", "std", "entropy_bits")
        .join(temporal.select(*on, "n_changes", "mean_abs_step"), on)
        .join(moves, on)
        .join(regime_stability.select(*on, F.col("stability_pct").alias("regime_stability"), F.col("stability_level").alias("regime_level")), on)
        .join(regime_summary.select(*on, label.alias("dominant_regime")), on)
        .withColumns(
            {
                "volatility_level": S.level(F.col("volatility"), L.LOW_CHANGE, L.HIGH_CHANGE),
                "consistency_level": S.share_level(F.col("consistency")),
            }
        )
    )


def profile_summary(profiles: DataFrame, keys=("entity_id",)) -> DataFrame:
    levels = ("LOW", "MEDIUM", "HIGH")
    return profiles.groupBy(*keys).agg(
        F.count("*").alias("n_profiles"),
        F.sum("n_obs").alias("total_obs"), F.sum("n_changes").alias("total_changes"),
        *[F.avg(m).alias(f"average_{m}") for m in NUMERIC[1:4] + NUMERIC[5:]],
        *[F.count_if(F.col("volatility_level") == x).alias(f"n_volatility_{x.lower()}") for x in levels],
        *[F.count_if(F.col("consistency_level") == x).alias(f"n_consistency_{x.lower()}") for x in levels],
    )


def _metric_rows(df: DataFrame, keys, numeric=NUMERIC, categorical=CATEGORICAL) -> DataFrame:
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("number"), F.lit(None).cast("string").alias("label")) for m in numeric]
    rows += [F.struct(F.lit(m).alias("metric"), F.lit(None).cast("double").alias("number"), F.col(m).alias("label")) for m in categorical]
    return df.select(*keys, F.inline(F.array(*rows)))


def profile_comparison(profiles: DataFrame, keys=("entity_id",), by: str = "position",
                       numeric=NUMERIC, categorical=CATEGORICAL) -> DataFrame:
    """Numeric differences and categorical equality of every pair of profiles.

    Profiles of one key are at most one per position; the join is on
    (key, metric).
    """
    rows = _metric_rows(profiles, [*keys, by], numeric, categorical)
    a = rows.select(*keys, "metric", F.col(by).alias(f"{by}_a"), F.col("number").alias("number_a"), F.col("label").alias("label_a"))
    b = rows.select(*keys, "metric", F.col(by).alias(f"{by}_b"), F.col("number").alias("number_b"), F.col("label").alias("label_b"))
    diff = F.col("number_b") - F.col("number_a")
    return a.join(b, [*keys, "metric"]).where(F.col(f"{by}_a") < F.col(f"{by}_b")).withColumns(
        {"difference": diff, "abs_difference": F.abs(diff), "same_label": F.col("label_a") == F.col("label_b")}
    )


def profile_distribution(profiles: DataFrame, keys=()) -> DataFrame:
    """Numeric statistics per metric and counts per categorical value."""
    rows = _metric_rows(profiles, keys)
    return rows.groupBy(*keys, "metric", "label").agg(
        F.count("*").alias("n"), F.avg("number").alias("mean"), F.min("number").alias("min"),
        F.max("number").alias("max"), F.stddev_pop("number").alias("std"),
    )


def profile_ranking(profiles: DataFrame, metrics, keys=("entity_id",)) -> DataFrame:
    """Competition rank of each position on each metric."""
    rows = _metric_rows(profiles, [*keys, "position"], metrics, ())
    w = Window.partitionBy(*keys, "metric").orderBy(F.desc("number"))
    return rows.select(*keys, "position", "metric", "number").withColumn("rank", F.rank().over(w))


# -- consolidation ------------------------------------------------------------


def consolidate(components: dict[str, DataFrame], keys=SERIES) -> DataFrame:
    """Full-outer join of per-position component tables.

    Metric columns are prefixed by the component; ``has_<component>`` tells
    which components hold the position.
    """
    parts = []
    for name, df in components.items():
        metrics = [c for c in df.columns if c not in keys]
        parts.append(
            df.select(*keys, F.lit(True).alias(f"has_{name}"), *[F.col(c).alias(f"{name}_{c}") for c in metrics])
        )
    out = reduce(lambda a, b: a.join(b, list(keys), "full_outer"), parts)
    return out.fillna(False, [f"has_{n}" for n in components])


def consolidated_summary(consolidated: DataFrame, metrics, keys=("entity_id",)) -> DataFrame:
    """Totals and averages of consolidated metrics, missing values as zero."""
    value = lambda m: F.coalesce(F.col(m).cast("double"), F.lit(0.0))
    return consolidated.groupBy(*keys).agg(
        F.count("*").alias("n_positions"),
        *[F.sum(value(m)).alias(f"total_{m}") for m in metrics],
        *[F.avg(value(m)).alias(f"average_{m}") for m in metrics],
    )


def position_comparison(consolidated: DataFrame, metrics, keys=("entity_id",)) -> DataFrame:
    """Every pair of positions of a key and every metric: both values, a missing one as zero, and first minus second.

    A key's positions are one array of at most eight rows; pairs are made inside it, without a self-join.
    """
    values = [F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in metrics]
    rows = consolidated.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", *values))).alias("p"))
    pairs = F.flatten(F.transform("p", lambda a, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"a.{m}").alias("value_a"), F.col(f"b.{m}").alias("value_b")) for m in metrics])
    out = rows.select(*keys, F.inline(pairs)).select(*keys, F.col("a.position").alias("position_a"), F.col("b.position").alias("position_b"), F.inline(cells))
    return out.withColumn("difference", F.col("value_a") - F.col("value_b"))


def completeness(consolidated: DataFrame, names, expected: int = len(L.POSITIONS), keys=("entity_id",)) -> DataFrame:
    """One check row per component: positions present, expected and missing."""
    present = consolidated.groupBy(*keys).agg(*[F.count_if(F.col(f"has_{n}")).alias(n) for n in names])
    rows = F.array(*[F.struct(F.lit(n).alias("component"), F.col(n).alias("n_present")) for n in names])
    out = present.select(*keys, F.inline(rows))
    return out.withColumns(
        {
            "n_expected": F.lit(expected),
            "n_missing": F.greatest(F.lit(expected) - F.col("n_present"), F.lit(0)),
            "issue": F.when(F.col("n_present") == 0, "MISSING_COMPONENT")
            .when(F.col("n_present") != expected, "POSITION_COUNT_MISMATCH").otherwise("NONE"),
        }
    )


def completeness_summary(checks: DataFrame, keys=("entity_id",)) -> DataFrame:
    out = checks.groupBy(*keys).agg(
        F.count("*").alias("n_components"), F.count_if(F.col("issue") == "NONE").alias("n_complete"),
        F.sum("n_missing").alias("n_missing"),
    )
    return out.withColumn("completeness_pct", S.pct(F.col("n_complete"), F.col("n_components")))
