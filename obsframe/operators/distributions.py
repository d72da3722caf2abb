"""Digit distributions over successive row windows: changes, trends, stability.

Working form: (keys, position, window_index, digit, pct). After the first
aggregate everything is small: ten rows per key, position and window.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsframe import layout as L
from obsframe.functions import stats as S
from obsframe.operators.aggregates import digit_frequency
from obsframe.operators.windows import direction_streaks, row_windows

MOVES = ("INCREASING", "DECREASING", "UNCHANGED")
STABILITY = ("STABLE", "MODERATE", "UNSTABLE")


def distribution_windows(long: DataFrame, size: int, keys=("entity_id",)) -> DataFrame:
    """Digit percentages of consecutive windows of ``size`` observations."""
    rows = row_windows(long, [*keys, "position"], size)
    return digit_frequency(rows, [*keys, "position", "window_index"]).select(
        *keys, "position", "window_index", "digit", "pct"
    )


def with_era(windows: DataFrame, length: int) -> DataFrame:
    """Group windows into eras of ``length`` windows."""
    return windows.withColumn(
        "era", (F.floor((F.col("window_index") - 1) / length) + 1).cast("int")
    )


def window_changes(windows: DataFrame, keys=("entity_id",)) -> DataFrame:
    """Percentage change of each digit between consecutive windows."""
    w = Window.partitionBy(*keys, "position", "digit").orderBy("window_index")
    change = F.col("pct") - F.lag("pct").over(w)
    return windows.withColumn("change", change).where("change is not null").withColumn(
        "direction", S.direction(F.col("change"), *MOVES)
    )


def digit_changes(a: DataFrame, b: DataFrame, keys=("position",)) -> DataFrame:
    """Digit-wise b − a of two distributions."""
    on = [*keys, "digit"]
    out = a.select(*on, F.col("pct").alias("pct_a")).join(b.select(*on, F.col("pct").alias("pct_b")), on)
    change = F.col("pct_b") - F.col("pct_a")
    return out.withColumns({"change": change, "abs_change": F.abs(change)}).withColumn(
        "direction", S.direction(F.col("change"), "INCREASED", "DECREASED", "UNCHANGED")
    )


def change_totals(changes: DataFrame, keys=("position",)) -> DataFrame:
    return changes.groupBy(*keys).agg(
        F.sum("abs_change").alias("total_abs_change"),
        (F.sum("abs_change") / L.DIGITS).alias("mean_abs_change"),
        *[F.count_if(F.col("direction") == d).alias(f"n_{d.lower()}") for d in ("INCREASED", "DECREASED", "UNCHANGED")],
    )


def classify_changes(changes: DataFrame, threshold: float = 0.0, low: float = L.LOW_CHANGE,
                     high: float = L.HIGH_CHANGE) -> DataFrame:
    """Direction beyond a threshold, and the magnitude band."""
    big = F.col("abs_change") > threshold
    return changes.withColumns(
        {
            "direction": F.when(big & (F.col("change") > 0), "INCREASED")
            .when(big & (F.col("change") < 0), "DECREASED").otherwise("UNCHANGED"),
            "magnitude": S.level(F.col("abs_change"), low, high),
        }
    )


def classified_counts(classified: DataFrame, keys=("position",)) -> DataFrame:
    return classified.groupBy(*keys).agg(
        *[F.count_if(F.col("direction") == d).alias(f"n_{d.lower()}") for d in ("INCREASED", "DECREASED", "UNCHANGED")],
        *[F.count_if(F.col("magnitude") == m).alias(f"n_{m.lower()}") for m in ("LOW", "MEDIUM", "HIGH")],
    )


def digit_trends(changes: DataFrame, keys=("entity_id",), low: float = L.LOW_CHANGE,
                 high: float = L.HIGH_CHANGE) -> DataFrame:
    """Change trend, volatility, strength and dominance of each digit in one pass."""
    c = F.col("change")
    out = changes.groupBy(*keys, "position", "digit").agg(
        F.count("*").alias("n_changes"),
        *[F.count_if(F.col("direction") == m).alias(f"n_{m.lower()}") for m in MOVES],
        F.sum(c).alias("total_change"), F.avg(c).alias("mean_change"),
        F.sum(F.abs(c)).alias("total_abs"), F.avg(F.abs(c)).alias("mean_abs"),
        F.max(F.abs(c)).alias("max_abs"), F.min(F.abs(c)).alias("min_abs"),
    )
    n, up, down, flat = (F.col(x) for x in ("n_changes", "n_increasing", "n_decreasing", "n_unchanged"))
    return out.withColumns(
        {
            "trend_direction": F.when(up == n, MOVES[0]).when(down == n, MOVES[1])
            .when(flat == n, MOVES[2]).otherwise("MIXED"),
            "level": S.level(F.col("mean_abs"), low, high),
            "stability": S.level(F.col("mean_abs"), low, high, STABILITY),
            "consistency_pct": F.greatest(up, down, flat) / n * 100,
            "dominant_direction": F.when(up > down, MOVES[0]).when(down > up, MOVES[1])
            .when((up == 0) & (down == 0), MOVES[2]).otherwise("MIXED"),
            "persistence_pct": F.when((up == 0) & (down == 0), flat)
            .otherwise(F.greatest(up, down)) / n * 100,
        }
    )


def trend_consistency(changes: DataFrame, keys=("entity_id",)) -> DataFrame:
    """Consistency, persistence, direction switches and streaks of each digit."""
    group = [*keys, "position", "digit"]
    streaks = direction_streaks(changes, group, "window_index", "direction")
    return digit_trends(changes, keys).join(streaks, group).withColumn(
        "consistency_level", S.share_level(F.col("consistency_pct"))
    )


def trend_summary(trends: DataFrame, keys=("entity_id",)) -> DataFrame:
    """Level and direction counts with total and mean movement per position."""
    return trends.groupBy(*keys, "position").agg(
        F.count("*").alias("n_digits"),
        *[F.count_if(F.col("level") == x).alias(f"n_{x.lower()}") for x in ("LOW", "MEDIUM", "HIGH")],
        *[F.count_if(F.col("trend_direction") == x).alias(f"n_{x.lower()}") for x in (*MOVES, "MIXED")],
        F.sum("total_abs").alias("total_abs"), F.avg("mean_abs").alias("average_mean_abs"),
    )


def position_differences(freq: DataFrame, keys=(), pairs=L.PAIR_POSITIONS) -> DataFrame:
    """Mean absolute percentage difference of every position pair.

    The map gathered per key holds one 10-vector per position.
    """
    vectors = freq.groupBy(*keys, "position").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("digit", "pct"))), lambda x: x["pct"]).alias("v")
    )
    packed = vectors.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("position", "v"))).alias("m"))
    rows = F.array(*[F.struct(F.lit(a).alias("position_a"), F.lit(b).alias("position_b")) for a, b in pairs])
    spread = packed.select(*keys, "m", F.inline(rows))
    diffs = F.zip_with(
        F.try_element_at("m", F.col("position_a")), F.try_element_at("m", F.col("position_b")),
        lambda x, y: F.abs(x - y),
    )
    return spread.select(
        *keys, "position_a", "position_b", (S.array_total(diffs) / L.DIGITS).alias("mean_abs_difference")
    )


def summarise(df: DataFrame, value: str, keys=()) -> DataFrame:
    """Count, mean, median, range and population deviation of a metric."""
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"),
    )


def window_differences(changes: DataFrame, keys=("entity_id",)) -> DataFrame:
    """Mean absolute difference between consecutive windows of a position."""
    return changes.groupBy(*keys, "position", "window_index").agg(
        (F.sum(F.abs("change")) / L.DIGITS).alias("mean_abs_difference")
    )


def stability_by_position(trends: DataFrame, keys=("entity_id",), low: float = L.LOW_CHANGE,
                          high: float = L.HIGH_CHANGE) -> DataFrame:
    """Stable, moderate and unstable digits of each position, with its level."""
    out = trends.groupBy(*keys, "position").agg(
        F.count("*").alias("n_digits"),
        *[F.count_if(F.col("stability") == s).alias(f"n_{s.lower()}") for s in STABILITY],
        F.sum("total_abs").alias("total_abs"), F.avg("mean_abs").alias("average_mean_abs"),
        F.min("mean_abs").alias("min_mean_abs"), F.max("mean_abs").alias("max_mean_abs"),
    )
    return out.withColumn("stability_level", S.level(F.col("average_mean_abs"), low, high, STABILITY))


def stability_overview(positions: DataFrame, keys=("entity_id",), low: float = L.LOW_CHANGE,
                       high: float = L.HIGH_CHANGE) -> DataFrame:
    """Share of stable, moderate and unstable positions, and the overall level."""
    out = positions.groupBy(*keys).agg(
        F.count("*").alias("n_positions"),
        *[F.count_if(F.col("stability_level") == s).alias(f"n_{s.lower()}") for s in STABILITY],
        F.sum("total_abs").alias("total_abs"), F.avg("average_mean_abs").alias("average_mean_abs"),
        F.min("average_mean_abs").alias("min_mean_abs"), F.max("average_mean_abs").alias("max_mean_abs"),
    )
    return out.withColumns(
        {
            **{f"{s.lower()}_pct": S.pct(F.col(f"n_{s.lower()}"), F.col("n_positions")) for s in STABILITY},
            "overall_level": S.level(F.col("average_mean_abs"), low, high, STABILITY),
        }
    )


STABILITY_METRICS = ("stable_pct", "moderate_pct", "unstable_pct")


def tied_labels(values: dict[str, Column]) -> Column:
    """Labels whose value is the largest, in the order given."""
    top = F.greatest(*values.values())
    return F.filter(
        F.array(*[F.when(v == top, F.lit(k)) for k, v in values.items()]), lambda x: x.isNotNull()
    )


def stability_trend(overviews: DataFrame, keys=("entity_id",), order: str = "era") -> DataFrame:
    """Start, end and change of the three shares, movement and direction."""
    steps = series_steps(overviews, keys, order, STABILITY_METRICS)
    moved = [F.coalesce(F.abs(f"{m}_change"), F.lit(0.0)) for m in STABILITY_METRICS]
    out = steps.groupBy(*keys).agg(
        F.count("*").alias("n_windows"),
        *[F.min_by(m, order).alias(f"{m}_start") for m in STABILITY_METRICS],
        *[F.max_by(m, order).alias(f"{m}_end") for m in STABILITY_METRICS],
        F.sum(moved[0] + moved[1] + moved[2]).alias("total_abs_change"),
    )
    out = out.withColumns(
        {f"{m}_change": F.col(f"{m}_end") - F.col(f"{m}_start") for m in STABILITY_METRICS}
    ).withColumn(
        "mean_abs_change", S.ratio(F.col("total_abs_change"), F.col("n_windows") - 1, 0.0)
    )
    s, m, u = (F.col(f"{x}_change") for x in STABILITY_METRICS)
    return out.withColumns(
        {
            "direction": F.when((s > 0) & (u < 0), "STABLE_INCREASING")
            .when((s < 0) & (u > 0), "STABILITY_DECREASING")
            .when((s == 0) & (m == 0) & (u == 0), "STABLE").otherwise("MIXED"),
            "strength": S.level(F.col("mean_abs_change"), L.LOW_CHANGE, L.HIGH_CHANGE),
            "dominant_levels": tied_labels(
                {name: F.col(f"{x}_end") for name, x in zip(STABILITY, STABILITY_METRICS)}
            ),
        }
    )


DIRECTIONS = ("STABLE_INCREASING", "STABILITY_DECREASING", "STABLE", "MIXED")


def stability_trend_summary(trends: DataFrame, keys=()) -> DataFrame:
    return trends.groupBy(*keys).agg(
        F.count("*").alias("n_trends"),
        *[F.count_if(F.col("direction") == d).alias(f"n_{d.lower()}") for d in DIRECTIONS],
        *[F.count_if(F.col("strength") == s).alias(f"n_{s.lower()}") for s in ("LOW", "MEDIUM", "HIGH")],
        F.avg("mean_abs_change").alias("average_movement"), F.min("mean_abs_change").alias("min_movement"),
        F.max("mean_abs_change").alias("max_movement"), F.sum("total_abs_change").alias("total_movement"),
    )


def movement_summary(overviews: DataFrame, keys=("entity_id",), order: str = "era") -> DataFrame:
    """Transitions between consecutive overviews by size of movement."""
    steps = series_steps(overviews, keys, order, STABILITY_METRICS).where("stable_pct_change is not null")
    moved = steps.select(
        *keys, sum([F.abs(f"{m}_change") for m in STABILITY_METRICS[1:]], F.abs(f"{STABILITY_METRICS[0]}_change")).alias("m")
    ).withColumn("movement", S.level(F.col("m"), L.LOW_CHANGE, L.HIGH_CHANGE))
    return moved.groupBy(*keys).agg(
        F.count("*").alias("n_transitions"),
        *[F.count_if(F.col("movement") == s).alias(f"n_{s.lower()}") for s in ("LOW", "MEDIUM", "HIGH")],
        F.avg("m").alias("average_movement"), F.min("m").alias("min_movement"),
        F.max("m").alias("max_movement"), F.sum("m").alias("total_movement"),
    )


# -- generic metric series ----------------------------------------------------


def series_steps(df: DataFrame, keys, order: str, metrics) -> DataFrame:
    """Wide consecutive differences of several metrics."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.select(
        *keys, order, *metrics, *[(F.col(m) - F.lag(m).over(w)).alias(f"{m}_change") for m in metrics]
    )


def series_detail(df: DataFrame, keys, order: str, metrics) -> DataFrame:
    """Long consecutive differences: (keys, order, metric, value, change, direction)."""
    steps = series_steps(df, keys, order, metrics)
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.col(f"{m}_change").cast("double").alias("change"))
            for m in metrics
        ]
    )
    out = steps.select(*keys, order, F.inline(rows)).where("change is not null")
    return out.withColumn("direction", S.direction(F.col("change"), *MOVES))


def series_summary(detail: DataFrame, keys) -> DataFrame:
    """Direction counts and movement statistics of each metric."""
    c = F.abs("change")
    return detail.groupBy(*keys, "metric").agg(
        F.count("*").alias("n_transitions"),
        *[F.count_if(F.col("direction") == m).alias(f"n_{m.lower()}") for m in MOVES],
        F.avg(c).alias("average_movement"), F.min(c).alias("min_movement"),
        F.max(c).alias("max_movement"), F.sum(c).alias("total_movement"),
    )


def series_overview(summary: DataFrame) -> DataFrame:
    """Direction counts as percentages of the transitions, dominant labels with ties."""
    pct = {m: S.pct(F.col(f"n_{m.lower()}"), F.col("n_transitions")) for m in MOVES}
    return summary.withColumns(
        {**{f"{m.lower()}_pct": v for m, v in pct.items()}, "dominant": tied_labels(pct)}
    )


def series_comparison(df: DataFrame, keys, order: str, metrics) -> DataFrame:
    """First against last value of each metric, with total and mean movement."""
    steps = series_steps(df, keys, order, metrics)
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.col(f"{m}_change").cast("double").alias("step"))
            for m in metrics
        ]
    )
    out = steps.select(*keys, order, F.inline(rows)).groupBy(*keys, "metric").agg(
        F.min_by("value", order).alias("start"), F.max_by("value", order).alias("end"),
        F.count("step").alias("n_transitions"), F.coalesce(F.sum(F.abs("step")), F.lit(0.0)).alias("total_movement"),
    )
    change = F.col("end") - F.col("start")
    return out.withColumns(
        {
            "change": change, "abs_change": F.abs(change),
            "mean_movement": S.ratio(F.col("total_movement"), F.col("n_transitions"), 0.0),
        }
    )


def unpivot_metrics(df: DataFrame, keys, metrics) -> DataFrame:
    """(keys, metric, value) rows of wide metric columns."""
    doubles = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    return doubles.unpivot(list(keys), list(metrics), "metric", "value")
