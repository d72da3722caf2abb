"""Pair correlations and distribution regimes over rows and row windows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsframe import layout as L
from obsframe.functions import stats as S
from obsframe.operators.windows import regime, row_windows


def pair_rows(df: DataFrame, keys, pairs=L.PAIR_POSITIONS) -> DataFrame:
    """(keys, position_a, position_b, a, b) exploded from wide rows in one stage."""
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("position_a"), F.lit(b).alias("position_b"), F.col(a).alias("a"), F.col(b).alias("b"))
            for a, b in pairs
        ]
    )
    return df.select(*keys, F.inline(rows))


def correlation_columns() -> dict[str, Column]:
    """Pair count, population covariance and correlation from exact sums.

    Digit sums are integers, so a zero covariance is exactly zero and the sign
    does not depend on the order rows are combined in.
    """
    n, sa, sb, ab, aa, bb = (F.col(c) for c in ("n_pairs", "_sa", "_sb", "_ab", "_aa", "_bb"))
    cross = n * ab - sa * sb
    spread = F.sqrt((n * aa - sa * sa) * (n * bb - sb * sb))
    return {
        "covariance": F.when(n >= 2, cross / (n * n)),
        "correlation": F.when(n >= 2, cross / F.nullif(spread, F.lit(0.0))),
    }


def relation_labels(r: Column) -> dict[str, Column]:
    size = F.abs(r)
    none = F.when(r.isNull(), "INSUFFICIENT_DATA")
    return {
        "direction": none.when(r > 0, "POSITIVE").when(r < 0, "NEGATIVE").otherwise("NEUTRAL"),
        "strength": none.when(size == 0, "NONE").when(size < 0.3, "WEAK").when(size < 0.7, "MODERATE")
        .otherwise("STRONG"),
    }


def pair_relations(df: DataFrame, keys=(), pairs=L.PAIR_POSITIONS) -> DataFrame:
    """Covariance, correlation, direction and strength of every position pair."""
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    a, b = (F.when(both, F.col(c).cast("double")) for c in ("a", "b"))
    sums = pair_rows(df, keys, pairs).groupBy(*keys, "position_a", "position_b").agg(
        F.count(a).alias("n_pairs"), F.sum(a).alias("_sa"), F.sum(b).alias("_sb"),
        F.sum(a * b).alias("_ab"), F.sum(a * a).alias("_aa"), F.sum(b * b).alias("_bb"),
    )
    out = sums.withColumns(correlation_columns()).withColumns(relation_labels(F.col("correlation")))
    return out.drop("_sa", "_sb", "_ab", "_aa", "_bb")


def relation_windows(df: DataFrame, size: int, keys=("entity_id",)) -> DataFrame:
    """Pair relations of tumbling row windows."""
    return pair_relations(row_windows(df, list(keys), size), [*keys, "window_index"])


def _series(keys):
    return Window.partitionBy(*keys, "position_a", "position_b").orderBy("window_index")


def relation_stability(windows: DataFrame, keys=("entity_id",)) -> DataFrame:
    """Direction and strength consistency over consecutive valid windows."""
    group = [*keys, "position_a", "position_b"]
    total = windows.groupBy(*group).agg(F.count("*").alias("n_windows"))
    valid = windows.where("direction <> 'INSUFFICIENT_DATA'").select(
        *group, "direction", "strength",
        F.lag("direction").over(_series(keys)).alias("_d"), F.lag("strength").over(_series(keys)).alias("_s"),
    )
    steps = valid.groupBy(*group).agg(
        F.count("*").alias("n_valid"),
        F.count_if(F.col("_d") != F.col("direction")).alias("direction_changes"),
        F.count_if(F.col("_s") != F.col("strength")).alias("strength_changes"),
    )
    out = total.join(steps, group, "left").fillna(0, ["n_valid", "direction_changes", "strength_changes"])
    moves = F.col("n_valid") - 1

    def consistency(changes: str) -> Column:
        return F.when(moves >= 1, (moves - F.col(changes)) * 100.0 / moves).otherwise(0.0)

    return out.withColumns(
        {
            "direction_consistency": consistency("direction_changes"),
            "strength_consistency": consistency("strength_changes"),
        }
    ).withColumn(
        "stability_level",
        F.when(F.col("n_valid") < 2, "INSUFFICIENT_DATA").otherwise(S.share_level(F.col("direction_consistency"))),
    )


def relation_changes(windows: DataFrame, keys=("entity_id",)) -> DataFrame:
    """Correlation, direction and strength changes between consecutive windows."""
    w = _series(keys)
    prev = {c: F.lag(c).over(w) for c in ("window_index", "correlation", "direction", "strength")}
    out = windows.withColumns({f"previous_{c}": v for c, v in prev.items()}).where("previous_window_index is not null")
    r, p = F.col("correlation"), F.col("previous_correlation")
    out = out.withColumns(
        {
            "correlation_change": r - p,
            "abs_correlation_change": F.abs(r) - F.abs(p),
            "direction_changed": F.col("direction") != F.col("previous_direction"),
            "strength_changed": F.col("strength") != F.col("previous_strength"),
        }
    )
    return out.withColumn(
        "relation_changed",
        F.col("direction_changed") | F.col("strength_changed")
        | F.coalesce(F.col("correlation_change") != 0, F.lit(False)),
    )


def relation_change_trend(windows: DataFrame, keys=("entity_id",)) -> DataFrame:
    """Latest window against the one before it: change and trend label."""
    changes = relation_changes(windows, keys)
    latest = changes.groupBy(*keys, "position_a", "position_b").agg(
        F.max_by(F.struct("correlation", "previous_correlation", "correlation_change", "relation_changed"), "window_index").alias("x"),
        F.count("*").alias("n_comparisons"),
    )
    return latest.select(*keys, "position_a", "position_b", "n_comparisons", "x.*").withColumn(
        "trend", S.direction(F.col("correlation_change"), "INCREASING", "DECREASING", "STABLE")
    )


DIRECTIONS = ("POSITIVE", "NEGATIVE", "NEUTRAL", "INSUFFICIENT_DATA")
STRENGTHS = ("NONE", "WEAK", "MODERATE", "STRONG")


def relation_summary(relations: DataFrame, keys=()) -> DataFrame:
    """Per-position and total relation counts and correlation statistics.

    Every relation counts once for each of its positions and once in the total
    (position NULL).
    """
    names = F.array(F.col("position_a"), F.col("position_b"), F.lit(None).cast("string"))
    r = F.col("correlation")
    return relations.withColumn("position", F.explode(names)).groupBy(*keys, "position").agg(
        F.count("*").alias("n_relations"), F.sum("n_pairs").alias("total_pairs"),
        *[F.count_if(F.col("direction") == d).alias(f"n_{d.lower()}") for d in DIRECTIONS],
        *[F.count_if(F.col("strength") == s).alias(f"n_{s.lower()}") for s in STRENGTHS],
        F.avg(r).alias("mean_correlation"), F.avg(F.abs(r)).alias("mean_abs_correlation"),
        F.min(r).alias("min_correlation"), F.max(r).alias("max_correlation"),
    )


def relation_overview(relations: DataFrame, stability: DataFrame, changes: DataFrame, keys=("entity_id",)) -> DataFrame:
    """Relations joined with their window stability and change counts."""
    group = [*keys, "position_a", "position_b"]
    moved = changes.groupBy(*group).agg(
        F.count("*").alias("n_comparisons"),
        *[F.count_if(c).alias(f"n_{c}") for c in ("direction_changed", "strength_changed", "relation_changed")],
    )
    return (
        relations.select(*group, "correlation", "direction", "strength")
        .join(stability.select(*group, "n_windows", "n_valid", "direction_consistency", "stability_level"), group, "left")
        .join(moved, group, "left")
    )


# -- regimes ------------------------------------------------------------------


def regime_windows(long: DataFrame, size: int = L.REGIME_WINDOW, keys=("entity_id", "position")) -> DataFrame:
    """Dominant digit, moments, entropy and regime of tumbling row windows."""
    rows = row_windows(long, list(keys), size)
    v = F.col("value")
    out = rows.groupBy(*keys, "window_index").agg(
        F.min("obs_date").alias("start_date"), F.max("obs_date").alias("end_date"),
        F.count(v).alias("n_obs"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        S.digit_counts(v).alias("counts"),
    )
    c, n = F.col("counts"), F.nullif(F.col("n_obs").cast("double"), F.lit(0.0))
    out = out.withColumns(
        {
            "dominant_digit": F.when(n.isNotNull(), S.argmax(c)),
            "dominant_pct": F.array_max(c) / n * 100.0,
            "entropy": F.when(n.isNotNull(), S.array_entropy(F.transform(c, lambda x: x / n), 2)),
        }
    )
    return out.withColumn("regime", regime(F.col("dominant_pct"), F.col("entropy"))).drop("counts")


def regime_transitions(windows: DataFrame, keys=("entity_id", "position")) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("window_index")
    before, now = F.col("previous_regime"), F.col("regime")
    out = windows.select(*keys, "window_index", F.lag("regime").over(w).alias("previous_regime"), "regime")
    missing = (before == "INSUFFICIENT_DATA") | (now == "INSUFFICIENT_DATA")
    return out.where("previous_regime is not null").withColumn(
        "transition", F.when(missing, "MISSING").when(before == now, "UNCHANGED").otherwise("TRANSITION")
    )


def regime_stability(windows: DataFrame, keys=("entity_id", "position")) -> DataFrame:
    """Share of unchanged comparable steps and its level."""
    sizes = windows.groupBy(*keys).agg(
        F.count("*").alias("n_windows"), F.count_if(F.col("regime") != "INSUFFICIENT_DATA").alias("n_valid")
    )
    steps = regime_transitions(windows, keys).groupBy(*keys).agg(
        *[F.count_if(F.col("transition") == t).alias(f"n_{t.lower()}") for t in ("TRANSITION", "UNCHANGED", "MISSING")]
    )
    out = sizes.join(steps, list(keys), "left").fillna(0)
    comparable = F.col("n_transition") + F.col("n_unchanged")
    return out.withColumn("stability_pct", S.pct(F.col("n_unchanged"), comparable)).withColumn(
        "stability_level",
        F.when(comparable <= 0, "INSUFFICIENT_DATA").otherwise(S.share_level(F.col("stability_pct"))),
    )


REGIMES = ("CONCENTRATED", "BALANCED", "DIVERSE", "INSUFFICIENT_DATA")


def regime_summary(windows: DataFrame, keys=("entity_id", "position")) -> DataFrame:
    """Windows per regime and means per key."""
    return windows.groupBy(*keys).agg(
        F.count("*").alias("n_windows"),
        *[F.count_if(F.col("regime") == r).alias(f"n_{r.lower()}") for r in REGIMES],
        F.avg("dominant_pct").alias("mean_dominant_pct"), F.avg("entropy").alias("mean_entropy"),
    )


def regime_flow(windows: DataFrame, keys=("entity_id", "position")) -> DataFrame:
    """Regime-to-regime counts per position with totals from one rollup."""
    steps = regime_transitions(windows, keys)
    return steps.groupingSets(
        [["position", "previous_regime", "regime"], ["previous_regime", "regime"]],
        "position", "previous_regime", "regime",
    ).agg(F.count("*").alias("n"))
