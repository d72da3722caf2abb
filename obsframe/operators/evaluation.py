"""Scores of probability rows and rankings."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsframe.functions import stats as S
from obsframe.layout import PERIOD_DAYS
from obsframe.operators.ranking import normalise_ks
from obsframe.operators.windows import periods, trailing_run

CLIP = 1e-15


def row_scores(df: DataFrame, top_k: int = 3) -> DataFrame:
    """Per-row log loss, hit, top-k hit, Brier score, entropy and confidence."""
    p = F.get("probs", F.col("target"))
    better = F.size(F.filter(
        F.transform("probs", lambda x, d: (x > p) | ((x == p) & (d < F.col("target")))), lambda b: b
    ))
    brier = S.array_total(F.transform(
        "probs", lambda x, d: (x - F.when(d == F.col("target"), 1.0).otherwise(0.0))
        * (x - F.when(d == F.col("target"), 1.0).otherwise(0.0))
    ))
    return df.withColumns(
        {
            "log_loss": -F.ln(F.greatest(p, F.lit(CLIP))),
            "rank": better + 1,
            "hit": (better == 0).cast("double"),
            "top_hit": (better < top_k).cast("double"),
            "brier": brier,
            "entropy": S.array_total(F.transform("probs", lambda x: -x * F.ln(F.greatest(x, F.lit(CLIP))))),
            "confidence": F.array_max("probs"),
        }
    )


def evaluate(df: DataFrame, keys, top_k: int = 3, bins: int = 10) -> DataFrame:
    """Log loss, accuracy, top-k accuracy, Brier, ECE and entropy per key.

    One pass: sums per calibration bin combine map-side, then the few bins of a
    key roll up to its metrics.
    """
    rows = row_scores(df, top_k)
    bin_ = F.least(F.lit(bins - 1), F.floor(F.col("confidence") * bins)).alias("bin")
    sums = rows.groupBy(*keys, bin_).agg(
        F.count("*").alias("n"),
        *[F.sum(c).alias(c) for c in ("log_loss", "hit", "top_hit", "brier", "entropy", "confidence")],
    )
    n = F.sum("n")
    gap = F.abs(F.col("confidence") / F.col("n") - F.col("hit") / F.col("n")) * F.col("n")
    return sums.groupBy(*keys).agg(
        n.alias("n_obs"), (F.sum("log_loss") / n).alias("log_loss"), (F.sum("hit") / n).alias("accuracy"),
        (F.sum("top_hit") / n).alias("top_k_accuracy"), (F.sum("brier") / n).alias("brier"),
        (F.sum(gap) / n).alias("ece"), (F.sum("entropy") / n).alias("mean_entropy"),
    )


# Temperature grid start, step and number of steps.
GRID = (0.25, 0.025, 150)


def fit_temperature(df: DataFrame, keys) -> DataFrame:
    """Grid temperature with the least log loss, 1 unless it improves by more than 1e-12.

    Each row is scored at every grid point inside the scan stage; what is
    shuffled is one partial sum per key, grid point and task.
    """
    start, step, n = GRID
    logits = [F.ln(F.greatest(F.col("probs")[d], F.lit(CLIP))).alias(f"l{d}") for d in range(10)]
    rows = df.select(
        *keys, *logits, F.ln(F.greatest(F.get("probs", F.col("target")), F.lit(CLIP))).alias("lt"),
        F.explode(F.sequence(F.lit(0), F.lit(n))).alias("g"),
    )
    temperature = F.when(F.col("g") == 0, 1.0).otherwise(start + F.col("g") * step)
    rows = rows.withColumn("temperature", temperature)
    total = F.exp(F.col("l0") / F.col("temperature"))
    for d in range(1, 10):
        total = total + F.exp(F.col(f"l{d}") / F.col("temperature"))
    loss = F.ln(total) - F.col("lt") / F.col("temperature")
    grid = rows.groupBy(*keys, "g", "temperature").agg(F.avg(loss).alias("loss"))
    best = grid.groupBy(*keys).agg(
        F.max(F.when(F.col("g") == 0, F.col("loss"))).alias("log_loss_before"),
        F.min(F.struct("loss", "g", "temperature")).alias("b"),
    )
    better = F.col("b.loss") < F.col("log_loss_before") - 1e-12
    return best.select(
        *keys, F.when(better, F.col("b.temperature")).otherwise(1.0).alias("temperature"),
        "log_loss_before", F.when(better, F.col("b.loss")).otherwise(F.col("log_loss_before")).alias("log_loss_after"),
    )


def rescale(df: DataFrame, temperature: Column) -> DataFrame:
    """Probability rows at a temperature; the largest logit and the total are found once per row, not per symbol."""
    names = df.columns
    step = df.withColumns({f"_l{d}": F.ln(F.greatest(F.col("probs")[d], F.lit(CLIP))) / temperature for d in range(10)})
    step = step.withColumn("_m", F.greatest(*[f"_l{d}" for d in range(10)]))
    step = step.withColumns({f"_e{d}": F.exp(F.col(f"_l{d}") - F.col("_m")) for d in range(10)})
    step = step.withColumn("_t", sum((F.col(f"_e{d}") for d in range(1, 10)), F.col("_e0")))
    return step.withColumn("probs", F.array(*[F.col(f"_e{d}") / F.col("_t") for d in range(10)])).select(*names)


# -- rankings -----------------------------------------------------------------


def _hit(k: int) -> Column:
    """Hit rate at k over rows whose actual was ranked."""
    return F.coalesce(F.avg(F.when(F.col("actual_rank").isNotNull(), (F.col("actual_rank") <= k).cast("double"))), F.lit(0.0))


def _mrr() -> Column:
    return F.coalesce(F.avg(F.when(F.col("actual_rank").isNotNull(), F.col("reciprocal_rank"))), F.lit(0.0))


def hit_rows(outcomes: DataFrame, ks) -> DataFrame:
    """hit_k flags of every outcome."""
    return outcomes.withColumns(
        {f"hit_{k}": F.coalesce(F.col("actual_rank") <= k, F.lit(False)) for k in normalise_ks(ks)}
    )


def top_k_report(outcomes: DataFrame, ks, keys=("source_type",)) -> DataFrame:
    """Hit rates and mean reciprocal rank over rows with a ranked actual."""
    return outcomes.groupBy(*keys).agg(
        F.count("*").alias("n_obs"), F.count("actual_rank").alias("n_ranked"),
        *[_hit(k).alias(f"hit_rate_{k}") for k in normalise_ks(ks)], _mrr().alias("mrr"),
    )


def actual_vs_ranked(outcomes: DataFrame, keys=("source_type",)) -> DataFrame:
    """Ranked and missed counts, mean and median rank, MRR and mean probabilities."""
    return outcomes.groupBy(*keys).agg(
        F.count("*").alias("n_obs"), F.count("actual_rank").alias("n_ranked"),
        F.count_if(F.col("actual_rank").isNull()).alias("n_missed"),
        F.avg("actual_rank").alias("mean_rank"),
        F.percentile("actual_rank", F.lit(0.5)).alias("median_rank"), _mrr().alias("mrr"),
        F.avg("top_prob").alias("mean_top_prob"), F.avg("cum_prob").alias("mean_cum_prob"),
    )


def rank_histogram(outcomes: DataFrame, keys=("source_type",)) -> DataFrame:
    return outcomes.groupBy(*keys, "bucket", "actual_rank").agg(F.count("*").alias("n"))


PERIOD_KEYS = ("period_index", "period_start", "period_end")


def period_metrics(outcomes: DataFrame, days: int = PERIOD_DAYS, ks=(1, 3, 5, 10), keys=("source_type",)) -> DataFrame:
    """Ranking metrics of each calendar period of a source."""
    rows = periods(outcomes, keys, days)
    return rows.groupBy(*keys, *PERIOD_KEYS).agg(
        F.count("*").alias("n_obs"), F.count("actual_rank").alias("n_ranked"),
        F.avg("actual_rank").alias("mean_actual_rank"), _mrr().alias("mean_reciprocal_rank"),
        F.avg("top_prob").alias("mean_top_probability"), F.avg("cum_prob").alias("mean_cumulative_probability"),
        F.avg(F.col("actual_rank").isNull().cast("double")).alias("miss_rate"),
        *[_hit(k).alias(f"hit_at_{k}") for k in normalise_ks(ks)],
    )


METRICS = (
    "mean_actual_rank", "mean_reciprocal_rank", "miss_rate", "mean_top_probability",
    "mean_cumulative_probability", "hit_at_1", "hit_at_3", "hit_at_5", "hit_at_10",
)


def metric_snapshots(period: DataFrame, metrics=METRICS, keys=("source_type",)) -> DataFrame:
    """Long (period, metric, value); a missing mean rank counts as 0."""
    rows = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias("value")) for m in metrics]
    )
    return period.select(*keys, *PERIOD_KEYS, "n_obs", "n_ranked", F.inline(rows))


def metric_trends(snapshots: DataFrame, keys=("source_type",)) -> DataFrame:
    """Slope per day, direction, and first and last value of each metric."""
    x = F.datediff("period_start", F.lit("1970-01-01").cast("date")).cast("double")
    out = snapshots.withColumn("_x", x).groupBy(*keys, "metric").agg(
        F.coalesce(F.covar_pop("_x", "value") / F.nullif(F.var_pop("_x"), F.lit(0.0)), F.lit(0.0)).alias("slope_per_day"),
        F.min_by("value", "period_index").alias("first_value"), F.max_by("value", "period_index").alias("last_value"),
        F.count("*").alias("n_periods"),
    )
    return out.withColumn("change", F.col("last_value") - F.col("first_value")).withColumn(
        "direction", S.direction(F.col("slope_per_day"), "IMPROVING", "DECLINING", "STABLE")
    )


# Degradation rules (metric, absolute threshold) and metrics that worsen upwards.
DEGRADATION_RULES = (("mean_actual_rank", 1.0), ("mean_reciprocal_rank", 0.05), ("miss_rate", 0.05), ("hit_at_1", 0.05))
HIGHER_IS_WORSE = ("mean_actual_rank", "miss_rate")


def degradation(snapshots: DataFrame, rules=DEGRADATION_RULES, relative: float | None = None,
                consecutive: int = 1, keys=("source_type",)) -> DataFrame:
    """Adverse change beyond a threshold, backed by a trailing run of adverse steps."""
    threshold = F.create_map(*[F.lit(x) for rule in rules for x in rule])
    rows = snapshots.where(F.col("metric").isin([m for m, _ in rules]))
    w = Window.partitionBy(*keys, "metric").orderBy("period_index")
    worse_up = F.col("metric").isin(list(HIGHER_IS_WORSE))
    adverse = lambda c: F.when(worse_up, c > 0).otherwise(c < 0)
    step = F.col("value") - F.lag("value").over(w)
    moves = rows.withColumn("adverse", adverse(step)).where("adverse is not null")
    run = trailing_run(moves, [*keys, "metric"], "period_index", "adverse")
    ends = rows.groupBy(*keys, "metric").agg(
        F.min_by("value", "period_index").alias("baseline"), F.max_by("value", "period_index").alias("latest")
    )
    change = F.col("latest") - F.col("baseline")
    rel = S.ratio(F.col("change"), F.abs("baseline"))
    breach = F.abs("change") >= threshold[F.col("metric")]
    if relative is not None:
        breach = breach | F.coalesce(F.abs("relative_change") >= relative, F.lit(False))
    return (
        ends.join(run, [*keys, "metric"]).withColumn("change", change).withColumn("relative_change", rel)
        .withColumn("degraded", adverse(F.col("change")) & breach & (F.col("trailing_run") >= consecutive))
    )


# -- probability distributions and drift --------------------------------------


def fixed_bin(value: Column, bins: int) -> Column:
    return F.least(F.lit(bins - 1), F.floor(value * bins)).cast("int")


def bin_vectors(df: DataFrame, keys, bin_: Column, bins: int) -> DataFrame:
    """Zero-filled bin counts of each key as an array."""
    return df.withColumn("_b", bin_).groupBy(*keys).agg(
        F.count("_b").alias("n"), F.array(*[F.count_if(F.col("_b") == i) for i in range(bins)]).alias("bins")
    )


def period_histograms(outcomes: DataFrame, days: int = PERIOD_DAYS, bins: int = 10, keys=("source_type",)) -> DataFrame:
    """Probability-bin and rank-bucket counts with bin entropy per period."""
    rows = periods(outcomes, keys, days).withColumn("_b", fixed_bin(F.col("top_prob"), bins))
    buckets = ("TOP_1", "TOP_3", "TOP_5", "TOP_10", "OUTSIDE_TOP_10", "UNAVAILABLE")
    out = rows.groupBy(*keys, *PERIOD_KEYS).agg(
        F.count("*").alias("n_obs"),
        *[F.count_if(F.col("bucket") == b).alias(f"n_{b.lower()}") for b in buckets],
        F.array(*[F.count_if(F.col("_b") == i) for i in range(bins)]).alias("bins"),
        F.avg("top_prob").alias("mean_top_prob"), F.avg("cum_prob").alias("mean_cum_prob"),
    )
    return out.withColumn("bin_entropy", S.array_entropy(F.transform("bins", lambda c: c / F.col("n_obs"))))


def psi(base: Column, base_n: Column, comp: Column, comp_n: Column, eps: float = 1e-12) -> Column:
    """Population stability index of two count vectors."""

    def term(b, c):
        bp = F.greatest(b / base_n, F.lit(eps))
        cp = F.greatest(c / comp_n, F.lit(eps))
        return (cp - bp) * F.ln(cp / bp)

    return S.array_total(F.zip_with(base, comp, term))


def model_drift(outcomes: DataFrame, days: int = PERIOD_DAYS, bins: int = 10, threshold: float = 0.2,
                keys=("source_type",)) -> DataFrame:
    """PSI of top and cumulative probability against the first period, fixed [0, 1] bins."""
    rows = periods(outcomes, keys, days)
    metrics = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(c).alias("v")) for m, c in (("top_probability", "top_prob"), ("cumulative_probability", "cum_prob"))]
    )
    long = rows.select(*keys, "period_index", "period_start", F.inline(metrics))
    vec = long.withColumn("_b", fixed_bin(F.col("v"), bins)).groupBy(*keys, "metric", "period_index", "period_start").agg(
        F.count("*").alias("n"), F.avg("v").alias("mean"),
        F.array(*[F.count_if(F.col("_b") == i) for i in range(bins)]).alias("bins"),
    )
    base = vec.where("period_index = 0").select(
        *keys, "metric", F.col("n").alias("baseline_n"), F.col("mean").alias("baseline_mean"), F.col("bins").alias("_base")
    )
    out = vec.where("period_index > 0").join(base, [*keys, "metric"])
    out = out.withColumn("psi", psi(F.col("_base"), F.col("baseline_n"), F.col("bins"), F.col("n")))
    return out.withColumn("drifted", F.col("psi") >= threshold).drop("_base", "bins")


def data_drift(features: DataFrame, days: int = PERIOD_DAYS, bins: int = 10, threshold: float = 0.2,
               by: str = "feature_name") -> DataFrame:
    """Per feature and period: PSI on the union range, missing rate, mean and deviation.

    Rows first combine into counts per distinct value. The baseline period is
    re-binned once per distinct (feature, range), not once per period: a
    period inside the baseline's range shares its edges.
    """
    anchored = periods(features, (), days)
    values = anchored.groupBy(by, "period_index", "period_start", "value").agg(F.count("*").alias("c"))
    v, c = F.col("value"), F.col("c")
    num = F.sum(F.when(v.isNotNull(), c))
    shape = values.groupBy(by, "period_index", "period_start").agg(
        F.sum(c).alias("rows"), F.coalesce(num, F.lit(0)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"),
        F.sum(v * c).alias("s"), F.sum(v * v * c).alias("q"),
    )
    mean = F.col("s") / F.nullif(F.col("n").cast("double"), F.lit(0.0))
    square = F.col("q") / F.nullif(F.col("n").cast("double"), F.lit(0.0))
    shape = shape.select(
        by, "period_index", "period_start", "n", "lo", "hi", mean.alias("mean"),
        F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"),
        (1 - F.col("n") / F.col("rows")).alias("missing_rate"),
    )
    base = shape.where("period_index = 0").select(
        by, *[F.col(x).alias(f"baseline_{x}") for x in ("n", "lo", "hi", "mean", "std", "missing_rate")]
    )
    comp = shape.where("period_index > 0 and n > 0").join(base, by)
    comp = comp.withColumns({"low": F.least("lo", "baseline_lo"), "high": F.greatest("hi", "baseline_hi")})
    width = (F.col("high") - F.col("low")) / bins
    index = F.least(F.lit(bins - 1), F.floor((v - F.col("low")) / F.nullif(width, F.lit(0.0)))).cast("int")

    def vectors(rows, keys, name):
        cells = [F.sum(F.when(F.col("_b") == i, F.col("c")).otherwise(0)) for i in range(bins)]
        return rows.withColumn("_b", F.coalesce(index, F.lit(0))).groupBy(*keys).agg(F.array(*cells).alias(name))

    edges = comp.select(by, "low", "high").distinct()
    known = values.where("value is not null")
    base_bins = vectors(known.where("period_index = 0").join(edges, by), (by, "low", "high"), "_base")
    comp_bins = vectors(
        known.where("period_index > 0").join(comp.select(by, "period_index", "low", "high"), [by, "period_index"]),
        (by, "period_index"), "_comp",
    )
    out = comp.join(base_bins, [by, "low", "high"]).join(comp_bins, [by, "period_index"])
    flat = F.col("high") - F.col("low") <= 1e-15
    out = out.withColumn(
        "psi", F.when(flat, 0.0).otherwise(psi(F.col("_base"), F.col("baseline_n"), F.col("_comp"), F.col("n")))
    )
    return out.withColumn("drifted", F.col("psi") >= threshold).select(
        by, "period_index", "period_start", "baseline_n", "n", "baseline_mean", "mean", "baseline_std", "std",
        "baseline_missing_rate", "missing_rate", "psi", "drifted",
    )


def concept_drift(features: DataFrame, outcomes: DataFrame, on, days: int = PERIOD_DAYS, bins: int = 5,
                  threshold: float = 0.1, by: str = "feature_name") -> DataFrame:
    """Change of the hit rate per feature bin, weighted by the comparison period.

    Edges come from the first period and are right-closed; values outside fall
    in the end bins.
    """
    hit = F.when(F.col("actual_rank") == 1, 1).when(F.col("actual_rank").isNotNull(), 0)
    y = outcomes.select(*on, hit.alias("hit")).where("hit is not null")
    rows = periods(features, (), days).where("value is not null").join(y, list(on))
    edges = rows.where("period_index = 0").groupBy(by).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    index = F.lit(bins - 1)
    for i in range(bins - 2, -1, -1):
        index = F.when(F.col("value") <= F.col("lo") + (i + 1) * width, i).otherwise(index)
    index = F.when(F.col("hi") - F.col("lo") <= 1e-15, 0).otherwise(index)
    counts = rows.join(F.broadcast(edges), by).withColumn("bin", index).groupBy(
        by, "period_index", "period_start", "bin"
    ).agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    base = counts.where("period_index = 0").select(by, "bin", F.col("n").alias("base_n"), F.col("hits").alias("base_hits"))
    comp = counts.where("period_index > 0").join(base, [by, "bin"], "left")
    base_rate = F.coalesce(F.col("base_hits") / F.col("base_n"), F.lit(0.0))
    change = F.abs(F.col("hits") / F.col("n") - base_rate) * F.col("n")
    totals = base.groupBy(by).agg(F.sum("base_n").alias("baseline_n"), (F.sum("base_hits") / F.sum("base_n")).alias("baseline_rate"))
    out = comp.groupBy(by, "period_index", "period_start").agg(
        F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("rate"), (F.sum(change) / F.sum("n")).alias("rate_change")
    )
    return out.join(totals, by).withColumn("drifted", F.col("rate_change") >= threshold)


def calibration_periods(outcomes: DataFrame, days: int = PERIOD_DAYS, bins: int = 10, keys=("source_type",)) -> DataFrame:
    """Mean predicted, hit rate, gap, Brier and ECE of the top candidate per period.

    Unranked rows carry NULLs, so a period without any ranked actual still
    appears, with zero metrics.
    """
    ranked = F.col("actual_rank").isNotNull()
    rows = periods(outcomes, keys, days).select(
        *keys, *PERIOD_KEYS, F.when(ranked, F.col("top_prob")).alias("p"),
        F.when(ranked, (F.col("actual_rank") == 1).cast("double")).alias("y"),
    )
    sums = rows.withColumn("bin", fixed_bin(F.col("p"), bins)).groupBy(*keys, *PERIOD_KEYS, "bin").agg(
        F.count("p").alias("n"), F.sum("p").alias("sp"), F.sum("y").alias("sy"),
        F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("sb"),
    )
    n = F.sum("n")
    out = sums.groupBy(*keys, *PERIOD_KEYS).agg(
        n.alias("n_ranked"), S.ratio(F.sum("sp"), n, 0.0).alias("mean_predicted_probability"),
        S.ratio(F.sum("sy"), n, 0.0).alias("empirical_hit_rate"), S.ratio(F.sum("sb"), n, 0.0).alias("brier_score"),
        S.ratio(F.sum(F.abs(F.col("sp") - F.col("sy"))), n, 0.0).alias("expected_calibration_error"),
    )
    return out.withColumn("calibration_gap", F.col("mean_predicted_probability") - F.col("empirical_hit_rate"))


def calibration_bins(outcomes: DataFrame, bins: int = 10, keys=("source_type",)) -> DataFrame:
    """Zero-filled reliability table."""
    rows = outcomes.where("actual_rank is not null").select(
        *keys, fixed_bin(F.col("top_prob"), bins).alias("b"), F.col("top_prob").alias("p"),
        (F.col("actual_rank") == 1).cast("double").alias("y"),
    )
    b = F.col("b")
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("bin"), F.count_if(b == i).alias("n"),
                F.coalesce(F.avg(F.when(b == i, F.col("p"))), F.lit(0.0)).alias("mean_predicted"),
                F.coalesce(F.avg(F.when(b == i, F.col("y"))), F.lit(0.0)).alias("hit_rate"),
            )
            for i in range(bins)
        ]
    )
    out = rows.groupBy(*keys).agg(cells.alias("cells")).select(*keys, F.inline("cells"))
    return out.withColumn("abs_gap", F.abs(F.col("mean_predicted") - F.col("hit_rate")))


def against_first(period: DataFrame, metrics, threshold: float = 0.05, keys=("source_type",)) -> DataFrame:
    """Absolute change of each metric against the first period (drift table)."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias("value")) for m in metrics])
    long = period.select(*keys, "period_index", "period_start", F.inline(rows))
    base = long.groupBy(*keys, "metric").agg(F.min_by("value", "period_index").alias("baseline"), F.min("period_index").alias("_first"))
    out = long.join(base, [*keys, "metric"]).where(F.col("period_index") > F.col("_first")).drop("_first")
    return out.withColumn("abs_change", F.abs(F.col("value") - F.col("baseline"))).withColumn(
        "drifted", F.col("abs_change") >= threshold
    )


def ranking_drift(outcomes: DataFrame, days: int = PERIOD_DAYS, rank_max: int = 20, threshold: float = 0.05,
                  keys=("source_type",)) -> DataFrame:
    """Top-k rates, mean rank, MRR and rank PSI of each period against the first."""
    rows = periods(outcomes, keys, days)
    r = F.least("actual_rank", F.lit(rank_max))
    ranked = F.col("actual_rank").isNotNull()
    out = rows.groupBy(*keys, "period_index", "period_start").agg(
        F.count("actual_rank").alias("n_ranked"),
        *[_hit(k).alias(f"top_{k}_rate") for k in (1, 3, 5, 10)],
        F.avg("actual_rank").alias("mean_actual_rank"), _mrr().alias("mean_reciprocal_rank"),
        F.array(*[F.count_if(ranked & (r == i)) for i in range(1, rank_max + 1)]).alias("bins"),
    )
    base = out.where("period_index = 0").select(*keys, F.col("bins").alias("_base"), F.col("n_ranked").alias("_n"))
    scored = out.join(base, list(keys)).withColumn(
        "rank_distribution_psi",
        F.when((F.col("_n") > 0) & (F.col("n_ranked") > 0), psi(F.col("_base"), F.col("_n"), F.col("bins"), F.col("n_ranked"))).otherwise(0.0),
    )
    metrics = ("top_1_rate", "top_3_rate", "top_5_rate", "top_10_rate", "mean_actual_rank", "mean_reciprocal_rank", "rank_distribution_psi")
    return against_first(scored, metrics, threshold, keys)
