"""Frequencies, descriptive statistics, joint and conditional tables."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsframe.functions import stats as S
from obsframe.functions.special import two_sided_p
from obsframe.layout import DIGITS, PAIR_POSITIONS
from obsframe.operators.scans import history


def count_vectors(long: DataFrame, keys=("position",), symbols: int = DIGITS) -> DataFrame:
    """Per-key array of symbol counts: one combined shuffle, zeros included."""
    return long.groupBy(*keys).agg(
        F.count("value").alias("n_obs"), S.digit_counts(F.col("value"), symbols).alias("counts")
    )


def digit_frequency(long: DataFrame, keys=("position",)) -> DataFrame:
    """Count, percentage and probability of all ten digits per key."""
    return (
        count_vectors(long, keys)
        .select(*keys, "n_obs", F.posexplode("counts").alias("digit", "n"))
        .withColumn("pct", S.pct(F.col("n"), F.col("n_obs")))
        .withColumn("prob", F.col("pct") / 100.0)
    )


def distribution_matrix(freq: DataFrame, keys=()) -> DataFrame:
    """Positions as rows, one percentage column per digit."""
    return freq.groupBy(*keys, "position").agg(
        *[F.max(F.when(F.col("digit") == d, F.col("pct"))).alias(f"d{d}") for d in range(DIGITS)]
    )


def frequency_extremes(long: DataFrame, keys=("position",)) -> DataFrame:
    """Most and least frequent digits with ties kept."""
    c = F.col("counts")

    def where_count(value):
        return F.filter(
            F.sequence(F.lit(0), F.lit(DIGITS - 1)), lambda d: F.get(c, d) == value
        )

    return count_vectors(long, keys).select(
        *keys, "n_obs",
        where_count(F.array_max(c)).alias("most_frequent"),
        F.array_max(c).alias("most_count"),
        where_count(F.array_min(c)).alias("least_frequent"),
        F.array_min(c).alias("least_count"),
    )


def describe(long: DataFrame, keys=("position",)) -> DataFrame:
    """Count, range, mean, median, tied modes, population variance and deviation."""
    v = F.col("value")
    out = long.groupBy(*keys).agg(
        F.count(v).alias("n_obs"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"),
        F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("std"),
        S.digit_counts(v).alias("counts"),
    )
    c = F.col("counts")
    modes = F.filter(
        F.sequence(F.lit(0), F.lit(DIGITS - 1)), lambda d: F.get(c, d) == F.array_max(c)
    )
    probs = F.transform(c, lambda x: x / F.col("n_obs"))
    return out.select(
        *keys, "n_obs", "min", "max", (F.col("max") - F.col("min")).alias("range"),
        "mean", "median", modes.alias("modes"), "variance", "std",
        S.array_entropy(probs, 2).alias("entropy_bits"),
    )


def global_frequency(long: DataFrame, keys=()) -> DataFrame:
    """Digit counts pooled over positions, with entropy in bits."""
    vec = count_vectors(long, keys)
    probs = F.transform("counts", lambda x: x / F.col("n_obs"))
    return vec.withColumn("entropy_bits", S.array_entropy(probs, 2)).select(
        *keys, "n_obs", "entropy_bits", F.posexplode("counts").alias("digit", "n")
    ).withColumn("pct", S.pct(F.col("n"), F.col("n_obs")))


def coverage(df: DataFrame, keys=("entity_id",)) -> DataFrame:
    """Records, distinct entities and dates, span, missing days and coverage %."""
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n_records"),
        F.countDistinct("entity_id").alias("n_entities"),
        F.countDistinct("obs_date").alias("n_dates"),
        F.min("obs_date").alias("first_date"), F.max("obs_date").alias("last_date"),
    )
    days = F.datediff("last_date", "first_date") + 1
    return out.withColumns(
        {
            "calendar_days": days,
            "missing_days": F.greatest(days - F.col("n_dates"), F.lit(0)),
            "coverage_pct": F.col("n_dates") * 100.0 / days,
        }
    )


def insights(df: DataFrame, long: DataFrame, trend: DataFrame, keys=("entity_id",)) -> DataFrame:
    """Narrated coverage, extreme digits, trend and spread per key."""
    vec = count_vectors(long, keys).select(
        *keys,
        S.argmax(F.col("counts")).alias("top_digit"),
        (F.array_position("counts", F.array_min("counts")) - 1).alias("low_digit"),
    )
    spread = (
        long.groupBy(*keys, "position").agg(F.stddev_pop("value").alias("s"))
        .groupBy(*keys).agg(F.max("s").alias("spread"))
    )
    k = list(keys)
    wide = coverage(df, keys).join(vec, k).join(spread, k).join(trend.select(*k, "direction"), k)
    lines = {
        "VOLUME": F.format_string("%d observations on record.", "n_records"),
        "COVERAGE": F.format_string(
            "%.2f%% of the calendar is covered; days without an observation: %d.", "coverage_pct", "missing_days"
        ),
        "DIGIT": F.format_string(
            "Most frequent digit: %d, least frequent: %d.",
            "top_digit", "low_digit",
        ),
        "TREND": F.format_string("Over time the mean of a row goes %s.", "direction"),
        "VARIABILITY": F.format_string("Widest spread of a position (standard deviation): %.4f.", "spread"),
    }
    rows = [F.struct(F.lit(a).alias("kind"), b.alias("message")) for a, b in lines.items()]
    return wide.select(*keys, F.inline(F.array(*rows)))


def calendar_counts(df: DataFrame, keys=("entity_id",)) -> DataFrame:
    """Records per month and per year (month NULL) in one pass."""
    step = df.withColumns({"year": F.year("obs_date"), "month": F.month("obs_date")})
    return step.groupingSets(
        [[*keys, "year", "month"], [*keys, "year"]], *keys, "year", "month"
    ).agg(F.count("*").alias("n_records"))


def gap_profile(df: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Gaps between consecutive dates and the calendar days missing in them."""
    gap = F.datediff("obs_date", F.lag("obs_date").over(history(entity)))
    return (
        df.select(entity, "obs_date", gap.alias("gap")).groupBy(entity).agg(
            F.count("gap").alias("n_gaps"), F.avg("gap").alias("mean_gap"),
            F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"),
            F.sum(F.greatest(F.coalesce(F.col("gap") - 1, F.lit(0)), F.lit(0))).alias("missing_days"),
        )
    )


# -- joint, conditional and transition tables --------------------------------


def fill_grid(counts: DataFrame, keys, a: str, b: str, n: str = "n",
              symbols: int = DIGITS) -> DataFrame:
    """Zero-fill a sparse (a, b) count table to the whole symbol grid.

    The map collected per key holds at most symbols² entries.
    """
    cell = F.col(a) * symbols + F.col(b)
    packed = counts.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(cell.alias("c"), F.col(n).alias("n")))).alias("m")
    )
    grid = packed.select(
        *keys, "m", F.explode(F.sequence(F.lit(0), F.lit(symbols * symbols - 1))).alias("c")
    )
    return grid.select(
        *keys, F.expr(f"CAST(c DIV {symbols} AS INT)").alias(a), (F.col("c") % symbols).alias(b),
        F.coalesce(F.try_element_at("m", F.col("c")), F.lit(0).cast("bigint")).alias(n),
    )


def joint_counts(df: DataFrame, keys=(), pairs=PAIR_POSITIONS) -> DataFrame:
    """Sparse joint counts of every unordered position pair.

    Pairs are exploded from the wide row and combined map-side, so what is
    shuffled is at most 100 cells per pair, key and task.
    """
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("position_a"), F.lit(b).alias("position_b"),
                F.col(a).alias("a"), F.col(b).alias("b"),
            )
            for a, b in pairs
        ]
    )
    return (
        df.select(*keys, F.inline(rows)).where("a is not null and b is not null")
        .groupBy(*keys, "position_a", "position_b", "a", "b").agg(F.count("*").alias("n"))
    )


def conditional_probabilities(df: DataFrame, keys=()) -> DataFrame:
    """P(b | a) for all ordered position pairs, zero-filled."""
    joint = joint_counts(df, keys)
    swapped = joint.select(
        *keys, F.col("position_b").alias("position_a"), F.col("position_a").alias("position_b"),
        F.col("b").alias("a"), F.col("a").alias("b"), "n",
    )
    group = [*keys, "position_a", "position_b"]
    grid = fill_grid(joint.unionByName(swapped), group, "a", "b")
    total = F.sum("n").over(Window.partitionBy(*group, "a"))
    return grid.withColumn("n_source", total).withColumn(
        "prob", S.ratio(F.col("n"), F.col("n_source"), 0.0)
    )


def independence(df: DataFrame, keys=()) -> DataFrame:
    """Chi-square and largest |joint − product| of every unordered pair."""
    group = [*keys, "position_a", "position_b"]
    grid = fill_grid(joint_counts(df, keys), group, "a", "b")
    w = Window.partitionBy(*group)
    step = grid.withColumns(
        {
            "total": F.sum("n").over(w),
            "row_n": F.sum("n").over(Window.partitionBy(*group, "a")),
            "col_n": F.sum("n").over(Window.partitionBy(*group, "b")),
        }
    )
    expected = F.col("row_n") * F.col("col_n") / F.col("total")
    product = (F.col("row_n") / F.col("total")) * (F.col("col_n") / F.col("total"))
    return step.groupBy(*group).agg(
        F.max("total").alias("n_obs"),
        F.sum(
            F.coalesce((F.col("n") - expected) * (F.col("n") - expected)
                       / F.nullif(expected, F.lit(0.0)), F.lit(0.0))
        ).alias("chi_square"),
        F.lit(81).alias("dof"),
        F.max(F.abs(F.col("n") / F.col("total") - product)).alias("max_diff"),
    ).withColumn("independent", F.col("max_diff") <= 1e-12)


def significance(long: DataFrame, keys=("position",), expected: float = 0.1,
                 with_p: bool = True) -> DataFrame:
    """z score of each digit against a flat expectation, and its two-sided p."""
    n = F.col("n_obs").cast("double")
    out = digit_frequency(long, keys).withColumn(
        "z", S.ratio(F.col("n") / n - expected, F.sqrt(F.lit(expected * (1 - expected)) / n), 0.0)
    )
    if not with_p:
        return out
    return out.withColumn("p_value", two_sided_p("z")).withColumn(
        "significant", F.col("p_value") < 0.05
    )


def compare_baselines(previous: DataFrame, current: DataFrame, keys=("position", "digit"),
                      tolerance: float = 0.0) -> DataFrame:
    """Probability change per (position, digit) and whether it exceeds a tolerance."""
    p = previous.select(*keys, F.col("prob").alias("previous_prob"))
    c = current.select(*keys, F.col("prob").alias("current_prob"))
    return p.join(c, list(keys), "full_outer").withColumn(
        "change", F.col("current_prob") - F.col("previous_prob")
    ).withColumn("changed", F.abs("change") > tolerance)


def rate_table(pairs: DataFrame, keys=("relation",), digits: int = 8) -> DataFrame:
    """Counts and conditional rates of (src, dst) rows."""
    counts = pairs.groupBy(*keys, "src", "dst").agg(F.count("*").alias("n"))
    support = F.sum("n").over(Window.partitionBy(*keys, "src"))
    return counts.withColumn("support", support).withColumn(
        "rate", F.round(F.col("n") / F.col("support"), digits)
    )


# Relations between code digits, (name, source, target, labelled by index).
RELATIONS = (
    ("head_digit_to_pair_digit", ("p1", "p2", "p3"), ("p4", "p5"), False),
    ("head_position_to_pair_position", ("p1", "p2", "p3"), ("p4", "p5"), True),
    ("head_digit_to_tail_digit", ("p1", "p2", "p3"), ("p6", "p7", "p8"), False),
    ("pair_digit_to_tail_digit", ("p4", "p5"), ("p6", "p7", "p8"), False),
    ("pair_first_to_second", ("p4",), ("p5",), False),
    ("tail_first_to_second", ("p6",), ("p7",), False),
    ("tail_second_to_third", ("p7",), ("p8",), False),
)
# Single conditional tables of the statistical profile.
PROFILE_RELATIONS = (
    ("head_to_pair_first", ("p1",), ("p4",), False),
    ("head_to_pair_second", ("p1",), ("p5",), False),
    ("pair_first_to_pair_second", ("p4",), ("p5",), False),
    ("pair_first_to_tail_first", ("p4",), ("p6",), False),
    ("pair_second_to_tail_first", ("p5",), ("p6",), False),
)


def relation_rows(df: DataFrame, relations=RELATIONS, keys=()) -> DataFrame:
    """One (relation, src, dst) row per digit pair of each relation."""

    def state(col: str, index: int, labelled: bool) -> Column:
        text = F.col(col).cast("string")
        return F.concat(F.lit(f"{index + 1}:"), text) if labelled else text

    cells = [
        F.struct(
            F.lit(name).alias("relation"),
            state(s, i, labelled).alias("src"), state(d, j, labelled).alias("dst"),
        )
        for name, sources, targets, labelled in relations
        for i, s in enumerate(sources) for j, d in enumerate(targets)
    ]
    return df.select(*keys, F.inline(F.array(*cells)))


def profile_conditionals(df: DataFrame, keys=()) -> DataFrame:
    """The profile's five conditional tables, zero-filled and rounded to 8 places."""
    counts = (
        relation_rows(df, PROFILE_RELATIONS, keys)
        .groupBy(*keys, "relation", F.col("src").cast("int").alias("src"),
                 F.col("dst").cast("int").alias("dst"))
        .agg(F.count("*").alias("n"))
    )
    grid = fill_grid(counts, [*keys, "relation"], "src", "dst")
    total = F.sum("n").over(Window.partitionBy(*keys, "relation", "src"))
    return grid.withColumn("rate", F.round(S.ratio(F.col("n"), total, 0.0), 8))


def state_transitions(df: DataFrame, states: dict[str, tuple[Column, Column]],
                      entity: str = "entity_id") -> DataFrame:
    """(relation, src, dst): src of the previous observation, dst of the current."""
    w = history(entity)
    step = df.select(
        entity,
        *[F.lag(s.cast("string")).over(w).alias(f"s{i}") for i, (s, _) in enumerate(states.values())],
        *[d.cast("string").alias(f"d{i}") for i, (_, d) in enumerate(states.values())],
        F.lag(F.lit(1)).over(w).alias("has_previous"),
    ).where("has_previous = 1")
    rows = [
        F.struct(F.lit(name).alias("relation"), F.col(f"s{i}").alias("src"), F.col(f"d{i}").alias("dst"))
        for i, name in enumerate(states)
    ]
    return step.select(entity, F.inline(F.array(*rows)))


def top_transitions(steps: DataFrame, keys=("relation",), k: int = 25) -> DataFrame:
    """The k most common transitions of each relation and their rate."""
    counts = steps.groupBy(*keys, "src", "dst").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(
        F.sum("n").alias("transition_count"),
        F.countDistinct("src").alias("n_sources"), F.countDistinct("dst").alias("n_targets"),
    )
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc_nulls_first("src"), F.asc_nulls_first("dst"))
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(totals, list(keys)).withColumn(
        "rate", F.round(F.col("n") / F.col("transition_count"), 8)
    )


def transition_matrix(long: DataFrame, keys=("entity_id", "position"), by=("position",)) -> DataFrame:
    """Row-normalised symbol transitions between consecutive rows of a series."""
    step = long.select(
        *by, F.col("value").alias("src"), F.lead("value").over(history(*keys)).alias("dst")
    ).where("dst is not null")
    return rate_table(step, by)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of every table."""
    return reduce(
        DataFrame.unionByName,
        [t.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
         for n, t in tables.items()],
    )


def status_summary(df: DataFrame, status: str = "status", keys=("entity_id",)) -> DataFrame:
    """Counts by status, percentage valid and a quality label."""
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n_records"),
        *[F.count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in ("VALID", "WARNING", "INVALID")],
    )
    pct = S.pct(F.col("n_valid"), F.col("n_records"))
    return out.withColumn("valid_pct", pct).withColumn(
        "quality",
        F.when(F.col("valid_pct") >= 99, "EXCELLENT").when(F.col("valid_pct") >= 95, "GOOD")
        .when(F.col("valid_pct") >= 90, "FAIR").otherwise("NEEDS_REVIEW"),
    )
