"""Windowed distributions, temporal profiles, relations and regimes (K, L, M)."""

from pyspark.sql import functions as F

from obsframe.operators import aggregates as A
from obsframe.operators import distributions as D
from obsframe.operators import relations as R
from obsframe.operators import temporal as TP
from obsframe.operators import windows as W
from obsframe.plans.catalog import day, q, r, register
from obsframe.plans.features import S
from obsframe.plans.statistics import FREQ, _halves

SIZE, ERA = 25, 6


def windows(t):
    return D.distribution_windows(t.long, SIZE)


def changes(t):
    return D.window_changes(windows(t))


def era_keys(t):
    """Changes inside eras of six windows."""
    w = D.with_era(windows(t), ERA)
    return D.window_changes(w, ("entity_id", "era"))


def era_overviews(t):
    trends = D.digit_trends(era_keys(t), ("entity_id", "era"))
    return D.stability_overview(D.stability_by_position(trends, ("entity_id", "era")), ("entity_id", "era"))


WIN = f"""rw AS (SELECT *, CAST((row_number() OVER {S}) - 1) // {SIZE} + 1 AS INTEGER) AS window_index FROM longs),
wd AS (SELECT k.entity_id, k.position, k.window_index, CAST(d.range AS INTEGER) AS digit, coalesce(c.n, 0) * 100.0 / k.n AS pct
  FROM (SELECT entity_id, position, window_index, count(*)::DOUBLE AS n FROM rw GROUP BY 1, 2, 3) k CROSS JOIN range(10) d
  LEFT JOIN (SELECT entity_id, position, window_index, value, count(*) AS n FROM rw GROUP BY 1, 2, 3, 4) c
  ON c.entity_id = k.entity_id AND c.position = k.position AND c.window_index = k.window_index AND c.value = d.range)"""


def label(x: str, up="INCREASING", down="DECREASING", flat="UNCHANGED") -> str:
    return f"CASE WHEN {x} > 0 THEN '{up}' WHEN {x} < 0 THEN '{down}' ELSE '{flat}' END"


def band(x: str, names=("LOW", "MEDIUM", "HIGH")) -> str:
    return f"CASE WHEN {x} < 2 THEN '{names[0]}' WHEN {x} < 5 THEN '{names[1]}' ELSE '{names[2]}' END"


def chg(extra: str = "") -> str:
    part = f"entity_id, {extra}position, digit"
    src = f"(SELECT *, CAST((window_index - 1) // {ERA} + 1 AS INTEGER) AS era FROM wd)" if extra else "wd"
    return f"""ch AS (SELECT *, {label('change')} AS direction FROM (SELECT *, pct - lag(pct) OVER (PARTITION BY {part} ORDER BY window_index) AS change FROM {src}) WHERE change IS NOT NULL)"""


def trends(extra: str = "") -> str:
    k = f"entity_id, {extra}position, digit"
    return f"""dt AS (SELECT *, CASE WHEN n_increasing = n_changes THEN 'INCREASING' WHEN n_decreasing = n_changes THEN 'DECREASING' WHEN n_unchanged = n_changes THEN 'UNCHANGED' ELSE 'MIXED' END AS trend_direction,
  {band('mean_abs')} AS level, {band('mean_abs', ('STABLE', 'MODERATE', 'UNSTABLE'))} AS stability,
  greatest(n_increasing, n_decreasing, n_unchanged) / n_changes * 100 AS consistency_pct,
  CASE WHEN n_increasing > n_decreasing THEN 'INCREASING' WHEN n_decreasing > n_increasing THEN 'DECREASING' WHEN n_increasing = 0 AND n_decreasing = 0 THEN 'UNCHANGED' ELSE 'MIXED' END AS dominant_direction,
  CASE WHEN n_increasing = 0 AND n_decreasing = 0 THEN n_unchanged ELSE greatest(n_increasing, n_decreasing) END / n_changes * 100 AS persistence_pct
  FROM (SELECT {k}, count(*) AS n_changes, count(*) FILTER (direction = 'INCREASING') AS n_increasing, count(*) FILTER (direction = 'DECREASING') AS n_decreasing, count(*) FILTER (direction = 'UNCHANGED') AS n_unchanged,
  sum(change) AS total_change, avg(change) AS mean_change, sum(abs(change)) AS total_abs, avg(abs(change)) AS mean_abs, max(abs(change)) AS max_abs, min(abs(change)) AS min_abs FROM ch GROUP BY {k}))"""


HALF = """half AS (SELECT a.position, a.digit, a.pct AS pct_a, b.pct AS pct_b, b.pct - a.pct AS change, abs(b.pct - a.pct) AS abs_change FROM (
  SELECT position, d.range AS digit, count(*) FILTER (value = d.range) * 100.0::DOUBLE / count(*) AS pct FROM longs CROSS JOIN range(10) d WHERE obs_date < DATE '1998-04-01' GROUP BY 1, 2) a
  JOIN (SELECT position, d.range AS digit, count(*) FILTER (value = d.range) * 100.0::DOUBLE / count(*) AS pct FROM longs CROSS JOIN range(10) d WHERE obs_date >= DATE '1998-04-01' GROUP BY 1, 2) b USING (position, digit))"""
ID_WD = "entity_id, position, window_index"

register(
    "k01_digit_changes", lambda t: D.digit_changes(*_halves(t)),
    q(f"SELECT position, CAST(digit AS INTEGER) AS digit, {r('pct_a', 'pct_a')}, {r('pct_b', 'pct_b')}, {r('change', 'change')}, {r('abs_change', 'abs_change')}, {label('change', 'INCREASED', 'DECREASED')} AS direction FROM half", HALF),
)
register(
    "k01_change_totals", lambda t: D.change_totals(D.digit_changes(*_halves(t))),
    q(f"SELECT position, {r('sum(abs_change)', 'total_abs_change')}, {r('sum(abs_change) / 10', 'mean_abs_change')}, count(*) FILTER (change > 0) AS n_increased, count(*) FILTER (change < 0) AS n_decreased, count(*) FILTER (change = 0) AS n_unchanged FROM half GROUP BY 1", HALF),
)
register(
    "k02_classified_changes", lambda t: D.classify_changes(D.digit_changes(*_halves(t)), 0.5, 0.5, 1.0).select("position", "digit", "direction", "magnitude"),
    q("SELECT position, CAST(digit AS INTEGER) AS digit, CASE WHEN abs_change > 0.5 AND change > 0 THEN 'INCREASED' WHEN abs_change > 0.5 AND change < 0 THEN 'DECREASED' ELSE 'UNCHANGED' END AS direction, CASE WHEN abs_change < 0.5 THEN 'LOW' WHEN abs_change < 1.0 THEN 'MEDIUM' ELSE 'HIGH' END AS magnitude FROM half", HALF),
)
register(
    "k03_magnitude_counts", lambda t: D.classified_counts(D.classify_changes(D.digit_changes(*_halves(t)), 0.5, 0.5, 1.0)),
    q("""SELECT position, count(*) FILTER (abs_change > 0.5 AND change > 0) AS n_increased, count(*) FILTER (abs_change > 0.5 AND change < 0) AS n_decreased, count(*) FILTER (abs_change <= 0.5) AS n_unchanged,
      count(*) FILTER (abs_change < 0.5) AS n_low, count(*) FILTER (abs_change >= 0.5 AND abs_change < 1.0) AS n_medium, count(*) FILTER (abs_change >= 1.0) AS n_high FROM half GROUP BY 1""", HALF),
)
register(
    "k04_change_trends",
    lambda t: D.digit_trends(changes(t)).select("entity_id", "position", "digit", "n_changes", "n_increasing", "n_decreasing", "n_unchanged", "total_change", "mean_change", "trend_direction"),
    q(f"SELECT entity_id, position, digit, n_changes, n_increasing, n_decreasing, n_unchanged, {r('total_change', 'total_change')}, {r('mean_change', 'mean_change')}, trend_direction FROM dt", WIN, chg(), trends()),
)
register(
    "k05_position_differences", lambda t: D.position_differences(A.digit_frequency(t.long, ["entity_id", "position"]), ["entity_id"]),
    q(f"SELECT a.entity_id, a.position AS position_a, b.position AS position_b, {r('sum(abs(a.pct - b.pct)) / 10', 'mean_abs_difference')} FROM freq a JOIN freq b ON a.entity_id = b.entity_id AND a.digit = b.digit AND a.position < b.position GROUP BY 1, 2, 3", FREQ),
)
register(
    "k05_position_difference_summary",
    lambda t: D.summarise(D.position_differences(A.digit_frequency(t.long, ["entity_id", "position"]), ["entity_id"]), "mean_abs_difference", ["entity_id"]),
    q(f"""SELECT entity_id, count(*) AS n, {r('avg(m)', 'mean')}, {r('median(m)', 'median')}, {r('min(m)', 'min')}, {r('max(m)', 'max')}, {r('stddev_pop(m)', 'std')} FROM (
      SELECT a.entity_id, a.position, b.position, sum(abs(a.pct - b.pct)) / 10 AS m FROM freq a JOIN freq b ON a.entity_id = b.entity_id AND a.digit = b.digit AND a.position < b.position GROUP BY 1, 2, 3) GROUP BY 1""", FREQ),
)
register(
    "k06_window_differences", lambda t: D.window_differences(changes(t)),
    q(f"SELECT {ID_WD}, {r('sum(abs(change)) / 10', 'mean_abs_difference')} FROM ch GROUP BY 1, 2, 3", WIN, chg()),
)
register(
    "k06_window_difference_summary", lambda t: D.summarise(D.window_differences(changes(t)), "mean_abs_difference", ["entity_id", "position"]),
    q(f"SELECT entity_id, position, count(*) AS n, {r('avg(m)', 'mean')}, {r('median(m)', 'median')}, {r('min(m)', 'min')}, {r('max(m)', 'max')}, {r('stddev_pop(m)', 'std')} FROM (SELECT {ID_WD}, sum(abs(change)) / 10 AS m FROM ch GROUP BY 1, 2, 3) GROUP BY 1, 2", WIN, chg()),
)
register(
    "k07_volatility",
    lambda t: D.digit_trends(changes(t)).select("entity_id", "position", "digit", "n_changes", "total_abs", "mean_abs", "max_abs", "min_abs", F.col("level").alias("volatility_level")),
    q(f"SELECT entity_id, position, digit, n_changes, {r('total_abs', 'total_abs')}, {r('mean_abs', 'mean_abs')}, {r('max_abs', 'max_abs')}, {r('min_abs', 'min_abs')}, level AS volatility_level FROM dt", WIN, chg(), trends()),
)
COUNTS = ", ".join(f"count(*) FILTER (level = '{x}') AS n_{x.lower()}" for x in ("LOW", "MEDIUM", "HIGH")) + ", " + ", ".join(
    f"count(*) FILTER (trend_direction = '{x}') AS n_{x.lower()}" for x in ("INCREASING", "DECREASING", "UNCHANGED", "MIXED"))
register(
    "k08_trend_strength_summary", lambda t: D.trend_summary(D.digit_trends(changes(t))),
    q(f"SELECT entity_id, position, count(*) AS n_digits, {COUNTS}, {r('sum(total_abs)', 'total_abs')}, {r('avg(mean_abs)', 'average_mean_abs')} FROM dt GROUP BY 1, 2", WIN, chg(), trends()),
)
STREAK = """st AS (SELECT entity_id, position, digit, max(n) AS max_streak FROM (SELECT entity_id, position, digit, direction, g, count(*) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id, position, digit ORDER BY window_index) - row_number() OVER (PARTITION BY entity_id, position, digit, direction ORDER BY window_index) AS g FROM ch) GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3),
sw AS (SELECT entity_id, position, digit, count(*) FILTER (pd <> direction AND pd <> 'UNCHANGED' AND direction <> 'UNCHANGED') AS n_switches FROM (
  SELECT *, lag(direction) OVER (PARTITION BY entity_id, position, digit ORDER BY window_index) AS pd FROM ch) GROUP BY 1, 2, 3)"""
register(
    "k09_trend_consistency",
    lambda t: D.trend_consistency(changes(t)).select("entity_id", "position", "digit", "consistency_pct", "consistency_level", "n_switches", "max_streak"),
    q(f"SELECT entity_id, position, digit, {r('consistency_pct', 'consistency_pct')}, CASE WHEN consistency_pct >= 80 THEN 'HIGH' WHEN consistency_pct >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS consistency_level, n_switches, max_streak FROM dt JOIN st USING (entity_id, position, digit) JOIN sw USING (entity_id, position, digit)", WIN, chg(), trends(), STREAK),
)
register(
    "k10_trend_persistence",
    lambda t: D.trend_consistency(changes(t)).select("entity_id", "position", "digit", "dominant_direction", "persistence_pct", F.col("max_streak").alias("longest_streak")),
    q(f"SELECT entity_id, position, digit, dominant_direction, {r('persistence_pct', 'persistence_pct')}, max_streak AS longest_streak FROM dt JOIN st USING (entity_id, position, digit)", WIN, chg(), trends(), STREAK),
)
register(
    "k11_stability_detail",
    lambda t: D.digit_trends(changes(t)).select("entity_id", "position", "digit", "mean_abs", F.col("stability").alias("stability_level")),
    q(f"SELECT entity_id, position, digit, {r('mean_abs', 'mean_abs')}, stability AS stability_level FROM dt", WIN, chg(), trends()),
)


def by_position(extra: str = "") -> str:
    k = f"entity_id, {extra}position"
    return f"""sp AS (SELECT *, {band('average_mean_abs', ('STABLE', 'MODERATE', 'UNSTABLE'))} AS stability_level FROM (SELECT {k}, count(*) AS n_digits, count(*) FILTER (stability = 'STABLE') AS n_stable, count(*) FILTER (stability = 'MODERATE') AS n_moderate,
  count(*) FILTER (stability = 'UNSTABLE') AS n_unstable, sum(total_abs) AS total_abs, avg(mean_abs) AS average_mean_abs, min(mean_abs) AS min_mean_abs, max(mean_abs) AS max_mean_abs FROM dt GROUP BY {k}))"""


OVER = f"""ov AS (SELECT *, n_stable * 100.0 / n_positions AS stable_pct, n_moderate * 100.0 / n_positions AS moderate_pct, n_unstable * 100.0 / n_positions AS unstable_pct, {band('average_mean_abs', ('STABLE', 'MODERATE', 'UNSTABLE'))} AS overall_level FROM (
  SELECT entity_id, era, count(*)::DOUBLE AS n_positions, count(*) FILTER (stability_level = 'STABLE') AS n_stable, count(*) FILTER (stability_level = 'MODERATE') AS n_moderate, count(*) FILTER (stability_level = 'UNSTABLE') AS n_unstable,
  sum(total_abs) AS total_abs, avg(average_mean_abs) AS average_mean_abs, min(average_mean_abs) AS min_mean_abs, max(average_mean_abs) AS max_mean_abs FROM sp GROUP BY 1, 2))"""
ERAS = (WIN, chg("era, "), trends("era, "), by_position("era, "), OVER)
register(
    "k12_stability_by_position", lambda t: D.stability_by_position(D.digit_trends(changes(t))),
    q(f"SELECT entity_id, position, n_digits, n_stable, n_moderate, n_unstable, {r('total_abs', 'total_abs')}, {r('average_mean_abs', 'average_mean_abs')}, {r('min_mean_abs', 'min_mean_abs')}, {r('max_mean_abs', 'max_mean_abs')}, stability_level FROM sp", WIN, chg(), trends(), by_position()),
)
register(
    "k13_stability_overview", lambda t: era_overviews(t),
    q(f"SELECT entity_id, era, CAST(n_positions AS BIGINT) AS n_positions, n_stable, n_moderate, n_unstable, {r('total_abs', 'total_abs')}, {r('average_mean_abs', 'average_mean_abs')}, {r('min_mean_abs', 'min_mean_abs')}, {r('max_mean_abs', 'max_mean_abs')}, {r('stable_pct', 'stable_pct')}, {r('moderate_pct', 'moderate_pct')}, {r('unstable_pct', 'unstable_pct')}, overall_level FROM ov", *ERAS),
)
M3 = ("stable_pct", "moderate_pct", "unstable_pct")
STEP = "stp AS (SELECT *, " + ", ".join(f"{m} - lag({m}) OVER (PARTITION BY entity_id ORDER BY era) AS {m}_change" for m in M3) + " FROM ov)"
ST = f"""tr AS (SELECT *, CASE WHEN stable_pct_change > 0 AND unstable_pct_change < 0 THEN 'STABLE_INCREASING' WHEN stable_pct_change < 0 AND unstable_pct_change > 0 THEN 'STABILITY_DECREASING'
  WHEN stable_pct_change = 0 AND moderate_pct_change = 0 AND unstable_pct_change = 0 THEN 'STABLE' ELSE 'MIXED' END AS direction, {band('mean_abs_change')} AS strength FROM (
  SELECT entity_id, count(*) AS n_windows, {', '.join(f'arg_min({m}, era) AS {m}_start, arg_max({m}, era) AS {m}_end, arg_max({m}, era) - arg_min({m}, era) AS {m}_change' for m in M3)},
  sum({' + '.join(f'coalesce(abs({m}_change), 0)' for m in M3)}) AS total_abs_change, coalesce(sum({' + '.join(f'coalesce(abs({m}_change), 0)' for m in M3)}) / nullif(count(*) - 1, 0), 0) AS mean_abs_change FROM stp GROUP BY 1))"""
TOP3 = "greatest(stable_pct_end, moderate_pct_end, unstable_pct_end)"
register(
    "k14_stability_trend", lambda t: D.stability_trend(era_overviews(t)),
    q(f"SELECT entity_id, n_windows, {', '.join(r(f'{m}_{s}', f'{m}_{s}') for m in M3 for s in ('start', 'end', 'change'))}, {r('total_abs_change', 'total_abs_change')}, {r('mean_abs_change', 'mean_abs_change')}, direction, strength, "
      f"array_to_string(list_filter([CASE WHEN stable_pct_end = {TOP3} THEN 'STABLE' END, CASE WHEN moderate_pct_end = {TOP3} THEN 'MODERATE' END, CASE WHEN unstable_pct_end = {TOP3} THEN 'UNSTABLE' END], lambda v: v IS NOT NULL), ',') AS dominant_levels FROM tr", *ERAS, STEP, ST),
)
register(
    "k15_stability_trend_summary", lambda t: D.stability_trend_summary(D.stability_trend(era_overviews(t))),
    q("SELECT count(*) AS n_trends, " + ", ".join(f"count(*) FILTER (direction = '{d}') AS n_{d.lower()}" for d in D.DIRECTIONS) + ", " + ", ".join(f"count(*) FILTER (strength = '{s}') AS n_{s.lower()}" for s in ("LOW", "MEDIUM", "HIGH"))
      + f", {r('avg(mean_abs_change)', 'average_movement')}, {r('min(mean_abs_change)', 'min_movement')}, {r('max(mean_abs_change)', 'max_movement')}, {r('sum(total_abs_change)', 'total_movement')} FROM tr", *ERAS, STEP, ST),
)
MV = " + ".join(f"abs({m}_change)" for m in M3)
register(
    "k16_movement_summary", lambda t: D.movement_summary(era_overviews(t)),
    q(f"SELECT entity_id, count(*) AS n_transitions, count(*) FILTER (m < 2) AS n_low, count(*) FILTER (m >= 2 AND m < 5) AS n_medium, count(*) FILTER (m >= 5) AS n_high, {r('avg(m)', 'average_movement')}, {r('min(m)', 'min_movement')}, {r('max(m)', 'max_movement')}, {r('sum(m)', 'total_movement')} FROM (SELECT entity_id, {MV} AS m FROM stp WHERE stable_pct_change IS NOT NULL) GROUP BY 1", *ERAS, STEP),
)
METRICS = (*M3, "n_stable", "n_unstable")
DETAIL = ("stq AS (SELECT *, " + ", ".join(f"{m} - lag({m}) OVER (PARTITION BY entity_id ORDER BY era) AS {m}_change" for m in METRICS) + " FROM ov),\nsd AS ("
          + " UNION ALL ".join(f"SELECT entity_id, era, '{m}' AS metric, {m} AS value, {m}_change AS change FROM stq" for m in METRICS) + ")")


def detail(t):
    return D.series_detail(era_overviews(t), ["entity_id"], "era", METRICS)


register("k17_series_detail", lambda t: detail(t), q(f"SELECT entity_id, era, metric, {r('value', 'value')}, {r('change', 'change')}, {label('change')} AS direction FROM sd WHERE change IS NOT NULL", *ERAS, DETAIL))
SUM = f"""ss AS (SELECT entity_id, metric, count(*) AS n_transitions, count(*) FILTER (change > 0) AS n_increasing, count(*) FILTER (change < 0) AS n_decreasing, count(*) FILTER (change = 0) AS n_unchanged, {r('avg(abs(change))', 'average_movement')},
  {r('min(abs(change))', 'min_movement')}, {r('max(abs(change))', 'max_movement')}, {r('sum(abs(change))', 'total_movement')} FROM sd WHERE change IS NOT NULL GROUP BY 1, 2)"""
register("k18_series_summary", lambda t: D.series_summary(detail(t), ["entity_id"]), q("SELECT * FROM ss", *ERAS, DETAIL, SUM))
BIG = "greatest(n_increasing, n_decreasing, n_unchanged)"
register(
    "k19_series_overview", lambda t: D.series_overview(D.series_summary(detail(t), ["entity_id"])),
    q(f"SELECT *, {', '.join(r(f'n_{m} * 100.0 / n_transitions', f'{m}_pct') for m in ('increasing', 'decreasing', 'unchanged'))}, array_to_string(list_filter([CASE WHEN n_increasing = {BIG} THEN 'INCREASING' END, CASE WHEN n_decreasing = {BIG} THEN 'DECREASING' END, CASE WHEN n_unchanged = {BIG} THEN 'UNCHANGED' END], lambda v: v IS NOT NULL), ',') AS dominant FROM ss", *ERAS, DETAIL, SUM),
)
register(
    "k20_series_comparison", lambda t: D.series_comparison(era_overviews(t), ["entity_id"], "era", METRICS),
    q(f"SELECT entity_id, metric, {r('s', 'start')}, {r('e', 'end')}, {r('e - s', 'change')}, {r('abs(e - s)', 'abs_change')}, n AS n_transitions, {r('coalesce(m, 0)', 'total_movement')}, {r('coalesce(m / nullif(n, 0), 0)', 'mean_movement')} FROM (SELECT entity_id, metric, arg_min(value, era) AS s, arg_max(value, era) AS e, count(change) AS n, sum(abs(change)) AS m FROM sd GROUP BY 1, 2)".replace("AS end", 'AS "end"').replace("AS start", 'AS "start"'), *ERAS, DETAIL),
)
register(
    "k21_unpivoted_comparison", lambda t: D.unpivot_metrics(era_overviews(t), ["entity_id", "era"], list(METRICS)),
    q(f"SELECT entity_id, era, metric, {r('value', 'value')} FROM sd", *ERAS, DETAIL),
)

# -- L temporal ---------------------------------------------------------------

LSTEP = f"ls AS (SELECT *, value - lag(value) OVER {S}) AS change, lag(obs_date) OVER {S}) AS previous_date, lag(value) OVER {S}) AS previous_value FROM longs)"
LA = """la AS (SELECT entity_id, position, count(*) AS n_obs, min(obs_date) AS first_date, max(obs_date) AS last_date, arg_min(value, obs_date) AS first_value, arg_max(value, obs_date) AS last_value, min(value) AS min, max(value) AS max,
  avg(value) AS mean, stddev_pop(value) AS std, count(change) AS n_changes, count(*) FILTER (change > 0) AS n_increase, count(*) FILTER (change < 0) AS n_decrease, count(*) FILTER (change = 0) AS n_unchanged,
  avg(abs(change)) AS mean_abs_step, max(abs(change)) AS max_abs_step FROM ls GROUP BY 1, 2)"""
register(
    "l01_temporal_analysis", lambda t: TP.temporal_analysis(t.long),
    q(f"SELECT entity_id, position, n_obs, {day('first_date')}, {day('last_date')}, first_value, last_value, min, max, {r('mean', 'mean')}, {r('std', 'std')}, n_changes, n_increase, n_decrease, n_unchanged, {r('mean_abs_step', 'mean_abs_step')}, max_abs_step, last_value - first_value AS net_change, abs(last_value - first_value) AS abs_net_change, "
      + ", ".join(r(f"n_{m} * 100.0 / n_changes", f"{m}_pct") for m in ("increase", "decrease", "unchanged")) + " FROM la", LSTEP, LA),
)
register(
    "l02_temporal_summary", lambda t: TP.temporal_summary(TP.temporal_analysis(t.long)),
    q(f"SELECT entity_id, count(*) AS n_positions, CAST(sum(n_obs) AS BIGINT) AS total_obs, CAST(sum(n_changes) AS BIGINT) AS total_changes, CAST(sum(n_increase) AS BIGINT) AS total_increase, CAST(sum(n_decrease) AS BIGINT) AS total_decrease, CAST(sum(n_unchanged) AS BIGINT) AS total_unchanged, {r('avg(mean)', 'average_mean')}, {r('avg(std)', 'average_std')}, {r('avg(mean_abs_step)', 'average_abs_step')}, max(max_abs_step) AS max_abs_step FROM la GROUP BY 1", LSTEP, LA),
)


def with_gaps(t):
    """Long rows in which the digit 7 stands for a missing value."""
    return t.long.withColumn("value", F.when(F.col("value") != 7, F.col("value")))


GAPPY = f"lg AS (SELECT *, lag(v) OVER {S}) AS previous_value, lag(obs_date) OVER {S}) AS previous_date FROM (SELECT *, nullif(value, 7) AS v FROM longs)),\nlc AS (SELECT *, v - previous_value AS change, abs(v - previous_value) AS abs_change, CASE WHEN v IS NULL OR previous_value IS NULL THEN 'MISSING' WHEN v > previous_value THEN 'INCREASE' WHEN v < previous_value THEN 'DECREASE' ELSE 'UNCHANGED' END AS direction, CASE WHEN v IS NULL OR previous_value IS NULL THEN 'MISSING' WHEN v = previous_value THEN 'UNCHANGED' WHEN abs(v - previous_value) < 2 THEN 'LOW' WHEN abs(v - previous_value) < 5 THEN 'MEDIUM' ELSE 'HIGH' END AS magnitude FROM lg WHERE previous_date IS NOT NULL)"
register(
    "l03_step_changes", lambda t: TP.change_steps(with_gaps(t)).drop("magnitude"),
    q(f"SELECT entity_id, position, {day('previous_date')}, {day('obs_date')}, previous_value, v AS value, change, abs_change, direction FROM lc", GAPPY),
)
register(
    "l04_step_magnitudes", lambda t: TP.change_steps(with_gaps(t)).groupBy("entity_id", "position", "magnitude").agg(F.count("*").alias("n")),
    q("SELECT entity_id, position, magnitude, count(*) AS n FROM lc GROUP BY 1, 2, 3", GAPPY),
)
register(
    "l05_change_summary", lambda t: TP.change_summary(TP.change_steps(with_gaps(t))),
    q("SELECT entity_id, position, count(*) AS n_changes, " + ", ".join(f"count(*) FILTER (magnitude = '{c}') AS n_{c.lower()}, {r(f'''count(*) FILTER (magnitude = '{c}') * 100.0 / count(*)''', f'{c.lower()}_pct')}" for c in TP.CLASSES) + " FROM lc GROUP BY GROUPING SETS ((entity_id, position), (entity_id))", GAPPY),
)


def profiles(t):
    rw = R.regime_windows(t.long)
    return TP.behaviour_profiles(
        A.describe(t.long, ["entity_id", "position"]), TP.temporal_analysis(t.long),
        D.digit_trends(changes(t)), R.regime_stability(rw), R.regime_summary(rw),
    )


RG = f"""g1 AS (SELECT *, CAST((row_number() OVER {S}) - 1) // 5 + 1 AS INTEGER) AS window_index FROM longs),
g2 AS (SELECT entity_id, position, window_index, min(obs_date) AS start_date, max(obs_date) AS end_date, count(*) AS n_obs, avg(value) AS mean, stddev_pop(value) AS std,
  [{', '.join(f'count(*) FILTER (value = {d})' for d in range(10))}] AS c FROM g1 GROUP BY 1, 2, 3),
g3 AS (SELECT *, CAST(list_position(c, list_max(c)) - 1 AS INTEGER) AS dominant_digit, list_max(c) / n_obs * 100.0 AS dominant_pct,
  list_sum(list_transform(c, lambda v: CASE WHEN v > 0 THEN -(v / n_obs) * log2(v / n_obs) ELSE 0 END)) AS entropy FROM g2),
rg AS (SELECT *, CASE WHEN dominant_pct >= 60 THEN 'CONCENTRATED' WHEN entropy >= 2.75 THEN 'DIVERSE' ELSE 'BALANCED' END AS regime FROM g3),
rt AS (SELECT *, CASE WHEN previous_regime = regime THEN 'UNCHANGED' ELSE 'TRANSITION' END AS transition FROM (SELECT entity_id, position, window_index, lag(regime) OVER (PARTITION BY entity_id, position ORDER BY window_index) AS previous_regime, regime FROM rg) WHERE previous_regime IS NOT NULL)"""
PROF = f"""pd AS (SELECT entity_id, position, n_obs_ AS n_obs, mean_ AS mean, std_ AS std, e AS entropy_bits FROM (SELECT entity_id, position, count(*) AS n_obs_, avg(value) AS mean_, stddev_pop(value) AS std_ FROM longs GROUP BY 1, 2)
  JOIN (SELECT entity_id, position, -sum(CASE WHEN n > 0 THEN n / n_obs * log2(n / n_obs) ELSE 0 END) AS e FROM freq GROUP BY 1, 2) USING (entity_id, position)),
pf AS (SELECT pd.*, la.n_changes, la.mean_abs_step, m.volatility, m.consistency, s.regime_stability, s.regime_level, s.dominant_regime,
  {band('m.volatility')} AS volatility_level, CASE WHEN m.consistency >= 80 THEN 'HIGH' WHEN m.consistency >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS consistency_level
  FROM pd JOIN la USING (entity_id, position) JOIN (SELECT entity_id, position, avg(mean_abs) AS volatility, avg(consistency_pct) AS consistency FROM dt GROUP BY 1, 2) m USING (entity_id, position)
  JOIN (SELECT *, CASE WHEN regime_stability >= 80 THEN 'HIGH' WHEN regime_stability >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS regime_level FROM (SELECT entity_id, position, count(*) FILTER (transition = 'UNCHANGED') * 100.0 / count(*) AS regime_stability FROM rt GROUP BY 1, 2)
    JOIN (SELECT entity_id, position, CASE WHEN a >= b AND a >= d THEN 'CONCENTRATED' WHEN b >= d THEN 'BALANCED' ELSE 'DIVERSE' END AS dominant_regime FROM (SELECT entity_id, position, count(*) FILTER (regime = 'CONCENTRATED') AS a, count(*) FILTER (regime = 'BALANCED') AS b, count(*) FILTER (regime = 'DIVERSE') AS d FROM rg GROUP BY 1, 2)) USING (entity_id, position)) s USING (entity_id, position))"""
PCTES = (FREQ, WIN, chg(), trends(), LSTEP, LA, RG, PROF)
NUM = [m for m in TP.NUMERIC if m not in ("n_obs", "n_changes")]
register(
    "l06_behaviour_profiles", lambda t: profiles(t),
    q(f"SELECT entity_id, position, n_obs, n_changes, {', '.join(r(m, m) for m in NUM)}, regime_level, dominant_regime, volatility_level, consistency_level FROM pf", *PCTES),
)
register(
    "l07_profile_summary", lambda t: TP.profile_summary(profiles(t)),
    q(f"SELECT entity_id, count(*) AS n_profiles, CAST(sum(n_obs) AS BIGINT) AS total_obs, CAST(sum(n_changes) AS BIGINT) AS total_changes, {', '.join(r(f'avg({m})', f'average_{m}') for m in NUM)}, "
      + ", ".join(f"count(*) FILTER ({k}_level = '{x}') AS n_{k}_{x.lower()}" for k in ("volatility", "consistency") for x in ("LOW", "MEDIUM", "HIGH")) + " FROM pf GROUP BY 1", *PCTES),
)
MROWS = "mr AS (" + " UNION ALL ".join(
    [f"SELECT entity_id, position, '{m}' AS metric, CAST({m} AS DOUBLE) AS number, NULL AS label FROM pf" for m in TP.NUMERIC]
    + [f"SELECT entity_id, position, '{m}', NULL, {m} FROM pf" for m in TP.CATEGORICAL]) + ")"
register(
    "l08_profile_comparison", lambda t: TP.profile_comparison(profiles(t)),
    q(f"SELECT a.entity_id, a.metric, a.position AS position_a, b.position AS position_b, {r('a.number', 'number_a')}, {r('b.number', 'number_b')}, a.label AS label_a, b.label AS label_b, {r('b.number - a.number', 'difference')}, {r('abs(b.number - a.number)', 'abs_difference')}, a.label = b.label AS same_label FROM mr a JOIN mr b ON a.entity_id = b.entity_id AND a.metric = b.metric AND a.position < b.position", *PCTES, MROWS),
)
register(
    "l09_profile_distribution", lambda t: TP.profile_distribution(profiles(t)),
    q(f"SELECT metric, label, count(*) AS n, {r('avg(number)', 'mean')}, {r('min(number)', 'min')}, {r('max(number)', 'max')}, {r('stddev_pop(number)', 'std')} FROM mr GROUP BY 1, 2", *PCTES, MROWS),
)
RANKED = ("entropy_bits", "n_changes", "regime_stability")
register(
    "l09_profile_ranking", lambda t: TP.profile_ranking(profiles(t), RANKED),
    q(f"SELECT entity_id, position, metric, {r('number', 'number')}, CAST(rank() OVER (PARTITION BY entity_id, metric ORDER BY number DESC) AS INTEGER) AS rank FROM mr WHERE metric IN {RANKED}", *PCTES, MROWS),
)


def consolidated(t):
    return TP.consolidate(
        {
            "frequency": A.describe(t.long, ["entity_id", "position"]).select("entity_id", "position", "n_obs", "mean", "entropy_bits"),
            "temporal": TP.temporal_analysis(t.long).select("entity_id", "position", "n_changes", "mean_abs_step"),
            "regime": R.regime_stability(R.regime_windows(t.long.where("position <> 'p8' or entity_id % 3 <> 0"))).select("entity_id", "position", "stability_pct"),
        }
    )


CMETRICS = ("frequency_n_obs", "frequency_mean", "temporal_mean_abs_step", "regime_stability_pct")
CO = """co AS (SELECT la.entity_id, la.position, la.n_obs AS frequency_n_obs, la.mean AS frequency_mean, e AS frequency_entropy_bits, la.n_changes AS temporal_n_changes, la.mean_abs_step AS temporal_mean_abs_step, g.s AS regime_stability_pct, g.s IS NOT NULL AS has_regime
  FROM la JOIN (SELECT entity_id, position, -sum(CASE WHEN n > 0 THEN n / n_obs * log2(n / n_obs) ELSE 0 END) AS e FROM freq GROUP BY 1, 2) USING (entity_id, position)
  LEFT JOIN (SELECT entity_id, position, count(*) FILTER (transition = 'UNCHANGED') * 100.0 / count(*) AS s FROM rt WHERE position <> 'p8' OR entity_id % 3 <> 0 GROUP BY 1, 2) g USING (entity_id, position))"""
register(
    "l10_consolidation", lambda t: consolidated(t),
    q(f"SELECT entity_id, position, true AS has_frequency, true AS has_temporal, has_regime, frequency_n_obs, {r('frequency_mean', 'frequency_mean')}, {r('frequency_entropy_bits', 'frequency_entropy_bits')}, temporal_n_changes, {r('temporal_mean_abs_step', 'temporal_mean_abs_step')}, {r('regime_stability_pct', 'regime_stability_pct')} FROM co", FREQ, LSTEP, LA, RG, CO),
)
register(
    "l10_consolidated_summary", lambda t: TP.consolidated_summary(consolidated(t), CMETRICS),
    q("SELECT entity_id, count(*) AS n_positions, " + ", ".join(f"{r(f'sum(coalesce({m}, 0))', f'total_{m}')}, {r(f'avg(coalesce({m}, 0))', f'average_{m}')}" for m in CMETRICS) + " FROM co GROUP BY 1", FREQ, LSTEP, LA, RG, CO),
)
register(
    "l10_position_comparison", lambda t: TP.position_comparison(consolidated(t), CMETRICS),
    q(" UNION ALL ".join(f"SELECT a.entity_id, a.position AS position_a, b.position AS position_b, '{m}' AS metric, {r(f'coalesce(a.{m}, 0)', 'value_a')}, {r(f'coalesce(b.{m}, 0)', 'value_b')}, {r(f'coalesce(a.{m}, 0)::DOUBLE - coalesce(b.{m}, 0)::DOUBLE', 'difference')} FROM co a JOIN co b ON a.entity_id = b.entity_id AND a.position < b.position" for m in CMETRICS), FREQ, LSTEP, LA, RG, CO),
)
COMP = "cc AS (SELECT entity_id, unnest(['frequency', 'temporal', 'regime']) AS component, unnest([count(*), count(*), count(*) FILTER (has_regime)]) AS n_present FROM co GROUP BY 1),\nck AS (SELECT *, 8 AS n_expected, greatest(8 - n_present, 0) AS n_missing, CASE WHEN n_present = 0 THEN 'MISSING_COMPONENT' WHEN n_present <> 8 THEN 'POSITION_COUNT_MISMATCH' ELSE 'NONE' END AS issue FROM cc)"
register(
    "l11_completeness", lambda t: TP.completeness(consolidated(t), ("frequency", "temporal", "regime")),
    q("SELECT * FROM ck", FREQ, LSTEP, LA, RG, CO, COMP),
)
register(
    "l11_completeness_summary", lambda t: TP.completeness_summary(TP.completeness(consolidated(t), ("frequency", "temporal", "regime"))),
    q(f"SELECT entity_id, count(*) AS n_components, count(*) FILTER (issue = 'NONE') AS n_complete, CAST(sum(n_missing) AS BIGINT) AS n_missing, {r('''count(*) FILTER (issue = 'NONE') * 100.0 / count(*)''', 'completeness_pct')} FROM ck GROUP BY 1", FREQ, LSTEP, LA, RG, CO, COMP),
)

# -- M relations and regimes --------------------------------------------------

RSIZE = 20


def corr_cte(name: str, keys: str, src: str) -> str:
    k = f"{keys}, " if keys else ""
    return f"""{name} AS (SELECT *, CASE WHEN correlation IS NULL THEN 'INSUFFICIENT_DATA' WHEN correlation > 0 THEN 'POSITIVE' WHEN correlation < 0 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS direction,
  CASE WHEN correlation IS NULL THEN 'INSUFFICIENT_DATA' WHEN correlation = 0 THEN 'NONE' WHEN abs(correlation) < 0.3 THEN 'WEAK' WHEN abs(correlation) < 0.7 THEN 'MODERATE' ELSE 'STRONG' END AS strength FROM (
  SELECT {k}position_a, position_b, CAST(n AS BIGINT) AS n_pairs, CASE WHEN n >= 2 THEN (n * ab - sa * sb) / (n * n) END AS covariance,
  CASE WHEN n >= 2 THEN (n * ab - sa * sb) / nullif(sqrt((n * aa - sa * sa) * (n * bb - sb * sb)), 0) END AS correlation FROM (
  SELECT {k}position_a, position_b, count(*)::DOUBLE AS n, sum(a)::DOUBLE AS sa, sum(b)::DOUBLE AS sb, sum(a * b)::DOUBLE AS ab, sum(a * a)::DOUBLE AS aa, sum(b * b)::DOUBLE AS bb FROM {src} GROUP BY ALL)))"""


PROWS = f"""pr AS (SELECT x.entity_id, x.window_index, x.position AS position_a, y.position AS position_b, x.value AS a, y.value AS b FROM (SELECT *, CAST((row_number() OVER {S}) - 1) // {RSIZE} + 1 AS INTEGER) AS window_index FROM longs) x
  JOIN longs y ON x.entity_id = y.entity_id AND x.obs_date = y.obs_date AND x.position < y.position)"""
register(
    "m01_pair_relations", lambda t: R.pair_relations(t.obs, ["entity_id"]),
    q(f"SELECT entity_id, position_a, position_b, n_pairs, {r('covariance', 'covariance')}, {r('correlation', 'correlation')}, direction, strength FROM rel", PROWS, corr_cte("rel", "entity_id", "pr")),
)
RW = (PROWS, corr_cte("rel", "entity_id, window_index", "pr"))
VALID = """vl AS (SELECT *, lag(direction) OVER w AS pd, lag(strength) OVER w AS ps FROM rel WHERE direction <> 'INSUFFICIENT_DATA' WINDOW w AS (PARTITION BY entity_id, position_a, position_b ORDER BY window_index)),
rs AS (SELECT *, CASE WHEN n_valid < 2 THEN 'INSUFFICIENT_DATA' WHEN direction_consistency >= 80 THEN 'HIGH' WHEN direction_consistency >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS stability_level FROM (
  SELECT entity_id, position_a, position_b, n_windows, coalesce(n_valid, 0) AS n_valid, coalesce(dc, 0) AS direction_changes, coalesce(sc, 0) AS strength_changes,
  CASE WHEN n_valid >= 2 THEN (n_valid - 1 - dc) * 100.0 / (n_valid - 1) ELSE 0 END AS direction_consistency, CASE WHEN n_valid >= 2 THEN (n_valid - 1 - sc) * 100.0 / (n_valid - 1) ELSE 0 END AS strength_consistency
  FROM (SELECT entity_id, position_a, position_b, count(*) AS n_windows FROM rel GROUP BY 1, 2, 3) LEFT JOIN (
  SELECT entity_id, position_a, position_b, count(*) AS n_valid, count(*) FILTER (pd <> direction) AS dc, count(*) FILTER (ps <> strength) AS sc FROM vl GROUP BY 1, 2, 3) USING (entity_id, position_a, position_b)))"""
register(
    "m02_relation_stability", lambda t: R.relation_stability(R.relation_windows(t.obs, RSIZE)),
    q(f"SELECT entity_id, position_a, position_b, n_windows, n_valid, direction_changes, strength_changes, {r('direction_consistency', 'direction_consistency')}, {r('strength_consistency', 'strength_consistency')}, stability_level FROM rs", *RW, VALID),
)
RC = """rc AS (SELECT *, correlation - previous_correlation AS correlation_change, abs(correlation) - abs(previous_correlation) AS abs_correlation_change, direction <> previous_direction AS direction_changed, strength <> previous_strength AS strength_changed,
  direction <> previous_direction OR strength <> previous_strength OR coalesce(correlation - previous_correlation <> 0, false) AS relation_changed FROM (
  SELECT *, lag(window_index) OVER w AS previous_window_index, lag(correlation) OVER w AS previous_correlation, lag(direction) OVER w AS previous_direction, lag(strength) OVER w AS previous_strength FROM rel
  WINDOW w AS (PARTITION BY entity_id, position_a, position_b ORDER BY window_index)) WHERE previous_window_index IS NOT NULL)"""
register(
    "m03_relation_changes", lambda t: R.relation_changes(R.relation_windows(t.obs, RSIZE)).drop("covariance", "n_pairs"),
    q(f"SELECT entity_id, window_index, position_a, position_b, previous_window_index, {r('correlation', 'correlation')}, {r('previous_correlation', 'previous_correlation')}, direction, previous_direction, strength, previous_strength, {r('correlation_change', 'correlation_change')}, {r('abs_correlation_change', 'abs_correlation_change')}, direction_changed, strength_changed, relation_changed FROM rc", *RW, RC),
)
register(
    "f23_relation_change_trend", lambda t: R.relation_change_trend(R.relation_windows(t.obs, RSIZE)),
    q(f"SELECT entity_id, position_a, position_b, n AS n_comparisons, {r('x.correlation', 'correlation')}, {r('x.previous_correlation', 'previous_correlation')}, {r('x.correlation_change', 'correlation_change')}, x.relation_changed AS relation_changed, CASE WHEN x.correlation_change > 0 THEN 'INCREASING' WHEN x.correlation_change < 0 THEN 'DECREASING' WHEN x.correlation_change = 0 THEN 'STABLE' END AS trend FROM (SELECT entity_id, position_a, position_b, count(*) AS n, arg_max(rc, window_index) AS x FROM rc GROUP BY 1, 2, 3)", *RW, RC),
)
register(
    "m04_relation_summary", lambda t: R.relation_summary(R.pair_relations(t.obs, ["entity_id"]), ["entity_id"]),
    q("SELECT entity_id, p AS position, count(*) AS n_relations, CAST(sum(n_pairs) AS BIGINT) AS total_pairs, " + ", ".join(f"count(*) FILTER (direction = '{d}') AS n_{d.lower()}" for d in R.DIRECTIONS) + ", " + ", ".join(f"count(*) FILTER (strength = '{s}') AS n_{s.lower()}" for s in R.STRENGTHS)
      + f", {r('avg(correlation)', 'mean_correlation')}, {r('avg(abs(correlation))', 'mean_abs_correlation')}, {r('min(correlation)', 'min_correlation')}, {r('max(correlation)', 'max_correlation')} FROM (SELECT *, unnest([position_a, position_b, NULL]) AS p FROM rel) GROUP BY 1, 2", PROWS, corr_cte("rel", "entity_id", "pr")),
)
register(
    "m04_relation_overview",
    lambda t: (lambda w: R.relation_overview(R.pair_relations(t.obs, ["entity_id"]), R.relation_stability(w), R.relation_changes(w)))(R.relation_windows(t.obs, RSIZE)),
    q(f"SELECT entity_id, position_a, position_b, {r('a.correlation', 'correlation')}, a.direction AS direction, a.strength AS strength, rs.n_windows, rs.n_valid, {r('rs.direction_consistency', 'direction_consistency')}, rs.stability_level, c.n_comparisons, c.n_direction_changed, c.n_strength_changed, c.n_relation_changed FROM al a JOIN rs USING (entity_id, position_a, position_b) JOIN (SELECT entity_id, position_a, position_b, count(*) AS n_comparisons, count(*) FILTER (direction_changed) AS n_direction_changed, count(*) FILTER (strength_changed) AS n_strength_changed, count(*) FILTER (relation_changed) AS n_relation_changed FROM rc GROUP BY 1, 2, 3) c USING (entity_id, position_a, position_b)",
      *RW, corr_cte("al", "entity_id", "pr"), VALID, RC),
)
register(
    "m05_regime_windows", lambda t: R.regime_windows(t.long),
    q(f"SELECT entity_id, position, window_index, {day('start_date')}, {day('end_date')}, n_obs, {r('mean', 'mean')}, {r('std', 'std')}, dominant_digit, {r('dominant_pct', 'dominant_pct')}, {r('entropy', 'entropy')}, regime FROM rg", RG),
)
register("m06_regime_transitions", lambda t: R.regime_transitions(R.regime_windows(t.long)), q("SELECT * FROM rt", RG))
register(
    "m07_regime_stability", lambda t: R.regime_stability(R.regime_windows(t.long)),
    q(f"SELECT entity_id, position, n_windows, n_windows AS n_valid, a AS n_transition, b AS n_unchanged, CAST(0 AS BIGINT) AS n_missing, {r('b * 100.0 / (a + b)', 'stability_pct')}, CASE WHEN b * 100.0 / (a + b) >= 80 THEN 'HIGH' WHEN b * 100.0 / (a + b) >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS stability_level FROM (SELECT entity_id, position, count(*) AS n_windows FROM rg GROUP BY 1, 2) JOIN (SELECT entity_id, position, count(*) FILTER (transition = 'TRANSITION') AS a, count(*) FILTER (transition = 'UNCHANGED') AS b FROM rt GROUP BY 1, 2) USING (entity_id, position)", RG),
)
register(
    "m08_regime_summary", lambda t: R.regime_summary(R.regime_windows(t.long)),
    q("SELECT entity_id, position, count(*) AS n_windows, " + ", ".join(f"count(*) FILTER (regime = '{x}') AS n_{x.lower()}" for x in R.REGIMES) + f", {r('avg(dominant_pct)', 'mean_dominant_pct')}, {r('avg(entropy)', 'mean_entropy')} FROM rg GROUP BY 1, 2", RG),
)
register(
    "m08_regime_flow", lambda t: R.regime_flow(R.regime_windows(t.long)),
    q("SELECT position, previous_regime, regime, count(*) AS n FROM rt GROUP BY GROUPING SETS ((position, previous_regime, regime), (previous_regime, regime))", RG),
)
