"""Point-in-time window features (F)."""

from pyspark.sql import functions as F

from obsframe import layout as L
from obsframe.operators import families as fam
from obsframe.operators import windows as W
from obsframe.plans.catalog import DIMS, ORACLES, day, doubles, ints, list_texts, per_digit, q, r, register
from obsframe.plans.observations import PRIOR

E = "(PARTITION BY entity_id ORDER BY obs_date"
S = "(PARTITION BY entity_id, position ORDER BY obs_date"


def back(n: int) -> str:
    return f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING"


ID = f"entity_id, {day('obs_date')}"

register(
    "f01_lags", lambda t: W.lag_features(t.obs),
    q(f"SELECT {ID}, " + ", ".join(f"lag({p}, {k}) OVER w AS {p}_lag_{k}" for p in L.POSITIONS for k in L.LAGS) + f" FROM obs WINDOW w AS {E})"),
)
register(
    "f02_rolling_statistics", lambda t: W.rolling_features(t.obs),
    q(f"SELECT {ID}, " + ", ".join(f"count(*) OVER {E} {back(n)}) AS rows_{n}" for n in L.ROLLING_WINDOWS) + ", " + ", ".join(
        f"{r(f'avg({p}) OVER {E} {back(n)})', f'{p}_mean_{n}')}, min({p}) OVER {E} {back(n)}) AS {p}_min_{n}, max({p}) OVER {E} {back(n)}) AS {p}_max_{n}"
        for p in L.POSITIONS for n in L.ROLLING_WINDOWS) + " FROM obs"),
)


def counts(n: int) -> str:
    return per_digit(f"count(*) FILTER (value = {{d}}) OVER {S} {back(n)})")


def freq_cte(windows) -> str:
    return "fc AS (SELECT *, " + ", ".join(
        f"{counts(n)} AS c{n}, CAST(count(*) OVER {S} {back(n)}) AS INTEGER) AS rows_{n}" for n in windows
    ) + " FROM longs)"


def pct(n: int) -> str:
    return f"list_transform(c{n}, lambda v: coalesce(v * 100.0::DOUBLE / nullif(rows_{n}, 0), 0))"


register(
    "f03_rolling_digit_frequency", lambda t: W.frequency_features(t.long, form=list_texts),
    q(f"SELECT {ID}, position, rows_5, {ints('c5', 'counts_5')}, {doubles(pct(5), 'pct_5')} FROM fc", freq_cte((5,))),
)
register(
    "f04_frequency_windows", lambda t: W.frequency_features(t.long, L.FREQUENCY_WINDOWS, form=list_texts),
    q(f"SELECT {ID}, position, " + ", ".join(f"rows_{n}, {ints(f'c{n}', f'counts_{n}')}, {doubles(pct(n), f'pct_{n}')}" for n in L.FREQUENCY_WINDOWS) + " FROM fc", freq_cte(L.FREQUENCY_WINDOWS)),
)
register(
    "f05_rolling_frequency_pct", lambda t: W.frequency_features(t.long, L.FREQUENCY_WINDOWS, counts=False, form=list_texts),
    q(f"SELECT {ID}, position, " + ", ".join(f"rows_{n}, {doubles(pct(n), f'pct_{n}')}" for n in L.FREQUENCY_WINDOWS) + " FROM fc", freq_cte(L.FREQUENCY_WINDOWS)),
)
PAIRS = ((3, 3), (5, 5), (10, 3), (20, 5))
register(
    "f06_frequency_change", lambda t: W.frequency_change(t.long, PAIRS),
    q(f"SELECT {ID}, position, " + ", ".join(
        doubles(f"list_transform(list_zip({pct(a)}, {pct(b)}), lambda z: z[1] - z[2])", f"change_{a}_{b}") for a, b in PAIRS) + " FROM fc", freq_cte((3, 5, 10, 20))),
)
CONC = ", ".join(
    f"CASE WHEN rows_{n} > 0 THEN CAST(list_position(c{n}, list_max(c{n})) - 1 AS INTEGER) END AS dominant_{n}, {r(f'list_max(c{n}) * 100.0 / nullif(rows_{n}, 0)', f'dominant_pct_{n}')}, "
    f"{r(f'e{n}', f'entropy_{n}')}, {r(f'e{n} / log2(10)', f'norm_entropy_{n}')}, "
    f"CASE WHEN rows_{n} = 0 THEN 'INSUFFICIENT_DATA' WHEN list_max(c{n}) * 100.0 / rows_{n} >= 60 THEN 'CONCENTRATED' WHEN e{n} >= 2.75 THEN 'DIVERSE' ELSE 'BALANCED' END AS regime_{n}"
    for n in L.FREQUENCY_WINDOWS)
register(
    "f07_concentration_regime", lambda t: W.concentration_features(t.long),
    q(f"SELECT {ID}, position, {CONC} FROM ec", freq_cte(L.FREQUENCY_WINDOWS),
      "ec AS (SELECT *, " + ", ".join(
          f"CASE WHEN rows_{n} > 0 THEN list_sum(list_transform(c{n}, lambda v: CASE WHEN v > 0 THEN -(v / rows_{n}) * log2(v / rows_{n}) ELSE 0 END)) END AS e{n}" for n in L.FREQUENCY_WINDOWS) + " FROM fc)"),
)
SEEN = ("rn AS (SELECT *, CAST(row_number() OVER " + S + ") AS INTEGER) AS rn FROM longs),\nseen AS (SELECT *, "
        + per_digit(f"rn - 1 - max(CASE WHEN value = {{d}} THEN rn END) OVER {S} {PRIOR})") + " AS dist FROM rn)")
within = lambda n: f"list_transform(dist, lambda v: CASE WHEN v < {n} THEN v END)"
register(
    "f08_recency", lambda t: W.recency_features(t.long),
    q(f"SELECT {ID}, position, {ints(within(10), 'recency')}, {ints('list_transform(dist, lambda v: CAST(coalesce(v < 10, false) AS INTEGER))', 'seen')} FROM seen", SEEN),
)
register(
    "f09_recency_expansion", lambda t: W.recency_expansion(t.long, form=list_texts),
    q(f"SELECT {ID}, position, " + ", ".join(
        f"{ints(f'c{n}', f'count_{n}')}, {doubles(f'list_transform(c{n}, lambda v: v / {float(n)}::DOUBLE)', f'rate_{n}')}, {ints(within(n), f'last_{n}')}, {ints(f'list_transform(c{n}, lambda v: CAST(v > 0 AS INTEGER))', f'seen_{n}')}"
        for n in L.RECENCY_LOOKBACKS) + " FROM seen2", SEEN,
      "seen2 AS (SELECT *, " + ", ".join(f"{counts(n)} AS c{n}" for n in L.RECENCY_LOOKBACKS) + " FROM seen)"),
)
DIST = {
    "mean": "avg(rn::DOUBLE)", "lo": "min(rn)", "hi": "max(rn)", "std": "stddev_pop(rn::DOUBLE)", "n": "count(*)",
}
register(
    "f10_recency_distribution", lambda t: W.recency_distribution(t.long, form=list_texts),
    q(f"SELECT {ID}, position, {ints('dn', 'count')}, {doubles('list_transform(dn, lambda v: v / 10.0::DOUBLE)', 'rate')}, {doubles('list_transform(dmean, lambda v: rn - 1 - v)', 'mean')}, "
      f"{ints('list_transform(dhi, lambda v: rn - 1 - v)', 'min')}, {ints('list_transform(dlo, lambda v: rn - 1 - v)', 'max')}, {doubles('dstd', 'std')}, "
      f"{ints('list_transform(list_zip(dhi, dlo), lambda z: z[1] - z[2])', 'span')} FROM dd", SEEN,
      "dd AS (SELECT *, " + ", ".join(per_digit(f"{e} FILTER (value = {{d}}) OVER {S} {back(10)})") + f" AS d{k}" for k, e in DIST.items()) + " FROM rn)"),
)
BUCKET = "CASE WHEN v IS NULL THEN 4 WHEN v <= 3 THEN 0 WHEN v <= 7 THEN 1 WHEN v <= 14 THEN 2 ELSE 3 END"
register(
    "f11_recency_buckets", lambda t: W.recency_buckets(t.long),
    q(f"SELECT {ID}, position, {ints('b', 'bucket')}, {ints('''list_transform(b, lambda v: ['RECENT_0_3', 'RECENT_4_7', 'RECENT_8_14', 'STALE_15_PLUS', 'UNSEEN'][v + 1])''', 'label')}, "
      + ", ".join(ints(f"list_transform(b, lambda v: CAST(v = {k} AS INTEGER))", f"is_{k}") for k in range(5))
      + f" FROM (SELECT *, list_transform(dist, lambda v: {BUCKET}) AS b FROM seen)", SEEN),
)
register(
    "f12_last_change", lambda t: W.change_features(t.obs),
    q(f"SELECT {ID}, " + ", ".join(
        f"c_{p} AS {p}_change, abs(c_{p}) AS {p}_abs_change, CASE WHEN c_{p} > 0 THEN 'INCREASE' WHEN c_{p} < 0 THEN 'DECREASE' WHEN c_{p} = 0 THEN 'UNCHANGED' END AS {p}_direction, CAST(c_{p} <> 0 AS INTEGER) AS {p}_changed" for p in L.POSITIONS)
      + " FROM (SELECT entity_id, obs_date, " + ", ".join(f"lag({p}, 1) OVER w - lag({p}, 2) OVER w AS c_{p}" for p in L.POSITIONS) + f" FROM obs WINDOW w AS {E}))"),
)


def trend_sql(p: str, n: int) -> str:
    w = f"OVER {E} {back(n)})"
    enough = f"count(*) {w} >= 2"
    return (f"{r(f'avg({p}) {w}', f'{p}_mean_{n}')}, min({p}) {w} AS {p}_min_{n}, max({p}) {w} AS {p}_max_{n}, max({p}) {w} - min({p}) {w} AS {p}_range_{n}, "
            f"{r(f'stddev_pop({p}) {w}', f'{p}_std_{n}')}, CASE WHEN {enough} THEN last_value({p}) {w} - first_value({p}) {w} END AS {p}_net_{n}, "
            f"{r(f'CASE WHEN {enough} THEN regr_slope({p}, rn) {w} END', f'{p}_slope_{n}')}")


register(
    "f13_window_trends", lambda t: W.trend_features(t.obs),
    q(f"SELECT {ID}, " + ", ".join(trend_sql(p, n) for p in L.POSITIONS for n in L.TREND_WINDOWS)
      + f" FROM (SELECT *, CAST(row_number() OVER {E}) AS DOUBLE) AS rn FROM obs)"),
)
GAPS = f"gaps AS (SELECT entity_id, obs_date, CAST(date_diff('day', lag(obs_date) OVER {E}), obs_date) AS INTEGER) AS gap, lag(obs_date) OVER {E}) AS prev, min(obs_date) OVER {E} {PRIOR}) AS first FROM obs)"
register(
    "f14_interval_features", lambda t: W.interval_features(t.obs),
    q(f"""SELECT {ID}, gap AS days_since_last, CAST(date_diff('day', first, obs_date) AS INTEGER) AS days_since_first, CAST(date_diff('day', first, prev) AS INTEGER) AS span_days,
      count(gap) OVER {E} {PRIOR}) AS n_gaps, {r(f'avg(gap) OVER {E} {PRIOR})', 'mean_gap')}, min(gap) OVER {E} {PRIOR}) AS min_gap, max(gap) OVER {E} {PRIOR}) AS max_gap,
      {r(f'stddev_pop(gap) OVER {E} {PRIOR})', 'std_gap')} FROM gaps""", GAPS),
)
RANGE = "(PARTITION BY entity_id ORDER BY obs_date RANGE BETWEEN INTERVAL {n} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"
register(
    "f15_observation_density", lambda t: W.density_features(t.obs),
    q(f"SELECT {ID}, " + ", ".join(f"count(*) OVER {RANGE.replace('{n}', str(n))} AS count_{n}, {r(f'''count(*) OVER {RANGE.replace('{n}', str(n))} / {float(n)}''', f'rate_{n}')}" for n in L.DENSITY_DAYS)
      + f""", nullif(count(*) OVER {E} {PRIOR}), 0) AS total_count, CAST(date_diff('day', first, prev) AS INTEGER) AS span_days, {r(f"count(*) OVER {E} {PRIOR}) / nullif(date_diff('day', first, prev), 0)", 'density_rate')},
      {r(f'avg(gap) OVER {E} {PRIOR})', 'average_interval')}, {r(f'stddev_pop(gap) OVER {E} {PRIOR})', 'interval_std')} FROM gaps""", GAPS),
)
register(
    "f16_sequence_features", lambda t: W.sequence_features(t.long),
    q(f"""SELECT {ID}, position, b AS previous, a AS latest, b || '_to_' || a AS transition, abs(a - b) AS distance, CAST(a <> b AS INTEGER) AS changed,
      CASE WHEN b IS NULL THEN 0 WHEN c IS NOT NULL AND c = b AND b = a THEN 2 ELSE 1 END AS transition_count,
      {r('CASE WHEN b IS NULL THEN 0 WHEN c IS NULL THEN 100 WHEN c = b AND b = a THEN 100 ELSE 50 END', 'transition_pct')}
      FROM (SELECT *, lag(value, 1) OVER w AS a, lag(value, 2) OVER w AS b, lag(value, 3) OVER w AS c FROM longs WINDOW w AS {S}))"""),
)
TRANS = f"tr AS (SELECT entity_id, obs_date, position, lag(value) OVER {S}) AS from_value, value AS to_value FROM longs), tn AS (SELECT * FROM tr WHERE from_value IS NOT NULL)"
register(
    "f17_position_transitions", lambda t: W.position_transitions(t.long),
    q(f"SELECT {ID}, position, from_value, to_value FROM tn", TRANS),
)
TC = "tc AS (SELECT entity_id, position, from_value, to_value, count(*) AS n FROM tn GROUP BY 1, 2, 3, 4)"
register(
    "f18_transition_frequency", lambda t: W.transition_frequency(t.long),
    q(f"SELECT entity_id, position, from_value, to_value, n, {r('n * 100.0 / sum(n) OVER (PARTITION BY entity_id, position)', 'pct')} FROM tc", TRANS, TC),
)
register(
    "f18_prior_transition_counts", lambda t: W.prior_transition_counts(t.long),
    q(f"SELECT {ID}, position, from_value, to_value, count(*) OVER (PARTITION BY entity_id, position, from_value, to_value ORDER BY obs_date {PRIOR}) AS n_before FROM tn", TRANS),
)
register(
    "f19_transition_stability", lambda t: W.transition_stability(t.long),
    q(f"""SELECT entity_id, position, CAST(total AS BIGINT) AS n_transitions, from_value AS dominant_from, to_value AS dominant_to, n AS dominant_count, CAST(total - n AS BIGINT) AS n_changes, {r('n * 100.0 / total', 'stability_pct')} FROM (
      SELECT *, sum(n) OVER (PARTITION BY entity_id, position) AS total, row_number() OVER (PARTITION BY entity_id, position ORDER BY n DESC, from_value, to_value) AS k FROM tc) WHERE k = 1""", TRANS, TC),
)
register(
    "f20_family_transitions", lambda t: fam.family_transitions(fam.family_rows(t.obs, t.dims)),
    q(f"SELECT {ID}, code_group, pf AS previous_family, family_name, pf <> family_name AS changed FROM (SELECT *, lag(family_name) OVER (PARTITION BY entity_id, code_group ORDER BY obs_date) AS pf FROM family_rows) WHERE pf IS NOT NULL AND family_name IS NOT NULL", DIMS),
)


def universe(t):
    return t.dims["tail"].select(F.lit("tail").alias("code_group"), "family_name").unionByName(
        t.dims["head"].select(F.lit("head").alias("code_group"), "family_name")
    ).distinct()


def tail_head_rows(t):
    return fam.family_rows(t.obs, {k: t.dims[k] for k in ("head", "tail")})


UNI = """uni AS (SELECT DISTINCT 'tail' AS code_group, family_name FROM tail_member WHERE family_active UNION ALL SELECT DISTINCT 'head', family_name FROM head_member),
spread AS (SELECT f.entity_id, f.obs_date, f.code_group, u.family_name, coalesce(f.family_name = u.family_name, false) AS hit, f.family_name IS NOT NULL AS mapped,
  CAST(row_number() OVER (PARTITION BY entity_id, code_group, u.family_name ORDER BY obs_date) AS INTEGER) AS rn FROM family_rows f JOIN uni u USING (code_group))"""
G = "(PARTITION BY entity_id, code_group, family_name ORDER BY obs_date"
register(
    "f21_family_frequency", lambda t: fam.family_window_rates(tail_head_rows(t), universe(t)),
    q(f"SELECT {ID}, code_group, family_name, " + ", ".join(
        f"CAST(count(*) FILTER (hit) OVER {G} {back(n)}) AS INTEGER) AS n_{n}, {r(f'coalesce(count(*) FILTER (hit) OVER {G} {back(n)}) * 100.0 / nullif(count(*) FILTER (mapped) OVER {G} {back(n)}), 0), 0)', f'pct_{n}')}"
        for n in L.FREQUENCY_WINDOWS) + " FROM spread", DIMS, UNI),
)
register(
    "f22_family_recency", lambda t: fam.family_recency(tail_head_rows(t), universe(t)),
    q(f"SELECT {ID}, code_group, family_name, rec AS recency, coalesce(rec < 10, false) AS seen_within FROM (SELECT *, rn - 1 - max(CASE WHEN hit THEN rn END) OVER {G} {PRIOR}) AS rec FROM spread)", DIMS, UNI),
)


def all_universe(t):
    return universe(t).unionByName(t.dims["pair"].select(F.lit("pair").alias("code_group"), "family_name").distinct())


# f21 and f22 over all three code groups; the pair families are those of the whole code domain.
UNI_ALL = """pair_uni AS (SELECT DISTINCT 'pair-' || least(a.range, b.range) || greatest(a.range, b.range) AS family_name FROM range(10) a, range(10) b WHERE (a.range + b.range) % 5 <> 4),
""" + UNI.replace("FROM head_member),", "FROM head_member UNION ALL SELECT 'pair', family_name FROM pair_uni),", 1)
register(
    "f21_family_frequency_all_groups", lambda t: fam.family_window_rates(fam.family_rows(t.obs, t.dims), all_universe(t)),
    ORACLES["f21_family_frequency"].replace(UNI, UNI_ALL),
)
register(
    "f22_family_recency_all_groups", lambda t: fam.family_recency(fam.family_rows(t.obs, t.dims), all_universe(t)),
    ORACLES["f22_family_recency"].replace(UNI, UNI_ALL),
)
register(
    "f24_rolling_rates", lambda t: W.rolling_rates(t.long),
    q(f"SELECT {ID}, position, " + ", ".join(
        doubles(f"list_transform(c{n}, lambda v: round(coalesce(v / nullif(rows_{n}, 0)::DOUBLE, 0), 8))", f"rate_{n}") for n in (3, 7, 14)) + " FROM fc", freq_cte((3, 7, 14))),
)
register(
    "f26_competition_rank",
    lambda t: W.competition_rank(t.long.groupBy("entity_id", "position").agg(F.count_if(F.col("value") == 0).alias("zeros")), "zeros", ["position"]),
    q("SELECT entity_id, position, n AS zeros, CAST(rank() OVER (PARTITION BY position ORDER BY n DESC) AS INTEGER) AS rank FROM (SELECT entity_id, position, count(*) FILTER (value = 0) AS n FROM longs GROUP BY 1, 2)"),
)
register(
    "f27_unique_rank",
    lambda t: W.unique_rank(t.long.groupBy("entity_id", "position", "value").agg(F.count("*").alias("n")), "n", "value", ["entity_id", "position"]),
    q("SELECT entity_id, position, value, n, CAST(row_number() OVER (PARTITION BY entity_id, position ORDER BY n DESC, value) AS INTEGER) AS rank FROM (SELECT entity_id, position, value, count(*) AS n FROM longs GROUP BY 1, 2, 3)"),
)


def moves(t):
    from obsframe.functions.stats import direction
    from obsframe.operators.scans import history

    change = F.col("value") - F.lag("value").over(history(*W.SERIES))
    return t.long.withColumn("direction", direction(change, "INCREASING", "DECREASING", "UNCHANGED")).where("direction is not null")


MOVES = f"""mv AS (SELECT * FROM (SELECT *, CASE WHEN value > pv THEN 'INCREASING' WHEN value < pv THEN 'DECREASING' WHEN value = pv THEN 'UNCHANGED' END AS direction FROM (
  SELECT *, lag(value) OVER {S}) AS pv FROM longs)) WHERE direction IS NOT NULL)"""
register(
    "f28_direction_streaks", lambda t: W.direction_streaks(moves(t), W.SERIES, "obs_date", "direction"),
    q(f"""SELECT entity_id, position, max_streak, n_switches FROM (SELECT entity_id, position, max(n) AS max_streak FROM (SELECT entity_id, position, direction, g, count(*) AS n FROM (
      SELECT *, row_number() OVER {S}) - row_number() OVER (PARTITION BY entity_id, position, direction ORDER BY obs_date) AS g FROM mv) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2)
      JOIN (SELECT entity_id, position, count(*) FILTER (pd <> direction AND pd <> 'UNCHANGED' AND direction <> 'UNCHANGED') AS n_switches FROM (
      SELECT *, lag(direction) OVER {S}) AS pd FROM mv) GROUP BY 1, 2) USING (entity_id, position)""", MOVES),
)
register(
    "f29_trailing_run",
    lambda t: W.trailing_run(moves(t).withColumn("moved", F.col("direction") != "UNCHANGED"), W.SERIES, "obs_date", "moved"),
    q("""SELECT m.entity_id, m.position, count(*) FILTER (l.d IS NULL OR m.obs_date > l.d) AS trailing_run FROM mv m LEFT JOIN (
      SELECT entity_id, position, max(obs_date) AS d FROM mv WHERE direction = 'UNCHANGED' GROUP BY 1, 2) l ON l.entity_id = m.entity_id AND l.position = m.position GROUP BY 1, 2""", MOVES),
)
register(
    "f30_tumbling_row_windows",
    lambda t: W.row_windows(t.obs.select("entity_id", "obs_date", "p1"), ["entity_id"], 5).groupBy("entity_id", "window_index").agg(
        F.min("obs_date").alias("start_date"), F.max("obs_date").alias("end_date"), F.count("*").alias("n"), F.sum("p1").alias("total")),
    q(f"""SELECT entity_id, CAST(k AS INTEGER) AS window_index, {day('min(obs_date)', 'start_date')}, {day('max(obs_date)', 'end_date')}, count(*) AS n, CAST(sum(p1) AS BIGINT) AS total FROM (
      SELECT *, (row_number() OVER {E}) - 1) // 5 + 1 AS k FROM obs) GROUP BY 1, 2"""),
)
register(
    "f31_calendar_periods",
    lambda t: W.periods(t.obs.select("entity_id", "obs_date", "p1"), ["entity_id"], 7, "obs_date").groupBy("entity_id", "period_index", "period_start", "period_end").agg(
        F.count("*").alias("n"), F.avg("p1").alias("mean")),
    q(f"""SELECT entity_id, CAST(k AS INTEGER) AS period_index, {day('a + CAST(k * 7 AS INTEGER)', 'period_start')}, {day('a + CAST(k * 7 + 6 AS INTEGER)', 'period_end')}, count(*) AS n, {r('avg(p1)', 'mean')} FROM (
      SELECT *, date_diff('day', a, obs_date) // 7 AS k FROM (SELECT *, min(obs_date) OVER (PARTITION BY entity_id) AS a FROM obs)) GROUP BY entity_id, k, a"""),
)
register(
    "f32_sliding_windows",
    lambda t: W.sliding_windows(t.obs, 5).select(
        "entity_id", "obs_date", "window_index", F.col("rows")[0]["obs_date"].alias("start_date"),
        F.transform("rows", lambda x: x["positions"]).alias("features")),
    q(f"""SELECT {ID}, CAST(rn - 4 AS INTEGER) AS window_index, {day('s', 'start_date')}, f AS features FROM (SELECT *, row_number() OVER {E}) AS rn, lag(obs_date, 4) OVER {E}) AS s,
      string_agg(head || pair || tail, ',') OVER {E} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS f FROM obs) WHERE rn >= 5"""),
)
