"""Frequencies, descriptive statistics, joint tables and set operations (E, H)."""

from pyspark.sql import functions as F

from obsframe.operators import aggregates as A
from obsframe.operators import families as fam
from obsframe.operators import scans as sc
from obsframe.operators import windows as W
from obsframe.plans.catalog import DIMS, Tables, day, ints, per_digit, q, r, register
from obsframe.plans.observations import MEAN

DIGITS = "range(10)"
FREQ = """freq AS (
  SELECT k.entity_id, k.position, CAST(d.range AS INTEGER) AS digit, k.n_obs, coalesce(c.n, 0) AS n,
         coalesce(c.n, 0) * 100.0 / k.n_obs AS pct, coalesce(c.n, 0) / k.n_obs AS prob
  FROM (SELECT entity_id, position, count(*) AS n_obs FROM longs GROUP BY 1, 2) k
  CROSS JOIN range(10) d
  LEFT JOIN (SELECT entity_id, position, value, count(*) AS n FROM longs GROUP BY 1, 2, 3) c
    ON c.entity_id = k.entity_id AND c.position = k.position AND c.value = d.range)"""
POOLED = """freq AS (
  SELECT k.position, CAST(d.range AS INTEGER) AS digit, k.n_obs, coalesce(c.n, 0) AS n,
         coalesce(c.n, 0) * 100.0 / k.n_obs AS pct, coalesce(c.n, 0) / k.n_obs AS prob
  FROM (SELECT position, count(*) AS n_obs FROM longs GROUP BY 1) k CROSS JOIN range(10) d
  LEFT JOIN (SELECT position, value, count(*) AS n FROM longs GROUP BY 1, 2) c
    ON c.position = k.position AND c.value = d.range)"""
KEYS = ["entity_id", "position"]

register(
    "e01_digit_frequency", lambda t: A.digit_frequency(t.long, KEYS),
    q(f"SELECT entity_id, position, digit, n_obs, n, {r('pct', 'pct')}, {r('prob', 'prob')} FROM freq", FREQ),
)
register(
    "e02_position_frequency", lambda t: A.digit_frequency(t.long, ["position"]),
    q(f"SELECT position, digit, n_obs, n, {r('pct', 'pct')}, {r('prob', 'prob')} FROM freq", POOLED),
)
register(
    "e03_frequency_extremes", lambda t: A.frequency_extremes(t.long, KEYS),
    q("""SELECT entity_id, position, any_value(n_obs) AS n_obs, string_agg(CAST(digit AS VARCHAR), ',' ORDER BY digit) FILTER (n = hi) AS most_frequent, any_value(hi) AS most_count,
      string_agg(CAST(digit AS VARCHAR), ',' ORDER BY digit) FILTER (n = lo) AS least_frequent, any_value(lo) AS least_count
      FROM (SELECT *, max(n) OVER w AS hi, min(n) OVER w AS lo FROM freq WINDOW w AS (PARTITION BY entity_id, position)) GROUP BY 1, 2""", FREQ),
)
ENTROPY = "-sum(CASE WHEN n > 0 THEN n / n_obs * log2(n / n_obs) ELSE 0 END)"
register(
    "e04_descriptive_statistics", lambda t: A.describe(t.long, KEYS),
    q(f"""SELECT s.*, m.modes, m.entropy_bits FROM (SELECT entity_id, position, count(*) AS n_obs, min(value) AS min, max(value) AS max, max(value) - min(value) AS range,
      {r('avg(value)', 'mean')}, {r('median(value)', 'median')}, {r('var_pop(value)', 'variance')}, {r('stddev_pop(value)', 'std')} FROM longs GROUP BY 1, 2) s
      JOIN (SELECT entity_id, position, string_agg(CAST(digit AS VARCHAR), ',' ORDER BY digit) FILTER (n = hi) AS modes, {r(ENTROPY, 'entropy_bits')}
      FROM (SELECT *, max(n) OVER (PARTITION BY entity_id, position) AS hi FROM freq) GROUP BY 1, 2) m USING (entity_id, position)""", FREQ),
)
register(
    "e05_distribution_matrix", lambda t: A.distribution_matrix(A.digit_frequency(t.long, KEYS), ["entity_id"]),
    q("SELECT entity_id, position, " + ", ".join(r(f"max(pct) FILTER (digit = {d})", f"d{d}") for d in range(10)) + " FROM freq GROUP BY 1, 2", FREQ),
)
register(
    "e06_global_digit_frequency", lambda t: A.global_frequency(t.long, ["entity_id"]),
    q(f"""SELECT entity_id, digit, n_obs, n, {r('n * 100.0 / n_obs', 'pct')}, {r('e', 'entropy_bits')} FROM (
      SELECT *, -sum(CASE WHEN n > 0 THEN n / n_obs * log2(n / n_obs) ELSE 0 END) OVER (PARTITION BY entity_id) AS e FROM (
      SELECT entity_id, digit, CAST(sum(n_obs) AS BIGINT) AS n_obs, CAST(sum(n) AS BIGINT) AS n FROM freq GROUP BY 1, 2))""", FREQ),
)
register(
    "e07_column_statistics",
    lambda t: A.describe(t.long, ["position"]).select("position", "n_obs", "mean", "std", "min", "max"),
    q(f"SELECT position, count(*) AS n_obs, {r('avg(value)', 'mean')}, {r('stddev_pop(value)', 'std')}, min(value) AS min, max(value) AS max FROM longs GROUP BY 1"),
)
COVER = """cover AS (SELECT entity_id, count(*) AS n_records, count(DISTINCT entity_id) AS n_entities, count(DISTINCT obs_date) AS n_dates, min(obs_date) AS first_date, max(obs_date) AS last_date,
  CAST(date_diff('day', min(obs_date), max(obs_date)) + 1 AS INTEGER) AS calendar_days FROM obs GROUP BY 1)"""
register(
    "e08_coverage_summary", lambda t: A.coverage(t.obs),
    q(f"SELECT entity_id, n_records, n_entities, n_dates, {day('first_date')}, {day('last_date')}, calendar_days, greatest(calendar_days - n_dates, 0) AS missing_days, {r('n_dates * 100.0 / calendar_days', 'coverage_pct')} FROM cover", COVER),
)
register(
    "e09_insights", lambda t: A.insights(t.obs, t.long, sc.row_mean_trend(t.obs)),
    q("""SELECT entity_id, kind, message FROM (SELECT c.entity_id, unnest(['VOLUME', 'COVERAGE', 'DIGIT', 'TREND', 'VARIABILITY']) AS kind,
      unnest([n_records || ' observations on record.',
        printf('%.2f%% of the calendar is covered; days without an observation: %d.', n_dates * 100.0::DOUBLE / calendar_days, greatest(calendar_days - n_dates, 0)),
        'Most frequent digit: ' || top || ', least frequent: ' || low || '.',
        'Over time the mean of a row goes ' || direction || '.', printf('Widest spread of a position (standard deviation): %.4f.', spread)]) AS message
      FROM cover c JOIN ext USING (entity_id) JOIN trend USING (entity_id) JOIN spread USING (entity_id))""",
      FREQ, COVER,
      """ext AS (SELECT entity_id, arg_min(digit, (-n, digit)) AS top, arg_min(digit, (n, digit)) AS low FROM (SELECT entity_id, digit, sum(n) AS n FROM freq GROUP BY 1, 2) GROUP BY 1)""",
      f"""trend AS (SELECT entity_id, CASE WHEN abs(slope) < 1e-9 THEN 'FLAT' WHEN slope > 0 THEN 'UP' ELSE 'DOWN' END AS direction FROM (SELECT entity_id, regr_slope(m, i) AS slope FROM (
      SELECT entity_id, {MEAN} AS m, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY obs_date) AS DOUBLE) AS i FROM obs) GROUP BY 1))""",
      "spread AS (SELECT entity_id, max(s) AS spread FROM (SELECT entity_id, position, stddev_pop(value) AS s FROM longs GROUP BY 1, 2) GROUP BY 1)"),
)
register(
    "e10_calendar_counts", lambda t: A.calendar_counts(t.obs),
    q("SELECT entity_id, CAST(year(obs_date) AS INTEGER) AS year, CAST(month(obs_date) AS INTEGER) AS month, count(*) AS n_records FROM obs GROUP BY GROUPING SETS ((entity_id, year(obs_date), month(obs_date)), (entity_id, year(obs_date)))"),
)
register(
    "e10_gap_profile", lambda t: A.gap_profile(t.obs),
    q(f"""SELECT entity_id, count(g) AS n_gaps, {r('avg(g)', 'mean_gap')}, CAST(min(g) AS INTEGER) AS min_gap, CAST(max(g) AS INTEGER) AS max_gap, CAST(sum(greatest(coalesce(g - 1, 0), 0)) AS BIGINT) AS missing_days
      FROM (SELECT entity_id, date_diff('day', lag(obs_date) OVER (PARTITION BY entity_id ORDER BY obs_date), obs_date) AS g FROM obs) GROUP BY 1"""),
)
PROFILE = (("head_to_pair_first", "p1", "p4"), ("head_to_pair_second", "p1", "p5"), ("pair_first_to_pair_second", "p4", "p5"),
           ("pair_first_to_tail_first", "p4", "p6"), ("pair_second_to_tail_first", "p5", "p6"))
register(
    "e11_profile_conditionals", lambda t: A.profile_conditionals(t.obs, ["entity_id"]),
    q(f"""SELECT k.entity_id, k.relation, CAST(s.range AS INTEGER) AS src, CAST(d.range AS INTEGER) AS dst, coalesce(c.n, 0) AS n,
      {r('coalesce(round(c.n / sum(c.n) OVER (PARTITION BY k.entity_id, k.relation, s.range), 8), 0)', 'rate')}
      FROM (SELECT DISTINCT entity_id, relation FROM rel) k CROSS JOIN range(10) s CROSS JOIN range(10) d
      LEFT JOIN (SELECT entity_id, relation, src, dst, count(*) AS n FROM rel GROUP BY 1, 2, 3, 4) c ON c.entity_id = k.entity_id AND c.relation = k.relation AND c.src = s.range AND c.dst = d.range""",
      "rel AS (" + " UNION ALL ".join(f"SELECT entity_id, '{n}' AS relation, {a} AS src, {b} AS dst FROM obs" for n, a, b in PROFILE) + ")"),
)
register(
    "e13_duplicate_keys",
    lambda t: t.read("orders").groupBy(F.expr("CAST(o_custkey DIV 50 AS INT)").alias("entity_id"), F.col("o_orderdate").cast("date").alias("obs_date"))
    .agg(F.count("*").alias("n")).where("n > 1"),
    q(f"SELECT CAST(o_custkey // 50 AS INTEGER) AS entity_id, {day('CAST(o_orderdate AS DATE)', 'obs_date')}, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1"),
)
JOINT = """joint AS (SELECT x.position AS position_a, y.position AS position_b, x.value AS a, y.value AS b, count(*) AS n
  FROM longs x JOIN longs y ON x.entity_id = y.entity_id AND x.obs_date = y.obs_date AND x.position <> y.position GROUP BY 1, 2, 3, 4),
grid AS (SELECT k.position_a, k.position_b, CAST(s.range AS INTEGER) AS a, CAST(d.range AS INTEGER) AS b, coalesce(j.n, 0) AS n
  FROM (SELECT DISTINCT position_a, position_b FROM joint) k CROSS JOIN range(10) s CROSS JOIN range(10) d
  LEFT JOIN joint j ON j.position_a = k.position_a AND j.position_b = k.position_b AND j.a = s.range AND j.b = d.range)"""
register(
    "e14_conditional_probabilities", lambda t: A.conditional_probabilities(t.obs),
    q(f"SELECT position_a, position_b, a, b, n, CAST(sum(n) OVER w AS BIGINT) AS n_source, {r('coalesce(n / nullif(sum(n) OVER w, 0), 0)', 'prob')} FROM grid WINDOW w AS (PARTITION BY position_a, position_b, a)", JOINT),
)
register(
    "e15_independence", lambda t: A.independence(t.obs),
    q(f"""SELECT position_a, position_b, CAST(max(total) AS BIGINT) AS n_obs, {r('sum(coalesce((n - rn * cn / total) ^ 2 / nullif(rn * cn / total, 0), 0))', 'chi_square')}, 81 AS dof,
      {r('max(abs(n / total - (rn / total) * (cn / total)))', 'max_diff')}, max(abs(n / total - (rn / total) * (cn / total))) <= 1e-12 AS independent
      FROM (SELECT position_a, position_b, n::DOUBLE AS n, sum(n) OVER (PARTITION BY position_a, position_b)::DOUBLE AS total, sum(n) OVER (PARTITION BY position_a, position_b, a)::DOUBLE AS rn,
      sum(n) OVER (PARTITION BY position_a, position_b, b)::DOUBLE AS cn FROM grid WHERE position_a < position_b) GROUP BY 1, 2""", JOINT),
)
ERFC = """CASE WHEN abs(z) / sqrt(2) > 4 THEN 0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 120), lambda k:
  CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * exp((2 * k + 1) * ln(greatest(abs(z) / sqrt(2), 1e-300)) - lgamma(k + 1.0)) / (2 * k + 1))) END"""
Z = "(n / n_obs - 0.1) / sqrt(0.09 / n_obs)"
register(
    "e16_digit_significance", lambda t: A.significance(t.long, KEYS),
    q(f"SELECT entity_id, position, digit, n_obs, n, {r('pct', 'pct')}, {r('prob', 'prob')}, {r('z', 'z')}, {r('p', 'p_value')}, p < 0.05 AS significant FROM (SELECT *, {ERFC} AS p FROM (SELECT *, (n / n_obs - 0.1) / sqrt(0.09::DOUBLE / n_obs) AS z FROM freq))", FREQ),
)


def _halves(t: Tables):
    cut = F.lit("1998-04-01").cast("date")
    early = A.digit_frequency(t.long.where(F.col("obs_date") < cut), ["position"])
    late = A.digit_frequency(t.long.where(F.col("obs_date") >= cut), ["position"])
    return early, late


register(
    "e17_baseline_comparison", lambda t: A.compare_baselines(*_halves(t), tolerance=0.01),
    q(f"""SELECT position, CAST(digit AS INTEGER) AS digit, {r('a', 'previous_prob')}, {r('b', 'current_prob')}, {r('b - a', 'change')}, abs(b - a) > 0.01 AS changed FROM (
      SELECT position, d.range AS digit, count(*) FILTER (value = d.range AND obs_date < DATE '1998-04-01') * 100.0 / count(*) FILTER (obs_date < DATE '1998-04-01') / 100.0::DOUBLE AS a,
      count(*) FILTER (value = d.range AND obs_date >= DATE '1998-04-01') * 100.0 / count(*) FILTER (obs_date >= DATE '1998-04-01') / 100.0::DOUBLE AS b FROM longs CROSS JOIN range(10) d GROUP BY 1, 2)"""),
)
REL_SQL = "rel AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS relation, " + (f"'{i + 1}:' || " if lab else "") + f"CAST({s} AS VARCHAR) AS src, " + (f"'{j + 1}:' || " if lab else "") + f"CAST({d} AS VARCHAR) AS dst FROM obs"
    for name, ss, ds, lab in A.RELATIONS for i, s in enumerate(ss) for j, d in enumerate(ds)
) + ")"
RATE = f"SELECT relation, src, dst, n, CAST(sum(n) OVER w AS BIGINT) AS support, {r('round(n / sum(n) OVER w, 8)', 'rate')} FROM (SELECT relation, src, dst, count(*) AS n FROM rel GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY relation, src)"
register("e18_relationship_tables", lambda t: A.rate_table(A.relation_rows(t.obs)), q(RATE, REL_SQL))


def _states(t: Tables):
    wide = fam.resolve_all(t.obs, t.dims)
    c = F.col
    return A.state_transitions(
        wide,
        {
            "head_to_head": (c("head"), c("head")), "pair_to_pair": (c("pair"), c("pair")),
            "tail_to_tail": (c("tail"), c("tail")), "family_to_family": (c("pair_name"), c("pair_name")),
            "head_to_pair": (c("head"), c("pair")), "pair_to_tail": (c("pair"), c("tail")),
            "head_to_family": (c("head"), c("pair_name")), "family_to_tail_family": (c("pair_name"), c("tail_name")),
        },
    )


register(
    "e19_top_transitions", lambda t: A.top_transitions(_states(t)),
    q(f"""SELECT relation, src, dst, n, CAST(rank AS INTEGER) AS rank, CAST(total AS BIGINT) AS transition_count, ns AS n_sources, nd AS n_targets, {r('round(n / total, 8)', 'rate')} FROM (
      SELECT c.*, row_number() OVER (PARTITION BY relation ORDER BY n DESC, src NULLS FIRST, dst NULLS FIRST) AS rank FROM c) JOIN (SELECT relation, sum(n) AS total, count(DISTINCT src) AS ns, count(DISTINCT dst) AS nd FROM c GROUP BY 1) USING (relation) WHERE rank <= 25""",
      DIMS, "s AS (SELECT *, lag(head) OVER w AS ph, lag(pair) OVER w AS pp, lag(tail) OVER w AS pt, lag(pair_name) OVER w AS pf, row_number() OVER w AS rn FROM resolved WINDOW w AS (PARTITION BY entity_id ORDER BY obs_date))",
      "st AS (" + " UNION ALL ".join(f"SELECT '{n}' AS relation, {a} AS src, {b} AS dst FROM s WHERE rn > 1" for n, a, b in (
          ("head_to_head", "ph", "head"), ("pair_to_pair", "pp", "pair"), ("tail_to_tail", "pt", "tail"), ("family_to_family", "pf", "pair_name"),
          ("head_to_pair", "ph", "pair"), ("pair_to_tail", "pp", "tail"), ("head_to_family", "ph", "pair_name"), ("family_to_tail_family", "pf", "tail_name"))) + ")",
      "c AS (SELECT relation, src, dst, count(*) AS n FROM st GROUP BY 1, 2, 3)"),
)
register(
    "e20_digit_transition_matrix", lambda t: A.transition_matrix(t.long),
    q(f"""SELECT position, src, dst, n, CAST(sum(n) OVER w AS BIGINT) AS support, {r('round(n / sum(n) OVER w, 8)', 'rate')} FROM (SELECT position, value AS src, nx AS dst, count(*) AS n FROM (
      SELECT position, value, lead(value) OVER (PARTITION BY entity_id, position ORDER BY obs_date) AS nx FROM longs) WHERE nx IS NOT NULL GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY position, src)"""),
)
register(
    "e20_family_transition_matrix",
    lambda t: A.rate_table(W.IDS and fam.family_transitions(fam.family_rows(t.obs, t.dims)).select("code_group", F.col("previous_family").alias("src"), F.col("family_name").alias("dst")), ["code_group"]),
    q(f"""SELECT code_group, src, dst, n, CAST(sum(n) OVER w AS BIGINT) AS support, {r('round(n / sum(n) OVER w, 8)', 'rate')} FROM (SELECT code_group, pf AS src, family_name AS dst, count(*) AS n FROM (
      SELECT *, lag(family_name) OVER (PARTITION BY entity_id, code_group ORDER BY obs_date) AS pf FROM family_rows) WHERE pf IS NOT NULL AND family_name IS NOT NULL GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY code_group, src)""", DIMS),
)
register(
    "e22_family_sizes", lambda t: fam.family_sizes(t.tail_member, "type"),
    q("SELECT family_name, type, count(DISTINCT code) AS n_codes, CAST(grouping(family_name, type) AS BIGINT) AS grouping_level FROM tail_member GROUP BY ROLLUP (family_name, type)", DIMS),
)
register(
    "e23_store_snapshot", lambda t: A.row_counts({"observations": t.obs, "orders": t.read("orders"), "events": t.read("events")}),
    q("SELECT 'observations' AS table_name, count(*) AS n_rows FROM obs UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events"),
)
