"""Scans, derivations, filters and joins (A–D)."""

from pyspark.sql import functions as F

from obsframe.functions import codes as C
from obsframe.functions.stats import compare as compare_to
from obsframe.layout import PAIR_POSITIONS, POSITIONS
from obsframe.operators import aggregates as A
from obsframe.operators import families as fam
from obsframe.operators import scans as sc
from obsframe.plans.catalog import DIMS, P, day, doubles, ints, q, r, register
from obsframe.sources import writers as wr
from obsframe.sources.readers import order_violations, pad_codes, split_codes

# -- A scans, sources, sinks --------------------------------------------------

register(
    "a01_observations_in_order",
    lambda t: sc.in_date_order(t.obs).select("entity_id", "obs_date", "obs_id", "head", "pair", "tail", "seq"),
    q(f"SELECT entity_id, {day('obs_date')}, obs_id, head, pair, tail, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY obs_date) AS INTEGER) AS seq FROM obs"),
)
register(
    "a02_date_range_scan",
    lambda t: sc.scan_range(t.obs, "1996-03-01", "2000-02-29").drop("obs_id"),
    q(f"SELECT entity_id, {day('obs_date')}, head, pair, tail, {P} FROM obs WHERE obs_date BETWEEN DATE '1996-03-01' AND DATE '2000-02-29'"),
)
register(
    "a03_lookup_by_key",
    lambda t: sc.lookup(
        t.obs, t.obs.groupBy("entity_id").agg(F.max("obs_date").alias("obs_date"))
    ).select("entity_id", "obs_date", "obs_id", "head", "pair", "tail"),
    q(f"SELECT entity_id, {day('obs_date')}, obs_id, head, pair, tail FROM obs o WHERE obs_date = (SELECT max(obs_date) FROM obs i WHERE i.entity_id = o.entity_id)"),
)
register(
    "a04_valid_history_rows",
    lambda t: sc.load_observations(t.obs),
    q(f"SELECT obs_id, entity_id, {day('obs_date')}, {ints(f'[{P}]', 'positions')} FROM obs"),
)
register(
    "a05_long_observations",
    lambda t: t.long,
    q(f"SELECT entity_id, {day('obs_date')}, position, value FROM longs"),
)
register(
    "a06_baseline_contract",
    lambda t: sc.baseline_contract(t.long, ["entity_id"]),
    q(f"SELECT entity_id, position, count(*) AS n_obs, {day('min(obs_date)', 'first_date')}, {day('max(obs_date)', 'last_date')} FROM longs GROUP BY 1, 2"),
)
register(
    "a07_padded_import",
    lambda t: split_codes(
        pad_codes(
            t.obs.select("entity_id", "obs_date", *[F.col(c).cast("int").alias(c) for c in ("head", "pair", "tail")])
        )
    ),
    q(f"SELECT entity_id, {day('obs_date')}, head, pair, tail, {P} FROM obs"),
)
register(
    "a07_import_order_violations",
    lambda t: order_violations(t.obs, "obs_id").select("entity_id", "obs_id", "obs_date", "previous_date"),
    q(f"SELECT entity_id, obs_id, {day('obs_date')}, {day('previous_date')} FROM (SELECT *, lag(obs_date) OVER (PARTITION BY entity_id ORDER BY obs_id) AS previous_date FROM obs) WHERE previous_date >= obs_date"),
)


def raw_cells(t):
    """Every order as an incoming row: many share an (entity, day)."""
    return t.read("orders").select(
        F.expr("CAST(o_custkey DIV 50 AS INT)").alias("entity_id"),
        F.col("o_orderdate").cast("date").alias("obs_date"),
        F.col("o_orderkey").alias("obs_id"), "o_orderstatus",
    )


STORED = "WHERE obs_date < DATE '1999-01-01'"
register(
    "a08_resumable_append",
    lambda t: wr.new_rows(raw_cells(t), t.obs.where("obs_date < date'1999-01-01'"), "obs_id"),
    q(f"""SELECT entity_id, {day('obs_date')}, obs_id, o_orderstatus FROM (
      SELECT o_custkey // 50 AS e, CAST(entity_id AS INTEGER) AS entity_id, obs_date, obs_id, o_orderstatus
      FROM obs JOIN orders ON o_orderkey = obs_id) WHERE obs_date >= DATE '1999-01-01'"""),
)
register(
    "a09_family_members",
    lambda t: t.pair_member.select("family_name", "code", F.lit("pair").alias("type"))
    .unionByName(t.tail_member.select("family_name", "code", "type")),
    q("SELECT family_name, code, 'pair' AS type FROM pair_member UNION ALL SELECT family_name, code, type FROM tail_member", DIMS),
)
register(
    "a10_rejected_duplicates",
    lambda t: A_rejected(t),
    q(f"""SELECT o.o_orderkey AS obs_id, c.entity_id, {day('c.obs_date', 'obs_date')} FROM orders o JOIN cell c
      ON CAST(o.o_custkey // 50 AS INTEGER) = c.entity_id AND CAST(o.o_orderdate AS DATE) = c.obs_date WHERE o.o_orderkey <> c.obs_id"""),
)


def A_rejected(t):
    return raw_cells(t).join(t.obs.select("obs_id"), "obs_id", "left_anti").select("obs_id", "entity_id", "obs_date")


register(
    "a11_update_and_delete",
    lambda t: split_codes(
        wr.delete_rows(
            wr.apply_changes(
                t.obs,
                t.obs.where("p8 = 0").select("obs_id", F.lpad(((F.col("p6") * 100 + F.col("p7") * 10 + 5)).cast("string"), 3, "0").alias("tail")),
            ),
            t.obs.where("p1 = 9"),
        )
    ).select("obs_id", "entity_id", "obs_date", "tail", "p6", "p7", "p8"),
    q(f"""SELECT obs_id, entity_id, {day('obs_date')}, CASE WHEN p8 = 0 THEN substr(tail, 1, 2) || '5' ELSE tail END AS tail,
      p6, p7, CASE WHEN p8 = 0 THEN 5 ELSE p8 END AS p8 FROM obs WHERE p1 <> 9"""),
)
register(
    "a12_report_rows",
    lambda t: A.coverage(t.obs).select(
        wr.canonical_json("entity_id", "n_records", "n_dates", "missing_days").alias("report"),
        F.sha2(wr.canonical_json("entity_id", "n_records", "n_dates", "missing_days"), 256).alias("identity"),
    ),
    q("""SELECT report, sha256(report) AS identity FROM (SELECT '{"entity_id":' || entity_id || ',"missing_days":' || m || ',"n_dates":' || n || ',"n_records":' || n || '}' AS report
      FROM (SELECT entity_id, count(*) AS n, greatest(date_diff('day', min(obs_date), max(obs_date)) + 1 - count(*), 0) AS m FROM obs GROUP BY 1))"""),
)
register(
    "a13_entities_by_name",
    lambda t: sc.entity_listing(t.obs),
    q("SELECT DISTINCT entity_id, 'entity-' || entity_id AS name FROM obs"),
)
register(
    "a14_dimension_members",
    lambda t: t.tail_member.select("family_id", "code", "type", "digit_1", "digit_2", "digit_3"),
    q("SELECT family_id, code, type, digit_1, digit_2, digit_3 FROM tail_member", DIMS),
)

# -- B derivations ------------------------------------------------------------


def class3(c: str, a: str, b: str, d: str) -> str:
    return f"""CASE len(list_distinct([{a}, {b}, {d}])) WHEN 3 THEN 'TRIPLE_UNIQUE' WHEN 2 THEN 'ONE_PAIR' ELSE 'TRIPLE_REPEAT' END
    || '|' || CASE WHEN contains({c}, '0') THEN 'HAS_ZERO' ELSE 'NO_ZERO' END
    || '|' || CASE WHEN {a} + {b} + {d} <= 9 THEN 'LOW_SUM' WHEN {a} + {b} + {d} <= 18 THEN 'MEDIUM_SUM' ELSE 'HIGH_SUM' END
    || '|' || translate({c}, '0123456789', 'EOEOEOEOEO')
    || '|' || CASE WHEN {a} < {b} AND {b} < {d} THEN 'ASCENDING' WHEN {a} > {b} AND {b} > {d} THEN 'DESCENDING' ELSE 'MIXED' END"""


SHARED = "len(list_intersect(list_distinct([p1, p2, p3]), list_distinct([p6, p7, p8])))"
CLASSES = f"""classes AS (SELECT obs_id, entity_id, obs_date, {class3('head', 'p1', 'p2', 'p3')} AS head_class,
  CASE WHEN p4 = p5 THEN 'DOUBLE|SAME_DIGIT|' ELSE 'NON_DOUBLE|DIFFERENT_DIGIT|' END || translate(pair, '0123456789', 'EOEOEOEOEO') AS pair_class,
  {class3('tail', 'p6', 'p7', 'p8')} AS tail_class,
  CASE WHEN head = tail THEN 'SAME' WHEN head = reverse(tail) THEN 'REVERSED' WHEN {SHARED} > 0 THEN 'PARTIAL_MATCH' ELSE 'NO_POSITIONAL_MATCH' END
    || '|' || {SHARED} || '_MATCH' AS overall_class FROM obs)"""

register(
    "b01_parse_codes",
    lambda t: split_codes(
        t.obs.select("obs_id", F.concat(F.lit(" "), "head").alias("head"),
                     F.when(F.col("p4") == 7, F.lit("7x")).otherwise(F.col("pair")).alias("pair"),
                     F.when(F.col("p8") == 3, F.substring("tail", 1, 2)).otherwise(F.col("tail")).alias("tail"))
    ),
    q("""SELECT obs_id, head, CASE WHEN p4 <> 7 THEN pair END AS pair, CASE WHEN p8 <> 3 THEN tail END AS tail, p1, p2, p3,
      CASE WHEN p4 <> 7 THEN p4 END AS p4, CASE WHEN p4 <> 7 THEN p5 END AS p5,
      CASE WHEN p8 <> 3 THEN p6 END AS p6, CASE WHEN p8 <> 3 THEN p7 END AS p7, CASE WHEN p8 <> 3 THEN p8 END AS p8 FROM obs"""),
)
register(
    "b02_three_digit_class",
    lambda t: t.obs.groupBy(C.three_digit_class(F.col("head")).alias("head_class")).agg(F.count("*").alias("n")),
    q(f"SELECT {class3('head', 'p1', 'p2', 'p3')} AS head_class, count(*) AS n FROM obs GROUP BY 1"),
)
register(
    "b03_pair_class",
    lambda t: t.obs.select("obs_id", C.pair_class(F.col("pair")).alias("pair_class")),
    q("SELECT obs_id, pair_class FROM classes", CLASSES),
)
register(
    "b04_head_tail_relation",
    lambda t: t.obs.select(
        "obs_id", C.code_relation(F.col("head"), F.col("tail")).alias("relation"),
        C.digit_overlap(F.col("head"), F.col("tail")).alias("overlap")),
    q("SELECT obs_id, split_part(overall_class, '|', 1) AS relation, split_part(overall_class, '|', 2) AS overlap FROM classes", CLASSES),
)
register(
    "b05_classification_rows",
    lambda t: sc.classify(t.obs),
    q(f"SELECT obs_id, entity_id, {day('obs_date')}, 'v1' AS classification_version, head_class, pair_class, tail_class, overall_class FROM classes", CLASSES),
)
register(
    "b06_code_structure",
    lambda t: sc.code_structure(t.obs),
    q("""SELECT obs_id, head, array_to_string(list_sort([p1, p2, p3]), '') AS sorted_digits,
      array_to_string(list_sort(list_distinct([p1, p2, p3])), '') AS unique_digits,
      CAST(3 - len(list_distinct([p1, p2, p3])) AS INTEGER) AS repeated_count FROM obs"""),
)


def cycle_sql(prefix: str, dom: str) -> str:
    parts = {
        "day_of_week": "(isodow(obs_date) - 1) / 7.0",
        "day_of_month": f"(day(obs_date) - 1) / {dom}",
        "iso_week": "(week(obs_date) - 1) / 53.0",
        "month": "(month(obs_date) - 1) / 12.0",
        "quarter": "(quarter(obs_date) - 1) / 4.0",
        "day_of_year": "(dayofyear(obs_date) - 1) / CAST(dayofyear(make_date(year(obs_date), 12, 31)) AS DOUBLE)",
    }
    return ", ".join(
        r(f"{fn}(CAST({e} AS DOUBLE) * 2 * pi())", f"{prefix}{n}_{fn}") for n, e in parts.items() for fn in ("sin", "cos")
    )


register(
    "b07_cyclical_dates",
    lambda t: sc.cyclical_features(t.obs.select("obs_id", "obs_date")),
    q(f"SELECT obs_id, {day('obs_date')}, {cycle_sql('', '31.0')} FROM obs"),
)
register(
    "b08_calendar_features",
    lambda t: sc.calendar_features(t.obs.select("obs_id", "obs_date")),
    q(f"""SELECT obs_id, {day('obs_date')}, dayname(obs_date) AS day_name, CAST(isodow(obs_date) - 1 AS INTEGER) AS day_of_week,
      CAST(day(obs_date) AS INTEGER) AS day_of_month, CAST(dayofyear(obs_date) AS INTEGER) AS day_of_year, CAST(week(obs_date) AS INTEGER) AS iso_week,
      CAST(month(obs_date) AS INTEGER) AS month, monthname(obs_date) AS month_name, CAST(quarter(obs_date) AS INTEGER) AS quarter,
      CAST(year(obs_date) AS INTEGER) AS year, {cycle_sql('real_', 'CAST(day(last_day(obs_date)) AS DOUBLE)')} FROM obs"""),
)
PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
register(
    "b09_latest_value_flags",
    lambda t: sc.position_features(t.obs),
    q("SELECT entity_id, " + day("obs_date") + ", " + ", ".join(
        f"l_{p} AS {p}_latest, CAST(l_{p} % 2 = 0 AS INTEGER) AS {p}_is_even, CAST(l_{p} = 0 AS INTEGER) AS {p}_is_zero, CAST(l_{p} >= 5 AS INTEGER) AS {p}_is_high, "
        f"{r(f'a_{p}', f'{p}_mean')}, n_{p} AS {p}_min, x_{p} AS {p}_max" for p in POSITIONS) + " FROM w",
      "w AS (SELECT entity_id, obs_date, " + ", ".join(
          f"lag({p}) OVER (PARTITION BY entity_id ORDER BY obs_date) AS l_{p}, avg({p}) OVER (PARTITION BY entity_id ORDER BY obs_date {PRIOR}) AS a_{p}, "
          f"min({p}) OVER (PARTITION BY entity_id ORDER BY obs_date {PRIOR}) AS n_{p}, max({p}) OVER (PARTITION BY entity_id ORDER BY obs_date {PRIOR}) AS x_{p}"
          for p in POSITIONS) + " FROM obs)"),
)
register(
    "b10_cross_position_relations",
    lambda t: sc.cross_position_features(t.obs),
    q(f"""SELECT entity_id, {day('obs_date')}, position_a, position_b, CAST(a = b AS INTEGER) AS equal, abs(a - b) AS abs_diff, a + b AS total,
      CAST(sign(a - b) AS INTEGER) AS ordering, CAST(a % 2 = b % 2 AS INTEGER) AS same_parity, CAST((a = 0) = (b = 0) AS INTEGER) AS same_zero_state
      FROM (SELECT x.entity_id, x.obs_date, x.position AS position_a, y.position AS position_b, x.v AS a, y.v AS b FROM l x JOIN l y
      ON x.entity_id = y.entity_id AND x.obs_date = y.obs_date AND x.position < y.position) WHERE a IS NOT NULL""",
      "l AS (SELECT entity_id, obs_date, position, lag(value) OVER (PARTITION BY entity_id, position ORDER BY obs_date) AS v FROM longs)"),
)
register(
    "b11_code_families",
    lambda t: fam.family_rows(t.obs, t.dims),
    q(f"SELECT entity_id, {day('obs_date')}, code_group, code, family_id, family_name, is_mapped FROM family_rows", DIMS),
)
register(
    "b12_family_combinations",
    lambda t: fam.family_combinations(t.obs, t.dims),
    q(" UNION ALL ".join(
        f"SELECT entity_id, {day('obs_date')}, '{a}_{b}' AS combination, {a}_name AS family_a, {b}_name AS family_b, {a}_mapped AND {b}_mapped AS both_mapped FROM resolved"
        for a, b in (("head", "pair"), ("head", "tail"), ("pair", "tail"))), DIMS),
)
register(
    "b13_record_rows",
    lambda t: sc.record_rows(t.obs).select("obs_id", "entity_id", "obs_date", "head", "pair", "tail", "positions"),
    q(f"SELECT obs_id, entity_id, {day('obs_date')}, head, pair, tail, {ints(f'[{P}]', 'positions')} FROM obs"),
)
MEAN = f"list_avg([{P}])"
register(
    "b14_row_mean_std",
    lambda t: sc.row_mean_std(t.obs).select("obs_id", "row_mean", "row_std"),
    q(f"SELECT obs_id, {r(MEAN, 'row_mean')}, {r(f'list_stddev_pop([{P}])', 'row_std')} FROM obs"),
)
register(
    "b14_row_mean_trend",
    lambda t: sc.row_mean_trend(t.obs),
    q(f"""SELECT entity_id, n AS n_points, {r('slope', 'slope')}, {r('mn', 'min_row_mean')}, {r('mx', 'max_row_mean')}, {r('latest', 'latest_row_mean')},
      CASE WHEN abs(slope) < 1e-9 THEN 'FLAT' WHEN slope > 0 THEN 'UP' ELSE 'DOWN' END AS direction FROM (
      SELECT entity_id, count(*) AS n, coalesce(regr_slope(m, i), 0.0) AS slope, min(m) AS mn, max(m) AS mx, arg_max(m, i) AS latest FROM (
      SELECT entity_id, {MEAN} AS m, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY obs_date) AS DOUBLE) AS i FROM obs) GROUP BY 1)"""),
)

# -- C filters ----------------------------------------------------------------

register(
    "c01_point_in_time_history",
    lambda t: sc.history_sizes(t.obs),
    q(f"""SELECT entity_id, {day('obs_date', 'target_date')}, count(*) OVER w AS n_history, {day('min(obs_date) OVER w', 'first_date')},
      {day('max(obs_date) OVER w', 'last_date')} FROM obs WINDOW w AS (PARTITION BY entity_id ORDER BY obs_date {PRIOR})"""),
)
register(
    "c01_history_before_targets",
    lambda t: sc.point_in_time(
        t.obs.select("entity_id", "obs_date", "p1"),
        t.obs.groupBy("entity_id").agg(F.max("obs_date").alias("target_date")),
    ),
    q(f"""SELECT o.entity_id, {day('o.obs_date', 'obs_date')}, p1, {day('x.m', 'target_date')} FROM obs o
      JOIN (SELECT entity_id, max(obs_date) AS m FROM obs GROUP BY 1) x ON o.entity_id = x.entity_id AND o.obs_date < x.m"""),
)
register(
    "c02_records_newest_first",
    lambda t: sc.record_rows(t.obs, "1997-01-01", "1999-12-31", limit=1000).select("obs_id", "entity_id", "obs_date", "positions"),
    q(f"""SELECT obs_id, entity_id, {day('obs_date')}, {ints(f'[{P}]', 'positions')} FROM (SELECT * FROM obs WHERE obs_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'
      ORDER BY obs_date DESC, obs_id DESC LIMIT 1000)"""),
)
register(
    "c03_code_search",
    lambda t: fam.search_codes(t.tail_member, "12", kind="single").select("family_id", "code", "type"),
    q("SELECT family_id, code, type FROM tail_member WHERE code ILIKE '%12%' AND type = 'single'", DIMS),
)
register(
    "c04_classification_filter",
    lambda t: sc.classify(t.obs).where(
        F.col("head_class").startswith("ONE_PAIR") & F.col("overall_class").endswith("1_MATCH")
        & F.col("obs_date").between("1996-01-01", "2000-12-31")
    ).select("obs_id", "head_class", "overall_class"),
    q("SELECT obs_id, head_class, overall_class FROM classes WHERE head_class LIKE 'ONE_PAIR%' AND overall_class LIKE '%1_MATCH' AND obs_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'", CLASSES),
)
register(
    "c06_threshold_predicate",
    lambda t: t.obs.select(
        "obs_id",
        *[compare_to(F.col("p1").cast("double"), F.col("p2").cast("double"), F.lit(op)).cast("int").alias(op)
          for op in ("gte", "gt", "lte", "lt", "eq")],
    ),
    q("SELECT obs_id, CAST(p1 >= p2 AS INTEGER) AS gte, CAST(p1 > p2 AS INTEGER) AS gt, CAST(p1 <= p2 AS INTEGER) AS lte, CAST(p1 < p2 AS INTEGER) AS lt, CAST(p1 = p2 AS INTEGER) AS eq FROM obs"),
)

# -- D joins ------------------------------------------------------------------

register(
    "d01_observations_with_entity",
    lambda t: t.obs.join(sc.entity_listing(t.obs), "entity_id").select("obs_id", "entity_id", "name"),
    q("SELECT obs_id, entity_id, 'entity-' || entity_id AS name FROM obs"),
)
register(
    "d02_unchecked_observations",
    lambda t: t.obs.join(t.read("lineitem").select(F.col("l_orderkey").alias("obs_id")), "obs_id", "left_anti").select("obs_id", "entity_id"),
    q("SELECT obs_id, entity_id FROM obs WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = obs_id)"),
)
register(
    "d03_family_lookup",
    lambda t: fam.resolve_all(t.obs, t.dims).select("obs_id", "head_name", "head_mapped", "pair_name", "pair_mapped", "tail_name", "tail_mapped"),
    q("SELECT obs_id, head_name, head_mapped, pair_name, pair_mapped, tail_name, tail_mapped FROM resolved", DIMS),
)
register(
    "d04_codes_of_digit",
    lambda t: t.obs.select("obs_id", F.col("p4").alias("family_id")).join(
        F.broadcast(t.tail_member.groupBy("family_id").agg(F.count("*").alias("n_codes"), F.min("code").alias("first_code"))), "family_id"),
    q("SELECT obs_id, p4 AS family_id, n_codes, first_code FROM obs JOIN (SELECT family_id, count(*) AS n_codes, min(code) AS first_code FROM tail_member GROUP BY 1) m ON p4 = m.family_id", DIMS),
)
register(
    "d05_next_observation",
    lambda t: t.obs.select(
        "entity_id", "obs_date",
        F.lead(F.struct("obs_date", "p1", "p8")).over(sc.history("entity_id")).alias("n"),
    ).where("n is not null").select("entity_id", "obs_date", F.col("n.obs_date").alias("next_date"), F.col("n.p1").alias("next_p1"), F.col("n.p8").alias("next_p8")),
    q(f"SELECT entity_id, {day('obs_date')}, {day('nd', 'next_date')}, n1 AS next_p1, n8 AS next_p8 FROM (SELECT *, lead(obs_date) OVER w AS nd, lead(p1) OVER w AS n1, lead(p8) OVER w AS n8 FROM obs WINDOW w AS (PARTITION BY entity_id ORDER BY obs_date)) WHERE nd IS NOT NULL"),
)
register(
    "d06_prior_rows_zero_filled",
    lambda t: t.obs.select(
        "entity_id", "obs_date",
        *[F.coalesce(F.lag(p, k).over(sc.history("entity_id")), F.lit(0)).alias(f"{p}_lag_{k}") for p in POSITIONS for k in (1, 2, 3)]),
    q(f"SELECT entity_id, {day('obs_date')}, " + ", ".join(f"coalesce(lag({p}, {k}) OVER w, 0) AS {p}_lag_{k}" for p in POSITIONS for k in (1, 2, 3)) + " FROM obs WINDOW w AS (PARTITION BY entity_id ORDER BY obs_date)"),
)
register(
    "d10_position_pairs",
    lambda t: A.joint_counts(t.obs),
    q("SELECT x.position AS position_a, y.position AS position_b, x.value AS a, y.value AS b, count(*) AS n FROM longs x JOIN longs y ON x.entity_id = y.entity_id AND x.obs_date = y.obs_date AND x.position < y.position GROUP BY 1, 2, 3, 4"),
)
REL2 = """pairs AS (SELECT a.family_id, a.code AS code_a, b.code AS code_b, a.code = reverse(b.code) AS is_reversed, a.code = b.code AS is_same,
  a.digit_1 = b.digit_1 AS same_1, a.digit_2 = b.digit_2 AS same_2, abs(a.digit_1 - b.digit_1) AS diff_1, abs(a.digit_2 - b.digit_2) AS diff_2,
  abs(a.digit_1 - b.digit_1) + abs(a.digit_2 - b.digit_2) AS total_diff, a.digit_1 + a.digit_2 AS sum_a, b.digit_1 + b.digit_2 AS sum_b,
  a.digit_1 + a.digit_2 = b.digit_1 + b.digit_2 AS same_sum
  FROM pair_member a JOIN pair_member b ON a.family_id = b.family_id AND a.code < b.code)"""
REL3 = """pairs AS (SELECT a.family_id, a.code AS code_a, b.code AS code_b, a.code = reverse(b.code) AS is_reversed, a.code = b.code AS is_same,
  a.digit_1 = b.digit_1 AS same_1, a.digit_2 = b.digit_2 AS same_2, a.digit_3 = b.digit_3 AS same_3,
  abs(a.digit_1 - b.digit_1) AS diff_1, abs(a.digit_2 - b.digit_2) AS diff_2, abs(a.digit_3 - b.digit_3) AS diff_3,
  abs(a.digit_1 - b.digit_1) + abs(a.digit_2 - b.digit_2) + abs(a.digit_3 - b.digit_3) AS total_diff,
  a.digit_1 + a.digit_2 + a.digit_3 AS sum_a, b.digit_1 + b.digit_2 + b.digit_3 AS sum_b,
  a.digit_1 + a.digit_2 + a.digit_3 = b.digit_1 + b.digit_2 + b.digit_3 AS same_sum
  FROM tail_member a JOIN tail_member b ON a.family_id = b.family_id AND a.code < b.code)"""
register("d11_family_member_pairs", lambda t: fam.member_pairs(t.tail_member, 3), q("SELECT * FROM pairs", DIMS, REL3))
register("i09_pair_code_relations", lambda t: fam.member_pairs(t.pair_member, 2), q("SELECT * FROM pairs", DIMS, REL2))
register(
    "i10_tail_code_categories",
    lambda t: fam.member_pairs(t.tail_member, 3).select("code_a", "code_b", fam.relation_categories(3).alias("categories")),
    q("""SELECT code_a, code_b, CASE WHEN len(c) > 0 THEN array_to_string(c, ',') ELSE 'different' END AS categories FROM (
      SELECT code_a, code_b, list_filter([CASE WHEN is_same THEN 'same' END, CASE WHEN is_reversed THEN 'reverse' END, CASE WHEN same_1 THEN 'same_first_digit' END,
      CASE WHEN same_2 THEN 'same_second_digit' END, CASE WHEN same_3 THEN 'same_third_digit' END, CASE WHEN same_sum THEN 'same_digit_sum' END], lambda v: v IS NOT NULL) AS c FROM pairs)""", DIMS, REL3),
)
register(
    "e21_family_pair_summary",
    lambda t: fam.family_pair_summary(fam.member_pairs(t.tail_member, 3), 3),
    q(f"""SELECT family_id, count(*) AS n_pairs, {r('avg(total_diff)', 'avg_total_diff')}, count(*) FILTER (is_same) AS n_is_same, count(*) FILTER (is_reversed) AS n_is_reversed,
      count(*) FILTER (same_1) AS n_same_1, count(*) FILTER (same_2) AS n_same_2, count(*) FILTER (same_3) AS n_same_3, count(*) FILTER (same_sum) AS n_same_sum,
      count(*) FILTER (NOT (is_same OR is_reversed OR same_1 OR same_2 OR same_3 OR same_sum)) AS n_different FROM pairs GROUP BY 1""", DIMS, REL3),
)
register(
    "d18_orphan_rows",
    lambda t: t.read("lineitem").join(t.obs.select(F.col("obs_id").alias("l_orderkey")), "l_orderkey", "left_anti").groupBy("l_returnflag").agg(F.count("*").alias("n_orphans")),
    q("SELECT l_returnflag, count(*) AS n_orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT obs_id FROM obs) GROUP BY 1"),
)
