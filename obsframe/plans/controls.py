"""Backtests, quality, versions, set operations and monitoring decisions (C, D, H, O, Q, R)."""

from pyspark.sql import functions as F

from obsframe import layout as L
from obsframe.operators import aggregates as A
from obsframe.operators import backtest as B
from obsframe.operators import evaluation as E
from obsframe.operators import quality as Q
from obsframe.operators import scans as sc
from obsframe.operators import windows as W
from obsframe.plans.catalog import day, doubles, per_digit, q, r, register
from obsframe.plans.features import E as ENT
from obsframe.plans.features import ID as IDS
from obsframe.plans.features import back
from obsframe.plans.observations import PRIOR, raw_cells
from obsframe.plans.rankings import F0, FV, MK, OCP, PR, PW, both_models, feature_values, markov, pair_outcomes

# -- Q ------------------------------------------------------------------------

register(
    "q01_ratio_split", lambda t: B.ratio_split(t.obs.select("entity_id", "obs_date")),
    q(f"SELECT entity_id, {day('obs_date')}, CASE WHEN n < 103 OR f + g >= n THEN 'INSUFFICIENT' WHEN i < f THEN 'TRAIN' WHEN i < f + g THEN 'VALIDATION' ELSE 'TEST' END AS split FROM (SELECT *, greatest(100, floor(n * 0.7::DOUBLE)) AS f, greatest(1, floor(n * 0.15::DOUBLE)) AS g FROM (SELECT entity_id, obs_date, row_number() OVER {ENT}) - 1 AS i, count(*) OVER (PARTITION BY entity_id) AS n FROM obs))"),
)
FOLDS = f"""dx AS (SELECT entity_id, obs_date, row_number() OVER {ENT}) - 1 AS i, count(*) OVER (PARTITION BY entity_id) AS n FROM obs),
fo AS (SELECT s.entity_id, CAST((s.i - 100) // 60 + 1 AS INTEGER) AS fold, min(a.obs_date) AS train_start, max(a.obs_date) FILTER (a.i < s.i) AS train_end, any_value(s.obs_date) AS test_start, max(a.obs_date) FILTER (a.i < s.i + 60) AS test_end
  FROM (SELECT * FROM dx WHERE i >= 100 AND (i - 100) % 60 = 0) s JOIN dx a ON a.entity_id = s.entity_id GROUP BY s.entity_id, s.i)"""


def folds(t):
    return B.expanding_folds(t.obs, 100, 60, 60)


register("q02_expanding_folds", lambda t: folds(t), q(f"SELECT entity_id, fold, {day('train_start')}, {day('train_end')}, {day('test_start')}, {day('test_end')} FROM fo", FOLDS))
register(
    "d17_rows_in_folds", lambda t: B.assign_folds(t.obs.select("entity_id", "obs_date"), folds(t)).select("entity_id", "obs_date", "fold"),
    q(f"SELECT o.entity_id, {day('o.obs_date', 'obs_date')}, fold FROM obs o JOIN fo ON fo.entity_id = o.entity_id AND o.obs_date BETWEEN test_start AND test_end", FOLDS),
)
register(
    "q03_walk_forward_metrics",
    lambda t: E.evaluate(B.assign_folds(markov(t), folds(t)), ["entity_id", "fold"]).select("entity_id", "fold", "n_obs", "log_loss", "accuracy"),
    q(f"SELECT m.entity_id, fold, count(*) AS n_obs, {r('avg(-ln(greatest(probs[target + 1], 1e-15)))', 'log_loss')}, {r('avg((list_position(probs, list_max(probs)) - 1 = target)::INTEGER)', 'accuracy')} FROM mk m JOIN fo ON fo.entity_id = m.entity_id AND m.obs_date BETWEEN test_start AND test_end GROUP BY 1, 2", MK, FOLDS),
)
register(
    "q04_ranking_backtest",
    lambda t: E.top_k_report(
        B.assign_folds(pair_outcomes(t), folds(t).withColumnRenamed("entity_id", "group_id"), ("group_id",), "target_date"), (1, 3, 5, 10), ["group_id", "fold"]),
    q("SELECT group_id, fold, count(*) AS n_obs, count(actual_rank) AS n_ranked, " + ", ".join(r(f"coalesce(avg((actual_rank <= {k})::INTEGER), 0)", f"hit_rate_{k}") for k in (1, 3, 5, 10)) + f", {r('coalesce(avg(CASE WHEN actual_rank IS NOT NULL THEN reciprocal_rank END), 0)', 'mrr')} FROM oc JOIN fo ON fo.entity_id = group_id AND target_date BETWEEN test_start AND test_end GROUP BY 1, 2", MK, PW, PR, OCP, FOLDS),
)
register(
    "q05_split_at_date", lambda t: B.split_at(B.sequence_samples(t.obs, 5), "target_date", "1999-12-31").groupBy("entity_id", "split").agg(F.count("*").alias("n")),
    q(f"SELECT entity_id, CASE WHEN td <= DATE '1999-12-31' THEN 'TRAIN' ELSE 'VALIDATION' END AS split, count(*) AS n FROM (SELECT entity_id, row_number() OVER {ENT}) AS k, lead(obs_date) OVER {ENT}) AS td FROM obs) WHERE k >= 5 AND td IS NOT NULL GROUP BY 1, 2"),
)
register(
    "q06_sequence_samples",
    lambda t: B.sequence_samples(t.obs, 3).select("entity_id", "window_end", "target_date", F.transform("rows", lambda x: x["positions"]).alias("features"), F.array_join(F.col("target").cast("array<string>"), "").alias("target")),
    q(f"SELECT entity_id, {day('obs_date', 'window_end')}, {day('td', 'target_date')}, f AS features, tg AS target FROM (SELECT entity_id, obs_date, row_number() OVER {ENT}) AS k, lead(obs_date) OVER {ENT}) AS td, lead(head || pair || tail) OVER {ENT}) AS tg, string_agg(head || pair || tail, ',') OVER {ENT} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS f FROM obs) WHERE k >= 3 AND td IS NOT NULL"),
)
TOTAL = " + ".join(L.POSITIONS)
register(
    "q07_history_dataset", lambda t: B.history_dataset(t.obs),
    q(f"SELECT {IDS}, " + ", ".join(f"coalesce(lag({p}, {k}) OVER {ENT}), 0) AS {p}_lag_{k}" for p in L.POSITIONS for k in L.LAGS) + ", "
      + ", ".join(f"{r(f'round(coalesce(avg(({TOTAL}) / 8.0) OVER {ENT} {back(n)}), 0), 8)', f'rolling_mean_{n}')}, CAST(coalesce(sum({TOTAL}) OVER {ENT} {back(n)}), 0) AS BIGINT) AS rolling_sum_{n}" for n in (3, 7, 14))
      + ", coalesce(" + " + ".join(f"abs(lag({p}) OVER {ENT}) - lag({p}, 2) OVER {ENT}))" for p in L.POSITIONS) + ", 0) AS change_sum, CAST(isodow(obs_date) - 1 AS INTEGER) AS day_of_week, CAST(month(obs_date) AS INTEGER) AS month, CAST(quarter(obs_date) AS INTEGER) AS quarter, CAST(year(obs_date) AS INTEGER) AS year, "
      + ", ".join(f"{p} AS target_{p}" for p in ("p4", "p5", "p6", "p7", "p8")) + " FROM obs"),
)
CW = f"(PARTITION BY entity_id, p1 ORDER BY obs_date {PRIOR})"
register(
    "f25_conditional_rates", lambda t: B.conditional_rates(t.obs),
    q(f"SELECT {IDS}, p1, count(*) OVER {CW} AS support, {doubles(per_digit(f'coalesce(count(*) FILTER (p4 = {{d}}) OVER {CW} / nullif(count(*) OVER {CW}, 0)::DOUBLE, 0)'), 'rates')} FROM obs"),
)

# -- R ------------------------------------------------------------------------


def damaged(t):
    """Observations with malformed tails and shifted digits, to exercise the rules."""
    return t.obs.withColumns(
        {
            "tail": F.when(F.col("p6") == 4, F.substring("tail", 1, 2)).otherwise(F.col("tail")),
            "p3": F.when(F.col("p1") == 2, F.col("p3") + 10).otherwise(F.col("p3")),
            "pair": F.when(F.col("p5") == 8, F.lit("00")).otherwise(F.col("pair")),
        }
    )


MSG = "CASE WHEN entity_id <= 0 THEN 'INVALID_ENTITY' WHEN p6 = 4 THEN 'INVALID_TAIL' WHEN p1 = 2 THEN 'INVALID_DIGIT_P3' WHEN p5 = 8 THEN 'MISMATCH_PAIR' END"
register(
    "r01_record_checks", lambda t: Q.record_checks(damaged(t)),
    q(f"SELECT obs_id, entity_id, {day('obs_date')}, CASE WHEN {MSG} IS NULL THEN 'VALID' ELSE 'INVALID' END AS status, {MSG} AS message FROM obs"),
)
register(
    "e12_quality_summary", lambda t: A.status_summary(Q.record_checks(damaged(t))),
    q(f"SELECT entity_id, n AS n_records, v AS n_valid, CAST(0 AS BIGINT) AS n_warning, n - v AS n_invalid, {r('v * 100.0 / n', 'valid_pct')}, CASE WHEN v * 100.0 / n >= 99 THEN 'EXCELLENT' WHEN v * 100.0 / n >= 95 THEN 'GOOD' WHEN v * 100.0 / n >= 90 THEN 'FAIR' ELSE 'NEEDS_REVIEW' END AS quality FROM (SELECT entity_id, count(*) AS n, count(*) FILTER ({MSG} IS NULL) AS v FROM obs GROUP BY 1)"),
)
register(
    "c05_records_by_status", lambda t: Q.record_checks(damaged(t)).where((F.col("status") == "INVALID") & F.col("obs_date").between("1997-01-01", "1999-12-31")).select("obs_id", "message"),
    q(f"SELECT obs_id, {MSG} AS message FROM obs WHERE {MSG} IS NOT NULL AND obs_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'"),
)
register(
    "r02_classification_mismatches",
    lambda t: Q.classification_mismatches(t.obs, sc.classify(t.obs).withColumn("pair_class", F.when(F.col("obs_id") % 10 == 0, "X").otherwise(F.col("pair_class")))),
    q("SELECT obs_id, 'pair_class' AS mismatched FROM obs WHERE obs_id % 10 = 0"),
)
register(
    "r03_integrity_issues",
    lambda t: Q.integrity_issues(damaged(t), sc.entity_listing(t.obs).where("entity_id <> 7"), raw_cells(t)).groupBy("code", "severity", "table_name").agg(F.count("*").alias("n"), F.min("record_id").alias("first_record")),
    q("""SELECT code, severity, 'observations' AS table_name, count(*) AS n, min(id) AS first_record FROM (
      SELECT 'BAD_TAIL' AS code, 'ERROR' AS severity, CAST(obs_id AS VARCHAR) AS id FROM obs WHERE p6 = 4 UNION ALL SELECT 'DERIVED_TAIL', 'ERROR', CAST(obs_id AS VARCHAR) FROM obs WHERE p6 = 4
      UNION ALL SELECT 'DERIVED_HEAD', 'ERROR', CAST(obs_id AS VARCHAR) FROM obs WHERE p1 = 2 UNION ALL SELECT 'DERIVED_PAIR', 'ERROR', CAST(obs_id AS VARCHAR) FROM obs WHERE p5 = 8 AND p4 >= 0
      UNION ALL SELECT 'DUPLICATE_KEY', 'ERROR', entity_id || '|' || d FROM (SELECT CAST(o_custkey // 50 AS INTEGER) AS entity_id, CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1)
      UNION ALL SELECT 'ORPHAN_ENTITY', 'ERROR', CAST(obs_id AS VARCHAR) FROM obs WHERE entity_id = 7) GROUP BY 1, 2"""),
)
GAP = f"gp AS (SELECT entity_id, lag(obs_date) OVER {ENT}) AS gap_start, obs_date AS gap_end FROM obs)"
register(
    "r04_date_gaps", lambda t: Q.date_issues(t.obs),
    q(f"SELECT entity_id, {day('gap_start')}, {day('gap_end')}, CAST(gap_end - gap_start AS INTEGER) AS gap_days, CAST(gap_end - gap_start - 1 AS INTEGER) AS missing_days FROM gp WHERE gap_end - gap_start > 1", GAP),
)
register(
    "h05_missing_dates", lambda t: Q.missing_dates(t.obs),
    q(f"SELECT entity_id, {day('CAST(d AS DATE)', 'missing_date')} FROM (SELECT entity_id, unnest(generate_series(CAST(min(obs_date) AS TIMESTAMP), CAST(max(obs_date) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM obs GROUP BY 1) c WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.entity_id = c.entity_id AND o.obs_date = CAST(c.d AS DATE))"),
)


def supplied_history(t):
    """Raw rows around one cut date per entity: some follow it, some repeat a date."""
    cut = F.date_add(F.lit("1998-01-01").cast("date"), F.col("entity_id") * 300 - 2000)
    return raw_cells(t).withColumn("target_date", cut)


register(
    "r05_history_leakage", lambda t: Q.leakage(supplied_history(t)),
    q(f"SELECT entity_id, {day('t', 'target_date')}, count(*) AS n_rows, count(*) FILTER (d > t) AS n_future, count(*) FILTER (d = t) AS n_target_date, count(*) - count(DISTINCT d) AS n_duplicates, CASE WHEN count(*) FILTER (d >= t) > 0 OR count(*) > count(DISTINCT d) THEN 'LEAKAGE' ELSE 'CLEAN' END AS status FROM (SELECT *, DATE '1998-01-01' + (entity_id * 300 - 2000) AS t FROM (SELECT CAST(o_custkey // 50 AS INTEGER) AS entity_id, CAST(o_orderdate AS DATE) AS d FROM orders)) GROUP BY 1, t"),
)
register(
    "r06_sequence_leakage",
    lambda t: Q.sequence_leakage(
        B.sequence_samples(t.obs, 4).withColumn("target_date", F.when(F.weekday("target_date") == 0, F.col("window_end")).otherwise(F.col("target_date"))), t.obs),
    q(f"SELECT entity_id, {day('t', 'target_date')}, CAST(sum(4) AS BIGINT) AS n_rows, CAST(sum(late) AS BIGINT) AS n_late, CAST(0 AS BIGINT) AS n_mismatched, CASE WHEN sum(late) > 0 THEN 'LEAKAGE' ELSE 'CLEAN' END AS status FROM (SELECT entity_id, CASE WHEN isodow(td) = 1 THEN obs_date ELSE td END AS t, CASE WHEN isodow(td) = 1 THEN 1 ELSE 0 END AS late FROM (SELECT entity_id, obs_date, row_number() OVER {ENT}) AS k, lead(obs_date) OVER {ENT}) AS td FROM obs) WHERE k >= 4 AND td IS NOT NULL) GROUP BY 1, t"),
)
register(
    "r07_feature_quality", lambda t: Q.feature_quality(feature_values(t)),
    q(f"SELECT feature_name, count(*) AS n_rows, count(*) - count(value) AS n_missing, CAST(0 AS BIGINT) AS n_non_finite, {r('min(value)', 'min')}, {r('max(value)', 'max')}, {r('avg(value)', 'mean')}, min(value) = max(value) AS is_constant FROM fv GROUP BY 1", FV),
)
HASH = "CAST('0x' || substr(sha256(concat_ws('|', CAST(obs_id AS VARCHAR), CAST(entity_id AS VARCHAR), CAST(obs_date AS VARCHAR), head, pair, tail)), 1, 8) AS BIGINT)"
FIELDS = ("obs_id", "entity_id", "obs_date", "head", "pair", "tail")
register(
    "r09_dataset_fingerprint", lambda t: Q.fingerprint(t.obs, FIELDS, ["entity_id"]),
    q(f"SELECT entity_id, count(*) AS n_rows, CAST(sum(h) AS BIGINT) AS hash_sum, max(h) AS hash_max FROM (SELECT entity_id, {HASH} AS h FROM obs) GROUP BY 1"),
)
register(
    "r10_version_identity", lambda t: Q.version_identity(t.obs, "observations", FIELDS),
    q(f"SELECT 'observations' AS name, n AS n_rows, sha256('observations|obs_id,entity_id,obs_date,head,pair,tail|' || n || '|' || s) AS identity FROM (SELECT count(*) AS n, CAST(sum({HASH}) AS BIGINT) AS s FROM obs)"),
)

# -- H, D ---------------------------------------------------------------------


def attributes(t, cut):
    rows = t.obs.where(F.col("obs_date") < cut).groupBy("entity_id").agg(
        F.count("*").cast("string").alias("n_rows"), F.min("obs_date").cast("string").alias("first_date"), F.max("obs_date").cast("string").alias("last_date"))
    return rows.unpivot(["entity_id"], ["n_rows", "first_date", "last_date"], "attribute", "value")


def attr_sql(cut: str) -> str:
    src = f"(SELECT entity_id, CAST(count(*) AS VARCHAR) AS n_rows, CAST(min(obs_date) AS VARCHAR) AS first_date, CAST(max(obs_date) AS VARCHAR) AS last_date FROM obs WHERE obs_date < DATE '{cut}' GROUP BY 1)"
    return f"(SELECT * FROM {src} UNPIVOT (value FOR attribute IN (n_rows, first_date, last_date)))"


register(
    "h06_version_differences", lambda t: Q.version_diff(attributes(t, "1999-01-01"), attributes(t, "2000-01-01"), ("entity_id", "attribute")),
    q(f"SELECT entity_id, attribute, a.value AS first_value, b.value AS second_value FROM {attr_sql('1999-01-01')} a FULL JOIN {attr_sql('2000-01-01')} b USING (entity_id, attribute) WHERE a.value IS DISTINCT FROM b.value"),
)
register(
    "h01_feature_union",
    lambda t: Q.feature_union({"lag": W.lag_features(t.obs, (1,), ("p1", "p8")), "rolling": W.rolling_features(t.obs, (3,), ("p1",)), "interval": W.interval_features(t.obs).select("entity_id", "obs_date", "mean_gap")}),
    q(f"SELECT {IDS}, lag(p1) OVER {ENT}) AS p1_lag_1, lag(p8) OVER {ENT}) AS p8_lag_1, count(*) OVER {ENT} {back(3)}) AS rows_3, {r(f'avg(p1) OVER {ENT} {back(3)})', 'p1_mean_3')}, min(p1) OVER {ENT} {back(3)}) AS p1_min_3, max(p1) OVER {ENT} {back(3)}) AS p1_max_3, {r(f'avg(gap) OVER {ENT} {PRIOR})', 'mean_gap')} FROM (SELECT *, date_diff('day', lag(obs_date) OVER {ENT}), obs_date) AS gap FROM obs)"),
)
register(
    "h03_code_differences",
    lambda t: Q.name_differences(t.obs.where("obs_date < date'1995-06-01'").select(F.col("tail").alias("feature_name")), t.obs.where("obs_date >= date'2001-01-01'").select(F.col("tail").alias("feature_name"))),
    q("SELECT tail AS feature_name, 'missing' AS side FROM (SELECT DISTINCT tail FROM obs WHERE obs_date < DATE '1995-06-01' EXCEPT SELECT tail FROM obs WHERE obs_date >= DATE '2001-01-01') UNION ALL SELECT tail, 'orphan' FROM (SELECT DISTINCT tail FROM obs WHERE obs_date >= DATE '2001-01-01' EXCEPT SELECT tail FROM obs WHERE obs_date < DATE '1995-06-01')"),
)
register(
    "c08_available_features",
    lambda t: t.obs.select("entity_id", F.col("obs_date").alias("target_date"), F.date_add("obs_date", (F.col("p1") - 5)).alias("available_date")).groupBy("entity_id").agg(
        F.count_if(F.col("available_date") < F.col("target_date")).alias("n_available"), F.count_if(F.col("available_date") >= F.col("target_date")).alias("n_rejected")),
    q("SELECT entity_id, count(*) FILTER (p1 < 5) AS n_available, count(*) FILTER (p1 >= 5) AS n_rejected FROM obs GROUP BY 1"),
)
register(
    "d07_features_with_outcomes",
    lambda t: feature_values(t).where("feature_name = 'gap_days' and value is not null").join(t.obs.select("entity_id", F.col("obs_date").alias("target_date"), "p4"), ["entity_id", "target_date"]).groupBy("p4").agg(F.count("*").alias("n"), F.avg("value").alias("mean_gap")),
    q(f"SELECT p4, count(g) AS n, {r('avg(g)', 'mean_gap')} FROM (SELECT p4, date_diff('day', lag(obs_date) OVER {ENT}), obs_date) AS g FROM obs) WHERE g IS NOT NULL GROUP BY 1"),
)

# -- O15..O20 -----------------------------------------------------------------


def yearly(t):
    """Accuracy of both models per year as metric values."""
    rows = both_models(t).withColumn("year", F.year("obs_date"))
    return E.evaluate(rows, ["model", "year"]).select("model", "year", "accuracy", "log_loss", "top_k_accuracy")


YR = "yr AS (SELECT model, CAST(year(obs_date) AS INTEGER) AS year, avg((list_position(probs, list_max(probs)) - 1 = target)::INTEGER) AS accuracy, avg(-ln(greatest(probs[target + 1], 1e-15))) AS log_loss FROM bm GROUP BY 1, 2)"


def alert_rules(t):
    return t.spark.createDataFrame(
        [("accuracy", 0.2, "WARNING", "lt", True), ("log_loss", 2.2, "CRITICAL", "gte", True), ("log_loss", 2.0, "INFO", "gt", False)],
        "metric string, threshold double, severity string, operator string, enabled boolean",
    )


register(
    "o15_alerts", lambda t: Q.alerts(yearly(t).drop("top_k_accuracy").unpivot(["model", "year"], ["accuracy", "log_loss"], "metric", "value"), alert_rules(t)).drop("enabled"),
    q(f"SELECT model, year, 'accuracy' AS metric, {r('accuracy', 'value')}, {r('0.2', 'threshold')}, 'WARNING' AS severity, 'lt' AS operator, accuracy < 0.2 AS active FROM yr UNION ALL SELECT model, year, 'log_loss', {r('log_loss', 'value')}, {r('2.2', 'threshold')}, 'CRITICAL', 'gte', log_loss >= 2.2 FROM yr", MK, F0, YR),
)


def healths(t):
    rows = yearly(t).select("model", "year", F.inline(F.array(
        F.struct(F.lit("accuracy").alias("component"), (F.col("accuracy") * 2).alias("score"), F.lit(2.0).alias("weight")),
        F.struct(F.lit("calibration").alias("component"), F.exp(-F.col("log_loss") / 4).alias("score"), F.lit(1.0).alias("weight")))))
    return Q.health(rows, ["model", "year"], 0.55, 0.4)


HL = "hl AS (SELECT model, year, s, CASE WHEN s >= 0.55 THEN 'HEALTHY' WHEN s >= 0.4 THEN 'DEGRADED' ELSE 'CRITICAL' END AS status FROM (SELECT model, year, (accuracy * 4 + exp(-log_loss / 4)) / 3 AS s FROM yr))"
register("o16_health_score", lambda t: healths(t), q(f"SELECT model, year, {r('s', 'health_score')}, CAST(2 AS BIGINT) AS n_components, status FROM hl", MK, F0, YR, HL))
register(
    "o17_period_comparison",
    lambda t: (lambda y: Q.compare_periods(y.where("year = 1996 and metric = 'accuracy'"), y.where("year = 2000"), ("model", "metric")))(yearly(t).drop("top_k_accuracy").unpivot(["model", "year"], ["accuracy", "log_loss"], "metric", "value")),
    q(f"SELECT model, metric, {r('a', 'baseline')}, {r('b', 'comparison')}, {r('b - a', 'change')}, {r('(b - a) / nullif(abs(a), 0)', 'relative_change')}, CASE WHEN a IS NULL THEN 'ONLY_COMPARISON' WHEN b IS NULL THEN 'ONLY_BASELINE' WHEN b > a THEN 'IMPROVED' WHEN b < a THEN 'DECLINED' ELSE 'UNCHANGED' END AS outcome FROM (SELECT model, 'accuracy' AS metric, max(accuracy) FILTER (year = 1996) AS a, max(accuracy) FILTER (year = 2000) AS b FROM yr GROUP BY 1 UNION ALL SELECT model, 'log_loss', NULL, max(log_loss) FILTER (year = 2000) FROM yr GROUP BY 1)", MK, F0, YR),
)
register(
    "o18_champion_challenger",
    lambda t: Q.challengers(healths(t).select("model", "year", F.col("health_score").alias("score"), "status"), "frequency", 0.5, ("year",)),
    q(f"SELECT c.model, c.year, {r('c.s', 'score')}, c.status, {r('b.s', 'champion_score')}, {r('c.s - b.s', 'improvement')}, CASE WHEN c.s >= 0.5 AND c.status = 'HEALTHY' AND c.s > b.s THEN 'PROMOTE' ELSE 'HOLD' END AS decision, CAST(1 AS INTEGER) AS preference FROM hl c JOIN hl b ON b.year = c.year AND b.model = 'frequency' WHERE c.model <> 'frequency'", MK, F0, YR, HL),
)
def evidence(t):
    """Three kinds of evidence a model and year: under a rule, without one, under a disabled one."""
    item = lambda metric, latest, base, periods, hit: F.struct(F.lit(metric).alias("metric"), latest.cast("double").alias("latest_value"), F.lit(base).alias("baseline_value"), periods.cast("int").alias("consecutive_periods"), hit.alias("triggered"))
    loss, year = F.col("log_loss"), F.col("year")
    items = F.array(
        item("log_loss", loss, 1.6, year - 1994, loss > 1.65), item("unruled", year, 1990.0, F.lit(1), (year == 1996) & (F.col("model") == "frequency")),
        item("paused", loss, 0.0, F.lit(9), (year == 1997) & (F.col("model") == "frequency")),
    )
    return yearly(t).select("model", "year", F.lit("monitor").alias("source_type"), F.inline(items))


register(
    "o19_retraining_decision",
    lambda t: Q.retraining_decision(
        evidence(t), t.spark.createDataFrame([("monitor", "log_loss", 0.1, 4, True), ("monitor", "paused", 99.0, 99, False)],
                                             "source_type string, metric string, threshold double, min_consecutive_periods int, enabled boolean"), ("model", "year")),
    q("""SELECT model, year, count(*) AS n_evidence, count(*) FILTER (ok) AS n_qualifying, count(*) FILTER (hit AND NOT ok) AS n_supporting, CASE WHEN bool_or(ok) THEN 'RETRAIN' ELSE 'HOLD' END AS decision
      FROM (SELECT model, year, log_loss > 1.65 AS hit, log_loss > 1.65 AND year - 1994 >= 4 AND abs(log_loss - 1.6::DOUBLE) >= 0.1::DOUBLE AS ok FROM yr
        UNION ALL SELECT model, year, year = 1996 AND model = 'frequency', year = 1996 AND model = 'frequency' FROM yr
        UNION ALL SELECT model, year, year = 1997 AND model = 'frequency', year = 1997 AND model = 'frequency' FROM yr) GROUP BY 1, 2""", MK, F0, YR),
)
FB = f"""fb AS (SELECT *, row_number() OVER w AS rn FROM (SELECT *, coalesce(actual_rank = 1, false) AS hit, coalesce(actual_rank <= 3, false) AS near FROM oc) WINDOW w AS (PARTITION BY group_id ORDER BY target_date)),
fc AS (SELECT *, rn - coalesce(max(CASE WHEN hit THEN rn END) OVER (PARTITION BY group_id ORDER BY target_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS ms, avg(hit::INTEGER) OVER (PARTITION BY group_id ORDER BY target_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS acc FROM fb)"""
register(
    "o20_feedback", lambda t: Q.feedback(pair_outcomes(t), ("group_id",)).select("group_id", "target_date", "actual_rank", "correct", "top_k_hit", "miss_streak", "recent_accuracy", "error_source", "decision"),
    q(f"SELECT group_id, {day('target_date')}, actual_rank, hit AS correct, near AS top_k_hit, CAST(ms AS INTEGER) AS miss_streak, {r('acc', 'recent_accuracy')}, CASE WHEN hit THEN 'none' WHEN near THEN 'ranking' ELSE 'unknown' END AS error_source, CASE WHEN ms >= 2 OR acc < 0.5 OR (near AND NOT hit) THEN 'RETRAIN' ELSE 'HOLD' END AS decision FROM fc", MK, PW, PR, OCP, FB),
)
