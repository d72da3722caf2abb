"""Decoding, selection, run comparison, feedback and the modelling table against enumeration and plain loops."""

import itertools
import math
from collections import defaultdict
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsframe import layout as L
from test_sequential import SCHEMA, START, by_entity, digit_rows


def small_model(states=3, seed=4):
    from obsframe.operators.hidden_markov import first_model

    rng = np.random.default_rng(seed)
    m = first_model(states, seed)
    m.start, m.moves, m.emits = (rng.dirichlet(np.ones(s.shape[-1]), s.shape[:-1]) for s in (m.start, m.moves, m.emits))
    return m


def enumerated(m, x):
    """(best path, posteriors, filtered, log likelihood) by going through all paths."""
    k, n = len(m.start), len(x)
    paths = list(itertools.product(range(k), repeat=n))
    def weight(path, upto):
        w = m.start[path[0]] * m.emits[path[0], x[0]]
        for t in range(1, upto):
            w *= m.moves[path[t - 1], path[t]] * m.emits[path[t], x[t]]
        return w
    whole = np.array([weight(p, n) for p in paths])
    post = np.array([[sum(w for p, w in zip(paths, whole) if p[t] == s) for s in range(k)] for t in range(n)]) / whole.sum()
    filtered = []
    for t in range(1, n + 1):
        part = np.array([weight(p, t) for p in itertools.product(range(k), repeat=t)])
        filtered.append([sum(w for p, w in zip(itertools.product(range(k), repeat=t), part) if p[-1] == s) / part.sum() for s in range(k)])
    return list(paths[int(whole.argmax())]), post, np.array(filtered), math.log(whole.sum())


def test_decoding_equals_enumeration():
    from obsframe.operators.hidden_markov import best_paths, group_sums, matrices, smoothed_states

    m, rng = small_model(), np.random.default_rng(1)
    series = [rng.integers(0, 10, n) for n in (1, 5, 3, 6, 2, 0, 6)]
    done, first, moves = 0, np.zeros(3), np.zeros((3, 3))
    for places, x, lengths in matrices(series):
        filtered, post, _, ll = smoothed_states(m, x, lengths)
        paths = best_paths(m, x, lengths)
        for row, (place, n) in enumerate(zip(places, lengths)):
            path, want, known, total = enumerated(m, series[place])
            assert paths[row, :n].tolist() == path and (paths[row, n:] == -1).all()
            assert np.allclose(post[row, :n], want) and np.allclose(filtered[row, :n], known) and ll[row] == pytest.approx(total)
            first += want[0]
            done += 1
    flat = group_sums(m, series)
    assert done == 6 and np.allclose(flat[:3], first) and flat[-1] == 23
    assert flat[3:12].sum() == pytest.approx(23 - 6)  # one expected move between neighbours


def test_fit_converges_and_finds_two_regimes(spark):
    from obsframe.operators.hidden_markov import decode, fit_models, next_symbol_rows

    rng = np.random.default_rng(2)
    rows = []
    for e in range(8):
        state, symbols = 0, []
        for _ in range(150):
            state = state if rng.random() < 0.95 else 1 - state
            symbols.append(int(rng.integers(0, 3) + 6 * state))
        rows.append((e, "p1", symbols))
    rows += [(9, "p2", [4] * 30), (10, "p1", [])]
    seqs = spark.createDataFrame(rows, "entity_id int, position string, symbols array<int>").repartition(3)
    models = fit_models(seqs, states=2, rounds=60, tolerance=1e-4)
    assert set(models) == {"p1", "p2"} and all(m.converged for m in models.values())
    m = models["p1"]
    assert sorted(m.emits[:, :3].sum(axis=1).round()) == [0, 1] and np.diag(m.moves).min() > 0.85
    got = {r.entity_id: r for r in decode(seqs, models).collect()}
    assert set(got) == {*range(8), 9}
    for r in rows[:8]:
        high = int(m.emits[:, 6:].sum(axis=1).argmax())
        assert np.mean([(s >= 6) == (p == high) for s, p in zip(r[2], got[r[0]].path)]) > 0.95  # a lone step may be taken for noise
        assert len(got[r[0]].posteriors) == 150 and sum(got[r[0]].next_probs) == pytest.approx(1)
    steps = next_symbol_rows(seqs, models).collect()
    assert len(steps) == 8 * 149 + 29 and {r.step for r in steps} == set(range(1, 150))


def test_joint_search_equals_brute_force(spark):
    from obsframe.operators.ranking import tail_candidates
    from obsframe.operators.selection import PLACES, rank_in_families, select_jointly

    rng, tails = np.random.default_rng(7), tail_candidates()
    rows = [(i, f"{i % 100:02d}", *[rng.dirichlet(np.ones(10)).tolist() for _ in range(5)]) for i in range(4)]
    rows += [(4, "07", *[[0.1] * 10] * 5), (5, "33", None, *[[0.1] * 10] * 4)]  # all equal, and a null
    df = spark.createDataFrame(rows, "id int, pair string, q4 array<double>, q5 array<double>, q6 array<double>, q7 array<double>, q8 array<double>")
    got = defaultdict(list)
    for r in select_jointly(df, ["q4", "q5", "q6", "q7", "q8"], tails, ["id"], 7).orderBy("id", "rank").collect():
        got[r.id].append((r.pair, r.first_tail, r.second_tail, r.joint_score))
    families = defaultdict(dict)
    assert set(got) == {0, 1, 2, 3, 4}
    for i, _, q4, q5, q6, q7, q8 in rows[:5]:
        total = sum(a * b for a in q4 for b in q5)
        pairs = {f"{a}{b}": round(q4[a] * q5[b] / total, PLACES) for a in range(10) for b in range(10)}
        raw = {c: q6[int(c[0])] * q7[int(c[1])] * q8[int(c[2])] for c, _ in tails}
        for f in range(10):
            mass = sum(raw[c] for c, g in tails if g == f)
            families[f] = {c: round(raw[c] / mass, PLACES) for c, g in tails if g == f}
        pool = [(-(p * x * y), pair, a, b) for pair, p in pairs.items() for a, x in families[int(pair[0])].items() for b, y in families[int(pair[1])].items()]
        want = sorted(pool)[:7]
        assert [g[:3] for g in got[i]] == [w[1:] for w in want] and [g[3] for g in got[i]] == pytest.approx([-w[0] for w in want])
    ranked = rank_in_families(df, ["q6", "q7", "q8"], tails, ["id"], "pair", 3).where("id = 4").orderBy("side", "rank").collect()
    assert [(r.side, r.digit, r.rank, r.code) for r in ranked] == [("first", "0", k, c) for k, c in enumerate(sorted(c for c, f in tails if f == 0)[:3], 1)] + [("second", "7", k, c) for k, c in enumerate(sorted(c for c, f in tails if f == 7)[:3], 1)]
    with pytest.raises(ValueError):
        select_jointly(df, ["q4"], tails, ["id"], 0)


def test_runs_are_told_apart_by_content_alone(spark):
    from obsframe.operators.run_comparison import differing_cells, differing_ranges, range_digests, rolled_up, run_verdict

    rows = [(i, i % 7, f"v{i % 13}", None if i % 5 else 1.5) for i in range(400)]
    schema = "id int, a int, b string, c double"
    first = spark.createDataFrame(rows, schema).repartition(5)
    permuted = spark.createDataFrame(rows[::-1], schema).repartition(3)
    assert differing_ranges(first, permuted, ["id"]).count() == 0 and differing_cells(first, permuted, ["id"]).count() == 0
    assert run_verdict(first, permuted, ["id"]).first().status == "REPRODUCIBLE"
    changed = [(i, a, "other" if i == 77 else b, c) for i, a, b, c in rows]
    second = spark.createDataFrame(changed, schema)
    found = differing_ranges(first, second, ["id"]).orderBy("level").collect()
    assert [(r.level, r.column, len(r.key_range)) for r in found] == [(k, "b", k) for k in range(4)] and found[0].first_rows == 400
    assert [tuple(r) for r in differing_cells(first, second, ["id"]).collect()] == [(77, "b", "v12", "other")]
    # two exchanged values keep every column's multiset of values, but not the cells' digests
    swapped = [(i, {3: 4, 4: 3}.get(i, i) % 7, b, c) for i, a, b, c in rows]
    assert {r.id for r in differing_cells(first, spark.createDataFrame(swapped, schema), ["id"]).collect()} == {3, 4}
    missing = differing_cells(first, spark.createDataFrame(rows[1:], schema), ["id"]).collect()
    assert {(r.id, r.column, r.first_value, r.second_value) for r in missing} == {(0, "a", "0", None), (0, "b", "v0", None), (0, "c", "1.5", None)}
    verdict = run_verdict(first, second, ["id"]).first()
    assert (verdict.status, verdict.differing_columns, verdict.first_rows) == ("DIFFERENT", "b", 400)
    assert run_verdict(first.limit(0), second.limit(0), ["id"]).first().status == "REPRODUCIBLE"
    digests = range_digests(first, ["id"])
    whole = {r.column: (r.low, r.high) for r in rolled_up(digests, 3).where("level = 0").collect()}
    assert whole == {r.column: (r.low, r.high) for r in range_digests(permuted, ["id"], depth=0).collect()}


def test_feedback_follows_flags_not_ranks(spark):
    from obsframe.operators import feedback as B

    probs = lambda top: [0.55 if d == top else 0.05 for d in range(10)]
    rows = [(1, START + timedelta(days=i), target, probs(3), ok) for i, (target, ok) in enumerate([(3, True), (0, True), (3, False), (9, False), (9, None), (3, True)])]
    df = spark.createDataFrame(rows, "entity_id int, obs_date date, target int, probs array<double>, ok boolean")
    out = B.prediction_outcomes(df)
    got = B.retraining(B.diagnosed(out, {"ranking_stable": F.col("ok"), "model_stable": F.lit(True)}), recent=2).orderBy("obs_date").collect()
    assert [r.correct for r in got] == [True, False, True, False, False, True]
    assert [r.actual_rank for r in got] == [1, 2, 1, 10, 10, 1] and got[1].top_k_hit and not got[3].top_k_hit and got[3].prediction_error == -6
    # a near miss without a flag is unknown; a correct row is unknown whatever its flags; a null flag is sound
    assert [r.error_source for r in got] == ["unknown", "unknown", "unknown", "ranking", "unknown", "unknown"]
    assert [r.miss_streak for r in got] == [0, 1, 0, 1, 2, 0]
    assert [list(r.reasons) for r in got] == [[], [], [], [B.LOW_ACCURACY, B.DIAGNOSED], [B.LOW_ACCURACY, B.LONG_STREAK], [B.LOW_ACCURACY]]
    assert got[3].evidence == ["CURRENT_PREDICTION_MISS", "CURRENT_TOP_K_MISS", "RECENT_ACCURACY=0.333333", "ERROR_SOURCE=ranking"]
    assert [r.decision for r in got] == ["HOLD"] * 3 + ["RETRAIN"] * 3 and len(got[3].actions) == 5 and got[0].actions == []
    both = B.diagnosed(out, {"distribution_stable": F.lit(False), "feature_stable": F.lit(False)}).where("NOT correct").first()
    assert both.error_source == "feature" and both.error_evidence == ["feature", "distribution_shift"]
    counts = {r.error_source: r.n_misses for r in B.error_breakdown(B.diagnosed(out, {"ranking_stable": F.col("ok")})).collect()}
    assert counts["ranking"] == 1 and counts["unknown"] == 2 and len(counts) == 8 and counts["data_quality"] == 0
    with pytest.raises(ValueError):
        B.diagnosed(out, {"luck": F.lit(False)})


def test_promotion_needs_every_gate(spark):
    from obsframe.operators import feedback as B

    names = "champion_accuracy champion_validation_accuracy champion_walk_forward_accuracy challenger_accuracy challenger_validation_accuracy challenger_walk_forward_accuracy".split()
    table = lambda rows: spark.createDataFrame(rows, "entity_id int, " + ", ".join(f"{n} double" for n in names))
    rows = [(1, 0.5, 0.5, 0.5, 0.6, 0.5, 0.5), (2, 0.5, 0.5, 0.5, 0.505, 0.4, 0.4), (3, 0.2, 0.2, 0.2, 0.3, 0.3, 0.3)]
    got = {r.entity_id: r for r in B.promotions(table(rows)).collect()}
    assert got[1].promotion == "PROMOTE" and got[1].promotion_reasons == [B.PASSED] and got[1].gain == pytest.approx(0.1)
    assert got[2].promotion_reasons == [B.VALIDATION, B.WALK_FORWARD, B.GAIN] and got[3].promotion_reasons == [B.FLOOR]
    assert B.promotions(table(rows), need_walk_forward=False).where("entity_id = 2").first().promotion_reasons == [B.VALIDATION, B.GAIN]
    with pytest.raises(Exception, match="must be a share"):
        B.promotions(table([(1, 1.5, 0.5, 0.5, 0.6, 0.5, 0.5)])).collect()
    assessed = spark.createDataFrame([(1, "RETRAIN"), (1, "HOLD"), (8, "RETRAIN")], "entity_id int, decision string")
    cycle = sorted((r.entity_id, r.decision, r.promotion, r.promotion_reasons[0], round(r.gain, 6)) for r in B.feedback_cycle(assessed, B.promotions(table(rows))).collect())
    assert cycle == [(1, "HOLD", "REJECT", B.NOT_TRIGGERED, 0), (1, "RETRAIN", "PROMOTE", B.PASSED, 0.1), (8, "RETRAIN", "REJECT", B.NO_COMPARISON, 0)]
    assert {r.promotion_reasons[0] for r in B.feedback_cycle(assessed).collect()} == {B.NO_COMPARISON}


def test_modelling_rows_use_only_what_came_before(spark):
    from obsframe.operators.modelling import feature_groups, feature_columns, modelling_rows

    rows = digit_rows(20, 2, 3)
    table = modelling_rows(spark.createDataFrame(rows, SCHEMA))
    got = {(r.entity_id, r.obs_date): r for r in table.collect()}
    for e, own in by_entity(rows).items():
        for i, r in enumerate(own):
            g, flat = got[e, r[1]], [x for old in own[max(0, i - 7) : i] for x in old[2:]]
            assert g.rolling_7_sum == sum(flat) and g.rolling_7_std == pytest.approx(round(float(np.std(flat)), 8) if flat else 0, abs=2e-8)
            assert g.rolling_7_digit_4_rate == (round(flat.count(4) / len(flat), 8) if flat else 0)
            assert g.lag_2_p5 == (own[i - 2][6] if i > 1 else 0) and g.current_p2 == r[3] and g.target_p8 == r[9]
            assert g.pair_change_sum == (sum(abs(a - b) for a, b in zip(own[i - 1][5:7], own[i - 2][5:7])) if i > 1 else 0)
    groups = feature_groups(feature_columns(table))
    assert {k: len(v) for k, v in groups.items()} == {"current": 3, "lags": 24, "rolling": 39, "date": 5, "transitions": 3}


def plain_windows(dates, folds=5, least=100):
    n = len(dates)
    train, check = max(least, int(n * 0.7)), max(1, int(n * 0.15))
    if n < least + 3 or n - train - check < 1:
        return []
    begin, out = train + check, []
    k = min(folds, n - begin)
    size = max(1, (n - begin) // k)
    for i in range(k):
        a = begin + i * size
        b = n if i == k - 1 else min(n, a + size)
        v = max(train, a - check)
        if a < b and v >= least:
            out.append((i + 1, dates[0], dates[v - 1], dates[v], dates[a - 1], dates[a], dates[b - 1], v, a - v, b - a))
    return out


@pytest.mark.parametrize("n", [50, 103, 117, 120, 121, 400])
def test_walk_forward_windows(spark, n):
    from obsframe.operators.modelling import walk_forward_windows

    dates = [START + timedelta(days=2 * i) for i in range(n)]
    got = walk_forward_windows(spark.createDataFrame([(1, d) for d in dates + dates[:3]], "entity_id int, obs_date date")).orderBy("fold").collect()
    assert [tuple(r)[1:] for r in got] == plain_windows(dates)


def test_stability_tells_what_a_tree_needs(spark):
    from obsframe.operators.modelling import modelling_rows, stability_report

    rng, rows = np.random.default_rng(9), []
    for d in range(150):
        for e in range(3):
            head = [int(x) for x in rng.integers(0, 10, 3)]
            rows.append((e, START + timedelta(days=d), *head, head[1], *map(int, rng.integers(0, 10, 4))))
    day = lambda n: START + timedelta(days=n)
    report = {(r.kind, r.name): r for r in stability_report(modelling_rows(spark.createDataFrame(rows, SCHEMA)), [(1, day(119), day(120), day(149))]).collect()}
    assert report["mode", "baseline"].top1 > 0.9 and report["mode", "baseline"].delta_top1 == 0 and report["mode", "baseline"].test_count == 90
    assert report["mode", "remove_current"].delta_top1 < -0.5 and report["mode", "rotate_current"].delta_top1 < -0.5 and report["ablation", "current"].delta_top1 < -0.5
    assert abs(report["mode", "rotate_history"].delta_top1) < 0.15 and abs(report["ablation", "date"].delta_top1) < 0.15
    assert set(n for k, n in report if k == "ablation") == {"current", "lags", "rolling", "date", "transitions"}


def test_retraining_dataset_is_complete_or_an_error(spark):
    from obsframe.operators.retraining import features_with_targets, missing_targets, retraining_dataset

    day = lambda n: START + timedelta(days=n)
    features = spark.createDataFrame([(1, day(i), i * 1.5, None) for i in range(10)] + [(2, day(i), 0.0, "x") for i in range(3)] + [(3, day(0), 0.0, "x")], "entity_id int, obs_date date, f double, g string")
    targets = lambda skip=(), **kw: spark.createDataFrame([(e, day(i), kw.get("value", i % 10)) for e in (1, 2, 3) for i in range(10) if (e, i) not in skip], "entity_id int, obs_date date, target int")
    got = retraining_dataset(features, targets()).collect()
    splits = defaultdict(list)
    for r in sorted(got, key=lambda r: r.obs_date):
        splits[r.entity_id].append(r.split)
    assert splits == {1: ["TRAIN"] * 7 + ["VALIDATION"] + ["TEST"] * 2, 2: ["TRAIN", "VALIDATION", "TEST"]}
    assert len({r.row_identity for r in got}) == 11 and all(len(r.row_identity) == 64 for r in got)
    assert [tuple(r) for r in missing_targets(features, targets({(1, 4), (2, 1)})).orderBy("entity_id").collect()] == [(1, day(4)), (2, day(1))]
    nulls = targets().withColumn("target", F.when(F.col("obs_date") != F.lit(day(2)), F.col("target")))
    assert missing_targets(features, nulls).count() == 2
    for bad in (targets({(1, 4)}), nulls):
        with pytest.raises(Exception, match="no target"):
            features_with_targets(features, bad).collect()
    with pytest.raises(Exception, match="comes twice"):
        features_with_targets(features.unionByName(features), targets()).collect()


def test_split_metrics_and_checks(spark):
    from obsframe.operators.retraining import retraining_checks, split_metrics

    probs = lambda top: [0.55 if d == top else 0.05 for d in range(10)]
    rows = [("TRAIN", 1, probs(1)), ("TRAIN", 2, probs(1)), ("TRAIN", 2, probs(2)), ("TEST", 0, probs(5))]
    scored = spark.createDataFrame(rows, "split string, target int, probs array<double>")
    got = {r.split: r for r in split_metrics(scored).collect()}
    assert got["TRAIN"].row_count == 3 and got["TRAIN"].accuracy == pytest.approx(2 / 3) and got["TRAIN"].f1 == pytest.approx(2 / 3)
    assert got["TEST"].f1 == 0 and got["TEST"].log_loss == pytest.approx(-math.log(0.05))
    checks = {r.check_id: r.status for r in retraining_checks(split_metrics(scored), scored, min_accuracy=0.5).collect()}
    assert checks == {
        "TRAIN_ROWS": "PASS", "TRAIN_REQUIRED": "PASS", "TRAIN_METRIC_BOUNDS": "PASS", "TRAIN_MIN_ACCURACY": "PASS", "VALIDATION_ROWS": "PASS", "VALIDATION_REQUIRED": "FAIL",
        "VALIDATION_METRIC_BOUNDS": "FAIL", "VALIDATION_MIN_ACCURACY": "FAIL", "TEST_ROWS": "PASS", "TEST_REQUIRED": "PASS", "TEST_METRIC_BOUNDS": "PASS", "TEST_MIN_ACCURACY": "FAIL",
    }


def test_explanation_names_the_digit_that_decides(spark):
    from obsframe.operators.modelling import explain_folds, modelling_rows

    rng, rows = np.random.default_rng(9), []
    for d in range(120):
        for e in range(3):
            head = [int(x) for x in rng.integers(0, 10, 3)]
            rows.append((e, START + timedelta(days=d), *head, head[1], *map(int, rng.integers(0, 10, 4))))
    day = lambda n: START + timedelta(days=n)
    importance, digits = explain_folds(modelling_rows(spark.createDataFrame(rows, SCHEMA)), [(1, day(79), day(80), day(99)), (2, day(99), day(100), day(119))])
    first = importance.orderBy("rank").first()
    assert first.feature == "current_p2" and first.n_folds == 2 and first.mean_share > 0.9 and first.std_share < 0.1
    per_digit = digits.collect()
    assert len(per_digit) == 20 and sum(r.support for r in per_digit) == 120
    assert sum(r.top1_hits for r in per_digit) > 108 and all(r.top1_hits <= r.top5_hits <= r.support for r in per_digit)


def test_feature_report_counts_each_violation(spark):
    from obsframe.operators.feature_audit import catalogue_issues, feature_catalogue, feature_ranges, feature_report

    day = lambda n: START + timedelta(days=n)
    rows = [
        (1, day(0), 1, None, 1.0, 5, None), (1, day(1), 2, day(0), float("nan"), 5, 2), (1, day(1), 3, day(1), float("inf"), 5, 3), (1, day(0), 4, day(3), None, 5, 4), (2, day(0), 5, None, 2.0, 5, 5),
    ]
    df = spark.createDataFrame(rows, "entity_id int, obs_date date, seq int, seen date, lag_1_p1 double, rolling_3_sum int, p4 int")
    got = feature_report(df, order="seq", history_end="seen").first()
    assert (got.record_count, got.feature_count, got.missing_values, got.non_finite_values) == (5, 3, 2, 2)
    assert (got.duplicate_dates, got.chronological_violations, got.future_history, got.target_leaks) == (2, 2, 2, 5)
    assert got.constant_features == ["rolling_3_sum"] and got.status == "INVALID"
    sound = df.where("seq = 5").drop("p4", "seen")
    assert feature_report(sound, order="seq").first().status == "VALID" and feature_report(df.limit(0), order="seq").first().status == "VALID"
    ranges = {r.feature_name: (r.min, r.max, r["mean"]) for r in feature_ranges(df, ["lag_1_p1", "rolling_3_sum"]).collect()}
    assert ranges == {"lag_1_p1": (1.0, 2.0, 1.5), "rolling_3_sum": (5.0, 5.0, 5.0)}
    catalogue = feature_catalogue(df.drop("seq", "seen"))
    assert {(r.feature_name, r.position, r.kind, r.window, r.lag) for r in catalogue.collect()} == {("lag_1_p1", "p1", "lag", None, 1), ("rolling_3_sum", None, "rolling", 3, None), ("p4", "p4", "p4", None, None)}
    assert catalogue_issues(df.drop("seq", "seen"), catalogue).count() == 0
    other = spark.createDataFrame([("lag_1_p1", "int"), ("gone", "int"), ("p4", "int"), ("p4", "int")], "feature_name string, data_type string")
    issues = {(r.feature_name, r.issue) for r in catalogue_issues(df.drop("seq", "seen"), other).collect()}
    assert issues == {("lag_1_p1", "TYPE_MISMATCH"), ("gone", "MISSING_COLUMN"), ("rolling_3_sum", "UNDECLARED_COLUMN"), ("p4", "DUPLICATE_NAME")}


def test_stage_and_feedback_issues(spark):
    from obsframe.operators.integrity import entity_summaries, feedback_issues, integrity_report, stage_issues

    day = lambda n: START + timedelta(days=n)
    obs = spark.createDataFrame([(1, day(0), "123", "45"), (1, day(1), "123", "45"), (1, day(5), "000", "00")], "entity_id int, obs_date date, head string, pair string")
    stages = spark.createDataFrame(
        [(1, 1, day(0), "COMPLETED", "123", "4"), (2, 1, day(1), "STAGE_1", "321", "4"), (3, 1, day(2), "COMPLETED", "12", None), (4, 1, day(3), "STAGE_1", "111", "1"), (5, 1, day(5), None, None, "1")],
        "stage_id int, entity_id int, obs_date date, status string, head string, pair_first string")
    got = {(r.record_id, r.code) for r in stage_issues(stages, obs).collect()}
    assert got == {
        ("2", "STAGE_HEAD_DIFFERS"), ("2", "OPEN_WITH_OBSERVATION"), ("3", "BAD_STAGE_HEAD"), ("3", "BAD_STAGE_FIRST"), ("3", "COMPLETED_WITHOUT_OBSERVATION"),
        ("5", "BAD_STAGE_STATUS"), ("5", "BAD_STAGE_HEAD"), ("5", "STAGE_HEAD_DIFFERS"), ("5", "STAGE_FIRST_DIFFERS"),
    }
    feedback = spark.createDataFrame([(1, "PAIR_FIRST", "4", "4", True), (2, "OTHER", "", None, True), (3, "STAGE_2", "5 123", " ", False), (4, None, None, None, None)], "feedback_id int, stage string, predicted_value string, actual_value string, is_correct boolean")
    assert {(r.record_id, r.code) for r in feedback_issues(feedback).collect()} == {
        ("2", "BAD_FEEDBACK_STAGE"), ("2", "EMPTY_PREDICTION"), ("2", "CORRECT_WITHOUT_ACTUAL"), ("3", "EMPTY_ACTUAL"), ("4", "BAD_FEEDBACK_STAGE"), ("4", "EMPTY_PREDICTION")}
    assert [tuple(r) for r in entity_summaries(obs).collect()] == [(1, 3, day(0), day(5), 1, 3)]
    report = {r.table_name: (r.n_rows, r.n_invalid, r.n_warnings, r.status) for r in integrity_report({"stages": stages, "observations": obs}, stage_issues(stages, obs)).collect()}
    assert report == {"stages": (5, 8, 1, "INVALID"), "observations": (3, 0, 0, "VALID")}
    assert stage_issues(stages.limit(0), obs).count() == 0


def test_feature_bundle_writes_its_parts(spark, tmp_path):
    from obsframe.operators.quality import feature_bundle, fingerprint

    features = spark.createDataFrame([(1, START, 3, 0.5), (2, START, 4, None)], "entity_id int, obs_date date, p1_lag_1 int, rate double")
    seen = spark.createDataFrame([(1, START + timedelta(days=1), START, 7), (2, START, START, 8)], "entity_id int, target_date date, obs_date date, obs_id long")
    path = str(tmp_path / "bundle")
    for _ in range(2):  # a second run replaces the first
        feature_bundle(features, seen, path, ["entity_id", "obs_date", "p1_lag_1", "rate"])
    assert {r.feature_name: (r.position, r.data_type) for r in spark.read.parquet(f"{path}/catalogue").collect()} == {"p1_lag_1": ("p1", "int"), "rate": (None, "double")}
    assert spark.read.parquet(f"{path}/features").count() == 2
    version = spark.read.parquet(f"{path}/version").first()
    assert version.n_rows == 2 and len(version.identity) == 64 and fingerprint(features, ["rate"]).first().n_rows == 2
    assert spark.read.parquet(f"{path}/leakage").count() >= 1
