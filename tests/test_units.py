"""Hand-computed values and brute force on small fixtures."""

import itertools
import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

START = date(2024, 1, 1)


def series(spark, values, entity=1, position="p1"):
    rows = [(entity, START + timedelta(days=i), position, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "entity_id int, obs_date date, position string, value int")


def test_frequency_has_all_digits_and_ties(spark):
    from obsframe.operators.aggregates import digit_frequency, frequency_extremes

    long = series(spark, [0, 0, 5, 5, 9])
    rows = {r.digit: (r.n, r.pct) for r in digit_frequency(long).collect()}
    assert len(rows) == 10 and rows[0] == (2, 40.0) and rows[3] == (0, 0.0)
    top = frequency_extremes(long).first()
    assert top.most_frequent == [0, 5] and len(top.least_frequent) == 7


def test_features_never_see_the_target_row(spark):
    from obsframe.operators.windows import last_seen, window_counts

    long = series(spark, [7, 7, 1, 7])
    counts = [r.counts_3 for r in window_counts(long, (3,)).orderBy("obs_date").collect()]
    assert [c[7] for c in counts] == [0, 1, 2, 2] and [c[1] for c in counts] == [0, 0, 0, 1]
    seen = [r.distance[7] for r in last_seen(long).orderBy("obs_date").collect()]
    assert seen == [None, 0, 0, 1]


def test_code_classes_keep_leading_zeros(spark):
    from obsframe.functions import codes as C

    row = spark.createDataFrame([("005", "05", "500")], "h string, p string, t string").select(
        C.three_digit_class(F.col("h")).alias("h"), C.pair_class(F.col("p")).alias("p"),
        C.code_relation(F.col("h"), F.col("t")).alias("r"), C.clean_code(F.lit(" 05 "), 2).alias("c"),
        C.clean_code(F.lit("5"), 2).alias("bad"),
    ).first()
    assert row.h == "ONE_PAIR|HAS_ZERO|LOW_SUM|EEO|MIXED" and row.p == "NON_DOUBLE|DIFFERENT_DIGIT|EO"
    assert row.r == "REVERSED" and row.c == "05" and row.bad is None


def test_correlation_is_null_without_variance(spark):
    from obsframe.operators.relations import pair_relations

    df = spark.createDataFrame([(3, 1), (3, 2), (3, 9)], "p1 int, p2 int")
    row = pair_relations(df, pairs=(("p1", "p2"),)).first()
    assert row.correlation is None and row.direction == "INSUFFICIENT_DATA" and row.covariance == 0


def test_trailing_run_counts_only_the_tail(spark):
    from obsframe.operators.windows import trailing_run

    df = spark.createDataFrame([("m", i, b) for i, b in enumerate([True, False, True, True])], "k string, i int, bad boolean")
    assert trailing_run(df, ["k"], "i", "bad").first().trailing_run == 2


def test_normal_p_value_and_beta_quantile(spark):
    from obsframe.functions.special import beta_quantile, two_sided_p

    row = spark.createDataFrame([(1.96, 0.5, 2.0, 2.0), (0.0, 0.975, 3.0, 1.0)], "z double, q double, a double, b double")
    got = row.select(two_sided_p("z").alias("p"), beta_quantile("q", "a", "b").alias("x")).collect()
    assert got[0].p == pytest.approx(math.erfc(1.96 / math.sqrt(2))) and got[1].p == 1.0
    assert got[0].x == pytest.approx(0.5) and got[1].x == pytest.approx(0.975 ** (1 / 3))


def test_code_ranking_matches_brute_force(spark):
    from obsframe.operators import ranking as K

    rng = np.random.default_rng(1)
    probs = [list(map(float, rng.dirichlet(np.ones(10)))) for _ in range(5)]
    df = spark.createDataFrame([(1, *probs)], "k int, a array<double>, b array<double>, c array<double>, d array<double>, e array<double>")
    tails, pairs = K.tail_candidates(), K.pair_candidates()
    mass = lambda code, ps: math.prod(p[int(x)] for p, x in zip(ps, code))
    tail = {c: (mass(c, probs[2:]), f) for c, f in tails}
    total = sum(m for m, _ in tail.values())
    want = sorted(tail, key=lambda c: (-tail[c][0], c))[:4]
    got = K.explode_ranking(K.rank_codes(df, ["c", "d", "e"], tails, 4), ["k"]).orderBy("rank").collect()
    assert [r.code for r in got] == want and got[0].prob == pytest.approx(tail[want[0]][0] / total)
    # joint selection against all triples
    fam = {f: sum(m for m, g in tail.values() if g == f) for f in range(10)}
    ptotal = sum(mass(c, probs[:2]) for c, _ in pairs)
    best = max(
        mass(p, probs[:2]) / ptotal * tail[a][0] / fam[tail[a][1]] * tail[b][0] / fam[tail[b][1]]
        for p, _ in pairs
        for a, b in itertools.product([c for c in tail if tail[c][1] == int(p[0])], [c for c in tail if tail[c][1] == int(p[1])])
    )
    row = K.joint_selection(df, ["a", "b"], ["c", "d", "e"], pairs, tails, ["k"], 3).where("rank = 1").first()
    assert row.joint_score == pytest.approx(best)


def test_hmm_likelihood_matches_enumeration():
    from obsframe.operators.models import forward_backward, start_parameters

    start, trans, emit = start_parameters(2)
    x = np.array([1, 4, 1, 0])
    total = 0.0
    for path in itertools.product(range(2), repeat=len(x)):
        p = start[path[0]] * emit[path[0], x[0]]
        for t in range(1, len(x)):
            p *= trans[path[t - 1], path[t]] * emit[path[t], x[t]]
        total += p
    post, moves, ll = forward_backward(x, start, trans, emit)
    assert ll == pytest.approx(math.log(total))
    assert post.sum(axis=1) == pytest.approx(np.ones(4)) and moves.sum() == pytest.approx(3.0)


def test_em_raises_the_likelihood(spark):
    from obsframe.operators.models import digit_sequences, fit_hmm

    long = series(spark, [0, 1] * 20).unionByName(series(spark, [5, 5, 6] * 12, entity=2))
    _, losses = fit_hmm(digit_sequences(long), states=2, iterations=4, smoothing=1e-3)
    assert losses == sorted(losses)


def test_naive_bayes_uses_only_earlier_rows(spark):
    from obsframe.streaming import prequential_scores

    rows = [(1, START + timedelta(days=i), i % 2, 3 if i % 2 else 8) for i in range(20)]
    df = spark.createDataFrame(rows, "entity_id int, obs_date date, p1 int, p4 int")
    out = prequential_scores(df, ("p1",), "p4").collect()
    assert len(out) == 8 and all(r.rank == 1 for r in out)


def test_retraining_and_alert_operators(spark):
    from obsframe.functions.stats import compare

    df = spark.createDataFrame([(1.0, 1.0 + 1e-13)], "v double, t double")
    row = df.select(*[compare(F.col("v"), F.col("t"), F.lit(o)).alias(o) for o in ("gte", "gt", "lte", "lt", "eq")]).first()
    assert row.eq and row.lte and not row.gt


def test_csv_import_pads_and_drops_blank_rows(spark, tmp_path):
    from obsframe.sources import read_import

    (tmp_path / "in.csv").write_text("date,head,pair,tail\n2024-01-01,5,7,12\n,,,\n2024-01-02,120,33,900\n")
    rows = read_import(spark, str(tmp_path / "in.csv"), 4).orderBy("obs_date").collect()
    assert [(r.head, r.pair, r.tail, r.p3, r.p8) for r in rows] == [("005", "07", "012", 5, 2), ("120", "33", "900", 0, 0)]


def test_family_master_document(spark, tmp_path):
    from obsframe.sources import family_dimensions, read_family_master

    (tmp_path / "m.json").write_text('{"pair_families": {"A": ["01", "10"]}, "tail_families": {"1": {"single": ["128"], "double": ["001"]}}}')
    pair, tail = family_dimensions(read_family_master(spark, str(tmp_path / "m.json")))
    assert sorted(r.code for r in pair.collect()) == ["01", "10"]
    assert sorted((r.family, r.type, r.code) for r in tail.collect()) == [("1", "double", "001"), ("1", "single", "128")]


def test_stream_ingest_skips_stored_keys(spark, tmp_path):
    from obsframe.streaming import ingest

    schema = "obs_id long, entity_id int, obs_date date"
    source, stored, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.createDataFrame([(2, 1, START), (1, 1, START)], schema).coalesce(1).write.parquet(f"{source}/a")
    read = lambda: spark.readStream.schema(schema).parquet(f"{source}/*")
    ingest(read(), stored, mark).awaitTermination()
    spark.createDataFrame([(3, 1, START), (4, 2, START)], schema).coalesce(1).write.parquet(f"{source}/b")
    ingest(read(), stored, mark).awaitTermination()
    assert sorted(r.obs_id for r in spark.read.schema(schema).parquet(f"{stored}/*").collect()) == [1, 4]


def test_stage_completion_keeps_latest_pending_and_first_final(spark, tmp_path):
    from datetime import datetime

    from obsframe.streaming import complete_stages, run_to_table

    schema = "entity_id int, obs_date date, stage int, head string, pair_first string, pair_second string, tail string, event_time timestamp"
    at = lambda m: datetime(2024, 1, 1, 10, m)
    rows = [
        (1, START, 1, "111", "1", None, None, at(0)), (1, START, 1, "222", "2", None, None, at(1)),
        (1, START, 2, None, None, "9", "333", at(2)), (1, START, 2, None, None, "8", "444", at(3)),
        (2, START, 2, None, None, "8", "444", at(3)),
    ]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = run_to_table(complete_stages(stream), str(tmp_path / "work")).collect()
    assert [(r.entity_id, r.head, r.pair, r.tail) for r in got] == [(1, "222", "29", "333")]


def test_stage_completion_over_single_file_batches(spark, tmp_path):
    """Stages that arrive in different micro-batches still meet, and a completed key stays final."""
    from datetime import datetime

    from obsframe.streaming import complete_stages

    schema = "entity_id int, obs_date date, stage int, head string, pair_first string, pair_second string, tail string, event_time timestamp"
    at = lambda m: datetime(2024, 1, 1, 10, m)
    batches = [
        [(k, START, 1, str(k) * 3, "1", None, None, at(k)) for k in (1, 2, 3)], [(1, START, 2, None, None, "9", "333", at(4))],
        [(2, START, 2, None, None, "8", "444", at(5))], [(1, START, 2, None, None, "7", "555", at(6))],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/batch={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = complete_stages(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("entity_id").collect()
    assert [(r.entity_id, r.head, r.pair, r.tail) for r in got] == [(1, "111", "19", "333"), (2, "222", "18", "444")]


def test_replay_appends_feedback(spark, tmp_path):
    from obsframe.operators.probabilities import markov_table, with_context
    from obsframe.streaming import replay

    long = series(spark, [1, 2] * 10)
    rows = with_context(long).select("entity_id", "obs_date", "position", "context", "value")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    replay(stream, markov_table(long).select("position", "context", "probs"), str(tmp_path / "w")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "w/feedback/batch=0"))
    assert out.count() == 19 and out.where("actual_rank = 1").count() == 19


def test_folds_end_with_a_ragged_one(spark):
    from obsframe.operators.backtest import expanding_folds

    df = series(spark, [0] * 25)
    rows = expanding_folds(df, 10, 6, 6).orderBy("fold").collect()
    assert [(r.test_end - r.test_start).days + 1 for r in rows] == [6, 6, 3]
