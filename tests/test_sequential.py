"""Staged prediction, row-by-row learning, walk-forward backtests and sequential streams against plain versions."""

import math
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsframe import layout as L

START = date(2024, 1, 1)
SCHEMA = "entity_id int, obs_date date, " + ", ".join(f"{p} int" for p in L.POSITIONS)


def digit_rows(n=60, entities=3, seed=1):
    rng = np.random.default_rng(seed)
    return [(e, START + timedelta(days=d), *map(int, rng.integers(0, 10, 8))) for d in range(n) for e in range(entities) if rng.random() < 0.8]


@pytest.fixture(scope="module")
def rows():
    return digit_rows()


@pytest.fixture(scope="module")
def obs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def by_entity(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: r[1]):
        out[r[0]].append(r)
    return out


def test_staged_rows_pad_on_the_left(obs, rows):
    from obsframe.operators.staged import staged_rows

    want = {}
    for e, own in by_entity(rows).items():
        for i in range(1, len(own)):
            earlier = [x for r in own[max(0, i - 3) : i] for x in r[2:]]
            pad = lambda known: ([0] * 28 + known + earlier)[-28:]
            want[e, own[i][1]] = (pad(list(own[i][2:5])), pad(list(own[i][2:6])), own[i][5:])
    got = {(r.entity_id, r.obs_date): (r.features_3, r.features_4, tuple(r[f"target_p{k}"] for k in range(4, 9))) for r in staged_rows(obs).collect()}
    assert got == want


def test_split_is_by_date_and_never_empty(spark, obs, rows):
    from obsframe.operators.staged import staged_rows, unique_date_split

    got = unique_date_split(staged_rows(obs)).groupBy("split").agg(F.min("obs_date").alias("a"), F.max("obs_date").alias("b"))
    sides = {r.split: (r.a, r.b) for r in got.collect()}
    dates = sorted({r[1] for own in by_entity(rows).values() for r in own[1:]})
    assert sides["TRAIN"][1] == dates[int(len(dates) * 0.8) - 1] < sides["VALIDATION"][0]
    one = spark.createDataFrame([(e, START) for e in range(10)], "entity_id int, obs_date date")
    split = {r.entity_id: r.split for r in unique_date_split(one).collect()}
    assert [split[e] for e in range(10)] == ["TRAIN"] * 8 + ["VALIDATION"] * 2
    assert unique_date_split(one.limit(0)).count() == 0


def test_chain_learns_what_the_digits_say(spark):
    from obsframe.operators import staged as G

    rng = np.random.default_rng(3)
    rows = []
    for d in range(120):
        for e in range(3):
            head = [int(x) for x in rng.integers(0, 4, 3)]
            rows.append((e, START + timedelta(days=d), *head, head[0], head[1], head[0], 9 - head[0], int(rng.integers(0, 10))))
    split = G.unique_date_split(G.staged_rows(spark.createDataFrame(rows, SCHEMA))).cache()
    train, late = (split.where(F.col("split") == s).drop("split") for s in ("TRAIN", "VALIDATION"))
    models = G.fit_chain(train, numTrees=40)
    got = {r.target: r for r in G.chain_metrics(models, train, late).collect()}
    assert set(got) == set(G.STAGES) and got["p4"].n_obs == late.count()
    assert all(got[t].top_1_accuracy > 0.9 and got[t].log_loss_gain > 0.5 for t in ("p4", "p5", "p6", "p7"))
    assert got["p8"].log_loss_gain < 0.2 and got["p8"].top_10_accuracy == 1


def plain_online(rows):
    """One loop over all rows in (date, entity) order: predict, then learn."""
    from obsframe.operators.staged import ONLINE_STAGES

    state = {t: (np.zeros(10), np.zeros((10, 30)), np.zeros((10, 30))) for t in ONLINE_STAGES}
    history, out = defaultdict(list), {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        digits = dict(zip(L.POSITIONS, r[2:]))
        for t, known in ONLINE_STAGES.items():
            values = [digits[p] for p in known] + [x for old in history[r[0]][-3:] for x in old]
            x = np.array(([0] * 30 + values)[-30:], float)
            n, s, q = state[t]
            scores = []
            for c in range(10):
                if not n[c]:
                    scores.append(-math.inf)
                    continue
                mean = s[c] / n[c]
                var = np.maximum(q[c] / n[c] - mean * mean, 1e-3)
                scores.append(round(float(np.log(n[c] / n.sum()) - 0.5 * np.sum(np.log(2 * np.pi * var) + (x - mean) ** 2 / var)), 9))
            order = sorted(range(10), key=lambda c: (-scores[c], c))
            out[r[0], r[1], t] = (digits[t], order[0], order.index(digits[t]) + 1, len(history[r[0]]) < 12)
            n[digits[t]] += 1
            s[digits[t]] += x
            q[digits[t]] += x * x
        history[r[0]].append(r[2:])
    return out


def test_online_chain_predicts_before_it_learns(obs, rows):
    from obsframe.operators import staged as G

    want = plain_online(rows)
    for per_block in (7, 1000):
        scores, totals = G.online_scores(G.online_rows(obs), per_block)
        assert {(r.entity_id, r.obs_date, r.target): (r.actual, r.prediction, r.rank, r.warm_up) for r in scores.collect()} == want
    status = Counter(r.status for r in G.row_status(scores).collect())
    assert sum(status.values()) == len(rows) and status["WARMUP"] == 3 * 12
    first = G.online_summary(scores).where("target = 'p4'").first()
    assert first.predictions == len(rows) - 36 == first.matches + first.misses == first.hits_10


def replay_folder(spark, rows, folder, parts):
    for k, part in enumerate(parts):
        spark.createDataFrame([r for r in rows if part(r[1])], SCHEMA).coalesce(1).write.parquet(f"{folder}/in/part={k}")


def test_replay_learns_from_every_batch_and_resumes(spark, rows, tmp_path):
    from obsframe.streaming.sequential import sequential_replay

    folder = str(tmp_path / "w")
    day = lambda n: START + timedelta(days=n)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    replay_folder(spark, rows, folder, [lambda d: d < day(25)])
    sequential_replay(stream(), folder, 20).awaitTermination()
    again = [r for r in rows if day(20) <= r[1] < day(45)]  # five days come twice
    spark.createDataFrame(again, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/part=1")
    sequential_replay(stream(), folder, 20).awaitTermination()
    spark.createDataFrame([r for r in rows if r[1] >= day(45)], SCHEMA).coalesce(1).write.parquet(f"{folder}/in/part=2")
    sequential_replay(stream(), folder, 20).awaitTermination()

    def feedback():
        return {(r.entity_id, r.obs_date, r.stage): (r.predicted_value, r.actual_value, r.is_correct) for r in spark.read.parquet(f"{folder}/feedback").collect()}

    want = {}
    online = plain_online(rows)
    for e, d in {k[:2] for k in online}:
        if not online[e, d, "p4"][3]:
            a, p = ({t: online[e, d, t][i] for t in ("p4", "p5", "p6", "p7", "p8")} for i in (0, 1))
            text = lambda x: {"PAIR_FIRST": str(x["p4"]), "PAIR_SECOND": str(x["p5"]), "STAGE_2": f"{x['p5']} {x['p6']}{x['p7']}{x['p8']}"}
            want |= {(e, d, s): (text(p)[s], text(a)[s], text(p)[s] == text(a)[s]) for s in text(a)}
    assert feedback() == want
    # the last batch fails after it has written: it runs again and replaces its own output
    Path(f"{folder}/checkpoint/commits/2").unlink()
    Path(f"{folder}/checkpoint/commits/.2.crc").unlink(missing_ok=True)
    sequential_replay(stream(), folder, 20).awaitTermination()
    assert feedback() == want


def test_keyed_ingest_reads_only_the_months_it_touches(spark, tmp_path):
    from obsframe.streaming.sequential import keyed_ingest, stored_rows

    schema = "obs_id long, entity_id int, obs_date date"
    folder = str(tmp_path)
    batches = [
        [(1, 1, date(2024, 1, 1)), (2, 1, date(2024, 2, 1)), (3, 1, date(2024, 2, 1))], [(4, 1, date(2024, 1, 1)), (5, 2, date(2024, 1, 1))],
        [(6, 1, date(2024, 3, 1))], [(7, 1, date(2024, 2, 1)), (8, 2, None), (9, None, START)], [(10, 2, date(2024, 3, 1)), (11, 1, date(2024, 3, 1))],
    ]
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    run = lambda: keyed_ingest(read(), f"{folder}/store", f"{folder}/mark").awaitTermination()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/part={k}")
        if k in (1, 4):
            run()
    kind = spark.createDataFrame([], schema).schema
    ids = lambda: sorted(r.obs_id for r in stored_rows(spark, f"{folder}/store", kind).collect())
    assert ids() == [1, 2, 5, 6, 10]
    Path(f"{folder}/mark/commits/4").unlink()
    Path(f"{folder}/mark/commits/.4.crc").unlink(missing_ok=True)
    run()
    assert ids() == [1, 2, 5, 6, 10]
    pruned = stored_rows(spark, f"{folder}/store", kind, ["2024-03"], 4)
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "obs_month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert [r.obs_id for r in pruned.collect()] == [6]


EVENTS = "entity_id int, obs_date date, stage int, head string, pair_first string, pair_second string, tail string, event_time timestamp"


def test_stages_complete_once_and_timers_forget(spark, tmp_path):
    from obsframe.streaming.sequential import completed_stages, keyed_state

    at = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    one = lambda e, d, head, first: (e, START, 1, head, first, None, None, at(d))
    two = lambda e, d, second, tail: (e, START, 2, None, None, second, tail, at(d))
    batches = [
        [one(1, 0, "111", "1"), one(1, 0.1, "222", "2"), one(2, 0, "333", "3"), one(3, 0, "444", "4"), two(4, 0, "9", "999")],
        [two(1, 1, "5", "555"), two(1, 1.1, "6", "666"), one(4, 1, "777", "7")],  # 1 completes, its second closing is ignored
        [one(1, 2, "000", "0"), two(1, 2.1, "0", "000"), two(4, 2, "8", "888")],  # 1 stays final, 4 completes
        [one(9, 90, "123", "1")],  # the watermark passes everything older than 30 days
        [one(9, 91, "123", "1"), two(2, 91, "1", "111")],  # 2 was forgotten: its closing comes alone
        [two(3, 20, "1", "111"), two(9, 92, "4", "456")],  # too late for 3
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / f"in/batch={k}"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    with keyed_state(spark):
        query = completed_stages(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
    got = sorted((r.entity_id, r.head, r.pair, r.tail) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "222", "25", "555"), (4, "777", "78", "888"), (9, "123", "14", "456")]


def test_walk_forward_calls_the_predictor_per_fold(spark):
    from obsframe.operators.walk_forward import predict_folds, smoothed_shares, walk_forward_report

    symbols = [int(x) for x in np.random.default_rng(5).integers(0, 10, 23)]
    long = spark.createDataFrame([(1, "p1", START + timedelta(days=i), v) for i, v in enumerate(symbols)] + [(2, "p1", START, 4)], "entity_id int, position string, obs_date date, value int")
    rows = predict_folds(long, smoothed_shares, 10, 5, 4).orderBy("fold", "obs_date").collect()
    want = [(f, end, min(end + 5, 23), symbols[i]) for f, end in enumerate(range(10, 23, 4)) for i in range(end, min(end + 5, 23))]
    assert [(r.fold, r.train_end, r.test_end, r.target) for r in rows] == want
    assert rows[0].probs == pytest.approx([(symbols[:10].count(d) + 1) / 20 for d in range(10)])
    report = {r.fold: r for r in walk_forward_report(predict_folds(long, smoothed_shares, 10, 5, 4)).collect()}
    assert set(report) == {None, 0, 1, 2, 3} and report[None].n_folds == 4 and report[None].n_obs == len(want)
    assert report[None].log_loss == pytest.approx(np.mean([-math.log(r.probs[r.target]) for r in rows]))

    def last_symbol(train, test):
        out = np.full((len(test), 10), 0.01)
        out[:, train[-1]] += 0.9
        return out

    assert predict_folds(long, last_symbol, 10).first().probs[symbols[9]] == pytest.approx(0.91)
    for bad in (lambda a, b: np.ones((len(b), 10)), lambda a, b: np.full((1, 9), 1 / 9)):
        with pytest.raises(Exception, match="ten shares"):
            predict_folds(long, bad, 10, 2, 2).collect()
    with pytest.raises(ValueError):
        predict_folds(long, smoothed_shares, 0)


def test_consensus_pools_rows_and_averages_agreement(spark):
    from obsframe.operators.walk_forward import consensus_backtest

    flat = [0.1] * 10
    sure = [0.91] + [0.01] * 9
    rows = spark.createDataFrame([("a", 0, sure), ("a", 0, sure), ("a", 1, sure), ("b", 9, flat)], "consensus string, target int, probs array<double>")
    agreement = spark.createDataFrame([("a", 0.8), ("b", 0.6)], "consensus string, agreement double")
    got = {r.consensus: r for r in consensus_backtest(rows, agreement).collect()}
    assert got["a"].accuracy == pytest.approx(2 / 3) and got["b"].top_k_accuracy == 0 and got["a"].margin == pytest.approx(0.9)
    assert got[None].n_obs == 4 and got[None].agreement == pytest.approx(0.7) and got[None].accuracy == pytest.approx(0.5)
    assert consensus_backtest(rows.limit(0), agreement).count() == 0


def test_blocks_number_and_rotate_in_global_order(spark, obs, rows):
    from obsframe.operators.sequences import numbered, rotated

    order = sorted(rows, key=lambda r: (r[1], r[0]))
    got = {(r.entity_id, r.obs_date): r.number for r in numbered(obs, ["obs_date", "entity_id"], rows_per_block=9).collect()}
    assert got == {(r[0], r[1]): i for i, r in enumerate(order, 1)}
    turned = {(r.entity_id, r.obs_date): (r.p1, r.p2, r.p3, r.p4) for r in rotated(obs, {"p1": 5, "p3": 5 + len(rows), "p4": -1}, ["obs_date", "entity_id"], 9).collect()}
    assert turned == {(r[0], r[1]): (order[(i + 5) % len(order)][2], r[3], order[(i + 5) % len(order)][4], order[i - 1][5]) for i, r in enumerate(order)}


def test_relationship_rows(obs, rows):
    from obsframe.operators.relationships import stage1_rows, stage2_rows

    share = lambda n, total: round(n / total, 8) if total else 0.0
    first = {(r.entity_id, r.obs_date): r for r in stage1_rows(obs).collect()}
    second = {(r.entity_id, r.obs_date): r for r in stage2_rows(obs).collect()}
    for e, own in by_entity(rows).items():
        for i, r in enumerate(own):
            got, before, digits = first[e, r[1]], own[:i], dict(zip(L.POSITIONS, r[2:]))
            same = [x for x in before if x[3] == digits["p2"]]
            assert got.p7_given_p2 == [share(sum(x[8] == d for x in same), len(same)) for d in range(10)] and got.support_p2 == len(same)
            assert got.tail_by_first == [share(sum(x[5] == a and x[7] == d for x in before), sum(x[5] == a for x in before)) for a in range(10) for d in range(10)]
            assert got.same_p3 == share(sum(x[4] == digits["p3"] for x in before), len(before))
            assert got.rolling7_p1 == share(sum(x[2] == digits["p1"] for x in before[-7:]), len(before[-7:]))
            assert got.temporal3 == [share(sum(x[2] == d for x in before[-3:]), len(before[-3:])) for d in range(10)]
            assert got.lag1_p8 == (before[-1][9] if before else None)
            with_first = [x for x in before if x[5] == digits["p4"]]
            assert second[e, r[1]].tail_given_first == [share(sum(v == d for x in with_first for v in x[7:]), 3 * len(with_first)) for d in range(10)]
