"""Probabilities of the next digit and outcomes of rankings are those of plain loops, and the lists of a ranking do not move."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from obsframe.operators import ranking as K
from obsframe.operators import trailing as TR
from obsframe.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain_steps(values):
    """Counts of what followed the last digit before each row; no digit is no row."""
    out, seen = [], []
    for v in values:
        if v is None or not 0 <= v <= 9:
            out.append(None)
            continue
        out.append([sum(a == seen[-1] and b == d for a, b in zip(seen, seen[1:])) for d in range(10)] if seen else None)
        seen.append(v)
    return out


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_steps_of_series_cut_anywhere(spark, batch):
    rng = random.Random(5)
    series = {e: [(rng.choice([0, 1, 1, 9, None, 12]), rng.choice([3, 4])) for _ in range(n)] for e, n in ((1, 30), (2, 1), (3, 12), (4, 2))}
    rows = [(e, i, *v, str(i)) for e, values in series.items() for i, v in enumerate(values)]
    random.Random(6).shuffle(rows)
    df = spark.createDataFrame(rows, "entity_id int, obs_date int, p1 int, p2 int, pair string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {(r.entity_id, r.obs_date): r for r in TR.step_probabilities(df, {"p1": "q1", "p2": "q2"}, 0.5, ("pair",), 2).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for e, values in series.items():
        want = list(zip(*(plain_steps([v[k] for v in values]) for k in (0, 1))))
        for i, pair in enumerate(want):
            if pair == (None, None):
                assert (e, i) not in got
                continue
            r = got.pop((e, i))
            assert r.pair == str(i)
            assert [r.q1, r.q2] == [c if c is None else [(x + 0.5) / (sum(c) + 5.0) for x in c] for c in pair]
    assert not got


def test_outcomes_with_ties_and_unknown_codes(spark):
    flat, steep = [0.1] * 10, [0.3, 0.0, 0.2, 0.2] + [0.05] * 6
    df = spark.createDataFrame(
        [(1, 1, "07", flat, flat), (1, 2, "23", steep, steep), (1, 3, "32", steep, steep), (1, 4, "x", steep, flat), (1, 5, None, flat, flat), (1, 6, "00", None, flat)],
        "entity_id int, obs_date int, pair string, a array<double>, b array<double>")
    codes = K.pair_candidates()
    got = K.outcomes(df, [("pair", "pair", ["a", "b"], codes)], shown=3).orderBy("target_date").collect()
    for r, (_, _, actual, a, b) in zip(got, df.orderBy("obs_date").collect()):
        if a is None:
            assert (r.actual_rank, r.reciprocal_rank, r.top_prob, r.bucket) == (None, 0.0, None, "UNAVAILABLE")
            continue
        order = sorted(((-a[int(c[0])] * b[int(c[1])], c) for c, _ in codes))
        rank = next((i for i, (_, c) in enumerate(order, 1) if c == actual), None)
        mass = -sum(m for m, _ in order)
        assert (r.actual_rank, r.reciprocal_rank) == (rank, 1 / rank if rank else 0.0)
        assert r.top_prob == pytest.approx(-order[0][0] / mass, abs=1e-12) and r.cum_prob == pytest.approx(-sum(m for m, _ in order[:3]) / mass, abs=1e-12)


@pytest.mark.parametrize("name", ["d14_outcome_of_each_ranking", "o04_actual_vs_ranked"])
def test_rows_move_once_for_all_rankings(spark, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        QUERIES[name](spark, FOLDER).explain()
    plan = out.getvalue()
    assert "Window" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning(entity_id") == 2
