"""Contributions and weights of models that lie beside each other."""

import re

import pytest


def test_contributions_move_no_rows(spark):
    """Rows of models beside each other give what rows apart give, without a shuffle of them; a model without a weight has none."""
    from obsframe.operators import probabilities as P
    from obsframe.operators import ranking as K

    rows = [(1, "p1", 3, [0.1] * 10, [0.05] * 9 + [0.55], [0.1] * 10), (2, "p1", 4, [0.5, 0.5] + [0.0] * 8, [0.5, 0.5] + [0.0] * 8, [0.1] * 10), (3, "p2", 0, [0.0] * 10, [0.0] * 10, [0.1] * 10)]
    three = spark.createDataFrame(
        [(i, p, t, (a, b, c)) for i, p, t, a, b, c in rows],
        "entity_id int, position string, target int, models struct<markov1: array<double>, frequency: array<double>, smooth: array<double>>")
    weights = spark.createDataFrame([("frequency", 0.75), ("markov1", 0.25)], "model string, weight double").coalesce(1)
    out = K.contributions(three, weights, ["entity_id", "position"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning|rangepartitioning|RoundRobin", plan)
    got, want = (sorted((r.entity_id, r.position, r.model, r.symbol, r.contribution, r.contribution_share) for r in x.collect()) for x in (
        out, K.contributions(P.apart(three), weights, ["entity_id", "position"])))
    assert [g[:4] for g in got] == [w[:4] for w in want] and len(got) == 6
    assert [g[4:] for g in got] == [pytest.approx(w[4:], abs=1e-15) for w in want]
    assert got[0][3:] == (9, pytest.approx(0.4125), pytest.approx(0.4125 / 0.4375))


def test_weights_of_all_methods_from_one_pass(spark):
    from obsframe.operators import probabilities as P

    rows = spark.createDataFrame([("a", 1.0, 0.5), ("b", 3.0, 0.25)], "model string, log_loss double, accuracy double")
    methods = ("equal", "inverse_log_loss", "accuracy_softmax", "log_loss_softmax")
    got = {(r.method, r.model): r.weight for r in P.weights_by_method(rows, methods).collect()}
    assert len(got) == 8 and got["inverse_log_loss", "a"] == pytest.approx(0.75)
    for m in methods:
        assert {r.model: r.weight for r in P.ensemble_weights(rows, m).collect()} == {x: got[m, x] for x in "ab"}
