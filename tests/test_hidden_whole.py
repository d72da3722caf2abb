"""The whole fit of the hidden Markov scores."""

from datetime import datetime, timedelta

import numpy as np
import pytest


def test_hidden_markov_scores_of_the_whole_fit(spark, tmp_path):
    """Ten states and up to 25 rounds that end at a change of 1e-6, worked out series by series."""
    from obsframe.operators import models as M
    from obsframe.plans import QUERIES
    from obsframe.plans.catalog import Tables

    rows = [(1_000 * i + 37 * c, 60 * c, datetime(1998, 1, 1) + timedelta(days=i)) for c in range(2) for i in range(15 + 5 * c)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    got = {(r.entity_id, r.position): r for r in QUERIES["p05_hidden_markov_scores"](spark, str(tmp_path)).collect()}
    series = {(r.entity_id, r.position): np.array(r.symbols) for r in M.digit_sequences(Tables(spark, str(tmp_path)).long).collect()}
    assert set(got) == set(series) and len(got) == 16
    (start, moves, emits), before = M.start_parameters(10), None
    share = lambda a: (a + 1.0) / (a + 1.0).sum(axis=-1, keepdims=True)
    for _ in range(25):
        s, a, e, total = np.zeros(10), np.zeros((10, 10)), np.zeros((10, 10)), 0.0
        for x in series.values():
            post, steps, ll = M.forward_backward(x, start, moves, emits)
            s, a, total = s + post[0], a + steps, total + ll
            np.add.at(e.T, x, post)
        start, moves, emits = share(s), share(a), share(e)
        if before is not None and abs(total - before) <= 1e-6:
            break
        before = total
    for key, x in series.items():
        assert got[key].log_likelihood == pytest.approx(M.forward_backward(x, start, moves, emits)[2], abs=1e-4)


def test_fit_goes_on_while_the_likelihood_moves(spark):
    """The tolerance is that of the log likelihood itself, not of its share."""
    from obsframe.operators import models as M

    df = spark.createDataFrame([([0, 1, 2] * 30,), ([5, 5, 6] * 20,)], "symbols array<int>")
    every = M.fit_hmm(df, states=2, iterations=8, tolerance=0.0)[1]
    steps = [abs(b - a) for a, b in zip(every, every[1:])]
    bound = steps[0] / 2
    end = next((i for i, x in enumerate(steps, 1) if x <= bound), len(steps))
    got = M.fit_hmm(df, states=2, iterations=8, tolerance=bound)[1]
    assert end > 1 and got == pytest.approx(every[: end + 1], rel=1e-9)
