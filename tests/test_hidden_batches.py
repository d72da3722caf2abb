"""Hidden Markov scores of many series in one matrix."""

import numpy as np
import pytest


def test_hidden_markov_scores_in_matrices(spark, monkeypatch):
    """Series of unlike lengths score as one by one, and none is worked on alone."""
    from obsframe.operators import models as M

    rng = np.random.default_rng(7)
    series = [(i, "p1", rng.integers(0, 10, n).tolist()) for i, n in enumerate((1, 2, 30, 7, 30, 95))]
    df = spark.createDataFrame(series, "entity_id int, position string, symbols array<int>")
    start, trans, emit = params = M.start_parameters(3)
    single = M.forward_backward

    def alone(*_):
        raise AssertionError("one series at a time")

    monkeypatch.setattr(M, "forward_backward", alone)
    flat = np.zeros(3 + 9 + 30 + 2)
    for pdf in M.expectation(params, "g")([df.toPandas().assign(g="all")]):
        flat += pdf["v"].to_numpy()
    got = {r.entity_id: r for r in M.score_hmm(df, params).collect()}
    want = np.zeros_like(flat)
    for i, _, symbols in series:
        x = np.array(symbols)
        post, moves, ll = single(x, start, trans, emit)
        e = np.zeros_like(emit)
        np.add.at(e.T, x, post)
        want += np.concatenate([post[0], moves.ravel(), e.ravel(), [ll, len(x)]])
        path = np.log(start) + np.log(emit[:, x[0]])
        for v in x[1:]:
            path = (path[:, None] + np.log(trans)).max(axis=0) + np.log(emit[:, v])
        assert got[i].log_likelihood == pytest.approx(ll, rel=1e-12) and got[i].last_state == path.argmax()
        assert got[i].probs == pytest.approx((post[-1] @ trans @ emit).tolist(), rel=1e-12)
    assert flat == pytest.approx(want, rel=1e-10)
