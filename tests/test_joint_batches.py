"""Joint choices of the rows of a batch together."""

import numpy as np
import pytest


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_joint_selection_in_batches(spark):
    """Against all triples, with ties and a null factor; no lambda over arrays runs for each row."""
    from obsframe.operators import ranking as K

    rng = np.random.default_rng(5)
    draw = lambda: (lambda v: (v / v.sum()).tolist())(rng.integers(1, 4, 10).astype(float))
    rows = [(i, *[draw() for _ in range(5)]) for i in range(12)] + [(12, draw(), None, draw(), draw(), draw())]
    names = ["q4", "q5", "q6", "q7", "q8"]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} array<double>" for n in names))
    pairs, tails = K.pair_candidates(), [t for t in K.tail_candidates() if t[1] != 6]
    out = K.joint_selection(df, names[:2], names[2:], pairs, tails, ["id"], 4)
    assert "lambda" not in plan_of(out)
    got = {}
    for r in out.orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r)
    assert sorted(got) == list(range(12))
    for i, *q in rows[:12]:
        share = {c: q[2][int(c[0])] * q[3][int(c[1])] * q[4][int(c[2])] for c, _ in tails}
        mass = {f: sum(share[c] for c, g in tails if g == f) for f in range(10)}
        own = {f: [(c, share[c] / mass[f]) for c, g in tails if g == f] for f in range(10)}
        every = sorted((q[0][int(p[0])] * q[1][int(p[1])] * a * b for p, _ in pairs for _, a in own[int(p[0])] for _, b in own[int(p[1])]), reverse=True)[:4]
        assert [r.joint_score for r in got[i]] == pytest.approx(every, abs=1e-12)
        assert [r.rank for r in got[i]] == [1, 2, 3, 4] and len({(r.pair, r.first_tail, r.second_tail) for r in got[i]}) == 4
