"""Staged forests: how often their rows are scored."""

import datetime as dt

import numpy as np

from obsframe import layout as L

DAY = dt.date(2020, 1, 1)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_staged_forests_score_each_target_once(spark):
    """The scored rows are written: metrics read them, and run no forest and no window again."""
    from obsframe.operators import staged as G

    rng = np.random.default_rng(11)
    rows = [(e, DAY + dt.timedelta(d), *map(int, rng.integers(0, 10, 8))) for e in range(3) for d in range(40)]
    df = spark.createDataFrame(rows, "entity_id int, obs_date date, " + ", ".join(f"{p} int" for p in L.POSITIONS))
    stages = {"p4": G.STAGES["p4"], "p6": G.STAGES["p6"]}
    train = G.staged_rows(df, stages=stages)
    scored = G.score_chain(G.fit_chain(train, stages, numTrees=3, maxDepth=3), train, stages)
    plan = plan_of(scored)
    assert "UDF" not in plan and "Window" not in plan and scored.count() == 2 * 3 * 39
