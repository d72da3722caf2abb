"""Stage 1 rows over batches of sorted rows."""

import datetime as dt
import itertools

import numpy as np

from obsframe import layout as L

DAY = dt.date(2020, 1, 1)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_stage1_rows_over_cut_batches(spark):
    """Series that go on over batches, a null head digit and halves of the eighth place, against plain counting."""
    from obsframe.operators.relationships import stage1_rows

    rng = np.random.default_rng(3)
    rows = [[e, DAY + dt.timedelta(d), *map(int, rng.integers(0, 4, 8))] for e, n in ((1, 40), (2, 3), (3, 1), (4, 700)) for d in range(n)]
    rows[5][2] = None
    df = spark.createDataFrame(rows, "entity_id int, obs_date date, " + ", ".join(f"{p} int" for p in L.POSITIONS))
    assert "Window" not in plan_of(stage1_rows(df))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.entity_id, r.obs_date): r for r in stage1_rows(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == len(rows)
    part = lambda a, b: 0.0 if b == 0 else (2 * 10**8 * a + b) // (2 * b) / 1e8
    for e, group in itertools.groupby(rows, key=lambda x: x[0]):
        group = list(group)
        for i, (_, day, *x) in enumerate(group):
            r, earlier = got[e, day], [g[2:] for g in group[:i]]
            same = [y for y in earlier if y[0] == x[0]]
            assert r.prior_count == i and r.support_p1 == len(same) and r.lag1_p8 == (earlier[-1][7] if i else None)
            assert r.p6_given_p1 == [part(sum(y[5] == d for y in same), len(same)) for d in range(10)]
            firsts = [[y for y in earlier if y[3] == a] for a in range(10)]
            assert r.tail_by_first == [part(sum(y[5] == d for y in f), len(f)) for f in firsts for d in range(10)]
            seen = [y[0] for y in earlier[-7:] if y[0] is not None]
            assert r.temporal7 == [part(seen.count(d), len(seen)) for d in range(10)]
            assert r.rolling7_p1 == part(seen.count(x[0]) if x[0] is not None else 0, len(seen))
            assert r.same_p2 == part(sum(y[1] == x[1] for y in earlier), i)
