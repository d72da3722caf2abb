"""Columns moved along an order of rows."""

import re
from datetime import date, timedelta

import pytest


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_columns_turn_in_one_sort(spark, n):
    """Many different shifts, also beyond a block and beyond the table, and no join for each of them."""
    from obsframe.operators.sequences import turned

    shifts = {f"c{k}": k for k in (0, 1, 2, 3, 5, 8, 13, 39, 41, 100)}
    rows = spark.createDataFrame([(i + 1, *[100 * k + i for k in shifts.values()]) for i in range(n)], "_number long, " + ", ".join(f"{c} long" for c in shifts)).repartition(3)
    out = turned(rows, n, shifts, rows_per_block=6)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and len(re.findall(r"Exchange hashpartitioning", plan)) <= 1
    got = {r._number: r for r in out.collect()}
    assert sorted(got) == list(range(1, n + 1))
    for i in range(n):
        assert [got[i + 1][c] for c in shifts] == [100 * k + (i + k) % n for k in shifts.values()]


def test_stability_rows_are_numbered_once(spark, monkeypatch):
    """A report of several folds numbers its rows once; rotations of a range of dates are those of its rows alone."""
    from obsframe.operators import modelling as MD
    from obsframe.operators import sequences

    start, calls = date(2020, 1, 1), []
    rows = spark.createDataFrame([(e, start + timedelta(d), (d * 7 + e) % 10, (d + 3 * e) % 10, (d * 3) % 10, 1, (d + e) % 10) for d in range(30) for e in range(3)],
                                 "entity_id int, obs_date date, current_p1 int, lag_1_p1 int, lag_10_p1 int, day_of_week int, target_p4 int")
    number = sequences.numbered
    count = lambda *a, **k: calls.append(1) or number(*a, **k)
    monkeypatch.setattr(sequences, "numbered", count)
    monkeypatch.setattr(MD, "numbered", count, raising=False)
    day = lambda n: start + timedelta(n)
    report = MD.stability_report(rows, [(1, day(9), day(10), day(19)), (2, day(19), day(20), day(29))]).collect()
    assert len(calls) == 1 and len(report) == 2 * (4 + 3) and all(r.test_count == 30 for r in report)
    part = number(rows.where("obs_date between '2020-01-11' and '2020-01-20'"), ["obs_date", "entity_id"], "_number")
    features = ["current_p1", "lag_1_p1", "lag_10_p1", "day_of_week"]
    for mode in ("rotate_current", "rotate_history"):
        one, two = (sorted(map(tuple, x.select(rows.columns).collect())) for x in (MD.perturbed_rows(part, mode, features, 1, 30), MD.perturbed_rows(part.drop("_number"), mode, features, 1)))
        assert one == two != sorted(map(tuple, part.select(rows.columns).collect()))
