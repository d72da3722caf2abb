"""Family features over all three code groups."""

import pytest

from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["f21_family_frequency_all_groups", "f22_family_recency_all_groups"])
def test_all_groups_match_sql(spark, name):
    from obsframe.plans import ORACLES, QUERIES

    ok, message = compare(spark, connect(FOLDER), name, FOLDER, QUERIES, ORACLES)
    assert ok, message
    assert {r["code_group"] for r in QUERIES[name](spark, FOLDER).select("code_group").distinct().collect()} == {"head", "pair", "tail"}


@pytest.mark.parametrize("name", ["f21_family_frequency_all_groups", "f22_family_recency_all_groups"])
def test_rows_move_before_they_are_spread_over_families(spark, name):
    import contextlib
    import io

    from obsframe.plans import QUERIES

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        QUERIES[name](spark, FOLDER).explain()
    plan = out.getvalue()
    assert "Window" not in plan and plan.index("inline(") < plan.index("Exchange hashpartitioning(entity_id")


def test_families_of_groups_of_two_sizes(spark):
    from pyspark.sql import functions as F

    from obsframe.operators import families as fam

    universe = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z"), ("b", "q")], "code_group string, family_name string")
    seen = {"a": ["y", None, "other", "x", "y"], "b": ["q", "q", None, "other", "q"]}
    rows = spark.createDataFrame([(1, i, g, f) for g, names in seen.items() for i, f in enumerate(names)], "entity_id int, obs_date int, code_group string, family_name string")
    rates = {(r.code_group, r.obs_date, r.family_name): (r.n_3, round(r.pct_3, 6)) for r in fam.family_window_rates(rows, universe, (3,)).collect()}
    far = {(r.code_group, r.obs_date, r.family_name): (r.recency, r.seen_within) for r in fam.family_recency(rows, universe, 2).collect()}
    for g, shown in (("a", "xyz"), ("b", "q")):
        for i in range(5):
            for f in shown:
                last = [x for x in seen[g][max(0, i - 3):i] if x is not None]
                assert rates.pop((g, i, f)) == (last.count(f), round(100 * last.count(f) / len(last), 6) if last else 0.0)
                d = next((i - 1 - j for j in range(i - 1, -1, -1) if seen[g][j] == f), None)
                assert far.pop((g, i, f)) == (d, d is not None and d < 2)
    assert not rates and not far
