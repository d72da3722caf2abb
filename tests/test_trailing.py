"""Trailing counts and distances are those of a plain loop, however batches cut the series, and move the rows once."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from obsframe.operators import trailing as TR
from obsframe.operators import windows as W
from obsframe.plans.catalog import QUERIES, list_texts, pack

FOLDER = "/root/testdata/sf0.001"
N = 5


def series():
    rng = random.Random(3)
    lengths = {(1, "p1"): 1, (1, "p2"): 40, (2, "p1"): 9, (2, "p2"): 8, (3, "p1"): 23}
    return {k: [rng.choice([0, 0, 1, 2, 7, 9, None]) for _ in range(n)] for k, n in lengths.items()}


def plain(values, i):
    last = values[max(0, i - N):i]
    seen = [next((i - 1 - j for j in range(i - 1, -1, -1) if values[j] == d), None) for d in range(10)]
    far = [[k for k, v in enumerate(reversed(last)) if v == d] for d in range(10)]
    return [last.count(d) for d in range(10)], min(i, N), seen, far


@pytest.mark.parametrize("batch", [1, 7, 8, 10_000])
def test_trails_of_series_cut_anywhere(spark, batch):
    all_of = series()
    rows = [(e, f"2024-{1 + i // 28:02}-{1 + i % 28:02}", p, v) for (e, p), values in all_of.items() for i, v in enumerate(values)]
    random.Random(4).shuffle(rows)
    long = spark.createDataFrame(rows, "entity_id int, obs_date string, position string, value int").withColumn("obs_date", F.col("obs_date").cast("date"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        by = lambda df: {k: [r for r in df.orderBy("obs_date").collect() if (r.entity_id, r.position) == k] for k in all_of}
        counts, seen, spread = by(W.window_counts(long, (2, N))), by(W.last_seen(long)), by(W.recency_distribution(long, N))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for k, values in all_of.items():
        for i in range(len(values)):
            want, rows_before, distance, far = plain(values, i)
            assert (counts[k][i].rn, counts[k][i][f"counts_{N}"], counts[k][i][f"rows_{N}"]) == (i + 1, want, rows_before)
            assert seen[k][i].distance == distance
            s = spread[k][i]
            assert (s["count"], s["min"], s["max"]) == (want, [min(f, default=None) for f in far], [max(f, default=None) for f in far])
            assert [None if m is None else round(m, 9) for m in s["mean"]] == [round(sum(f) / len(f), 9) if f else None for f in far]


@pytest.mark.parametrize("values,kind", [
    ([[1, None, -3], [], None, [20]], "bigint"), ([[0.5, None, 1 / 3, float("nan"), float("inf"), -float("inf"), -0.25], None, [], [1e300, 2.0]], "double"), ([None], "int"), ([], "double"),
])
def test_list_texts_are_those_of_pack(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], f"v array<{kind}>").coalesce(1)
    want = [r.v for r in pack(df).collect()]
    assert list_texts(df.toArrow()["v"].combine_chunks()).to_pylist() == want


def test_list_texts_of_a_slice(spark):
    import pyarrow as pa

    whole = pa.array([[1, 2], None, [3], [], [4, None]])
    assert list_texts(whole.slice(1, 4)).to_pylist() == [None, "3", "", "4,NA"]
    assert TR.lists(__import__("numpy").arange(4).reshape(2, 2)).to_pylist() == [[0, 1], [2, 3]]


@pytest.mark.parametrize("name", ["f04_frequency_windows", "f07_concentration_regime", "f09_recency_expansion", "f10_recency_distribution"])
def test_series_are_sorted_once_and_kept_by_no_window(spark, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        QUERIES[name](spark, FOLDER).explain()
    plan = out.getvalue()
    assert "Window" not in plan and plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 2
