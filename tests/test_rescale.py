"""Rows at a temperature, without work that grows with the square of the symbols."""

import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsframe.operators.evaluation import rescale


def test_rescale_equals_the_softmax_and_has_no_array_lambdas(spark):
    probs = [[0.55 if d == k else 0.05 for d in range(10)] for k in range(3)] + [[1.0] + [0.0] * 9]
    out = rescale(spark.createDataFrame([(i, p) for i, p in enumerate(probs)], "id int, probs array<double>"), F.lit(2.0))
    assert out.columns == ["id", "probs"]
    for row in out.collect():
        roots = np.sqrt(np.maximum(probs[row.id], 1e-15))
        assert row.probs == pytest.approx(list(roots / roots.sum()))
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        out.explain()
    assert "lambda" not in plan.getvalue()
