"""Models beside each other in one row give what their separate rows give."""

import contextlib
import io

import pytest

from obsframe.operators import probabilities as P
from obsframe.plans.catalog import Tables

FOLDER = "/root/testdata/sf0.001"
MODELS = (("markov1", 1, 1.0), ("frequency", 0, 1.0), ("smooth", 1, 25.0))
KEYS = ["entity_id", "position", "obs_date"]


@pytest.fixture(scope="module")
def both_forms(spark):
    long = Tables(spark, FOLDER).long.where("position in ('p2', 'p7')").cache()
    markov = P.markov_rows(long)
    frequency = P.markov_rows(long, order=0, name="frequency").join(markov.select(*KEYS), KEYS, "left_semi")
    separate = markov.unionByName(frequency).unionByName(P.markov_rows(long, smoothing=25.0, name="smooth"))
    return P.model_rows(long, MODELS), separate


def rows(df, by):
    return [{k: [round(x, 9) for x in v] if isinstance(v, list) else round(v, 9) if isinstance(v, float) else v for k, v in r.asDict().items()}
            for r in df.orderBy(*by).collect()]


def exchanges_and_joins(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue().count("Exchange hashpartitioning"), out.getvalue().count("SortMergeJoin")


def test_models_apart(both_forms):
    together, separate = both_forms
    assert rows(P.apart(together), ["model", *KEYS]) == rows(separate.select("model", *KEYS, "target", "probs"), ["model", *KEYS])


@pytest.mark.parametrize("weights", [
    [("markov1", 0.5), ("frequency", 0.3), ("smooth", 0.2)], [("markov1", 2.0)], [("markov1", 0.5), ("markov1", 0.25), ("other", 1.0), ("frequency", None)],
])
def test_blend(spark, both_forms, weights):
    w = spark.createDataFrame(weights, "model string, weight double")
    want, got = (rows(P.blend(x, w, "b").select(*KEYS, "target", "probs", "model"), KEYS) for x in reversed(both_forms))
    assert got == want and got


def test_blend_by_key(spark, both_forms):
    w = spark.createDataFrame([("p2", "markov1", 0.5), ("p2", "smooth", 0.5), ("p3", "smooth", 1.0)], "position string, model string, weight double")
    want, got = (rows(P.blend(x, w, "b").select(*KEYS, "target", "probs", "model"), KEYS) for x in reversed(both_forms))
    assert got == want and {r["position"] for r in got} == {"p2"}


def test_agreement_moves_no_probabilities(both_forms):
    together, separate = both_forms
    by = ["position", "model_a", "model_b"]
    assert rows(P.model_agreement(together, by=("position",)), by) == rows(P.model_agreement(separate, by=("position",)), by)
    assert exchanges_and_joins(P.model_agreement(together))[1] == 0
