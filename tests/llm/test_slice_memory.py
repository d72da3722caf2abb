"""Scoring holds little more than a small slice of a batch's texts at a time, whatever the batch."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from obsframe.llm.passages import quality_scorer
from obsframe.llm.toxicity import toxicity_scorer

WORDS = ["plain", "river", "stone", "window", "garden", "paper", "letter", "summer"]


def texts(n: int, length: int, extra: str = "") -> list[str]:
    rng = np.random.default_rng(n)
    return [" ".join([*rng.choice(WORDS, length), extra]) + f" w{i}." for i in range(n)]


@pytest.mark.parametrize("kind", ["quality", "toxicity"])
def test_scoring_a_large_batch_stays_small(spark, kind):
    rows = [(i, t, int(i >= 60)) for i, t in enumerate(texts(60, 12) + texts(60, 12, "zorblaxer"))]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k, k) for i, _, k in rows], "doc_id long, quality int, toxic int")
    score = quality_scorer(docs, labels) if kind == "quality" else toxicity_scorer(docs, labels)
    batch = pa.array(texts(3000, 500, "zorblaxer") + [""])  # about 10 MB
    run = score.func
    parts = [run(batch.slice(a, 500)).to_pylist() for a in range(0, len(batch), 500)]
    tracemalloc.start()
    got = run(batch).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == pytest.approx(sum(parts, []), abs=1e-6)
    assert peak < 90 << 20
