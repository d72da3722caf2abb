"""The source of an error, and what it asks for, follow the rank of the actual."""

from datetime import date, timedelta

from obsframe.operators.quality import feedback


def test_a_near_miss_is_a_ranking_error_and_asks_for_retraining(spark):
    ranks = [1] * 9 + [2, 1, None]
    rows = [(1, date(2020, 1, 1) + timedelta(days=i), rank) for i, rank in enumerate(ranks)]
    got = feedback(spark.createDataFrame(rows, "entity_id int, target_date date, actual_rank int")).orderBy("target_date").collect()
    assert [r.error_source for r in got] == ["none"] * 9 + ["ranking", "none", "unknown"]
    assert [r.decision for r in got] == ["HOLD"] * 9 + ["RETRAIN", "HOLD", "HOLD"]
