"""A cross-section of the registered queries against their SQL text."""

import pytest

from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
NAMES = """a04_valid_history_rows a08_resumable_append a11_update_and_delete b01_parse_codes b05_classification_rows
b08_calendar_features b10_cross_position_relations b11_code_families c01_point_in_time_history d05_next_observation
d10_position_pairs e01_digit_frequency e04_descriptive_statistics e14_conditional_probabilities e15_independence
e16_digit_significance f02_rolling_statistics f04_frequency_windows f09_recency_expansion f15_observation_density
f19_transition_stability f22_family_recency f28_direction_streaks k09_trend_consistency l03_step_changes
m02_relation_stability m05_regime_windows n03_pair_ranking n05_joint_selection o01_probability_scores
o04_actual_vs_ranked o10_data_drift p03_prequential_rows q02_expanding_folds r01_record_checks r03_integrity_issues
s05_streamed_periods""".split()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_sql_text_has_a_query():
    from obsframe.plans import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    from obsframe.plans import ORACLES, QUERIES

    ok, message = compare(spark, duck, name, FOLDER, QUERIES, ORACLES)
    assert ok, message
