"""A cross-section of the registered queries against DuckDB; oracle_check.py runs all of them."""

import pytest

import __spark_entry__ as entry
from tests import oracle_check

SF = "/root/testdata/sf0.001"
CHOSEN = """
normalise_names rename_dictionary write_dataset html_tables nth_table header_column_filter cast_numeric
filter_complete_cases unpivot_twice left_join_means befor_matrix befor_sum rowwise_min age_band_lower
ever_flag_hdg_compat label_lookup usage_label weighted_rate crosstab_long weighted_share_in_group
weighted_quantiles weighted_density column_profile missing_report global_min_scalar guttman_all
guttman_all_compat survey_design svy_logistic linearised_se recall_precision_f1 weighted_auc_rows
distance_heom distance_hvdm smote
""".split()


@pytest.fixture(scope="module")
def duck():
    return oracle_check.duck(SF)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, duck, name):
    problem = oracle_check.compare(entry.queries()[name](spark, SF), duck, entry.oracle_sql()[name])
    assert problem is None, problem


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 17
