"""Partition-count invariance: queries built on the prefix / quantile / halo
plans give the oracle's answer when every key is cut into many tiny buckets."""

import pytest

import __spark_entry__ as se
import clinlake.plans.prefix as prefix
from tests.conftest import SMOKE
from tests.test_catalog import _rows, con  # noqa: F401  (fixture)

BUCKETED = [
    "grouped_median_fill", "label_encode_sorted", "outliers_iqr_z", "ks_two_sample", "visit_number_rate_accel",
    "ffill_limit2", "interpolate_edges", "running_drug_burden", "second_difference_flag", "sliding_sequences",
    "trailing_window_stats", "stratified_split", "first_visits_per_patient", "quantile_bin_weights",
    "roc_auc_by_group", "youden_threshold", "average_precision_by_group", "conformal_coverage", "semantic_chunks",
    "instruction_split", "baseline_profile", "quota_selection", "latency_percentiles", "motion_scrub",
    "proportional_threshold", "adjacency_edges", "edge_stability",
]


@pytest.fixture()
def tiny_buckets(monkeypatch):
    monkeypatch.setattr(prefix, "ROWS_PER_BUCKET", 37)


@pytest.mark.parametrize("name", BUCKETED)
def test_bucketed_query_matches_oracle(spark, con, tiny_buckets, name):  # noqa: F811
    df = se.queries()[name](spark, SMOKE)
    rel = con.sql(se.oracle_sql()[name])
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(rel.columns, rel.fetchall())
