"""Registered queries against DuckDB at the smallest scale (all of them with HYPNOLAKE_ALL=1)."""

import os

import pytest

import oracle_check
from hypnolake import plans

SF = "/root/testdata/sf0.001"
DEFAULT = [
    "transition_profile", "stage_macro_architecture", "fragmentation", "arousal_distribution", "desaturation_events",
    "event_clustering", "reward_thresholds", "full_evaluation", "subgroup_metrics", "harrell_c_index", "incident_labels",
    "split_train_val_test", "numeric_summary", "column_profile", "standardise_channels", "join_feature_families",
    "mann_whitney", "bootstrap_auroc", "site_zscore", "site_rank", "combat", "epoch_band_powers", "hrv_time_domain",
    "cap_summary", "knn_join",
]
NAMES = sorted(plans.ORACLES) if os.environ.get("HYPNOLAKE_ALL") else DEFAULT

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    return oracle_check.duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    msg, _, ok = oracle_check.compare(spark, duck, name, SF)
    assert ok, msg


def test_every_oracle_has_a_query():
    assert set(plans.ORACLES) <= set(plans.QUERIES)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
