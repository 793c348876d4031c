"""Registered queries next to their SQL oracle; CONTACTFLOW_FULL=1 runs all of them."""
import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect

QUICK = """box_iou_pairs contact_zone nearest_joint_region guard_segment_distance window_frame_join nearest_contact_event
fuzzy_window_match swap_timeline_lookup forward_fill_lookup uncovered_truth detector_agreement wrist_deceleration_gate
vector_jerk_gate wrist_peak_speed_gate head_reaction_gate approach_rate_gate box_snap_gate receiver_motion score_greedy_nms
first_fit_cooldown pair_global_cooldown countdown_cooldown evidence_feature_matrix merged_action_windows clip_names
percentile_tiers live_contact_score landing_summary cross_person_depth_audit part_boundaries interpolated_gaps
match_nearest_unused match_closest_pair threshold_cooldown_sweep roc_auc_report stft_band_energy adaptive_audio_peaks
manifest_diff manifest_ordered_merge sequence_features padded_sequences pose_entry_scan streaming_combos""".split()
ALL = queries()
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect("0.001")


@pytest.mark.parametrize("name", list(ALL) if os.environ.get("CONTACTFLOW_FULL") else QUICK)
def test_query(spark, con, name):
    ok, msg = compare(spark, con, "0.001", name, ALL[name], SQL.get(name))
    assert ok, msg


def test_entry(spark):
    df = entry(spark)
    assert df.columns and df.collect() is not None


def test_oracles_belong_to_queries():
    assert set(SQL) <= set(ALL) and len(ALL) >= 240
