"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "anchored_detections", "window_scan_scores", "dense_scan_detections", "evidence_feature_matrix",
    "nearest_contact_event", "window_frame_join", "forward_fill_lookup", "label_by_truth_band",
    "receiver_motion", "range_framed_aggregate", "gaussian_smoothed_track", "merged_action_windows",
    "score_greedy_nms", "first_fit_cooldown", "pair_global_cooldown", "match_closest_pair",
    "threshold_cooldown_sweep", "roc_auc_report", "ground_truth_relabel", "prominent_audio_peaks",
    "sequence_features", "manifest_diff", "streaming_round_counters",
]


def main() -> None:
    from contactflow.plans import catalog
    from contactflow.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "contactflow-bench")
    qs = catalog.queries()
    qs["box_measures"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        t = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
