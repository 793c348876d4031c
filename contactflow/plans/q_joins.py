"""Join queries (survey group J)."""
from __future__ import annotations

from pyspark.sql import functions as F

from contactflow.functions import geometry as G
from contactflow.operators import joins as J
from contactflow.operators.ordering import blocked, forward_fill
from contactflow.plans.q_geometry import BK, PK, box_pairs, pairs, r6
from contactflow.plans.registry import query
from contactflow.plans.sqltext import BPAIR, PAIR, PKEY, P, dj, iou, min_pair
from contactflow.sources import adapters as A

KEYS = ["match_id", "round_id"]


@query("same_frame_pairs", f"SELECT {PKEY} FROM {BPAIR}")
def _(spark, sf):
    return box_pairs(spark, sf).select(*PK)


@query("window_frame_join", """SELECT a.action_id, b.frame, b.track_id FROM act a JOIN box b ON a.match_id=b.match_id AND a.round_id=b.round_id
  AND a.fighter_id=b.track_id AND b.frame BETWEEN a.window_start-3 AND a.window_end+5""")
def _(spark, sf):
    b = A.boxes(spark, sf).select(*KEYS, F.col("track_id").alias("fighter_id"), "frame")
    j = J.interval_join(A.actions(spark, sf), b, [*KEYS, "fighter_id"], start="window_start", end="window_end", before=3, after=5)
    return j.select("action_id", "frame", F.col("fighter_id").alias("track_id"))


def best_ce(spark, sf):
    """One contact per (recording, striker, frame): most probable, smallest id."""
    c = A.contacts(spark, sf).groupBy(*KEYS, "striker_id", "ce_frame").agg(
        F.min(F.when(F.col("contact_prob").isNotNull(), F.struct((-F.col("contact_prob")).alias("np"), "contact_id", "contact_region"))).alias("b"))
    return c.select(*KEYS, "striker_id", "ce_frame", (-F.col("b.np")).alias("contact_prob"), "b.contact_id", "b.contact_region")


@query("nearest_contact_event", """SELECT det_id, contact_id, contact_region, round(contact_prob,6) AS contact_prob FROM (
  SELECT d.det_id, c.contact_id, c.contact_region, c.contact_prob, row_number() OVER (PARTITION BY d.det_id ORDER BY c.contact_prob DESC NULLS LAST, c.ce_frame, c.contact_id) AS rn
  FROM det d LEFT JOIN ce c ON d.match_id=c.match_id AND d.round_id=c.round_id AND d.striker_id=c.striker_id AND c.ce_frame BETWEEN d.frame-15 AND d.frame+15) WHERE rn=1""")
def _(spark, sf):
    j = J.best_in_band(A.detections(spark, sf), best_ce(spark, sf), [*KEYS, "striker_id"], left_on="frame", right_on="ce_frame",
                       lo=-15, hi=15, order=[-F.col("contact_prob"), F.col("ce_frame"), F.col("contact_id")],
                       keep=["contact_id", "contact_region", "contact_prob"])
    return j.select("det_id", "contact_id", "contact_region", r6(F.col("contact_prob"), "contact_prob"))


@query("nearest_action_by_confidence", """SELECT det_id, action_id, round(confidence,6) AS confidence FROM (
  SELECT d.det_id, a.action_id, a.confidence, row_number() OVER (PARTITION BY d.det_id ORDER BY a.confidence DESC NULLS LAST, a.action_frame, a.action_id) AS rn
  FROM det d LEFT JOIN act a ON d.match_id=a.match_id AND d.round_id=a.round_id AND d.striker_id=a.fighter_id AND a.action_frame BETWEEN d.frame-5 AND d.frame+5) WHERE rn=1""")
def _(spark, sf):
    a = A.actions(spark, sf).groupBy(*KEYS, F.col("fighter_id").alias("striker_id"), "action_frame").agg(
        F.min(F.when(F.col("confidence").isNotNull(), F.struct((-F.col("confidence")).alias("nc"), "action_id"))).alias("b"))
    a = a.select(*KEYS, "striker_id", "action_frame", (-F.col("b.nc")).alias("confidence"), "b.action_id")
    j = J.best_in_band(A.detections(spark, sf), a, [*KEYS, "striker_id"], left_on="frame", right_on="action_frame",
                       lo=-5, hi=5, order=[-F.col("confidence"), F.col("action_frame"), F.col("action_id")], keep=["action_id", "confidence"])
    return j.select("det_id", "action_id", r6(F.col("confidence"), "confidence"))


@query("nearest_action_by_frame", """SELECT contact_id, action_id, frame_gap FROM (
  SELECT c.contact_id, a.action_id, abs(a.action_frame-c.ce_frame) AS frame_gap, row_number() OVER (PARTITION BY c.contact_id ORDER BY abs(a.action_frame-c.ce_frame), a.action_frame, a.action_id) AS rn
  FROM ce c JOIN act a ON c.match_id=a.match_id AND c.round_id=a.round_id AND c.striker_id=a.fighter_id AND a.action_frame BETWEEN c.ce_frame-15 AND c.ce_frame+15) WHERE rn=1""")
def _(spark, sf):
    a = A.actions(spark, sf).groupBy(*KEYS, F.col("fighter_id").alias("striker_id"), "action_frame").agg(F.min("action_id").alias("action_id"))
    c = A.contacts(spark, sf)
    gap = F.abs(F.col("action_frame") - F.col("ce_frame"))
    j = J.best_in_band(c, a, [*KEYS, "striker_id"], left_on="ce_frame", right_on="action_frame", lo=-15, hi=15,
                       order=[gap, F.col("action_frame"), F.col("action_id")], keep=["action_id", "action_frame"])
    return j.where("action_id is not null").select("contact_id", "action_id", gap.alias("frame_gap"))


@query("fuzzy_window_match", """SELECT action_id, det_id, round(center_gap,2) AS center_gap FROM (
  SELECT a.action_id, d.det_id, abs(d.frame-(a.window_start+a.window_end)/2) AS center_gap, row_number() OVER (PARTITION BY a.action_id ORDER BY abs(d.frame-(a.window_start+a.window_end)/2), d.frame, d.det_id) AS rn
  FROM act a JOIN det d ON a.match_id=d.match_id AND a.round_id=d.round_id AND a.fighter_id=d.striker_id AND abs(d.frame-(a.window_start+a.window_end)/2) <= 8) WHERE rn=1""")
def _(spark, sf):
    d = A.detections(spark, sf).groupBy(*KEYS, "striker_id", "frame").agg(F.min("det_id").alias("det_id"))
    a = A.actions(spark, sf).withColumnRenamed("fighter_id", "striker_id").withColumn("center", (F.col("window_start") + F.col("window_end")) / 2)
    gap = F.abs(F.col("frame") - F.col("center"))
    j = J.best_in_band(a, d, [*KEYS, "striker_id"], left_on="center", right_on="frame", lo=-8, hi=8,
                       order=[gap, F.col("frame"), F.col("det_id")], keep=["det_id", "frame"])
    return j.where("det_id is not null").select("action_id", "det_id", F.round(gap, 2).alias("center_gap"))


def swaps(spark, sf):
    """Swap samples every 20 frames: swapped when the bucket's newest event id is divisible by 3."""
    e = A.events(spark, sf)
    return e.groupBy(*KEYS, (F.floor(F.col("frame") / 20) * 20).cast("int").alias("frame")).agg(
        (F.pmod(F.max("event_id"), F.lit(3)) == 0).alias("swapped")).where(F.pmod("frame", F.lit(60)) != 40)


SWP = "swp AS (SELECT match_id, round_id, frame // 20 * 20 AS frame, max(event_id) % 3 = 0 AS swapped FROM hev GROUP BY 1, 2, 3 HAVING (frame // 20 * 20) % 60 <> 40)"


@query("swap_timeline_lookup", f"""WITH {SWP} SELECT d.det_id, coalesce(s.swapped, false) AS swapped FROM det d LEFT JOIN swp s
  ON d.match_id=s.match_id AND d.round_id=s.round_id AND s.frame = d.frame // 20 * 20""")
def _(spark, sf):
    return J.bucket_asof(A.detections(spark, sf), swaps(spark, sf), KEYS, frame="frame", stride=20, value="swapped", default=F.lit(False)).select("det_id", "swapped")


@query("forward_fill_lookup", """SELECT d.det_id, arg_max(b.x1, b.frame) AS x1 FROM det d LEFT JOIN box b
  ON d.match_id=b.match_id AND d.round_id=b.round_id AND d.striker_id=b.track_id AND b.frame <= d.frame GROUP BY d.det_id""")
def _(spark, sf):
    tk = [*KEYS, "track_id"]
    axis = A.detections(spark, sf).select(*KEYS, F.col("striker_id").alias("track_id"), "frame").distinct()
    b = A.boxes(spark, sf).select(*tk, "frame", F.col("bbox.x1").alias("x1"))
    filled = forward_fill(axis.join(b, [*tk, "frame"], "full_outer"), tk, "frame", "x1", "x1_ff")
    filled = filled.select(*KEYS, F.col("track_id").alias("striker_id"), "frame", F.col("x1_ff").alias("x1"))
    return A.detections(spark, sf).join(filled, [*KEYS, "striker_id", "frame"], "left").select("det_id", "x1")


@query("neighbour_fallback_lookup", """SELECT det_id, x1 FROM (SELECT d.det_id, b.x1, row_number() OVER (PARTITION BY d.det_id ORDER BY abs(b.frame-d.frame), b.frame) AS rn
  FROM det d LEFT JOIN box b ON d.match_id=b.match_id AND d.round_id=b.round_id AND d.receiver_id=b.track_id AND b.frame BETWEEN d.frame-5 AND d.frame+5) WHERE rn=1""")
def _(spark, sf):
    b = A.boxes(spark, sf).select(*KEYS, F.col("track_id").alias("receiver_id"), F.col("frame").alias("bf"), F.col("bbox.x1").alias("x1"))
    j = J.best_in_band(A.detections(spark, sf), b, [*KEYS, "receiver_id"], left_on="frame", right_on="bf", lo=-5, hi=5,
                       order=[F.abs(F.col("bf") - F.col("frame")), F.col("bf")], keep=["x1"])
    return j.select("det_id", "x1")


@query("crop_centre_fallback", """SELECT det_id, CASE WHEN x1 IS NULL THEN 320 ELSE CAST(trunc(least(639.0::DOUBLE, greatest(0.0::DOUBLE, (x1+x2)/2))) AS INTEGER) END AS cx,
  CASE WHEN x1 IS NULL THEN 180 ELSE CAST(trunc(least(359.0::DOUBLE, greatest(0.0::DOUBLE, y1+(y2-y1)*CASE WHEN region='head' THEN 0.2 ELSE 0.5 END))) AS INTEGER) END AS cy FROM (
  SELECT d.det_id, d.region, b.x1, b.x2, b.y1, b.y2, row_number() OVER (PARTITION BY d.det_id ORDER BY abs(b.frame-d.frame), b.frame) AS rn
  FROM det d LEFT JOIN box b ON d.match_id=b.match_id AND d.round_id=b.round_id AND d.receiver_id=b.track_id AND b.frame BETWEEN d.frame-5 AND d.frame+5) WHERE rn=1""")
def _(spark, sf):
    b = A.boxes(spark, sf).select(*KEYS, F.col("track_id").alias("receiver_id"), F.col("frame").alias("bf"), "bbox")
    j = J.best_in_band(A.detections(spark, sf), b, [*KEYS, "receiver_id"], left_on="frame", right_on="bf", lo=-5, hi=5,
                       order=[F.abs(F.col("bf") - F.col("frame")), F.col("bf")], keep=["bbox"])
    share = F.when(F.col("region") == "head", 0.2).otherwise(0.5)
    box = F.col("bbox")
    cx = F.least(F.lit(639.0), F.greatest(F.lit(0.0), (box["x1"] + box["x2"]) / 2))
    cy = F.least(F.lit(359.0), F.greatest(F.lit(0.0), box["y1"] + (box["y2"] - box["y1"]) * share))
    # greatest/least skip NULLs, so the fallback tests the box itself
    return j.select("det_id", F.when(box.isNotNull(), cx.cast("int")).otherwise(320).alias("cx"),
                    F.when(box.isNotNull(), cy.cast("int")).otherwise(180).alias("cy"))


@query("exact_frame_lookup", "SELECT d.det_id, b.x1 FROM det d LEFT JOIN box b ON d.match_id=b.match_id AND d.round_id=b.round_id AND d.striker_id=b.track_id AND d.frame=b.frame")
def _(spark, sf):
    b = A.boxes(spark, sf).select(*KEYS, F.col("track_id").alias("striker_id"), "frame", F.col("bbox.x1").alias("x1"))
    return A.detections(spark, sf).join(b, [*KEYS, "striker_id", "frame"], "left").select("det_id", "x1")


@query("truth_window_coverage", """SELECT g.match_id, g.round_id, g.frame, count(DISTINCT a.action_frame) AS n_windows FROM gt g LEFT JOIN act a
  ON g.match_id=a.match_id AND g.round_id=a.round_id AND g.frame BETWEEN a.action_frame-8 AND a.action_frame+12 GROUP BY ALL""")
def _(spark, sf):
    # covering windows are counted per distinct action frame
    a = A.actions(spark, sf).select(*KEYS, "action_frame").distinct()
    g = A.truth(spark, sf)
    hits = J.band_join(g, a, KEYS, left_on="frame", right_on="action_frame", lo=-12, hi=8)
    n = hits.groupBy(*KEYS, "frame").agg(F.count(F.lit(1)).alias("n_windows"))
    return g.join(n, [*KEYS, "frame"], "left").na.fill(0, ["n_windows"])


@query("uncovered_truth", """SELECT g.* FROM gt g ANTI JOIN act a ON g.match_id=a.match_id AND g.round_id=a.round_id AND g.frame BETWEEN a.action_frame-8 AND a.action_frame+12""")
def _(spark, sf):
    a = A.actions(spark, sf)
    m = J.matched_in_band(A.truth(spark, sf), a, KEYS, left_on="frame", right_on="action_frame", lo=-12, hi=8)
    return m.where("not matched").drop("matched")


@query("label_by_truth_band", """SELECT d.det_id, CAST(EXISTS (SELECT 1 FROM gt g WHERE g.match_id=d.match_id AND g.round_id=d.round_id AND abs(g.frame-d.frame) <= 30) AS INTEGER) AS y FROM det d""")
def _(spark, sf):
    m = J.matched_in_band(A.detections(spark, sf), A.truth(spark, sf), KEYS, left_on="frame", right_on="frame", lo=-30, hi=30)
    return m.select("det_id", F.col("matched").cast("int").alias("y"))


@query("decayed_onset_strength", """SELECT d.det_id, round(coalesce(max(o.strength*(1-abs(o.onset_frame-d.frame)/11.0)),0),6) AS audio, round(coalesce(max(o.strength),0),6) AS audio_raw
  FROM det d LEFT JOIN ons o ON d.match_id=o.match_id AND d.round_id=o.round_id AND abs(o.onset_frame-d.frame) <= 10 GROUP BY d.det_id""")
def _(spark, sf):
    gap = F.abs(F.col("onset_frame") - F.col("frame"))
    j = J.aggregate_in_band(A.detections(spark, sf), A.onsets(spark, sf), KEYS, left_on="frame", right_on="onset_frame", lo=-10, hi=10,
                            aggs=[F.max(F.col("strength") * (1 - gap / 11.0)).alias("a"), F.max("strength").alias("b")])
    return j.select("det_id", r6(F.coalesce("a", F.lit(0.0)), "audio"), r6(F.coalesce("b", F.lit(0.0)), "audio_raw"))


@query("time_range_envelope", """SELECT d.det_id, round(coalesce(max(o.strength),0),6) AS env FROM det d LEFT JOIN ons o ON d.match_id=o.match_id AND d.round_id=o.round_id
  AND o.onset_frame/25.0 BETWEEN d.frame/25.0-0.30 AND d.frame/25.0+0.30 GROUP BY d.det_id""")
def _(spark, sf):
    d = A.detections(spark, sf).select("det_id", *KEYS, "frame").withColumn("t", F.col("frame") / 25.0)
    o = A.onsets(spark, sf).withColumn("ot", F.col("onset_frame") / 25.0)
    j = J.aggregate_in_band(d, o, KEYS, left_on="t", right_on="ot", lo=-0.30, hi=0.30, width=0.6, aggs=[F.max("strength").alias("e")])
    return j.select("det_id", r6(F.coalesce("e", F.lit(0.0)), "env"))


@query("candidate_union_outer", """SELECT coalesce(a.match_id,b.match_id) AS match_id, coalesce(a.round_id,b.round_id) AS round_id, coalesce(a.frame,b.frame) AS frame,
  round(coalesce(a.s,0),6) AS score_a, round(coalesce(b.s,0),6) AS score_b FROM (SELECT match_id, round_id, frame, max(score) AS s FROM det GROUP BY ALL) a FULL JOIN
  (SELECT match_id, round_id, ce_frame AS frame, max(contact_prob) AS s FROM ce GROUP BY ALL) b ON a.match_id=b.match_id AND a.round_id=b.round_id AND a.frame=b.frame""")
def _(spark, sf):
    a = A.detections(spark, sf).groupBy(*KEYS, "frame").agg(F.max("score").alias("score_a"))
    b = A.contacts(spark, sf).groupBy(*KEYS, F.col("ce_frame").alias("frame")).agg(F.max("contact_prob").alias("score_b"))
    j = a.join(b, [*KEYS, "frame"], "full_outer").na.fill(0.0, ["score_a", "score_b"])
    return j.select(*KEYS, "frame", r6(F.col("score_a"), "score_a"), r6(F.col("score_b"), "score_b"))


@query("clip_confidence_join", """SELECT c.contact_id, round(coalesce(max(a.confidence),1.0),6) AS confidence FROM ce c LEFT JOIN act a
  ON c.match_id=a.match_id AND c.round_id=a.round_id AND c.striker_id=a.fighter_id AND c.ce_frame=a.action_frame GROUP BY c.contact_id""")
def _(spark, sf):
    a = A.actions(spark, sf).groupBy(*KEYS, F.col("fighter_id").alias("striker_id"), F.col("action_frame").alias("ce_frame")).agg(F.max("confidence").alias("confidence"))
    j = A.contacts(spark, sf).join(a, [*KEYS, "striker_id", "ce_frame"], "left")
    return j.select("contact_id", r6(F.coalesce("confidence", F.lit(1.0)), "confidence"))


@query("overlapping_box_pairs", f"SELECT s.match_id, s.round_id, s.frame, s.track_id AS track_a, r.track_id AS track_b, round({iou('s', 'r')},6) AS iou FROM {BPAIR} AND s.track_id < r.track_id WHERE {iou('s', 'r')} >= 0.0")
def _(spark, sf):
    p = box_pairs(spark, sf).where("s.track_id < r.track_id").withColumn("iou", G.box_iou(F.col("s.bbox"), F.col("r.bbox"))).where("iou >= 0.0")
    return p.select(*KEYS, "frame", F.col("s.track_id").alias("track_a"), F.col("r.track_id").alias("track_b"), r6(F.col("iou"), "iou"))


@query("detector_agreement", """WITH a AS (SELECT DISTINCT match_id, round_id, frame FROM det), b AS (SELECT DISTINCT match_id, round_id, ce_frame AS frame FROM ce)
  SELECT 'both' AS side, count(*) AS n FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.match_id=b.match_id AND a.round_id=b.round_id AND abs(a.frame-b.frame) <= 8)
  UNION ALL SELECT 'a_only', count(*) FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.match_id=b.match_id AND a.round_id=b.round_id AND abs(a.frame-b.frame) <= 8)
  UNION ALL SELECT 'b_only', count(*) FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.match_id=b.match_id AND a.round_id=b.round_id AND abs(a.frame-b.frame) <= 8)""")
def _(spark, sf):
    a = A.detections(spark, sf).select(*KEYS, "frame").distinct()
    b = A.contacts(spark, sf).select(*KEYS, F.col("ce_frame").alias("frame")).distinct()
    ma = J.matched_in_band(a, b, KEYS, left_on="frame", right_on="frame", lo=-8, hi=8)
    mb = J.matched_in_band(b, a, KEYS, left_on="frame", right_on="frame", lo=-8, hi=8)
    sides = ma.select(F.when(F.col("matched"), "both").otherwise("a_only").alias("side")).unionAll(
        mb.where("not matched").select(F.lit("b_only").alias("side")))
    return sides.groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("parameter_grid", """SELECT d.det_id, g.thr, g.cd FROM det d CROSS JOIN (SELECT unnest([0.1::DOUBLE,0.2,0.3]) AS thr) g0 CROSS JOIN (SELECT unnest([6,18]) AS cd) g1, LATERAL (SELECT g0.thr AS thr, g1.cd AS cd) g WHERE d.score >= g.thr""")
def _(spark, sf):
    from contactflow.operators.search import with_grid
    return with_grid(A.detections(spark, sf), {"thr": [0.1, 0.2, 0.3], "cd": [6, 18]}).where("score >= thr").select("det_id", "thr", "cd")


@query("wrist_body_min_distance", f"SELECT {PKEY}, round({min_pair('s', P.wrists, 'r', (*P.head, *P.torso))},6) AS d FROM {PAIR}")
def _(spark, sf):
    w = G.joints_of(F.col("s.joints"), A.PROFILE.wrists)
    b = G.joints_of(F.col("r.joints"), (*A.PROFILE.head, *A.PROFILE.torso))
    return pairs(spark, sf).select(*PK, r6(G.min_dist(w, b), "d"))


@query("external_track_match", f"""SELECT match_id, round_id, frame, track_id, other_track, round(iou,6) AS iou FROM (
  SELECT s.match_id, s.round_id, s.frame, s.track_id, r.track_id AS other_track, {iou('s', 'r')} AS iou, row_number() OVER (PARTITION BY s.match_id, s.round_id, s.frame, s.track_id ORDER BY {iou('s', 'r')} DESC, r.track_id) AS rn
  FROM {BPAIR} WHERE {iou('s', 'r')} >= 0.15) WHERE rn=1""")
def _(spark, sf):
    p = box_pairs(spark, sf).withColumn("iou", G.box_iou(F.col("s.bbox"), F.col("r.bbox"))).where("iou >= 0.15")
    b = p.groupBy(*KEYS, "frame", F.col("striker_id").alias("track_id")).agg(
        J.least([-F.col("iou"), F.col("receiver_id")]).alias("b"))
    return b.select(*KEYS, "frame", "track_id", F.col("b._o1").alias("other_track"), r6(-F.col("b._o0"), "iou"))
