"""Scan and sink queries (groups S and K): raw JSON built from the tables, parsed by the readers."""
from __future__ import annotations

from pyspark.sql import functions as F

from contactflow.operators import labels as L
from contactflow.plans.q_candidates import features
from contactflow.plans.q_geometry import BK, r6
from contactflow.plans.q_joins import SWP, swaps
from contactflow.plans.registry import query
from contactflow.plans.sqltext import X, Y
from contactflow.schema import raw_action, raw_clip, raw_contact, raw_entry
from contactflow.sources import adapters as A
from contactflow.sources import readers as R
from contactflow.sources import writers as K

KEYS = ["match_id", "round_id"]


@query("pose_entry_scan", f"SELECT match_id, round_id, track_id, frame, round({X('p', 0)}*3,6) AS x0, round({Y('p', 0)}*3,6) AS y0, 21 AS n_joints, round(x1,4) AS bx1 FROM pz p")
def _(spark, sf):
    # one JSON line per entry, with the default resize of 1920x1080 to 640x360
    p = A.pose(spark, sf)
    line = F.to_json(F.struct("track_id", "frame", F.array(*[F.col(f"bbox.{c}") for c in ("x1", "y1", "x2", "y2")]).alias("bbox"),
                              F.transform("joints", lambda j: F.array(j["x"], j["y"])).alias("joints_2d")))
    e = R.parse_entries(p.select(*KEYS, F.from_json(line, raw_entry).alias("e")))
    j = F.get("joints_2d", F.lit(0))
    return e.select(*BK, r6(j["x"], "x0"), r6(j["y"], "y0"), F.size("joints_2d").alias("n_joints"), F.round("bbox.x1", 4).alias("bx1"))


@query("pose_3d_entry_scan", f"SELECT match_id, round_id, track_id, frame, round({X('p', 7)},6) AS x7, round({X('p', 7)}+1.5,6) AS cam_x7, true AS no_2d FROM pz p")
def _(spark, sf):
    p = A.pose(spark, sf)
    line = F.to_json(F.struct("track_id", "frame", F.transform("joints", lambda j: F.array(j["x"], j["y"], j["z"])).alias("normalized_coords"),
                              F.array(F.lit(1.5), F.lit(0.0), F.lit(5.0)).alias("pred_cam_t")))
    e = R.parse_entries(p.select(*KEYS, F.from_json(line, raw_entry).alias("e")))
    j = F.get("normalized_coords", F.lit(7))
    return e.select(*BK, r6(j["x"], "x7"), r6(j["x"] + F.col("pred_cam_t.x"), "cam_x7"), F.col("joints_2d").isNull().alias("no_2d"))


@query("box_only_scan", "SELECT match_id, round_id, track_id, frame, round(x1,4) AS x1, round(y2,4) AS y2 FROM pz")
def _(spark, sf):
    return R.boxes_only(A.pose(spark, sf)).select(*BK, F.round("bbox.x1", 4).alias("x1"), F.round("bbox.y2", 4).alias("y2"))


@query("action_document_scan", "SELECT action_id, fighter_id, action, 'Head' AS target, round(CASE WHEN action_id%2=0 THEN speed_kmh ELSE 0 END,6) AS speed_kmh, 0.0::DOUBLE AS power_watts, window_start AS frame FROM act")
def _(spark, sf):
    a = A.actions(spark, sf)
    doc = F.to_json(F.struct(F.array(F.struct(
        F.concat(F.lit("fighter_"), F.col("fighter_id").cast("string")).alias("fighter_type"), "action", "confidence", "window_start", "window_end",
        F.when(F.pmod("action_id", F.lit(2)) == 0, F.struct(F.col("speed_kmh").alias("estimated_speed_kmh"))).alias("speed_estimation"))).alias("actions")))
    d = a.select("action_id", F.from_json(doc, "struct<actions:" + f"array<{raw_action.simpleString()}>>").alias("d")).select("action_id", "d.actions")
    return R.parse_actions(d).select("action_id", "fighter_id", "action", "target", r6(F.col("speed_kmh"), "speed_kmh"), "power_watts", "frame")


@query("annotation_export_scan", "SELECT action_id, action, window_start, window_end, part, 1.0::DOUBLE AS confidence FROM (SELECT *, 'part0' || CAST(action_id%3+1 AS VARCHAR) AS part FROM act) WHERE part <> 'part03'")
def _(spark, sf):
    a = A.actions(spark, sf)
    part = F.concat(F.lit("part0"), (F.pmod("action_id", F.lit(3)) + 1).cast("string"))
    doc = F.to_json(F.struct(F.array(F.struct(part.alias("part"), F.col("action").alias("label"), F.col("window_start").alias("start"), F.col("window_end").alias("end"))).alias("labels"),
                             F.array(*[F.struct(F.lit(f"part0{i}").alias("part"), F.lit(1500).alias("frame_count"), F.lit(1500 * (i - 1)).alias("frame_offset")) for i in (1, 2)]).alias("parts")))
    d = a.select("action_id", F.from_json(doc, R.annotation_export).alias("d")).select("action_id", "d.labels", "d.parts")
    return R.parse_annotations(d).select("action_id", "action", "window_start", "window_end", "part", "confidence")


@query("contact_event_scan", "SELECT match_id, round_id, ce_frame AS frame, striker_id, receiver_id, round(contact_prob,6) AS contact_prob, contact_region FROM ce")
def _(spark, sf):
    c = A.contacts(spark, sf)
    doc = F.to_json(F.struct(F.array(F.struct(F.col("ce_frame").alias("frame"), "striker_id", "receiver_id", "contact_prob", "contact_3d_distance_m", "contact_region")).alias("contact_events")))
    d = c.select(*KEYS, F.from_json(doc, f"struct<contact_events:array<{raw_contact.simpleString()}>>")["contact_events"].alias("contact_events"))
    return R.document_contacts(d).select(*KEYS, "frame", "striker_id", "receiver_id", r6(F.col("contact_prob"), "contact_prob"), "contact_region")


@query("ground_truth_scan", "SELECT det_id, frame, CASE det_id%4 WHEN 0 THEN 'landed' WHEN 1 THEN 'missed' ELSE 'other' END AS kind FROM det")
def _(spark, sf):
    v = A._pick(["LANDED", "MISS", "BLOCKED", "CLINCH"], F.pmod("det_id", F.lit(4)))
    d = A.detections(spark, sf).select("det_id", F.array(F.struct("frame", v.alias("verdict"))).alias("annotations"))
    return R.parse_truth(d).select("det_id", "frame", "kind")


@query("manifest_scan", "SELECT doc_id, 'clip_' || doc_id AS clip, CASE WHEN quality=1 THEN 'impact' ELSE 'not_impact' END AS label FROM labels WHERE doc_id%7<>0")
def _(spark, sf):
    l = A.table(spark, sf, "labels")
    doc = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("clip_"), F.col("doc_id").cast("string")).alias("clip"), F.when(F.pmod("doc_id", F.lit(7)) != 0, F.when(F.col("quality") == 1, "impact").otherwise("not_impact")).alias("label"))).alias("clips")))
    d = l.select("doc_id", F.from_json(doc, f"struct<clips:array<{raw_clip.simpleString()}>>")["clips"].alias("clips"))
    return R.parse_manifest(d).select("doc_id", "clip", "label")


@query("swap_timeline_scan", f"WITH {SWP} SELECT match_id, round_id, 20 AS stride, frame, swapped FROM swp")
def _(spark, sf):
    s = swaps(spark, sf)
    doc = F.to_json(F.struct(F.lit(20).alias("stride"), F.create_map(F.col("frame").cast("string"), F.col("swapped")).alias("timeline")))
    return R.parse_swaps(s.select(*KEYS, doc.alias("value"))).select(*KEYS, "stride", "frame", "swapped")


@query("detection_schema_reconciliation", "SELECT det_id, frame, round(score,6) AS score FROM det")
def _(spark, sf):
    # two exports name the same things differently
    d = A.detections(spark, sf)
    odd = F.pmod("det_id", F.lit(2)) == 1
    ev = F.array(F.struct(F.when(odd, F.col("frame")).alias("impact_frame"), F.when(~odd, F.col("frame")).alias("frame"),
                          F.when(odd, F.col("score")).alias("impact_score"), F.when(~odd, F.col("score")).alias("punch_prob")))
    return R.reconcile_detections(d.select("det_id", ev.alias("events"))).select("det_id", "frame", r6(F.col("score"), "score"))


@query("scored_candidate_scan", "SELECT fighter_id AS striker_id, window_start, window_end, match_id, round_id, round(max(confidence),6) AS impact_score FROM act GROUP BY ALL")
def _(spark, sf):
    a = A.actions(spark, sf).select(*KEYS, F.array(F.struct(F.col("fighter_id").alias("striker_id"), "window_start", "window_end", F.col("confidence").alias("impact_score"))).alias("all_scored_candidates"))
    e = a.select(*KEYS, F.explode("all_scored_candidates").alias("c")).select(*KEYS, "c.*")
    return e.groupBy("striker_id", "window_start", "window_end", *KEYS).agg(F.round(F.max("impact_score"), 6).alias("impact_score"))


@query("labelled_clip_names", """SELECT det_id, CASE WHEN det_id%3=0 THEN 'punch' ELSE 'not_punch' END AS label, round((frame//60)*60+frame%60+0.25::DOUBLE,2) AS time_sec, frame FROM det""")
def _(spark, sf):
    d = A.detections(spark, sf)
    name = F.format_string("c%d_t%dm%d.25s_f%d.mp4", "det_id", F.floor(F.col("frame") / 60).cast("int"), F.pmod("frame", F.lit(60)), "frame")
    # every clip has a not_punch copy; some also a punch copy, which wins
    folders = F.when(F.pmod("det_id", F.lit(3)) == 0, F.array(F.lit("/a/not_punch/"), F.lit("/a/punch/"))).otherwise(F.array(F.lit("/a/not_punch/")))
    f = d.select(name.alias("n"), F.explode(folders).alias("f")).select(F.concat("f", "n").alias("path"))
    c = R.labelled_clips(f)
    return c.select(F.regexp_extract("clip", r"^c(\d+)_", 1).cast("long").alias("det_id"), "label", F.round("time_sec", 2).alias("time_sec"), "frame")


@query("landmark_scan", "SELECT match_id, round_id, frame, track_id, round(e[1],6) AS vis0 FROM pz")
def _(spark, sf):
    p = A.pose(spark, sf)
    doc = F.to_json(F.struct(F.create_map(F.col("frame").cast("string"), F.create_map(F.col("track_id").cast("string"), F.struct(
        F.transform("joints", lambda j: j["x"]).alias("visibility")))).alias("frames")))
    return R.parse_landmarks(p.select(*KEYS, doc.alias("value"))).select(*KEYS, "frame", "track_id", r6(F.get("visibility", F.lit(0)), "vis0"))


@query("registry_lookup", "SELECT d.det_id, 'match_' || d.match_id AS match_name, 'keypoints' AS tracking_format FROM det d")
def _(spark, sf):
    reg = A.events(spark, sf).select("match_id").distinct().select("match_id", F.concat(F.lit("match_"), F.col("match_id").cast("string")).alias("match_name"), F.lit("keypoints").alias("tracking_format"))
    return R.registry_lookup(A.detections(spark, sf), reg).select("det_id", "match_name", "tracking_format")


@query("verdict_scan", "SELECT det_id, frame, ['LANDED','BLOCKED','MISS','CLINCH','UNCLEAR'][det_id%5+1] AS verdict FROM det")
def _(spark, sf):
    d = A.detections(spark, sf)
    v = A._pick(list(L.VERDICTS), F.pmod("det_id", F.lit(5)))
    doc = F.to_json(F.create_map(F.col("frame").cast("string"), F.struct(v.alias("verdict"), F.lit("ok").alias("note"))))
    return R.parse_verdicts(d.select("det_id", doc.alias("value"))).select("det_id", "frame", "verdict")


@query("recording_from_path", "SELECT det_id, 'm' || match_id AS match_name, round_id FROM det")
def _(spark, sf):
    d = A.detections(spark, sf).select("det_id", F.format_string("/data/m%d/Round%d/pose.json", "match_id", "round_id").alias("p"))
    return R.with_recording(d, F.col("p")).select("det_id", F.col("match_id").alias("match_name"), "round_id")


@query("detection_export_rows", """SELECT det_id, match_id, round_id, frame AS impact_frame, round(score,4) AS impact_score, round(conf,3) AS g_conf, round(ce,3) AS g_ce, 'evidence' AS approach, 0.2::DOUBLE AS threshold, 18 AS cooldown, 25.0::DOUBLE AS fps,
  count(*) OVER (PARTITION BY match_id, round_id) AS n_impacts, round(frame/25.0,3) AS timestamp_seconds FROM ft""")
def _(spark, sf):
    f = features(spark, sf)
    e = K.detection_events(f.withColumn("det", F.col("det_id")), "evidence", 0.2, 18, ["conf", "ce", "det"], fps=A.FPS)
    return e.select(F.col("gates.det").cast("long").alias("det_id"), *KEYS, "impact_frame", "impact_score", F.col("gates.conf").alias("g_conf"), F.col("gates.ce").alias("g_ce"), "approach",
                    "threshold", "cooldown", "fps", "n_impacts", "timestamp_seconds")
