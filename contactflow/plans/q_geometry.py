"""Geometry queries (survey group P) and the predicates built on them (group F)."""
from __future__ import annotations

from pyspark.sql import functions as F

from contactflow.functions import geometry as G
from contactflow.functions import kinematics as K
from contactflow.operators.joins import interval_join, pairs_same_frame
from contactflow.plans.registry import query
from contactflow.plans.sqltext import (
    BPAIR, HX, HY, PAIR, PKEY, PX, PY, SW, X, Y, Z, P, dj, dpx, hyp, iou, least_of, mean, min_pair, segdist)
from contactflow.sources import adapters as A

PROFILE = A.PROFILE
R6 = 6


def r6(c, name):
    return F.round(c, R6).alias(name)


def pairs(spark, sf):
    """Directed pose pairs with the pair's ids as columns."""
    p = pairs_same_frame(A.pose(spark, sf))
    return p.withColumn("striker_id", F.col("s.track_id")).withColumn("receiver_id", F.col("r.track_id"))


def box_pairs(spark, sf):
    p = pairs_same_frame(A.boxes(spark, sf))
    return p.withColumn("striker_id", F.col("s.track_id")).withColumn("receiver_id", F.col("r.track_id"))


PK = ["match_id", "round_id", "frame", "striker_id", "receiver_id"]
BK = ["match_id", "round_id", "track_id", "frame"]


@query("joint_centroids", f"""SELECT match_id, round_id, track_id, frame, round({HX('p')},6) AS head_x, round({HY('p')},6) AS head_y,
  round({mean(X('p', j) for j in P.torso)},6) AS torso_x, round({mean(Y('p', j) for j in P.torso)},6) AS torso_y FROM pz p""")
def _(spark, sf):
    p = A.pose(spark, sf)
    h, t = G.centroid(F.col("joints"), PROFILE.head), G.centroid(F.col("joints"), PROFILE.torso)
    return p.select(*BK, r6(h["x"], "head_x"), r6(h["y"], "head_y"), r6(t["x"], "torso_x"), r6(t["y"], "torso_y"))


@query("joint_distance", f"""SELECT {PKEY}, round({dj('s', P.left_wrist, 'r', 0, 'xyz')},6) AS d3, round({dj('s', P.left_wrist, 'r', 0)},6) AS dxy FROM {PAIR}""")
def _(spark, sf):
    a, b = G.joint(F.col("s.joints"), PROFILE.left_wrist), G.joint(F.col("r.joints"), 0)
    return pairs(spark, sf).select(*PK, r6(G.dist(a, b, "xyz"), "d3"), r6(G.dist(a, b), "dxy"))


@query("box_measures", """SELECT match_id, round_id, track_id, frame, round((x1+x2)/2,6) AS cx, round((y1+y2)/2,6) AS cy,
  round((x2-x1)*(y2-y1),6) AS area, round(y1+0.18*(y2-y1),6) AS head_y, round(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))+1e-6,6) AS diag FROM box""")
def _(spark, sf):
    b = F.col("bbox")
    return A.boxes(spark, sf).select(*BK, r6(G.box_center(b)["x"], "cx"), r6(G.box_center(b)["y"], "cy"),
                                     r6(G.box_area(b), "area"), r6(G.box_head(b)["y"], "head_y"), r6(G.box_diag(b), "diag"))


@query("box_iou_pairs", f"SELECT {PKEY}, round({iou('s', 'r')},6) AS iou FROM {BPAIR}")
def _(spark, sf):
    return box_pairs(spark, sf).select(*PK, r6(G.box_iou(F.col("s.bbox"), F.col("r.bbox")), "iou"))


_ex = ",".join(X("p", j) for j in range(A.N_JOINTS))
_ey = ",".join(Y("p", j) for j in range(A.N_JOINTS))


@query("project_joint_to_box", f"""SELECT match_id, round_id, track_id, frame,
  round(x1+({X('p', 20)}-list_min([{_ex}]))/(list_max([{_ex}])-list_min([{_ex}]))*(x2-x1),4) AS u,
  round(y1+({Y('p', 20)}-list_min([{_ey}]))/(list_max([{_ey}])-list_min([{_ey}]))*(y2-y1),4) AS v FROM pz p""")
def _(spark, sf):
    p = A.pose(spark, sf)
    q = G.project_to_box(F.col("joints"), F.col("bbox"), G.joint(F.col("joints"), 20))
    return p.select(*BK, F.round(q["x"], 4).alias("u"), F.round(q["y"], 4).alias("v"))


@query("pinhole_projection", f"""SELECT match_id, round_id, track_id, frame, round(u,4) AS u, round(v,4) AS v FROM (
  SELECT *, 900*{X('p', 0)}/({Z('p', 0)}+0.3)+960 AS u, 900*{Y('p', 0)}/({Z('p', 0)}+0.3)+540 AS v FROM pz p) p
  WHERE {Z('p', 0)}+0.3 > 0.1 AND u >= 0 AND u < 1920 AND v >= 0 AND v < 1080""")
def _(spark, sf):
    j = G.joint(F.col("joints"), 0)
    p = F.struct(j["x"].alias("x"), j["y"].alias("y"), (j["z"] + 0.3).alias("z"))
    d = A.pose(spark, sf).withColumn("uv", G.pinhole(p, F.lit(900.0), 1920, 1080)).where("uv is not null")
    return d.select(*BK, F.round("uv.x", 4).alias("u"), F.round("uv.y", 4).alias("v"))


@query("camera_space_joints", f"""SELECT match_id, round_id, track_id, frame, round({X('p', 0)}+{X('p', 9)},6) AS x, round({Y('p', 0)}+{Y('p', 9)},6) AS y,
  round({Z('p', 0)}+{Z('p', 9)},6) AS z FROM pz p""")
def _(spark, sf):
    p = A.pose(spark, sf)
    cam = G.to_camera_space(F.col("joints"), G.joint(F.col("joints"), 9))
    n = G.joint(cam, 0)
    return p.select(*BK, r6(n["x"], "x"), r6(n["y"], "y"), r6(n["z"], "z"))


@query("shoulder_width", f"SELECT match_id, round_id, track_id, frame, round({SW('p')},6) AS sw FROM pz p")
def _(spark, sf):
    return A.pose(spark, sf).select(*BK, r6(G.shoulder_width(F.col("joints"), PROFILE, F.col("bbox")), "sw"))


_sd = segdist(X("r", 7), Y("r", 7), X("s", 19), Y("s", 19), HX("r"), HY("r"))


@query("guard_segment_distance", f"SELECT {PKEY}, round({_sd},6) AS d FROM {PAIR}")
def _(spark, sf):
    d = G.segment_distance(G.joint(F.col("r.joints"), 7), G.joint(F.col("s.joints"), 19),
                           G.centroid(F.col("r.joints"), PROFILE.head))
    return pairs(spark, sf).select(*PK, r6(d, "d"))


_UV = "900*{x}/({z})+960 AS u, {sign}900*{y}/({z})+540 AS v"
_ONSCREEN = "u >= 0 AND u < 1920 AND v >= 0 AND v < 1080"


@query("pinhole_projection_variants", f"""SELECT match_id, round_id, track_id, frame, 'up' AS variant, round(u,4) AS u, round(v,4) AS v FROM (SELECT *, {_UV.format(x=X('p', 0), y=Y('p', 0), z=Z('p', 0) + '+0.3', sign='-')} FROM pz p) p WHERE {Z('p', 0)}+0.3 > 0.05 AND {_ONSCREEN}
  UNION ALL SELECT match_id, round_id, track_id, frame, 'camera', trunc(u), trunc(v) FROM (SELECT *, {_UV.format(x='(' + X('p', 0) + '+0.1)', y='(' + Y('p', 0) + '-0.1)', z=Z('p', 0) + '+2', sign='')} FROM pz p) p WHERE {Z('p', 0)}+2 > 0.1 AND {_ONSCREEN.replace('u ', 'trunc(u) ').replace('v ', 'trunc(v) ')}""")
def _(spark, sf):
    """The y axis upwards behind a nearer plane, and whole pixels of joints moved into the camera's space."""
    p, j = A.pose(spark, sf), G.joint(F.col("joints"), 0)
    up = G.pinhole(F.struct(j["x"].alias("x"), j["y"].alias("y"), (j["z"] + 0.3).alias("z")), F.lit(900.0), 1920, 1080, 0.05, up=True)
    cam = G.pinhole(G.joint(G.to_camera_space(F.col("joints"), F.struct(F.lit(0.1).alias("x"), F.lit(-0.1).alias("y"), F.lit(2.0).alias("z"))), 0), F.lit(900.0), 1920, 1080, whole=True)
    both = F.filter(F.array(F.struct(F.lit("up").alias("variant"), up.alias("p")), F.struct(F.lit("camera").alias("variant"), cam.alias("p"))), lambda v: v["p"].isNotNull())
    return p.select(*BK, F.explode(both).alias("b")).select(*BK, "b.variant", F.round("b.p.x", 4).alias("u"), F.round("b.p.y", 4).alias("v"))


@query("fist_position_of_pose", f"""SELECT {PKEY}, round(CASE WHEN s.frame % 2 = 0 THEN {PX('s', 19)} WHEN s.frame % 3 = 0 THEN {PX('s', 20)} WHEN s.x1+s.x2 < r.x1+r.x2 THEN s.x2 ELSE s.x1 END,4) AS fx,
  round(CASE WHEN s.frame % 2 = 0 THEN {PY('s', 19)} WHEN s.frame % 3 = 0 THEN {PY('s', 20)} ELSE s.y1+0.28*(s.y2-s.y1) END,4) AS fy FROM {PAIR}""")
def _(spark, sf):
    """The first wrist in sight, else the box's edge; the left wrist is in sight on even frames, the right one on every third."""
    seen = lambda i, k: F.when(F.pmod("frame", F.lit(k)) == 0, F.struct(G.joint(F.col("s.px"), i)["x"].alias("x"), G.joint(F.col("s.px"), i)["y"].alias("y")))
    f = G.fist_position(F.array(seen(PROFILE.left_wrist, 2), seen(PROFILE.right_wrist, 3)), F.col("s.bbox"), F.col("r.bbox"))
    return pairs(spark, sf).select(*PK, F.round(f["x"], 4).alias("fx"), F.round(f["y"], 4).alias("fy"))


@query("fist_position", f"""SELECT {PKEY}, round(CASE WHEN s.x1+s.x2 < r.x1+r.x2 THEN s.x2 ELSE s.x1 END,4) AS fx,
  round(s.y1+0.28*(s.y2-s.y1),4) AS fy FROM {BPAIR}""")
def _(spark, sf):
    none = F.array(F.lit(None).cast("struct<x:double,y:double>"))
    f = G.fist_position(none, F.col("s.bbox"), F.col("r.bbox"))
    return box_pairs(spark, sf).select(*PK, F.round(f["x"], 4).alias("fx"), F.round(f["y"], 4).alias("fy"))


@query("depth_from_box", """SELECT match_id, round_id, track_id, frame, round(900*1.75/nullif(y2-y1,0),6) AS depth_m,
  round((x2-x1)*(y2-y1)/(1920.0*1080.0+1e-6),8) AS depth_proxy FROM box""")
def _(spark, sf):
    b = F.col("bbox")
    return A.boxes(spark, sf).select(*BK, r6(G.depth_from_box(b, F.lit(900.0), 1.75), "depth_m"),
                                     F.round(G.depth_proxy(b, 1920.0 * 1080.0), 8).alias("depth_proxy"))


_cx = mean(PX("r", j) for j in P.torso)
_sy = mean(PY("r", j) for j in (P.left_shoulder, P.right_shoulder))
_hy = mean(PY("r", j) for j in (P.left_hip, P.right_hip))
_hd = least_of(dpx("s", 20, "r", j) for j in P.head)


@query("contact_zone", f"""SELECT {PKEY}, CASE WHEN {_hd} < 100 THEN 'head_' WHEN {PY('s', 20)} < ({_sy}+{_hy})/2 THEN 'upper_torso_' ELSE 'lower_torso_' END
  || CASE WHEN {PX('s', 20)} < {_cx} THEN 'left' ELSE 'right' END AS zone FROM {PAIR}""")
def _(spark, sf):
    z = G.contact_zone(G.joint(F.col("s.px"), 20), F.col("r.px"), PROFILE)
    return pairs(spark, sf).select(*PK, z.alias("zone"))


_cands = [(k, "head") for k in P.head] + [(k, "torso") for k in P.torso] + [(7, "arm"), (8, "arm")]
_structs = ",".join(f"{{'d': {least_of([dj('s', 19, 'r', k), dj('s', 20, 'r', k)])}, 'k': {k}, 'region': '{g}'}}" for k, g in _cands)


@query("nearest_joint_region", f"""SELECT match_id, round_id, frame, striker_id, receiver_id, round(m.d,6) AS d, m.k AS joint, m.region AS region FROM (
  SELECT {PKEY}, list_min([{_structs}]) AS m FROM {PAIR})""")
def _(spark, sf):
    w = F.array(G.joint(F.col("s.joints"), 19), G.joint(F.col("s.joints"), 20))
    m = G.nearest_joint_region(w, F.col("r.joints"), PROFILE)
    return pairs(spark, sf).withColumn("m", m).select(*PK, r6(F.col("m.d"), "d"), F.col("m.k").alias("joint"), "m.region")


@query("striking_hand", """SELECT action_id, action, CASE WHEN action LIKE '%\\_left' ESCAPE '\\' THEN 'left'
  WHEN action LIKE '%\\_right' ESCAPE '\\' THEN 'right' ELSE 'right' END AS hand FROM act""")
def _(spark, sf):
    return A.actions(spark, sf).select("action_id", "action", G.hand_of_action(F.col("action")).alias("hand"))


@query("fighter_track_id", "SELECT action_id, fighter_id AS track_id FROM act")
def _(spark, sf):
    a = A.actions(spark, sf).withColumn("fighter_type", F.concat(F.lit("fighter_"), F.col("fighter_id").cast("string")))
    return a.select("action_id", G.track_of_fighter(F.col("fighter_type")).alias("track_id"))


@query("union_crop_side", f"""SELECT {PKEY}, round(greatest(200.0::DOUBLE, greatest(greatest(s.x2,r.x2)-least(s.x1,r.x1),
  greatest(s.y2,r.y2)-least(s.y1,r.y1))*1.4),4) AS side FROM {BPAIR}""")
def _(spark, sf):
    return box_pairs(spark, sf).select(*PK, F.round(G.padded_square_side(F.col("s.bbox"), F.col("r.bbox")), 4).alias("side"))


@query("joint_trajectory", f"""SELECT action_id, p.frame, round({X('p', 20)},6) AS x, round({Y('p', 20)},6) AS y, round({Z('p', 20)},6) AS z
  FROM pact a JOIN pz p ON a.match_id=p.match_id AND a.round_id=p.round_id AND a.fighter_id=p.track_id AND p.frame BETWEEN window_start AND window_end""")
def _(spark, sf):
    j = interval_join(A.pose_actions(spark, sf),
                      A.pose(spark, sf).withColumnRenamed("track_id", "fighter_id")
                      .select("match_id", "round_id", "fighter_id", "frame", G.joint(F.col("joints"), 20).alias("j")),
                      ["match_id", "round_id", "fighter_id"], start="window_start", end="window_end", before=0, after=0)
    return j.select("action_id", "frame", r6(F.col("j.x"), "x"), r6(F.col("j.y"), "y"), r6(F.col("j.z"), "z"))


@query("joint_subset_confidence", f"""SELECT match_id, round_id, track_id, frame, 17 AS n_joints,
  CAST({'+'.join(f"(CASE WHEN abs({PX('p', j)})<=1e-8 AND abs({PY('p', j)})<=1e-8 THEN 0 ELSE 1 END)" for j in range(17))} AS DOUBLE) AS conf_sum FROM pz p""")
def _(spark, sf):
    s = G.joint_subset(F.col("px"), 17)
    return A.pose(spark, sf).select(*BK, F.size(s).alias("n_joints"),
                                    F.aggregate(s, F.lit(0.0), lambda a, v: a + v["conf"]).alias("conf_sum"))


@query("region_marker", """SELECT c.contact_id, CAST(trunc((b.x1+b.x2)/2) AS INTEGER) AS mx, CAST(trunc(b.y1 + CASE contact_region WHEN 'head' THEN 0.13
  WHEN 'left_arm' THEN 0.40 WHEN 'right_arm' THEN 0.40 WHEN 'left_leg' THEN 0.80 WHEN 'right_leg' THEN 0.80 ELSE 0.45 END * (b.y2-b.y1)) AS INTEGER) AS my
  FROM ce c JOIN box b ON c.match_id=b.match_id AND c.round_id=b.round_id AND c.ce_frame=b.frame AND c.receiver_id=b.track_id""")
def _(spark, sf):
    b = A.boxes(spark, sf).select("match_id", "round_id", F.col("track_id").alias("receiver_id"), F.col("frame").alias("ce_frame"), "bbox")
    m = G.region_marker(F.col("bbox"), F.col("contact_region"))
    return (A.contacts(spark, sf).join(b, ["match_id", "round_id", "receiver_id", "ce_frame"])
            .select("contact_id", m["x"].alias("mx"), m["y"].alias("my")))


@query("head_roi", f"""SELECT match_id, round_id, track_id, frame, CAST(greatest(0, trunc({least_of(PX('p', j) for j in P.head)})-30) AS INTEGER) AS rx1,
  CAST(greatest(0, trunc({least_of(PY('p', j) for j in P.head)})-30) AS INTEGER) AS ry1,
  CAST(least(1920, trunc(greatest({','.join(PX('p', j) for j in P.head)}))+30) AS INTEGER) AS rx2,
  CAST(least(1080, trunc(greatest({','.join(PY('p', j) for j in P.head)}))+30) AS INTEGER) AS ry2 FROM pz p""")
def _(spark, sf):
    roi = G.head_roi(F.col("px"), PROFILE, 30, 1920, 1080)
    return A.pose(spark, sf).withColumn("b", roi).select(*BK, *[F.col(f"b.{c}").alias(f"r{c}") for c in ("x1", "y1", "x2", "y2")])


@query("limb_names", """SELECT action_id, contact_region, CASE WHEN action LIKE '%left' THEN 'left_jab' ELSE 'right_cross' END AS limb,
  upper(contact_region[1]) || replace(contact_region[2:], '_', ' ') AS zone_label FROM (
  SELECT a.action_id, a.action, min(c.contact_region) AS contact_region FROM act a JOIN ce c ON a.match_id=c.match_id AND a.round_id=c.round_id AND a.action_frame=c.ce_frame GROUP BY ALL)""")
def _(spark, sf):
    c = A.contacts(spark, sf).select("match_id", "round_id", F.col("ce_frame").alias("action_frame"), "contact_region")
    # one region per frame before the join, so no pair list builds up
    c = c.groupBy("match_id", "round_id", "action_frame").agg(F.min("contact_region").alias("contact_region"))
    j = A.actions(spark, sf).join(c, ["match_id", "round_id", "action_frame"])
    hand = G.hand_of_action(F.col("action"))
    return j.select("action_id", "contact_region", F.when(hand == "left", "left_jab").otherwise("right_cross").alias("limb"),
                    F.concat(F.upper(F.substring("contact_region", 1, 1)), F.regexp_replace(F.expr("substring(contact_region, 2)"), "_", " ")).alias("zone_label"))


# ---- predicates

@query("valid_joints", f"""SELECT match_id, round_id, track_id, frame FROM pz p WHERE NOT (abs({PX('p', 19)})<=1e-8 AND abs({PY('p', 19)})<=1e-8)""")
def _(spark, sf):
    return A.pose(spark, sf).where(G.null_if_zero(G.joint(F.col("px"), 19)).isNotNull()).select(*BK)


@query("wrist_in_box", f"""SELECT {PKEY}, round({hyp(f"greatest(r.x1-{PX('s', 20)}, 0.0, {PX('s', 20)}-r.x2)", f"greatest(r.y1-{PY('s', 20)}, 0.0, {PY('s', 20)}-r.y2)")},4) AS outside
  FROM {PAIR} WHERE {PX('s', 20)} BETWEEN r.x1-20 AND r.x2+20 AND {PY('s', 20)} BETWEEN r.y1-20 AND r.y2+20""")
def _(spark, sf):
    w = G.joint(F.col("s.px"), 20)
    return (pairs(spark, sf).where(G.in_box(w, F.col("r.bbox"), 20.0))
            .select(*PK, F.round(G.outside_distance(w, F.col("r.bbox")), 4).alias("outside")))


_REACH = lambda j: f"({PX('s', j)} BETWEEN r.x1-120 AND r.x2+120 AND {PY('s', j)} BETWEEN r.y1-120 AND r.y2+120)"
_SURE = lambda j: f"({_REACH(j)} AND abs({Z('s', j)})*4 >= 0.25)"


@query("reach_precheck", f"SELECT {PKEY}, coalesce({_SURE(19)} OR {_SURE(20)}, false) AS confident FROM {PAIR} WHERE {_REACH(19)} OR {_REACH(20)}")
def _(spark, sf):
    """Every pair with a wrist inside the widened box, and whether such a wrist has a confidence of 0.25 or more; the test joints' depth stands for their confidence."""
    hit = [G.in_box(G.joint(F.col("s.px"), i), F.col("r.bbox"), 120.0) for i in PROFILE.wrists]
    sure = [h & (F.abs(G.joint(F.col("s.joints"), i)["z"]) * 4 >= 0.25) for h, i in zip(hit, PROFILE.wrists)]
    return pairs(spark, sf).where(hit[0] | hit[1]).select(*PK, F.coalesce(sure[0] | sure[1], F.lit(False)).alias("confident"))


@query("head_separation", f"""SELECT {PKEY}, round({hyp(f"{HX('s')}*400-{HX('r')}*400", f"{HY('s')}*400-{HY('r')}*400")},4) AS sep
  FROM {PAIR} WHERE {hyp(f"{HX('s')}*400-{HX('r')}*400", f"{HY('s')}*400-{HY('r')}*400")} >= 80""")
def _(spark, sf):
    d = G.dist(G.centroid(F.col("s.px"), PROFILE.head), G.centroid(F.col("r.px"), PROFILE.head))
    return pairs(spark, sf).withColumn("d", d).where("d >= 80").select(*PK, F.round("d", 4).alias("sep"))


@query("person_size_filter", """SELECT match_id, round_id, track_id, frame FROM box
  WHERE (x2-x1)*(y2-y1) >= 0.02*(640*360) AND (x1+x2)/2 BETWEEN 0.05*640 AND 0.95*640""")
def _(spark, sf):
    b = F.col("bbox")
    return (A.boxes(spark, sf).where(G.box_area(b) >= 0.02 * (640 * 360))
            .where(G.box_center(b)["x"].between(0.05 * 640, 0.95 * 640)).select(*BK))


@query("clinch_filter", f"SELECT {PKEY}, round({iou('s', 'r')},6) AS iou FROM {PAIR} WHERE {iou('s', 'r')} <= 0.35")
def _(spark, sf):
    d = pairs(spark, sf).withColumn("iou", G.box_iou(F.col("s.bbox"), F.col("r.bbox"))).where("iou <= 0.35")
    return d.select(*PK, r6(F.col("iou"), "iou"))


@query("stride_sampling", "SELECT match_id, round_id, track_id, frame FROM pz WHERE frame % 2 = 0")
def _(spark, sf):
    return A.pose(spark, sf).where(F.pmod("frame", F.lit(2)) == 0).select(*BK)


_body_l = least_of(dj("s", 19, "r", j) for j in (*P.head, *P.torso))
_body_r = least_of(dj("s", 20, "r", j) for j in (*P.head, *P.torso))
_arm_l = least_of(dj("s", 19, "r", j) for j in (7, 8, 19, 20))
_arm_r = least_of(dj("s", 20, "r", j) for j in (7, 8, 19, 20))


@query("arm_contact_ratio", f"""SELECT * FROM (SELECT {PKEY}, round(CASE WHEN {_body_r} < {_body_l} THEN {_arm_r}/({_body_r}+1e-3)
  ELSE {_arm_l}/({_body_l}+1e-3) END,6) AS ratio FROM {PAIR}) WHERE ratio >= 0.3""")
def _(spark, sf):
    from contactflow.operators.gates_extra import arm_contact_ratio
    return (pairs(spark, sf).withColumn("ratio", F.round(arm_contact_ratio(F.col("s.joints"), F.col("r.joints"), PROFILE), 6))
            .where("ratio >= 0.3").select(*PK, "ratio"))
