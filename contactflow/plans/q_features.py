"""Wide feature matrix and the gates that combine both bodies."""
from __future__ import annotations

from pyspark.sql import functions as F

from contactflow.functions import geometry as G
from contactflow.functions import kinematics as K
from contactflow.functions import scoring as SC
from contactflow.operators import gates as GA
from contactflow.operators import gates_extra as GX
from contactflow.operators import joins as J
from contactflow.operators.evidence import evidence_features
from contactflow.operators.ordering import blocked
from contactflow.plans.q_candidates import union_cands
from contactflow.plans.q_geometry import BK, PK, pairs, r6
from contactflow.plans.registry import ORACLE, query
from contactflow.plans.sqltext import PAIR, PKEY, PX, PY, X, Y, Z, dj, hyp, mean
from contactflow.sources import adapters as A

KEYS = ["match_id", "round_id"]
_H3 = lambda f: mean(f("r", j) for j in (0, 1, 2))


@query("receiver_reaction_window_gate", f"""WITH f AS (SELECT a.action_id, p.* FROM pact a JOIN (SELECT {PKEY}, {_H3(PX)} AS hx, {_H3(PY)} AS hy FROM {PAIR}) p
    ON a.match_id=p.match_id AND a.round_id=p.round_id AND a.fighter_id=p.striker_id AND p.frame BETWEEN greatest(0, a.window_start-5, a.action_frame-6) AND least(a.window_end+5, a.action_frame+6)),
  v AS (SELECT action_id, frame, sqrt((hx-lag(hx) OVER w)**2+(hy-lag(hy) OVER w)**2)/(frame-lag(frame) OVER w) AS v FROM f WINDOW w AS (PARTITION BY action_id ORDER BY frame)), d AS (SELECT action_id, abs(v-lag(v) OVER (PARTITION BY action_id ORDER BY frame)) AS j FROM v)
  SELECT action_id, round(CASE WHEN count(*) < 3 THEN 0 ELSE least(1.0::DOUBLE, max(j)/1500.0) END,6) AS g_react FROM d GROUP BY action_id""")
def _(spark, sf):
    # these tracks move hundreds of pixels per frame, so the scale is a hundred times the usual 15
    p = pairs(spark, sf).select(*KEYS, "frame", F.col("striker_id").alias("fighter_id"), G.centroid(F.col("r.px"), (0, 1, 2)).alias("h"))
    a = (A.pose_actions(spark, sf).withColumn("lo", F.greatest(F.lit(0), F.col("window_start") - 5, F.col("action_frame") - 6))
         .withColumn("hi", F.least(F.col("window_end") + 5, F.col("action_frame") + 6)))
    j = J.interval_join(a, p, [*KEYS, "fighter_id"], start="lo", end="hi", before=0, after=0)
    t = j.groupBy("action_id").agg(F.sort_array(F.collect_list(F.struct("frame", F.col("h.x").alias("x"), F.col("h.y").alias("y")))).alias("t"))
    return t.select("action_id", r6(K.speed_change_score(F.col("t"), "xy", 1500.0), "g_react"))


_HY18 = lambda a: f"({a}.y1+0.18*({a}.y2-{a}.y1))"
_HX18 = lambda a: f"(({a}.x1+{a}.x2)/2)"


@query("paired_physics", f"""WITH st AS (SELECT b.match_id, b.round_id, b.track_id, b.frame, {hyp(f"{_HX18('b')}-{_HX18('p')}", f"{_HY18('b')}-{_HY18('p')}")} AS step FROM pz b LEFT JOIN pz p ON p.match_id=b.match_id AND p.round_id=b.round_id AND p.track_id=b.track_id AND p.frame=b.frame-1),
  ha AS (SELECT *, coalesce(avg(step) OVER (PARTITION BY match_id, round_id, track_id ORDER BY frame RANGE BETWEEN 3 FOLLOWING AND 5 FOLLOWING),0)-coalesce(avg(step) OVER (PARTITION BY match_id, round_id, track_id ORDER BY frame RANGE BETWEEN 4 PRECEDING AND 2 PRECEDING),0) AS acc FROM st),
  de AS (SELECT p.match_id, p.round_id, p.track_id, p.frame, CASE WHEN b.frame IS NULL OR n.frame IS NULL THEN 0 ELSE greatest(0.0::DOUBLE, {hyp(f"{PX('p', 19)}-{PX('b', 19)}", f"{PY('p', 19)}-{PY('b', 19)}")}/3-{hyp(f"{PX('n', 19)}-{PX('p', 19)}", f"{PY('n', 19)}-{PY('p', 19)}")}/3) END AS decel
    FROM pz p LEFT JOIN pz b ON b.match_id=p.match_id AND b.round_id=p.round_id AND b.track_id=p.track_id AND b.frame=p.frame-3 LEFT JOIN pz n ON n.match_id=p.match_id AND n.round_id=p.round_id AND n.track_id=p.track_id AND n.frame=p.frame+3)
  SELECT d.match_id, d.round_id, d.frame, d.track_id AS striker_id, round(d.decel,4) AS decel, round(h.acc,4) AS head_accel, round(greatest(0.0::DOUBLE,d.decel)*greatest(0.0::DOUBLE,h.acc),3) AS paired FROM de d JOIN ha h ON h.match_id=d.match_id AND h.round_id=d.round_id AND h.frame=d.frame AND h.track_id<>d.track_id""")
def _(spark, sf):
    p = A.pose(spark, sf)
    b = blocked(p.select(*BK, G.joint(F.col("px"), A.PROFILE.left_wrist).alias("w")), GA.TRACK, "frame", 3, 3)
    d = b.core(b.df.withColumn("p", b.at(F.col("w"), -3)).withColumn("n", b.at(F.col("w"), 3)))
    drop = G.dist(F.col("w"), F.col("p")) / 3 - G.dist(F.col("n"), F.col("w")) / 3
    d = d.select(*KEYS, "frame", F.col("track_id").alias("striker_id"), F.greatest(F.lit(0.0), F.coalesce(drop, F.lit(0.0))).alias("decel"))
    m = GX.receiver_motion(p.select(*BK, "bbox")).select(*KEYS, "frame", F.col("track_id").alias("receiver_id"), "head_accel")
    j = d.join(m, [*KEYS, "frame"]).where("striker_id <> receiver_id")
    return j.select(*KEYS, "frame", "striker_id", F.round("decel", 4).alias("decel"), F.round("head_accel", 4).alias("head_accel"),
                    F.round(F.greatest(F.lit(0.0), F.col("decel")) * F.greatest(F.lit(0.0), F.col("head_accel")), 3).alias("paired"))


@query("region_weights", "SELECT contact_id, CASE contact_region WHEN 'head' THEN 1.0 WHEN 'torso' THEN 0.85 WHEN 'left_arm' THEN 0.2 WHEN 'right_arm' THEN 0.2 ELSE 0.3 END::DOUBLE AS weight FROM ce")
def _(spark, sf):
    return A.contacts(spark, sf).select("contact_id", SC.region_weight(F.col("contact_region"), 0.5).alias("weight"))


@query("depth_offset_distance", f"""SELECT {PKEY}, round({hyp(f"{X('s', 19)}-{X('r', 0)}", f"{Y('s', 19)}-{Y('r', 0)}", f"{Z('s', 19)}-({Z('r', 0)}+coalesce(o.off,0))")},6) AS d FROM {PAIR}
  LEFT JOIN (SELECT match_id, round_id, frame, max(e[64]) AS off FROM pz WHERE label=9 GROUP BY ALL) o ON o.match_id=s.match_id AND o.round_id=s.round_id AND o.frame=s.frame""")
def _(spark, sf):
    off = A.pose(spark, sf).where("label = 9").groupBy(*KEYS, "frame").agg(F.max("tail").alias("off"))
    p = pairs(spark, sf).join(off, [*KEYS, "frame"], "left")
    d = G.dist(G.joint(F.col("s.joints"), 19), G.shift_depth(G.joint(F.col("r.joints"), 0), F.col("off")), "xyz")
    return p.select(*PK, r6(d, "d"))


_BOX = {"receiver_motion": ["motion_pre", "motion_post", "motion_delta", "head_accel"], "velocity_change_sum": ["vel_change"],
        "box_displacement_area_change": ["pos_change", "area_change"], "flow_windows": ["flow_ahead"]}
_JOINS = " ".join(f"LEFT JOIN ({ORACLE[n]}) t{i} ON t{i}.match_id=c.match_id AND t{i}.round_id=c.round_id AND t{i}.frame=c.frame AND t{i}.track_id=1-c.striker_id" for i, n in enumerate(_BOX))
_COLS = ", ".join(f"round(coalesce(t{i}.{c},0),4) AS {c}" for i, n in enumerate(_BOX) for c in _BOX[n])


@query("wide_feature_matrix", f"""SELECT c.match_id, c.round_id, c.frame, c.striker_id, {_COLS},
  round((SELECT coalesce(max(a.confidence),0) FROM act a WHERE a.match_id=c.match_id AND a.round_id=c.round_id AND a.fighter_id=c.striker_id AND abs(a.action_frame-c.frame)<=5),6) AS conf,
  round((SELECT coalesce(max(a.contact_prob),0) FROM ce a WHERE a.match_id=c.match_id AND a.round_id=c.round_id AND a.striker_id=c.striker_id AND abs(a.ce_frame-c.frame)<=8),6) AS ce,
  round((SELECT coalesce(max(o.strength),0) FROM ons o WHERE o.match_id=c.match_id AND o.round_id=c.round_id AND abs(o.onset_frame-c.frame)<=10),6) AS audio FROM cand c {_JOINS}""")
def _(spark, sf):
    c = evidence_features(union_cands(spark, sf), A.actions(spark, sf), A.contacts(spark, sf), A.onsets(spark, sf))
    b = A.boxes(spark, sf)
    flow = GX.flow_windows(b.select(*BK, F.col("bbox.x1").alias("flow")), "flow").select(*BK, "flow_ahead")
    t = GX.receiver_motion(b)
    for other in (GX.velocity_change(b), GX.box_change(b), flow):
        t = t.join(other, BK)
    names = [x for v in _BOX.values() for x in v]
    t = t.select(*KEYS, "frame", (1 - F.col("track_id")).alias("striker_id"), *names)
    d = c.join(t, [*KEYS, "frame", "striker_id"], "left").na.fill(0.0, names)
    return d.select(*KEYS, "frame", "striker_id", *[F.round(n, 4).alias(n) for n in names], *[r6(F.col(n), n) for n in ("conf", "ce", "audio")])
