"""Candidate (group C), fusion (group U) and evidence queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from contactflow import schema as S
from contactflow.functions import geometry as G
from contactflow.functions import kinematics as K
from contactflow.functions import scoring as SC
from contactflow.operators import candidates as C
from contactflow.operators import detector as D
from contactflow.operators import gates as GA
from contactflow.operators import gates_extra as GX
from contactflow.operators import joins as J
from contactflow.operators.evidence import evidence_features, with_motion
from contactflow.operators.ordering import blocked, row_number
from contactflow.operators.ranking import ranked
from contactflow.operators.suppress import first_fit, greedy_nms
from contactflow.plans.q_gates import _AK, _PWIN, _VEL, ANCHORED, action_traj, hot, nms_sql
from contactflow.plans.q_geometry import BK, PK, pairs, r6
from contactflow.plans.q_suppress import first_fit_sql, pair_sql
from contactflow.plans.registry import query, view
from contactflow.plans.sqltext import HX, HY, HZ, PAIR, PKEY, PX, PY, P, SW, X, Y, Z, arr, dj, dpx, hyp, iou, least_of
from contactflow.session import cut_lineage
from contactflow.sources import adapters as A

KEYS = ["match_id", "round_id"]


@query("action_candidates", "SELECT match_id, round_id, action_frame AS frame, fighter_id AS striker_id, round(confidence,6) AS conf FROM act")
def _(spark, sf):
    return A.actions(spark, sf).select(*KEYS, F.col("action_frame").alias("frame"), F.col("fighter_id").alias("striker_id"), r6(F.col("confidence"), "conf"))


view("cand", """SELECT DISTINCT * FROM (SELECT match_id, round_id, action_frame AS frame, fighter_id AS striker_id FROM act
  UNION ALL SELECT match_id, round_id, ce_frame, striker_id FROM ce UNION ALL SELECT match_id, round_id, onset_frame, s FROM ons, (SELECT unnest([0,1]) AS s)
  UNION ALL SELECT match_id, round_id, frame, s FROM (SELECT match_id, round_id, frame FROM box WHERE frame % 5 = 0 GROUP BY ALL HAVING count(*) >= 2), (SELECT unnest([0,1]) AS s))""")


def union_cands(spark, sf):
    return C.union_candidates(A.actions(spark, sf), A.contacts(spark, sf), A.onsets(spark, sf), A.boxes(spark, sf))


@query("union_candidates", "SELECT * FROM cand")
def _(spark, sf):
    return union_cands(spark, sf).select(*KEYS, "frame", "striker_id")


# evidence of every raw detection
view("ft", """SELECT d.*, (SELECT coalesce(max(a.confidence),0) FROM act a WHERE a.match_id=d.match_id AND a.round_id=d.round_id AND a.fighter_id=d.striker_id AND abs(a.action_frame-d.frame)<=5) AS conf,
  (SELECT coalesce(max(c.contact_prob),0) FROM ce c WHERE c.match_id=d.match_id AND c.round_id=d.round_id AND c.striker_id=d.striker_id AND abs(c.ce_frame-d.frame)<=8) AS ce,
  (SELECT coalesce(max(c.contact_prob),0) FROM ce c WHERE c.match_id=d.match_id AND c.round_id=d.round_id AND c.striker_id=d.striker_id AND abs(c.ce_frame-d.frame)<=8 AND c.contact_region IN ('head','torso')) AS ce_ht,
  (SELECT coalesce(max(o.strength),0) FROM ons o WHERE o.match_id=d.match_id AND o.round_id=d.round_id AND abs(o.onset_frame-d.frame)<=10) AS audio,
  coalesce(sqrt(((s.x1+s.x2)/2-(r.x1+r.x2)/2)**2+((s.y1+s.y2)/2-(r.y1+r.y2)/2)**2), -1) AS dist
  FROM det d LEFT JOIN box s ON s.match_id=d.match_id AND s.round_id=d.round_id AND s.frame=d.frame AND s.track_id=d.striker_id
  LEFT JOIN box r ON r.match_id=d.match_id AND r.round_id=d.round_id AND r.frame=d.frame AND r.track_id=d.receiver_id""")


def features(spark, sf):
    d = evidence_features(A.detections(spark, sf), A.actions(spark, sf), A.contacts(spark, sf), A.onsets(spark, sf))
    p = J.pairs_same_frame(A.boxes(spark, sf)).select(
        *KEYS, "frame", F.col("s.track_id").alias("striker_id"),
        G.dist(G.box_center(F.col("s.bbox")), G.box_center(F.col("r.bbox"))).alias("dist"))
    return d.join(p, [*KEYS, "frame", "striker_id"], "left").na.fill(-1.0, ["dist"])


# the same with the motion of both boxes and the action's flag; the test actions carry no flag, so one of half confidence is significant
view("ft8", """SELECT f.*, CASE WHEN b0.x1 IS NULL OR b1.x1 IS NULL OR s.x1 IS NULL THEN 0 ELSE greatest(0.0::DOUBLE,
    sqrt(((s.x1+s.x2)/2-(b0.x1+b0.x2)/2)**2+((s.y1+s.y2)/2-(b0.y1+b0.y2)/2)**2)/3 - sqrt(((b1.x1+b1.x2)/2-(s.x1+s.x2)/2)**2+((b1.y1+b1.y2)/2-(s.y1+s.y2)/2)**2)/3) END AS decel,
  CASE WHEN h0.x1 IS NULL OR h1.x1 IS NULL OR r.x1 IS NULL THEN 0 ELSE sqrt(
    ((((h1.x1+h1.x2)/2-(r.x1+r.x2)/2)/4)-(((r.x1+r.x2)/2-(h0.x1+h0.x2)/2)/4))**2+(((h1.y1+0.18*(h1.y2-h1.y1))-(r.y1+0.18*(r.y2-r.y1)))/4-((r.y1+0.18*(r.y2-r.y1))-(h0.y1+0.18*(h0.y2-h0.y1)))/4)**2) END AS head_acc,
  CASE WHEN conf >= 0.5 THEN 1.0::DOUBLE ELSE 0 END AS sig
  FROM ft f LEFT JOIN box s ON s.match_id=f.match_id AND s.round_id=f.round_id AND s.frame=f.frame AND s.track_id=f.striker_id
  LEFT JOIN box b0 ON b0.match_id=f.match_id AND b0.round_id=f.round_id AND b0.frame=f.frame-3 AND b0.track_id=f.striker_id
  LEFT JOIN box b1 ON b1.match_id=f.match_id AND b1.round_id=f.round_id AND b1.frame=f.frame+3 AND b1.track_id=f.striker_id
  LEFT JOIN box r ON r.match_id=f.match_id AND r.round_id=f.round_id AND r.frame=f.frame AND r.track_id=f.receiver_id
  LEFT JOIN box h0 ON h0.match_id=f.match_id AND h0.round_id=f.round_id AND h0.frame=f.frame-4 AND h0.track_id=f.receiver_id
  LEFT JOIN box h1 ON h1.match_id=f.match_id AND h1.round_id=f.round_id AND h1.frame=f.frame+4 AND h1.track_id=f.receiver_id""")


def fusion_features(spark, sf):
    d = with_motion(features(spark, sf), A.boxes(spark, sf))
    return d.withColumn("sig", F.when(F.col("conf") >= 0.5, 1.0).otherwise(0.0))


#: Terms of the linear evidence score, each from 0 to 1, in the order of their weights; the same in SQL.
TERMS = ["conf", "t_audio", "ce", "t_dist", "t_decel", "t_head", "sig", "ce_ht"]


def terms():
    return dict(zip(TERMS, (F.col("conf"), F.least(F.lit(1.0), F.col("audio") * 4), F.col("ce"), F.greatest(F.lit(0.0), 1 - F.when(F.col("dist") > 0, F.col("dist")).otherwise(999.0) / 300.0),
                            F.least(F.lit(1.0), F.col("decel") / 10.0), F.least(F.lit(1.0), F.col("head_acc") / 5.0), F.col("sig"), F.col("ce_ht"))))


TERMS_SQL = ["conf", "least(1.0::DOUBLE,audio*4)", "ce", "greatest(0.0::DOUBLE,1-(CASE WHEN dist>0 THEN dist ELSE 999 END)/300.0)", "least(1.0::DOUBLE,decel/10.0)", "least(1.0::DOUBLE,head_acc/5.0)", "sig", "ce_ht"]

FEATS = ["conf", "ce", "ce_ht", "audio", "dist"]


@query("evidence_feature_matrix", "SELECT det_id, round(conf,6) AS conf, round(ce,6) AS ce, round(ce_ht,6) AS ce_ht, round(audio,6) AS audio, round(dist,4) AS dist FROM ft")
def _(spark, sf):
    return features(spark, sf).select("det_id", *[r6(F.col(c), c) for c in FEATS[:-1]], F.round("dist", 4).alias("dist"))


_VOTES = "((conf>=0.3)::INT+(audio>=0.1)::INT+(ce>=0.3)::INT+(dist>0 AND dist<=150)::INT+(decel>=5)::INT+(head_acc>=2)::INT)"


@query("vote_count_score", f"SELECT * FROM (SELECT det_id, CAST({_VOTES} AS INTEGER) AS votes, round({_VOTES}+0.1*conf+0.02*audio+0.01*ce,6) AS score FROM ft8) WHERE votes >= 2")
def _(spark, sf):
    d = fusion_features(spark, sf)
    v = SC.votes([F.col("conf") >= 0.3, F.col("audio") >= 0.1, F.col("ce") >= 0.3, (F.col("dist") > 0) & (F.col("dist") <= 150), F.col("decel") >= 5.0, F.col("head_acc") >= 2.0])
    d = d.withColumn("votes", v).where("votes >= 2")
    return d.select("det_id", "votes", r6(F.col("votes") + 0.1 * F.col("conf") + 0.02 * F.col("audio") + 0.01 * F.col("ce"), "score"))


_LINEAR = dict(zip(TERMS, (1.0, 0.8, 0.6, 0.5, 0.4, 0.4, 0.2, 0.7)))


@query("linear_evidence_score", "SELECT det_id, round(" + "+".join(f"{w}*{t}" for w, t in zip(_LINEAR.values(), TERMS_SQL)) + ",6) AS score FROM ft8")
def _(spark, sf):
    return fusion_features(spark, sf).select("det_id", r6(SC.weighted_sum(_LINEAR, terms()), "score"))


@query("evidence_modes", """SELECT det_id, mode FROM ft, (SELECT unnest(['any','audio_only','ce_only','dist_only','audio_or_ce','audio_and_dist','ce_or_dist']) AS mode)
  WHERE CASE mode WHEN 'any' THEN audio>=0.2 OR ce>=0.3 OR (dist>0 AND dist<=150) WHEN 'audio_only' THEN audio>=0.2 WHEN 'ce_only' THEN ce>=0.3 WHEN 'dist_only' THEN (dist>0 AND dist<=150)
  WHEN 'audio_or_ce' THEN audio>=0.2 OR ce>=0.3 WHEN 'audio_and_dist' THEN audio>=0.2 AND (dist>0 AND dist<=150) ELSE ce>=0.3 OR (dist>0 AND dist<=150) END""")
def _(spark, sf):
    modes = ["any", "audio_only", "ce_only", "dist_only", "audio_or_ce", "audio_and_dist", "ce_or_dist"]
    a, c, d = F.col("audio") >= 0.2, F.col("ce") >= 0.3, (F.col("dist") > 0) & (F.col("dist") <= 150)
    hit = F.array_compact(F.array(*[F.when(SC.evidence_mode(m, a, c, d), m) for m in modes]))
    return features(spark, sf).select("det_id", F.explode(hit).alias("mode"))


@query("onset_extended_candidates", """WITH o AS (SELECT o.match_id, o.round_id, o.onset_frame AS frame, s AS striker_id, strength AS audio FROM ons o CROSS JOIN (SELECT unnest([0,1]) AS s)
    WHERE NOT EXISTS (SELECT 1 FROM act a WHERE a.match_id=o.match_id AND a.round_id=o.round_id AND a.action_frame=o.onset_frame AND a.fighter_id=s)),
  x AS (SELECT o.*, (SELECT coalesce(max(contact_prob),0) FROM ce c WHERE c.match_id=o.match_id AND c.round_id=o.round_id AND c.striker_id=o.striker_id AND abs(c.ce_frame-o.frame)<=8) AS ce,
    CASE WHEN s.x1 IS NULL OR r.x1 IS NULL THEN 0 ELSE greatest(0.0::DOUBLE, 1-sqrt(((s.x1+s.x2)/2-(r.x1+r.x2)/2)**2+((s.y1+s.y2)/2-(r.y1+r.y2)/2)**2)/150) END AS dist,
    CASE WHEN h0.x1 IS NULL OR h1.x1 IS NULL OR r.x1 IS NULL THEN 0 ELSE least(1.0::DOUBLE, sqrt(((((h1.x1+h1.x2)/2-(r.x1+r.x2)/2)/4)-(((r.x1+r.x2)/2-(h0.x1+h0.x2)/2)/4))**2
      +(((h1.y1+0.18*(h1.y2-h1.y1))-(r.y1+0.18*(r.y2-r.y1)))/4-((r.y1+0.18*(r.y2-r.y1))-(h0.y1+0.18*(h0.y2-h0.y1)))/4)**2)/20) END AS head_acc
    FROM o LEFT JOIN box s ON s.match_id=o.match_id AND s.round_id=o.round_id AND s.frame=o.frame AND s.track_id=o.striker_id LEFT JOIN box r ON r.match_id=o.match_id AND r.round_id=o.round_id AND r.frame=o.frame AND r.track_id=1-o.striker_id
    LEFT JOIN box h0 ON h0.match_id=o.match_id AND h0.round_id=o.round_id AND h0.frame=o.frame-4 AND h0.track_id=1-o.striker_id LEFT JOIN box h1 ON h1.match_id=o.match_id AND h1.round_id=o.round_id AND h1.frame=o.frame+4 AND h1.track_id=1-o.striker_id)
  SELECT match_id, round_id, frame, striker_id, round(audio,6) AS audio, round(ce,6) AS ce, round(dist,6) AS dist, round(head_acc,6) AS head_acc FROM x WHERE dist > 0.5 OR ce > 0.2 OR audio > 0.5 OR head_acc > 0.4""")
def _(spark, sf):
    """Onsets without an action that closeness, a contact event, a loud onset or a moving head supports."""
    o = A.onsets(spark, sf).select(*KEYS, F.col("onset_frame").alias("frame"), F.col("strength").alias("audio_here"), F.explode(F.array(F.lit(0), F.lit(1))).alias("striker_id"))
    seen = A.actions(spark, sf).select(*KEYS, F.col("action_frame").alias("frame"), F.col("fighter_id").alias("striker_id"))
    o = o.join(seen, [*KEYS, "frame", "striker_id"], "left_anti")
    e = evidence_features(o, A.actions(spark, sf), A.contacts(spark, sf), A.onsets(spark, sf)).withColumn("receiver_id", 1 - F.col("striker_id"))
    near = J.pairs_same_frame(A.boxes(spark, sf)).select(*KEYS, "frame", F.col("s.track_id").alias("striker_id"), G.dist(G.box_center(F.col("s.bbox")), G.box_center(F.col("r.bbox"))).alias("d"))
    e = with_motion(e, A.boxes(spark, sf)).join(near, [*KEYS, "frame", "striker_id"], "left")
    e = e.withColumns({"audio": F.col("audio_here"), "dist": F.coalesce(F.greatest(F.lit(0.0), 1 - F.col("d") / 150), F.lit(0.0)), "head_acc": F.least(F.lit(1.0), F.col("head_acc") / 20)})
    return C.onset_supported(e).select(*KEYS, "frame", "striker_id", *[r6(F.col(c), c) for c in ("audio", "ce", "dist", "head_acc")])


@query("window_grid_candidates", """SELECT action_id, CAST(unnest(range(greatest(10, round_even(window_start*1.2,0)::INT-5), least(279, round_even(window_end*1.2,0)::INT+5)+1, 3)) AS INTEGER) AS frame FROM act""")
def _(spark, sf):
    return C.window_grid(A.actions(spark, sf), stride=3, pad=5, ratio=1.2, margin=10, last_frame=F.lit(289)).select("action_id", "frame")


_MERGE = """WITH o AS (SELECT *, max(window_end) OVER (PARTITION BY match_id, round_id ORDER BY window_start, action_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM act),
  g AS (SELECT *, sum(CASE WHEN reach IS NULL OR window_start - reach > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, round_id ORDER BY window_start, action_id) AS grp FROM o)"""


@query("merged_action_windows", _MERGE + """ SELECT match_id, round_id, min(window_start) AS window_start, max(window_end) AS window_end, round(max(confidence),6) AS confidence, count(*) AS n_windows,
  string_agg(action, '+' ORDER BY window_start, action_id) AS actions FROM g GROUP BY match_id, round_id, grp""")
def _(spark, sf):
    m = C.merge_windows(A.actions(spark, sf), KEYS, 6, order=["window_start", "action_id"])
    return m.select(*KEYS, "window_start", "window_end", r6(F.col("confidence"), "confidence"), "n_windows", "actions")


@query("merged_window_members", _MERGE + " SELECT match_id, round_id, action_id, action, window_start, min(window_start) OVER (PARTITION BY match_id, round_id, grp) AS group_start FROM g")
def _(spark, sf):
    return C.window_groups(A.actions(spark, sf), KEYS, 6).select(*KEYS, "action_id", "action", "window_start", "group_start")


@query("clip_bounds_seconds", """SELECT action_id, round(CASE WHEN e-s < 1.4 THEN greatest(0.0::DOUBLE, (s+e)/2-0.7) ELSE s END,4) AS start_sec, round(CASE WHEN e-s < 1.4 THEN 1.4 ELSE e-s END,4) AS dur_sec FROM (
  SELECT action_id, greatest(0.0::DOUBLE, window_start/25.0-0.4) AS s, window_end/25.0+0.7 AS e FROM act)""")
def _(spark, sf):
    s, d = C.clip_bounds(F.col("window_start"), F.col("window_end"), A.FPS)
    return A.actions(spark, sf).select("action_id", F.round(s, 4).alias("start_sec"), F.round(d, 4).alias("dur_sec"))


def clip_rows(spark, sf):
    a = row_number(A.actions(spark, sf), KEYS, "window_start", "idx", tie=["action_id"], size=16)
    return a.withColumn("clip", C.clip_name(F.col("round_id"), F.col("fighter_id"), F.col("idx"), F.col("action"), F.col("window_start"), F.col("window_end")))


@query("clip_names", """SELECT action_id, format('R{}_f{}_{:03d}_{}_f{:04d}_f{:04d}', round_id, fighter_id, row_number() OVER (PARTITION BY match_id, round_id ORDER BY window_start, action_id), action, window_start, window_end) AS clip FROM act""")
def _(spark, sf):
    return clip_rows(spark, sf).select("action_id", "clip")


# ---- detectors over every frame

_BRD = f"""FROM pz b LEFT JOIN pz p ON b.match_id=p.match_id AND b.round_id=p.round_id AND b.track_id=p.track_id AND p.frame=b.frame-1"""
view("psnap", f"""SELECT match_id, round_id, track_id, frame, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (coalesce(max(snap) OVER (PARTITION BY match_id, round_id, track_id ORDER BY frame RANGE BETWEEN 1 FOLLOWING AND 8 FOLLOWING),0)
  /greatest(coalesce(avg(snap) OVER (PARTITION BY match_id, round_id, track_id ORDER BY frame RANGE BETWEEN 2 PRECEDING AND CURRENT ROW),0.02),0.005)-1)/4)) AS g_snap FROM (
  SELECT b.match_id, b.round_id, b.track_id, b.frame, sqrt(((b.x1+b.x2)/2-(p.x1+p.x2)/2)**2+(b.y1-p.y1)**2)/greatest(1.0::DOUBLE, b.y2-b.y1) AS snap {_BRD})""")


SCAN_GATES = ["gap", "ce_prob", "region", "decel", "react", "bbox_react", "approach", "guard", "audio", "conf"]
_SCAN_W = "+".join(f"{S.WEIGHTS['window_scan'][g]}*g_{g}" for g in SCAN_GATES)
_SCAN = ANCHORED + f""", gu2 AS (SELECT {_AK}, greatest(0.30::DOUBLE, least(1.0::DOUBLE, (min(b.guard_d)-0.30)/1.20)) AS g_guard {_PWIN.format(lo=3, hi=0)} GROUP BY ALL),
  scf AS (SELECT a.action_id, a.match_id, a.round_id, a.fighter_id AS striker_id, p.receiver_id, p.frame, p.gap, p.region, a.confidence FROM pact a
    JOIN pgap p ON a.match_id=p.match_id AND a.round_id=p.round_id AND a.fighter_id=p.striker_id AND p.frame BETWEEN a.window_start-15 AND a.window_end+20),
  spot AS (SELECT DISTINCT match_id, round_id, striker_id, receiver_id, frame FROM scf),
  sce AS (SELECT * FROM (SELECT s.*, c.contact_prob, c.contact_region, row_number() OVER (PARTITION BY s.match_id, s.round_id, s.striker_id, s.receiver_id, s.frame ORDER BY c.contact_prob DESC, c.ce_frame) AS rn
    FROM spot s JOIN pce c ON c.match_id=s.match_id AND c.round_id=s.round_id AND c.striker_id=s.striker_id AND c.receiver_id=s.receiver_id AND abs(c.ce_frame-s.frame)<=15) WHERE rn=1),
  sau AS (SELECT s.match_id, s.round_id, s.frame, max(o.strength) AS g_audio FROM (SELECT DISTINCT match_id, round_id, frame FROM spot) s JOIN pons o ON o.match_id=s.match_id AND o.round_id=s.round_id AND abs(o.onset_frame-s.frame)<=7 GROUP BY ALL),
  scn AS (SELECT f.*, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (0.45-f.gap)/0.35)) AS g_gap, coalesce(e.contact_prob,0) AS g_ce_prob,
    CASE coalesce(e.contact_region, f.region) WHEN 'head' THEN 1.0 WHEN 'torso' THEN 0.85 WHEN 'left_arm' THEN 0.2 WHEN 'right_arm' THEN 0.2 WHEN 'left_leg' THEN 0.3 WHEN 'right_leg' THEN 0.3 ELSE 0.5 END AS g_region,
    tg.g_decel, hr.g_react, n.g_snap AS g_bbox_react, ap.g_approach, g.g_guard, coalesce(u.g_audio,0) AS g_audio, f.confidence AS g_conf FROM scf f
    JOIN tg ON tg.match_id=f.match_id AND tg.round_id=f.round_id AND tg.track_id=f.striker_id AND tg.frame=f.frame JOIN hr ON hr.match_id=f.match_id AND hr.round_id=f.round_id AND hr.track_id=f.receiver_id AND hr.frame=f.frame
    JOIN ap ON ap.match_id=f.match_id AND ap.round_id=f.round_id AND ap.striker_id=f.striker_id AND ap.frame=f.frame JOIN gu2 g ON g.match_id=f.match_id AND g.round_id=f.round_id AND g.striker_id=f.striker_id AND g.frame=f.frame
    JOIN psnap n ON n.match_id=f.match_id AND n.round_id=f.round_id AND n.track_id=f.receiver_id AND n.frame=f.frame
    LEFT JOIN sce e ON e.match_id=f.match_id AND e.round_id=f.round_id AND e.striker_id=f.striker_id AND e.receiver_id=f.receiver_id AND e.frame=f.frame LEFT JOIN sau u ON u.match_id=f.match_id AND u.round_id=f.round_id AND u.frame=f.frame),
  s AS (SELECT *, {_SCAN_W} AS score FROM scn), ba AS (SELECT *, row_number() OVER (PARTITION BY action_id ORDER BY score DESC, frame) AS ra FROM s WHERE score IS NOT NULL)"""


def scan_gates(spark, sf):
    """All ten gates of every frame in the padded window of an action."""
    pz = A.pose(spark, sf)
    hot = cut_lineage(GA.hot_joints(pz, A.PROFILE))
    near = A.pose_actions(spark, sf).withColumnRenamed("fighter_id", "striker_id")
    spots = near.select(*KEYS, "striker_id", F.explode(F.sequence(F.col("window_start") - 15, F.col("window_end") + 20)).alias("frame")).distinct()
    pg = GA.pair_gates(GA.pair_frames(hot)).join(spots, [*KEYS, "striker_id", "frame"], "left_semi")
    tg = GA.track_gates(hot)
    side = lambda c, *gates: tg.select(*KEYS, F.col("track_id").alias(c), "frame", *gates)
    snap = GX.box_snap(pz.select(*BK, "bbox")).select(*KEYS, F.col("track_id").alias("receiver_id"), "frame", "g_bbox_react")
    pg = pg.join(side("striker_id", "g_decel"), [*KEYS, "striker_id", "frame"]).join(side("receiver_id", "g_react"), [*KEYS, "receiver_id", "frame"]).join(snap, [*KEYS, "receiver_id", "frame"])
    pg = D.contact_prior(cut_lineage(pg), A.pose_contacts(spark, sf), frame="frame")
    pg = J.best_in_band(pg, A.pose_onsets(spark, sf), KEYS, left_on="frame", right_on="onset_frame", lo=-7, hi=7, order=[-F.col("strength"), F.col("onset_frame")], keep=["strength"])
    pg = pg.withColumns({
        "g_gap": K.clip01((0.45 - F.col("gap")) / 0.35), "g_ce_prob": F.coalesce("contact_prob", F.lit(0.0)), "g_region": SC.region_weight(F.coalesce("contact_region", "region"), 0.5),
        "g_guard": F.greatest(F.lit(0.30), F.col("g_guard")), "g_audio": F.coalesce("strength", F.lit(0.0))}).drop("contact_prob", "contact_region", "strength")
    j = J.interval_join(near, cut_lineage(pg), [*KEYS, "striker_id"], start="window_start", end="window_end", before=15, after=20)
    return j.withColumn("g_conf", F.least(F.lit(1.0), F.col("confidence"))).withColumn("score", SC.weighted_sum(S.WEIGHTS["window_scan"])).where("score is not null")


@query("window_scan_scores", _SCAN + """, top AS (SELECT *, row_number() OVER (PARTITION BY match_id, round_id, frame ORDER BY score DESC, action_id) AS rf FROM ba WHERE ra = 1)
  SELECT action_id, match_id, round_id, frame, striker_id, round(score,5) AS score FROM top WHERE rf = 1""")
def _(spark, sf):
    # best frame per action, then best action per frame
    best = scan_gates(spark, sf).groupBy(*KEYS, "action_id", "striker_id").agg(F.min(F.struct((-F.col("score")).alias("ns"), "frame")).alias("b"))
    top = best.groupBy(*KEYS, F.col("b.frame").alias("frame")).agg(F.min(F.struct("b.ns", "action_id", "striker_id")).alias("t"))
    return top.select("t.action_id", *KEYS, "frame", "t.striker_id", F.round(-F.col("t.ns"), 5).alias("score"))


@query("gate_contribution_breakdown", _SCAN + ", b AS (SELECT * FROM ba WHERE ra=1) " + " UNION ALL ".join(
    f"SELECT action_id, frame, '{g}' AS gate, round(g_{g},5) AS value, round({S.WEIGHTS['window_scan'][g]}*g_{g},5) AS contribution FROM b" for g in SCAN_GATES))
def _(spark, sf):
    """What each gate adds at the chosen frame of every action."""
    g = scan_gates(spark, sf)
    best = g.groupBy("action_id").agg(F.min(F.struct((-F.col("score")).alias("ns"), "frame", *[f"g_{n}" for n in SCAN_GATES])).alias("b"))
    rows = F.array(*[F.struct(F.lit(n).alias("gate"), F.col(f"b.g_{n}").cast("double").alias("v"), F.lit(S.WEIGHTS["window_scan"][n]).alias("w")) for n in SCAN_GATES])
    return best.select("action_id", F.col("b.frame").alias("frame"), F.explode(rows).alias("x")).select("action_id", "frame", "x.gate", F.round("x.v", 5).alias("value"), F.round(F.col("x.w") * F.col("x.v"), 5).alias("contribution"))


def dense_scores(spark, sf):
    """Both directions and both arms on every second frame, by all six gates; windows of ten frames before and after."""
    pose = A.pose(spark, sf)
    joint = lambda i: G.joint(F.col("joints"), i)
    t = pose.select(*BK, joint(A.PROFILE.left_wrist).alias("lw"), joint(A.PROFILE.right_wrist).alias("rw"), G.centroid(F.col("joints"), A.PROFILE.head, "xyz").alias("head"))
    b = blocked(t, GA.TRACK, "frame", 10, 10)
    d = b.df.withColumn("_w", F.collect_list(F.struct("frame", "lw", "rw")).over(b.span(-10, 10))).withColumn("_hb", b.at(F.col("head"), -5)).withColumn("_hf", b.at(F.col("head"), 5))
    d = b.core(d).where(F.pmod("frame", F.lit(2)) == 0)
    path = lambda n: F.transform("_w", lambda p: F.struct(p["frame"].alias("frame"), *[p[n][c].alias(c) for c in "xyz"]))
    acc = G.norm([F.col(f"_hf.{c}") - 2 * F.col(f"head.{c}") + F.col(f"_hb.{c}") for c in "xyz"])
    t = cut_lineage(d.select(*BK, *[K.decel_score(path(n)).alias(f"decel_{n}") for n in ("lw", "rw")], *[K.scalar_jerk_score(path(n)).alias(f"jerk_{n}") for n in ("lw", "rw")],
                             F.coalesce(K.cap1(acc / 0.06), F.lit(0.0)).alias("react")))
    p = pairs(spark, sf).where(F.pmod("frame", F.lit(2)) == 0)
    p = p.join(t.select(*KEYS, F.col("track_id").alias("striker_id"), "frame", "decel_lw", "decel_rw", "jerk_lw", "jerk_rw"), [*KEYS, "striker_id", "frame"])
    p = p.join(t.select(*KEYS, F.col("track_id").alias("receiver_id"), "frame", "react"), [*KEYS, "receiver_id", "frame"])
    body, w = (*A.PROFILE.head, *A.PROFILE.torso), S.WEIGHTS["dense_scan"]

    def arm(side):
        w_i, e_i, s_i = A.PROFILE.arm(side)
        wrist = G.joint(F.col("s.px"), w_i)
        near = G.min_dist(F.array(wrist), G.joints_of(F.col("r.px"), body))
        ext = GA.extension(wrist, G.joint(F.col("s.px"), e_i), G.joint(F.col("s.px"), s_i))
        return F.greatest(F.lit(0.0), 1 - near / 60.0), K.clip01((ext - 0.50) / 0.40)

    d3 = G.min_dist(G.joints_of(F.col("s.joints"), A.PROFILE.wrists), G.joints_of(F.col("r.joints"), body), "xyz")
    p = p.withColumn("g_prox3d", F.greatest(F.lit(0.0), 1 - d3 / 0.60))
    cands = []
    for n, (side, name) in enumerate((("left", "lw"), ("right", "rw"))):
        mask, ext = arm(side)
        sc = w["mask"] * mask + w["decel"] * F.col(f"decel_{name}") + w["react"] * F.col("react") + w["prox3d"] * F.col("g_prox3d") + w["jerk"] * F.col(f"jerk_{name}") + w["ext"] * ext
        cands.append(F.struct(F.round(sc, 9).alias("score"), F.lit(-n).alias("o"), F.lit(side).alias("side")))
    return p.withColumn("best", F.array_max(F.array(*cands))).select(
        *PK, F.col("best.score").alias("score"), F.col("best.side").alias("side"))


def _arm_sql(w, e, s):
    near = least_of(dpx("s", w, "r", j) for j in (*P.head, *P.torso))
    ext = f"{dpx('s', w, 's', s)}/({dpx('s', s, 's', e)}+{dpx('s', e, 's', w)})"
    return f"(0.36*greatest(0.0::DOUBLE, 1-{near}/60.0)+0.18*t.d{w}+0.10*t.j{w}+0.08*greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({ext}-0.50)/0.40)))"


_P3 = least_of(dj("s", w, "r", j, "xyz") for w in P.wrists for j in (*P.head, *P.torso))
_C5 = "PARTITION BY match_id, round_id, track_id, f ORDER BY frame"
view("dtr", f"""SELECT match_id, round_id, track_id, f AS frame, """ + ", ".join(
    f"CASE WHEN count(*) >= 3 AND max(v{j}) >= 1e-6 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE,-min(a{j}))/max(v{j})/0.6) ELSE 0 END AS d{j}, CASE WHEN count(*) >= 4 THEN coalesce(least(1.0::DOUBLE, max(k{j})/1.5),0) ELSE 0 END AS j{j}" for j in P.wrists) + """ FROM (SELECT *, """
     + ", ".join(f"abs(a{j}-lag(a{j}) OVER o) AS k{j}" for j in P.wrists) + " FROM (SELECT *, " + ", ".join(f"(v{j}-lag(v{j}) OVER o)/dt AS a{j}" for j in P.wrists) + " FROM (SELECT *, frame-lag(frame) OVER o AS dt, "
     + ", ".join(f"{hyp(*[f'{c}{j}-lag({c}{j}) OVER o' for c in 'xyz'])}/(frame-lag(frame) OVER o) AS v{j}" for j in P.wrists) + " FROM (SELECT a.match_id, a.round_id, a.track_id, a.frame AS f, b.frame, "
     + ", ".join(f"{g('b', j)} AS {c}{j}" for j in P.wrists for c, g in (("x", X), ("y", Y), ("z", Z))) + f""" FROM pz a JOIN pz b ON a.match_id=b.match_id AND a.round_id=b.round_id AND a.track_id=b.track_id AND b.frame BETWEEN a.frame-10 AND a.frame+10 WHERE a.frame % 2 = 0)
     WINDOW o AS ({_C5})) WINDOW o AS ({_C5})) WINDOW o AS ({_C5})) GROUP BY ALL""")
view("dre", f"""SELECT p.match_id, p.round_id, p.track_id, p.frame, CASE WHEN b.frame IS NULL OR n.frame IS NULL THEN 0 ELSE least(1.0::DOUBLE, {hyp(*[f"{h('n')}-2*{h('p')}+{h('b')}" for h in (HX, HY, HZ)])}/0.06) END AS react
  FROM pz p LEFT JOIN pz b ON p.match_id=b.match_id AND p.round_id=b.round_id AND p.track_id=b.track_id AND b.frame=p.frame-5
  LEFT JOIN pz n ON p.match_id=n.match_id AND p.round_id=n.round_id AND p.track_id=n.track_id AND n.frame=p.frame+5 WHERE p.frame % 2 = 0""")
view("dsc", f"""SELECT match_id, round_id, frame, striker_id, receiver_id, greatest(l, r) AS score, CASE WHEN r > l THEN 'right' ELSE 'left' END AS side FROM (
  SELECT match_id, round_id, frame, striker_id, receiver_id, round(l+0.12*greatest(0.0::DOUBLE, 1-d3/0.60)+0.16*react,9) AS l, round(r+0.12*greatest(0.0::DOUBLE, 1-d3/0.60)+0.16*react,9) AS r FROM (
  SELECT {PKEY}, {_arm_sql(19, 7, 5)} AS l, {_arm_sql(20, 8, 6)} AS r, {_P3} AS d3, x.react FROM {PAIR} JOIN dtr t ON t.match_id=s.match_id AND t.round_id=s.round_id AND t.track_id=s.track_id AND t.frame=s.frame
  JOIN dre x ON x.match_id=r.match_id AND x.round_id=r.round_id AND x.track_id=r.track_id AND x.frame=r.frame WHERE s.frame % 2 = 0))""")


@query("dense_scan_scores", "SELECT match_id, round_id, frame, striker_id, receiver_id, round(score,5) AS score, side FROM dsc")
def _(spark, sf):
    return dense_scores(spark, sf).select(*PK, F.round("score", 5).alias("score"), "side")


@query("dense_scan_detections", """WITH src AS (SELECT *, (match_id*10+round_id)*100000 + frame*10 + striker_id AS det_id, CAST(striker_id AS VARCHAR) AS pk FROM dsc WHERE score >= 0.3), """
       + pair_sql("src", "pk", 30, 10)
       + " SELECT s.match_id, s.round_id, s.frame, s.striker_id, round(s.score,5) AS score FROM src s JOIN run r ON s.det_id=r.det_id WHERE r.keep")
def _(spark, sf):
    from contactflow.operators.suppress import pair_global_cooldown
    d = dense_scores(spark, sf).where("score >= 0.3")
    d = pair_global_cooldown(d, KEYS, "frame", F.col("striker_id").cast("string"), pair_cooldown=30, global_cooldown=10, tie=["striker_id"])
    return d.select(*KEYS, "frame", "striker_id", F.round("score", 5).alias("score"))


# wrist inside the other box, fast and directed at the head
_VX = lambda j: f"({PX('s', j)}-{PX('q', j)})"
_VY = lambda j: f"({PY('s', j)}-{PY('q', j)})"
_OUT = lambda j: hyp(f"greatest(r.x1-0.05*(r.x2-r.x1)-{PX('s', j)}, 0.0, {PX('s', j)}-r.x2-0.05*(r.x2-r.x1))", f"greatest(r.y1-0.05*(r.y2-r.y1)-{PY('s', j)}, 0.0, {PY('s', j)}-r.y2-0.05*(r.y2-r.y1))")
_HPX, _HPY = f"({HX('r')}*400+960)", f"({HY('r')}*400+540)"


def _w(j):
    n = hyp(_VX(j), _VY(j))
    tx, ty = f"({_HPX}-{PX('s', j)})", f"({_HPY}-{PY('s', j)})"
    return f"{{'nd': {_OUT(j)}, 'spd': {n}/4, 'da': ({_VX(j)}*{tx}+{_VY(j)}*{ty})/(({n}+1e-6)*greatest({hyp(tx, ty)},1e-6))}}"


view("wib", f"""SELECT * FROM (SELECT match_id, round_id, frame, striker_id, CASE WHEN b.nd < a.nd THEN b ELSE a END AS w FROM (
  SELECT {PKEY}, {_w(19)} AS a, {_w(20)} AS b FROM {PAIR} JOIN pz q ON q.match_id=s.match_id AND q.round_id=s.round_id AND q.track_id=s.track_id AND q.frame=s.frame-4
  WHERE {hyp(f'{HX("s")}*400-{HX("r")}*400', f'{HY("s")}*400-{HY("r")}*400')} >= 20)) WHERE w.nd <= 0 AND w.spd >= 10 AND w.da >= 0.20""")


def wrist_box_rows(spark, sf):
    b = blocked(A.pose(spark, sf), GA.TRACK, "frame", 4, 0)
    prev = b.core(b.df.withColumn("px4", b.at(F.col("px"), -4)))
    p = J.pairs_same_frame(prev.select(*BK, "px", "px4", "bbox"))
    head = G.centroid(F.col("r.px"), A.PROFILE.head)
    p = p.withColumn("_head", head).where(G.dist(G.centroid(F.col("s.px"), A.PROFILE.head), F.col("_head")) >= 20)

    def one(i, order):
        w, q, box = G.joint(F.col("s.px"), i), G.joint(F.col("s.px4"), i), F.col("r.bbox")
        grow = F.struct((box["x1"] - 0.05 * (box["x2"] - box["x1"])).alias("x1"), (box["y1"] - 0.05 * (box["y2"] - box["y1"])).alias("y1"),
                        (box["x2"] + 0.05 * (box["x2"] - box["x1"])).alias("x2"), (box["y2"] + 0.05 * (box["y2"] - box["y1"])).alias("y2"))
        vx, vy = w["x"] - q["x"], w["y"] - q["y"]
        n = G.norm([vx, vy])
        tx, ty = F.col("_head.x") - w["x"], F.col("_head.y") - w["y"]
        da = (vx * tx + vy * ty) / ((n + 1e-6) * F.greatest(G.norm([tx, ty]), F.lit(1e-6)))
        return F.struct(G.outside_distance(w, grow).alias("nd"), F.lit(order).alias("o"), (n / 4).alias("spd"), da.alias("da"))

    both = F.array(one(A.PROFILE.left_wrist, 0), one(A.PROFILE.right_wrist, 1))
    best = F.array_min(F.filter(both, lambda c: c["nd"].isNotNull()))  # a missing wrist is not the deepest
    p = p.withColumn("w", best).where("w.nd <= 0 and w.spd >= 10 and w.da >= 0.20")
    return p.select(*KEYS, "frame", F.col("s.track_id").alias("striker_id"), F.col("w.spd").alias("speed"), F.col("w.da").alias("direction"))


@query("directed_speed_gate", "SELECT match_id, round_id, frame, striker_id, round(w.spd,4) AS speed, round(w.da,5) AS direction FROM wib")
def _(spark, sf):
    return wrist_box_rows(spark, sf).select(*KEYS, "frame", "striker_id", F.round("speed", 4).alias("speed"), F.round("direction", 5).alias("direction"))


@query("wrist_in_box_scan", "WITH bf AS (SELECT *, (match_id*10+round_id)*1000+frame AS det_id FROM (SELECT *, row_number() OVER (PARTITION BY match_id, round_id, frame ORDER BY striker_id) AS rn FROM wib) WHERE rn=1), "
       + first_fit_sql("bf", 10) + " SELECT b.match_id, b.round_id, b.frame, b.striker_id FROM bf b JOIN run r ON b.det_id=r.det_id WHERE r.keep")
def _(spark, sf):
    # deepest wrist first; all are inside, so the lower striker id decides
    return first_fit(wrist_box_rows(spark, sf), KEYS, "frame", 10, tie=["striker_id"]).select(*KEYS, "frame", "striker_id")


# ---- fusion

_PH = "0.30*g_decel+0.25*g_jerk+0.15*g_ext+0.15*g_depth+0.15*conf"


@query("weighted_fusion_phase", f"""WITH {_VEL}, ac AS (SELECT action_id, v, (v-lag(v) OVER (PARTITION BY action_id ORDER BY frame))/dt AS acc FROM v),
  d AS (SELECT action_id, CASE WHEN count(*) >= 3 AND max(v) >= 1e-6 THEN coalesce(least(1.0::DOUBLE, greatest(0.0::DOUBLE, -min(acc))/max(v)/0.6),0) ELSE 0 END AS g_decel FROM ac GROUP BY action_id),
  va AS (SELECT action_id, frame, dt, (vx-lag(vx) OVER w)/dt AS ax, (vy-lag(vy) OVER w)/dt AS ay, (vz-lag(vz) OVER w)/dt AS az FROM v WINDOW w AS (PARTITION BY action_id ORDER BY frame)),
  jk AS (SELECT action_id, coalesce(least(1.0::DOUBLE, max(jerk)/0.03),0) AS g_jerk FROM (SELECT action_id, {hyp('(ax-lag(ax) OVER w)/dt', '(ay-lag(ay) OVER w)/dt', '(az-lag(az) OVER w)/dt')} AS jerk FROM va WINDOW w AS (PARTITION BY action_id ORDER BY frame)) GROUP BY action_id),
  n AS (SELECT *, row_number() OVER (PARTITION BY action_id ORDER BY frame)-1 AS i, count(*) OVER (PARTITION BY action_id) AS n FROM atraj),
  pe AS (SELECT action_id, any_value(n) AS n, arg_min(x,i) AS x0, arg_min(y,i) AS y0, arg_min(z,i) AS z0, max(x) FILTER (i=n//2) AS xm, max(y) FILTER (i=n//2) AS ym, max(z) FILTER (i=n//2) AS zm, arg_max(x,i) AS x1, arg_max(y,i) AS y1, arg_max(z,i) AS z1 FROM n GROUP BY action_id),
  dp AS (SELECT action_id, CASE WHEN n < 4 THEN 0 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (1-((xm-x0)*(x1-xm)+(ym-y0)*(y1-ym)+(zm-z0)*(z1-zm))/(sqrt((xm-x0)**2+(ym-y0)**2+(zm-z0)**2)*sqrt((x1-xm)**2+(y1-ym)**2+(z1-zm)**2)))/1.5)) END AS g_depth FROM pe),
  e AS (SELECT action_id, any_value(confidence) AS conf, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (coalesce(max(ext) FILTER (frame BETWEEN window_start AND window_end), max(ext))-0.60)/0.35)) AS g_ext FROM atraj GROUP BY action_id)
  SELECT action_id, round({_PH},6) AS score, {_PH} >= 0.35 AS landed FROM d JOIN e USING (action_id) JOIN jk USING (action_id) JOIN dp USING (action_id)""")
def _(spark, sf):
    ext = lambda arr: F.array_max(F.transform(arr, lambda p: p["ext"]))
    inside = F.filter("t", lambda p: p["frame"].between(F.col("window_start"), F.col("window_end")))
    t = action_traj(spark, sf)
    t = t.withColumns({"g_decel": K.decel_score(F.col("t")), "g_jerk": K.jerk_score(F.col("t")), "g_depth": K.depth_convergence(F.col("t")),
                       "g_ext": K.clip01((F.coalesce(ext(inside), ext(F.col("t"))) - 0.60) / 0.35), "g_conf": F.col("confidence")})
    t = t.withColumn("score", SC.weighted_sum(S.WEIGHTS["phase"]))
    return t.select("action_id", r6(F.col("score"), "score"), (F.col("score") >= 0.35).alias("landed"))


_G3 = ["mask", "decel", "prox3d", "jerk", "conf", "ext"]


@query("approach_weight_sets", """WITH g AS (SELECT det_id, ce AS mask, conf AS decel, audio AS prox3d, ce_ht AS jerk, conf, least(1.0::DOUBLE, score) AS ext, audio AS react, ce_ht AS dual FROM ft)
  SELECT det_id, 'standard' AS approach, round(CASE WHEN mask<0.05 AND prox3d<0.05 THEN 0 ELSE 0.40*mask+0.20*decel+0.15*prox3d+0.12*jerk+0.08*conf+0.05*ext END,6) AS score FROM g
  UNION ALL SELECT det_id, 'reaction', round(CASE WHEN mask<0.05 AND prox3d<0.05 THEN 0 ELSE 0.33*mask+0.18*decel+0.14*react+0.12*prox3d+0.10*jerk+0.08*conf+0.05*ext END,6) FROM g
  UNION ALL SELECT det_id, 'dual_body', round(CASE WHEN mask<0.05 AND prox3d<0.05 AND decel<0.3 THEN 0 ELSE 0.28*mask+0.16*decel+0.18*dual+0.12*prox3d+0.10*jerk+0.08*conf+0.08*ext END,6) FROM g""")
def _(spark, sf):
    g = features(spark, sf)
    g = (g.withColumn("g_mask", F.col("ce")).withColumn("g_decel", F.col("conf")).withColumn("g_prox3d", F.col("audio")).withColumn("g_jerk", F.col("ce_ht"))
         .withColumn("g_conf", F.col("conf")).withColumn("g_ext", F.least(F.lit(1.0), F.col("score"))).withColumn("g_react", F.col("audio")).withColumn("g_dual", F.col("ce_ht")))
    none = (F.col("g_mask") < 0.05) & (F.col("g_prox3d") < 0.05)
    soft = none & (F.col("g_decel") < 0.3)
    rows = [F.struct(F.lit(n).alias("approach"), F.round(F.when(soft if n == "dual_body" else none, 0.0).otherwise(SC.weighted_sum(S.WEIGHTS[n])), 6).alias("score"))
            for n in ("standard", "reaction", "dual_body")]
    return g.select("det_id", F.explode(F.array(*rows)).alias("a")).select("det_id", "a.approach", "a.score")


@query("and_or_combination", """SELECT det_id, CASE WHEN ce>=0.5 AND audio>=0.3 AND conf>=0.2 THEN 1.0 ELSE 0.0 END::DOUBLE AS and_score, round(0.45*ce+0.35*audio+0.20*conf,6) AS weighted FROM ft""")
def _(spark, sf):
    w = S.WEIGHTS["and_or"]
    return features(spark, sf).select("det_id", F.when((F.col("ce") >= 0.5) & (F.col("audio") >= 0.3) & (F.col("conf") >= 0.2), 1.0).otherwise(0.0).alias("and_score"),
                                      r6(w["mask"] * F.col("ce") + w["depth"] * F.col("audio") + w["react"] * F.col("conf"), "weighted"))


@query("rank_normalised_average", """SELECT det_id, round(0.5*ra/greatest(1,n-1)+0.5*rb/greatest(1,n-1),6) AS combined FROM (SELECT det_id, row_number() OVER (ORDER BY score, det_id)-1 AS ra,
  row_number() OVER (ORDER BY ce, det_id)-1 AS rb, count(*) OVER () AS n FROM ft)""")
def _(spark, sf):
    d = features(spark, sf).select("det_id", "score", "ce").withColumn("g", F.lit(1))
    a = ranked(d, ["g"], "score", tie=["det_id"]).select("det_id", "g", "ce", (F.col("rank_first") - 1).alias("ra"))
    b = ranked(a, ["g"], "ce", tie=["det_id"])
    n1 = F.greatest(F.lit(1), F.col("n") - 1)
    return b.select("det_id", r6(0.5 * F.col("ra") / n1 + 0.5 * (F.col("rank_first") - 1) / n1, "combined"))


@query("percentile_tiers", """SELECT det_id, round(pct,1) AS pct, CASE WHEN score > 0.5 THEN 'impact' WHEN dist > 150 THEN 'not_impact' WHEN pct >= 90 THEN 'impact' WHEN pct >= 70 THEN 'borderline' ELSE 'not_impact' END AS tier FROM (
  SELECT *, 100.0*(row_number() OVER (PARTITION BY match_id ORDER BY score, det_id)-1)/greatest(1, count(*) OVER (PARTITION BY match_id)-1) AS pct FROM ft)""")
def _(spark, sf):
    d = ranked(features(spark, sf), ["match_id"], "score", tie=["det_id"])
    d = d.withColumn("pct", 100.0 * (F.col("rank_first") - 1) / F.greatest(F.lit(1), F.col("n") - 1))
    tier = (F.when(F.col("score") > 0.5, "impact").when(F.col("dist") > 150, "not_impact").when(F.col("pct") >= 90, "impact")
            .when(F.col("pct") >= 70, "borderline").otherwise("not_impact"))
    return d.select("det_id", F.round("pct", 1).alias("pct"), tier.alias("tier"))


@query("plausibility_gate", "SELECT det_id, dist > 150 AS implausible, score > 0.5 OR NOT (dist > 150) AS keep FROM ft")
def _(spark, sf):
    return features(spark, sf).select("det_id", (F.col("dist") > 150).alias("implausible"), ((F.col("score") > 0.5) | ~(F.col("dist") > 150)).alias("keep"))


@query("model_mean_probability", """SELECT det_id, round(avg(p),6) AS prob FROM (SELECT det_id, ce AS p FROM ft UNION ALL SELECT det_id, audio FROM ft UNION ALL SELECT det_id, conf FROM ft) GROUP BY det_id""")
def _(spark, sf):
    d = features(spark, sf).select("det_id", F.explode(F.array("ce", "audio", "conf")).alias("p"))
    return d.groupBy("det_id").agg(F.round(F.avg("p"), 6).alias("prob"))


_JT = (*P.head, *P.torso, 7, 8)
_REGION_SQL = f"CASE WHEN jt IN ({','.join(map(str, P.head))}) THEN 'head' WHEN jt IN ({','.join(map(str, P.torso))}) THEN 'torso' ELSE 'arm' END"


@query("rich_detection_metadata", f"""WITH k AS (SELECT d.match_id, d.round_id, d.frame, d.striker_id, d.score FROM dsc d WHERE d.score >= 0.3),
  h AS (SELECT * FROM (SELECT k.match_id, k.round_id, k.frame AS f0, k.striker_id, k.score, c.frame, c.d, c.jt, c.hx, c.hy, row_number() OVER (PARTITION BY k.match_id, k.round_id, k.frame, k.striker_id ORDER BY c.d, c.frame) AS rn FROM k JOIN (
    SELECT match_id, round_id, frame, striker_id, m.d AS d, m.k AS jt, m.hx AS hx, m.hy AS hy FROM (SELECT {PKEY}, list_min([{",".join(f"{{'d': {least_of([dj('s', 19, 'r', j), dj('s', 20, 'r', j)])}, 'k': {j}, 'hx': {PX('r', j)}, 'hy': {PY('r', j)}}}" for j in _JT)}]) AS m FROM {PAIR})) c
    ON c.match_id=k.match_id AND c.round_id=k.round_id AND c.striker_id=k.striker_id AND abs(c.frame-k.frame)<=12) WHERE rn=1),
  ac AS (SELECT h.match_id, h.round_id, h.f0, h.striker_id, first(p.action ORDER BY p.confidence DESC, p.action_frame, p.action_id) AS action, max(p.confidence) AS conf FROM h JOIN pact p ON p.match_id=h.match_id AND p.round_id=h.round_id AND p.fighter_id=h.striker_id AND abs(p.action_frame-h.f0)<=8 GROUP BY ALL),
  ec AS (SELECT h.match_id, h.round_id, h.f0, h.striker_id, first(p.contact_region ORDER BY p.contact_prob DESC, p.ce_frame) AS region, max(p.contact_prob) AS ce FROM h JOIN pce p ON p.match_id=h.match_id AND p.round_id=h.round_id AND p.striker_id=h.striker_id AND abs(p.ce_frame-h.f0)<=15 GROUP BY ALL),
  ao AS (SELECT h.match_id, h.round_id, h.f0, max(o.strength) AS audio FROM (SELECT DISTINCT match_id, round_id, f0 FROM h) h JOIN pons o ON o.match_id=h.match_id AND o.round_id=h.round_id AND abs(o.onset_frame-h.f0)<=8 GROUP BY ALL)
  SELECT match_id, round_id, f0 AS frame, striker_id, frame AS contact_frame, round(d,6) AS dist, jt AS joint, round(hx,3) AS hit_x, round(hy,3) AS hit_y, CASE WHEN ce >= 0.7 THEN ec.region ELSE {_REGION_SQL} END AS contact_region,
    coalesce(action,'punch') AS action, round(coalesce(conf,0)*40,4) AS speed_kmh, round(coalesce(audio,0),6) AS audio, round(coalesce(ce,0),6) AS ce
  FROM h LEFT JOIN ac USING (match_id, round_id, f0, striker_id) LEFT JOIN ec USING (match_id, round_id, f0, striker_id) LEFT JOIN ao USING (match_id, round_id, f0)""")
def _(spark, sf):
    """What a detection is exported with: the strongest action nearby, sound, contact frame, struck joint and its place; a sure contact event (0.7) names the region."""
    k = cut_lineage(dense_scores(spark, sf).where("score >= 0.3").select(*KEYS, "frame", "striker_id"))
    side = [*KEYS, "striker_id"]
    w = F.array(*[G.joint(F.col("s.joints"), i) for i in A.PROFILE.wrists])
    c = pairs(spark, sf).withColumn("m", G.nearest_joint_region(w, F.col("r.joints"), A.PROFILE))
    hit = F.get(F.col("r.px"), F.col("m.k"))
    c = c.select(*side, F.col("frame").alias("cf"), F.col("m.d").alias("d"), F.col("m.k").alias("joint"), hit["x"].alias("hit_x"), hit["y"].alias("hit_y"))
    k = J.best_in_band(k, c, side, left_on="frame", right_on="cf", lo=-12, hi=12, order=[F.col("d"), F.col("cf")], keep=["cf", "d", "joint", "hit_x", "hit_y"]).where("cf is not null")
    a = A.pose_actions(spark, sf).groupBy(*KEYS, F.col("fighter_id").alias("striker_id"), "action_frame").agg(J.least([-F.col("confidence"), F.col("action_id")], F.col("action")).alias("_a"))
    a = a.select(*side, "action_frame", (-F.col("_a._o0")).alias("conf"), "_a.action")
    k = J.best_in_band(k, a, side, left_on="frame", right_on="action_frame", lo=-8, hi=8, order=[-F.col("conf"), F.col("action_frame")], keep=["action", "conf"])
    ce = A.pose_contacts(spark, sf).groupBy(*side, "ce_frame").agg(J.least([-F.col("contact_prob")], F.col("contact_region")).alias("_c"))
    ce = ce.select(*side, "ce_frame", (-F.col("_c._o0")).alias("ce"), F.col("_c.contact_region").alias("event_region"))
    k = J.best_in_band(k, ce, side, left_on="frame", right_on="ce_frame", lo=-15, hi=15, order=[-F.col("ce"), F.col("ce_frame")], keep=["ce", "event_region"])
    k = J.best_in_band(k, A.pose_onsets(spark, sf), KEYS, left_on="frame", right_on="onset_frame", lo=-8, hi=8, order=[-F.col("strength"), F.col("onset_frame")], keep=["strength"])
    own = F.when(F.col("joint").isin(*A.PROFILE.head), "head").when(F.col("joint").isin(*A.PROFILE.torso), "torso").otherwise("arm")
    # the pose actions carry no speed: 40 km/h at full confidence stands for it
    return k.select(*KEYS, "frame", "striker_id", F.col("cf").alias("contact_frame"), r6(F.col("d"), "dist"), "joint", F.round("hit_x", 3).alias("hit_x"), F.round("hit_y", 3).alias("hit_y"),
                    F.when(F.col("ce") >= 0.7, F.col("event_region")).otherwise(own).alias("contact_region"), F.coalesce("action", F.lit("punch")).alias("action"),
                    F.round(F.coalesce("conf", F.lit(0.0)) * 40, 4).alias("speed_kmh"), r6(F.coalesce("strength", F.lit(0.0)), "audio"), r6(F.coalesce("ce", F.lit(0.0)), "ce"))


@query("audio_class_scan", "WITH cls AS (SELECT match_id, round_id, onset_frame AS frame, onset_frame + 1000*round_id + 10000*match_id AS det_id, strength*0.6+0.3*(onset_frame%5)/5.0 AS score FROM ons), good AS (SELECT * FROM cls WHERE score >= 0.2), "
       + nms_sql("good", 12) + " SELECT g.match_id, g.round_id, g.frame, round(g.score,6) AS score FROM good g SEMI JOIN ids USING (det_id)")
def _(spark, sf):
    # class probabilities come in as a map; the impact classes are summed
    o = A.onsets(spark, sf).withColumn("frame", F.col("onset_frame"))
    probs = F.create_map(F.lit("slap"), F.col("strength") * 0.6, F.lit("thud"), 0.3 * F.pmod("onset_frame", F.lit(5)) / 5.0, F.lit("crowd"), F.lit(0.4))
    pick = F.map_filter(probs, lambda k, v: k.isin("slap", "thud"))
    o = o.withColumn("score", F.aggregate(F.map_values(pick), F.lit(0.0), lambda a, v: a + v)).where("score >= 0.2")
    return greedy_nms(o, KEYS, "frame", "score", 12, tie="onset_frame").select(*KEYS, "frame", r6(F.col("score"), "score"))


# ---- remaining pose gates

@query("window_proximity_gate", f"""SELECT a.action_id, round(coalesce(max(greatest(0.0::DOUBLE, 1-p.d/0.60)),0),6) AS g_prox3d FROM pact a LEFT JOIN (
  SELECT {PKEY}, {least_of(dj('s', 20, 'r', j, 'xyz') for j in (*P.head, *P.torso))} AS d FROM {PAIR}) p
  ON a.match_id=p.match_id AND a.round_id=p.round_id AND a.fighter_id=p.striker_id AND p.frame BETWEEN greatest(greatest(0, a.window_start-5), a.action_frame-8) AND least(a.window_end+5, a.action_frame+12) GROUP BY a.action_id""")
def _(spark, sf):
    p = pairs(spark, sf).select(*KEYS, "frame", F.col("striker_id").alias("fighter_id"), G.min_dist(
        F.array(G.joint(F.col("s.joints"), 20)), G.joints_of(F.col("r.joints"), (*A.PROFILE.head, *A.PROFILE.torso)), "xyz").alias("d"))
    a = A.pose_actions(spark, sf)
    a2 = (a.withColumn("lo", F.greatest(F.lit(0), F.col("window_start") - 5, F.col("action_frame") - 8))
          .withColumn("hi", F.least(F.col("window_end") + 5, F.col("action_frame") + 12)))
    j = J.interval_join(a2, p, [*KEYS, "fighter_id"], start="lo", end="hi", before=0, after=0, how="left")
    return j.groupBy("action_id").agg(F.round(F.coalesce(F.max(F.greatest(F.lit(0.0), 1 - F.col("d") / 0.60)), F.lit(0.0)), 6).alias("g_prox3d"))


@query("proximity_argmax_frame", f"""SELECT action_id, coalesce(arg_max(f, prox), any_value(action_frame))::INTEGER AS best_frame, round(coalesce(max(prox),0),6) AS prox FROM (SELECT a.action_id, a.action_frame, p.frame AS f,
    greatest(0.0::DOUBLE, 1-p.d/60.0) AS prox FROM pact a JOIN (SELECT {PKEY}, {least_of(dpx('s', 20, 'r', j) for j in (*P.head, *P.torso))} AS d FROM {PAIR}) p
    ON a.match_id=p.match_id AND a.round_id=p.round_id AND a.fighter_id=p.striker_id AND p.frame BETWEEN greatest(0, a.window_start-5) AND a.window_end+5 ORDER BY action_id, p.frame) GROUP BY action_id""")
def _(spark, sf):
    p = pairs(spark, sf).select(*KEYS, "frame", F.col("striker_id").alias("fighter_id"), G.min_dist(
        F.array(G.joint(F.col("s.px"), 20)), G.joints_of(F.col("r.px"), (*A.PROFILE.head, *A.PROFILE.torso))).alias("d"))
    a = A.pose_actions(spark, sf).withColumn("lo", F.greatest(F.lit(0), F.col("window_start") - 5)).withColumn("hi", F.col("window_end") + 5)
    j = J.interval_join(a, p.where("d is not null"), [*KEYS, "fighter_id"], start="lo", end="hi", before=0, after=0)
    b = j.groupBy("action_id").agg(F.min(F.struct((-F.greatest(F.lit(0.0), 1 - F.col("d") / 60.0)).alias("np"), "frame")).alias("b"))
    return b.select("action_id", F.col("b.frame").alias("best_frame"), r6(-F.col("b.np"), "prox"))


@query("pooled_frame_score", """SELECT d.match_id, d.round_id, d.frame, d.striker_id, round(max(e.score),6) AS max_score, round(sum(pow(0.7, abs(e.frame-d.frame))*e.score)/(1+2*0.7*0.7),6) AS ema_score
  FROM dsc d JOIN dsc e ON d.match_id=e.match_id AND d.round_id=e.round_id AND d.striker_id=e.striker_id AND abs(e.frame-d.frame) <= 2 GROUP BY ALL""")
def _(spark, sf):
    # missing frames count as zero, so weights are normalised over every offset on the stride-2 axis
    d = dense_scores(spark, sf).select(*KEYS, "striker_id", "frame", "score")
    b = blocked(d, [*KEYS, "striker_id"], "frame", 2, 2)
    tot = None
    x = b.df.withColumn("m", F.max("score").over(b.span(-2, 2)))
    for o in (-2, 0, 2):
        t = (0.7 ** abs(o)) * F.coalesce(b.at(F.col("score"), o), F.lit(0.0))
        tot = t if tot is None else tot + t
    x = b.core(x.withColumn("e", tot / (1 + 2 * 0.7 ** 2)))
    return x.select(*KEYS, "frame", "striker_id", r6(F.col("m"), "max_score"), r6(F.col("e"), "ema_score"))


@query("dual_body_correlation", f"""WITH f AS (SELECT a.action_id, p.* FROM pact a JOIN (SELECT {PKEY}, {X('s', 20)} AS wx, {Y('s', 20)} AS wy, {Z('s', 20)} AS wz, {HX('r')} AS hx, {HY('r')} AS hy, {"((" + "+".join(Z('r', j) for j in P.head) + ")/5)"} AS hz FROM {PAIR}) p
    ON a.match_id=p.match_id AND a.round_id=p.round_id AND a.fighter_id=p.striker_id AND p.frame BETWEEN greatest(greatest(0, a.window_start-5), a.action_frame-5) AND least(a.window_end+5, a.action_frame+5)),
  v AS (SELECT action_id, frame, sqrt((wx-lag(wx) OVER w)**2+(wy-lag(wy) OVER w)**2+(wz-lag(wz) OVER w)**2)/(frame-lag(frame) OVER w) AS sw, sqrt((hx-lag(hx) OVER w)**2+(hy-lag(hy) OVER w)**2+(hz-lag(hz) OVER w)**2)/(frame-lag(frame) OVER w) AS sh FROM f WINDOW w AS (PARTITION BY action_id ORDER BY frame)),
  d AS (SELECT action_id, -(sw-lag(sw) OVER w) AS a, sh-lag(sh) OVER w AS b FROM v WINDOW w AS (PARTITION BY action_id ORDER BY frame))
  SELECT action_id, round(CASE WHEN count(*) < 4 THEN 0 ELSE coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (corr(a,b)+1)/2)),0) END,5) AS g_dual FROM d GROUP BY action_id""")
def _(spark, sf):
    p = pairs(spark, sf).select(*KEYS, "frame", F.col("striker_id").alias("fighter_id"), G.joint(F.col("s.joints"), 20).alias("w"), G.centroid(F.col("r.joints"), A.PROFILE.head, "xyz").alias("h"))
    a = (A.pose_actions(spark, sf).withColumn("lo", F.greatest(F.lit(0), F.col("window_start") - 5, F.col("action_frame") - 5))
         .withColumn("hi", F.least(F.col("window_end") + 5, F.col("action_frame") + 5)))
    j = J.interval_join(a, p, [*KEYS, "fighter_id"], start="lo", end="hi", before=0, after=0)
    t = j.groupBy("action_id").agg(F.sort_array(F.collect_list(F.struct("frame", "w", "h"))).alias("t"))
    return t.select("action_id", F.round(K.dual_body_score(F.col("t"), "w", "h"), 5).alias("g_dual"))


@query("landmark_top_contact", f"""SELECT vec_id, round(list_avg(list_reverse_sort([e[i]*e[i] FOR i IN range(1,22)])[1:8]),6) AS score FROM pz""")
def _(spark, sf):
    v = F.transform("joints", lambda j: j["x"])
    e = A.table(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 21), lambda x: x.cast("double")).alias("v"))
    return e.select("vec_id", r6(GX.top_landmark_contact(F.col("v"), F.col("v")), "score"))


@query("depth_delta_gates", f"""SELECT {PKEY}, round(abs({Z('s', 20)}-({"+".join(Z('r', j) for j in P.head)})/5),6) AS delta, round(exp(-pow(({Z('s', 20)}-list_median(b))/(list_stddev_pop(b)+1e-3),2)/2),5) AS g_depth FROM
  (SELECT *, [{",".join(Z('q', j) for j in (*P.head, *P.torso))}] AS b FROM pz q) r JOIN pz s ON s.match_id=r.match_id AND s.round_id=r.round_id AND s.frame=r.frame AND s.track_id<>r.track_id
  WHERE abs({Z('s', 20)}-({"+".join(Z('r', j) for j in P.head)})/5) < 0.25""")
def _(spark, sf):
    w = G.joint(F.col("s.joints"), 20)["z"]
    b = G.field(G.joints_of(F.col("r.joints"), (*A.PROFILE.head, *A.PROFILE.torso)), "z")
    srt = F.sort_array(b)
    med = srt[4]  # nine sampled depths
    mu = G.mean_of(b)
    sd = F.sqrt(F.aggregate(b, F.lit(0.0), lambda a, v: a + (v - mu) * (v - mu)) / F.size(b))
    delta = F.abs(w - G.centroid(F.col("r.joints"), A.PROFILE.head, "xyz")["z"])
    p = pairs(spark, sf).withColumn("delta", delta).where("delta is null or delta < 0.25")
    return p.select(*PK, r6(F.col("delta"), "delta"), F.round(GX.depth_gate((w - med) / (sd + 1e-3)), 5).alias("g_depth"))


@query("approach_trend_slope", f"""WITH d AS (SELECT a.match_id, a.round_id, a.striker_id, a.frame, b.head_gap, row_number() OVER (PARTITION BY {_AK} ORDER BY b.frame)-1 AS i {_PWIN.format(lo=8, hi=0)} WHERE (a.frame-b.frame) % 2 = 0),
  t AS (SELECT match_id, round_id, striker_id, frame, CASE WHEN count(*) >= 3 THEN -regr_slope(head_gap, i) END AS slope FROM d GROUP BY ALL),
  m AS (SELECT a.match_id, a.round_id, a.striker_id, a.frame, min(b.head_gap) AS least_gap {_PWIN.format(lo=5, hi=5)} GROUP BY ALL)
  SELECT t.match_id, t.round_id, t.striker_id, t.frame, round(coalesce(t.slope, (g.head_gap-m.least_gap)/8, 0),5) AS trend FROM t JOIN m USING (match_id, round_id, striker_id, frame)
  LEFT JOIN pgap g ON g.match_id=t.match_id AND g.round_id=t.round_id AND g.striker_id=t.striker_id AND g.frame=t.frame-8""")
def _(spark, sf):
    """Slope of the gap over nine frames, else its mean rate since eight frames ago."""
    pg = GA.pair_frames(hot(spark, sf))
    b = blocked(pg, GA.PAIR, "frame", 8, 5)
    g = b.df.withColumn("_w", F.collect_list(F.struct("frame", "head_gap")).over(b.span(-8, 0))).withColumn("_m", F.min("head_gap").over(b.span(-5, 5))).withColumn("_g8", b.at(F.col("head_gap"), -8))
    v = G.field(F.filter("_w", lambda x: F.pmod(F.col("frame") - x["frame"], F.lit(2)) == 0), "head_gap")
    g = b.core(g.withColumn("v", v))
    trend = F.coalesce(F.when(F.size("v") >= 3, -K.slope(F.col("v"))), (F.col("_g8") - F.col("_m")) / 8, F.lit(0.0))
    return g.select(*KEYS, "striker_id", "frame", F.round(trend, 5).alias("trend"))


_CXY = lambda j: hyp(f"{PX('s', j)}-(r.x1+r.x2)/2", f"{PY('s', j)}-(r.y1+r.y2)/2")


@query("min_fist_distance", f"""WITH c AS (SELECT {PKEY}, {least_of(_CXY(j) for j in P.wrists)} AS cd FROM {PAIR}), m AS (SELECT {_AK.replace('a.receiver_id, ', '')}, min(b.head_gap) AS d_min {_PWIN.format(lo=5, hi=5)} GROUP BY ALL)
  SELECT m.match_id, m.round_id, m.striker_id, m.frame, round(m.d_min,6) AS d_min, round(min(c.cd),4) AS d_body FROM m JOIN c ON c.match_id=m.match_id AND c.round_id=m.round_id AND c.striker_id=m.striker_id AND c.frame BETWEEN m.frame-5 AND m.frame+5 GROUP BY ALL""")
def _(spark, sf):
    """Least distance of a fist to the head (shoulder widths) and to the box centre (pixels) within five frames; 1000 where unknown."""
    px = pairs(spark, sf)
    centre = G.box_center(F.col("r.bbox"))
    body = px.select(*PK, F.least(*[G.dist(G.joint(F.col("s.px"), i), centre) for i in A.PROFILE.wrists]).alias("body"))
    b = blocked(GA.pair_frames(hot(spark, sf)).join(body, PK), GA.PAIR, "frame", 5, 5)
    d = b.core(b.df.withColumn("d_min", F.min("head_gap").over(b.span(-5, 5))).withColumn("d_body", F.min("body").over(b.span(-5, 5))))
    return d.select(*KEYS, "striker_id", "frame", r6(F.coalesce("d_min", F.lit(1000.0)), "d_min"), F.round(F.coalesce("d_body", F.lit(1000.0)), 4).alias("d_body"))


@query("post_contact_displacement", f"""SELECT p.match_id, p.round_id, p.track_id, p.frame, round(least(1.0::DOUBLE, coalesce(max({hyp(f"{HX('n')}-{HX('p')}", f"{HY('n')}-{HY('p')}")}/({hyp('(p.x2-p.x1)/400', '(p.y2-p.y1)/400')}+1e-6)),0)/0.30),5) AS g_react
  FROM pz p LEFT JOIN pz n ON p.match_id=n.match_id AND p.round_id=n.round_id AND p.track_id=n.track_id AND n.frame BETWEEN p.frame+1 AND p.frame+6 GROUP BY ALL""")
def _(spark, sf):
    d = A.pose(spark, sf).select(*BK, G.centroid(F.col("joints"), A.PROFILE.head).alias("head"),
                                 (G.norm([(F.col("bbox.x2") - F.col("bbox.x1")) / 400, (F.col("bbox.y2") - F.col("bbox.y1")) / 400]) + 1e-6).alias("diag"))
    b = blocked(d, GA.TRACK, "frame", 0, 6)
    x = b.df.withColumn("_h", F.collect_list("head").over(b.span(1, 6)))
    mx = F.coalesce(F.array_max(F.transform("_h", lambda h: G.dist(h, F.col("head")))), F.lit(0.0))
    return b.core(x.withColumn("mx", mx / F.col("diag"))).select(*BK, F.round(F.least(F.lit(1.0), F.col("mx") / 0.30), 5).alias("g_react"))


@query("track_distance_approach", """SELECT s.match_id, s.round_id, s.frame, s.track_id AS striker_id, round(sqrt(((s.x1+s.x2)/2-(r.x1+r.x2)/2)**2+((s.y1+s.y2)/2-(r.y1+r.y2)/2)**2),4) AS d_now,
  round(coalesce(sqrt(((s5.x1+s5.x2)/2-(r5.x1+r5.x2)/2)**2+((s5.y1+s5.y2)/2-(r5.y1+r5.y2)/2)**2)-sqrt(((s.x1+s.x2)/2-(r.x1+r.x2)/2)**2+((s.y1+s.y2)/2-(r.y1+r.y2)/2)**2),0),4) AS approach
  FROM pz s JOIN pz r ON s.match_id=r.match_id AND s.round_id=r.round_id AND s.frame=r.frame AND s.track_id<>r.track_id
  LEFT JOIN pz s5 ON s5.match_id=s.match_id AND s5.round_id=s.round_id AND s5.track_id=s.track_id AND s5.frame=s.frame-5 LEFT JOIN pz r5 ON r5.match_id=s.match_id AND r5.round_id=s.round_id AND r5.track_id=r.track_id AND r5.frame=s.frame-5""")
def _(spark, sf):
    p = pairs(spark, sf).select(*PK, G.dist(G.box_center(F.col("s.bbox")), G.box_center(F.col("r.bbox"))).alias("d"))
    b = blocked(p, GA.PAIR, "frame", 5, 0)
    x = b.core(b.df.withColumn("d5", b.at(F.col("d"), -5)))
    return x.select(*KEYS, "frame", "striker_id", F.round("d", 4).alias("d_now"), F.round(F.coalesce(F.col("d5") - F.col("d"), F.lit(0.0)), 4).alias("approach"))


def _live_sql():
    def net(j):
        raw = (f"({PX('s', j)}-{PX('q', j)})", f"({PY('s', j)}-{PY('q', j)})")
        m = hyp(*raw)
        k = f"(CASE WHEN {m} > 60 THEN 60/{m} ELSE 1 END)"
        bx = f"(({PX('s', 9)}+{PX('s', 10)})/2-({PX('q', 9)}+{PX('q', 10)})/2)"
        by = f"(({PY('s', 9)}+{PY('s', 10)})/2-({PY('q', 9)}+{PY('q', 10)})/2)"
        return f"({raw[0]}*{k}-{bx})", f"({raw[1]}*{k}-{by})"
    out = []
    for j in (19, 20):
        vx, vy = net(j)
        out.append(f"{vx} AS vx{j}, {vy} AS vy{j}")
    return ", ".join(out)


@query("directed_velocity", f"""SELECT {PKEY}, {_live_sql()} FROM {PAIR} JOIN pz q ON q.match_id=s.match_id AND q.round_id=s.round_id AND q.track_id=s.track_id AND q.frame=s.frame-1""".join(["SELECT match_id, round_id, frame, striker_id, round(vx19,4) AS vx_left, round(vy19,4) AS vy_left, round(vx20,4) AS vx_right, round(vy20,4) AS vy_right FROM (", ")"]))
def _(spark, sf):
    p = live_rows(spark, sf).where("s.v_left is not null")
    return p.select(*KEYS, "frame", F.col("s.track_id").alias("striker_id"), F.round("s.v_left.x", 4).alias("vx_left"), F.round("s.v_left.y", 4).alias("vy_left"),
                    F.round("s.v_right.x", 4).alias("vx_right"), F.round("s.v_right.y", 4).alias("vy_right"))


def live_rows(spark, sf):
    """Pairs whose striker carries wrist velocity net of hip drift, clamped to 60 px per frame."""
    from contactflow.operators.ordering import previous_row
    d = previous_row(A.pose(spark, sf).select(*BK, "px", "bbox"), GA.TRACK, "frame", F.struct("frame", "px"), "prev")
    dt = (F.col("frame") - F.col("prev.frame")).cast("double")
    hips = (A.PROFILE.left_hip, A.PROFILE.right_hip)
    shoulders = (A.PROFILE.left_shoulder, A.PROFILE.right_shoulder)
    moved = lambda part, c: (G.centroid(F.col("px"), part)[c] - G.centroid(F.col("prev.px"), part)[c]) / dt
    drift = {c: F.coalesce(moved(hips, c), moved(shoulders, c)) for c in "xy"}  # bodies without hips drift by their shoulders
    for side in ("left", "right"):
        i = A.PROFILE.arm(side)[0]
        raw = {c: (G.joint(F.col("px"), i)[c] - G.joint(F.col("prev.px"), i)[c]) / dt for c in "xy"}
        m = G.norm(raw.values())
        k = F.when(m > 60.0, 60.0 / m).otherwise(1.0)
        d = d.withColumn(f"v_{side}", F.when(dt.isNotNull(), G.point(raw["x"] * k - drift["x"], raw["y"] * k - drift["y"])))
    return J.pairs_same_frame(d.drop("prev"))


def _live_score():
    parts = []
    for n, (w, e, s) in enumerate(((19, 7, 5), (20, 8, 6))):
        ext = f"({dpx('s', w, 's', s)}/({dpx('s', w, 's', e)}+{dpx('s', e, 's', s)}))"
        for m, j in enumerate((*P.head, *P.torso)):
            d = dpx("r", j, "s", w)
            dv = f"((vx{w}*({PX('r', j)}-{PX('s', w)})+vy{w}*({PY('r', j)}-{PY('s', w)}))/{d})"
            sc = f"(0.35*greatest(0.0::DOUBLE,1-{d}/60.0)+0.40*least(1.0::DOUBLE,greatest(0.0::DOUBLE,{dv})/12.0)+0.15*least(1.0::DOUBLE,({ext}-0.68)/0.32)+0.10)"
            parts.append(f"CASE WHEN {ext} >= 0.68 AND {dv} >= 9.0 THEN {sc} END")
    return "greatest(" + ",".join(parts) + ")"


@query("live_contact_score", f"""SELECT * FROM (SELECT {PKEY}, round({_live_score()},5) AS prob FROM (SELECT s.*, q.e AS qe, {_live_sql()} FROM pz s JOIN pz q ON q.match_id=s.match_id AND q.round_id=s.round_id AND q.track_id=s.track_id AND q.frame=s.frame-1) s
  JOIN pz r ON s.match_id=r.match_id AND s.round_id=r.round_id AND s.frame=r.frame AND s.track_id<>r.track_id WHERE ({PX('s', 19)} BETWEEN r.x1-120 AND r.x2+120 AND {PY('s', 19)} BETWEEN r.y1-120 AND r.y2+120)
  OR ({PX('s', 20)} BETWEEN r.x1-120 AND r.x2+120 AND {PY('s', 20)} BETWEEN r.y1-120 AND r.y2+120)) WHERE prob IS NOT NULL""")
def _(spark, sf):
    p = GX.live_contact(live_rows(spark, sf), A.PROFILE, reach=120.0, min_extension=0.68, min_velocity=9.0, proximity=60.0, full_velocity=12.0)
    return p.select(*KEYS, "frame", F.col("s.track_id").alias("striker_id"), F.col("r.track_id").alias("receiver_id"), F.round("contact.prob", 5).alias("prob"))
