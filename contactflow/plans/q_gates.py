"""Kinematic gate queries (survey group G) and the detectors built from them."""
from __future__ import annotations

from pyspark.sql import functions as F

from contactflow.functions import geometry as G
from contactflow.functions import kinematics as K
from contactflow.functions import scoring as SC
from contactflow.operators import detector as D
from contactflow.operators import gates as GA
from contactflow.operators import gates_extra as GX
from contactflow.operators.joins import interval_join, pairs_same_frame
from contactflow.operators.ordering import blocked, previous_row
from contactflow.plans.q_geometry import BK, PK, box_pairs, pairs, r6
from contactflow.plans.registry import query, view
from contactflow.plans.sqltext import (
    BPAIR, HX, HY, HZ, PAIR, PKEY, PX, PY, SW, X, Y, Z, P, dj, dpx, hyp, iou, least_of, min_pair, segdist)
from contactflow.sources import adapters as A

PROFILE = A.PROFILE
TK = "match_id, round_id, track_id, frame"
WTK = "PARTITION BY match_id, round_id, track_id ORDER BY frame"


def hot(spark, sf):
    return GA.hot_joints(A.pose(spark, sf), PROFILE)


@query("velocity_profile", f"""SELECT {TK}, round({hyp('x-px', 'y-py', 'z-pz_')}/greatest(frame-pf,1),6) AS speed FROM (
  SELECT {TK}, {X('p', 20)} AS x, {Y('p', 20)} AS y, {Z('p', 20)} AS z, lag({X('p', 20)}) OVER w AS px, lag({Y('p', 20)}) OVER w AS py,
  lag({Z('p', 20)}) OVER w AS pz_, lag(frame) OVER w AS pf FROM pz p WINDOW w AS ({WTK})) WHERE pf IS NOT NULL""")
def _(spark, sf):
    p = A.pose(spark, sf).select(*BK, G.joint(F.col("joints"), 20).alias("j"))
    d = previous_row(p, GA.TRACK, "frame", F.struct("frame", "j"), "prev").where("prev is not null")
    dt = F.greatest(F.col("frame") - F.col("prev.frame"), F.lit(1))
    return d.select(*BK, r6(G.dist(F.col("j"), F.col("prev.j"), "xyz") / dt, "speed"))


# one trajectory per padded action: frames of the striker's right wrist
view("atraj", f"""SELECT action_id, confidence, window_start, window_end, p.frame, {X('p', 20)} AS x, {Y('p', 20)} AS y, {Z('p', 20)} AS z,
  {dj('p', 20, 'p', 6)}/nullif({dj('p', 20, 'p', 8)}+{dj('p', 8, 'p', 6)},0) AS ext
  FROM pact a JOIN pz p ON a.match_id=p.match_id AND a.round_id=p.round_id AND a.fighter_id=p.track_id
  AND p.frame BETWEEN greatest(0, window_start-5) AND window_end+5""")


def action_traj(spark, sf):
    """Per action: ordered array of wrist positions and arm extension."""
    j = F.col("joints")
    f = A.pose(spark, sf).select("match_id", "round_id", F.col("track_id").alias("fighter_id"), "frame",
                                 G.joint(j, 20).alias("w"), GA.extension(G.joint(j, 20), G.joint(j, 8), G.joint(j, 6)).alias("ext"))
    t = interval_join(A.pose_actions(spark, sf), f, ["match_id", "round_id", "fighter_id"],
                      start="window_start", end="window_end", before=5, after=5)
    return t.groupBy("action_id", "confidence", "window_start", "window_end").agg(
        F.sort_array(F.collect_list(F.struct("frame", F.col("w.x").alias("x"), F.col("w.y").alias("y"),
                                             F.col("w.z").alias("z"), "ext"))).alias("t"))


_VEL = f"""v AS (SELECT action_id, frame, frame-lag(frame) OVER w AS dt, {hyp('x-lag(x) OVER w', 'y-lag(y) OVER w', 'z-lag(z) OVER w')}/(frame-lag(frame) OVER w) AS v,
  (x-lag(x) OVER w)/(frame-lag(frame) OVER w) AS vx, (y-lag(y) OVER w)/(frame-lag(frame) OVER w) AS vy, (z-lag(z) OVER w)/(frame-lag(frame) OVER w) AS vz
  FROM atraj WINDOW w AS (PARTITION BY action_id ORDER BY frame))"""


@query("wrist_deceleration_gate", f"""WITH {_VEL}, a AS (SELECT action_id, v, (v-lag(v) OVER (PARTITION BY action_id ORDER BY frame))/dt AS acc FROM v)
  SELECT action_id, round(CASE WHEN count(*) >= 3 AND max(v) >= 1e-6 THEN coalesce(least(1.0::DOUBLE, greatest(0.0::DOUBLE, -min(acc))/max(v)/0.6), 0) ELSE 0 END,6) AS g_decel
  FROM a GROUP BY action_id""")
def _(spark, sf):
    return action_traj(spark, sf).select("action_id", r6(K.decel_score(F.col("t")), "g_decel"))


@query("vector_jerk_gate", f"""WITH {_VEL}, a AS (SELECT action_id, frame, dt, (vx-lag(vx) OVER w)/dt AS ax, (vy-lag(vy) OVER w)/dt AS ay, (vz-lag(vz) OVER w)/dt AS az
  FROM v WINDOW w AS (PARTITION BY action_id ORDER BY frame)),
  j AS (SELECT action_id, frame, {hyp('(ax-lag(ax) OVER w)/dt', '(ay-lag(ay) OVER w)/dt', '(az-lag(az) OVER w)/dt')} AS jerk
  FROM a WINDOW w AS (PARTITION BY action_id ORDER BY frame))
  SELECT action_id, round(coalesce(max(jerk),0),4) AS jerk, coalesce(arg_max(frame, jerk), -1)::INTEGER AS jerk_frame, round(coalesce(least(1.0::DOUBLE, max(jerk)/0.03),0),6) AS g_jerk
  FROM j GROUP BY action_id""")
def _(spark, sf):
    pk = K.jerk_peak(F.col("t"))
    return action_traj(spark, sf).select("action_id", F.round(F.coalesce(pk["jerk"], F.lit(0.0)), 4).alias("jerk"),
                                         F.coalesce(pk["frame"], F.lit(-1)).alias("jerk_frame"), r6(K.jerk_score(F.col("t")), "g_jerk"))


@query("scalar_jerk_gate", f"""WITH {_VEL}, a AS (SELECT action_id, frame, (v-lag(v) OVER w)/dt AS acc FROM v WINDOW w AS (PARTITION BY action_id ORDER BY frame)),
  j AS (SELECT action_id, abs(acc-lag(acc) OVER w) AS jerk FROM a WINDOW w AS (PARTITION BY action_id ORDER BY frame))
  SELECT action_id, round(coalesce(least(1.0::DOUBLE, max(jerk)/1.5),0),6) AS g_jerk FROM j GROUP BY action_id""")
def _(spark, sf):
    return action_traj(spark, sf).select("action_id", r6(K.scalar_jerk_score(F.col("t")), "g_jerk"))


@query("arm_extension_window_gate", """SELECT action_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (coalesce(max(ext) FILTER (frame BETWEEN window_start AND window_end), max(ext))-0.60)/0.35)),6) AS g_ext
  FROM atraj GROUP BY action_id""")
def _(spark, sf):
    ext = F.transform("t", lambda p: p["ext"])
    inside = F.transform(F.filter("t", lambda p: p["frame"].between(F.col("window_start"), F.col("window_end"))), lambda p: p["ext"])
    peak = F.coalesce(F.array_max(inside), F.array_max(ext))
    return action_traj(spark, sf).select("action_id", r6(K.clip01((peak - 0.60) / 0.35), "g_ext"))


@query("arm_extension_frame_gate", f"""SELECT {TK}, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (max(greatest(
  coalesce({dj('p', 19, 'p', 5)}/({dj('p', 5, 'p', 7)}+{dj('p', 7, 'p', 19)}),0), coalesce({dj('p', 20, 'p', 6)}/({dj('p', 6, 'p', 8)}+{dj('p', 8, 'p', 20)}),0)))
  OVER (PARTITION BY match_id, round_id, track_id ORDER BY frame RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)-0.45)/0.40)),6) AS g_ext FROM pz p""")
def _(spark, sf):
    return GA.track_gates(hot(spark, sf)).select(*BK, r6(K.clip01((F.col("ext") - 0.45) / 0.40), "g_ext"))


@query("depth_convergence_gate", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY action_id ORDER BY frame)-1 AS i, count(*) OVER (PARTITION BY action_id) AS n FROM atraj),
  e AS (SELECT action_id, any_value(n) AS n, arg_min(x,i) AS x0, arg_min(y,i) AS y0, arg_min(z,i) AS z0, max(x) FILTER (i=n//2) AS xm, max(y) FILTER (i=n//2) AS ym,
  max(z) FILTER (i=n//2) AS zm, arg_max(x,i) AS x1, arg_max(y,i) AS y1, arg_max(z,i) AS z1 FROM n GROUP BY action_id)
  SELECT action_id, round(CASE WHEN n < 4 THEN 0 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (1-((xm-x0)*(x1-xm)+(ym-y0)*(y1-ym)+(zm-z0)*(z1-zm))/
  (sqrt((xm-x0)**2+(ym-y0)**2+(zm-z0)**2)*sqrt((x1-xm)**2+(y1-ym)**2+(z1-zm)**2)))/1.5)) END,6) AS g_depth FROM e""")
def _(spark, sf):
    return action_traj(spark, sf).select("action_id", r6(K.depth_convergence(F.col("t")), "g_depth"))


@query("action_confidence_gate", """SELECT action_id, round(0.5*least(1.0::DOUBLE,confidence)+0.25*least(1.0::DOUBLE,power_watts/3000.0)+0.25*least(1.0::DOUBLE,speed_kmh/25.0),6) AS g_conf FROM act""")
def _(spark, sf):
    return A.actions(spark, sf).select("action_id", r6(SC.action_confidence(F.col("confidence"), F.col("power_watts"), F.col("speed_kmh")), "g_conf"))


_WIN = """w AS (SELECT a.match_id, a.round_id, a.track_id, a.frame AS f, b.frame, {cols} FROM pz a JOIN pz b ON a.match_id=b.match_id AND a.round_id=b.round_id
  AND a.track_id=b.track_id AND b.frame BETWEEN a.frame-{k} AND a.frame+{k})"""
_PF = "PARTITION BY match_id, round_id, track_id, f ORDER BY frame"


@query("wrist_decel_window_gate", "WITH " + _WIN.format(k=5, cols=",".join(f"{X('b', j)} AS x{j}, {Y('b', j)} AS y{j}" for j in P.wrists)) + f""",
  v AS (SELECT *, """ + ",".join(f"{hyp(f'x{j}-lag(x{j}) OVER o', f'y{j}-lag(y{j}) OVER o')}/(frame-lag(frame) OVER o) AS v{j}" for j in P.wrists) + f""" FROM w WINDOW o AS ({_PF})),
  a AS (SELECT *, """ + ",".join(f"v{j}-lag(v{j}) OVER o AS a{j}" for j in P.wrists) + f""" FROM v WINDOW o AS ({_PF}))
  SELECT match_id, round_id, track_id, f AS frame, round(CASE WHEN count(*) >= 4 THEN greatest(""" + ",".join(
    f"CASE WHEN max(v{j}) >= 1e-6 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE,-min(a{j}))/max(v{j})/0.6) ELSE 0 END" for j in P.wrists) + """) ELSE 0 END,6) AS g_decel
  FROM a GROUP BY match_id, round_id, track_id, f""")
def _(spark, sf):
    return GA.track_gates(hot(spark, sf)).select(*BK, r6(F.col("g_decel"), "g_decel"))


@query("wrist_peak_speed_gate", "WITH " + _WIN.format(k=6, cols=f"{SW('b')} AS sw," + ",".join(f"{X('b', j)} AS x{j}, {Y('b', j)} AS y{j}" for j in P.wrists)) + f""",
  v AS (SELECT *, """ + ",".join(f"{hyp(f'x{j}-lag(x{j}) OVER o', f'y{j}-lag(y{j}) OVER o')}/(frame-lag(frame) OVER o) AS v{j}" for j in P.wrists) + f""" FROM w WINDOW o AS ({_PF}))
  SELECT match_id, round_id, track_id, f AS frame, round(CASE WHEN count(*) >= 3 THEN greatest(max(v19), max(v20))/avg(sw) ELSE 0 END,6) AS peak,
  round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((CASE WHEN count(*) >= 3 THEN greatest(max(v19), max(v20))/avg(sw) ELSE 0 END)-0.40)/0.60)),6) AS g_speed
  FROM v GROUP BY match_id, round_id, track_id, f""")
def _(spark, sf):
    return GA.track_gates(hot(spark, sf)).select(*BK, r6(F.col("peak"), "peak"), r6(K.clip01((F.col("peak") - 0.40) / 0.60), "g_speed"))


_OFF = """FROM pz p LEFT JOIN pz b ON p.match_id=b.match_id AND p.round_id=b.round_id AND p.track_id=b.track_id AND b.frame=p.frame-{k}
  LEFT JOIN pz n ON p.match_id=n.match_id AND p.round_id=n.round_id AND p.track_id=n.track_id AND n.frame=p.frame+{k}"""
_PTK = "p.match_id, p.round_id, p.track_id, p.frame"


@query("head_reaction_gate", f"""SELECT {_PTK}, round(CASE WHEN b.frame IS NULL OR n.frame IS NULL THEN 0 ELSE least(1.0::DOUBLE, {hyp(f"{HX('n')}-2*{HX('p')}+{HX('b')}", f"{HY('n')}-2*{HY('p')}+{HY('b')}")}/{SW('p')}/1.5) END,6) AS g_react """ + _OFF.format(k=4))
def _(spark, sf):
    return GA.track_gates(hot(spark, sf)).select(*BK, r6(F.col("g_react"), "g_react"))


@query("head_reaction_velocity_gate", f"""SELECT {_PTK}, round(coalesce(least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({hyp(*[f"({h('n')}-{h('p')})/4-({h('p')}-{h('b')})/4" for h in (HX, HY, HZ)])}-0.05)/0.25)),0),6) AS g_react """ + _OFF.format(k=4))
def _(spark, sf):
    b = blocked(hot(spark, sf).select(*BK, "head"), GA.TRACK, "frame", 4, 4)
    d = b.core(b.df.withColumn("p", b.at(F.col("head"), -4)).withColumn("n", b.at(F.col("head"), 4)))
    acc = G.norm([(F.col(f"n.{c}") - F.col(f"head.{c}")) / 4 - (F.col(f"head.{c}") - F.col(f"p.{c}")) / 4 for c in "xyz"])
    return d.select(*BK, r6(F.coalesce(K.clip01((acc - 0.05) / 0.25), F.lit(0.0)), "g_react"))


@query("three_point_decel_gate", f"""SELECT {_PTK}, round(coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (greatest(""" + ",".join(
    f"greatest(0.0::DOUBLE, {hyp(*[f'{c('p', j)}-{c('b', j)}' for c in (X, Y, Z)])}/3-{hyp(*[f'{c('n', j)}-{c('p', j)}' for c in (X, Y, Z)])}/3)" for j in P.wrists)
    + """)-0.02)/0.15)),0),6) AS g_decel """ + _OFF.format(k=3).replace("LEFT JOIN", "LEFT JOIN"))
def _(spark, sf):
    b = blocked(hot(spark, sf).select(*BK, "lw", "rw"), GA.TRACK, "frame", 3, 3)
    d = b.df
    for w in ("lw", "rw"):
        d = d.withColumn(f"{w}_p", b.at(F.col(w), -3)).withColumn(f"{w}_n", b.at(F.col(w), 3))
    drop = F.greatest(*[F.greatest(F.lit(0.0), G.dist(F.col(w), F.col(f"{w}_p"), "xyz") / 3 - G.dist(F.col(f"{w}_n"), F.col(w), "xyz") / 3)
                        for w in ("lw", "rw")])
    has = F.col("lw_p").isNotNull() & F.col("lw_n").isNotNull()
    return b.core(d).select(*BK, r6(F.when(has, K.clip01((drop - 0.02) / 0.15)).otherwise(0.0), "g_decel"))


@query("backward_displacement_speed_gate", f"""SELECT {_PTK}, round(coalesce(greatest(""" + ",".join(f"{hyp(*[f'{c('p', j)}-{c('b', j)}' for c in (X, Y, Z)])}/4" for j in P.hands)
       + """),0),6) AS speed, round(least(1.0::DOUBLE, coalesce(greatest(""" + ",".join(f"{hyp(*[f'{c('p', j)}-{c('b', j)}' for c in (X, Y, Z)])}/4" for j in P.hands) + """),0)/0.10),6) AS g_vel """ + _OFF.format(k=4))
def _(spark, sf):
    names = ("lw", "rw", "le", "re")
    b = blocked(hot(spark, sf).select(*BK, *names), GA.TRACK, "frame", 4, 0)
    d = b.df
    for w in names:
        d = d.withColumn(f"{w}_p", b.at(F.col(w), -4))
    v = F.coalesce(F.greatest(*[G.dist(F.col(w), F.col(f"{w}_p"), "xyz") / 4 for w in names]), F.lit(0.0))
    return b.core(d).select(*BK, r6(v, "speed"), r6(F.least(F.lit(1.0), v / 0.10), "g_vel"))


_GAPH = min_pair("s", P.wrists, "r", P.head)
_GAPT = min_pair("s", P.wrists, "r", P.torso)
_PW = lambda c: f"(CASE WHEN {hyp(f'{X('s', 20)}-{HX('r')}', f'{Y('s', 20)}-{HY('r')}')} < {hyp(f'{X('s', 19)}-{HX('r')}', f'{Y('s', 19)}-{HY('r')}')} THEN {c('s', 20)} ELSE {c('s', 19)} END)"
_GUARD = least_of(segdist(X("r", j), Y("r", j), "pwx", "pwy", HX("r"), HY("r")) for j in P.guard)
view("pgap", f"""SELECT match_id, round_id, striker_id, receiver_id, frame, least(gh, gt_)/sw AS gap, CASE WHEN gh <= gt_ THEN 'head' ELSE 'torso' END AS region,
  gh/sw AS head_gap, iou, gd/sw AS guard_d FROM (SELECT {PKEY}, {_GAPH} AS gh, {_GAPT} AS gt_, {SW('r')} AS sw, {iou('s', 'r')} AS iou,
  {least_of(segdist(X('r', j), Y('r', j), _PW(X), _PW(Y), HX('r'), HY('r')) for j in P.guard)} AS gd FROM {PAIR})""")


@query("wrist_body_gap", "SELECT match_id, round_id, striker_id, receiver_id, frame, round(gap,6) AS gap, region, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.3-gap)),6) AS g_gap FROM pgap")
def _(spark, sf):
    return GA.pair_frames(hot(spark, sf)).select(*GA.PAIR, "frame", r6(F.col("gap"), "gap"), "region", r6(K.clip01(1.3 - F.col("gap")), "g_gap"))


_PWIN = """FROM pgap a JOIN pgap b ON a.match_id=b.match_id AND a.round_id=b.round_id AND a.striker_id=b.striker_id AND a.receiver_id=b.receiver_id AND b.frame BETWEEN a.frame-{lo} AND a.frame+{hi}"""
_AK = "a.match_id, a.round_id, a.striker_id, a.receiver_id, a.frame"


@query("approach_rate_gate", f"""WITH d AS (SELECT {_AK}, b.head_gap < lag(b.head_gap) OVER (PARTITION BY {_AK} ORDER BY b.frame) AS down {_PWIN.format(lo=8, hi=0)})
  SELECT match_id, round_id, striker_id, receiver_id, frame, round(CASE WHEN count(*) >= 4 THEN avg(CAST(down AS INTEGER)) ELSE 0 END,6) AS g_approach FROM d GROUP BY ALL""")
def _(spark, sf):
    return GA.pair_gates(GA.pair_frames(hot(spark, sf))).select(*GA.PAIR, "frame", r6(F.col("g_approach"), "g_approach"))


@query("guard_interception_gate", f"SELECT {_AK}, round(coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (min(b.guard_d)-0.30)/1.20)),0.5),6) AS g_guard {_PWIN.format(lo=3, hi=0)} GROUP BY ALL")
def _(spark, sf):
    return GA.pair_gates(GA.pair_frames(hot(spark, sf))).select(*GA.PAIR, "frame", r6(F.col("g_guard"), "g_guard"))


@query("mean_overlap_penalty", f"SELECT {_AK}, round(avg(b.iou),6) AS mean_iou, round(1-0.6*avg(b.iou),6) AS factor {_PWIN.format(lo=2, hi=2)} GROUP BY ALL")
def _(spark, sf):
    return GA.pair_gates(GA.pair_frames(hot(spark, sf))).select(
        *GA.PAIR, "frame", r6(F.col("mean_iou"), "mean_iou"), r6(1 - 0.6 * F.col("mean_iou"), "factor"))


# ---- box gates over the event tracks
view("stp", """SELECT b.*, p.x1 IS NOT NULL AS has, sqrt(((b.x1+b.x2)/2-(p.x1+p.x2)/2)**2+(b.y1-p.y1)**2)/greatest(1.0::DOUBLE, b.y2-b.y1) AS snap,
  sqrt(((b.x1+b.x2)/2-(p.x1+p.x2)/2)**2+(b.y1+0.18*(b.y2-b.y1)-p.y1-0.18*(p.y2-p.y1))**2) AS step
  FROM box b LEFT JOIN box p ON b.match_id=p.match_id AND b.round_id=p.round_id AND b.track_id=p.track_id AND p.frame=b.frame-1""")
_RW = "(PARTITION BY match_id, round_id, track_id ORDER BY frame RANGE BETWEEN {} AND {})"


@query("box_snap_gate", f"""SELECT {TK}, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (coalesce(max(snap) OVER {_RW.format('1 FOLLOWING', '8 FOLLOWING')},0)
  /greatest(coalesce(avg(snap) OVER {_RW.format('2 PRECEDING', 'CURRENT ROW')},0.02),0.005)-1)/4)),6) AS g_bbox_react FROM stp""")
def _(spark, sf):
    return GX.box_snap(A.boxes(spark, sf)).select(*BK, r6(F.col("g_bbox_react"), "g_bbox_react"))


@query("receiver_motion", f"""SELECT {TK}, round(pre,4) AS motion_pre, round(post,4) AS motion_post, round(post-pre,4) AS motion_delta, round(va-vb,4) AS head_accel FROM (
  SELECT *, coalesce(avg(step) OVER {_RW.format('5 PRECEDING', 'CURRENT ROW')},0) AS pre, coalesce(avg(step) OVER {_RW.format('2 FOLLOWING', '7 FOLLOWING')},0) AS post,
  coalesce(avg(step) OVER {_RW.format('4 PRECEDING', '2 PRECEDING')},0) AS vb, coalesce(avg(step) OVER {_RW.format('3 FOLLOWING', '5 FOLLOWING')},0) AS va FROM stp)""")
def _(spark, sf):
    m = GX.receiver_motion(A.boxes(spark, sf))
    return m.select(*BK, *[F.round(c, 4).alias(c) for c in ("motion_pre", "motion_post", "motion_delta", "head_accel")])


@query("velocity_change_sum", f"""WITH c AS (SELECT b.*, sqrt(((n.x1+n.x2)/2-(b.x1+b.x2)+(p.x1+p.x2)/2)**2+(n.y1+0.18*(n.y2-n.y1)-2*(b.y1+0.18*(b.y2-b.y1))+p.y1+0.18*(p.y2-p.y1))**2) AS chg
  FROM box b LEFT JOIN box p ON b.match_id=p.match_id AND b.round_id=p.round_id AND b.track_id=p.track_id AND p.frame=b.frame-1
  LEFT JOIN box n ON b.match_id=n.match_id AND b.round_id=n.round_id AND b.track_id=n.track_id AND n.frame=b.frame+1)
  SELECT {TK}, round(coalesce(sum(chg) OVER {_RW.format('4 PRECEDING', '4 FOLLOWING')},0),4) AS vel_change FROM c""")
def _(spark, sf):
    return GX.velocity_change(A.boxes(spark, sf)).select(*BK, F.round("vel_change", 4).alias("vel_change"))


_BOFF = _OFF.replace("pz", "box")


@query("box_displacement_area_change", f"""SELECT {_PTK}, round(coalesce(sqrt(((n.x1+n.x2)/2-(b.x1+b.x2)/2)**2+((n.y1+n.y2)/2-(b.y1+b.y2)/2)**2),0),4) AS pos_change,
  round(coalesce(abs((n.x2-n.x1)*(n.y2-n.y1)-(b.x2-b.x1)*(b.y2-b.y1))/greatest(1.0::DOUBLE,(b.x2-b.x1)*(b.y2-b.y1)),0),6) AS area_change """ + _BOFF.format(k=5))
def _(spark, sf):
    return GX.box_change(A.boxes(spark, sf)).select(*BK, F.round("pos_change", 4).alias("pos_change"), r6(F.col("area_change"), "area_change"))


@query("flow_ratio_gate", f"""SELECT {TK}, round(coalesce(avg(x1) OVER {_RW.format('4 PRECEDING', '1 PRECEDING')},0)/(coalesce(avg(x1) OVER {_RW.format('30 PRECEDING', '11 PRECEDING')},0)+1e-4),4) AS flow_ratio FROM box""")
def _(spark, sf):
    flow = A.boxes(spark, sf).select(*BK, F.col("bbox.x1").alias("flow"))
    return GX.flow_ratio(flow, "flow").select(*BK, F.round("flow_ratio", 4).alias("flow_ratio"))


@query("flow_ratio_filter", f"""SELECT * FROM (SELECT {TK}, round(coalesce(avg(x1) OVER {_RW.format('4 PRECEDING', '1 PRECEDING')},0)/(coalesce(avg(x1) OVER {_RW.format('30 PRECEDING', '11 PRECEDING')},0)+1e-4),4) AS flow_ratio FROM box) WHERE flow_ratio >= 1.3""")
def _(spark, sf):
    flow = A.boxes(spark, sf).select(*BK, F.col("bbox.x1").alias("flow"))
    return GX.flow_ratio(flow, "flow").select(*BK, F.round("flow_ratio", 4).alias("flow_ratio")).where("flow_ratio >= 1.3")


@query("flow_windows", f"""SELECT {TK}, max(x1) OVER {_RW.format('CURRENT ROW', '5 FOLLOWING')} AS flow_ahead, max(x1) OVER {_RW.format('4 PRECEDING', 'CURRENT ROW')} AS flow_back FROM box""")
def _(spark, sf):
    flow = A.boxes(spark, sf).select(*BK, F.col("bbox.x1").alias("flow"))
    return GX.flow_windows(flow, "flow")


# ---- detectors

_ANCH = f"""tg AS (SELECT match_id, round_id, track_id, f AS frame, greatest(
    CASE WHEN max(v19) >= 1e-6 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE,-min(a19))/max(v19)/0.6) ELSE 0 END,
    CASE WHEN max(v20) >= 1e-6 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE,-min(a20))/max(v20)/0.6) ELSE 0 END) AS g_decel, count(*) AS n FROM a5 GROUP BY 1,2,3,4),
  ps AS (SELECT match_id, round_id, track_id, f AS frame, greatest(max(v19), max(v20))/avg(sw) AS peak FROM v6 GROUP BY 1,2,3,4),
  ex AS (SELECT {TK}, max(greatest(coalesce({dj('p', 19, 'p', 5)}/({dj('p', 5, 'p', 7)}+{dj('p', 7, 'p', 19)}),0), coalesce({dj('p', 20, 'p', 6)}/({dj('p', 6, 'p', 8)}+{dj('p', 8, 'p', 20)}),0)))
     OVER (PARTITION BY match_id, round_id, track_id ORDER BY frame RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS ext FROM pz p),
  hr AS (SELECT {_PTK}, CASE WHEN b.frame IS NULL OR n.frame IS NULL THEN 0 ELSE least(1.0::DOUBLE, {hyp(f"{HX('n')}-2*{HX('p')}+{HX('b')}", f"{HY('n')}-2*{HY('p')}+{HY('b')}")}/{SW('p')}/1.5) END AS g_react {_OFF.format(k=4)}),
  ap0 AS (SELECT {_AK}, b.head_gap < lag(b.head_gap) OVER (PARTITION BY {_AK} ORDER BY b.frame) AS down {_PWIN.format(lo=8, hi=0)}),
  ap AS (SELECT match_id, round_id, striker_id, frame, CASE WHEN count(*) >= 4 THEN avg(CAST(down AS INTEGER)) ELSE 0 END AS g_approach FROM ap0 GROUP BY 1,2,3,4),
  gu AS (SELECT a.match_id, a.round_id, a.striker_id, a.frame, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (min(b.guard_d)-0.30)/1.20)) AS g_guard {_PWIN.format(lo=3, hi=0)} GROUP BY 1,2,3,4),
  ov AS (SELECT a.match_id, a.round_id, a.striker_id, a.frame, avg(b.iou) AS mean_iou {_PWIN.format(lo=2, hi=2)} GROUP BY 1,2,3,4),
  bf AS (SELECT * FROM (SELECT a.*, g.frame, g.receiver_id, g.gap, g.region, row_number() OVER (PARTITION BY a.action_id ORDER BY g.gap, g.frame) AS rn
     FROM pact a JOIN pgap g ON a.match_id=g.match_id AND a.round_id=g.round_id AND a.fighter_id=g.striker_id AND g.frame BETWEEN window_start-3 AND window_end+5) WHERE rn=1),
  cp AS (SELECT * FROM (SELECT b.action_id, c.contact_prob, c.contact_region, row_number() OVER (PARTITION BY b.action_id ORDER BY c.contact_prob DESC, c.ce_frame) AS rn FROM bf b JOIN pce c
     ON b.match_id=c.match_id AND b.round_id=c.round_id AND b.fighter_id=c.striker_id AND b.receiver_id=c.receiver_id AND c.ce_frame BETWEEN b.frame-15 AND b.frame+15) WHERE rn=1),
  au AS (SELECT b.action_id, max(o.strength) AS g_audio FROM bf b JOIN pons o ON b.match_id=o.match_id AND b.round_id=o.round_id AND o.onset_frame BETWEEN b.frame-8 AND b.frame+8 GROUP BY b.action_id),
  al AS (SELECT b.match_id, b.round_id, b.action_id, b.fighter_id AS striker_id, b.receiver_id, b.frame, b.gap, tg.g_decel, ps.peak, ex.ext, hr.g_react, ap.g_approach, gu.g_guard, ov.mean_iou,
     coalesce(cp.contact_region, b.region) AS contact_region, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.3-b.gap)) AS g_gap, coalesce(cp.contact_prob,0) AS g_ce_prob,
     CASE coalesce(cp.contact_region, b.region) WHEN 'head' THEN 1.0 WHEN 'torso' THEN 0.85 WHEN 'left_arm' THEN 0.2 WHEN 'right_arm' THEN 0.2 ELSE 0.3 END AS g_region,
     greatest(0.0::DOUBLE, least(1.0::DOUBLE, (ex.ext-0.45)/0.40)) AS g_ext, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (ps.peak-0.40)/0.60)) AS g_speed, b.confidence AS g_conf, coalesce(au.g_audio, 0) AS g_audio
     FROM bf b JOIN tg ON tg.match_id=b.match_id AND tg.round_id=b.round_id AND tg.track_id=b.fighter_id AND tg.frame=b.frame
     JOIN ps ON ps.match_id=b.match_id AND ps.round_id=b.round_id AND ps.track_id=b.fighter_id AND ps.frame=b.frame
     JOIN ex ON ex.match_id=b.match_id AND ex.round_id=b.round_id AND ex.track_id=b.fighter_id AND ex.frame=b.frame
     JOIN hr ON hr.match_id=b.match_id AND hr.round_id=b.round_id AND hr.track_id=b.receiver_id AND hr.frame=b.frame
     JOIN ap ON ap.match_id=b.match_id AND ap.round_id=b.round_id AND ap.striker_id=b.fighter_id AND ap.frame=b.frame
     JOIN gu ON gu.match_id=b.match_id AND gu.round_id=b.round_id AND gu.striker_id=b.fighter_id AND gu.frame=b.frame
     JOIN ov ON ov.match_id=b.match_id AND ov.round_id=b.round_id AND ov.striker_id=b.fighter_id AND ov.frame=b.frame
     LEFT JOIN cp ON cp.action_id=b.action_id LEFT JOIN au ON au.action_id=b.action_id),
  sc AS (SELECT *, CASE WHEN gap > 0.95 THEN 'far' WHEN peak < 0.42 THEN 'slow' WHEN mean_iou >= 0.18 AND g_approach < 0.55 AND ext < 0.90 THEN 'clinch'
     WHEN ext < 0.45 AND g_approach < 0.45 THEN 'guard' END AS reject_reason,
     (0.26*g_gap+0.08*g_ce_prob+0.10*g_region+0.08*g_decel+0.10*g_ext+0.08*g_speed+0.06*g_react+0.06*g_approach+0.04*g_audio+0.04*g_conf+0.10*g_guard)*(1-0.6*mean_iou) AS score FROM al)"""
_V5 = _WIN.format(k=5, cols=",".join(f"{X('b', j)} AS x{j}, {Y('b', j)} AS y{j}" for j in P.wrists)).replace("w AS", "w5 AS", 1)
_V6 = _WIN.format(k=6, cols=f"{SW('b')} AS sw," + ",".join(f"{X('b', j)} AS x{j}, {Y('b', j)} AS y{j}" for j in P.wrists)).replace("w AS", "w6 AS", 1)
_VV = ",".join(f"{hyp(f'x{j}-lag(x{j}) OVER o', f'y{j}-lag(y{j}) OVER o')}/(frame-lag(frame) OVER o) AS v{j}" for j in P.wrists)
_AA = ",".join(f"v{j}-lag(v{j}) OVER o AS a{j}" for j in P.wrists)
ANCHORED = f"""WITH {_V5}, {_V6}, v5 AS (SELECT *, {_VV} FROM w5 WINDOW o AS ({_PF})), v6 AS (SELECT *, {_VV} FROM w6 WINDOW o AS ({_PF})),
  a5 AS (SELECT *, {_AA} FROM v5 WINDOW o AS ({_PF})), {_ANCH}"""


@query("anchored_contact_scores", ANCHORED + """ SELECT action_id, frame, striker_id, receiver_id, contact_region, reject_reason, round(score,5) AS score, round(gap,5) AS gap, round(g_decel,5) AS g_decel,
  round(g_react,5) AS g_react, round(g_approach,5) AS g_approach, round(g_guard,5) AS g_guard, round(mean_iou,5) AS mean_iou FROM sc""")
def _(spark, sf):
    s = D.score_anchored(D.anchored_gates(A.pose(spark, sf), A.pose_actions(spark, sf), PROFILE), A.pose_contacts(spark, sf), A.pose_onsets(spark, sf))
    return s.select("action_id", "frame", "striker_id", "receiver_id", "contact_region", "reject_reason",
                    *[F.round(c, 5).alias(c) for c in ("score", "gap", "g_decel", "g_react", "g_approach", "g_guard", "mean_iou")])


_NMS = """ord AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {s} DESC, frame, {t}) AS rk FROM {src}),
  kept AS (SELECT {k}, 1 AS rk, [frame] AS fs, [{t}] AS ids FROM ord WHERE rk = 1
    UNION ALL SELECT {ok}, o.rk, CASE WHEN list_min([abs(x - o.frame) FOR x IN k.fs]) >= {cd} THEN list_append(k.fs, o.frame) ELSE k.fs END,
      CASE WHEN list_min([abs(x - o.frame) FOR x IN k.fs]) >= {cd} THEN list_append(k.ids, o.{t}) ELSE k.ids END
    FROM kept k JOIN ord o ON {jk} AND o.rk = k.rk + 1),
  ids AS (SELECT DISTINCT unnest(ids) AS {t} FROM (SELECT {k}, arg_max(ids, rk) AS ids FROM kept GROUP BY {k}))"""


def nms_sql(src: str, cd: int, score: str = "score", tie: str = "det_id", keys=("match_id", "round_id")) -> str:
    """Recursive whole-list NMS: every group's rows in rank order."""
    return _NMS.format(src=src, cd=cd, s=score, t=tie, k=", ".join(keys), ok=", ".join(f"o.{k}" for k in keys),
                       jk=" AND ".join(f"o.{k} = k.{k}" for k in keys))


@query("anchored_detections", ANCHORED + ", good AS (SELECT * FROM sc WHERE reject_reason IS NULL AND score >= 0.45), " + nms_sql("good", 18, tie="action_id")
       + " SELECT g.action_id, g.match_id, g.round_id, g.frame, g.striker_id, g.receiver_id, g.contact_region, round(g.score,5) AS score FROM good g SEMI JOIN ids USING (action_id)")
def _(spark, sf):
    d = D.detect(A.pose(spark, sf), A.pose_actions(spark, sf), A.pose_contacts(spark, sf), PROFILE, onsets=A.pose_onsets(spark, sf))
    return d.select("action_id", "match_id", "round_id", "frame", "striker_id", "receiver_id", "contact_region", F.round("score", 5).alias("score"))
