"""Further gates: pixel variants, box reactions, flow, depth, landmark and live scores."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactflow.functions import geometry as G
from contactflow.functions import kinematics as K
from contactflow.functions.scoring import weighted_sum
from contactflow.operators.ordering import Blocked, blocked
from contactflow.schema import WEIGHTS, JointProfile

TRACK = ["match_id", "round_id", "track_id"]


def arm_contact_ratio(striker: Column, receiver: Column, profile: JointProfile) -> Column:
    """Distance to the guard over distance to the body, for the wrist nearest the body."""
    arm, body = G.joints_of(receiver, profile.guard), G.joints_of(receiver, (*profile.head, *profile.torso))

    def one(i: int) -> Column:
        w = F.array(G.joint(striker, i))
        d_arm = F.coalesce(G.min_dist(w, arm), F.lit(9999.0))
        d_body = F.coalesce(G.min_dist(w, body), F.lit(9999.0))
        return F.when(G.joint(striker, i).isNotNull(), F.struct(
            d_body.alias("body"), F.lit(profile.wrists.index(i)).alias("order"), (d_arm / (d_body + 1e-3)).alias("ratio")))

    best = F.array_min(F.filter(F.array(*[one(i) for i in profile.wrists]), lambda c: c.isNotNull()))
    return F.coalesce(best["ratio"], F.lit(1.0))


def head_steps(b: Blocked) -> DataFrame:
    """Adds the head-point step to the previous frame (exact frame), raw and over box height.

    Works inside the given blocks, whose halo must hold one more frame than the
    windows that follow; so steps and windows share one shuffle.
    """
    box = F.col("bbox")
    d = b.df.withColumn("_h", G.box_head(box)).withColumn("_t", G.point((box["x1"] + box["x2"]) / 2, box["y1"]))
    d = d.withColumn("_ph", b.at(F.col("_h"), -1)).withColumn("_pt", b.at(F.col("_t"), -1))
    return d.withColumn("head_step", G.dist(F.col("_h"), F.col("_ph"))).withColumn(
        "snap", G.dist(F.col("_t"), F.col("_pt")) / F.greatest(F.lit(1.0), box["y2"] - box["y1"])).drop("_h", "_t", "_ph", "_pt")


def box_snap(boxes: DataFrame, after: int = 8) -> DataFrame:
    """Peak head-level speed after a frame relative to the speed just before it."""
    b = blocked(boxes, TRACK, "frame", before=3, after=after)
    base = F.coalesce(F.avg("snap").over(b.span(-2, 0)), F.lit(0.02))
    peak = F.coalesce(F.max("snap").over(b.span(1, after)), F.lit(0.0))
    d = head_steps(b).withColumn("_r", peak / F.greatest(base, F.lit(0.005)))
    return b.core(d.withColumn("g_bbox_react", K.clip01((F.col("_r") - 1.0) / 4.0))).drop("_r", "snap", "head_step")


def receiver_motion(boxes: DataFrame) -> DataFrame:
    """Mean head step before and after a frame, their change, and head acceleration.

    A window of positions a..b contributes the steps a+1..b, both ends inside it.
    """
    b = blocked(boxes, TRACK, "frame", before=6, after=7)
    mean = lambda lo, hi: F.coalesce(F.avg("head_step").over(b.span(lo, hi)), F.lit(0.0))
    d = (head_steps(b).withColumn("motion_pre", mean(-5, 0)).withColumn("motion_post", mean(2, 7))
         .withColumn("_vb", mean(-4, -2)).withColumn("_va", mean(3, 5)))
    d = b.core(d)
    return d.select(*TRACK, "frame", "motion_pre", "motion_post",
                    (F.col("motion_post") - F.col("motion_pre")).alias("motion_delta"),
                    (F.col("_va") - F.col("_vb")).alias("head_accel"))


def velocity_change(boxes: DataFrame, span: int = 5) -> DataFrame:
    """Sum of head velocity changes over consecutive triples inside the window."""
    b = blocked(boxes, TRACK, "frame", before=span, after=span)
    d = b.df.withColumn("_h", G.box_head(F.col("bbox")))
    d = d.withColumn("_a", b.at(F.col("_h"), -1)).withColumn("_z", b.at(F.col("_h"), 1))
    d = d.withColumn("_c", G.norm([F.col(f"_z.{c}") - 2 * F.col(f"_h.{c}") + F.col(f"_a.{c}") for c in "xy"]))
    d = d.withColumn("vel_change", F.coalesce(F.sum("_c").over(b.span(-span + 1, span - 1)), F.lit(0.0)))
    return b.core(d).select(*TRACK, "frame", "vel_change")


def box_change(boxes: DataFrame, k: int = 5) -> DataFrame:
    """Centre displacement and relative area change between frame-k and frame+k."""
    b = blocked(boxes, TRACK, "frame", before=k, after=k)
    d = b.df.withColumn("_p", b.at(F.col("bbox"), -k)).withColumn("_n", b.at(F.col("bbox"), k))
    d = b.core(d)
    p, n = F.col("_p"), F.col("_n")
    return d.select(*TRACK, "frame",
                    F.coalesce(G.dist(G.box_center(n), G.box_center(p)), F.lit(0.0)).alias("pos_change"),
                    F.coalesce(F.abs(G.box_area(n) - G.box_area(p)) / F.greatest(F.lit(1.0), G.box_area(p)), F.lit(0.0))
                    .alias("area_change"))


def flow_ratio(flow: DataFrame, value: str, impact=(-4, 0), baseline=(-30, -10)) -> DataFrame:
    """Mean flow just before a frame over the mean of an earlier baseline window."""
    b = blocked(flow, TRACK, "frame", before=-baseline[0], after=0)
    near = F.coalesce(F.avg(value).over(b.span(impact[0], impact[1] - 1)), F.lit(0.0))
    base = F.coalesce(F.avg(value).over(b.span(baseline[0], baseline[1] - 1)), F.lit(0.0))
    return b.core(b.df.withColumn("flow_ratio", near / (base + 1e-4))).select(*TRACK, "frame", "flow_ratio")


def flow_windows(flow: DataFrame, value: str, ahead: int = 5, back: int = 4) -> DataFrame:
    """Largest flow after a frame (receiver role) and up to it (striker role)."""
    b = blocked(flow, TRACK, "frame", before=back, after=ahead)
    d = (b.df.withColumn("flow_ahead", F.max(value).over(b.span(0, ahead)))
         .withColumn("flow_back", F.max(value).over(b.span(-back, 0))))
    return b.core(d).select(*TRACK, "frame", "flow_ahead", "flow_back")


def top_landmark_contact(prob: Column, visibility: Column, k: int = 8) -> Column:
    """Mean of the k largest visibility-weighted contact probabilities."""
    w = F.zip_with(prob, visibility, lambda p, v: p * v)
    return F.coalesce(G.mean_of(F.slice(F.sort_array(w, asc=False), 1, k)), F.lit(0.0))


def depth_gate(delta: Column) -> Column:
    return F.exp(-(delta * delta) / 2.0)


def live_contact(pairs: DataFrame, profile: JointProfile, *, reach: float, min_extension: float,
                 min_velocity: float, proximity: float, full_velocity: float) -> DataFrame:
    """Four-part contact score of the best (wrist, target joint) of each pair frame.

    Expects ``s``/``r`` structs with ``px`` joints and ``v`` per-joint net
    velocity (wrist minus body drift) on the striker.
    """
    def arm(side: str, order: int) -> Column:
        w, e, sh = (G.joint(F.col("s.px"), i) for i in profile.arm(side))
        length = G.dist(w, e) + G.dist(e, sh)
        return F.struct(w.alias("w"), (G.dist(w, sh) / F.when(length >= 1e-3, length)).alias("ext"),
                        F.col(f"s.v_{side}").alias("v"), F.lit(side).alias("side"), F.lit(order).alias("order"))

    def target(i: int, region: str, order: int) -> Column:
        return F.struct(G.joint(F.col("r.px"), i).alias("p"), F.lit(region).alias("region"), F.lit(order).alias("order"))

    groups = [(i, "head") for i in profile.head] + [(i, "torso") for i in profile.torso]

    def score(a: Column, t: Column) -> Column:
        def with_distance(d: Column) -> Column:
            toward = (a["v"]["x"] * (t["p"]["x"] - a["w"]["x"]) + a["v"]["y"] * (t["p"]["y"] - a["w"]["y"])) / d
            return K.let(toward, lambda dv: F.when((a["ext"] >= min_extension) & (dv >= min_velocity), F.struct(
                weighted_sum(WEIGHTS["live"], {
                    "proximity": F.greatest(F.lit(0.0), 1.0 - d / proximity),
                    "directed_velocity": F.least(F.lit(1.0), dv / full_velocity),
                    "extension": F.least(F.lit(1.0), (a["ext"] - min_extension) / (1.0 - min_extension)),
                    "confidence": F.lit(1.0)}).alias("prob"),
                (-a["order"] * 100 - t["order"]).alias("order"), t["region"].alias("region"),
                dv.alias("velocity"), a["side"].alias("side"))))
        return K.let(G.dist(t["p"], a["w"]), lambda d: K.let(F.when(d >= 1e-3, d), with_distance))

    pairs = (pairs.withColumn("_arms", F.array(arm("left", 0), arm("right", 1)))
             .withColumn("_targets", F.array(*[target(i, r, m) for m, (i, r) in enumerate(groups)])))
    in_reach = None
    for i in profile.wrists:
        hit = G.in_box(G.joint(F.col("s.px"), i), F.col("r.bbox"), reach)
        in_reach = hit if in_reach is None else in_reach | hit
    all_scores = F.flatten(F.transform("_arms", lambda a: F.transform("_targets", lambda t: score(a, t))))
    return (pairs.where(in_reach).withColumn("contact", F.array_max(all_scores))
            .where("contact is not null").drop("_arms", "_targets"))
