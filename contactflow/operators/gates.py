"""Per-frame kinematic gates over pose tracks and directed pairs.

Track-level and pair-level windows share one blocked shuffle each, however many
gates are asked for.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactflow.functions import geometry as G
from contactflow.functions import kinematics as K
from contactflow.operators.joins import pairs_same_frame
from contactflow.operators.ordering import blocked
from contactflow.schema import JointProfile

TRACK = ["match_id", "round_id", "track_id"]
PAIR = ["match_id", "round_id", "striker_id", "receiver_id"]


def _traj(p: str) -> Column:
    return F.struct("frame", F.col(f"{p}.x").alias("x"), F.col(f"{p}.y").alias("y"), F.col(f"{p}.z").alias("z"))


def hot_joints(pose: DataFrame, profile: JointProfile) -> DataFrame:
    """Narrow track rows: only the joints the gates use, as struct columns."""
    j = F.col("joints")
    return pose.select(
        *TRACK, "frame", "bbox",
        *[G.joint(j, i).alias(n) for n, i in (
            ("lw", profile.left_wrist), ("rw", profile.right_wrist), ("le", profile.left_elbow),
            ("re", profile.right_elbow), ("ls", profile.left_shoulder), ("rs", profile.right_shoulder),
            ("lh", profile.left_hip), ("rh", profile.right_hip))],
        G.centroid(j, profile.head, "xyz").alias("head"), G.shoulder_width(j, profile).alias("sw"),
        G.joints_of(j, profile.head).alias("head_pts"), G.joints_of(j, profile.torso).alias("torso_pts"))


def extension(w: Column, e: Column, s: Column, dims: str = "xy") -> Column:
    """Wrist-shoulder distance over arm length; NULL for a degenerate arm."""
    chain = G.dist(s, e, dims) + G.dist(e, w, dims)
    return F.when(chain > 1e-6, G.dist(w, s, dims) / chain)


def track_gates(hot: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """decel, peak speed, arm extension and head reaction of every (track, frame), or of the tracks and frames in ``at``."""
    b = blocked(hot, TRACK, "frame", before=6, after=6)
    ext = F.greatest(F.coalesce(extension(F.col("lw"), F.col("le"), F.col("ls")), F.lit(0.0)),
                     F.coalesce(extension(F.col("rw"), F.col("re"), F.col("rs")), F.lit(0.0)))
    row = F.struct("frame", "lw", "rw", "sw")
    d = (b.df.withColumn("_e", ext)
         .withColumn("_w5", F.collect_list(row).over(b.span(-5, 5)))
         .withColumn("_w6", F.collect_list(row).over(b.span(-6, 6)))
         .withColumn("ext", F.max("_e").over(b.span(-1, 1)))
         .withColumn("_hb", b.at(F.col("head"), -4)).withColumn("_hf", b.at(F.col("head"), 4)))
    d = b.core(d)
    if at is not None:
        d = d.join(at, [*TRACK, "frame"], "left_semi")

    def wrist(arr: str, name: str) -> Column:
        return F.transform(F.col(arr), lambda p: F.struct(
            p["frame"].alias("frame"), p[name]["x"].alias("x"), p[name]["y"].alias("y")))

    mean_sw = G.mean_of(F.transform("_w6", lambda p: p["sw"]))
    acc = G.norm([F.col(f"_hf.{c}") - 2 * F.col(f"head.{c}") + F.col(f"_hb.{c}") for c in "xy"]) / F.col("sw")
    return d.select(
        *TRACK, "frame",
        F.greatest(*[K.decel_score(wrist("_w5", n), "xy", 4, per_frame=False) for n in ("lw", "rw")]).alias("g_decel"),
        (F.greatest(*[K.peak_speed(wrist("_w6", n), "xy", 3) for n in ("lw", "rw")]) / mean_sw).alias("peak"),
        "ext", F.coalesce(K.cap1(acc / 1.5), F.lit(0.0)).alias("g_react"))


def pair_frames(hot: DataFrame) -> DataFrame:
    """Directed pairs per frame with gap, region, head gap, overlap and guard distance."""
    p = pairs_same_frame(hot)
    wrists = F.array("s.lw", "s.rw")
    # own columns, so the nested minima are evaluated once
    p = (p.withColumn("_hd", G.min_dist(wrists, F.col("r.head_pts")))
         .withColumn("_td", G.min_dist(wrists, F.col("r.torso_pts"))))
    head_d, torso_d = F.col("_hd"), F.col("_td")
    dl, dr = G.dist(F.col("s.lw"), F.col("r.head")), G.dist(F.col("s.rw"), F.col("r.head"))
    right = (dr < dl) | (dl.isNull() & dr.isNotNull())  # a missing wrist is never the punching one
    punch = F.when(right, F.col("s.rw")).otherwise(F.col("s.lw"))
    p = p.withColumn("_punch", punch)
    guard = F.least(*[G.segment_distance(F.col(f"r.{g}"), F.col("_punch"), F.col("r.head"))
                      for g in ("le", "re", "rw", "lw")])
    sw = F.col("r.sw")
    return p.select(
        "match_id", "round_id", F.col("s.track_id").alias("striker_id"), F.col("r.track_id").alias("receiver_id"),
        "frame", (F.least(head_d, torso_d) / sw).alias("gap"),
        F.when((head_d <= torso_d) | (head_d.isNotNull() & torso_d.isNull()), "head").when(torso_d.isNotNull(), "torso").alias("region"),
        (head_d / sw).alias("head_gap"), G.box_iou(F.col("s.bbox"), F.col("r.bbox")).alias("iou"),
        (guard / sw).alias("guard_d"))


def pair_gates(pairs: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """Adds approach share, guard openness and mean overlap to every pair frame, or to the pairs and frames in ``at``."""
    b = blocked(pairs, PAIR, "frame", before=8, after=2)
    d = (b.df.withColumn("_g", F.collect_list(F.struct("frame", "head_gap")).over(b.span(-8, 0)))
         .withColumn("_d", F.min("guard_d").over(b.span(-3, 0)))
         .withColumn("iou2", F.avg("iou").over(b.span(-2, 2))))
    d = b.core(d)
    if at is not None:
        d = d.join(at, [*PAIR, "frame"], "left_semi")
    return d.select(
        *PAIR, "frame", "gap", "region", "iou", F.col("iou2").alias("mean_iou"),
        K.falling_share(F.col("_g"), "head_gap", 4).alias("g_approach"),
        F.coalesce(K.clip01((F.col("_d") - 0.30) / 1.20), F.lit(0.5)).alias("g_guard"))


#: Frames before and after a frame that its gates look at.
REACH = 8


def gates_at(hot: DataFrame, pairs: DataFrame, anchors: DataFrame) -> DataFrame:
    """All gates of the anchors (match, round, striker, receiver, frame): windows see the frames around anchors only, scores are taken at anchors only."""
    anchors = anchors.select(*PAIR, "frame").distinct()
    near = anchors.select("match_id", "round_id", F.explode(F.sequence(F.col("frame") - REACH, F.col("frame") + REACH)).alias("frame")).distinct()
    axis = ["match_id", "round_id", "frame"]
    sides = [anchors.select("match_id", "round_id", F.col(c).alias("track_id"), "frame") for c in ("striker_id", "receiver_id")]
    tg = track_gates(hot.join(near, axis, "left_semi"), sides[0].unionByName(sides[1]).distinct())
    s = tg.select("match_id", "round_id", F.col("track_id").alias("striker_id"), "frame", "g_decel", "peak", "ext")
    r = tg.select("match_id", "round_id", F.col("track_id").alias("receiver_id"), "frame", "g_react")
    return (pair_gates(pairs.join(near, axis, "left_semi"), anchors).drop("gap", "region")
            .join(s, ["match_id", "round_id", "striker_id", "frame"])
            .join(r, ["match_id", "round_id", "receiver_id", "frame"]))


def full_gates(pose: DataFrame, profile: JointProfile) -> DataFrame:
    """Every pair frame with all gates of striker, receiver and pair."""
    hot = hot_joints(pose, profile)
    tg = track_gates(hot)
    s = tg.select("match_id", "round_id", F.col("track_id").alias("striker_id"), "frame", "g_decel", "peak", "ext")
    r = tg.select("match_id", "round_id", F.col("track_id").alias("receiver_id"), "frame", "g_react")
    return (pair_gates(pair_frames(hot))
            .join(s, ["match_id", "round_id", "striker_id", "frame"])
            .join(r, ["match_id", "round_id", "receiver_id", "frame"]))
