"""Fixed-length sequence datasets: extraction, padding and augmentation.

Extraction keeps long rows (clip, frame) until the end: one join per role, then
windows inside a clip, whose length is the window plus fixed padding.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactflow.functions import geometry as G
from contactflow.functions.geometry import hand_of_action
from contactflow.operators.joins import interval_join
from contactflow.schema import JointProfile

KEYS = ["match_id", "round_id"]
# Engineered feature names in storage order, after the raw joints.
ENGINEERED = ["wrist_to_torso", "wrist_to_head", "wrist_velocity", "wrist_acceleration", "head_velocity",
              "head_acceleration", "arm_extension", "hip_to_hip", "is_left_hand", "reach_ratio"]
MOTION = ("wrist_velocity", "wrist_acceleration", "head_velocity", "head_acceleration")
SCALE_FREE = ("arm_extension", "is_left_hand", "reach_ratio")
REACH_SENTINEL = 5.0


def raw_joints(profile: JointProfile) -> list[int]:
    return [*profile.head, profile.left_shoulder, profile.right_shoulder, profile.left_elbow, profile.right_elbow,
            profile.left_hip, profile.right_hip, profile.right_wrist, profile.left_wrist]


def clip_frames(clips: DataFrame, pose: DataFrame, lo: str, hi: str) -> DataFrame:
    """One row per clip frame with forward-filled striker and receiver joints (``s``, ``r``)."""
    axis = clips.withColumn("frame", F.explode(F.sequence(lo, hi)))
    p = pose.select(*KEYS, "track_id", "frame", "joints")
    s = p.select(*KEYS, F.col("track_id").alias("striker_id"), "frame", F.col("joints").alias("_s"))
    r = p.select(*KEYS, F.col("track_id").alias("receiver_id"), "frame", F.col("joints").alias("_r"))
    d = axis.join(s, [*KEYS, "striker_id", "frame"], "left").join(r, [*KEYS, "receiver_id", "frame"], "left")
    w = Window.partitionBy("clip_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("s", F.last("_s", ignorenulls=True).over(w)).withColumn("r", F.last("_r", ignorenulls=True).over(w))
    return d.drop("_s", "_r")


def sequence_rows(clips: DataFrame, pose: DataFrame, profile: JointProfile, *, lo: str, hi: str,
                  ref_start: str, ref_frames: int = 5) -> DataFrame:
    """Per clip frame: normalised raw joints (array) and the engineered features (columns)."""
    d = clip_frames(clips, pose, lo, hi)
    s, r = F.col("s"), F.col("r")
    mid = lambda arr, a, b: F.struct(*[((G.joint(arr, a)[c] + G.joint(arr, b)[c]) / 2).alias(c) for c in "xyz"])
    hips = (profile.left_hip, profile.right_hip)
    left = hand_of_action(F.col("action")) == "left"
    pick = lambda a, b: F.when(left, G.joint(s, a)).otherwise(G.joint(s, b))
    d = (d.withColumn("wrist", pick(profile.left_wrist, profile.right_wrist))
         .withColumn("elbow", pick(profile.left_elbow, profile.right_elbow))
         .withColumn("shoulder", pick(profile.left_shoulder, profile.right_shoulder))
         .withColumn("r_head", G.centroid(r, profile.head, "xyz")).withColumn("r_torso", G.centroid(r, profile.torso, "xyz"))
         .withColumn("s_hip", mid(s, *hips)).withColumn("r_hip", mid(r, *hips))
         .withColumn("_sw", G.dist(G.joint(r, profile.left_shoulder), G.joint(r, profile.right_shoulder), "xyz")))
    clip = Window.partitionBy("clip_id")
    ref = F.col("frame").between(F.col(ref_start), F.col(ref_start) + (ref_frames - 1))
    # without a reference frame there is no scale: the clip is skipped
    d = d.withColumn("ref_scale", F.avg(F.when(ref, F.col("_sw"))).over(clip)).where(F.col("ref_scale").isNotNull())
    d = d.withColumn("ref_scale", F.greatest(F.col("ref_scale"), F.lit(1e-4)))
    for c in "xyz":
        d = d.withColumn(f"_o{c}", F.avg(F.when(ref, F.col(f"r_hip.{c}"))).over(clip))
    w = clip.orderBy("frame")
    k = F.col("ref_scale")
    step = lambda name: G.dist(F.col(name), F.lag(name).over(w), "xyz") / k
    d = (d.withColumn("wrist_velocity", F.coalesce(step("wrist"), F.lit(0.0)))
         .withColumn("head_velocity", F.coalesce(step("r_head"), F.lit(0.0))))
    diff = lambda name: F.coalesce(F.col(name) - F.lag(name).over(w), F.lit(0.0))
    arm = G.dist(F.col("wrist"), F.col("elbow"), "xyz") + G.dist(F.col("elbow"), F.col("shoulder"), "xyz")
    d = (d.withColumn("wrist_acceleration", diff("wrist_velocity")).withColumn("head_acceleration", diff("head_velocity"))
         .withColumn("wrist_to_torso", G.dist(F.col("wrist"), F.col("r_torso"), "xyz") / k)
         .withColumn("wrist_to_head", G.dist(F.col("wrist"), F.col("r_head"), "xyz") / k)
         .withColumn("hip_to_hip", G.dist(F.col("s_hip"), F.col("r_hip"), "xyz") / k)
         .withColumn("_arm", arm / k).withColumn("is_left_hand", left.cast("double")))
    d = (d.withColumn("arm_extension", F.when(F.col("_arm") > 1e-4, G.dist(F.col("wrist"), F.col("shoulder"), "xyz") / k / F.col("_arm")).otherwise(0.0))
         .withColumn("reach_ratio", F.when(F.col("_arm") > 1e-4, F.col("wrist_to_torso") / F.col("_arm")).otherwise(REACH_SENTINEL)))
    norm = lambda arr: [((G.joint(arr, j)[c] - F.col(f"_o{c}")) / k) for j in raw_joints(profile) for c in "xyz"]
    return d.select("clip_id", *[c for c in clips.columns if c != "clip_id"], "frame", F.array(*norm(s), *norm(r)).alias("raw"), *ENGINEERED)


def padded(rows: DataFrame, t_max: int | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """(clip_id, t_actual, x, mask): sequences padded to the longest clip's length.

    Padding repeats the last row with its motion features zeroed. A caller may name a
    length of its own (``t_max``); only then are longer clips cut.
    """
    if t_max is None:
        longest = rows.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"))
        t_max = int(longest.first()[0] or 1)  # one number
    names = [*ENGINEERED, *extra]
    feats = F.concat("raw", F.array(*[F.col(n).cast("double") for n in names]))
    d = rows.groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct("frame", feats.alias("v")))).alias("_a"))
    n_raw = F.size(F.element_at("_a", 1)["v"]) - len(names)
    still = [i for i, n in enumerate(names) if n in MOTION]
    last = F.transform(F.element_at("_a", -1)["v"], lambda v, i: F.when(
        (i - n_raw).isin(*still), 0.0).otherwise(v))
    d = d.withColumn("t_actual", F.least(F.size("_a"), F.lit(t_max))).withColumn("_last", last)
    pad = F.array_repeat("_last", F.greatest(F.lit(0), t_max - F.size("_a")))
    x = F.concat(F.slice(F.transform("_a", lambda e: e["v"]), 1, t_max), pad)
    mask = F.concat(F.array_repeat(F.lit(1.0), F.col("t_actual")), F.array_repeat(F.lit(0.0), t_max - F.col("t_actual")))
    return d.select("clip_id", "t_actual", x.alias("x"), mask.alias("mask"))


def mirror(x: Column, profile: JointProfile, hand_index: int) -> Column:
    """Left-right flip of every row: negate x, swap paired joints, flip the hand flag."""
    ids = raw_joints(profile)
    swap = {profile.left_shoulder: profile.right_shoulder, profile.left_elbow: profile.right_elbow,
            profile.left_hip: profile.right_hip, profile.left_wrist: profile.right_wrist,
            profile.head[1]: profile.head[2], profile.head[3]: profile.head[4]}
    swap |= {b: a for a, b in swap.items()}
    order, sign = [], []
    for block in range(2):
        for j in ids:
            src = ids.index(swap.get(j, j))
            for c in range(3):
                order.append(block * 3 * len(ids) + src * 3 + c)
                sign.append(-1.0 if c == 0 else 1.0)
    n = len(order)
    o, sg = F.array(*[F.lit(i) for i in order]), F.array(*[F.lit(v) for v in sign])

    def row(v: Column) -> Column:
        raw = F.zip_with(o, sg, lambda i, k: F.get(v, i) * k)
        rest = F.transform(F.slice(v, F.lit(n + 1), F.size(v) - n), lambda e, i: F.when(i == hand_index, 1.0 - e).otherwise(e))
        return F.concat(raw, rest)
    return F.transform(x, row)


def time_warp(values: Column, length: Column, rate: Column) -> Column:
    """Linear resample of the first ``length`` values at a speed; fewer than four stay as they are."""
    real = F.slice(values, F.lit(1), length)
    n = F.greatest(F.lit(2), F.bround(length * rate).cast("int"))

    def at(i: Column) -> Column:
        pos = i * (length - 1) / (n - 1)
        lo = F.floor(pos).cast("int")
        a, b = F.get(real, lo), F.get(real, F.least(lo + 1, length - 1))
        return a + (b - a) * (pos - lo)
    return F.when(length < 4, real).otherwise(F.transform(F.sequence(F.lit(0), n - 1), at))


def scale_jitter(x: Column, factor: Column, n_raw: int, names: Sequence[str]) -> Column:
    """Multiply the scale-dependent columns by one factor per clip."""
    free = [n_raw + i for i, n in enumerate(names) if n in SCALE_FREE]
    return F.transform(x, lambda r: F.transform(r, lambda v, i: F.when(i.isin(*free), v).otherwise(v * factor)))


def augment(seqs: DataFrame, profile: JointProfile, *, seed: int, held_out: Column, p: float = 0.5,
            scale_range: tuple[float, float] = (0.95, 1.05), n_raw: int = 78) -> DataFrame:
    """Mirror and scale each training clip independently with probability p.

    Draws are hashes of (seed, clip), so retries and reruns repeat them; the
    held-out fold is passed through.
    """
    def draw(tag: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), F.col("clip_id")), F.lit(1 << 20)) / float(1 << 20)

    flip, scale = (draw(1) < p) & ~held_out, (draw(2) < p) & ~held_out
    factor = scale_range[0] + (scale_range[1] - scale_range[0]) * draw(3)
    hand = ENGINEERED.index("is_left_hand")
    d = seqs.withColumn("mirrored", flip).withColumn("scaled", scale)
    d = d.withColumn("x", F.when(F.col("mirrored"), mirror(F.col("x"), profile, hand)).otherwise(F.col("x")))
    return d.withColumn("x", F.when(F.col("scaled"), scale_jitter(F.col("x"), factor, n_raw, ENGINEERED)).otherwise(F.col("x")))


def column_std(seqs: DataFrame, training: Column) -> DataFrame:
    """Standard deviation per feature column over the training fold's real rows."""
    rows = seqs.where(training).select(F.explode(F.slice("x", F.lit(1), F.col("t_actual"))).alias("v"))
    return rows.select(F.posexplode("v").alias("col", "value")).groupBy("col").agg(F.stddev_pop("value").alias("std"))


def gaussian_jitter(value: Column, std: Column, seed: int, *ids: Column, fraction: float = 0.03) -> Column:
    """Normal noise of a fraction of the column's deviation, from hashed uniforms (Box-Muller)."""
    u = lambda tag: (F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), *ids), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    z = F.sqrt(-2.0 * F.log(u(1))) * F.cos(2 * F.pi() * u(2))
    return value + fraction * std * z
