"""Evidence around candidates: actions, contact events and audio onsets nearby."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactflow.functions import geometry as G
from contactflow.operators.ordering import blocked

KEYS = ["match_id", "round_id"]


def evidence_features(cands: DataFrame, actions: DataFrame, contacts: DataFrame, onsets: DataFrame, *,
                      action_window: int = 5, contact_window: int = 8, audio_window: int = 10) -> DataFrame:
    """Adds conf, ce, ce_ht and audio to candidates with (frame, striker_id).

    All sources are first reduced to one row per (recording, frame), so the
    range windows never see more rows than frames; the windows share one shuffle.
    """
    def per_side(side: str, value, name: str):
        return [F.max(F.when(F.col(side) == i, value)).alias(f"{name}_{i}") for i in (0, 1)]

    a = actions.groupBy(*KEYS, F.col("action_frame").alias("frame")).agg(
        *per_side("fighter_id", F.col("confidence"), "conf"))
    ht = F.when(F.col("contact_region").isin("head", "torso"), F.col("contact_prob"))
    c = contacts.groupBy(*KEYS, F.col("ce_frame").alias("frame")).agg(
        *per_side("striker_id", F.col("contact_prob"), "ce"), *per_side("striker_id", ht, "ht"))
    o = onsets.select(*KEYS, F.col("onset_frame").alias("frame"), "strength")
    spots = cands.select(*KEYS, "frame").distinct()
    rows = (spots.unionByName(a, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
            .unionByName(o, allowMissingColumns=True))
    names = ["conf_0", "conf_1", "ce_0", "ce_1", "ht_0", "ht_1", "strength"]
    axis = rows.groupBy(*KEYS, "frame").agg(*[F.max(n).alias(n) for n in names])
    k = max(action_window, contact_window, audio_window)
    b = blocked(axis, KEYS, "frame", k, k)
    d = b.df
    for n in names:
        w = {"c": action_window}.get(n[0]) if n.startswith("conf") else audio_window if n == "strength" else contact_window
        d = d.withColumn(f"w_{n}", F.max(n).over(b.span(-w, w)))
    d = b.core(d).select(*KEYS, "frame", *[f"w_{n}" for n in names])
    out = cands.join(d, [*KEYS, "frame"])
    side = lambda n: F.coalesce(F.when(F.col("striker_id") == 0, F.col(f"w_{n}_0")).otherwise(F.col(f"w_{n}_1")), F.lit(0.0))
    return (out.withColumn("conf", side("conf")).withColumn("ce", side("ce")).withColumn("ce_ht", side("ht"))
            .withColumn("audio", F.coalesce("w_strength", F.lit(0.0))).drop(*[f"w_{n}" for n in names]))


#: Frames before and after over which a striker's speed change and a head's acceleration are taken.
DECEL_STEP, HEAD_STEP = 3, 4


def box_motion(boxes: DataFrame) -> DataFrame:
    """(keys, track_id, frame, decel, head_acc): speed lost by a box's centre, and acceleration of its head point, in pixels.

    Zero where a box is missing on either side. Boxes carry no wrists, so the centre stands for the striking body."""
    b = blocked(boxes, [*KEYS, "track_id"], "frame", HEAD_STEP, HEAD_STEP)
    d = b.df.withColumn("_c", G.box_center(F.col("bbox"))).withColumn("_h", F.struct(((F.col("bbox.x1") + F.col("bbox.x2")) / 2).alias("x"), (F.col("bbox.y1") + 0.18 * (F.col("bbox.y2") - F.col("bbox.y1"))).alias("y")))
    for n, c, k in (("_c0", "_c", -DECEL_STEP), ("_c1", "_c", DECEL_STEP), ("_h0", "_h", -HEAD_STEP), ("_h1", "_h", HEAD_STEP)):
        d = d.withColumn(n, b.at(F.col(c), k))
    speed = lambda p, q: G.dist(F.col(p), F.col(q)) / DECEL_STEP
    decel = F.greatest(F.lit(0.0), speed("_c", "_c0") - speed("_c1", "_c"))
    turn = [(F.col(f"_h1.{a}") - F.col(f"_h.{a}")) / HEAD_STEP - (F.col(f"_h.{a}") - F.col(f"_h0.{a}")) / HEAD_STEP for a in "xy"]
    both = lambda p, q, v: F.when(F.col(p).isNotNull() & F.col(q).isNotNull(), v).otherwise(0.0)
    d = d.withColumn("decel", both("_c0", "_c1", decel)).withColumn("head_acc", both("_h0", "_h1", F.sqrt(turn[0] * turn[0] + turn[1] * turn[1])))
    return b.core(d).select(*KEYS, "track_id", "frame", "decel", "head_acc")


def with_motion(cands: DataFrame, boxes: DataFrame) -> DataFrame:
    """Adds decel of the striker's box and head_acc of the receiver's; zero without a box."""
    m = box_motion(boxes)
    one = lambda side, c: m.select(*KEYS, F.col("track_id").alias(side), "frame", c)
    d = cands.join(one("striker_id", "decel"), [*KEYS, "striker_id", "frame"], "left").join(one("receiver_id", "head_acc"), [*KEYS, "receiver_id", "frame"], "left")
    return d.na.fill(0.0, ["decel", "head_acc"])
