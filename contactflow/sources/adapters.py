"""Domain tables derived from the generic test tables.

Only stateless expressions and per-frame aggregates are used, so deriving a
table costs at most one map-side-combined shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactflow.schema import COMPACT21

# Fixed values of the derived tables.
ACTIONS = ["jab_left", "cross_right", "hook_left", "hook_right", "uppercut_left", "overhand_right"]
REGIONS = ["head", "torso", "left_arm", "right_arm", "left_leg", "right_leg"]
PROFILE = COMPACT21
N_JOINTS = 21
FPS = 25.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(names: list[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on an hourly frame axis; ten days form a round, a user is a match."""
    e = table(spark, sf_dir, "events")
    h = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")
    return e.select("event_id", F.col("user_id").alias("match_id"),
                    F.floor(h / 240).cast("int").alias("round_id"),
                    F.pmod(h, F.lit(240)).cast("int").alias("frame"),
                    "event_type", "value")


def _side(id_col: str) -> Column:
    return F.pmod(F.col(id_col), F.lit(2)).cast("int")


def actions(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir).where("event_type = 'purchase'")
    return e.select("match_id", "round_id", F.col("event_id").alias("action_id"),
                    _side("event_id").alias("fighter_id"),
                    _pick(ACTIONS, F.pmod("event_id", F.lit(6))).alias("action"),
                    F.least(F.lit(1.0), F.col("value") / 200).alias("confidence"),
                    F.col("frame").alias("action_frame"),
                    (F.col("frame") - 2).alias("window_start"),
                    (F.col("frame") + 1 + F.pmod("event_id", F.lit(4))).cast("int").alias("window_end"),
                    (F.col("value") / 10).alias("speed_kmh"), (F.col("value") * 10).alias("power_watts"))


def contacts(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir).where("event_type = 'error'")
    return e.select("match_id", "round_id", F.col("event_id").alias("contact_id"),
                    F.col("frame").alias("ce_frame"), _side("event_id").alias("striker_id"),
                    (1 - _side("event_id")).alias("receiver_id"),
                    F.least(F.lit(1.0), F.col("value") / 150).alias("contact_prob"),
                    (F.pmod("event_id", F.lit(150)) / 1000.0).alias("contact_3d_distance_m"),
                    _pick(REGIONS, F.pmod("event_id", F.lit(6))).alias("contact_region"))


def detections(spark, sf_dir) -> DataFrame:
    """Raw scored candidates."""
    e = events(spark, sf_dir).where("event_type = 'click'")
    return e.select("match_id", "round_id", F.col("event_id").alias("det_id"), "frame",
                    (F.col("value") / 500).alias("score"), _side("event_id").alias("striker_id"),
                    (1 - _side("event_id")).alias("receiver_id"),
                    _pick(REGIONS, F.pmod("event_id", F.lit(6))).alias("region"))


def truth(spark, sf_dir) -> DataFrame:
    """Distinct ground-truth frames."""
    e = events(spark, sf_dir).where("event_type = 'signup'")
    return e.select("match_id", "round_id", "frame").distinct()


def onsets(spark, sf_dir) -> DataFrame:
    """Audio onsets: strongest per frame."""
    e = events(spark, sf_dir).where("event_type = 'view'")
    return e.groupBy("match_id", "round_id", F.col("frame").alias("onset_frame")).agg(
        F.max(F.col("value") / 350).alias("strength"))


def boxes(spark, sf_dir) -> DataFrame:
    """Two box tracks per match, one row per (track, frame) seen."""
    e = events(spark, sf_dir)
    g = e.groupBy("match_id", "round_id", _side("event_id").alias("track_id"), "frame").agg(
        F.max("value").alias("x1"),
        F.max(F.pmod(F.col("event_id") * 37, F.lit(101)).cast("double")).alias("y1"))
    return g.select("match_id", "round_id", "track_id", "frame", F.struct(
        "x1", "y1", (F.col("x1") + 30 + F.pmod("frame", F.lit(40))).alias("x2"),
        (F.col("y1") + 60 + F.pmod("frame", F.lit(50))).alias("y2")).alias("bbox"))


def pose(spark, sf_dir) -> DataFrame:
    """Pose tracks: one embedding is one body, two tracks, fifty frames per round."""
    e = table(spark, sf_dir, "embeddings")
    t = F.floor(F.col("vec_id") / 2)
    v = F.col("embedding")

    def at(i: int) -> Column:
        return F.get(v, F.lit(i)).cast("double")

    joints = F.array(*[F.struct(at(3 * j).alias("x"), at(3 * j + 1).alias("y"), at(3 * j + 2).alias("z"))
                       for j in range(N_JOINTS)])
    d = e.select(F.col("vec_id"), F.floor(t / 500).cast("int").alias("match_id"),
                 F.pmod(F.floor(t / 50), F.lit(10)).cast("int").alias("round_id"),
                 F.pmod(F.col("vec_id"), F.lit(2)).cast("int").alias("track_id"),
                 F.pmod(t, F.lit(50)).cast("int").alias("frame"), "label",
                 joints.alias("joints"), at(63).alias("tail"))
    px = F.transform("joints", lambda j: F.struct((j["x"] * 400 + 960).alias("x"), (j["y"] * 400 + 540).alias("y")))
    d = d.withColumn("px", px)
    xs, ys = F.transform("px", lambda p: p["x"]), F.transform("px", lambda p: p["y"])
    return d.withColumn("bbox", F.struct(
        F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"),
        F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2")))


def pose_actions(spark, sf_dir) -> DataFrame:
    """Action windows on the pose axis: bodies labelled 0, 1 or 2 start one."""
    p = pose(spark, sf_dir).where("label < 3")
    return p.select("match_id", "round_id", F.col("vec_id").alias("action_id"),
                    F.col("track_id").alias("fighter_id"),
                    _pick(ACTIONS, F.pmod("vec_id", F.lit(6))).alias("action"),
                    F.least(F.lit(1.0), F.abs("tail") * 4).alias("confidence"),
                    F.col("frame").alias("action_frame"),
                    (F.col("frame") - 2).alias("window_start"), (F.col("frame") + 3).alias("window_end"))


def pose_onsets(spark, sf_dir) -> DataFrame:
    """Audio onsets on the pose axis: bodies labelled 6 or more sound; the strongest counts."""
    p = pose(spark, sf_dir).where("label >= 6")
    return p.groupBy("match_id", "round_id", F.col("frame").alias("onset_frame")).agg(F.max(F.least(F.lit(1.0), F.abs("tail") * 6)).alias("strength"))


def pose_contacts(spark, sf_dir) -> DataFrame:
    p = pose(spark, sf_dir).where("label between 3 and 5")
    return p.select("match_id", "round_id", F.col("frame").alias("ce_frame"),
                    F.col("track_id").alias("striker_id"), (1 - F.col("track_id")).alias("receiver_id"),
                    F.least(F.lit(1.0), F.abs("tail") * 5).alias("contact_prob"),
                    _pick(REGIONS, F.pmod("vec_id", F.lit(6))).alias("contact_region"))
