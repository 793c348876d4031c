"""Evaluation beyond matching: relabelling, folds, coverage, verdicts."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactflow.functions import geometry as G
from contactflow.operators.joins import best_in_band, pairs_same_frame
from contactflow.operators.ordering import blocked
from contactflow.operators.ranking import ranked
from contactflow.schema import WEIGHTS

KEYS = ["match_id", "round_id"]


def relabel_signals(boxes: DataFrame, onsets: DataFrame, audio_radius: int = 4) -> DataFrame:
    """Best relabel score per frame over both strikers: distance, audio, head displacement."""
    tk = [*KEYS, "track_id"]
    b = blocked(boxes, tk, "frame", 1, 1)
    head = G.box_head(F.col("bbox"))
    d = b.df.withColumn("_h", head)
    d = b.core(d.withColumn("_a", b.at(F.col("_h"), -1)).withColumn("_b", b.at(F.col("_h"), 1)))
    d = d.select(*tk, "frame", "bbox", F.coalesce(G.dist(F.col("_a"), F.col("_b")), F.lit(0.0)).alias("react"))
    p = pairs_same_frame(d)
    none = F.array(F.lit(None).cast("struct<x:double,y:double>"))
    fist = G.fist_position(none, F.col("s.bbox"), F.col("r.bbox"))
    p = p.select(*KEYS, "frame", F.col("s.track_id").alias("striker_id"), F.col("r.react").alias("react"),
                 G.dist(fist, G.box_head(F.col("r.bbox"))).alias("dist"))
    axis = (p.select(*KEYS, "frame").distinct().withColumn("strength", F.lit(None).cast("double"))
            .unionByName(onsets.select(*KEYS, F.col("onset_frame").alias("frame"), "strength"))
            .groupBy(*KEYS, "frame").agg(F.max("strength").alias("strength")))
    a = blocked(axis, KEYS, "frame", audio_radius, audio_radius)
    aud = a.core(a.df.withColumn("audio", F.max("strength").over(a.span(-audio_radius, audio_radius))))
    p = p.join(aud.select(*KEYS, "frame", "audio"), [*KEYS, "frame"])
    w = WEIGHTS["relabel"]
    score = (w["dist"] * F.greatest(F.lit(0.0), 1 - F.col("dist") / 500.0) + w["audio"] * F.coalesce("audio", F.lit(0.0))
             + w["react"] * F.least(F.lit(1.0), F.col("react") / 50.0))
    best = p.withColumn("score", score).where(F.col("score").isNotNull()).groupBy(*KEYS, "frame").agg(
        F.min(F.struct((-F.col("score")).alias("ns"), "striker_id")).alias("b"))
    return best.select(*KEYS, F.col("frame").alias("best_frame"), (-F.col("b.ns")).alias("score"), "b.striker_id")


def relabel(truth: DataFrame, signals: DataFrame, radius: int = 60) -> DataFrame:
    """Move each ground-truth frame to the strongest signal within the radius (earliest on ties)."""
    return best_in_band(truth, signals, KEYS, left_on="frame", right_on="best_frame", lo=-radius, hi=radius,
                        order=[-F.col("score"), F.col("best_frame")], keep=["best_frame", "striker_id", "score"])


def stratified_folds(df: DataFrame, label: str, id_col: str, k: int, out: str = "fold") -> DataFrame:
    """Round-robin over a hash order within each class: reproducible and balanced."""
    h = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("double")
    r = ranked(df.withColumn("_h", h), [label], "_h", tie=[id_col])
    return r.withColumn(out, F.pmod(F.col("rank_first") - 1, F.lit(k)).cast("int")).drop(
        "_h", "rank_first", "rank_min", "rank_avg", "n")


def confusion(df: DataFrame, keys: Sequence[str], label: str, score: str, threshold: float) -> DataFrame:
    y, p = F.col(label) == 1, F.col(score) >= threshold
    return df.groupBy(*keys).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                                 F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))


def combo_verdict(combo: Column, best: Column, margin: float = 0.01) -> Column:
    return (F.when(combo > best + margin, "HELPS").when(F.abs(combo - best) <= margin, "NEUTRAL").otherwise("HURTS"))
