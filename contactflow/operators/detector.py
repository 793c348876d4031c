"""The anchored contact detector: actions to gated, fused, suppressed detections."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactflow import schema as S
from contactflow.functions import scoring
from contactflow.functions.kinematics import clip01
from contactflow.operators.gates import PAIR, gates_at, hot_joints, pair_frames
from contactflow.operators.joins import best_in_band, interval_join
from contactflow.operators.suppress import greedy_nms
from contactflow.schema import JointProfile
from contactflow.session import cut_lineage

KEYS = ["match_id", "round_id"]


def contact_prior(candidates: DataFrame, contacts: DataFrame, *, frame: str, window: int = 15) -> DataFrame:
    """Most probable contact event of the same direction near each candidate."""
    # one contact per (direction, frame) is enough for an arg-max
    per_frame = (contacts.groupBy(*KEYS, "striker_id", "receiver_id", "ce_frame")
                 .agg(F.min(F.when(F.col("contact_prob").isNotNull(), F.struct((-F.col("contact_prob")).alias("np"), "contact_region"))).alias("_c"))
                 .select(*KEYS, "striker_id", "receiver_id", "ce_frame",
                         (-F.col("_c.np")).alias("contact_prob"), "_c.contact_region"))
    return best_in_band(candidates, per_frame, [*KEYS, "striker_id", "receiver_id"],
                        left_on=frame, right_on="ce_frame", lo=-window, hi=window,
                        order=[-F.col("contact_prob"), F.col("ce_frame")],
                        keep=["contact_prob", "contact_region"])


def anchor_actions(actions: DataFrame, gates: DataFrame, before: int = 3, after: int = 5) -> DataFrame:
    """The frame of smallest gap inside each padded action window (earliest on ties); frames without a gap are skipped."""
    a = actions.withColumnRenamed("fighter_id", "striker_id")
    rest = [c for c in a.columns if c not in (*KEYS, "striker_id")]
    cols = [c for c in gates.columns if c not in (*KEYS, "striker_id", "frame", "gap")]
    j = interval_join(a, gates.where(F.col("gap").isNotNull()), [*KEYS, "striker_id"], start="window_start", end="window_end",
                      before=before, after=after)
    best = j.groupBy(*KEYS, "striker_id", *rest).agg(
        F.min(F.struct("gap", "frame", *cols)).alias("b"))
    return best.select(*KEYS, "striker_id", *rest, "b.*")


def anchored_gates(pose: DataFrame, actions: DataFrame, profile: JointProfile) -> DataFrame:
    """Every action at its anchor with all gates: the gap alone chooses the anchors, the other gates are taken there only."""
    hot = cut_lineage(hot_joints(pose, profile))
    pairs = cut_lineage(pair_frames(hot))
    anchors = cut_lineage(anchor_actions(actions, pairs.select(*PAIR, "frame", "gap", "region")))
    return cut_lineage(anchors.join(gates_at(hot, pairs, anchors), [*PAIR, "frame"]))


def score_anchored(anchored: DataFrame, contacts: DataFrame, onsets: DataFrame | None = None) -> DataFrame:
    """Gate scores, hard-filter reason and fused score per anchored action."""
    c = contact_prior(anchored, contacts, frame="frame")
    has = F.col("contact_prob").isNotNull()
    region = F.coalesce("contact_region", "region")
    weight = F.when(has, scoring.region_weight(F.col("contact_region"), S.REGION_WEIGHT_UNKNOWN_EVENT)).otherwise(
        scoring.region_weight(F.col("region"), S.REGION_WEIGHT_UNKNOWN))
    c = c.withColumns({
        "g_gap": clip01(1.3 - F.col("gap")), "g_ce_prob": F.coalesce("contact_prob", F.lit(0.0)), "g_region": weight,
        "g_ext": clip01((F.col("ext") - 0.45) / 0.40), "g_speed": clip01((F.col("peak") - 0.40) / 0.60),
        "g_conf": F.least(F.lit(1.0), F.col("confidence")), "g_audio": F.lit(0.0), "contact_region": region})
    if onsets is not None:
        near = best_in_band(c, onsets, KEYS, left_on="frame",
                            right_on="onset_frame", lo=-8, hi=8,
                            order=[-F.col("strength"), F.col("onset_frame")], keep=["strength"])
        c = near.withColumn("g_audio", F.coalesce("strength", F.lit(0.0))).drop("strength")
    reason = (F.when(F.col("gap") > S.GAP_MAX, "far")
              .when(F.col("peak") < S.MIN_PEAK_SPEED, "slow")
              .when((F.col("mean_iou") >= S.IOU_REJECT) & (F.col("g_approach") < 0.55) & (F.col("ext") < 0.90), "clinch")
              .when((F.col("ext") < S.EXT_MIN) & (F.col("g_approach") < S.APPROACH_MIN), "guard"))
    fused = scoring.weighted_sum(S.WEIGHTS["anchored"]) * (1.0 - S.CLINCH_PENALTY * F.col("mean_iou"))
    return c.withColumn("reject_reason", reason).withColumn("score", fused)


def detect(pose: DataFrame, actions: DataFrame, contacts: DataFrame, profile: JointProfile, *,
           threshold: float = 0.45, cooldown: int = 18, onsets: DataFrame | None = None) -> DataFrame:
    """End to end: anchor, score, filter, suppress."""
    scored = score_anchored(anchored_gates(pose, actions, profile), contacts, onsets)
    good = scored.where(F.col("reject_reason").isNull() & (F.col("score") >= threshold))
    return greedy_nms(good, KEYS, "frame", "score", cooldown, tie="action_id")
