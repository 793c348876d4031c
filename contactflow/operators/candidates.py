"""Candidate generation."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactflow.operators.ordering import BLOCK, forward_fill, two_level_scan

KEYS = ["match_id", "round_id"]


def union_candidates(actions: DataFrame, contacts: DataFrame, onsets: DataFrame, tracks: DataFrame,
                     every: int = 5) -> DataFrame:
    """Distinct (frame, striker): actions, contacts, onsets for both sides, dense frames with two tracks."""
    both = F.explode(F.array(F.lit(0), F.lit(1))).alias("striker_id")
    dense = (tracks.where(F.pmod("frame", F.lit(every)) == 0).groupBy(*KEYS, "frame")
             .agg(F.count(F.lit(1)).alias("n")).where("n >= 2"))
    parts = [
        actions.select(*KEYS, F.col("action_frame").alias("frame"), F.col("fighter_id").alias("striker_id")),
        contacts.select(*KEYS, F.col("ce_frame").alias("frame"), "striker_id"),
        onsets.select(*KEYS, F.col("onset_frame").alias("frame"), both),
        dense.select(*KEYS, "frame", both),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def window_grid(actions: DataFrame, *, stride: int, pad: int, ratio: float = 1.0, margin: int = 0,
                last_frame: Column | None = None) -> DataFrame:
    """Frames of each window at a stride, after an fps rescale and padding, clamped to the recording."""
    lo = F.greatest(F.lit(margin), F.bround(F.col("window_start") * ratio).cast("int") - pad)
    hi = F.bround(F.col("window_end") * ratio).cast("int") + pad
    if last_frame is not None:
        hi = F.least(last_frame - margin, hi)
    d = actions.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi")
    return d.withColumn("frame", F.explode(F.sequence("_lo", "_hi", F.lit(stride)))).drop("_lo", "_hi")


def window_groups(windows: DataFrame, keys: list[str], gap: int, size: int = BLOCK) -> DataFrame:
    """Windows with ``group_start``, the start of the merged window they belong to.

    A window joins when it starts within ``gap`` frames of the running end. The
    running end is a running maximum in start order: computed per block and
    carried over blocks. The members in order spell the merged window's name.
    """
    # windows with one start act as one for the running end
    starts = windows.groupBy(*keys, "window_start").agg(F.max("window_end").alias("end"))
    d = two_level_scan(
        starts, keys, "window_start", size=size,
        local={"_l": lambda w: F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))},
        summary={"_s": F.max("end")},
        carry={"_c": lambda w: F.max("_s").over(w)})
    reach = F.greatest("_l", "_c")
    d = d.withColumn("_open", F.when(reach.isNull() | (F.col("window_start") - reach > gap), F.col("window_start")))
    d = forward_fill(d.select(*keys, "window_start", "_open"), keys, "window_start", "_open", "group_start", size=size)
    return windows.join(d.select(*keys, "window_start", "group_start"), [*keys, "window_start"])


def merge_windows(windows: DataFrame, keys: list[str], gap: int, size: int = BLOCK, order: list[str] | None = None) -> DataFrame:
    """Merged windows: end, highest confidence, member count and the members' action names in order (of window_start, or ``order``)."""
    order = order or ["window_start", "action"]
    return window_groups(windows, keys, gap, size).groupBy(*keys, "group_start").agg(
        F.max("window_end").alias("window_end"), F.max("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("n_windows"),
        F.sort_array(F.collect_list(F.struct(*order, F.col("action").alias("_name")))).alias("_m"),
    ).select(*keys, F.col("group_start").alias("window_start"), "window_end", "confidence", "n_windows",
             F.array_join(F.transform("_m", lambda m: m["_name"]), "+").alias("actions"))


def clip_bounds(start: Column, end: Column, fps: float, pre: float = 0.4, post: float = 0.7,
                min_duration: float = 1.4) -> tuple[Column, Column]:
    """(start seconds, duration): padded, short clips re-centred to the minimum."""
    s = F.greatest(F.lit(0.0), start / fps - pre)
    e = end / fps + post
    short = (e - s) < min_duration
    s2 = F.greatest(F.lit(0.0), (s + e) / 2 - min_duration / 2)
    return F.when(short, s2).otherwise(s), F.when(short, F.lit(min_duration)).otherwise(e - s)


def clip_name(round_id: Column, fighter: Column, idx: Column, action: Column, ws: Column, we: Column) -> Column:
    return F.format_string("R%d_f%d_%03d_%s_f%04d_f%04d", round_id, fighter, idx, action, ws, we)


def onset_supported(cands: DataFrame) -> DataFrame:
    """Onset-only candidates need support beyond audio."""
    return cands.where("dist > 0.5 or ce > 0.2 or audio > 0.5 or head_acc > 0.4")
