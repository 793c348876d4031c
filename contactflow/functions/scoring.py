"""Fusion expressions: weighted sums, votes, gates, region weights, time codes."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactflow.schema import REGION_WEIGHT


def weighted_sum(weights: Mapping[str, float], cols: Mapping[str, Column] | None = None,
                 prefix: str = "g_") -> Column:
    total = None
    for name, w in weights.items():
        term = F.lit(w) * (cols[name] if cols else F.col(prefix + name))
        total = term if total is None else total + term
    return total


def votes(signals: Sequence[Column]) -> Column:
    total = None
    for s in signals:
        v = F.coalesce(s, F.lit(False)).cast("int")
        total = v if total is None else total + v
    return total


def region_weight(region: Column, unknown: float) -> Column:
    w = F.lit(unknown)
    for name, v in REGION_WEIGHT.items():
        w = F.when(region == name, F.lit(v)).otherwise(w)
    return w


def action_confidence(conf: Column, watts: Column, kmh: Column) -> Column:
    one = F.lit(1.0)
    return (0.50 * F.least(one, conf) + 0.25 * F.least(one, watts / 3000.0)
            + 0.25 * F.least(one, kmh / 25.0))


def evidence_mode(mode: str, audio: Column, ce: Column, dist: Column) -> Column:
    """Which evidence a candidate needs: the named combination of three signals."""
    rules = {
        "any": audio | ce | dist, "audio_only": audio, "ce_only": ce, "dist_only": dist,
        "audio_or_ce": audio | ce, "audio_and_dist": audio & dist, "ce_or_dist": ce | dist,
    }
    return rules[mode]


def timecode_seconds(text: Column, fps: float) -> Column:
    """``S:F`` or ``M:S:F`` to seconds."""
    p = F.split(text, ":")
    a, b, c = (F.get(p, F.lit(i)).cast("double") for i in range(3))
    return F.when(F.size(p) == 2, a + b / fps).when(F.size(p) == 3, a * 60 + b + c / fps)


def timecode_frame(text: Column, fps: float, mode: str = "round") -> Column:
    s = timecode_seconds(text, fps) * fps
    return {"round": F.bround(s), "floor": F.floor(s)}[mode].cast("int")


def frame_timecode(frame: Column, fps: float) -> Column:
    """Frame to ``M:SS:FF``."""
    t = frame / fps
    m = F.floor(t / 60)
    s = t - m * 60
    return F.format_string("%d:%02d:%02d", m.cast("int"), F.floor(s).cast("int"),
                           F.bround((s - F.floor(s)) * fps).cast("int"))
