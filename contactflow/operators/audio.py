"""Audio features: short-time spectra, flux, noise-floor ratios, peak picking.

Recordings arrive as fixed-size sample blocks (recording_id, block_no, samples).
A block borrows its successor's head, so every analysis window is computed in
exactly one task and no recording is assembled.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactflow.functions.geometry import mean_of
from contactflow.operators.ordering import BLOCK, block_of, blocked
from contactflow.operators.ranking import exact_quantiles
from contactflow.operators.suppress import first_fit, greedy_nms
from contactflow.session import cut_lineage

REC = ["recording_id"]
# Band limits in Hz, noise-floor weights, smoothing kernel.
BANDS = {"low": (60, 400), "mid": (400, 2000), "high": (2000, 8000)}
RATIO_WEIGHTS = {"low": 0.30, "mid": 0.20, "high": 0.35, "rms": 0.15}
TRIANGLE = (0.25, 0.50, 0.25)


def spectra(blocks: DataFrame, block_len: int, win: int, hop: int, pre_emphasis: float = 0.0) -> DataFrame:
    """(recording_id, hop_idx, mags, rms) for every full window; hop must divide the block length."""
    if block_len % hop or win > block_len:
        raise ValueError("hop must divide the block length and a window must fit a block")
    b = blocked(blocks, REC, "block_no", 1 if pre_emphasis else 0, 1)
    d = b.df.withColumn("_next", b.at(F.col("samples"), 1))
    d = d.withColumn("_prev", b.at(F.element_at("samples", -1), -1) if pre_emphasis else F.lit(None).cast("double"))
    d = b.core(d)

    @F.pandas_udf("array<struct<h:int,mags:array<double>,rms:double>>")
    def windows(cur: pd.Series, nxt: pd.Series, prev: pd.Series) -> pd.Series:
        hann = np.hanning(win)
        out = []
        for c, n, p in zip(cur, nxt, prev):
            x = np.asarray(c, dtype=float) if n is None else np.concatenate([c, n]).astype(float)
            if pre_emphasis:
                shifted = np.concatenate([[0.0 if p is None or np.isnan(p) else p], x[:-1]])
                x = x - pre_emphasis * shifted
            rows = []
            for h in range(block_len // hop):
                seg = x[h * hop:h * hop + win]
                if len(seg) == win:
                    seg = seg * hann
                    rows.append({"h": h, "mags": np.abs(np.fft.rfft(seg)).tolist(), "rms": float(np.sqrt(np.mean(seg ** 2)))})
            out.append(rows)
        return pd.Series(out)

    d = d.select(*REC, "block_no", F.explode(windows("samples", "_next", "_prev")).alias("w"))
    return d.select(*REC, (F.col("block_no") * (block_len // hop) + F.col("w.h")).cast("int").alias("hop_idx"), "w.mags", "w.rms")


def band_flux(spec: DataFrame, bands: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Sum of positive magnitude changes per band of bins [lo, hi); zero without a predecessor."""
    b = blocked(spec, REC, "hop_idx", 1, 0)
    d = b.core(b.df.withColumn("_p", b.at(F.col("mags"), -1)))

    def flux(lo: int, hi: int) -> Column:
        up = F.zip_with(F.slice("mags", lo + 1, hi - lo), F.slice("_p", lo + 1, hi - lo), lambda a, p: F.greatest(F.lit(0.0), a - p))
        return F.coalesce(F.aggregate(up, F.lit(0.0), lambda s, v: s + v), F.lit(0.0))

    return d.select(*REC, "hop_idx", "rms", *[flux(*r).alias(f"flux_{n}") for n, r in bands.items()])


def spectral_centroid(mags: Column, bin_hz: float) -> Column:
    total = F.aggregate(mags, F.lit(0.0), lambda s, v: s + v)
    weighted = F.aggregate(F.transform(mags, lambda v, i: v * i * bin_hz), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(weighted / F.nullif(total, F.lit(0.0)), F.lit(0.0))


def median_clamp_normalise(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Subtract the recording's median, clamp at zero, divide by the maximum."""
    keys = list(keys)
    q = exact_quantiles(df, keys, value, {"_med": 0.5}, highest="_mx").drop("n")
    d = df.join(q.hint("merge"), keys)  # a row for each recording: they grow with the data, so the driver never holds them
    return d.withColumn(out, F.greatest(F.lit(0.0), F.col(value) - F.col("_med")) / (
        F.greatest(F.lit(0.0), F.col("_mx") - F.col("_med")) + 1e-9)).drop("_med", "_mx")


def floor_ratio(df: DataFrame, keys: Sequence[str], frame: str, weights: Mapping[str, float], half: int, out: str) -> DataFrame:
    """Weighted sum of each signal over its local 75th percentile (truncated window)."""
    b = blocked(df, keys, frame, half, half)
    d = b.df
    for n in weights:
        d = d.withColumn(f"_q_{n}", F.percentile(n, 0.75).over(b.span(-half, half)))
    d = b.core(d)
    total = None
    for n, w in weights.items():
        t = w * F.col(n) / (F.col(f"_q_{n}") + 1e-6)
        total = t if total is None else total + t
    return d.withColumn(out, total).drop(*[f"_q_{n}" for n in weights])


def triangular_smooth(df: DataFrame, keys: Sequence[str], frame: str, value: str, out: str) -> DataFrame:
    b = blocked(df, keys, frame, 1, 1)
    zero = lambda o: F.coalesce(b.at(F.col(value), o), F.lit(0.0))
    return b.core(b.df.withColumn(out, TRIANGLE[0] * zero(-1) + TRIANGLE[1] * F.col(value) + TRIANGLE[2] * zero(1)))


def local_peaks(df: DataFrame, keys: Sequence[str], frame: str, value: str, height: float) -> DataFrame:
    """Samples above both neighbours and at least ``height``."""
    b = blocked(df, keys, frame, 1, 1)
    d = b.core(b.df.withColumn("_p", b.at(F.col(value), -1)).withColumn("_n", b.at(F.col(value), 1)))
    return d.where((F.col(value) > F.col("_p")) & (F.col(value) > F.col("_n")) & (F.col(value) >= height)).drop("_p", "_n")


def falls_to(v: np.ndarray, needed: float) -> np.ndarray:
    """For each sample s the least peak height p with p - s >= needed, in the same floating-point comparison."""
    p = np.asarray(v, dtype=float) + needed
    for _ in range(2):
        p = np.where(p - v >= needed, p, np.nextafter(p, np.inf))
    for _ in range(2):
        lower = np.nextafter(p, -np.inf)
        p = np.where(lower - v >= needed, lower, p)
    return p


def entry_height(v: np.ndarray, needed: float) -> float:
    """Least height of a peak before the samples that falls by ``needed`` in them before one is higher; inf if none does."""
    before = np.concatenate([[-np.inf], np.maximum.accumulate(v)[:-1]])
    return float(np.maximum(before, falls_to(v, needed)).min()) if len(v) else np.inf


def peak_falls(v: np.ndarray, at: np.ndarray, needed: float, beyond: float) -> np.ndarray:
    """Whether the peaks at places ``at`` fall on their left; those that meet neither a fall nor a higher sample fall from height ``beyond`` on.

    All peaks step left together, by halving strides over running extremes of 1, 2, 4, ... samples."""
    n, own = len(v), v[at]
    top, low = [v], [v]
    while (1 << len(top)) < n:
        k = 1 << (len(top) - 1)
        top.append(np.maximum(top[-1], np.concatenate([np.full(k, -np.inf), top[-1][:-k]])))
        low.append(np.minimum(low[-1], np.concatenate([np.full(k, np.inf), low[-1][:-k]])))
    place, least = at - 1, np.full(len(at), np.inf)
    for k in range(len(top) - 1, -1, -1):
        for _ in range(2 if k == len(top) - 1 else 1):
            here = np.maximum(place, 0)
            go = (place >= (1 << k) - 1) & (top[k][here] <= own)
            least = np.where(go, np.minimum(least, low[k][here]), least)
            place = np.where(go, place - (1 << k), place)
    return (own - least >= needed) | ((place < 0) & (own >= beyond))


def prominent(peaks: DataFrame, signal: DataFrame, keys: Sequence[str], frame: str, value: str, needed: float, size: int = BLOCK) -> DataFrame:
    """Peaks that fall by ``needed`` on both sides before a higher sample.

    Seen from a block's edge, whether a peak falls depends on its height alone and never turns back as it grows: from some height
    on it falls. A block maps the height that its far edge asks for to that of its near edge, x -> min(own, max(highest sample, x)).
    So a block is two numbers a side, composed per recording from one row a block; then every block settles its own peaks. No
    pairs are made, however far a peak must look, and the output is linear.
    """
    keys = list(keys)
    rest = [c for c in peaks.columns if c not in (*keys, frame)]
    d = signal.select(*keys, F.col(frame).alias("_f"), F.col(value).cast("double").alias("_v"), F.lit(None).cast(peaks.select(F.struct(*rest)).schema[0].dataType).alias("_row"))
    d = d.where("_v is not null and not isnan(_v)").unionByName(peaks.select(*keys, F.col(frame).alias("_f"), F.lit(None).cast("double").alias("_v"), F.struct(*rest).alias("_row")))
    rows = d.groupBy(*keys, block_of("_f", size).alias("_blk")).agg(
        F.sort_array(F.collect_list(F.when(F.col("_v").isNotNull(), F.struct("_f", "_v")))).alias("_s"),
        F.collect_list(F.when(F.col("_row").isNotNull(), F.struct("_f", "_row"))).alias("_p"))
    rows = cut_lineage(rows)  # a row a block, read three times

    @F.pandas_udf("struct<top:double,left:double,right:double>")
    def edges(samples: pd.Series) -> pd.DataFrame:
        out = []
        for v in samples:
            v = np.asarray(v, dtype=float)
            out.append((v.max(initial=-np.inf), entry_height(v[::-1], needed), entry_height(v, needed)))
        return pd.DataFrame(out, columns=["top", "left", "right"])

    @F.pandas_udf("array<struct<l:double,r:double>>")
    def beyond(tops: pd.Series, lefts: pd.Series, rights: pd.Series) -> pd.Series:
        """What the blocks beyond each edge ask for: composed from the farthest block on."""
        def composed(top: Sequence[float], own: Sequence[float]) -> list[float]:
            x, out = np.inf, []
            for t, o in zip(top, own):
                out.append(x)
                x = min(o, max(t, x))
            return out

        return pd.Series([[{"l": x, "r": y} for x, y in zip(composed(t, left), composed(t[::-1], right[::-1])[::-1])] for t, left, right in zip(tops, lefts, rights)])

    parts = rows.select(*keys, "_blk", edges("_s._v").alias("_e")).select(*keys, "_blk", "_e.*").where("top > double('-infinity')")
    whole = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_blk", "top", "left", "right"))).alias("_b"))
    asked = whole.withColumn("_x", beyond("_b.top", "_b.left", "_b.right"))
    asked = asked.select(*keys, F.explode(F.arrays_zip(F.col("_b._blk").alias("b"), F.col("_x").alias("x"))).alias("z"))
    asked = asked.select(*keys, F.col("z.b").alias("_blk"), F.col("z.x.l").alias("_l"), F.col("z.x.r").alias("_r"))

    @F.pandas_udf("array<boolean>")
    def settle(frames: pd.Series, samples: pd.Series, at: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for f, v, p, x, y in zip(frames, samples, at, left, right):
            v, k = np.asarray(v, dtype=float), np.searchsorted(np.asarray(f), np.asarray(p))
            out.append((peak_falls(v, k, needed, x) & peak_falls(v[::-1], len(v) - 1 - k, needed, y)).tolist())
        return pd.Series(out)

    d = rows.where(F.size("_p") > 0).join(asked, [*keys, "_blk"]).withColumn("_m", settle("_s._f", "_s._v", "_p._f", "_l", "_r"))
    d = d.select(*keys, F.explode(F.filter(F.zip_with("_p", "_m", lambda p, m: F.struct(p.alias("p"), m.alias("m"))), lambda z: z["m"])).alias("_z"))
    return d.select(*keys, F.col("_z.p._f").alias(frame), "_z.p._row.*").select(*peaks.columns)


def pick_peaks(signal: DataFrame, keys: Sequence[str], frame: str, value: str, height: float, distance: int) -> DataFrame:
    """Peaks by height, mutual distance (higher first) and prominence of a quarter of the height."""
    keys = list(keys)
    signal = cut_lineage(signal.select(*keys, frame, value))  # peaks, suppression and prominence read it
    p = local_peaks(signal, keys, frame, value, height).withColumn("_id", F.col(frame))
    p = greedy_nms(p, keys, frame, value, distance, tie="_id").drop("_id")
    return prominent(p, signal, keys, frame, value, 0.25 * height)


def adaptive_peaks(signal: DataFrame, keys: Sequence[str], frame: str, value: str, *, pre_max: int = 20, post_max: int = 20,
                   pre_avg: int = 30, post_avg: int = 30, k: float = 1.0, wait: int = 12) -> DataFrame:
    """Local maxima above the local mean by k standard deviations of the recording, ``wait`` frames apart."""
    keys = list(keys)
    sd = signal.groupBy(*keys).agg(F.stddev_pop(value).alias("_sd"))
    b = blocked(signal, keys, frame, max(pre_max, pre_avg), max(post_max, post_avg) - 1)
    d = (b.df.withColumn("_mx", F.max(value).over(b.span(-pre_max, post_max - 1)))
         .withColumn("_av", F.avg(value).over(b.span(-pre_avg, post_avg - 1))))
    d = b.core(d).where(F.col(value) == F.col("_mx")).join(sd, keys)
    d = d.where(F.col(value) >= F.col("_av") + k * F.col("_sd")).select(*keys, frame, value)
    return first_fit(d, keys, frame, wait + 1, tie=[value])


def features_at_frames(signal: DataFrame, keys: Sequence[str], frame: str, value: str) -> DataFrame:
    """Peak within six frames, rise over the preceding stretch, mean level ten to two frames before."""
    b = blocked(signal, keys, frame, 10, 6)
    d = (b.df.withColumn("peak", F.max(value).over(b.span(-6, 6)))
         .withColumn("_before", F.coalesce(F.max(value).over(b.span(-6, -4)), F.lit(0.0)))
         .withColumn("silence", F.coalesce(F.avg(value).over(b.span(-10, -3)), F.lit(0.5)))
         .withColumn("rms3", F.max(value).over(b.span(-3, 3))))
    d = b.core(d)
    return d.withColumn("rising", F.greatest(F.lit(0.0), F.col("peak") - F.col("_before"))).drop("_before")
