"""Gap filling and smoothing on a dense frame axis."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactflow.operators.ordering import BLOCK, blocked, two_level_scan


def interpolate(df: DataFrame, keys: Sequence[str], frame: str, value: str, size: int = BLOCK) -> DataFrame:
    """Dense frames between each key's ends, missing values linearly interpolated.

    The rows that are there look for their neighbours; each then makes the frames up to the next one, so dense frames are never shuffled."""
    keys = list(keys)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    d = df.where(F.col(frame).isNotNull()).select(F.struct(*keys).alias("_key"), frame, F.when(whole, F.col(value)).alias(value))  # rows without a key have no values
    d = d.withColumn("_k", F.when(F.col(value).isNotNull(), F.struct(F.col(frame).alias("f"), F.col(value).alias("v"))))
    # both neighbours in one scan: the same blocks and the same sort serve either direction
    known = F.when(F.col("_k").isNotNull(), F.col(frame))
    before, after = Window.unboundedPreceding, Window.unboundedFollowing
    d = two_level_scan(
        d, ["_key"], frame, size=size,
        local={"_lp": lambda w: F.last("_k", ignorenulls=True).over(w.rowsBetween(before, 0)),
               "_ln": lambda w: F.first("_k", ignorenulls=True).over(w.rowsBetween(1, after)),
               "_lf": lambda w: F.lead(frame).over(w)},
        summary={"_sp": F.max_by("_k", known), "_sn": F.min_by("_k", known), "_sf": F.min(frame)},
        carry={"_cp": lambda w: F.last("_sp", ignorenulls=True).over(w),
               "_cn": lambda w: F.first("_sn", ignorenulls=True).over(w.rowsBetween(1, after)),
               "_cf": lambda w: F.first("_sf").over(w.rowsBetween(1, after))})
    last = F.greatest(F.col(frame), F.coalesce("_lf", "_cf", F.col(frame) + 1) - 1)
    d = d.select("_key", F.col(frame).alias("_f"), value, F.coalesce("_lp", "_cp").alias("_p"), F.coalesce("_ln", "_cn").alias("_n"), last.alias("_last"))
    d = d.withColumn("_c", F.explode(F.sequence("_f", "_last", F.lit(size))))  # long gaps in parts
    d = d.withColumn(frame, F.explode(F.sequence("_c", F.least(F.col("_c") + (size - 1), F.col("_last")))))
    span = (F.col("_n.f") - F.col("_p.f")).cast("double")
    lerp = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (F.col(frame) - F.col("_p.f")) / F.nullif(span, F.lit(0.0))
    own = F.when(F.col(frame) == F.col("_f"), F.col(value))
    return d.select("_key.*", frame, F.coalesce(own, lerp, F.col("_p.v"), F.col("_n.v")).alias(value))


def gaussian_kernel(n: int) -> list[float]:
    """Kernel of odd length with sigma n/6, summing to one."""
    n += 1 - n % 2
    k = [math.exp(-0.5 * ((i - n // 2) / (n / 6.0)) ** 2) for i in range(n)]
    return [v / sum(k) for v in k]


def gaussian_smooth(df: DataFrame, keys: Sequence[str], frame: str, value: str, n: int, out: str) -> DataFrame:
    """Convolve a dense series with reflected ends.

    A series shorter than the kernel is reflected as often as it takes; one frame
    alone repeats itself. Folding never moves a place away from the row, so every
    folded place lies in the row's own window.
    """
    keys = list(keys)
    kernel = gaussian_kernel(n)
    half = len(kernel) // 2
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    b = blocked(df, keys, frame, half, half)
    w = b.base()
    near = [f"_w{i}" for i in range(len(kernel))]
    ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # a block sees ``half`` frames beyond its own, so an end of the series that a row can reach is an end of what the block sees
    x = b.df.withColumns({"_lo": F.min(frame).over(ends), "_hi": F.max(frame).over(ends), **{c: F.lag(value, half - i).over(w) for i, c in enumerate(near)}})

    lo, last = F.col("_lo"), F.col("_hi") - F.col("_lo")

    def folded(k):
        place = F.pmod(F.col(frame) + k - half - lo, F.greatest(2 * last, F.lit(1)))
        return lo + last - F.abs(place - last)

    # away from the ends the window lines up with the kernel; only end rows need folded places
    inner = F.lit(0.0)
    for c, v in zip(near, kernel):
        inner = inner + F.col(c) * v
    at = lambda k: F.get(F.array(*near), (folded(k) - F.col(frame) + half).cast("int"))
    edge = F.aggregate(F.transform(F.array(*[F.lit(v) for v in kernel]), lambda v, k: at(k) * v), F.lit(0.0), lambda a, v: a + v)
    inside = (F.col(frame) - half >= lo) & (F.col(frame) + half <= F.col("_hi"))
    return b.core(x.withColumn(out, F.when(inside, inner).otherwise(edge))).drop("_lo", "_hi", *near)
