"""Band, interval and nearest joins keyed by recording and frame bucket."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], *,
              left_on: str, right_on: str, lo: float, hi: float,
              how: str = "inner", width: float | None = None) -> DataFrame:
    """Pairs with ``right_on - left_on`` in [lo, hi].

    Both sides meet on (keys, bucket), so one recording spreads over many tasks;
    each left row is copied into the at most few buckets its band touches.
    The right side's join columns arrive as ``right_on`` only.
    """
    keys = list(keys)
    width = width or max(hi - lo + 1, 1)
    first = F.floor((F.col(left_on) + lo) / width)
    last = F.floor((F.col(left_on) + hi) / width)
    a = left.withColumn("_bk", F.explode(F.sequence(first, last)))
    b = right.withColumn("_bk", F.floor(F.col(right_on) / width))
    joined = a.join(b, [*keys, "_bk"]).where(
        (F.col(right_on) - F.col(left_on)).between(lo, hi)).drop("_bk")
    if how == "inner":
        return joined
    raise ValueError(f"unsupported how={how!r}; see best_in_band / matched_in_band")


def least(order: Sequence[Column], *keep: Column) -> Column:
    """Arg-min by ``order``; a row whose first order column is NULL never wins (NULL if there is no other)."""
    return F.min(F.when(order[0].isNotNull(), F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *keep)))


def best_in_band(left: DataFrame, right: DataFrame, keys: Sequence[str], *,
                 left_on: str, right_on: str, lo: float, hi: float,
                 order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """Left outer join to the single best right row in the band.

    ``order`` lists columns to minimise, the last of which must break ties; ``keep``
    are right columns to attach. The winner depends on the row's keys and frame
    only, so it is found once per distinct frame: rows repeated on one frame add
    no pairs. min(struct) combines map-side; no pair list is ever collected.
    Give ``right`` at most one row per frame.
    """
    keys = list(keys)
    spots = left.select(*keys, left_on).distinct()
    pairs = band_join(spots, right, keys, left_on=left_on, right_on=right_on, lo=lo, hi=hi)
    best = pairs.groupBy(*keys, left_on).agg(
        least(order, *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]).alias("_best"))
    out = left.join(best, [*keys, left_on], "left")
    for i, c in enumerate(keep):
        out = out.withColumn(c, F.col(f"_best._k{i}"))
    return out.drop("_best")


def aggregate_in_band(left: DataFrame, right: DataFrame, keys: Sequence[str], *, left_on: str,
                      right_on: str, lo: float, hi: float, aggs: Sequence[Column],
                      width: float | None = None) -> DataFrame:
    """Left outer join to aggregates over the band, computed per distinct frame."""
    keys = list(keys)
    spots = left.select(*keys, left_on).distinct()
    got = (band_join(spots, right, keys, left_on=left_on, right_on=right_on, lo=lo, hi=hi, width=width)
           .groupBy(*keys, left_on).agg(*aggs))
    return left.join(got, [*keys, left_on], "left")


def matched_in_band(left: DataFrame, right: DataFrame, keys: Sequence[str], *,
                    left_on: str, right_on: str, lo: int, hi: int, out: str = "matched") -> DataFrame:
    """Flag left rows with at least one right row in the band (integer frames)."""
    keys = list(keys)
    cover = (right.select(*keys, F.col(right_on).alias("_r")).distinct()
             .select(*keys, F.explode(F.sequence(F.col("_r") - hi, F.col("_r") - lo)).alias(left_on))
             .distinct().withColumn(out, F.lit(True)))
    return left.join(cover, [*keys, left_on], "left").withColumn(
        out, F.coalesce(F.col(out), F.lit(False)))


def interval_join(windows: DataFrame, frames: DataFrame, keys: Sequence[str], *,
                  start: str, end: str, before: int, after: int, frame: str = "frame",
                  how: str = "inner") -> DataFrame:
    """Each window meets the frames of [start-before, end+after] by equi-join.

    Expanding the window keeps the join on (keys, frame): hash-distributed, no
    residual range predicate. ``frame`` must not be a column of ``windows``.
    """
    keys = list(keys)
    axis = windows.withColumn(frame, F.explode(
        F.sequence(F.col(start) - before, F.col(end) + after)))
    return axis.join(frames, [*keys, frame], how)


def pairs_same_frame(tracks: DataFrame, keys: Sequence[str] = ("match_id", "round_id", "frame"),
                     track: str = "track_id") -> DataFrame:
    """Directed striker/receiver pairs of tracks present in the same frame.

    Columns of the two sides arrive as structs ``s`` and ``r``.
    """
    keys = list(keys)
    rest = [c for c in tracks.columns if c not in keys]
    a = tracks.select(*keys, F.struct(*rest).alias("s"))
    b = tracks.select(*keys, F.struct(*rest).alias("r"))
    return a.join(b, keys).where(F.col(f"s.{track}") != F.col(f"r.{track}"))


def bucket_asof(left: DataFrame, samples: DataFrame, keys: Sequence[str], *, frame: str,
                stride: int, value: str, default: Column) -> DataFrame:
    """Sample in force at the start of the row's stride bucket, else the default."""
    keys = list(keys)
    s = samples.select(*keys, F.col("frame").alias("_bucket"), value)
    key = (F.floor(F.col(frame) / stride) * stride).cast("int")
    return (left.withColumn("_bucket", key).join(s, [*keys, "_bucket"], "left")
            .withColumn(value, F.coalesce(F.col(value), default)).drop("_bucket"))
