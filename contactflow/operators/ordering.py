"""Frame-ordered primitives that never put a whole recording into one task.

A recording (match, round, track) can hold a large share of all rows, so ordered
work is split into blocks of consecutive frames:

* bounded look-back / look-ahead: every block also receives a *halo* of
  neighbouring rows, so range-framed windows stay exact inside one block;
* unbounded scans (fills, running sums, running maxima, row numbers): a scan
  inside each block, a scan over one summary row per block, and a join of the
  carry back onto the block's rows.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = 4096


def block_of(frame: Column | str, size: int) -> Column:
    return F.floor(F.col(frame) / size) if isinstance(frame, str) else F.floor(frame / size)


@dataclass
class Blocked:
    """Rows replicated into the blocks that need them, and the windows over a block."""

    df: DataFrame
    keys: list[str]
    frame: str

    def base(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, "_blk").orderBy(self.frame)

    def span(self, lo: int, hi: int) -> WindowSpec:
        return self.base().rangeBetween(lo, hi)

    def at(self, value: Column, offset: int) -> Column:
        """The value at exactly ``frame + offset``; NULL when that frame is absent."""
        return F.first(value).over(self.span(offset, offset))

    def core(self, df: DataFrame) -> DataFrame:
        return df.where("_core").drop("_blk", "_core")


def blocked(df: DataFrame, keys: Sequence[str], frame: str, before: int, after: int,
            size: int | None = None) -> Blocked:
    """Block rows by frame so that each core row sees [frame-before, frame+after]."""
    size = size or max(BLOCK, 16 * (before + after + 1))
    lo = block_of(F.col(frame) - after, size)
    hi = block_of(F.col(frame) + before, size)
    out = (df.withColumn("_blk", F.explode(F.sequence(lo, hi)))
             .withColumn("_core", F.col("_blk") == block_of(frame, size)))
    return Blocked(out, list(keys), frame)


def two_level_scan(df: DataFrame, keys: Sequence[str], order: str, *,
                   local: dict[str, Callable[[WindowSpec], Column]],
                   summary: dict[str, Column],
                   carry: dict[str, Callable[[WindowSpec], Column]],
                   tie: Sequence[str] = (), size: int = BLOCK,
                   descending: bool = False) -> DataFrame:
    """Exact ordered scan: within-block columns plus the carry of earlier blocks."""
    keys = list(keys)
    d = df.withColumn("_blk", block_of(order, size))
    cols = [F.col(c).desc() if descending else F.col(c).asc() for c in (order, *tie)]
    w = Window.partitionBy(*keys, "_blk").orderBy(*cols)
    for name, fn in local.items():
        d = d.withColumn(name, fn(w))
    s = d.groupBy(*keys, "_blk").agg(*[c.alias(n) for n, c in summary.items()])
    ws = (Window.partitionBy(*keys)
          .orderBy(F.col("_blk").desc() if descending else F.col("_blk"))
          .rowsBetween(Window.unboundedPreceding, -1))
    s = s.select(*keys, "_blk", *[fn(ws).alias(n) for n, fn in carry.items()])
    return d.join(s, [*keys, "_blk"], "left").drop("_blk")


def forward_fill(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str,
                 *, descending: bool = False, size: int = BLOCK) -> DataFrame:
    """Last non-null ``value`` at or before the row (or at or after, if descending)."""
    # NULL orders never win: max_by/min_by skip rows whose ordering key is NULL
    key = F.when(F.col(value).isNotNull(), F.col(order))
    pick = F.min_by(value, key) if descending else F.max_by(value, key)
    d = two_level_scan(
        df, keys, order, descending=descending, size=size,
        local={"_l": lambda w: F.last(value, ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, 0))},
        summary={"_s": pick},
        carry={"_c": lambda w: F.last("_s", ignorenulls=True).over(w)})
    return d.withColumn(out, F.coalesce("_l", "_c")).drop("_l", "_c")


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str,
                *, tie: Sequence[str] = (), inclusive: bool = True,
                size: int = BLOCK) -> DataFrame:
    d = two_level_scan(
        df, keys, order, tie=tie, size=size,
        local={"_l": lambda w: F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))},
        summary={"_s": F.sum(value)},
        carry={"_c": lambda w: F.sum("_s").over(w)})
    total = F.coalesce("_l", F.lit(0)) + F.coalesce("_c", F.lit(0))
    if not inclusive:
        total = total - F.coalesce(F.col(value), F.lit(0))
    return d.withColumn(out, total).drop("_l", "_c")


def row_number(df: DataFrame, keys: Sequence[str], order: str, out: str,
               *, tie: Sequence[str] = (), size: int = BLOCK) -> DataFrame:
    """1-based row number per key in (order, tie) order."""
    d = two_level_scan(
        df, keys, order, tie=tie, size=size,
        local={"_l": lambda w: F.row_number().over(w)},
        summary={"_s": F.count(F.lit(1))},
        carry={"_c": lambda w: F.sum("_s").over(w)})
    return d.withColumn(out, F.col("_l") + F.coalesce("_c", F.lit(0))).drop("_l", "_c")


def previous_row(df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str,
                 *, size: int = BLOCK) -> DataFrame:
    """Value of the preceding available row (row-based lag, any gap)."""
    d = two_level_scan(
        df.withColumn("_v", F.struct(value.alias("v"))), keys, order, size=size,  # a struct, so a NULL value is not taken for no row
        local={"_l": lambda w: F.lag("_v").over(w)},
        summary={"_s": F.max_by("_v", order)},
        carry={"_c": lambda w: F.last("_s").over(w)})
    return d.withColumn(out, F.coalesce("_l", "_c")["v"]).drop("_l", "_c", "_v")


def islands(df: DataFrame, keys: Sequence[str], frame: str, gap: int, out: str = "island",
            *, size: int = BLOCK) -> DataFrame:
    """Label runs whose consecutive frames are closer than ``gap`` by their first frame.

    A row opens an island when no row lies in (frame-gap, frame): a bounded test.
    """
    b = blocked(df, keys, frame, before=gap, after=0, size=max(size, 4 * gap))
    prev = F.max(frame).over(b.span(-gap + 1, -1)) if gap > 1 else F.lit(None).cast("int")
    d = b.core(b.df.withColumn("_open", F.when(prev.isNull(), F.col(frame))))
    return forward_fill(d, keys, frame, "_open", out, size=size).drop("_open")


def densify(df: DataFrame, keys: Sequence[str], frame: str, chunk: int = BLOCK) -> DataFrame:
    """One row per frame between each key's first and last frame.

    Ranges are cut into chunks first, so no task expands a whole recording.
    """
    keys = list(keys)
    ends = df.groupBy(*keys).agg(F.min(frame).alias("_lo"), F.max(frame).alias("_hi"))
    cut = ends.withColumn("_b", F.explode(F.sequence(block_of("_lo", chunk), block_of("_hi", chunk))))
    cut = cut.repartition(*keys, "_b")
    lo = F.greatest(F.col("_lo"), (F.col("_b") * chunk).cast("int"))
    hi = F.least(F.col("_hi"), (F.col("_b") * chunk + (chunk - 1)).cast("int"))
    axis = cut.select(*keys, F.explode(F.sequence(lo, hi)).alias(frame))
    return axis.join(df, [*keys, frame], "left")


def ema_scan(df: DataFrame, keys: Sequence[str], order: str, value: str, alpha: float, out: str,
             *, size: int = BLOCK) -> DataFrame:
    """Exact exponential moving average along each key.

    A block's effect on the state is affine (state -> a * state + b), so blocks
    fold independently and one row per block is composed per key.
    """
    keys = list(keys)
    q = 1 - alpha
    d = df.withColumn("_blk", block_of(order, size))
    rows = d.groupBy(*keys, "_blk").agg(F.sort_array(F.collect_list(F.struct(
        F.col(order).alias("o"), F.col(value).alias("v"), F.struct(*[c for c in df.columns if c not in keys]).alias("r")))).alias("_a"))
    # within the block, starting from zero state
    rows = rows.withColumn("_b", F.aggregate("_a", F.lit(0.0), lambda s, x: alpha * x["v"] + q * s))
    parts = rows.select(*keys, "_blk", F.size("_a").alias("_n"), "_b", F.get("_a", F.lit(0))["v"].alias("_v0"))
    folded = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_blk", "_n", "_b", "_v0"))).alias("_p"))
    start = F.aggregate(
        "_p", F.struct(F.get("_p", F.lit(0))["_v0"].alias("s"), F.expr("cast(array() as array<double>)").alias("all")),
        lambda acc, p: F.struct((F.pow(F.lit(q), p["_n"]) * acc["s"] + p["_b"]).alias("s"),
                                F.array_append(acc["all"], acc["s"]).alias("all")))
    entry = (folded.withColumn("_e", start["all"])
             .select(*keys, F.explode(F.arrays_zip(F.col("_p._blk").alias("b"), F.col("_e").alias("e"))).alias("z"))
             .select(*keys, F.col("z.b").alias("_blk"), F.col("z.e").alias("_s0")))
    x = rows.join(entry, [*keys, "_blk"]).withColumn("_z", F.explode("_a"))
    w = Window.partitionBy(*keys, "_blk").orderBy("_z.o").rowsBetween(Window.unboundedPreceding, 0)
    # running value as a scan over the block's rows: scaled prefix sums lose precision, so fold a short tail
    hist = F.collect_list(F.struct(F.col("_z.v").alias("v"))).over(w.rowsBetween(-ema_tail(q), 0))
    k = F.row_number().over(Window.partitionBy(*keys, "_blk").orderBy("_z.o"))
    x = x.withColumn("_h", hist).withColumn("_k", k)
    s0 = F.when(F.col("_k") <= F.size("_h"), F.col("_s0")).otherwise(0.0)
    x = x.withColumn(out, F.aggregate("_h", s0, lambda s, e: alpha * e["v"] + q * s))
    return x.select(*keys, "_z.r.*", out)


def ema_tail(q: float) -> int:
    """Rows after which an earlier value weighs less than double precision."""
    return max(1, math.ceil(math.log(1e-17) / math.log(q)))
