"""One-to-one matching of detections to ground truth within a frame tolerance.

The three matchers differ only in the order in which candidate pairs are
considered; a pair is accepted if neither side is taken:

* ``nearest_unused``: detections in frame order, each takes its nearest free truth
* ``first_unused``: detections in frame order, each takes its earliest free truth
* ``closest_pair``: all pairs by distance, then detection, then truth

Work runs in frame blocks with a halo. A detection whose outcome could depend on
rows outside the visible range stays open and is retried with its neighbours'
decisions fixed, so results equal the whole-recording scan.
"""
from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactflow.operators.ordering import BLOCK, block_of
from contactflow.session import cut_lineage

OPEN, FREE = -2, -1  # assignment states of a detection; otherwise the truth's frame
METHODS = ("nearest_unused", "first_unused", "closest_pair")


def _match_block(frames, assigned, goals, lo, hi, tol, method):
    """New assignments of detections; both sides are distinct frames in ascending order, those within [lo, hi)."""
    frames, out, goals = frames.tolist(), assigned.tolist(), goals.tolist()
    open_det = [i for i, a in enumerate(out) if a == OPEN]
    taken = {a for a in out if a >= 0}
    pairs = []
    for i in open_det:
        f = frames[i]
        for g in goals[bisect_left(goals, f - tol):bisect_right(goals, f + tol)]:
            key = {"nearest_unused": (f, abs(f - g), g), "first_unused": (f, g, 0),
                   "closest_pair": (abs(f - g), f, g)}[method]
            pairs.append((key, i, g))
    pairs.sort()
    # truths beyond the visible range might rank first
    unsure = {i for i in open_det if frames[i] - tol < lo or frames[i] + tol >= hi}
    # truths reachable by unseen detections might be taken earlier
    unsure_gt = {g for g in goals if g - tol < lo or g + tol >= hi}
    for _, i, g in pairs:
        if out[i] >= 0 or g in taken:
            continue
        if i in unsure or g in unsure_gt:
            unsure.add(i)
            unsure_gt.add(g)
            continue
        out[i] = g
        taken.add(g)
    for i in open_det:
        if out[i] == OPEN and i not in unsure:
            out[i] = FREE
    return out


def match(detections: DataFrame, truth: DataFrame, keys: Sequence[str], tol: int, method: str,
          *, frame: str = "frame", size: int = BLOCK, config: Sequence[str] = ()) -> DataFrame:
    """(keys, config, frame, gt_frame) per distinct detection frame; gt_frame NULL if unmatched.

    ``config`` names columns that detections alone have: the detections of each configuration are
    matched with all truths. A block's truths are one row that its configurations join, so they
    are never copied for each of these.
    """
    if method not in METHODS:
        raise ValueError(method)
    keys = list(keys)
    own = [*keys, *config]
    halo = 16 * (tol + 1)
    size = max(size, 8 * halo)

    def dealt(d: DataFrame) -> DataFrame:
        """A row for each block that sees it."""
        lo = block_of(F.col("_f") - halo, size)
        hi = block_of(F.col("_f") + halo, size)
        return d.withColumn("_blk", F.explode(F.sequence(lo, hi)))

    @F.pandas_udf("array<long>")
    def resolve(blk: pd.Series, f: pd.Series, a: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([
            _match_block(x, y, z, b * size - halo, (b + 1) * size + halo, tol, method)
            for b, x, y, z in zip(blk, f, a, g)])

    goals = dealt(truth.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(frame).alias("_f")))
    goals = cut_lineage(goals.groupBy(*[f"_k{i}" for i in range(len(keys))], F.col("_blk").alias("_b"))
                        .agg(F.sort_array(F.collect_set("_f")).alias("_g")))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    nodes = detections.select(*own, F.col(frame).alias("_f"), F.lit(OPEN).cast("long").alias("_as"))
    while True:
        g = dealt(nodes).groupBy(*own, "_blk").agg(F.sort_array(F.collect_set(F.struct("_f", "_as"))).alias("_a"))
        g = g.where(F.exists("_a", lambda a: block_of(a["_f"], size) == F.col("_blk")))
        # merged: truths compress so well that they would look small enough to broadcast
        g = g.join(goals.hint("merge"), [*same, F.col("_blk") == F.col("_b")], "left")
        g = g.withColumn("_n", resolve("_blk", "_a._f", "_a._as", F.coalesce("_g", F.array().cast(goals.schema["_g"].dataType))))
        nodes = (g.select(*own, "_blk", F.explode(F.zip_with(
                     "_a", "_n", lambda a, n: F.struct(a["_f"].alias("_f"), n.alias("_as")))).alias("z"))
                 .where(block_of(F.col("z._f"), size) == F.col("_blk"))
                 .select(*own, "z._f", "z._as"))
        nodes = cut_lineage(nodes)
        if nodes.where(F.col("_as") == OPEN).isEmpty():
            break
    return nodes.select(*own, F.col("_f").alias(frame),
                        F.when(F.col("_as") >= 0, F.col("_as")).cast("int").alias("gt_frame"))


def match_counts(matched: DataFrame, truth: DataFrame, keys: Sequence[str],
                 *, frame: str = "frame") -> DataFrame:
    """tp, fp, fn per key from a match table and the distinct truth frames."""
    keys = list(keys)
    d = matched.groupBy(*keys).agg(F.count("gt_frame").alias("tp"), F.count(F.lit(1)).alias("n_det"))
    g = truth.select(*keys, frame).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gt"))
    j = d.join(g, keys, "full_outer").na.fill(0, ["tp", "n_det", "n_gt"])
    return j.select(*keys, "tp", (F.col("n_det") - F.col("tp")).alias("fp"),
                    (F.col("n_gt") - F.col("tp")).alias("fn"))


def with_prf(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 from tp/fp/fn; zero where undefined."""
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0))
    d = df.withColumn("precision", p).withColumn("recall", r)
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                 F.col("precision") + F.col("recall")), F.lit(0.0))
    return d.withColumn("f1", f1)
