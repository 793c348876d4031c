"""Label and manifest operations: merging tracks, labels and verdicts."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def part_to_global(part: Column, local_frame: Column, part_size: int = 1500) -> Column:
    """1-based part and local frame to a 0-based round frame."""
    return ((part - 1) * part_size + (local_frame - 1)).cast("int")


def last_write_wins(df: DataFrame, keys: Sequence[str], version: Sequence[Column]) -> DataFrame:
    """The newest row per key; max(struct) combines map-side."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    b = df.groupBy(*keys).agg(F.max(F.struct(*[v.alias(f"_v{i}") for i, v in enumerate(version)], F.struct(*rest).alias("_r"))).alias("b"))
    return b.select(*keys, "b._r.*").select(*df.columns)


def first_source(df: DataFrame, keys: Sequence[str], priority: str) -> DataFrame:
    """Rows of the best source each key group has (a track from keypoints, else from boxes)."""
    keys = list(keys)
    best = df.groupBy(*keys).agg(F.min(priority).alias("_best"))
    return df.join(best, keys).where(F.col(priority) == F.col("_best")).drop("_best")


def keep_labels(fresh: DataFrame, existing: DataFrame, key: Sequence[str] = ("clip",)) -> DataFrame:
    """Fresh manifest rows with the labels and impact frames already assigned."""
    old = existing.select(*key, F.col("label").alias("_l"), F.col("impact_frame").alias("_f"))
    return (fresh.join(old, list(key), "left")
            .withColumn("label", F.coalesce("_l", "label")).withColumn("impact_frame", F.coalesce("_f", "impact_frame"))
            .drop("_l", "_f"))


def diff_manifest(live: DataFrame, incoming: DataFrame) -> DataFrame:
    """(clip, kind, live, incoming): new labels, agreements, conflicts, frames, structure."""
    a = live.select("clip", F.col("label").alias("ll"), F.col("impact_frame").alias("lf"), F.lit(True).alias("in_live"))
    b = incoming.select("clip", F.col("label").alias("il"), F.col("impact_frame").alias("fi"), F.lit(True).alias("in_inc"))
    j = a.join(b, "clip", "full_outer")
    both = F.col("in_live").isNotNull() & F.col("in_inc").isNotNull()
    label = (F.when(both & F.col("il").isNotNull() & F.col("ll").isNull(), "new_label")
             .when(both & (F.col("il") == F.col("ll")), "agree").when(both & F.col("il").isNotNull(), "conflict"))
    frame = (F.when(both & F.col("fi").isNotNull() & F.col("lf").isNull(), "frame_added")
             .when(both & F.col("fi").isNotNull() & (F.col("fi") != F.col("lf")), "frame_conflict"))
    shape = F.when(F.col("in_live").isNull(), "not_in_live").when(F.col("in_inc").isNull(), "not_in_incoming")
    rows = F.array_compact(F.array(
        F.when(label.isNotNull(), F.struct(label.alias("kind"), F.col("ll").alias("live"), F.col("il").alias("incoming"))),
        F.when(frame.isNotNull(), F.struct(frame.alias("kind"), F.col("lf").cast("string").alias("live"), F.col("fi").cast("string").alias("incoming"))),
        F.when(shape.isNotNull(), F.struct(shape.alias("kind"), F.col("ll").alias("live"), F.col("il").alias("incoming")))))
    return j.select("clip", F.explode(rows).alias("r")).select("clip", "r.*")


def merge_in_order(live: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Apply several files at once: live value first, else the earliest file's.

    A file conflicts on a clip when its value differs from the merged one,
    which is exactly what a file-by-file merge would have seen.
    """
    fields = ("label", "impact_frame")
    inc = incoming.groupBy("clip").agg(*[
        F.min(F.when(F.col(f).isNotNull(), F.struct(order, F.col(f).alias("v"))))["v"].alias(f"_{f}") for f in fields])
    m = live.join(inc, "clip", "left")
    for f in fields:
        m = m.withColumn(f, F.coalesce(F.col(f), F.col(f"_{f}")))
    return m.drop(*[f"_{f}" for f in fields])


def file_conflicts(merged: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Per incoming file: agreements and conflicts with the merged manifest; clean files have none."""
    m = merged.select("clip", F.col("label").alias("ml"), F.col("impact_frame").alias("mf"))
    j = incoming.join(m, "clip")
    bad = (F.col("label").isNotNull() & (F.col("label") != F.col("ml"))) | (
        F.col("impact_frame").isNotNull() & (F.col("impact_frame") != F.col("mf")))
    return j.groupBy(order).agg(F.count(F.lit(1)).alias("n_clips"), F.count_if(bad).alias("conflicts"))


def manifest_counters(manifest: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    impact = F.col("label") == "impact"
    return manifest.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_clips"), F.count("label").alias("labeled"),
        F.count_if(F.col("label").isNull()).alias("unlabeled"),
        F.count_if(impact & F.col("impact_frame").isNotNull()).alias("impact_frames_marked"),
        F.count_if(impact & F.col("impact_frame").isNull()).alias("impact_frames_unmarked"))


def swap_roles(df: DataFrame, swapped: str = "swapped") -> DataFrame:
    """Correct striker and receiver where the identity timeline says they are swapped."""
    s = F.when(F.col(swapped), 1 - F.col("fighter_id")).otherwise(F.col("fighter_id"))
    return df.withColumn("striker_id", s).withColumn("receiver_id", 1 - s)


VERDICTS = ("LANDED", "BLOCKED", "MISS", "CLINCH", "UNCLEAR")  # fixed values


def apply_verdicts(detections: DataFrame, verdicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of frame verdicts; missing ones are UNCLEAR, unknown ones an error."""
    v = verdicts.withColumn("verdict", F.when(F.col("verdict").isin(*VERDICTS), F.col("verdict")).otherwise(
        F.raise_error(F.concat(F.lit("unknown verdict: "), F.coalesce("verdict", F.lit("NULL")))).cast("string")))
    return detections.join(v, list(keys), "left").withColumn("verdict", F.coalesce("verdict", F.lit("UNCLEAR")))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Rows with weight 1 / class count; two classes, so the counts fit a broadcast."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(F.broadcast(c), label).withColumn("weight", 1.0 / F.col("_n")).drop("_n")
