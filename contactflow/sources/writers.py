"""Sinks: partitioned Parquet tables, JSON and CSV exports, versioned manifests."""
from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactflow.operators.labels import manifest_counters

RECORDING = ("match_id", "round_id")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = RECORDING, mode: str = "overwrite") -> None:
    """Parquet by recording. Rows are spread by recording and frame block first,
    so a large recording is written by many tasks and a small one to few files.
    Overwriting replaces the recordings of ``df`` only."""
    keys = [F.col(c) for c in partition_by]
    if "frame" in df.columns:
        keys.append(F.floor(F.col("frame") / 65536))
    w = df.repartition(*keys).write.mode(mode).option("partitionOverwriteMode", "dynamic")
    w.partitionBy(*partition_by).parquet(path)


def detection_events(df: DataFrame, approach: str, threshold: float, cooldown: int, gates: Sequence[str], fps: float | None = None) -> DataFrame:
    """Export rows: rounded scores, gate struct and the run's header fields; with a frame rate also it, times and the recording's number of rows."""
    g = F.struct(*[F.round(F.col(c), 3).alias(c) for c in gates])
    out = df.select(*RECORDING, F.lit(approach).alias("approach"), F.lit(threshold).alias("threshold"), F.lit(cooldown).alias("cooldown"),
                    F.col("frame").alias("impact_frame"), F.round("score", 4).alias("impact_score"), F.lit(True).alias("is_impact"),
                    "striker_id", "receiver_id", g.alias("gates"))
    if fps is None:
        return out
    n = df.groupBy(*RECORDING).agg(F.count(F.lit(1)).alias("n_impacts"))
    return out.join(n, list(RECORDING)).withColumns({"fps": F.lit(fps), "timestamp_seconds": F.round(F.col("impact_frame") / fps, 3)})


def write_json_lines(df: DataFrame, path: str, partition_by: Sequence[str] = RECORDING) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).json(path)


def write_manifest(clips: DataFrame, path: str) -> None:
    """Clips and, next to them, the derived counters."""
    clips.write.mode("overwrite").parquet(f"{path}/clips")
    manifest_counters(clips).write.mode("overwrite").json(f"{path}/counters")


def write_parts_csv(parts: DataFrame, path: str) -> None:
    parts.select("fight", "round", "fighter", "part", "path").write.mode("overwrite").option("header", "true").csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def publish_version(df: DataFrame, root: str) -> str:
    """Write a new version directory, then point to it; earlier versions stay as backups.

    Pointers are only ever added and the newest one counts, so a reader always finds a
    complete version, also while the next one is published."""
    version = f"v{time.time_ns():020d}"
    df.write.mode("errorifexists").parquet(f"{root}/{version}")
    spark = df.sparkSession
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").json(f"{root}/current")
    return version


def read_current(spark: SparkSession, root: str) -> DataFrame:
    version = spark.read.schema("version string").json(f"{root}/current").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root}/{version}")


def write_tensors(tensors: DataFrame, names: Sequence[str], root: str, parts: int | None = None) -> str:
    """Sequence tensors (x: T x F arrays, mask, y, group, name and more) as a new version of a table, with their column names.

    Parts are dealt by a hash of the name, so a group with a third of all clips is written by many tasks. A manifest with the number of clips,
    T, F and the column names is taken from the written parts and added last: it commits them. A write that fails before that leaves the
    newest version as it was."""
    version = f"v{time.time_ns():020d}"
    spark, path = tensors.sparkSession, f"{root}/{version}"
    key = F.xxhash64("name")
    (tensors.repartition(parts, key) if parts else tensors.repartition(key)).write.mode("errorifexists").parquet(path)
    shape = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("t0"), F.max(F.size("x")).alias("t"), F.max(F.size(F.get("x", F.lit(0)))).alias("f"), F.count_if(F.size("mask") != F.size("x")).alias("odd")).first()
    if shape["n"] and (shape["t0"] != shape["t"] or shape["f"] != len(names) or shape["odd"]):
        raise ValueError(f"tensors of one shape and {len(names)} columns are needed, got {shape.asDict()}")
    row = spark.createDataFrame([(version, shape["n"], shape["t"] or 0, len(names), list(names))], TENSOR_MANIFEST)
    row.coalesce(1).write.mode("append").json(f"{root}/manifest")
    return version


TENSOR_MANIFEST = "version string, n long, t int, f int, names array<string>"


def read_tensors(spark: SparkSession, root: str) -> tuple[DataFrame, list[str]]:
    """The newest committed version and its column names."""
    newest = spark.read.schema(TENSOR_MANIFEST).json(f"{root}/manifest").agg(F.max(F.struct("version", "n", "names")).alias("m")).first()["m"]
    return spark.read.parquet(f"{root}/{newest['version']}"), list(newest["names"])
