"""Scans of the raw exports into typed tables.

Every reader has an explicit schema. Exports are nested JSON documents; the
``parse_*`` functions work on a DataFrame, so the same code serves whole
documents, JSON lines (splittable, preferred for large recordings) and streams.
"""
from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactflow.functions.geometry import track_of_fighter
from contactflow.schema import raw_action, raw_clip, raw_contact, raw_entry

# Path patterns that carry the match, the round, a part, a clip time.
MATCH_ROUND = r"([^/]+)/[Rr]ound_?(\d+)(?:/|[^/]*$)"
PART = r"_part(\d+)"
CLIP_TIME = r"_t(?:(\d+)m)?([\d.]+)s"
CLIP_FRAME = r"_f(\d+)\."
DEFAULT_DIMS = (1920.0, 1080.0, 640.0, 360.0)

document = T.StructType([T.StructField("0", T.ArrayType(raw_entry)), T.StructField("1", T.ArrayType(raw_entry)),
                         T.StructField("contact_events", T.ArrayType(raw_contact))])


def with_recording(df: DataFrame, path: Column | None = None) -> DataFrame:
    """match_id and round_id from the file path."""
    p = F.col("_metadata.file_path") if path is None else path
    return df.select("*", F.regexp_extract(p, MATCH_ROUND, 1).alias("match_id"),
                     F.regexp_extract(p, MATCH_ROUND, 2).cast("int").alias("round_id"))


def discover(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Files below a match folder or a parent of many: path, length, match, round."""
    d = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
         .select("path", "length"))
    return with_recording(d, F.col("path"))


# ---- poses

def _points(arr: Column, dims: str, scale: tuple[Column, ...] | None = None) -> Column:
    def one(p: Column) -> Column:
        vals = [F.get(p, F.lit(i)) for i in range(len(dims))]
        missing = None
        for v in vals:
            z = F.abs(v) <= 1e-8
            missing = z if missing is None else missing & z
        if scale:
            vals = [v * s for v, s in zip(vals, scale)]
        return F.when(~missing, F.struct(*[v.alias(d) for v, d in zip(vals, dims)]))
    return F.transform(arr, one)


def parse_entries(df: DataFrame, entry: str = "e", frame_base: int = 0) -> DataFrame:
    """Typed pose rows from raw entries: joints scaled to original pixels, zero joints NULL."""
    e = F.col(entry)
    ow, oh, rw, rh = (F.coalesce(e["frame_dims"][n], F.lit(d)) for n, d in zip(
        ("original_width", "original_height", "resized_width", "resized_height"), DEFAULT_DIMS))
    b = e["bbox"]
    cam = e["pred_cam_t"]
    rest = [c for c in df.columns if c != entry]
    return df.select(
        *rest, e["track_id"].alias("track_id"), (e["frame"] - frame_base).alias("frame"),
        F.when(b.isNotNull(), F.struct(*[F.get(b, F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])).alias("bbox"),
        _points(e["joints_2d"], "xy", (ow / rw, oh / rh)).alias("joints_2d"),
        *[_points(e[n], "xyz").alias(n) for n in ("shared_space_coords", "normalized_coords", "focal_normalized_coords", "world_coords")],
        e["keypoint_conf"].alias("keypoint_conf"), e["world_coords_reliable"].alias("world_coords_reliable"),
        F.when(cam.isNotNull(), F.struct(*[F.get(cam, F.lit(i)).alias(n) for i, n in enumerate("xyz")])).alias("pred_cam_t"),
        e["focal_length"].alias("focal_length"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole pose documents, one file per recording."""
    d = (spark.read.schema(document).option("multiLine", "true").option("recursiveFileLookup", "true").json(path))
    return with_recording(d)


def document_tracks(docs: DataFrame) -> DataFrame:
    """Pose rows of both tracks; the track id comes from the key, entries may omit it."""
    both = F.array(*[F.struct(F.lit(i).alias("t"), F.col(f"`{i}`").alias("a")) for i in (0, 1)])
    d = docs.select("match_id", "round_id", F.explode(both).alias("x")).select("match_id", "round_id", "x.t", F.explode("x.a").alias("e"))
    d = d.withColumn("e", F.col("e").withField("track_id", F.coalesce("e.track_id", "t"))).drop("t")
    return parse_entries(d)


def document_contacts(docs: DataFrame) -> DataFrame:
    return docs.select("match_id", "round_id", F.explode("contact_events").alias("c")).select("match_id", "round_id", "c.*")


def read_pose_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, one entry per line: splittable, any number of tasks per recording."""
    d = spark.read.schema(raw_entry).option("recursiveFileLookup", "true").json(path)
    return parse_entries(with_recording(d).select("match_id", "round_id", F.struct(*raw_entry.fieldNames()).alias("e")))


def boxes_only(pose: DataFrame) -> DataFrame:
    """Frame and box columns; on Parquet nothing else is read."""
    return pose.select("match_id", "round_id", "track_id", "frame", "bbox")


# ---- actions, labels, contacts

def parse_actions(df: DataFrame, actions: str = "actions") -> DataFrame:
    rest = [c for c in df.columns if c != actions]
    a = df.select(*rest, F.explode(actions).alias("a"))
    fighter = F.coalesce(F.col("a.fighter_type"), F.concat(F.lit("fighter_"), F.coalesce("a.fighter_id", F.lit(0)).cast("string")))
    return a.select(
        *rest, track_of_fighter(fighter).alias("fighter_id"), "a.action", "a.confidence",
        F.coalesce("a.frame", "a.window_start").alias("frame"), "a.window_start", "a.window_end", "a.part",
        F.coalesce("a.timestamp_seconds", F.lit(0.0)).alias("timestamp_seconds"), F.coalesce("a.target", F.lit("Head")).alias("target"),
        F.coalesce("a.is_significant", F.lit(False)).alias("is_significant"),
        F.coalesce("a.speed_estimation.estimated_speed_kmh", F.lit(0.0)).alias("speed_kmh"),
        F.coalesce("a.power_estimation.estimated_power_watts", F.lit(0.0)).alias("power_watts"))


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """Action documents; labelled round files carry match and round in the path too."""
    s = T.StructType([T.StructField("actions", T.ArrayType(raw_action))])
    d = spark.read.schema(s).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    return parse_actions(with_recording(d))


annotation_export = T.StructType([
    T.StructField("labels", T.ArrayType(T.StructType([T.StructField("part", T.StringType()), T.StructField("label", T.StringType()),
                                                      T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("parts", T.ArrayType(T.StructType([T.StructField("part", T.StringType()), T.StructField("frame_count", T.IntegerType()),
                                                     T.StructField("frame_offset", T.IntegerType())])))])


def parse_annotations(df: DataFrame) -> DataFrame:
    """Labels of known parts; start and end are already global, 1-based frames."""
    rest = [c for c in df.columns if c not in ("labels", "parts")]
    known = F.transform("parts", lambda p: p["part"])
    keep = F.filter("labels", lambda l: F.array_contains(known, l["part"]))
    l = df.select(*rest, F.explode(keep).alias("l"))
    return l.select(*rest, F.col("l.label").alias("action"), F.col("l.start").alias("window_start"), F.col("l.end").alias("window_end"),
                    F.col("l.part").alias("part"), F.lit(1.0).alias("confidence"))


def parse_truth(df: DataFrame, annotations: str = "annotations") -> DataFrame:
    rest = [c for c in df.columns if c != annotations]
    a = df.select(*rest, F.explode(annotations).alias("a")).select(*rest, "a.*")
    kind = F.when(F.col("verdict") == "LANDED", "landed").when(F.col("verdict") == "MISS", "missed").otherwise("other")
    return a.withColumn("kind", kind)


def parse_manifest(df: DataFrame, clips: str = "clips", labelled_only: bool = True) -> DataFrame:
    rest = [c for c in df.columns if c != clips]
    c = df.select(*rest, F.explode(clips).alias("c")).select(*rest, "c.*")
    return c.where("label is not null") if labelled_only else c


def read_manifest(spark: SparkSession, path: str, labelled_only: bool = True) -> DataFrame:
    s = T.StructType([T.StructField("fight", T.StringType()), T.StructField("clips", T.ArrayType(raw_clip))])
    return parse_manifest(spark.read.schema(s).option("multiLine", "true").json(path), labelled_only=labelled_only)


SWAP = "stride int, timeline map<string,boolean>"


def parse_swaps(df: DataFrame, value: str = "value") -> DataFrame:
    rest = [c for c in df.columns if c != value]
    d = df.select(*rest, F.from_json(value, SWAP).alias("s"))
    return d.select(*rest, F.col("s.stride").alias("stride"), F.explode("s.timeline").alias("frame", "swapped")).withColumn("frame", F.col("frame").cast("int"))


def parse_verdicts(df: DataFrame, value: str = "value") -> DataFrame:
    rest = [c for c in df.columns if c != value]
    d = df.select(*rest, F.explode(F.from_json(value, "map<string,struct<verdict:string,note:string>>")).alias("frame", "v"))
    return d.select(*rest, F.col("frame").cast("int").alias("frame"), "v.verdict", "v.note")


SCORES = ("score", "impact_score", "sam", "punch_prob", "onset_score")  # fixed values: score fields, first present wins


def reconcile_detections(df: DataFrame, events: str = "events") -> DataFrame:
    """One schema for every detection export: frame and score from the first field present."""
    rest = [c for c in df.columns if c != events]
    e = df.select(*rest, F.explode(events).alias("e")).select(*rest, "e.*")
    have = set(e.columns)
    frame = F.coalesce(*[F.col(c) for c in ("impact_frame", "frame") if c in have])
    score = F.coalesce(*[F.col(c).cast("double") for c in SCORES if c in have])
    drop = [c for c in ("impact_frame", "frame", *SCORES) if c in have]
    return e.withColumn("_f", frame.cast("int")).withColumn("_s", score).drop(*drop).withColumnsRenamed({"_f": "frame", "_s": "score"})


def parse_landmarks(df: DataFrame, value: str = "value") -> DataFrame:
    """frames -> person -> arrays, exploded to one row per (frame, track)."""
    s = ("struct<frames:map<string,map<string,struct<landmarks_2d:array<array<double>>,visibility:array<double>,"
         "uncertainty:array<double>,contact_prob:array<double>>>>>")
    rest = [c for c in df.columns if c != value]
    d = df.select(*rest, F.explode(F.from_json(value, s)["frames"]).alias("frame", "p"))
    d = d.select(*rest, F.col("frame").cast("int").alias("frame"), F.explode("p").alias("track_id", "l"))
    return d.select(*rest, "frame", F.col("track_id").cast("int").alias("track_id"), "l.*")


def registry_lookup(df: DataFrame, registry: DataFrame, key: str = "match_id") -> DataFrame:
    """Attach match settings; an unregistered match is an error."""
    r = registry.withColumn("_known", F.lit(True))
    j = df.join(r, key, "left")
    ok = F.when(F.col("_known"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unregistered match: "), F.col(key).cast("string"))).cast("boolean"))
    return j.where(ok).drop("_known")


# ---- audio and clip files

def read_wav_blocks(spark: SparkSession, path: str, block: int = 65536) -> DataFrame:
    """PCM16 WAV files to mono sample blocks in [-1, 1]; channels are averaged."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, raw in zip(pdf["path"], pdf["content"]):
                rate, channels, data = _wav_data(raw)
                per = block * channels
                for no, off in enumerate(range(0, len(data) // 2, per)):
                    x = np.frombuffer(data, "<i2", count=min(per, len(data) // 2 - off), offset=off * 2).astype(np.float32) / 32768.0
                    yield pd.DataFrame({"recording_id": [p], "block_no": [no], "sr": [rate], "samples": [x.reshape(-1, channels).mean(axis=1)]})

    return files.mapInPandas(decode, "recording_id string, block_no int, sr int, samples array<float>")


def _wav_data(raw: bytes) -> tuple[int, int, memoryview]:
    """(rate, channels, sample bytes) of a RIFF file."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    pos, fmt = 12, None
    while pos + 8 <= len(raw):
        tag, size = raw[pos:pos + 4], struct.unpack_from("<I", raw, pos + 4)[0]
        if tag == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", raw, pos + 8)
            if bits != 16:
                raise ValueError("only 16-bit PCM is supported")
            fmt = (rate, channels)
        if tag == b"data":
            return fmt[0], fmt[1], memoryview(raw)[pos + 8:pos + 8 + size]
        pos += 8 + size + size % 2
    raise ValueError("no data chunk")


def labelled_clips(files: DataFrame, path: str = "path") -> DataFrame:
    """Clip label, time and frame from the file path; a punch/ copy overrides a not_punch/ one."""
    p = F.col(path)
    name = F.element_at(F.split(p, "/"), -1)
    label = F.when(p.contains("/not_punch/"), "not_punch").when(p.contains("/punch/"), "punch")
    t = F.coalesce(F.regexp_extract(name, CLIP_TIME, 1).try_cast("int"), F.lit(0)) * 60 + F.regexp_extract(name, CLIP_TIME, 2).try_cast("double")
    d = files.select(name.alias("clip"), label.alias("label"), t.alias("time_sec"), F.regexp_extract(name, CLIP_FRAME, 1).try_cast("int").alias("frame")).where("label is not null")
    pick = F.min(F.struct((F.col("label") != "punch").alias("o"), "label", "time_sec", "frame")).alias("b")
    return d.groupBy("clip").agg(pick).select("clip", "b.label", "b.time_sec", "b.frame")
