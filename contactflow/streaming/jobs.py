"""Structured Streaming forms of the live operators.

Event time is the frame's wall-clock time. Rows later than the watermark are
dropped; cooldowns count event-time frames, not processed rows. A recording's state is
removed once the watermark has passed its last row by IDLE. Recordings share the calls and the
state rows of their shard.
"""
from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from contactflow.session import ensure_checkpoint_dir


#: Lateness that keyed state allows for, and how long a silent recording's state is kept (longer than any cooldown).
DELAY, IDLE = "2 hours", 10 * 24 * 3600 * 1000


def _timed(stream: DataFrame, delay: str) -> DataFrame:
    return stream.withColumn("_ms", F.unix_millis("ts")).withWatermark("ts", delay)


#: Keyed state is held by shards of recordings: a call of Python costs milliseconds whatever it does, a recording only its rows.
#: A shard's state is its live recordings, so more shards make smaller states and more calls.
SHARDS = 1024
_RECORDING = "_m long, _r int, _z int"


def sharded(stream: DataFrame, shards: int, *extra: str) -> DataFrame:
    """The stream keyed by recording: match and round as _m and _r, with their missing values as bits in _z, and a shard number.
    Rows without a frame have no place in a recording and are left out."""
    null = lambda c, bit: F.when(F.col(c).isNull(), bit).otherwise(0)
    d = stream.where(F.col("frame").isNotNull()).withColumn("_m", F.coalesce("match_id", F.lit(0)).cast("long")).withColumn("_r", F.coalesce("round_id", F.lit(0)).cast("int"))
    d = d.withColumn("_z", (null("match_id", 1) + null("round_id", 2)).cast("int"))
    return d.withColumn("_shard", F.pmod(F.xxhash64("_m", "_r", "_z", *extra), F.lit(shards)).cast("int"))


def recordings(out: DataFrame) -> DataFrame:
    """match_id and round_id again in place of _m, _r and _z."""
    rest = [c for c in out.columns if c not in ("_m", "_r", "_z")]
    return out.select(F.when(F.col("_z").bitwiseAND(1) == 0, F.col("_m")).alias("match_id"), F.when(F.col("_z").bitwiseAND(2) == 0, F.col("_r")).alias("round_id"), *rest)


def runs_of(rows: pd.DataFrame, keys: Sequence[str]) -> Iterator[tuple[tuple, int, int]]:
    """(key, first row, row after the last) of every key; rows are sorted by the keys."""
    columns = [rows[k].to_numpy() for k in keys]
    new = np.zeros(len(rows), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    ends = [*starts[1:].tolist(), len(rows)]
    return zip(zip(*[c[starts].tolist() for c in columns]), starts.tolist(), ends)


def held(state: GroupState, keys: int, idle: int | None = None) -> dict[tuple, tuple]:
    """A shard's state by key: parallel arrays, of which the first ``keys`` are the key. With idle, the last array holds each key's newest
    time, and keys that have ended are left out. (Rows of a batch come before its timers.)"""
    if not state.exists:
        return {}
    now = None if idle is None else state.getCurrentWatermarkMs()
    return {row[:keys]: row[keys:] for row in zip(*state.get) if now is None or row[-1] + idle > now}


def hold(state: GroupState, known: dict[tuple, tuple], width: int, idle: int | None = None) -> None:
    """Keeps what is known by key (``width`` arrays in all); with idle, a timer in event time for the key that ends first (one that has passed
    already is set to fire at the next watermark)."""
    if not known and idle is not None:
        state.remove()
        return
    state.update(tuple(map(list, zip(*[(*k, *v) for k, v in known.items()]))) if known else tuple([] for _ in range(width)))
    if idle is not None:
        state.setTimeoutTimestamp(max(min(v[-1] for v in known.values()) + idle, state.getCurrentWatermarkMs() + 1))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, name: str, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """Process everything available, then read the sink's table.

    In update mode each batch writes only its changed rows, in a folder of its own (a
    repeated batch replaces it); the last version of every key is read.
    """
    spark = stream.sparkSession
    out, ckpt = scratch(spark, name), scratch(spark, name + "-ckpt")
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", out).start()
    elif mode == "update":
        spark.createDataFrame([], stream.schema).write.parquet(f"{out}/batch=-1")
        q = w.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")).start()
        q.awaitTermination()
        rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(out)
        rest = [c for c in stream.columns if c not in keys]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
        return last.select(*[F.col(c) if c in keys else F.col(f"_r.{c}") for c in stream.columns])
    else:
        q = w.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def utc_instant(ts: str) -> Column:
    """A zone-less timestamp read as UTC, whatever the session's time zone."""
    day = F.datediff(F.col(ts).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    clock = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long")
    second = F.expr(f"extract(second from {ts})")
    return F.timestamp_micros((day * 86400 + clock) * 1000000 + (second * 1000000).cast("long"))


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream, on the same frame axis as the batch adapter."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a glob serves a single file and a folder of part files alike
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    h = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")
    return e.select("event_id", F.col("user_id").alias("match_id"), F.floor(h / 240).cast("int").alias("round_id"),
                    F.pmod(h, F.lit(240)).cast("int").alias("frame"), "event_type", "value",
                    utc_instant("ts").alias("ts"))


# ---- two-level cooldown

COOLDOWN_STATE = "m array<long>, r array<int>, z array<int>, g array<int>, pairs array<array<string>>, last array<array<int>>, ms array<long>"


def cooldown_events(stream: DataFrame, pair_cooldown: int, global_cooldown: int, delay: str = DELAY, idle: int = IDLE, shards: int = SHARDS) -> DataFrame:
    """Contacts that pass the per-pair and the global cooldown, per recording.

    Input columns: match_id, round_id, frame, pair, det_id, ts. idle: milliseconds without a row after which a recording
    has ended and its state goes; a row that comes later still starts it anew.
    """
    keys = ["_m", "_r", "_z"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = held(state, 3, idle)
        if state.hasTimedOut:
            hold(state, known, 7, idle)
            return
        rows = pd.concat(list(batches)).sort_values([*keys, "frame", "pair", "det_id"], kind="stable")
        frames, pairs, ms = (rows[c].tolist() for c in ("frame", "pair", "_ms"))
        keep = []
        for k, a, b in runs_of(rows, keys):
            g, names, last, _ = known.get(k, (None, (), (), 0))
            seen = dict(zip(names, last))
            for i in range(a, b):
                f, p = frames[i], pairs[i]
                if (g is None or f - g >= global_cooldown) and (p not in seen or f - seen[p] >= pair_cooldown):
                    g = seen[p] = int(f)
                    keep.append(i)
            # a pair past its cooldown no longer matters
            seen = {p: f for p, f in seen.items() if g - f < pair_cooldown}
            known[k] = (g, list(seen), list(seen.values()), int(max(ms[a:b])))
        hold(state, known, 7, idle)
        yield rows.iloc[keep][[*keys, "frame", "det_id"]]

    return recordings(sharded(_timed(stream, delay), shards).groupBy("_shard").applyInPandasWithState(
        step, f"{_RECORDING}, frame int, det_id long", COOLDOWN_STATE, "append", GroupStateTimeout.EventTimeTimeout))


# ---- joins and windows

def window_frame_join(actions: DataFrame, frames: DataFrame, before_h: int, after_h: int, delay: str = "2 hours") -> DataFrame:
    """Stream-stream join: frames of the acting side inside each padded action window."""
    a = actions.withWatermark("start_ts", delay).alias("a")
    f = frames.withWatermark("ts", delay).alias("f")
    cond = F.expr(f"""a.match_id = f.match_id and a.fighter_id = f.track_id
        and f.ts >= a.start_ts - interval {before_h} hours and f.ts <= a.end_ts + interval {after_h} hours""")
    return a.join(f, cond).select("a.action_id", F.col("f.event_id"))


def tumbling_counts(stream: DataFrame, size: str, delay: str = "1 hour") -> DataFrame:
    return (stream.withWatermark("ts", delay).groupBy(F.window("ts", size), "match_id")
            .agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("max_value"))
            .select("match_id", F.unix_seconds("window.start").alias("start_sec"), "n", "max_value"))


def combos(stream: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    """Session windows: runs of detections no further apart than the gap (append or complete mode: sessions cannot be updated)."""
    return (stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "match_id")
            .agg(F.count(F.lit(1)).alias("n"))
            .select("match_id", F.unix_seconds("session_window.start").alias("start_sec"), "n"))


def running_counters(stream: DataFrame) -> DataFrame:
    """Running totals per recording and event type."""
    return stream.groupBy("match_id", "round_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("max_value"))


# ---- previous-row state

STEP_STATE = "m array<long>, r array<int>, z array<int>, t array<long>, last array<double>, frame array<int>, ms array<long>"


def value_steps(stream: DataFrame, delay: str = DELAY, idle: int = IDLE, shards: int = SHARDS) -> DataFrame:
    """Change of a track's value since its previous sample, the last one kept as state until the track falls silent for ``idle``.

    A row that comes after rows with later frames were processed has no step: its predecessor is gone."""
    keys = ["_m", "_r", "_z", "track_id"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = held(state, 4, idle)
        if state.hasTimedOut:
            hold(state, known, 7, idle)
            return
        rows = pd.concat(list(batches)).sort_values([*keys, "frame", "event_id"], kind="stable")
        frames, ms, values = rows["frame"].tolist(), rows["_ms"].tolist(), rows["value"].to_numpy(dtype=float).tolist()
        steps = [math.nan] * len(rows)
        for k, a, b in runs_of(rows, keys):
            last, frame, seen = known.get(k, (math.nan, None, 0))
            begun = frame
            for i in range(a, b):
                if begun is None or frames[i] >= begun:
                    steps[i] = values[i] - last
                    last, frame = values[i], int(frames[i])
            known[k] = (last, frame, int(max(max(ms[a:b]), seen)))
        hold(state, known, 7, idle)
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "step": steps})

    return sharded(_timed(stream, delay), shards, "track_id").groupBy("_shard").applyInPandasWithState(
        step, "event_id long, step double", STEP_STATE, "append", GroupStateTimeout.EventTimeTimeout)
