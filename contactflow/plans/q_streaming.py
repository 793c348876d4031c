"""Streaming queries (survey group ST): run over everything available, result read from the sink."""
from __future__ import annotations

from pyspark.sql import functions as F

from contactflow.operators.suppress import pair_global_cooldown
from contactflow.plans.q_suppress import pair_sql
from contactflow.plans.registry import query
from contactflow.sources import adapters as A
from contactflow.streaming import jobs as J
from contactflow.streaming import tracker as T

KEYS = ["match_id", "round_id"]
_PAIR = "CAST(least(striker_id,receiver_id) AS VARCHAR) || '-' || CAST(greatest(striker_id,receiver_id) AS VARCHAR)"


def stream(spark, sf, *types):
    e = J.read_events(spark, sf)
    return e.where(F.col("event_type").isin(*types)) if types else e


@query("streaming_cooldown_events", "WITH " + pair_sql("det", "CAST(striker_id AS VARCHAR)", 30, 10) + " SELECT d.match_id, d.round_id, d.frame, d.det_id FROM det d JOIN run r ON d.det_id=r.det_id WHERE r.keep")
def _(spark, sf):
    d = stream(spark, sf, "click").select(*KEYS, "frame", F.pmod("event_id", F.lit(2)).cast("string").alias("pair"), F.col("event_id").alias("det_id"), "ts")
    return J.drain(J.cooldown_events(d, 30, 10), "cooldown")


@query("streaming_window_join", """SELECT a.event_id AS action_id, f.event_id FROM events a JOIN events f ON a.user_id=f.user_id AND a.event_id%2=f.event_id%2 AND f.ts BETWEEN a.ts - INTERVAL 5 HOUR AND a.ts + INTERVAL 9 HOUR WHERE a.event_type='purchase' AND f.event_type='view'""")
def _(spark, sf):
    side = F.pmod("event_id", F.lit(2))
    a = stream(spark, sf, "purchase").select("match_id", side.alias("fighter_id"), F.col("event_id").alias("action_id"), F.expr("ts - interval 2 hours").alias("start_ts"), F.expr("ts + interval 4 hours").alias("end_ts"))
    f = stream(spark, sf, "view").select("match_id", side.alias("track_id"), "event_id", "ts")
    return J.drain(J.window_frame_join(a, f, 3, 5), "winjoin")


@query("streaming_round_counters", "SELECT user_id AS match_id, CAST(floor(epoch(ts)/21600)*21600 AS BIGINT) AS start_sec, count(*) AS n, max(value) AS max_value FROM events GROUP BY ALL")
def _(spark, sf):
    return J.drain(J.tumbling_counts(stream(spark, sf), "6 hours"), "tumbling", "update", ["match_id", "start_sec"])


@query("streaming_combos", """WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 HOUR THEN 0 ELSE 1 END AS b FROM events WHERE event_type='click' WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM o)
  SELECT user_id AS match_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_sec, count(*) AS n FROM g GROUP BY user_id, s""")
def _(spark, sf):
    return J.drain(J.combos(stream(spark, sf, "click"), "10 hours"), "combos", "complete")


@query("streaming_running_counters", "SELECT match_id, round_id, event_type, count(*) AS n, max(value) AS max_value FROM hev GROUP BY ALL")
def _(spark, sf):
    return J.drain(J.running_counters(stream(spark, sf)), "counters", "update", [*KEYS, "event_type"])


@query("streaming_value_steps", """SELECT event_id, round(value-lag(value) OVER (PARTITION BY match_id, round_id, event_id%2 ORDER BY frame, event_id),6) AS step FROM hev WHERE event_type='view'""")
def _(spark, sf):
    e = stream(spark, sf, "view").select(*KEYS, F.pmod("event_id", F.lit(2)).cast("int").alias("track_id"), "frame", "event_id", "value", "ts")
    d = J.drain(J.value_steps(e), "steps")
    return d.select("event_id", F.round(F.when(~F.isnan("step"), F.col("step")), 6).alias("step"))


def boxes_of(e):
    """Every event as the box of a detected person."""
    y1 = F.pmod(F.col("event_id") * 37, F.lit(101)).cast("double")
    return e.select(*KEYS, "frame", F.col("event_id").alias("det_id"), F.col("value").alias("x1"), y1.alias("y1"),
                    (F.col("value") + 80).alias("x2"), (y1 + 120).alias("y2"))


@query("track_assignment")
def _(spark, sf):
    return T.track_batch(boxes_of(A.events(spark, sf)), KEYS).select("det_id", *KEYS, "frame", "track_id")


@query("streaming_track_assignment")
def _(spark, sf):
    # sixteen cameras film a match: each is a stream of its own
    e = stream(spark, sf).withColumn("round_id", (F.col("round_id") * 16 + F.pmod("event_id", F.lit(16))).cast("int"))
    d = J.drain(T.track_stream(boxes_of(e)), "tracks")
    return d.select("det_id", "match_id", F.floor(F.col("round_id") / 16).cast("int").alias("round_id"), F.pmod("round_id", F.lit(16)).alias("camera_id"), "frame", "track_id")


@query("streaming_fighter_selection")
def _(spark, sf):
    e = boxes_of(stream(spark, sf)).withColumn("track_id", F.pmod("det_id", F.lit(5)).cast("int"))
    return J.drain(T.select_fighters_stream(e), "fighters")


@query("live_chain_replay")
def _(spark, sf):
    """Batch replay of the live chain: track, keep the two largest per frame, pair, cool down."""
    from pyspark.sql import Window
    t = T.track_batch(boxes_of(A.events(spark, sf)), KEYS)
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    # one box per (frame, track), then at most two per frame: both reductions combine map-side
    t = t.groupBy(*KEYS, "frame", "track_id").agg(
        F.max(F.struct(area.alias("area"), "det_id", "x1", "y1", "x2", "y2")).alias("b"))
    a = t.groupBy(*KEYS, "frame").agg(F.max(F.struct("b.area", "track_id", "b")).alias("first"))
    rest = t.join(a, [*KEYS, "frame"]).where(F.col("track_id") != F.col("first.track_id")).groupBy(*KEYS, "frame").agg(
        F.max(F.struct("b.area", "track_id", "b")).alias("second"), F.max("first").alias("first"))
    p = rest.select(*KEYS, "frame", F.col("first.track_id").alias("striker_id"), F.col("second.track_id").alias("receiver_id"), F.col("first.b.det_id").alias("det_id"))
    pair = F.concat_ws("-", F.least("striker_id", "receiver_id").cast("string"), F.greatest("striker_id", "receiver_id").cast("string"))
    k = pair_global_cooldown(p, KEYS, "frame", pair, pair_cooldown=31, global_cooldown=20, tie=["det_id"])
    return k.select(*KEYS, "frame", "striker_id", "receiver_id", "det_id")
