"""Suppression queries (survey group D)."""
from __future__ import annotations

from pyspark.sql import functions as F

from contactflow.operators import suppress as S
from contactflow.plans.q_gates import nms_sql
from contactflow.plans.registry import query
from contactflow.sources import adapters as A

KEYS = ["match_id", "round_id"]


@query("score_greedy_nms", "WITH " + nms_sql("det", 18) + " SELECT d.det_id, d.match_id, d.round_id, d.frame, round(d.score,6) AS score FROM det d SEMI JOIN ids USING (det_id)")
def _(spark, sf):
    d = S.greedy_nms(A.detections(spark, sf), KEYS, "frame", "score", 18, tie="det_id")
    return d.select("det_id", *KEYS, "frame", F.round("score", 6).alias("score"))


FIRST_FIT = """ord AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY frame, {t}) AS rk FROM {src}),
  run AS (SELECT {k}, rk, frame AS last, {t}, true AS keep FROM ord WHERE rk = 1
    UNION ALL SELECT {ok}, o.rk, CASE WHEN o.frame - r.last >= {cd} THEN o.frame ELSE r.last END, o.{t}, o.frame - r.last >= {cd}
    FROM run r JOIN ord o ON {jk} AND o.rk = r.rk + 1)"""


def first_fit_sql(src, cd, tie="det_id", keys=("match_id", "round_id")):
    return FIRST_FIT.format(src=src, cd=cd, t=tie, k=", ".join(keys), ok=", ".join(f"o.{k}" for k in keys),
                            jk=" AND ".join(f"o.{k} = r.{k}" for k in keys))


@query("first_fit_cooldown", "WITH " + first_fit_sql("det", 15) + " SELECT d.det_id, d.match_id, d.round_id, d.frame FROM det d JOIN run r ON d.det_id=r.det_id WHERE r.keep")
def _(spark, sf):
    return S.first_fit(A.detections(spark, sf), KEYS, "frame", 15, tie=["det_id"]).select("det_id", *KEYS, "frame")


def pair_sql(src, pair, pc, gc, frame="frame"):
    """State per recording: last accepted frame, and last per pair in a map."""
    return f"""ord AS (SELECT *, {pair} AS p, {frame} AS ff, row_number() OVER (PARTITION BY match_id, round_id ORDER BY {frame}, {pair}, det_id) AS rk FROM {src}),
  run AS (SELECT match_id, round_id, rk, det_id, true AS keep, ff AS g, map([p],[ff]) AS m FROM ord WHERE rk = 1
    UNION ALL SELECT match_id, round_id, rk, det_id, ok, CASE WHEN ok THEN ff ELSE g END,
      CASE WHEN ok THEN map_from_entries(list_append(list_filter(map_entries(m), lambda e: e.key <> p), {{'key': p, 'value': ff}})) ELSE m END
    FROM (SELECT o.match_id, o.round_id, o.rk, o.det_id, o.p, o.ff, r.g, r.m, o.ff - r.g >= {gc} AND coalesce(o.ff - r.m[o.p] >= {pc}, true) AS ok
          FROM run r JOIN ord o ON o.match_id=r.match_id AND o.round_id=r.round_id AND o.rk=r.rk+1))"""


@query("pair_global_cooldown", "WITH " + pair_sql("det", "CAST(least(striker_id,receiver_id) AS VARCHAR) || '-' || CAST(greatest(striker_id,receiver_id) AS VARCHAR)", 30, 20)
       + " SELECT d.det_id, d.match_id, d.round_id, d.frame FROM det d JOIN run r ON d.det_id=r.det_id WHERE r.keep")
def _(spark, sf):
    d = S.pair_global_cooldown(A.detections(spark, sf), KEYS, "frame", S.unordered_pair("striker_id", "receiver_id"),
                               pair_cooldown=30, global_cooldown=20, tie=["det_id"])
    return d.select("det_id", *KEYS, "frame")


@query("directed_pair_cooldown", "WITH " + pair_sql("det", "CAST(striker_id AS VARCHAR)", 30, 10)
       + " SELECT d.det_id, d.match_id, d.round_id, d.frame FROM det d JOIN run r ON d.det_id=r.det_id WHERE r.keep")
def _(spark, sf):
    d = S.pair_global_cooldown(A.detections(spark, sf), KEYS, "frame", F.col("striker_id").cast("string"),
                               pair_cooldown=30, global_cooldown=10, tie=["det_id"])
    return d.select("det_id", *KEYS, "frame")


@query("countdown_cooldown", "WITH st AS (SELECT *, frame // 2 AS step FROM det WHERE frame % 2 = 0), "
       + pair_sql("st", "CAST(least(striker_id,receiver_id) AS VARCHAR) || '-' || CAST(greatest(striker_id,receiver_id) AS VARCHAR)", 31, 20, "step")
       + " SELECT d.det_id, d.match_id, d.round_id, d.frame FROM det d JOIN run r ON d.det_id=r.det_id WHERE r.keep")
def _(spark, sf):
    # every second frame is processed; the countdown ticks once per processed step
    d = A.detections(spark, sf).where(F.pmod("frame", F.lit(2)) == 0).withColumn("step", (F.col("frame") / 2).cast("int"))
    d = S.pair_global_cooldown(d, KEYS, "step", S.unordered_pair("striker_id", "receiver_id"),
                               pair_cooldown=31, global_cooldown=20, tie=["det_id"])
    return d.select("det_id", *KEYS, "frame")


@query("radius_dedup", "WITH gc AS (SELECT match_id, round_id, action_id, CAST(unnest(range(greatest(0, window_start), window_end + 1, 2)) AS INTEGER) AS frame, -CAST(action_id AS DOUBLE) AS pri, action_id*100000 AS cid0 FROM act), "
       "gd AS (SELECT *, cid0 + frame AS cid FROM gc), " + nms_sql("gd", 9, score="pri", tie="cid") + " SELECT g.action_id, g.match_id, g.round_id, g.frame FROM gd g SEMI JOIN ids USING (cid)")
def _(spark, sf):
    # kept earlier in (action, frame) order wins; exactly the radius (8) still drops
    from contactflow.operators.candidates import window_grid
    c = window_grid(A.actions(spark, sf), stride=2, pad=0).withColumn("pri", -F.col("action_id").cast("double"))
    return S.greedy_nms(c, KEYS, "frame", "pri", 8 + 1, tie="action_id").select("action_id", *KEYS, "frame")


@query("best_per_window", """SELECT match_id, round_id, action_id, det_id, round(score,6) AS score FROM (
  SELECT a.match_id, a.round_id, a.action_id, d.det_id, d.score, row_number() OVER (PARTITION BY a.action_id ORDER BY d.score DESC, d.frame, d.det_id) AS rn
  FROM act a JOIN det d ON a.match_id=d.match_id AND a.round_id=d.round_id AND d.frame BETWEEN a.window_start AND a.window_end WHERE d.score IS NOT NULL) WHERE rn = 1""")
def _(spark, sf):
    from contactflow.operators.joins import interval_join
    per_frame = A.detections(spark, sf).where("score is not null").groupBy(*KEYS, "frame").agg(  # a missing score never wins
        F.min(F.struct((-F.col("score")).alias("ns"), "det_id")).alias("b"))
    j = interval_join(A.actions(spark, sf), per_frame, KEYS, start="window_start", end="window_end", before=0, after=0)
    best = j.groupBy(*KEYS, "action_id").agg(F.min(F.struct("b.ns", "frame", "b.det_id")).alias("w"))
    return best.select(*KEYS, "action_id", "w.det_id", F.round(-F.col("w.ns"), 6).alias("score"))
