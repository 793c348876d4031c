"""Report (group R), window (group W) and filter queries on the event domain."""
from __future__ import annotations

from pyspark.sql import functions as F

from contactflow.functions import geometry as G
from contactflow.functions import scoring as SC
from contactflow.operators import gates as GA
from contactflow.operators import joins as J
from contactflow.operators import smoothing as SM
from contactflow.operators.ordering import blocked, densify, forward_fill, previous_row, row_number, running_sum
from contactflow.operators.ranking import exact_quantiles, ranked
from contactflow.operators.suppress import first_fit
from contactflow.plans.q_candidates import clip_rows, features
from contactflow.plans.q_gates import hot
from contactflow.plans.q_geometry import BK, PK, pairs, r6
from contactflow.plans.q_suppress import FIRST_FIT
from contactflow.plans.registry import query, view
from contactflow.plans.sqltext import HX, HY, HZ, PAIR, PKEY, P, X, Y, Z, hyp
from contactflow.session import cut_lineage
from contactflow.sources import adapters as A

KEYS = ["match_id", "round_id"]
TK = "match_id, round_id, track_id, frame"


@query("landing_summary", """SELECT match_id, count(*) AS total, count_if(score>=0.1)::BIGINT AS landed, count_if(score<0.1)::BIGINT AS missed, round(count_if(score>=0.1)/count(*),6) AS rate,
  round(coalesce(avg(score) FILTER (score>=0.1),0),6) AS avg_landed FROM det GROUP BY match_id""")
def _(spark, sf):
    hit = F.col("score") >= 0.1
    return A.detections(spark, sf).groupBy("match_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("landed"), F.count_if(~hit).alias("missed"),
        F.round(F.count_if(hit) / F.count(F.lit(1)), 6).alias("rate"),
        F.round(F.coalesce(F.avg(F.when(hit, F.col("score"))), F.lit(0.0)), 6).alias("avg_landed"))


@query("action_type_summary", """SELECT coalesce(action,'ALL') AS action, count(*) AS total, count_if(confidence>=0.3)::BIGINT AS landed, count_if(confidence<0.3)::BIGINT AS missed FROM act GROUP BY ROLLUP(action)""")
def _(spark, sf):
    hit = F.col("confidence") >= 0.3
    g = A.actions(spark, sf).rollup("action").agg(F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("landed"), F.count_if(~hit).alias("missed"))
    return g.withColumn("action", F.coalesce("action", F.lit("ALL")))


@query("region_receiver_heatmap", """WITH c AS (SELECT contact_region, receiver_id, count(*) AS n FROM ce GROUP BY ALL) SELECT contact_region, sum(n)::BIGINT AS total, sum(n) FILTER (receiver_id=0)::BIGINT AS receiver_0,
  sum(n) FILTER (receiver_id=1)::BIGINT AS receiver_1, max(n) AS max_cell, arg_max(receiver_id, n*10-receiver_id) AS dominant FROM c GROUP BY contact_region""")
def _(spark, sf):
    c = A.contacts(spark, sf).groupBy("contact_region", "receiver_id").agg(F.count(F.lit(1)).alias("n"))
    side = lambda i: F.sum(F.when(F.col("receiver_id") == i, F.col("n"))).alias(f"receiver_{i}")
    return c.groupBy("contact_region").agg(F.sum("n").alias("total"), side(0), side(1), F.max("n").alias("max_cell"),
                                           F.min(F.struct((-F.col("n")).alias("k"), "receiver_id"))["receiver_id"].alias("dominant"))


@query("region_mix", "SELECT match_id, contact_region, count(*) AS n FROM ce GROUP BY ALL")
def _(spark, sf):
    return A.contacts(spark, sf).groupBy("match_id", "contact_region").agg(F.count(F.lit(1)).alias("n"))


@query("hit_and_strike_maps", """SELECT match_id, striker_id AS fighter_id, 'strike' AS kind, contact_region AS region, count(*) AS n FROM ce GROUP BY ALL
  UNION ALL SELECT match_id, receiver_id, 'hit', contact_region, count(*) FROM ce GROUP BY ALL""")
def _(spark, sf):
    roles = F.explode(F.array(F.struct(F.col("striker_id").alias("f"), F.lit("strike").alias("k")), F.struct(F.col("receiver_id").alias("f"), F.lit("hit").alias("k")))).alias("x")
    return (A.contacts(spark, sf).select("match_id", F.col("contact_region").alias("region"), roles)
            .groupBy("match_id", F.col("x.f").alias("fighter_id"), F.col("x.k").alias("kind"), "region").agg(F.count(F.lit(1)).alias("n")))


@query("approach_comparison", """SELECT approach, count(*) AS total, count_if(s>=0.2)::BIGINT AS landed, round(count_if(s>=0.2)/count(*),6) AS rate FROM (
  SELECT 'evidence' AS approach, 0.5*ce+0.5*audio AS s FROM ft UNION ALL SELECT 'action', conf FROM ft UNION ALL SELECT 'raw', score FROM ft) GROUP BY approach""")
def _(spark, sf):
    rows = F.array(F.struct(F.lit("evidence").alias("approach"), (0.5 * F.col("ce") + 0.5 * F.col("audio")).alias("s")),
                   F.struct(F.lit("action").alias("approach"), F.col("conf").alias("s")), F.struct(F.lit("raw").alias("approach"), F.col("score").alias("s")))
    d = features(spark, sf).select(F.explode(rows).alias("x")).select("x.*")
    return d.groupBy("approach").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("s") >= 0.2).alias("landed"),
                                     F.round(F.count_if(F.col("s") >= 0.2) / F.count(F.lit(1)), 6).alias("rate"))


@query("cross_person_depth_audit", f"""SELECT match_id, count(*) AS n, round(avg(g),6) AS mean_gap, round(quantile_cont(g,0.5),6) AS median_gap, round(quantile_cont(g,0.9),6) AS p90_gap, round(max(g),6) AS max_gap,
  round(avg((g>0.15)::INT),6) AS share_large, round(avg(reliable::INT),6) AS share_reliable FROM (SELECT s.match_id, s.label <> 9 AND r.label <> 9 AS reliable, abs(({HZ('s')})-({HZ('r')})) AS g FROM {PAIR} AND s.track_id < r.track_id) GROUP BY match_id""")
def _(spark, sf):
    h = lambda a: G.centroid(F.col(f"{a}.joints"), A.PROFILE.head, "xyz")["z"]
    g = pairs(spark, sf).where("striker_id < receiver_id").select("match_id", F.abs(h("s") - h("r")).alias("g"), ((F.col("s.label") != 9) & (F.col("r.label") != 9)).alias("reliable"))
    a = g.groupBy("match_id").agg(F.round(F.avg("g"), 6).alias("mean_gap"), F.round(F.max("g"), 6).alias("max_gap"),
                                  F.round(F.avg((F.col("g") > 0.15).cast("int")), 6).alias("share_large"),
                                  F.round(F.avg(F.col("reliable").cast("int")), 6).alias("share_reliable"))  # bodies labelled 9 have unreliable coordinates
    q = exact_quantiles(g, ["match_id"], "g", {"median_gap": 0.5, "p90_gap": 0.9})
    return a.join(q, "match_id").select("match_id", "n", "mean_gap", r6(F.col("median_gap"), "median_gap"), r6(F.col("p90_gap"), "p90_gap"), "max_gap", "share_large", "share_reliable")


@query("confidence_placeholder_audit", """SELECT label, count(*) AS n, round(min(c),6) AS min_conf, round(avg(c),6) AS mean_conf, round(max(c),6) AS max_conf, round(avg((c<0.01)::INT),6) AS share_low,
  avg((c<0.01)::INT) < 0.02 AS placeholder FROM (SELECT label, abs(unnest(e)) AS c FROM pz) GROUP BY label""")
def _(spark, sf):
    e = A.table(spark, sf, "embeddings").select("label", F.explode("embedding").alias("v")).select("label", F.abs(F.col("v").cast("double")).alias("c"))
    low = (F.col("c") < 0.01).cast("int")
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("c"), 6).alias("min_conf"), F.round(F.avg("c"), 6).alias("mean_conf"),
                                  F.round(F.max("c"), 6).alias("max_conf"), F.round(F.avg(low), 6).alias("share_low"), (F.avg(low) < 0.02).alias("placeholder"))


@query("contact_event_profile", """SELECT match_id, count(*) AS n, count_if(contact_prob>0.5)::BIGINT AS over_50, count_if(contact_prob>0.3)::BIGINT AS over_30, round(quantile_cont(contact_3d_distance_m,0.5),6) AS median_dist,
  count(DISTINCT contact_region) AS n_regions FROM ce GROUP BY match_id""")
def _(spark, sf):
    c = A.contacts(spark, sf)
    # the six regions bound the distinct set
    a = c.groupBy("match_id").agg(F.count_if(F.col("contact_prob") > 0.5).alias("over_50"), F.count_if(F.col("contact_prob") > 0.3).alias("over_30"),
                                  F.size(F.collect_set("contact_region")).cast("long").alias("n_regions"))
    q = exact_quantiles(c, ["match_id"], "contact_3d_distance_m", {"median_dist": 0.5})
    return a.join(q, "match_id").select("match_id", "n", "over_50", "over_30", r6(F.col("median_dist"), "median_dist"), "n_regions")


@query("gate_separation", """WITH l AS (SELECT f.*, EXISTS (SELECT 1 FROM gt g WHERE g.match_id=f.match_id AND g.round_id=f.round_id AND abs(g.frame-f.frame)<=15) AS landed FROM ft f),
  u AS (SELECT landed, unnest(['conf','ce','audio','score']) AS gate, unnest([conf,ce,audio,score]) AS v FROM l)
  SELECT gate, round(avg(v) FILTER (landed),6) AS landed_mean, round(avg(v) FILTER (NOT landed),6) AS other_mean, round(avg(v) FILTER (landed)-avg(v) FILTER (NOT landed),6) AS separation, round(min(v),6) AS min_v, round(max(v),6) AS max_v FROM u GROUP BY gate""")
def _(spark, sf):
    f = J.matched_in_band(features(spark, sf), A.truth(spark, sf), KEYS, left_on="frame", right_on="frame", lo=-15, hi=15)
    u = f.select("matched", F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).alias("v")) for g in ("conf", "ce", "audio", "score")])).alias("x")).select("matched", "x.*")
    yes, no = F.avg(F.when(F.col("matched"), F.col("v"))), F.avg(F.when(~F.col("matched"), F.col("v")))
    return u.groupBy("gate").agg(r6(yes, "landed_mean"), r6(no, "other_mean"), r6(yes - no, "separation"), r6(F.min("v"), "min_v"), r6(F.max("v"), "max_v"))


@query("part_boundaries", """WITH p AS (SELECT match_id, track_id, (round_id*240+frame)//60 AS part, count(*) AS frame_count FROM box GROUP BY ALL)
  SELECT match_id, track_id, part::BIGINT AS part, frame_count, (sum(frame_count) OVER w - frame_count)::BIGINT AS frame_offset, (sum(frame_count) OVER w - frame_count + 1)::BIGINT AS range_start, (sum(frame_count) OVER w)::BIGINT AS range_end FROM p WINDOW w AS (PARTITION BY match_id, track_id ORDER BY part)""")
def _(spark, sf):
    b = A.boxes(spark, sf).withColumn("part", F.floor((F.col("round_id") * 240 + F.col("frame")) / 60))
    p = b.groupBy("match_id", "track_id", "part").agg(F.count(F.lit(1)).alias("frame_count"))
    p = running_sum(p, ["match_id", "track_id"], "part", "frame_count", "frame_offset", inclusive=False)
    return p.select("match_id", "track_id", "part", "frame_count", "frame_offset", (F.col("frame_offset") + 1).alias("range_start"), (F.col("frame_offset") + F.col("frame_count")).alias("range_end"))


@query("chunk_crop_window", """SELECT match_id, round_id, track_id, frame//60 AS chunk, greatest(0, trunc(cx-w*0.75))::INTEGER AS wx1, greatest(0, trunc(cy-h*0.75))::INTEGER AS wy1, least(640, trunc(cx+w*0.75))::INTEGER AS wx2, least(360, trunc(cy+h*0.75))::INTEGER AS wy2 FROM (
  SELECT match_id, round_id, track_id, min(frame) AS frame, median((x1+x2)/2) AS cx, median((y1+y2)/2) AS cy, median(x2-x1) AS w, median(y2-y1) AS h FROM box GROUP BY match_id, round_id, track_id, frame//60)""")
def _(spark, sf):
    b = F.col("bbox")
    # a chunk holds at most 60 frames of a track, so the medians' state is bounded
    g = A.boxes(spark, sf).groupBy(*KEYS, "track_id", F.floor(F.col("frame") / 60).cast("int").alias("chunk")).agg(
        F.median(G.box_center(b)["x"]).alias("cx"), F.median(G.box_center(b)["y"]).alias("cy"), F.median(b["x2"] - b["x1"]).alias("w"), F.median(b["y2"] - b["y1"]).alias("h"))
    cl = lambda e, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), e.cast("int")))
    return g.select(*KEYS, "track_id", "chunk", F.greatest(F.lit(0), (F.col("cx") - F.col("w") * 0.75).cast("int")).alias("wx1"), F.greatest(F.lit(0), (F.col("cy") - F.col("h") * 0.75).cast("int")).alias("wy1"),
                    F.least(F.lit(640), (F.col("cx") + F.col("w") * 0.75).cast("int")).alias("wx2"), F.least(F.lit(360), (F.col("cy") + F.col("h") * 0.75).cast("int")).alias("wy2"))


@query("round_crop_window", """SELECT match_id, round_id, track_id, greatest(0, trunc(cx-w*0.75))::INTEGER AS wx1, greatest(0, trunc(cy-h*0.75))::INTEGER AS wy1, least(640, trunc(cx+w*0.75))::INTEGER AS wx2, least(360, trunc(cy+h*0.75))::INTEGER AS wy2 FROM (
  SELECT match_id, round_id, track_id, median((x1+x2)/2) AS cx, median((y1+y2)/2) AS cy, median(x2-x1) AS w, median(y2-y1) AS h FROM box GROUP BY match_id, round_id, track_id)""")
def _(spark, sf):
    """One window for a whole round: exact medians by distributed ranks, so no state grows with the round."""
    b, track = F.col("bbox"), [*KEYS, "track_id"]
    d = cut_lineage(A.boxes(spark, sf).select(*track, G.box_center(b)["x"].alias("cx"), G.box_center(b)["y"].alias("cy"), (b["x2"] - b["x1"]).alias("w"), (b["y2"] - b["y1"]).alias("h")))
    m = None
    for c in ("cx", "cy", "w", "h"):
        q = exact_quantiles(d, track, c, {c: 0.5}).drop("n")
        m = q if m is None else m.join(q, track)
    low = lambda e: F.greatest(F.lit(0), e.cast("int"))
    high = lambda e, top: F.least(F.lit(top), e.cast("int"))
    return m.select(*track, low(F.col("cx") - F.col("w") * 0.75).alias("wx1"), low(F.col("cy") - F.col("h") * 0.75).alias("wy1"),
                    high(F.col("cx") + F.col("w") * 0.75, 640).alias("wx2"), high(F.col("cy") + F.col("h") * 0.75, 360).alias("wy2"))


@query("close_truth_pairs", """SELECT match_id, round_id, frame, (nxt-frame) AS gap FROM (SELECT *, lead(frame) OVER (PARTITION BY match_id, round_id ORDER BY frame) AS nxt FROM gt) WHERE nxt-frame < 20""")
def _(spark, sf):
    b = blocked(A.truth(spark, sf), KEYS, "frame", 0, 20)
    d = b.core(b.df.withColumn("nxt", F.min("frame").over(b.span(1, 19))))
    return d.where("nxt is not null").select(*KEYS, "frame", (F.col("nxt") - F.col("frame")).alias("gap"))


@query("derived_fps", """SELECT match_id, coalesce(round(max(frame)/nullif(count(DISTINCT round_id)*240/25.0,0),6), 30.0) AS fps FROM hev GROUP BY match_id""")
def _(spark, sf):
    e = A.events(spark, sf).groupBy("match_id", "round_id").agg(F.max("frame").alias("m"))
    g = e.groupBy("match_id").agg(F.max("m").alias("m"), F.count(F.lit(1)).alias("r"))
    return g.select("match_id", F.coalesce(F.round(F.col("m") / F.nullif(F.col("r") * 240 / 25.0, F.lit(0.0)), 6), F.lit(30.0)).alias("fps"))


# ---- windows

@query("frame_offset_access", f"SELECT p.match_id, p.round_id, p.track_id, p.frame, b.x1 AS x1_before, n.x1 AS x1_after FROM box p LEFT JOIN box b ON b.match_id=p.match_id AND b.round_id=p.round_id AND b.track_id=p.track_id AND b.frame=p.frame-3 LEFT JOIN box n ON n.match_id=p.match_id AND n.round_id=p.round_id AND n.track_id=p.track_id AND n.frame=p.frame+3")
def _(spark, sf):
    b = blocked(A.boxes(spark, sf), GA.TRACK, "frame", 3, 3)
    v = F.col("bbox.x1")
    return b.core(b.df.withColumn("x1_before", b.at(v, -3)).withColumn("x1_after", b.at(v, 3))).select(*BK, "x1_before", "x1_after")


@query("ordered_differences", f"SELECT * FROM (SELECT {TK}, frame-lag(frame) OVER w AS dt, round((x1-lag(x1) OVER w)/(frame-lag(frame) OVER w),6) AS dx FROM box WINDOW w AS (PARTITION BY match_id, round_id, track_id ORDER BY frame)) WHERE dt IS NOT NULL")
def _(spark, sf):
    d = previous_row(A.boxes(spark, sf), GA.TRACK, "frame", F.struct("frame", F.col("bbox.x1").alias("x")), "p").where("p is not null")
    dt = F.col("frame") - F.col("p.frame")
    return d.select(*BK, dt.alias("dt"), r6((F.col("bbox.x1") - F.col("p.x")) / dt, "dx"))


@query("range_framed_aggregate", f"SELECT {TK}, round(avg(x1) OVER w,6) AS mean_x, max(x1) OVER w AS max_x, count(*) OVER w AS n FROM box WINDOW w AS (PARTITION BY match_id, round_id, track_id ORDER BY frame RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING)")
def _(spark, sf):
    b = blocked(A.boxes(spark, sf), GA.TRACK, "frame", 5, 5)
    w = b.span(-5, 5)
    d = b.df.withColumn("m", F.avg("bbox.x1").over(w)).withColumn("max_x", F.max("bbox.x1").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    return b.core(d).select(*BK, r6(F.col("m"), "mean_x"), "max_x", "n")


view("dense", """SELECT match_id, round_id, track_id, CAST(unnest(range(lo, hi+1)) AS INTEGER) AS frame FROM (SELECT match_id, round_id, track_id, min(frame) AS lo, max(frame) AS hi FROM box GROUP BY ALL)""")
view("lerp", """SELECT d.match_id, d.round_id, d.track_id, d.frame, CASE WHEN p.f = n.f THEN p.v ELSE p.v+(n.v-p.v)*(d.frame-p.f)/(n.f-p.f) END AS x FROM dense d
  JOIN LATERAL (SELECT max(frame) AS f, arg_max(x1, frame) AS v FROM box b WHERE b.match_id=d.match_id AND b.round_id=d.round_id AND b.track_id=d.track_id AND b.frame<=d.frame) p ON true
  JOIN LATERAL (SELECT min(frame) AS f, arg_min(x1, frame) AS v FROM box b WHERE b.match_id=d.match_id AND b.round_id=d.round_id AND b.track_id=d.track_id AND b.frame>=d.frame) n ON true""")


def box_x(spark, sf):
    return A.boxes(spark, sf).select(*BK, F.col("bbox.x1").alias("x"))


@query("densified_frames", "SELECT d.match_id, d.round_id, d.track_id, d.frame, b.x1 AS x FROM dense d LEFT JOIN box b ON b.match_id=d.match_id AND b.round_id=d.round_id AND b.track_id=d.track_id AND b.frame=d.frame")
def _(spark, sf):
    return densify(box_x(spark, sf), GA.TRACK, "frame").select(*BK, "x")


@query("interpolated_gaps", "SELECT match_id, round_id, track_id, frame, round(x,8) AS x FROM lerp")
def _(spark, sf):
    return SM.interpolate(box_x(spark, sf), GA.TRACK, "frame", "x").select(*BK, F.round("x", 8).alias("x"))


_K9 = SM.gaussian_kernel(9)
# a triangle wave: short tracks are reflected as often as the kernel needs
_REFL = "CASE WHEN e.hi = e.lo THEN e.lo ELSE e.hi-abs(((d.frame+k-e.lo)%(2*(e.hi-e.lo))+2*(e.hi-e.lo))%(2*(e.hi-e.lo))-(e.hi-e.lo)) END"


@query("gaussian_smoothed_track", f"""WITH e AS (SELECT match_id, round_id, track_id, min(frame) AS lo, max(frame) AS hi FROM box GROUP BY ALL)
  SELECT d.match_id, d.round_id, d.track_id, d.frame, round(sum(l.x*[{",".join(map(repr, _K9))}][k+5]),8) AS x FROM lerp d JOIN e USING (match_id, round_id, track_id), (SELECT unnest(range(-4,5)) AS k), lerp l
  WHERE l.match_id=d.match_id AND l.round_id=d.round_id AND l.track_id=d.track_id AND l.frame = {_REFL} GROUP BY ALL""")
def _(spark, sf):
    d = SM.interpolate(box_x(spark, sf), GA.TRACK, "frame", "x")
    s = SM.gaussian_smooth(d, GA.TRACK, "frame", "x", 9, "y")
    return s.select(*BK, F.round("y", 8).alias("x"))


@query("forward_filled_track", "SELECT d.match_id, d.round_id, d.track_id, d.frame, (SELECT arg_max(x1, frame) FROM box b WHERE b.match_id=d.match_id AND b.round_id=d.round_id AND b.track_id=d.track_id AND b.frame<=d.frame) AS x FROM dense d")
def _(spark, sf):
    d = densify(box_x(spark, sf), GA.TRACK, "frame")
    return forward_fill(d, GA.TRACK, "frame", "x", "xf").select(*BK, F.col("xf").alias("x"))


@query("carried_confident_verdict", """WITH s AS (SELECT match_id, round_id, frame, max(value) FILTER (event_id%2=0)/100 AS g0, max(value) FILTER (event_id%2=1)/100 AS g1 FROM hev GROUP BY ALL)
  SELECT match_id, round_id, frame, coalesce(last_value(CASE WHEN abs(g0-g1)>0.03 THEN g0>g1 END IGNORE NULLS) OVER (PARTITION BY match_id, round_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS swapped FROM s""")
def _(spark, sf):
    e = A.events(spark, sf)
    side = lambda i: F.max(F.when(F.pmod("event_id", F.lit(2)) == i, F.col("value"))) / 100
    s = e.groupBy(*KEYS, "frame").agg(side(0).alias("g0"), side(1).alias("g1"))
    s = s.withColumn("v", F.when(F.abs(F.col("g0") - F.col("g1")) > 0.03, F.col("g0") > F.col("g1")))
    return forward_fill(s, KEYS, "frame", "v", "s").select(*KEYS, "frame", F.coalesce("s", F.lit(False)).alias("swapped"))


@query("rank_within_recording", "SELECT det_id, row_number() OVER (PARTITION BY match_id, round_id ORDER BY score, det_id) AS rank, round(percent_rank() OVER (PARTITION BY match_id, round_id ORDER BY score),6) AS pct FROM det")
def _(spark, sf):
    r = ranked(A.detections(spark, sf), KEYS, "score", tie=["det_id"])
    pct = F.when(F.col("n") > 1, (F.col("rank_min") - 1) / (F.col("n") - 1)).otherwise(0.0)
    return r.select("det_id", F.col("rank_first").alias("rank"), r6(pct, "pct"))


@query("top_detections", "SELECT det_id, round(score,6) AS score FROM det ORDER BY score DESC, det_id LIMIT 25")
def _(spark, sf):
    return A.detections(spark, sf).orderBy(F.desc("score"), "det_id").limit(25).select("det_id", r6(F.col("score"), "score"))


@query("key_set_operations", """WITH a AS (SELECT DISTINCT match_id, frame FROM det), b AS (SELECT DISTINCT match_id, frame FROM gt)
  SELECT 'union' AS op, count(*) AS n FROM (FROM a UNION FROM b) UNION ALL SELECT 'intersect', count(*) FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'a_minus_b', count(*) FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'b_minus_a', count(*) FROM (FROM b EXCEPT FROM a)""")
def _(spark, sf):
    a = A.detections(spark, sf).select("match_id", "frame", F.lit(1).alias("m"))
    b = A.truth(spark, sf).select("match_id", "frame", F.lit(2).alias("m"))
    # one shuffle serves all four sets: which sides hold each key
    k = a.unionAll(b).groupBy("match_id", "frame").agg(F.bit_or("m").alias("m"))
    sets = F.when(F.col("m") == 3, F.array(F.lit("union"), F.lit("intersect"))).when(F.col("m") == 1, F.array(F.lit("union"), F.lit("a_minus_b"))).otherwise(F.array(F.lit("union"), F.lit("b_minus_a")))
    return k.select(F.explode(sets).alias("op")).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


# ---- filters on events

@query("score_threshold", "SELECT det_id, round(score,6) AS score FROM det WHERE score >= 0.2")
def _(spark, sf):
    return A.detections(spark, sf).where("score >= 0.2").select("det_id", r6(F.col("score"), "score"))


@query("zero_evidence_gate", "SELECT det_id, round(CASE WHEN ce < 0.05 AND audio < 0.05 THEN 0 ELSE score END,6) AS hard, round(CASE WHEN ce < 0.05 AND audio < 0.05 AND conf < 0.3 THEN 0 ELSE score END,6) AS soft FROM ft")
def _(spark, sf):
    none = (F.col("ce") < 0.05) & (F.col("audio") < 0.05)
    return features(spark, sf).select("det_id", r6(F.when(none, 0.0).otherwise(F.col("score")), "hard"), r6(F.when(none & (F.col("conf") < 0.3), 0.0).otherwise(F.col("score")), "soft"))


@query("contact_event_filter", "SELECT contact_id, contact_region, round(contact_prob,6) AS contact_prob FROM ce WHERE contact_region IN ('head','torso') AND contact_prob >= 0.3 AND contact_3d_distance_m <= 0.12")
def _(spark, sf):
    return (A.contacts(spark, sf).where(F.col("contact_region").isin("head", "torso") & (F.col("contact_prob") >= 0.3) & (F.col("contact_3d_distance_m") <= 0.12))
            .select("contact_id", "contact_region", r6(F.col("contact_prob"), "contact_prob")))


_LB = FIRST_FIT.format(src="cls", cd=15, t="contact_id", k="match_id, round_id, striker_id, cls", ok="o.match_id, o.round_id, o.striker_id, o.cls",
                       jk="o.match_id=r.match_id AND o.round_id=r.round_id AND o.striker_id=r.striker_id AND o.cls=r.cls")


@query("landed_blocked_split", """WITH cls AS (SELECT *, ce_frame AS frame, CASE WHEN contact_region IN ('head','torso') AND contact_prob >= 0.2 THEN 'landed' WHEN contact_region IN ('left_arm','right_arm') AND contact_prob >= 0.3 THEN 'blocked' END AS cls
  FROM ce WHERE contact_3d_distance_m <= 0.12 AND ((contact_region IN ('head','torso') AND contact_prob >= 0.2) OR (contact_region IN ('left_arm','right_arm') AND contact_prob >= 0.3))), """ + _LB
       + " SELECT c.contact_id, c.cls FROM cls c JOIN run r ON c.contact_id=r.contact_id WHERE r.keep")
def _(spark, sf):
    reg, prob = F.col("contact_region"), F.col("contact_prob")
    cls = F.when(reg.isin("head", "torso") & (prob >= 0.2), "landed").when(reg.isin("left_arm", "right_arm") & (prob >= 0.3), "blocked")
    c = A.contacts(spark, sf).where("contact_3d_distance_m <= 0.12").withColumn("cls", cls).where("cls is not null")
    return first_fit(c, [*KEYS, "striker_id", "cls"], "ce_frame", 15, tie=["contact_id"]).select("contact_id", "cls")


@query("round_validity", "SELECT match_id, round_id, count(DISTINCT track_id) = 2 AS valid, count(*) AS n_rows FROM box GROUP BY match_id, round_id")
def _(spark, sf):
    g = A.boxes(spark, sf).groupBy(*KEYS).agg(F.bool_or(F.col("track_id") == 0).alias("a"), F.bool_or(F.col("track_id") == 1).alias("b"), F.count(F.lit(1)).alias("n_rows"))
    return g.select(*KEYS, (F.col("a") & F.col("b")).alias("valid"), "n_rows")


@query("in_bounds_windows", "SELECT a.action_id FROM act a JOIN (SELECT match_id, round_id, max(frame) AS last FROM hev GROUP BY ALL) l USING (match_id, round_id) WHERE a.window_start-8 >= 0 AND a.window_end+8 <= l.last")
def _(spark, sf):
    last = A.events(spark, sf).groupBy(*KEYS).agg(F.max("frame").alias("last"))
    return A.actions(spark, sf).join(last, KEYS).where("window_start - 8 >= 0 and window_end + 8 <= last").select("action_id")


@query("closest_large_pair", """WITH t AS (SELECT *, row_number() OVER (PARTITION BY match_id, round_id, frame ORDER BY (x2-x1)*(y2-y1) DESC, track_id) AS rn FROM box),
  p AS (SELECT a.match_id, a.round_id, a.frame, a.track_id AS ta, b.track_id AS tb, sqrt(((a.x1+a.x2)/2-(b.x1+b.x2)/2)**2+((a.y1+a.y2)/2-(b.y1+b.y2)/2)**2)/((a.x2-a.x1)*(a.y2-a.y1)+(b.x2-b.x1)*(b.y2-b.y1)+1) AS d
    FROM t a JOIN t b ON a.match_id=b.match_id AND a.round_id=b.round_id AND a.frame=b.frame AND a.rn<b.rn WHERE a.rn<=4 AND b.rn<=4)
  SELECT match_id, round_id, frame, ta, tb, round(d,9) AS d FROM p QUALIFY row_number() OVER (PARTITION BY match_id, round_id, frame ORDER BY d, ta, tb) = 1""")
def _(spark, sf):
    """Of a frame's four largest boxes the pair with the least distance over summed area, as in the stream."""
    area = G.box_area(F.col("bbox"))
    boxes = F.slice(F.sort_array(F.collect_list(F.struct((-area).alias("na"), "track_id", "bbox"))), 1, 4)  # a frame holds a few boxes
    four = A.boxes(spark, sf).groupBy(*KEYS, "frame").agg(boxes.alias("t"))
    ps = F.flatten(F.transform("t", lambda x, i: F.transform(F.filter("t", lambda y, k: k > i), lambda y: F.struct(
        (G.dist(G.box_center(x["bbox"]), G.box_center(y["bbox"])) / (G.box_area(x["bbox"]) + G.box_area(y["bbox"]) + 1)).alias("d"), x["track_id"].alias("ta"), y["track_id"].alias("tb")))))
    return four.withColumn("p", F.array_min(ps)).where("p is not null").select(*KEYS, "frame", "p.ta", "p.tb", F.round("p.d", 9).alias("d"))


@query("timecode_roundtrip", """SELECT det_id, tc, round_even(secs*24.995,0)::INTEGER AS frame_round, floor(secs*24.995)::INTEGER AS frame_floor FROM (SELECT det_id, tc, split_part(tc,':',1)::DOUBLE*60+split_part(tc,':',2)::DOUBLE+split_part(tc,':',3)::DOUBLE/24.995 AS secs FROM (
  SELECT det_id, format('{}:{:02d}:{:02d}', m::INTEGER, floor(t-m*60)::INTEGER, round_even((t-m*60-floor(t-m*60))*24.995,0)::INTEGER) AS tc FROM (SELECT *, floor(t/60) AS m FROM (SELECT det_id, (frame*7+round_id*1680)/24.995 AS t FROM det))))""")
def _(spark, sf):
    d = A.detections(spark, sf).select("det_id", SC.frame_timecode(F.col("frame") * 7 + F.col("round_id") * 1680, 24.995).alias("tc"))
    return d.select("det_id", "tc", SC.timecode_frame(F.col("tc"), 24.995).alias("frame_round"), SC.timecode_frame(F.col("tc"), 24.995, "floor").alias("frame_floor"))


@query("candidate_frame_list", "SELECT DISTINCT match_id, round_id, CAST(unnest(range(action_frame-2, action_frame+3)) AS INTEGER) AS frame FROM act")
def _(spark, sf):
    return A.actions(spark, sf).select(*KEYS, F.explode(F.sequence(F.col("action_frame") - 2, F.col("action_frame") + 2)).alias("frame")).distinct()


@query("head_keypoint_ema", f"""WITH RECURSIVE o AS (SELECT *, {X('p', 0)} AS x, row_number() OVER (PARTITION BY match_id, round_id, track_id ORDER BY frame) AS rk FROM pz p),
  m AS (SELECT match_id, round_id, track_id, frame, rk, x AS s FROM o WHERE rk=1 UNION ALL SELECT o.match_id, o.round_id, o.track_id, o.frame, o.rk, 0.7*o.x+0.3*m.s FROM m JOIN o ON o.match_id=m.match_id AND o.round_id=m.round_id AND o.track_id=m.track_id AND o.rk=m.rk+1)
  SELECT match_id, round_id, track_id, frame, round(s,5) AS x FROM m""")
def _(spark, sf):
    # 0.3^40 is below double precision, so a 40-row look-back carries the whole history
    from contactflow.operators.ordering import ema_scan
    p = A.pose(spark, sf).select(*BK, G.joint(F.col("joints"), 0)["x"].alias("x"))
    return ema_scan(p, GA.TRACK, "frame", "x", 0.7, "s").select(*BK, F.round("s", 5).alias("x"))
