"""Label, manifest and track-merge queries (survey group L)."""
from __future__ import annotations

from pyspark.sql import functions as F

from contactflow.functions import scoring as SC
from contactflow.operators import candidates as C
from contactflow.operators import joins as J
from contactflow.operators import labels as L
from contactflow.operators.ordering import row_number
from contactflow.plans.q_candidates import clip_rows
from contactflow.plans.q_geometry import BK, r6
from contactflow.plans.q_joins import SWP, swaps
from contactflow.plans.registry import query, view
from contactflow.sources import adapters as A

KEYS = ["match_id", "round_id"]


def live(spark, sf):
    l = A.table(spark, sf, "labels")
    k = F.pmod("doc_id", F.lit(7))
    return l.select(F.col("doc_id").alias("clip"), F.when(~k.isin(0, 3), F.when(F.col("quality") == 1, "impact").otherwise("not_impact")).alias("label"),
                    F.when(k.isin(1, 2) & (F.col("quality") == 1), F.pmod("doc_id", F.lit(100))).cast("int").alias("impact_frame"))


def incoming(spark, sf):
    """Two returned files per clip set; file 1 fills gaps and flips some, file 2 disagrees elsewhere."""
    l = A.table(spark, sf, "labels")
    k = F.pmod("doc_id", F.lit(7))
    same, flip = F.when(F.col("quality") == 1, "impact").otherwise("not_impact"), F.when(F.col("quality") == 1, "not_impact").otherwise("impact")
    one = l.where("doc_id % 11 <> 5").select(F.when(F.pmod("doc_id", F.lit(13)) == 0, F.col("doc_id") + 1000000).otherwise(F.col("doc_id")).alias("clip"), F.lit(1).alias("file_no"),
                                             F.when(k == 4, flip).when(k != 5, same).alias("label"), F.when(k.isin(1, 3), F.pmod("doc_id", F.lit(90))).cast("int").alias("impact_frame"))
    two = l.where("doc_id % 5 = 0").select(F.col("doc_id").alias("clip"), F.lit(2).alias("file_no"), F.when(k == 3, flip).otherwise(same).alias("label"), F.lit(None).cast("int").alias("impact_frame"))
    return one.unionByName(two)


view("ml", "SELECT doc_id AS clip, CASE WHEN doc_id%7 NOT IN (0,3) THEN CASE WHEN quality=1 THEN 'impact' ELSE 'not_impact' END END AS label, CAST(CASE WHEN doc_id%7 IN (1,2) AND quality=1 THEN doc_id%100 END AS INTEGER) AS impact_frame FROM labels")
view("mi", """SELECT CASE WHEN doc_id%13=0 THEN doc_id+1000000 ELSE doc_id END AS clip, 1 AS file_no, CASE WHEN doc_id%7=4 THEN CASE WHEN quality=1 THEN 'not_impact' ELSE 'impact' END WHEN doc_id%7<>5 THEN CASE WHEN quality=1 THEN 'impact' ELSE 'not_impact' END END AS label,
  CAST(CASE WHEN doc_id%7 IN (1,3) THEN doc_id%90 END AS INTEGER) AS impact_frame FROM labels WHERE doc_id%11<>5 UNION ALL SELECT doc_id, 2, CASE WHEN (doc_id%7=3)<>(quality=1) THEN 'impact' ELSE 'not_impact' END, NULL FROM labels WHERE doc_id%5=0""")
view("mm", """SELECT l.clip, coalesce(l.label, (SELECT arg_min(label, file_no) FROM mi i WHERE i.clip=l.clip AND label IS NOT NULL)) AS label, coalesce(l.impact_frame, (SELECT arg_min(impact_frame, file_no) FROM mi i WHERE i.clip=l.clip AND impact_frame IS NOT NULL)) AS impact_frame FROM ml l""")


@query("manifest_keep_labels", "SELECT d.doc_id AS clip, l.label, l.impact_frame FROM (SELECT doc_id FROM documents) d LEFT JOIN ml l ON l.clip=d.doc_id")
def _(spark, sf):
    fresh = A.table(spark, sf, "documents").select(F.col("doc_id").alias("clip"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("int").alias("impact_frame"))
    return L.keep_labels(fresh, live(spark, sf)).select("clip", "label", "impact_frame")


@query("manifest_diff", """WITH i AS (SELECT * FROM mi WHERE file_no=1), j AS (SELECT coalesce(l.clip,i.clip) AS clip, l.label AS ll, l.impact_frame AS lf, i.label AS il, i.impact_frame AS fi, l.clip IS NOT NULL AS a, i.clip IS NOT NULL AS b FROM ml l FULL JOIN i ON l.clip=i.clip)
  SELECT clip, CASE WHEN ll IS NULL THEN 'new_label' WHEN ll=il THEN 'agree' ELSE 'conflict' END AS kind, ll AS live, il AS incoming FROM j WHERE a AND b AND il IS NOT NULL
  UNION ALL SELECT clip, CASE WHEN lf IS NULL THEN 'frame_added' ELSE 'frame_conflict' END, lf::VARCHAR, fi::VARCHAR FROM j WHERE a AND b AND fi IS NOT NULL AND (lf IS NULL OR lf<>fi)
  UNION ALL SELECT clip, CASE WHEN a THEN 'not_in_incoming' ELSE 'not_in_live' END, ll, il FROM j WHERE NOT (a AND b)""")
def _(spark, sf):
    return L.diff_manifest(live(spark, sf), incoming(spark, sf).where("file_no = 1"))


@query("manifest_ordered_merge", "SELECT clip, label, impact_frame FROM mm")
def _(spark, sf):
    return L.merge_in_order(live(spark, sf), incoming(spark, sf), "file_no").select("clip", "label", "impact_frame")


@query("manifest_file_conflicts", "SELECT i.file_no, count(*) AS n_clips, count_if((i.label IS NOT NULL AND i.label<>m.label) OR (i.impact_frame IS NOT NULL AND i.impact_frame<>m.impact_frame))::BIGINT AS conflicts FROM mi i JOIN mm m ON i.clip=m.clip GROUP BY i.file_no")
def _(spark, sf):
    m = L.merge_in_order(live(spark, sf), incoming(spark, sf), "file_no")
    return L.file_conflicts(m, incoming(spark, sf), "file_no")


@query("manifest_counters", "SELECT count(*) AS total_clips, count(label) AS labeled, count_if(label IS NULL)::BIGINT AS unlabeled, count_if(label='impact' AND impact_frame IS NOT NULL)::BIGINT AS impact_frames_marked, count_if(label='impact' AND impact_frame IS NULL)::BIGINT AS impact_frames_unmarked FROM ml")
def _(spark, sf):
    return L.manifest_counters(live(spark, sf))


@query("class_weights", "SELECT label, count(*) AS n, round(1.0/count(*),8) AS weight, round((SELECT count_if(label='not_impact')/count_if(label='impact') FROM ml),6) AS pos_weight FROM ml WHERE label IS NOT NULL GROUP BY label")
def _(spark, sf):
    w = L.class_weights(live(spark, sf).where("label is not null"), "label")
    g = w.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("weight"), 8).alias("weight"))
    neg, pos = F.max(F.when(F.col("label") == "not_impact", F.col("n"))), F.max(F.when(F.col("label") == "impact", F.col("n")))
    two = g.agg(F.collect_list(F.struct("label", "n", "weight")).alias("c"), F.round(neg / pos, 6).alias("pos_weight"))  # two classes
    return two.select(F.explode("c").alias("c"), "pos_weight").select("c.*", "pos_weight")


@query("merged_parts", """WITH p AS (SELECT match_id, round_id, event_id, frame//60+1 AS part, frame%60+1 AS local_frame, value FROM hev) SELECT match_id, round_id, CAST((part-1)*60+(local_frame-1) AS INTEGER) AS frame, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM p GROUP BY match_id, round_id, part, local_frame""")
def _(spark, sf):
    e = A.events(spark, sf).withColumn("part", F.floor(F.col("frame") / 60) + 1).withColumn("local_frame", F.pmod("frame", F.lit(60)) + 1)
    g = e.withColumn("frame", L.part_to_global(F.col("part"), F.col("local_frame"), 60)).select(*KEYS, "frame", "event_id", "value")
    return L.last_write_wins(g, [*KEYS, "frame"], [F.col("event_id")])


@query("track_merge_with_fallback", """WITH u AS (SELECT match_id, round_id, event_id%2 AS track_id, frame, event_id, CASE WHEN event_type='error' THEN 1 WHEN event_type='view' THEN 2 ELSE 3 END AS src FROM hev WHERE event_type IN ('error','view'))
  SELECT match_id, round_id, CAST(track_id AS INTEGER) AS track_id, frame, event_id, src FROM u JOIN (SELECT match_id, round_id, track_id, min(src) AS src FROM u GROUP BY ALL) b USING (match_id, round_id, track_id, src)""")
def _(spark, sf):
    e = A.events(spark, sf).where("event_type in ('error', 'view')")
    u = e.select(*KEYS, F.pmod("event_id", F.lit(2)).cast("int").alias("track_id"), "frame", "event_id", F.when(F.col("event_type") == "error", 1).otherwise(2).alias("src"))
    return L.first_source(u, [*KEYS, "track_id"], "src")


@query("merged_action_manifest", """SELECT match_id, round_id, action_id, row_number() OVER (PARTITION BY match_id, round_id ORDER BY window_start, action_id) AS idx, fighter_id, action, window_start, window_end, CAST(NULL AS VARCHAR) AS label FROM act""")
def _(spark, sf):
    return clip_rows(spark, sf).select(*KEYS, "action_id", "idx", "fighter_id", "action", "window_start", "window_end", F.lit(None).cast("string").alias("label"))


@query("identity_swap_correction", f"WITH {SWP} SELECT a.action_id, coalesce(s.swapped,false) AS swapped, CASE WHEN coalesce(s.swapped,false) THEN 1-fighter_id ELSE fighter_id END AS striker_id, CASE WHEN coalesce(s.swapped,false) THEN fighter_id ELSE 1-fighter_id END AS receiver_id FROM act a LEFT JOIN swp s ON a.match_id=s.match_id AND a.round_id=s.round_id AND s.frame=greatest(0,a.window_start-8)//20*20")
def _(spark, sf):
    a = A.actions(spark, sf).withColumn("lo", F.greatest(F.lit(0), F.col("window_start") - 8))
    j = J.bucket_asof(a, swaps(spark, sf), KEYS, frame="lo", stride=20, value="swapped", default=F.lit(False))
    return L.swap_roles(j).select("action_id", "swapped", "striker_id", "receiver_id")


@query("verdict_overlay", """WITH v AS (SELECT match_id, round_id, frame, ['LANDED','BLOCKED','MISS','CLINCH'][max(event_id)%4+1] AS verdict FROM hev WHERE event_type='signup' GROUP BY ALL) SELECT d.det_id, coalesce(v.verdict,'UNCLEAR') AS verdict FROM det d LEFT JOIN v USING (match_id, round_id, frame)""")
def _(spark, sf):
    return verdicts(spark, sf).select("det_id", "verdict")


def verdicts(spark, sf):
    e = A.events(spark, sf).where("event_type = 'signup'").groupBy(*KEYS, "frame").agg(F.max("event_id").alias("m"))
    v = e.select(*KEYS, "frame", A._pick(list(L.VERDICTS[:4]), F.pmod("m", F.lit(4))).alias("verdict"))
    return L.apply_verdicts(A.detections(spark, sf), v, [*KEYS, "frame"])


@query("verdict_precision", """WITH v AS (SELECT match_id, round_id, frame, ['LANDED','BLOCKED','MISS','CLINCH'][max(event_id)%4+1] AS verdict FROM hev WHERE event_type='signup' GROUP BY ALL), j AS (SELECT coalesce(v.verdict,'UNCLEAR') AS verdict FROM det d LEFT JOIN v USING (match_id, round_id, frame))
  SELECT count(*) AS n, count_if(verdict='LANDED')::BIGINT AS landed, count_if(verdict='UNCLEAR')::BIGINT AS unclear, round(count_if(verdict='LANDED')/nullif(count_if(verdict<>'UNCLEAR'),0),6) AS "precision" FROM j""")
def _(spark, sf):
    v = F.col("verdict")
    return verdicts(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_if(v == "LANDED").alias("landed"), F.count_if(v == "UNCLEAR").alias("unclear"),
                                   F.round(F.try_divide(F.count_if(v == "LANDED").cast("double"), F.count_if(v != "UNCLEAR").cast("double")), 6).alias("precision"))


@query("av_clip_index", """WITH c AS (SELECT *, row_number() OVER (PARTITION BY match_id, round_id ORDER BY onset_frame) AS id, onset_frame/25.0 AS t FROM ons WHERE strength >= 0.1),
  d AS (SELECT *, floor(t/60)::INTEGER AS m, floor(t-60*floor(t/60))::INTEGER AS s, round_even((t-floor(t))*25.0,0)::INTEGER AS f FROM c)
  SELECT match_id, round_id, id, format('{:03d}_t{}m{:02d}{:02d}s_score{:.2f}_f{}.mp4', id, m, s, f, round(strength,2), onset_frame) AS file, round(t,3) AS time_sec, format('{}:{:02d}:{:02d}', m, s, f) AS timestamp, onset_frame AS frame, round(strength,3) AS onset_score FROM d""")
def _(spark, sf):
    """Index of the audio-and-video clips around onsets: number, file name, time and strength (the clips themselves are not cut)."""
    o = row_number(A.onsets(spark, sf).where("strength >= 0.1"), KEYS, "onset_frame", "id")
    t = F.col("onset_frame") / 25.0
    code = SC.frame_timecode(F.col("onset_frame"), 25.0)
    parts = F.split(code, ":")
    name = F.format_string("%03d_t%sm%s%ss_score%.2f_f%d.mp4", "id", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.round("strength", 2), "onset_frame")
    return o.select(*KEYS, "id", name.alias("file"), F.round(t, 3).alias("time_sec"), code.alias("timestamp"), F.col("onset_frame").alias("frame"), F.round("strength", 3).alias("onset_score"))


@query("action_clip_index", """SELECT a.action_id, round(CASE WHEN e-s<1.4 THEN greatest(0.0::DOUBLE,(s+e)/2-0.7) ELSE s END,3) AS clip_start_sec, round(CASE WHEN e-s<1.4 THEN 1.4 ELSE e-s END,3) AS clip_dur_sec, round(onset,3) AS onset FROM (SELECT *, greatest(0.0::DOUBLE, window_start/25.0-0.4) AS s, window_end/25.0+0.7 AS e,
  (SELECT coalesce(max(strength),0) FROM ons o WHERE o.match_id=act.match_id AND o.round_id=act.round_id AND o.onset_frame BETWEEN window_start-7 AND window_end+7) AS onset FROM act) a""")
def _(spark, sf):
    # 0.3 s around the window is seven whole frames at 25 fps
    a = A.actions(spark, sf)
    o = A.onsets(spark, sf).withColumnRenamed("onset_frame", "of")
    w = a.select(*KEYS, "window_start", "window_end").distinct()
    best = J.interval_join(w, o, KEYS, start="window_start", end="window_end", before=7, after=7, frame="of").groupBy(*KEYS, "window_start", "window_end").agg(F.max("strength").alias("onset"))
    s, d = C.clip_bounds(F.col("window_start"), F.col("window_end"), A.FPS)
    return a.join(best, [*KEYS, "window_start", "window_end"], "left").select(
        "action_id", F.round(s, 3).alias("clip_start_sec"), F.round(d, 3).alias("clip_dur_sec"), F.round(F.coalesce("onset", F.lit(0.0)), 3).alias("onset"))


@query("skip_accounting", """SELECT match_id, round_id, count(*) AS n_clips, count_if(NOT ok)::BIGINT AS skipped FROM (SELECT a.*, EXISTS (SELECT 1 FROM box b WHERE b.match_id=a.match_id AND b.round_id=a.round_id AND b.track_id<>a.fighter_id AND b.frame BETWEEN a.window_start-3 AND a.window_end+5) AS ok FROM act a) GROUP BY ALL""")
def _(spark, sf):
    b = A.boxes(spark, sf).select(*KEYS, (1 - F.col("track_id")).alias("fighter_id"), "frame")
    a = A.actions(spark, sf)
    hit = J.interval_join(a.select(*KEYS, "fighter_id", "window_start", "window_end").distinct(), b, [*KEYS, "fighter_id"], start="window_start", end="window_end", before=3, after=5)
    hit = hit.select(*KEYS, "fighter_id", "window_start", "window_end").distinct().withColumn("ok", F.lit(True))
    j = a.join(hit, [*KEYS, "fighter_id", "window_start", "window_end"], "left")
    return j.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_clips"), F.count_if(F.col("ok").isNull()).alias("skipped"))
