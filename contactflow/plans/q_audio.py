"""Audio queries (survey group A)."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from contactflow.functions import scoring as SC
from contactflow.operators import audio as AU
from contactflow.operators.ordering import row_number
from contactflow.plans.q_geometry import r6
from contactflow.plans.q_suppress import first_fit_sql
from contactflow.plans.q_gates import nms_sql
from contactflow.plans.registry import query, view
from contactflow.sources import adapters as A

KEYS = ["match_id", "round_id"]
BLOCK_LEN, WIN, HOP = 64, 32, 16
BINS = {"low": (1, 5), "mid": (5, 11), "high": (11, 17)}


def sample_blocks(spark, sf):
    """One embedding is a block of 64 samples; each pose track is a recording."""
    e = A.table(spark, sf, "embeddings")
    t = F.floor(F.col("vec_id") / 2)
    return e.select((F.floor(t / 500) * 2 + F.pmod("vec_id", F.lit(2))).cast("int").alias("recording_id"), F.pmod(t, F.lit(500)).cast("int").alias("block_no"),
                    F.transform("embedding", lambda v: v.cast("double")).alias("samples"))


_H = "[" + ",".join(repr(float(v)) for v in np.hanning(WIN)) + "]"
_CS = lambda f: "[" + ",".join("[" + ",".join(repr(float(v)) for v in f(2 * np.pi * k * np.arange(WIN) / WIN)) + "]" for k in range(WIN // 2 + 1)) + "]"
view("ablk", "SELECT CAST(vec_id//2//500*2+vec_id%2 AS INTEGER) AS recording_id, CAST(vec_id//2%500 AS INTEGER) AS block_no, CAST(embedding AS DOUBLE[]) AS x FROM embeddings")
view("aseg", f"""SELECT recording_id, CAST(block_no*4+h AS INTEGER) AS hop_idx, [seg[i]*{_H}[i] FOR i IN range(1,33)] AS seg FROM (
  SELECT c.recording_id, c.block_no, h, list_concat(c.x, coalesce(n.x, []))[h*16+1:h*16+32] AS seg FROM ablk c LEFT JOIN ablk n ON n.recording_id=c.recording_id AND n.block_no=c.block_no+1, (SELECT unnest(range(0,4)) AS h)) WHERE len(seg)=32""")
view("amag", f"""SELECT recording_id, hop_idx, sqrt(list_avg([v*v FOR v IN seg])) AS rms, [sqrt(pow(list_sum([seg[i]*c[i] FOR i IN range(1,33)]),2)+pow(list_sum([seg[i]*s[i] FOR i IN range(1,33)]),2)) FOR c, s IN []] AS unused, mags FROM (
  SELECT a.recording_id, a.hop_idx, any_value(a.seg) AS seg, list(sqrt(pow(list_sum([a.seg[i]*({_CS(np.cos)})[k][i] FOR i IN range(1,33)]),2)+pow(list_sum([a.seg[i]*({_CS(np.sin)})[k][i] FOR i IN range(1,33)]),2)) ORDER BY k) AS mags
  FROM aseg a, (SELECT unnest(range(1,18)) AS k) GROUP BY a.recording_id, a.hop_idx)""".replace("[sqrt(pow(list_sum([seg[i]*c[i] FOR i IN range(1,33)]),2)+pow(list_sum([seg[i]*s[i] FOR i IN range(1,33)]),2)) FOR c, s IN []] AS unused, ", ""))
_BAND = lambda b, e: f"list_sum({e}[{BINS[b][0] + 1}:{BINS[b][1]}])"


@query("stft_band_energy", f"SELECT recording_id, hop_idx, round(rms,6) AS rms, round({_BAND('low', 'mags')},6) AS low, round({_BAND('mid', 'mags')},6) AS mid, round({_BAND('high', 'mags')},6) AS high FROM amag")
def _(spark, sf):
    s = AU.spectra(sample_blocks(spark, sf), BLOCK_LEN, WIN, HOP)
    band = lambda lo, hi: F.aggregate(F.slice("mags", lo + 1, hi - lo), F.lit(0.0), lambda a, v: a + v)
    return s.select("recording_id", "hop_idx", r6(F.col("rms"), "rms"), *[r6(band(*r), n) for n, r in BINS.items()])


view("aflux", "SELECT m.recording_id, m.hop_idx, m.rms, " + ", ".join(
    f"coalesce(list_sum([greatest(0.0::DOUBLE, m.mags[i]-p.mags[i]) FOR i IN range({lo + 1},{hi + 1})]),0) AS flux_{n}" for n, (lo, hi) in BINS.items())
    + " FROM amag m LEFT JOIN amag p ON p.recording_id=m.recording_id AND p.hop_idx=m.hop_idx-1")


def flux(spark, sf):
    return AU.band_flux(AU.spectra(sample_blocks(spark, sf), BLOCK_LEN, WIN, HOP), BINS)


@query("spectral_flux_bands", "SELECT m.recording_id, m.hop_idx, " + ", ".join(
    f"round(CASE WHEN p.mags IS NULL THEN 0 ELSE list_sum([greatest(0.0::DOUBLE, m.mags[i]-p.mags[i]) FOR i IN range({lo + 1},{hi + 1})]) END,6) AS flux_{n}" for n, (lo, hi) in BINS.items())
    + " FROM amag m LEFT JOIN amag p ON p.recording_id=m.recording_id AND p.hop_idx=m.hop_idx-1")
def _(spark, sf):
    return flux(spark, sf).select("recording_id", "hop_idx", *[r6(F.col(f"flux_{n}"), f"flux_{n}") for n in BINS])


@query("spectral_centroid", "SELECT recording_id, hop_idx, round(list_sum([mags[i]*(i-1)*100.0 FOR i IN range(1,18)])/list_sum(mags),4) AS centroid FROM amag")
def _(spark, sf):
    s = AU.spectra(sample_blocks(spark, sf), BLOCK_LEN, WIN, HOP)
    return s.select("recording_id", "hop_idx", F.round(AU.spectral_centroid(F.col("mags"), 100.0), 4).alias("centroid"))


@query("pre_emphasised_rms")
def _(spark, sf):
    s = AU.spectra(sample_blocks(spark, sf), BLOCK_LEN, WIN, HOP, pre_emphasis=0.97)
    return s.select("recording_id", "hop_idx", r6(F.col("rms"), "rms"))


@query("noise_floor_ratio", """WITH f AS (SELECT recording_id, hop_idx, rms, CASE WHEN hop_idx=0 THEN 0 ELSE flux_low END AS low, CASE WHEN hop_idx=0 THEN 0 ELSE flux_mid END AS mid, CASE WHEN hop_idx=0 THEN 0 ELSE flux_high END AS high FROM aflux)
  SELECT recording_id, hop_idx, round(0.30*low/(quantile_cont(low,0.75) OVER w+1e-6)+0.20*mid/(quantile_cont(mid,0.75) OVER w+1e-6)+0.35*high/(quantile_cont(high,0.75) OVER w+1e-6)+0.15*rms/(quantile_cont(rms,0.75) OVER w+1e-6),5) AS onset
  FROM f WINDOW w AS (PARTITION BY recording_id ORDER BY hop_idx ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING)""")
def _(spark, sf):
    f = flux(spark, sf).select("recording_id", "hop_idx", "rms", *[F.col(f"flux_{n}").alias(n) for n in BINS])
    d = AU.floor_ratio(f, ["recording_id"], "hop_idx", AU.RATIO_WEIGHTS, 20, "onset")
    return d.select("recording_id", "hop_idx", F.round("onset", 5).alias("onset"))


# a dense envelope per recording and frame from the events
view("env", """SELECT a.match_id, a.round_id, a.frame, coalesce(v,0) AS v FROM (SELECT match_id, round_id, CAST(unnest(range(lo,hi+1)) AS INTEGER) AS frame FROM (SELECT match_id, round_id, min(frame) AS lo, max(frame) AS hi FROM hev GROUP BY ALL)) a
  LEFT JOIN (SELECT match_id, round_id, frame, max(value)/100 AS v FROM hev GROUP BY ALL) b USING (match_id, round_id, frame)""")


def envelope(spark, sf):
    from contactflow.operators.ordering import densify
    e = A.events(spark, sf).groupBy(*KEYS, "frame").agg((F.max("value") / 100).alias("v"))
    return densify(e, KEYS, "frame").na.fill(0.0, ["v"])


@query("median_clamped_envelope", """SELECT e.match_id, e.round_id, e.frame, round(greatest(0.0::DOUBLE, e.v-m.med)/(greatest(0.0::DOUBLE, m.mx-m.med)+1e-9),6) AS v FROM env e JOIN (SELECT match_id, round_id, median(v) AS med, max(v) AS mx FROM env GROUP BY ALL) m USING (match_id, round_id)""")
def _(spark, sf):
    return AU.median_clamp_normalise(envelope(spark, sf), KEYS, "v", "o").select(*KEYS, "frame", r6(F.col("o"), "v"))


view("smo", "SELECT match_id, round_id, frame, 0.25*coalesce(lag(v) OVER w,0)+0.5*v+0.25*coalesce(lead(v) OVER w,0) AS v FROM env WINDOW w AS (PARTITION BY match_id, round_id ORDER BY frame)")


def smoothed(spark, sf):
    return AU.triangular_smooth(envelope(spark, sf), KEYS, "frame", "v", "s").select(*KEYS, "frame", F.col("s").alias("v"))


@query("triangular_smoothing", "SELECT match_id, round_id, frame, round(v,6) AS v FROM smo")
def _(spark, sf):
    return smoothed(spark, sf).select(*KEYS, "frame", r6(F.col("v"), "v"))


_PK = """pk AS (SELECT *, frame AS det_id0, v AS score FROM (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS n FROM smo WINDOW w AS (PARTITION BY match_id, round_id ORDER BY frame)) WHERE v>p AND v>n AND v>=0.3),
  pk2 AS (SELECT *, match_id*10000+round_id*1000+frame AS det_id FROM pk), """


@query("prominent_audio_peaks", "WITH " + _PK + nms_sql("pk2", 10) + """, kp AS (SELECT p.* FROM pk2 p SEMI JOIN ids USING (det_id)),
  pr AS (SELECT k.match_id, k.round_id, k.frame, k.v, (SELECT min(s.v) FROM smo s WHERE s.match_id=k.match_id AND s.round_id=k.round_id AND s.frame<k.frame AND s.frame>coalesce((SELECT max(h.frame) FROM smo h WHERE h.match_id=k.match_id AND h.round_id=k.round_id AND h.frame<k.frame AND h.v>k.v),-1)) AS lm,
    (SELECT min(s.v) FROM smo s WHERE s.match_id=k.match_id AND s.round_id=k.round_id AND s.frame>k.frame AND s.frame<coalesce((SELECT min(h.frame) FROM smo h WHERE h.match_id=k.match_id AND h.round_id=k.round_id AND h.frame>k.frame AND h.v>k.v),1000000)) AS rm FROM kp k)
  SELECT match_id, round_id, frame, round(v,6) AS v FROM pr WHERE v-greatest(lm,rm) >= 0.075""")
def _(spark, sf):
    p = AU.pick_peaks(smoothed(spark, sf), KEYS, "frame", "v", 0.3, 10)
    return p.select(*KEYS, "frame", r6(F.col("v"), "v"))


@query("adaptive_audio_peaks", """WITH s AS (SELECT *, max(v) OVER (PARTITION BY match_id, round_id ORDER BY frame ROWS BETWEEN 20 PRECEDING AND 19 FOLLOWING) AS mx, avg(v) OVER (PARTITION BY match_id, round_id ORDER BY frame ROWS BETWEEN 30 PRECEDING AND 29 FOLLOWING) AS av,
  stddev_pop(v) OVER (PARTITION BY match_id, round_id) AS sd FROM smo), c AS (SELECT *, match_id*10000+round_id*1000+frame AS det_id FROM s WHERE v=mx AND v>=av+sd), """ + first_fit_sql("c", 13)
       + " SELECT c.match_id, c.round_id, c.frame, round(c.v,6) AS v FROM c JOIN run r ON c.det_id=r.det_id WHERE r.keep")
def _(spark, sf):
    return AU.adaptive_peaks(smoothed(spark, sf), KEYS, "frame", "v").select(*KEYS, "frame", r6(F.col("v"), "v"))


_R = "OVER (PARTITION BY match_id, round_id ORDER BY frame RANGE BETWEEN {} AND {})"


@query("audio_features_at_frame", f"""SELECT match_id, round_id, frame, round(pk,9) AS peak, round(greatest(0.0::DOUBLE, pk-bf),9) AS rising, round(si,9) AS silence, round(r3,9) AS rms3 FROM (SELECT *, max(v) {_R.format('6 PRECEDING', '6 FOLLOWING')} AS pk,
  coalesce(max(v) {_R.format('6 PRECEDING', '4 PRECEDING')},0) AS bf, coalesce(avg(v) {_R.format('10 PRECEDING', '3 PRECEDING')},0.5) AS si, max(v) {_R.format('3 PRECEDING', '3 FOLLOWING')} AS r3 FROM smo)""")
def _(spark, sf):
    d = AU.features_at_frames(smoothed(spark, sf), KEYS, "frame", "v")
    return d.select(*KEYS, "frame", *[F.round(c, 9).alias(c) for c in ("peak", "rising", "silence", "rms3")])


@query("onset_index_table", """SELECT match_id, round_id, row_number() OVER (PARTITION BY match_id, round_id ORDER BY onset_frame) AS id, onset_frame AS frame, round(onset_frame/25.0,3) AS time_sec,
  format('{}:{:02d}:{:02d}', floor(onset_frame/25.0/60)::INTEGER, floor(onset_frame/25.0-60*floor(onset_frame/25.0/60))::INTEGER, round_even((onset_frame/25.0-floor(onset_frame/25.0))*25.0,0)::INTEGER) AS timestamp, round(strength,3) AS score FROM ons WHERE strength>=0.1""")
def _(spark, sf):
    o = row_number(A.onsets(spark, sf).where("strength >= 0.1"), KEYS, "onset_frame", "id")
    return o.select(*KEYS, "id", F.col("onset_frame").alias("frame"), F.round(F.col("onset_frame") / 25.0, 3).alias("time_sec"),
                    SC.frame_timecode(F.col("onset_frame"), 25.0).alias("timestamp"), F.round("strength", 3).alias("score"))
