"""Evaluation, sweep and validation queries (survey group E)."""
from __future__ import annotations

from hashlib import md5
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from contactflow.functions import scoring as SC
from contactflow.operators import evaluate as E
from contactflow.operators import joins as J
from contactflow.operators import learned as ML
from contactflow.operators import search as SE
from contactflow.operators.matching import match, match_counts, with_prf
from contactflow.operators.ranking import blocks_by_rank, ranked, roc_auc
from contactflow.operators.suppress import greedy_nms
from contactflow.plans.q_candidates import TERMS, TERMS_SQL, features, fusion_features, terms
from contactflow.plans.q_gates import nms_sql
from contactflow.plans.q_geometry import r6
from contactflow.plans.registry import query, view
from contactflow.session import cut_lineage
from contactflow.sources import adapters as A

KEYS = ["match_id", "round_id"]
ORDERS = {"nearest_unused": "d.frame, abs(d.frame-g.frame), g.frame", "first_unused": "d.frame, g.frame",
          "closest_pair": "abs(d.frame-g.frame), d.frame, g.frame"}


def match_sql(det, gt, tol, method, keys=("match_id", "round_id"), p=""):
    """Whole-list greedy matching by recursion over the ordered pairs; result fin{p}."""
    k = ", ".join(keys)
    on = lambda a, b: " AND ".join(f"{a}.{x}={b}.{x}" for x in keys)
    q = lambda a: ", ".join(f"{a}.{x}" for x in keys)
    used = "list_contains(m.ud,p.df) OR list_contains(m.ug,p.gf)"
    return f"""pr{p} AS (SELECT {q('d')}, d.frame AS df, g.frame AS gf, row_number() OVER (PARTITION BY {q('d')} ORDER BY {ORDERS[method]}) AS rk FROM {det} d JOIN {gt} g ON {on('d', 'g')} AND abs(d.frame-g.frame)<={tol}),
  mt{p} AS (SELECT {k}, rk, [df] AS ud, [gf] AS ug FROM pr{p} WHERE rk=1 UNION ALL SELECT {q('p')}, p.rk, CASE WHEN {used} THEN m.ud ELSE list_append(m.ud,p.df) END, CASE WHEN {used} THEN m.ug ELSE list_append(m.ug,p.gf) END
    FROM mt{p} m JOIN pr{p} p ON {on('p', 'm')} AND p.rk=m.rk+1),
  fin{p} AS (SELECT {k}, unnest(ud) AS frame, unnest(ug) AS gt_frame FROM (SELECT {k}, arg_max(ud, rk) AS ud, arg_max(ug, rk) AS ug FROM mt{p} GROUP BY {k}))"""


view("dd", "SELECT DISTINCT match_id, round_id, frame FROM det")
_PRF = "round(CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 0 END,6) AS \"precision\", round(CASE WHEN tp+fn>0 THEN tp/(tp+fn) ELSE 0 END,6) AS recall, round(CASE WHEN tp>0 THEN 2*tp/(2*tp+fp+fn) ELSE 0 END,6) AS f1"


def _register_matcher(name, method):
    @query(f"match_{name}", f"WITH {match_sql('dd', 'gt', 12, method)} SELECT d.match_id, d.round_id, d.frame, f.gt_frame FROM dd d LEFT JOIN fin f USING (match_id, round_id, frame)")
    def _(spark, sf):
        return match(A.detections(spark, sf), A.truth(spark, sf), KEYS, 12, method).select(*KEYS, "frame", "gt_frame")


for _m in ORDERS:
    _register_matcher(_m, _m)


@query("precision_recall_f1", f"""WITH {match_sql('dd', 'gt', 12, 'closest_pair')}, c AS (SELECT match_id, round_id, sum(d) AS nd, sum(g) AS ng, sum(m) AS tp FROM (
    SELECT match_id, round_id, 1 AS d, 0 AS g, 0 AS m FROM dd UNION ALL SELECT match_id, round_id, 0, 1, 0 FROM gt UNION ALL SELECT match_id, round_id, 0, 0, 1 FROM fin) GROUP BY ALL),
  t AS (SELECT match_id, round_id, tp::BIGINT AS tp, (nd-tp)::BIGINT AS fp, (ng-tp)::BIGINT AS fn FROM c) SELECT *, {_PRF} FROM t""")
def _(spark, sf):
    m = match(A.detections(spark, sf), A.truth(spark, sf), KEYS, 12, "closest_pair")
    d = with_prf(match_counts(m, A.truth(spark, sf), KEYS))
    return d.select(*KEYS, "tp", "fp", "fn", *[r6(F.col(c), c) for c in ("precision", "recall", "f1")])


@query("truth_coverage", """SELECT match_id, count(*) AS n_gt, count_if(EXISTS (SELECT 1 FROM det d WHERE d.match_id=g.match_id AND d.round_id=g.round_id AND abs(d.frame-g.frame)<=12))::BIGINT AS covered FROM gt g GROUP BY match_id""")
def _(spark, sf):
    m = J.matched_in_band(A.truth(spark, sf), A.detections(spark, sf), KEYS, left_on="frame", right_on="frame", lo=-12, hi=12)
    return m.groupBy("match_id").agg(F.count(F.lit(1)).alias("n_gt"), F.count_if("matched").alias("covered"))


view("miss", "SELECT DISTINCT match_id, round_id, ce_frame AS frame FROM ce")


@query("false_positive_breakdown", f"""WITH {match_sql('dd', 'gt', 8, 'closest_pair')}, fpd AS (SELECT d.* FROM dd d ANTI JOIN fin f USING (match_id, round_id, frame)), {match_sql('fpd', 'miss', 8, 'closest_pair', p='2')}
  SELECT d.match_id, count(*) AS n_fp, count(f.frame) AS on_annotated_miss FROM fpd d LEFT JOIN fin2 f USING (match_id, round_id, frame) GROUP BY d.match_id""")
def _(spark, sf):
    fp = match(A.detections(spark, sf), A.truth(spark, sf), KEYS, 8, "closest_pair").where("gt_frame is null")
    miss = A.contacts(spark, sf).select(*KEYS, F.col("ce_frame").alias("frame"))
    m = match(fp.select(*KEYS, "frame"), miss, KEYS, 8, "closest_pair")
    return m.groupBy("match_id").agg(F.count(F.lit(1)).alias("n_fp"), F.count("gt_frame").alias("on_annotated_miss"))


_THR, _CDS = [0.02, 0.05, 0.1, 0.2], [12, 20]
_SWEEP = ("dg AS (SELECT d.*, cd, det_id*100+cd AS rid FROM det d, (SELECT unnest([12,20]) AS cd)), " + nms_sql("dg", "o.cd", tie="rid", keys=("match_id", "round_id", "cd"))
          + ", kp AS (SELECT g.match_id, g.round_id, g.cd, thr, g.frame FROM dg g SEMI JOIN ids USING (rid), (SELECT unnest([0.02::DOUBLE,0.05,0.1,0.2]) AS thr) WHERE g.score>=thr)"
          + ", gg AS (SELECT gt.*, cd, thr FROM gt, (SELECT unnest([12,20]) AS cd), (SELECT unnest([0.02::DOUBLE,0.05,0.1,0.2]) AS thr)), " + match_sql("kp", "gg", 12, "closest_pair", keys=("match_id", "round_id", "cd", "thr"))
          + ", cn AS (SELECT cd, thr, (SELECT count(*) FROM fin f WHERE f.cd=k.cd AND f.thr=k.thr) AS tp, count(*) AS nd FROM kp k GROUP BY cd, thr)"
          + f", sw AS (SELECT cd, thr, tp, nd-tp AS fp, (SELECT count(*) FROM gt)-tp AS fn FROM cn), sp AS (SELECT *, {_PRF} FROM sw)")


def sweep(spark, sf):
    return SE.threshold_sweep(A.detections(spark, sf), A.truth(spark, sf), KEYS, frame="frame", score="score", tie="det_id",
                              thresholds=_THR, cooldowns=_CDS, tol=12)


@query("threshold_cooldown_sweep", f"WITH {_SWEEP} SELECT cd, thr, tp, fp, fn, \"precision\", recall, f1 FROM sp")
def _(spark, sf):
    return sweep(spark, sf).select("cd", "thr", "tp", "fp", "fn", *[r6(F.col(c), c) for c in ("precision", "recall", "f1")])


@query("best_threshold", f"WITH {_SWEEP} SELECT cd, thr, tp, fp, fn, f1 FROM sp ORDER BY f1 DESC, cd, thr LIMIT 1")
def _(spark, sf):
    b = SE.best_config(sweep(spark, sf), ["cd", "thr"])
    return b.select("cd", "thr", "tp", "fp", "fn", r6(F.col("f1"), "f1"))


@query("constrained_best_config", f"""WITH {_SWEEP}, t AS (SELECT *, CASE WHEN "precision">=0.45 THEN 0 WHEN "precision">=0.40 THEN 1 ELSE 2 END AS tier FROM sp)
  SELECT cd, thr, tier, "precision", recall, f1 FROM t ORDER BY tier, CASE WHEN tier=0 THEN -recall ELSE -f1 END, -f1, cd, thr LIMIT 1""")
def _(spark, sf):
    b = SE.constrained_best(sweep(spark, sf), ["cd", "thr"], 0.45, 0.40)
    return b.select("cd", "thr", "tier", *[r6(F.col(c), c) for c in ("precision", "recall", "f1")])


_CONFIG_PRF = f"tp, fp, fn, {_PRF} FROM sw"


def trial_sql(kept: str, n: int, cut: str = "cut") -> str:
    """Counts of kept rows (match_id, round_id, trial, cut, frame) against the truth, for every trial and cut."""
    return (f"kp AS (SELECT DISTINCT match_id, round_id, trial, {cut} AS cut, frame FROM {kept}), gg AS (SELECT DISTINCT g.match_id, g.round_id, g.frame, k.trial, k.cut FROM gt g JOIN kp k ON k.match_id=g.match_id AND k.round_id=g.round_id AND abs(k.frame-g.frame)<=12), "
            + match_sql("kp", "gg", 12, "closest_pair", keys=("match_id", "round_id", "trial", "cut"))
            + f", cn AS (SELECT trial, cut, count(*) AS nd FROM kp GROUP BY ALL), hits AS (SELECT trial, cut, count(*) AS tp FROM fin GROUP BY ALL), grid AS (SELECT t::INT AS trial, c::INT AS cut FROM (SELECT unnest(range({n})) AS t), (SELECT unnest(range((SELECT max(cut)+1 FROM kp))) AS c))"
            + ", sw AS (SELECT trial, cut, coalesce(tp,0) AS tp, coalesce(nd,0)-coalesce(tp,0) AS fp, (SELECT count(*) FROM gt)-coalesce(tp,0) AS fn FROM grid LEFT JOIN cn USING (trial, cut) LEFT JOIN hits USING (trial, cut))")


def trial_table(t):
    return t.select("trial", "cut", "cd", "tp", "fp", "fn", *[r6(F.col(c), c) for c in ("precision", "recall", "f1")])


# votes: thresholds of each feature, all combinations; a distance of -1 is unknown and never votes
VOTE_GRID = {"audio": [0.05, 0.1, 0.2], "ce": [0.2, 0.3, 0.5], "dist": [80.0, 150.0, 250.0, 400.0], "decel": [2.0, 5.0, 10.0], "head_acc": [1.0, 2.0, 4.0], "conf": [0.3, 0.4, 0.5]}
_VG = list(product(*VOTE_GRID.values()))
MIN_VOTES, VOTE_COOLDOWNS = [1.0, 2.0, 3.0], [6, 10, 15, 20]


def vote_search(spark, sf, cooldowns):
    d = fusion_features(spark, sf).withColumn("near", F.when(F.col("dist") > 0, F.col("dist")).otherwise(float("inf")))
    names = ["near" if n == "dist" else n for n in VOTE_GRID]
    grid = np.array(_VG)
    least, most = np.where(np.array(names) == "near", -np.inf, grid), np.where(np.array(names) == "near", grid, np.inf)
    cuts = np.tile(MIN_VOTES, (len(grid), 1))
    return SE.search_trials(d, A.truth(spark, sf), KEYS, frame="frame", tie="det_id", features=names, scorer=SE.vote_scorer(least, most), trials=len(grid), cuts=cuts, cooldowns=cooldowns, tol=12)


_VG_SQL = "(SELECT row_number() OVER (ORDER BY a, c, d, e, h, f) - 1 AS trial, * FROM " + ", ".join(f"(SELECT unnest({v}::DOUBLE[]) AS {n})" for n, v in zip("acdehf", VOTE_GRID.values())) + ")"


@query("vote_grid_search", f"""WITH vg AS (SELECT x.match_id, x.round_id, x.det_id, x.frame, trial, (audio>=a)::INT+(ce>=c)::INT+(dist>0 AND dist<=d)::INT+(decel>=e)::INT+(head_acc>=h)::INT+(conf>=f)::INT AS score FROM ft8 x, {_VG_SQL}),
  vk AS (SELECT *, det_id*1000+trial AS rid FROM vg WHERE score >= 1), """ + nms_sql("vk", 10, tie="rid", keys=("match_id", "round_id", "trial"))
       + ", ck AS (SELECT v.*, m - 1 AS cut FROM vk v SEMI JOIN ids USING (rid), (SELECT unnest([1,2,3]) AS m) WHERE v.score >= m), " + trial_sql("ck", len(_VG)) + " SELECT trial, cut, 10 AS cd, " + _CONFIG_PRF)
def _(spark, sf):
    return trial_table(vote_search(spark, sf, [10]))


@query("vote_grid_search_cooldowns")
def _(spark, sf):
    """All cooldowns of the grid: the same operator, held against brute force in the tests."""
    return trial_table(vote_search(spark, sf, VOTE_COOLDOWNS))


# weights: seeded draws, one for each trial and term, by a rule that SQL can state too
N_TRIALS, HIGHEST = 4000, [1.5, 1.5, 1.5, 1.5, 1.0, 1.0, 0.5, 1.5]
TOP_SHARES, WEIGHT_COOLDOWNS = [0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40], [8, 12, 15, 20]


def weights():
    draw = lambda t, k: int(md5(f"0:{t}:{k}".encode()).hexdigest()[:8], 16) / 4294967296.0
    return np.array([[draw(t, k) * h for k, h in enumerate(HIGHEST)] for t in range(N_TRIALS)])


def weight_cuts(spark, sf, shares):
    d = cut_lineage(fusion_features(spark, sf).select(*KEYS, "det_id", "frame", *[c.alias(n) for n, c in terms().items()]).repartition(2 * spark.sparkContext.defaultParallelism, F.xxhash64("det_id")))  # a number, as few bytes make much work
    scorer = SE.linear_scorer(weights())
    return d, scorer, SE.score_cuts(d, TERMS, scorer, N_TRIALS, shares)


def weight_search(spark, sf, shares, cooldowns):
    d, scorer, cuts = weight_cuts(spark, sf, shares)
    return SE.search_trials(d, A.truth(spark, sf), KEYS, frame="frame", tie="det_id", features=TERMS, scorer=scorer, trials=N_TRIALS, cuts=cuts, cooldowns=cooldowns, tol=12)


_WT = f"""wt AS MATERIALIZED (SELECT t::INT AS trial, {", ".join(f"('0x' || substr(md5('0:' || t || ':{k}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE * {h}::DOUBLE AS w{k}" for k, h in enumerate(HIGHEST))} FROM (SELECT unnest(range({N_TRIALS})) AS t)),
  tm AS MATERIALIZED (SELECT match_id, round_id, det_id, frame, {", ".join(f"{t} AS t{k}" for k, t in enumerate(TERMS_SQL))} FROM ft8),
  rs AS MATERIALIZED (SELECT match_id, round_id, det_id, frame, trial, {"+".join(f"w{k}*t{k}" for k in range(len(HIGHEST)))} AS score FROM tm, wt)"""
_CUT = "th AS MATERIALIZED (SELECT trial, list_sort(list(score) FILTER (score>0)) AS l FROM rs GROUP BY trial)"


@query("random_weight_cuts", f"WITH {_WT}, {_CUT} SELECT trial, (c-1)::INT AS cut, round(l[greatest(0, floor(len(l)*(1-p))::BIGINT)+1], 9) AS score FROM th, (SELECT unnest({TOP_SHARES}::DOUBLE[]) AS p, generate_subscripts({TOP_SHARES}::DOUBLE[], 1) AS c) WHERE len(l) > 0")
def _(spark, sf):
    cuts = weight_cuts(spark, sf, TOP_SHARES)[2]
    return spark.createDataFrame([(t, c, round(float(v), 9)) for t, line in enumerate(cuts) for c, v in enumerate(line) if np.isfinite(v)], "trial int, cut int, score double")


@query("random_weight_search", f"WITH {_WT}, {_CUT}, rk0 AS (SELECT r.*, det_id*10000+r.trial AS rid FROM rs r JOIN th USING (trial) WHERE r.score >= l[greatest(0, floor(len(l)*(1-0.25::DOUBLE))::BIGINT)+1]), "
       + nms_sql("rk0", 12, tie="rid", keys=("match_id", "round_id", "trial")) + ", ck AS (SELECT r.*, 0 AS cut FROM rk0 r SEMI JOIN ids USING (rid)), " + trial_sql("ck", N_TRIALS) + " SELECT trial, cut, 12 AS cd, " + _CONFIG_PRF)
def _(spark, sf):
    return trial_table(weight_search(spark, sf, [0.25], [12]))


@query("random_weight_search_grid")
def _(spark, sf):
    """All percentiles and cooldowns of all trials (112,000 configurations): the same operator, held against brute force in the tests."""
    return trial_table(weight_search(spark, sf, TOP_SHARES, WEIGHT_COOLDOWNS))


@query("random_weight_best")
def _(spark, sf):
    """The configuration with the highest F1; the first in trial, cooldown and percentile order wins ties."""
    return SE.best_config(weight_search(spark, sf, TOP_SHARES, WEIGHT_COOLDOWNS), ["trial", "cd", "cut"]).select("trial", "cd", "cut", "tp", "fp", "fn", *[r6(F.col(c), c) for c in ("precision", "recall", "f1")])


_FPS, _TOLS = [25.0, 30.0, 24.995], [4, 8, 12]


@query("multi_tolerance_evaluation", f"WITH cf AS (SELECT tol, fps FROM (SELECT unnest({_TOLS}) AS tol), (SELECT unnest({_FPS}::DOUBLE[]) AS fps)), tk AS (SELECT dd.*, tol, fps FROM dd, cf), tg AS (SELECT DISTINCT match_id, round_id, round_even(gt.frame/fps*25,0)::INTEGER AS frame, tol, fps FROM gt, cf), "
       + match_sql("tk", "tg", "d.tol", "closest_pair", keys=("match_id", "round_id", "tol", "fps")) + f", hit AS (SELECT tol, fps, count(*) AS tp FROM fin GROUP BY ALL), ng AS (SELECT tol, fps, count(*) AS n FROM tg GROUP BY ALL), sw AS (SELECT tol, fps, tp, (SELECT count(*) FROM dd)-tp AS fp, n-tp AS fn FROM hit JOIN ng USING (tol, fps)) SELECT tol, fps, tp, fp, fn, {_PRF} FROM sw")
def _(spark, sf):
    """Truth labelled under several frame rates, in frames of 25 a second; all rates of a tolerance are matched at once."""
    det = SE.with_grid(A.detections(spark, sf).select(*KEYS, "frame"), {"fps": _FPS})
    truth = SE.with_grid(A.truth(spark, sf), {"fps": _FPS}).withColumn("frame", F.bround(F.col("frame") / F.col("fps") * 25, 0).cast("int")).distinct()
    out = None
    for tol in _TOLS:
        c = match_counts(match(det, truth, [*KEYS, "fps"], tol, "closest_pair"), truth, [*KEYS, "fps"])
        c = c.groupBy("fps").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")]).withColumn("tol", F.lit(tol))
        out = c if out is None else out.unionByName(c)
    return with_prf(out).select("tol", "fps", "tp", "fp", "fn", *[r6(F.col(c), c) for c in ("precision", "recall", "f1")])


@query("ground_truth_relabel", """WITH h AS (SELECT *, (x1+x2)/2 AS hx, y1+0.18*(y2-y1) AS hy FROM box),
  rc AS (SELECT b.*, coalesce(sqrt((n.hx-p.hx)**2+(n.hy-p.hy)**2),0) AS react FROM h b LEFT JOIN h p ON p.match_id=b.match_id AND p.round_id=b.round_id AND p.track_id=b.track_id AND p.frame=b.frame-1
    LEFT JOIN h n ON n.match_id=b.match_id AND n.round_id=b.round_id AND n.track_id=b.track_id AND n.frame=b.frame+1),
  sg AS (SELECT s.match_id, s.round_id, s.frame, s.track_id AS sid, 0.55*greatest(0.0::DOUBLE, 1-sqrt(((CASE WHEN s.x1+s.x2<r.x1+r.x2 THEN s.x2 ELSE s.x1 END)-r.hx)**2+(s.y1+0.28*(s.y2-s.y1)-r.hy)**2)/500.0)
    +0.30*(SELECT coalesce(max(strength),0) FROM ons o WHERE o.match_id=s.match_id AND o.round_id=s.round_id AND abs(o.onset_frame-s.frame)<=4)+0.15*least(1.0::DOUBLE, r.react/50.0) AS score
    FROM rc s JOIN rc r ON s.match_id=r.match_id AND s.round_id=r.round_id AND s.frame=r.frame AND s.track_id<>r.track_id)
  SELECT match_id, round_id, frame, best_frame, sid AS striker_id, round(score,6) AS score, best_frame-frame AS delta FROM (SELECT g.*, s.frame AS best_frame, s.sid, s.score, row_number() OVER (PARTITION BY g.match_id, g.round_id, g.frame ORDER BY s.score DESC NULLS LAST, s.frame, s.sid) AS rn
    FROM gt g LEFT JOIN sg s ON s.match_id=g.match_id AND s.round_id=g.round_id AND abs(s.frame-g.frame)<=60) WHERE rn=1""")
def _(spark, sf):
    d = E.relabel(A.truth(spark, sf), E.relabel_signals(A.boxes(spark, sf), A.onsets(spark, sf)))
    return d.select(*KEYS, "frame", "best_frame", "striker_id", r6(F.col("score"), "score"), (F.col("best_frame") - F.col("frame")).alias("delta"))


view("lab", "SELECT f.*, CAST(EXISTS (SELECT 1 FROM gt g WHERE g.match_id=f.match_id AND g.round_id=f.round_id AND abs(g.frame-f.frame)<=12) AS INTEGER) AS y FROM ft f")


def labelled(spark, sf):
    m = J.matched_in_band(features(spark, sf), A.truth(spark, sf), KEYS, left_on="frame", right_on="frame", lo=-12, hi=12)
    return m.withColumn("y", F.col("matched").cast("int")).drop("matched")


@query("stratified_folds", """SELECT det_id, CAST((row_number() OVER (PARTITION BY y ORDER BY ('0x' || substr(md5(det_id::VARCHAR),1,8))::BIGINT, det_id)-1) % 5 AS INTEGER) AS fold FROM lab""")
def _(spark, sf):
    return E.stratified_folds(labelled(spark, sf), "y", "det_id", 5).select("det_id", "fold")


@query("temporal_block_folds", "SELECT det_id, CAST(ntile(5) OVER (PARTITION BY match_id ORDER BY round_id*240+frame, det_id)-1 AS INTEGER) AS fold FROM det")
def _(spark, sf):
    d = A.detections(spark, sf).withColumn("t", F.col("round_id") * 240 + F.col("frame"))
    return blocks_by_rank(d, ["match_id"], "t", 5, "fold", ["det_id"]).select("det_id", "fold")


@query("leave_one_group_folds", "SELECT match_id || '_R' || round_id AS held_out, count(*) AS n_test, sum(y)::BIGINT AS n_pos FROM lab GROUP BY ALL")
def _(spark, sf):
    g = F.concat_ws("_R", F.col("match_id").cast("string"), F.col("round_id").cast("string"))
    return labelled(spark, sf).groupBy(g.alias("held_out")).agg(F.count(F.lit(1)).alias("n_test"), F.sum("y").alias("n_pos"))


_AUC = "(sum(r) FILTER (y=1)-count_if(y=1)*(count_if(y=1)+1)/2)/nullif(count_if(y=1)*count_if(y=0),0)"
_RANK = "rank() OVER (PARTITION BY {k} ORDER BY {s}) + (count(*) OVER (PARTITION BY {k}, {s})-1)/2.0"


@query("roc_auc_report", f"SELECT fold, count_if(y=1)::BIGINT AS n_pos, count_if(y=0)::BIGINT AS n_neg, round({_AUC},6) AS auc FROM (SELECT match_id%3 AS fold, y, {_RANK.format(k='match_id%3', s='score')} AS r FROM lab) GROUP BY fold")
def _(spark, sf):
    d = labelled(spark, sf).select(F.pmod("match_id", F.lit(3)).alias("fold"), "y", "score")
    return roc_auc(d, ["fold"], "y", "score").select("fold", "n_pos", "n_neg", r6(F.col("auc"), "auc"))


@query("confusion_matrix", "SELECT match_id, count_if(y=1 AND score>=0.1)::BIGINT AS tp, count_if(y=0 AND score>=0.1)::BIGINT AS fp, count_if(y=1 AND score<0.1)::BIGINT AS fn, count_if(y=0 AND score<0.1)::BIGINT AS tn FROM lab GROUP BY match_id")
def _(spark, sf):
    return E.confusion(labelled(spark, sf), ["match_id"], "y", "score", 0.1)


@query("scorer_report_row", f"""SELECT 'raw' AS scorer, round(count_if((score>=0.1)=(y=1))/count(*),6) AS accuracy, round(count_if(y=1 AND score>=0.1)/count_if(score>=0.1),6) AS "precision", round(count_if(y=1 AND score>=0.1)/count_if(y=1),6) AS recall,
  round({_AUC},6) AS auc FROM (SELECT *, {_RANK.format(k='1', s='score')} AS r FROM lab)""")
def _(spark, sf):
    d = labelled(spark, sf).withColumn("scorer", F.lit("raw"))
    c = with_prf(E.confusion(d, ["scorer"], "y", "score", 0.1))
    acc = (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    return c.join(roc_auc(d, ["scorer"], "y", "score"), "scorer").select("scorer", r6(acc, "accuracy"), r6(F.col("precision"), "precision"), r6(F.col("recall"), "recall"), r6(F.col("auc"), "auc"))


@query("ensemble_verdict", f"""WITH s AS (SELECT det_id, y, unnest(['a','b','combo']) AS scorer, unnest([score, ce, 0.5*score+0.5*ce]) AS v FROM lab), u AS (SELECT scorer, {_AUC} AS auc FROM (SELECT scorer, y, {_RANK.format(k='scorer', s='v')} AS r FROM s) GROUP BY scorer),
  p AS (SELECT max(auc) FILTER (scorer='combo') AS combo, max(auc) FILTER (scorer<>'combo') AS best FROM u) SELECT round(combo,6) AS combo, round(best,6) AS best, CASE WHEN combo>best+0.01 THEN 'HELPS' WHEN abs(combo-best)<=0.01 THEN 'NEUTRAL' ELSE 'HURTS' END AS verdict FROM p""")
def _(spark, sf):
    rows = F.array(*[F.struct(F.lit(n).alias("scorer"), e.alias("v")) for n, e in (("a", F.col("score")), ("b", F.col("ce")), ("combo", 0.5 * F.col("score") + 0.5 * F.col("ce")))])
    d = labelled(spark, sf).select("y", F.explode(rows).alias("x")).select("y", "x.*")
    u = roc_auc(d, ["scorer"], "y", "v")
    p = u.agg(F.max(F.when(F.col("scorer") == "combo", F.col("auc"))).alias("combo"), F.max(F.when(F.col("scorer") != "combo", F.col("auc"))).alias("best"))
    return p.select(r6(F.col("combo"), "combo"), r6(F.col("best"), "best"), E.combo_verdict(F.col("combo"), F.col("best")).alias("verdict"))


def descent_sql(src: str, d: int, steps: int = 1500, rate: float = 0.8, p: str = "") -> str:
    """Ridge-penalised logistic regression of every group g by full gradient descent until it stands still: weights w0..wd in co{p}.

    src: columns g, y, c (row weight), x0..x(d-1). The fits of the plans are Newton's; both reach the one optimum."""
    k = range(d)
    z = "+".join([f"w{i}*z{i}" for i in k]) + f"+w{d}"
    ws = ", ".join(f"w{i}" for i in range(d + 1))
    step = ", ".join([f"w{i}-{rate}*(avg(c*(p-y)*z{i})+0.001*w{i})" for i in k] + [f"w{d}-{rate}*(avg(c*(p-y))+0.001*w{d})"])
    return (f"st{p} AS MATERIALIZED (SELECT g, {', '.join(f'avg(x{i}) AS m{i}, stddev_pop(x{i})+1e-6 AS s{i}' for i in k)} FROM {src} GROUP BY g), "
            f"zr{p} AS MATERIALIZED (SELECT r.g, y, c, {', '.join(f'(x{i}-m{i})/s{i} AS z{i}' for i in k)} FROM {src} r JOIN st{p} USING (g)), "
            f"gd{p} AS (SELECT g, 0 AS step, {', '.join(f'0.0::DOUBLE AS w{i}' for i in range(d + 1))} FROM st{p} UNION ALL SELECT g, step+1, {step} FROM "
            f"(SELECT s.*, z.* EXCLUDE (g), 1/(1+exp(-({z}))) AS p FROM gd{p} s JOIN zr{p} z USING (g)) GROUP BY g, step, {ws} HAVING step < {steps}), co{p} AS (SELECT * FROM gd{p} WHERE step = {steps})")


def score_sql(d: int) -> str:
    """Probability of a row x0.. joined with the st and co of its group."""
    return "1/(1+exp(-(" + "+".join(f"w{i}*(x{i}-m{i})/s{i}" for i in range(d)) + f"+w{d})))"


def report_sql(src: str, keys: str) -> str:
    """n, accuracy, precision, recall, F1 and AUC of src (keys, fold, y, p) by fold, with a row of means."""
    return f"""rr AS (SELECT {keys}, fold, y, p, {_RANK.format(k=keys + ', fold', s='p')} AS r FROM {src}), cn2 AS (SELECT {keys}, fold::VARCHAR AS fold, count(*) AS n, count_if(y=1 AND p>=0.5) AS tp, count_if(y=0 AND p>=0.5) AS fp, count_if(y=1 AND p<0.5) AS fn, count_if(y=0 AND p<0.5) AS tn, {_AUC} AS auc FROM rr GROUP BY ALL),
  rp AS (SELECT {keys}, fold, n, (tp+tn)/n AS accuracy, CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 0 END AS "precision", CASE WHEN tp+fn>0 THEN tp/(tp+fn) ELSE 0 END AS recall, CASE WHEN tp>0 THEN 2*tp/(2*tp+fp+fn) ELSE 0 END AS f1, auc FROM cn2),
  al2 AS (SELECT * FROM rp UNION ALL SELECT {keys}, 'mean', sum(n), avg(accuracy), avg("precision"), avg(recall), avg(f1), avg(auc) FROM rp GROUP BY ALL) SELECT {keys}, fold, n::BIGINT AS n, round(accuracy,4) AS accuracy, round("precision",4) AS "precision", round(recall,4) AS recall, round(f1,4) AS f1, round(auc,4) AS auc FROM al2"""


def report_columns(t, *keys):
    return t.select(*keys, "fold", "n", *[F.round(c, 4).alias(c) for c in ("accuracy", "precision", "recall", "f1", "auc")])


_LENGTHS = [3, 6, 8, 10]


@query("window_length_ablation", f"""WITH o AS (SELECT *, ntile(5) OVER (ORDER BY match_id, round_id, action_frame, action_id)-1 AS fold FROM pact), w AS (SELECT a.action_id, t, a.fold, CAST(EXISTS (SELECT 1 FROM pce c WHERE c.match_id=a.match_id AND c.round_id=a.round_id AND c.striker_id=a.fighter_id AND abs(c.ce_frame-a.action_frame)<=3) AS INTEGER) AS y,
    -min(p.head_gap) AS x0, avg(p.head_gap) AS x1, max(p.iou) AS x2, min(p.guard_d) AS x3, 1.0::DOUBLE AS c FROM o a JOIN (SELECT unnest({_LENGTHS}) AS t) ON true JOIN pgap p ON p.match_id=a.match_id AND p.round_id=a.round_id AND p.striker_id=a.fighter_id AND abs(p.frame-a.action_frame)<=t GROUP BY ALL),
  tr AS (SELECT t*10+h AS g, y, c, x0, x1, x2, x3 FROM w, (SELECT unnest(range(5)) AS h) WHERE h <> fold), {descent_sql('tr', 4)},
  oof AS (SELECT t, fold, y, round({score_sql(4)}, 7) AS p FROM w JOIN st ON st.g=t*10+fold JOIN co ON co.g=st.g), {report_sql('oof', 't')}""")
def _(spark, sf):
    """A model for every window length and held-out block of time, all fitted together; every action is scored by the model that did not see its block."""
    from contactflow.operators import gates as GA
    p = GA.pair_frames(GA.hot_joints(A.pose(spark, sf), A.PROFILE)).select(*KEYS, F.col("striker_id").alias("fighter_id"), "frame", "head_gap", "iou", "guard_d")
    a = A.pose_actions(spark, sf)
    c = A.pose_contacts(spark, sf).select(*KEYS, F.col("striker_id").alias("fighter_id"), "ce_frame")
    a = J.matched_in_band(a, c, [*KEYS, "fighter_id"], left_on="action_frame", right_on="ce_frame", lo=-3, hi=3)
    a = blocks_by_rank(a.withColumns({"all": F.lit(1), "t0": (F.col("match_id").cast("long") * 100 + F.col("round_id")) * 1000000 + F.col("action_frame")}), ["all"], "t0", 5, "fold", ["action_id"]).drop("all", "t0")
    # one join at the longest window; shorter ones are conditional aggregates of it
    j = J.interval_join(a, p, [*KEYS, "fighter_id"], start="action_frame", end="action_frame", before=10, after=10)
    off = F.abs(F.col("frame") - F.col("action_frame"))
    inside = lambda f, col, t: f(F.when(off <= t, F.col(col)))
    g = j.groupBy("action_id", "matched", "fold").agg(*[F.struct((-inside(F.min, "head_gap", t)).alias("x0"), inside(F.avg, "head_gap", t).alias("x1"), inside(F.max, "iou", t).alias("x2"), inside(F.min, "guard_d", t).alias("x3")).alias(f"w{t}") for t in _LENGTHS])
    u = g.select(F.col("matched").cast("int").alias("y"), "fold", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), f"w{t}.*") for t in _LENGTHS])).alias("x")).select("y", "fold", "x.*")
    u, names = cut_lineage(u), ["x0", "x1", "x2", "x3"]
    model = ML.grouped_logistic(ML.left_out(u, "fold", 5), ["t", "held"], names, "y")
    s = ML.apply_scorer(u.withColumn("held", F.col("fold")), model, ["t", "held"], names)
    return report_columns(ML.fold_report(s.withColumn("prob", F.round("prob", 7)), ["t"], "fold", "y", "prob"), "t")



@query("reachability_report", """SELECT g.match_id, count(*) AS n_gt, count_if(EXISTS (SELECT 1 FROM act a WHERE a.match_id=g.match_id AND a.round_id=g.round_id AND abs(a.action_frame-g.frame)<=12))::BIGINT AS by_action,
  count_if(EXISTS (SELECT 1 FROM ce a WHERE a.match_id=g.match_id AND a.round_id=g.round_id AND abs(a.ce_frame-g.frame)<=12))::BIGINT AS by_contact, count_if(EXISTS (SELECT 1 FROM det a WHERE a.match_id=g.match_id AND a.round_id=g.round_id AND abs(a.frame-g.frame)<=12))::BIGINT AS by_detection FROM gt g GROUP BY g.match_id""")
def _(spark, sf):
    g = A.truth(spark, sf)
    for t, c, n in ((A.actions, "action_frame", "by_action"), (A.contacts, "ce_frame", "by_contact"), (A.detections, "frame", "by_detection")):
        g = J.matched_in_band(g, t(spark, sf), KEYS, left_on="frame", right_on=c, lo=-12, hi=12, out=n)
    return g.groupBy("match_id").agg(F.count(F.lit(1)).alias("n_gt"), *[F.count_if(n).alias(n) for n in ("by_action", "by_contact", "by_detection")])
