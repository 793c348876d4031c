"""Values that follow by hand from the formulas."""
import pytest
from pyspark.sql import functions as F

from contactflow.functions import geometry as G
from contactflow.functions import kinematics as K
from contactflow.functions import scoring as SC
from contactflow.operators import labels as L
from contactflow.operators.gates_extra import top_landmark_contact
from contactflow.operators.joins import bucket_asof
from contactflow.operators.matching import match
from contactflow.operators.ranking import ranked
from contactflow.operators.suppress import first_fit, greedy_nms


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def pt(x, y, z=None):
    c = [F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")]
    return F.struct(*c, *([F.lit(float(z)).alias("z")] if z is not None else []))


def box(*v):
    return F.struct(*[F.lit(float(a)).alias(n) for a, n in zip(v, ("x1", "y1", "x2", "y2"))])


@pytest.mark.parametrize("text,frame,floor", [("7:11", 186, 185), ("1:05:22", 1647, 1646)])
def test_timecode(spark, text, frame, floor):
    assert one(spark, SC.timecode_frame(F.lit(text), 24.995)) == frame
    assert one(spark, SC.timecode_frame(F.lit(text), 24.995, "floor")) == floor


def test_distances(spark):
    assert one(spark, G.dist(pt(0.31, 1.61, 3.5), pt(0.29, 1.60, 3.5), "xyz")) == pytest.approx(0.02236, abs=1e-5)
    assert one(spark, G.dist(pt(0.637, -0.219, 1.937), pt(0.572, -0.055, 1.833), "xyz")) == pytest.approx(0.20479, abs=1e-5)
    assert one(spark, G.segment_distance(pt(1, 1), pt(0, 0), pt(2, 0))) == 1.0
    assert one(spark, G.segment_distance(pt(3, 4), pt(0, 0), pt(0, 0))) == 5.0


def test_iou(spark):
    assert one(spark, G.box_iou(box(0, 0, 2, 2), box(1, 1, 3, 3))) == pytest.approx(1 / 7, abs=1e-6)
    assert one(spark, G.box_iou(box(0, 0, 1, 1), box(2, 2, 3, 3))) == 0.0


def test_gate_formulas(spark):
    assert one(spark, SC.action_confidence(F.lit(0.72), F.lit(148.0), F.lit(7.2))) == pytest.approx(0.444333, abs=1e-6)
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    assert one(spark, top_landmark_contact(arr(0.7, 0.2), arr(1.0, 0.8))) == pytest.approx(0.43)
    assert one(spark, K.slope(arr(1.0, 3.0, 5.0))) == pytest.approx(2.0)
    assert one(spark, K.correlation(arr(1.0, 2.0, 3.0), arr(2.0, 4.0, 6.0))) == pytest.approx(1.0)
    assert one(spark, K.clip01(F.lit(None).cast("double"))) is None


def test_degenerate_projection_is_null(spark):
    joints = F.array(pt(1, 1, 1), pt(1, 2, 1))
    assert one(spark, G.project_to_box(joints, box(0, 0, 10, 10), pt(1, 1, 1))) is None


def test_short_trajectories_score_zero(spark):
    t = F.array(F.struct(F.lit(1).alias("frame"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")))
    for gate in (K.decel_score(t), K.jerk_score(t), K.scalar_jerk_score(t), K.depth_convergence(t)):
        assert one(spark, gate) == 0.0


def test_suppression_goldens(spark):
    d = spark.createDataFrame([(1, 10, 0.9, 1), (1, 14, 0.95, 2), (1, 18, 0.8, 3)], "k int, frame int, score double, id int")
    assert [r.frame for r in greedy_nms(d, ["k"], "frame", "score", 5, tie="id").collect()] == [14]
    assert sorted(r.frame for r in first_fit(d, ["k"], "frame", 5, tie=["id"]).collect()) == [10, 18]


def test_matchers_differ(spark):
    d = spark.createDataFrame([(1, 10), (1, 12)], "k int, frame int")
    g = spark.createDataFrame([(1, 12)], "k int, frame int")
    got = {m: {r.frame: r.gt_frame for r in match(d, g, ["k"], 5, m).collect()} for m in ("nearest_unused", "closest_pair")}
    assert got["nearest_unused"] == {10: 12, 12: None}
    assert got["closest_pair"] == {10: None, 12: 12}


def test_no_detections(spark):
    from contactflow.operators.matching import match_counts, with_prf
    d = spark.createDataFrame([], "k int, frame int")
    g = spark.createDataFrame([(1, 12)], "k int, frame int")
    r = with_prf(match_counts(match(d, g, ["k"], 5, "closest_pair"), g, ["k"])).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) == (0, 0, 1, 0.0, 0.0, 0.0)


def test_swap_bucket_and_parts(spark):
    d = spark.createDataFrame([(1, 715), (1, 40)], "k int, frame int")
    s = spark.createDataFrame([(1, 700, True)], "k int, frame int, swapped boolean")
    got = {r.frame: r.swapped for r in bucket_asof(d, s, ["k"], frame="frame", stride=20, value="swapped", default=F.lit(False)).collect()}
    assert got == {715: True, 40: False}
    assert one(spark, L.part_to_global(F.lit(2), F.lit(1))) == 1500


def test_rank_normalise(spark):
    d = spark.createDataFrame([(1, 3.0, 1), (1, 1.0, 2), (1, 2.0, 3)], "k int, s double, id int")
    got = {r.id: (r.rank_first - 1) / (r.n - 1) for r in ranked(d, ["k"], "s", tie=["id"]).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.5}


def test_bad_fighter_and_verdict_raise(spark):
    with pytest.raises(Exception, match="not a fighter id"):
        one(spark, G.track_of_fighter(F.lit("boxer_1")))
    d = spark.createDataFrame([(1,)], "frame int")
    with pytest.raises(Exception, match="unknown verdict"):
        L.apply_verdicts(d, spark.createDataFrame([(1, "MAYBE")], "frame int, verdict string"), ["frame"]).collect()
