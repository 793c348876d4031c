"""Ordered operators against whole-list brute force, on recordings that span many blocks."""
import random

import pytest
from pyspark.sql import functions as F

from contactflow.operators import ordering as O
from contactflow.operators.matching import METHODS, match
from contactflow.operators.suppress import first_fit, greedy_nms, pair_global_cooldown


def rows(seed, n, span, keys=2, ramp=False):
    r = random.Random(seed)
    out = []
    for i in range(n):
        f = r.randrange(span)
        s = 1 - f / span if ramp else round(r.random(), 2)
        out.append((r.randrange(keys), f, s, i))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "k int, frame int, score double, id int")


@pytest.mark.parametrize("ramp", [False, True])
def test_nms_equals_whole_list(spark, ramp):
    data = rows(1, 900, 1500, ramp=ramp)
    kept = set()
    for k in (0, 1):
        mine = []
        for f, s, i in sorted(((f, s, i) for kk, f, s, i in data if kk == k), key=lambda t: (-t[1], t[0], t[2])):
            if all(abs(f - g) >= 2 for g, _ in mine):
                mine.append((f, i))
        kept |= {i for _, i in mine}
    got = greedy_nms(frame(spark, data), ["k"], "frame", "score", 2, tie="id", size=1)
    assert {r.id for r in got.collect()} == kept


@pytest.mark.parametrize("kind", ["constant", "ramp", "fall", "vee", "saw", "gaps"])
def test_nms_settles_long_runs_in_few_steps(spark, kind, monkeypatch):
    """Runs over 64 blocks, in which a row's outcome depends on rows of all of them."""
    from contactflow.operators import suppress
    cd, n = 2, 64 * 8 * 32  # a block has 8 halos of 16 cooldowns
    score = {"constant": lambda f: 1.0, "ramp": lambda f: f / n, "fall": lambda f: 1 - f / n, "vee": lambda f: abs(f - n / 2), "saw": lambda f: (f % 3000) / 3000, "gaps": lambda f: 1.0}[kind]
    r = random.Random(2)
    data = [(1, f, score(f), f) for f in range(n) if r.random() < 0.9 and (kind != "gaps" or f % 1500 < 700)]
    kept: list = []
    taken = set()
    for f, s, i in sorted(((f, s, i) for _, f, s, i in data), key=lambda t: (-t[1], t[0])):
        if not any(g in taken for g in range(f - cd + 1, f + cd)):
            taken.add(f)
            kept.append(i)
    steps = []
    monkeypatch.setattr(suppress, "cut_lineage", lambda d, f=suppress.cut_lineage: (steps.append(1), f(d))[1])
    got = greedy_nms(frame(spark, data), ["k"], "frame", "score", cd, tie="id", size=1)
    assert {x.id for x in got.collect()} == set(kept)
    assert len(steps) <= 8


@pytest.mark.parametrize("cd,n", [(5, 1500), (7, 200)])
def test_first_fit_equals_whole_list(spark, cd, n):
    data = rows(2, n, 1200)
    kept = set()
    for k in (0, 1):
        last = None
        for f, i in sorted((f, i) for kk, f, _, i in data if kk == k):
            if last is None or f - last >= cd:
                kept.add(i)
                last = f
    got = first_fit(frame(spark, data), ["k"], "frame", cd, tie=["id"], size=16)
    assert {r.id for r in got.collect()} == kept


def test_pair_global_equals_whole_list(spark):
    data = [(k, f, float(p), i) for (k, f, _, i), p in zip(rows(3, 500, 900), [random.Random(5).randrange(3) for _ in range(500)])]
    kept = set()
    for k in (0, 1):
        g, last = None, {}
        for f, p, i in sorted((f, str(p), i) for kk, f, p, i in data if kk == k):
            if (g is None or f - g >= 3) and (p not in last or f - last[p] >= 8):
                g = last[p] = f
                kept.add(i)
    got = pair_global_cooldown(frame(spark, data), ["k"], "frame", F.col("score").cast("string"), pair_cooldown=8, global_cooldown=3, tie=["id"])
    assert {r.id for r in got.collect()} == kept


@pytest.mark.parametrize("kind,pc,gc", [("dense", 8, 3), ("dense", 30, 20), ("dense", 5, 5), ("sparse", 12, 2), ("sparse", 9, 0), ("one", 7, 10)])
def test_cooldown_blocks_compose(spark, kind, pc, gc):
    """Dense runs over 16 blocks and more: blocks never come to rest, so every block's table counts."""
    r = random.Random(pc * 100 + gc)
    n = 16 * max(2 * pc, 2 * gc, 16)
    data = [(1, f, p, 3 * f + p) for f in range(n) for p in (range(1) if kind == "one" else range(3)) if kind != "sparse" or r.random() < 0.25]
    kept, g, last = set(), None, {}
    for _, f, p, i in sorted(data, key=lambda t: (t[1], str(t[2]))):
        if (g is None or f - g >= gc) and (p not in last or f - last[p] >= pc):
            g = last[p] = f
            kept.add(i)
    d = spark.createDataFrame(data, "k int, frame int, p int, id int")
    got = pair_global_cooldown(d, ["k"], "frame", F.col("p").cast("string"), pair_cooldown=pc, global_cooldown=gc, tie=["id"], size=16)
    assert {x.id for x in got.collect()} == kept


@pytest.mark.parametrize("method", METHODS)
def test_matching_equals_whole_list(spark, method):
    r = random.Random(7)
    det = sorted(r.sample(range(1200), 500))
    gts = sorted(r.sample(range(1200), 400))
    tol = 2
    order = {"nearest_unused": lambda d, g: (d, abs(d - g), g), "first_unused": lambda d, g: (d, g), "closest_pair": lambda d, g: (abs(d - g), d, g)}[method]
    want, used = {}, set()
    for d, g in sorted(((d, g) for d in det for g in gts if abs(d - g) <= tol), key=lambda p: order(*p)):
        if d not in want and g not in used:
            want[d] = g
            used.add(g)
    mk = lambda v: spark.createDataFrame([(1, f) for f in v], "k int, frame int")
    got = {x.frame: x.gt_frame for x in match(mk(det), mk(gts), ["k"], tol, method, size=1).collect()}
    assert got == {d: want.get(d) for d in det}


def test_scans_cross_blocks(spark):
    r = random.Random(11)
    fr = sorted(r.sample(range(400), 150))
    data = [(1, f, float(r.randrange(50)) if r.random() < 0.4 else None, i) for i, f in enumerate(fr)]
    d = frame(spark, data)
    fill = {x.frame: x.o for x in O.forward_fill(d, ["k"], "frame", "score", "o", size=8).collect()}
    back = {x.frame: x.o for x in O.forward_fill(d, ["k"], "frame", "score", "o", size=8, descending=True).collect()}
    cum = {x.frame: x.o for x in O.running_sum(d.na.fill(0.0), ["k"], "frame", "score", "o", size=8).collect()}
    num = {x.frame: x.o for x in O.row_number(d, ["k"], "frame", "o", size=8).collect()}
    prev = {x.frame: x.o for x in O.previous_row(d, ["k"], "frame", F.col("frame"), "o", size=8).collect()}
    ema = {x.frame: x.o for x in O.ema_scan(d.na.fill(1.0), ["k"], "frame", "score", 0.7, "o", size=8).collect()}
    last, total, e, before = None, 0.0, None, None
    for n, (_, f, v, _) in enumerate(data, 1):
        last = v if v is not None else last
        total += v or 0.0
        x = 1.0 if v is None else v
        e = x if e is None else 0.7 * x + 0.3 * e
        assert (fill[f], num[f], prev[f]) == (last, n, before)
        assert cum[f] == pytest.approx(total) and ema[f] == pytest.approx(e)
        before = f
    nxt = None
    for _, f, v, _ in reversed(data):
        nxt = v if v is not None else nxt
        assert back[f] == nxt


def test_islands_and_windows_cross_blocks(spark):
    r = random.Random(13)
    fr = sorted(r.sample(range(600), 180))
    d = spark.createDataFrame([(1, f) for f in fr], "k int, frame int")
    got = {x.frame: x.island for x in O.islands(d, ["k"], "frame", 5, size=8).collect()}
    start, prev = None, None
    for f in fr:
        start = f if prev is None or f - prev >= 5 else start
        assert got[f] == start
        prev = f
    b = O.blocked(d, ["k"], "frame", 3, 4, size=8)
    n = b.core(b.df.withColumn("n", F.count(F.lit(1)).over(b.span(-3, 4))).withColumn("at2", b.at(F.col("frame"), 2)))
    for x in n.collect():
        assert x.n == sum(1 for g in fr if x.frame - 3 <= g <= x.frame + 4)
        assert x.at2 == (x.frame + 2 if x.frame + 2 in fr else None)
    dense = sorted(x.frame for x in O.densify(d, ["k"], "frame", chunk=16).collect())
    assert dense == list(range(fr[0], fr[-1] + 1))


def test_merge_windows_crosses_blocks(spark):
    from contactflow.operators.candidates import merge_windows
    r = random.Random(17)
    w = [(1, s, s + r.randrange(1, 40), f"a{i}", r.random(), i) for i, s in enumerate(r.randrange(800) for _ in range(60))]
    d = spark.createDataFrame(w, "k int, window_start int, window_end int, action string, confidence double, id int")
    want = []
    for _, s, e, _, _, _ in sorted(w, key=lambda t: (t[1], t[5])):
        if want and s - want[-1][1] <= 3:
            want[-1][1] = max(want[-1][1], e)
        else:
            want.append([s, e])
    got = sorted([x.window_start, x.window_end] for x in merge_windows(d, ["k"], 3, size=16).collect())
    assert got == want


def test_prominence_looks_as_far_as_needed(spark):
    from contactflow.operators.audio import prominent
    v = [0.5] * 200
    v[100], v[0], v[199] = 0.6, 0.1, 0.1      # falls far enough only at the ends
    sig = spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "k int, f int, v double")
    peak = sig.where("f = 100")
    assert prominent(peak, sig, ["k"], "f", "v", 0.3, size=4).count() == 1
    assert prominent(peak, sig, ["k"], "f", "v", 0.55, size=4).count() == 0


@pytest.mark.parametrize("kind", ["noise", "steps", "rise", "flat"])
def test_prominence_equals_brute_force(spark, kind):
    from contactflow.operators.audio import local_peaks, prominent
    r = random.Random(41)
    make = {"noise": lambda i: r.random(), "steps": lambda i: r.randrange(6) / 10, "rise": lambda i: i / 500 + (0.3 if i % 7 == 0 else 0.1 * r.random()), "flat": lambda i: 0.9 if i % 5 == 0 else 0.7}[kind]
    v = {i: make(i) for i in range(600) if kind == "flat" or r.random() < 0.97}
    sig = spark.createDataFrame(list((1, i, x) for i, x in v.items()), "k int, f int, v double")
    peaks = local_peaks(sig, ["k"], "f", "v", 0.0).withColumn("extra", F.lit("x"))
    for needed in (0.1, 0.2, 0.35, 0.8):
        want = set()
        for p in (x.f for x in peaks.collect()):
            fell = []
            for step in (-1, 1):
                low, g = float("inf"), p + step
                while 0 <= g < 600 and not (g in v and v[g] > v[p]):
                    low, g = min(low, v.get(g, low)), g + step
                fell.append(v[p] - low >= needed)
            want |= {p} if all(fell) else set()
        got = prominent(peaks, sig, ["k"], "f", "v", needed, size=16)
        assert got.columns == peaks.columns and {x.f for x in got.collect()} == want


def test_ranks_split_a_hot_score(spark):
    from contactflow.operators.ranking import ranked
    r = random.Random(19)
    data = [(1, 0.0 if r.random() < 0.7 else r.random(), i) for i in range(600)]
    r.shuffle(data)
    d = spark.createDataFrame(data, "k int, s double, id long")
    want = {i: n for n, (_, i) in enumerate(sorted((s, i) for _, s, i in data), 1)}
    for hot in (50, 10_000):
        assert {x.id: x.rank_first for x in ranked(d, ["k"], "s", tie=["id"], hot=hot).collect()} == want
    named = d.withColumn("name", F.format_string("%04d", "id"))  # a tie column of any type, in the same plan
    for tie in (["name"], ["name", "id"]):
        assert {x.id: x.rank_first for x in ranked(named, ["k"], "s", tie=tie, hot=50).collect()} == want


def test_steps_are_exact_at_block_edges(spark, monkeypatch):
    from contactflow.operators import gates_extra as GX
    r = random.Random(23)
    data = [(1, 0, 0, f, (r.random() * 50, 0.0, 60.0, 100.0)) for f in range(300) if r.random() < 0.9]
    d = spark.createDataFrame(data, "match_id int, round_id int, track_id int, frame int, bbox struct<x1:double,y1:double,x2:double,y2:double>")
    whole = {x.frame: (x.motion_pre, x.motion_post, x.head_accel) for x in GX.receiver_motion(d).collect()}
    snap = {x.frame: x.g_bbox_react for x in GX.box_snap(d).collect()}
    monkeypatch.setattr(GX, "blocked", lambda *a, **k: O.blocked(*a, **k, size=20))
    assert {x.frame: (x.motion_pre, x.motion_post, x.head_accel) for x in GX.receiver_motion(d).collect()} == whole
    assert {x.frame: x.g_bbox_react for x in GX.box_snap(d).collect()} == snap


def test_interpolation_crosses_blocks(spark):
    import numpy as np
    from contactflow.operators.smoothing import interpolate
    r = random.Random(29)
    known = sorted(r.sample(range(300), 25))
    vals = {f: float(r.randrange(100)) for f in known}
    d = spark.createDataFrame([(1, f, v) for f, v in vals.items()], "k int, frame int, v double")
    got = {x.frame: x.v for x in interpolate(d, ["k"], "frame", "v", size=8).collect()}
    axis = np.arange(known[0], known[-1] + 1)
    want = np.interp(axis, known, [vals[f] for f in known])
    assert sorted(got) == axis.tolist()
    assert [got[f] for f in axis.tolist()] == pytest.approx(want.tolist())


def test_missing_values_never_win(spark):
    from pyspark.sql import functions as F

    from contactflow.functions import geometry as G
    from contactflow.operators import joins, ordering, ranking, suppress

    left = spark.createDataFrame([(1, 10)], "k int, f int")
    right = spark.createDataFrame([(1, 9, None), (1, 11, 0.8)], "k int, g int, p double")
    best = joins.best_in_band(left, right, ["k"], left_on="f", right_on="g", lo=-3, hi=3, order=[-F.col("p"), F.col("g")], keep=["p"])
    assert [r.p for r in best.collect()] == [0.8]
    rows = spark.createDataFrame([(1, 0, 5.0), (1, 5000, None), (1, 9000, 7.0)], "k int, f int, v double")
    prev = ordering.previous_row(rows, ["k"], "f", F.col("v"), "p", size=64)
    assert {r.f: r.p for r in prev.collect()} == {0: None, 5000: 5.0, 9000: None}
    box = spark.sql("SELECT named_struct('x', CAST(NULL AS DOUBLE), 'y', 1.0D) AS p, named_struct('x1', 0.0D, 'y1', 0.0D, 'x2', 2.0D, 'y2', 2.0D) AS b")
    assert box.select(G.outside_distance(F.col("p"), F.col("b"))).first()[0] is None
    scored = spark.createDataFrame([(1, 0, None, 1), (1, 3, 0.9, 2), (None, 4, 0.5, 3)], "k int, f int, s double, id int")
    assert {r.id for r in suppress.greedy_nms(scored.where("k = 1"), ["k"], "f", "s", 10, tie="id").collect()} == {2}
    assert ranking.ranked(scored, ["k"], "s").count() == 3


def test_smoothing_reflects_short_series(spark):
    import numpy as np

    from contactflow.operators.smoothing import gaussian_kernel, gaussian_smooth
    r = random.Random(31)
    series = {n: [r.random() for _ in range(n)] for n in (1, 2, 3, 5, 9, 30)}
    d = spark.createDataFrame([(n, 7 + k, v) for n, vs in series.items() for k, v in enumerate(vs)], "k int, frame int, v double")
    got = {(x.k, x.frame): x.s for x in gaussian_smooth(d, ["k"], "frame", "v", 9, "s").collect()}
    for n, vs in series.items():
        padded = np.pad(vs, 4, mode="reflect") if n > 1 else np.repeat(vs, 9)
        want = np.convolve(padded, gaussian_kernel(9), mode="valid")
        assert [got[n, 7 + k] for k in range(n)] == pytest.approx(want.tolist())
