"""Queries whose state, joins or numbers once did not fit large inputs, on small rows of the same shape."""
import random

import numpy as np
import pytest

from __spark_entry__ import oracle_sql, queries

PLAN = queries()


def nodes(df) -> str:
    """The plan that ran, with every change that was made on the way."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_are_merged_not_broadcast(spark):
    """F1: a row for each key and score is as much as the data, however small its shuffle is."""
    from contactflow.operators.audio import median_clamp_normalise
    from contactflow.operators.ranking import exact_quantiles, ranked
    d = spark.createDataFrame([(k, f, float(f % 7)) for k in range(3) for f in range(40)], "k int, frame int, v double")
    for out in (ranked(d, ["k"], "v"), ranked(d, ["k"], "v", tie=["frame"]), exact_quantiles(d, ["k"], "v", {"m": 0.5}), median_clamp_normalise(d, ["k"], "v", "o")):
        assert "Broadcast" not in nodes(out)
    assert {(r.n, r.m, r.top) for r in exact_quantiles(d, ["k"], "v", {"m": 0.5}, highest="top").collect()} == {(40, 3.0, 6.0)}


def bodies(spark, folder, matches, rows=120, seed=5):
    """Embeddings of a few matches: (vec_id, embedding, label)."""
    r, out = random.Random(seed), []
    for m in matches:
        for i in range(rows):
            out.append((m * 1000 + i, [r.uniform(-0.3, 0.3) for _ in range(64)], r.randrange(6)))
    spark.createDataFrame(out, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_ablation_of_high_match_numbers(spark, tmp_path):
    """the number that orders actions in time did not fit 32 bits from match 22 on."""
    low, high = (bodies(spark, tmp_path / str(m), [0, 1, m]) for m in (2, 5000))
    want, got = ({(r.t, r.fold): tuple(r) for r in PLAN["window_length_ablation"](spark, d).collect()} for d in (low, high))
    assert len(got) == 4 * 6 and got == want


def test_reach_precheck_keeps_unsure_pairs(spark, tmp_path):
    """a pair in reach is a row, whatever its wrists' confidence; the verdict on that is a column."""
    flat = [[0.1, 0.1, z] * 21 + [0.0] for z in (0.01, 0.2)]
    spark.createDataFrame([(0, flat[0], 0), (1, flat[1], 0), (2, flat[1], 0), (3, [9.0, 9.0, 0.2] * 21 + [0.0], 0)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.frame, r.striker_id): r.confident for r in PLAN["reach_precheck"](spark, str(tmp_path)).collect()}
    assert got == {(0, 0): False, (0, 1): True}
    import duckdb
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    rel = con.sql(oracle_sql()["reach_precheck"])
    at = [rel.columns.index(c) for c in ("frame", "striker_id", "confident")]
    assert {tuple(r[i] for i in at[:2]): r[at[2]] for r in rel.fetchall()} == got


def test_streams_hold_recordings_by_shard(spark, tmp_path):
    """A call and a state row for every recording cost milliseconds each; now a shard's recordings share them."""
    import datetime as dt

    from pyspark.sql import functions as F

    from contactflow.operators.suppress import pair_global_cooldown
    from contactflow.streaming import jobs as J
    from contactflow.streaming import tracker as T
    r, keys = random.Random(7), ["match_id", "round_id"]
    rows = []
    for i in range(900):
        f = r.randrange(60)
        rows.append((r.randrange(100), r.randrange(3), r.randrange(2), f, i, str(i % 2), r.random(), *[float(r.randrange(40)) for _ in range(2)], 60.0, 70.0, dt.datetime(2024, 1, 1) + dt.timedelta(hours=f)))
    rows.append((None, 0, 0, 3, 1000, "0", 0.5, 0.0, 0.0, 60.0, 70.0, dt.datetime(2024, 1, 1, 3)))  # a recording without a match
    d = spark.createDataFrame(rows, "match_id long, round_id int, track_id int, frame int, det_id long, pair string, value double, x1 double, y1 double, x2 double, y2 double, ts timestamp")
    for k, part in enumerate((d.where("frame < 30"), d.where("frame >= 30"))):
        part.withColumn("event_id", F.col("det_id")).coalesce(1).write.parquet(f"{tmp_path}/src/part={k}")
    s = lambda: spark.readStream.schema(d.withColumn("event_id", F.col("det_id")).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/src/*")
    got = {x.det_id for x in J.drain(J.cooldown_events(s(), 12, 5, delay="100 hours", shards=4), "t").collect()}
    want = pair_global_cooldown(d.na.fill(-1, ["match_id"]), keys, "frame", F.col("pair"), pair_cooldown=12, global_cooldown=5, tie=["det_id"])
    assert got == {x.det_id for x in want.collect()}
    got = {x.det_id: x.track_id for x in J.drain(T.track_stream(s(), shards=4), "t").where("match_id is not null").collect()}
    assert got == {x.det_id: x.track_id for x in T.track_batch(d, keys).collect()}
    got = {x.event_id: x.step for x in J.drain(J.value_steps(s(), delay="100 hours", shards=4), "t").collect()}
    last: dict = {}
    for m, n, t, f, i, _, v, *_ in sorted(rows, key=lambda x: (x[3], x[4])):
        assert (got[i] is None or got[i] != got[i]) if (m, n, t) not in last else got[i] == v - last[m, n, t]
        last[m, n, t] = v
    picked = J.drain(T.select_fighters_stream(s(), shards=4), "t").collect()
    one = J.drain(T.select_fighters_stream(s(), shards=1), "t").collect()
    assert sorted(picked, key=str) == sorted(one, key=str) and any(x.match_id is None for x in picked)
    q = T.track_stream(s()).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    few = T.track_stream(s(), shards=4).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ckpt4")).trigger(availableNow=True).start()
    few.awaitTermination()
    assert [p["stateOperators"][0]["numRowsTotal"] for p in few.recentProgress if p["numInputRows"]][-1] == 4


@pytest.mark.parametrize("guess", [20, 20_000])
def test_cuts_are_exact_in_few_counts(spark, guess, monkeypatch):
    """exact cuts from any guess, with ties, by counts of one size for each task."""
    from contactflow.operators import search as SE
    r = np.random.default_rng(3)
    x = np.concatenate([r.random((700, 2)), np.full((300, 2), 0.5), -r.random((100, 2))])
    d = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double").repartition(3)
    w = r.random((5, 2))
    got = SE.score_cuts(d, ["a", "b"], SE.linear_scorer(w), 5, [0.1, 0.5, 0.9], guess=guess, few=3)
    for t in range(5):
        s = np.sort(w[t, 0] * x[:, 0] + w[t, 1] * x[:, 1])
        s = s[s > 0]
        assert got[t].tolist() == [s[int(len(s) * (1 - p))] for p in (0.1, 0.5, 0.9)]


def test_smoothing_shuffles_rows_that_are_there(spark):
    """dense frames are made where they are needed; nothing joins them to their series' ends, no window gathers lists."""
    from contactflow.operators.smoothing import gaussian_kernel, gaussian_smooth, interpolate
    r = random.Random(9)
    known = {(k, f): r.random() if r.random() < 0.8 else None for k in range(4) for f in r.sample(range(1000 * k, 1000 * k + 300), 40)}
    d = spark.createDataFrame([(k, f, v) for (k, f), v in known.items()] + [(None, 3, 1.0), (None, 5, 1.0)], "k int, frame int, v double")
    got = {(x.k, x.frame): x.v for x in interpolate(d, ["k"], "frame", "v", size=16).collect()}
    smooth = gaussian_smooth(interpolate(d, ["k"], "frame", "v"), ["k"], "frame", "v", 9, "s")
    plan = nodes(smooth)
    assert "collect_list" not in plan
    smoothed = {(x.k, x.frame): x.s for x in smooth.collect()}
    assert [got[None, f] for f in (3, 4, 5)] == [None, None, None]
    for k in range(4):
        fs = sorted(f for kk, f in known if kk == k)
        axis = np.arange(fs[0], fs[-1] + 1)
        there = [f for f in fs if known[k, f] is not None]
        want = np.interp(axis, there, [known[k, f] for f in there])
        assert [got[k, f] for f in axis.tolist()] == pytest.approx(want.tolist())
        line = np.convolve(np.pad(want, 4, mode="reflect"), gaussian_kernel(9), mode="valid")
        assert [smoothed[k, f] for f in axis.tolist()] == pytest.approx(line.tolist())
    assert len(smoothed) == len(got) - 3


@pytest.mark.parametrize("size", [1, 4096])
def test_configurations_share_the_truths(spark, monkeypatch, size):
    """truths were copied for every configuration before they were grouped, in the task that read the most of them."""
    from contactflow.operators import matching as M
    from contactflow.operators import search as SE
    r = random.Random(11)
    truth = sorted({(k, r.randrange(2500)) for k in (1, 2) for _ in range(300)}) + [(None, 7), (None, 9)]
    dets = [(r.choice([1, 2, 3]), r.randrange(2500), cd, thr) for _ in range(500) for cd in (3, 5) for thr in (0.1, 0.2)] + [(None, 8, 3, 0.1)]
    g = spark.createDataFrame(truth, "k int, frame int").repartition(3)
    d = spark.createDataFrame(dets + dets[:50], "k int, frame int, cd int, thr double").repartition(3)  # frames come up more than once
    want, sums = {}, {}
    for cd, thr in {x[2:] for x in dets}:
        for k in {x[0] for x in dets}:
            mine, goals = {f for kk, f, *c in dets if kk == k and c == [cd, thr]}, [f for kk, f in truth if kk == k]
            own, taken = dict.fromkeys(mine), set()
            for _, f, x in sorted((abs(f - x), f, x) for f in mine for x in goals if abs(f - x) <= 12):
                if own[f] is None and x not in taken:
                    own[f] = x
                    taken.add(x)
            want |= {(k, cd, thr, f): x for f, x in own.items()}
            tp, n = sums.get((cd, thr), (0, 0))
            sums[cd, thr] = tp + len(taken), n + len(mine)
    got = M.match(d, g, ["k"], 12, "closest_pair", size=size, config=["cd", "thr"])
    assert got.columns == ["k", "cd", "thr", "frame", "gt_frame"]
    rows = got.collect()
    assert len(rows) == len(want) and {tuple(x)[:4]: x.gt_frame for x in rows} == want
    seen = []
    monkeypatch.setattr(M, "match", lambda a, b, *more, f=M.match, **named: (seen.append(b.count()), f(a, b, *more, **named))[1])
    table = SE.score_configs(d, g, ["k"], ["cd", "thr"], "frame", 12, {"cd": [3, 5, 8], "thr": [0.1, 0.2]})
    assert {(x.cd, x.thr): (x.tp, x.fp, x.fn) for x in table.collect()} == {c: (tp, n - tp, len(truth) - tp) for c, (tp, n) in sums.items()}
    assert seen == [len(truth)]
    assert SE.score_configs(d, g.limit(0), ["k"], ["cd", "thr"], "frame", 12, {"cd": [3, 5], "thr": [0.1, 0.2]}).isEmpty()
