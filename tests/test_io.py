"""Readers, sinks and streaming jobs on small generated files."""
import json
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactflow.operators.suppress import pair_global_cooldown
from contactflow.sources import readers as R
from contactflow.sources import writers as K
from contactflow.streaming import jobs as J
from contactflow.streaming import tracker as T


def entry(frame, x, **more):
    return {"frame": frame, "bbox": [0.0, 0.0, 10.0, 20.0], "joints_2d": [[x, x], [0.0, 0.0]], **more}


@pytest.fixture
def docs(tmp_path):
    d = tmp_path / "alpha" / "Round3"
    d.mkdir(parents=True)
    (d / "pose.json").write_text(json.dumps({
        "0": [entry(1, 10.0), entry(2, 11.0)],
        "1": [entry(1, 20.0, frame_dims={"original_width": 100, "original_height": 100, "resized_width": 50, "resized_height": 25})],
        "contact_events": [{"frame": 1, "striker_id": 0, "receiver_id": 1, "contact_prob": 0.9, "contact_region": "head"}]}))
    return str(tmp_path / "alpha")


def test_pose_document(spark, docs):
    d = R.read_documents(spark, docs)
    rows = {(r.track_id, r.frame): r for r in R.document_tracks(d).collect()}
    assert set(rows) == {(0, 1), (0, 2), (1, 1)}
    r = rows[(0, 1)]
    assert (r.match_id, r.round_id) == ("alpha", 3)
    assert (r.joints_2d[0].x, r.joints_2d[0].y) == (30.0, 30.0) and r.joints_2d[1] is None
    assert (rows[(1, 1)].joints_2d[0].x, rows[(1, 1)].joints_2d[0].y) == (40.0, 80.0)
    c = R.document_contacts(d).first()
    assert (c.frame, c.contact_prob, c.contact_region) == (1, 0.9, "head")
    assert R.discover(spark, docs, "*.json").first().round_id == 3


def test_pose_lines(spark, tmp_path):
    d = tmp_path / "m" / "Round1"
    d.mkdir(parents=True)
    (d / "p.json").write_text("\n".join(json.dumps(entry(i, 1.0, track_id=i % 2)) for i in range(4)))
    rows = R.read_pose_lines(spark, str(tmp_path)).collect()
    assert sorted((r.track_id, r.frame) for r in rows) == [(0, 0), (0, 2), (1, 1), (1, 3)]


def test_actions_defaults(spark, tmp_path):
    d = tmp_path / "m" / "Round2"
    d.mkdir(parents=True)
    (d / "actions.json").write_text(json.dumps({"actions": [
        {"fighter_id": 1, "action": "jab_left", "window_start": 3, "window_end": 9, "confidence": 1.0},
        {"fighter_type": "fighter_0", "action": "cross", "frame": 5, "window_start": 4, "window_end": 6, "confidence": 0.5,
         "speed_estimation": {"estimated_speed_kmh": 7.2}}]}))
    a, b = sorted(R.read_actions(spark, str(tmp_path)).collect(), key=lambda r: r.window_start)
    assert (a.fighter_id, a.target, a.speed_kmh, a.frame, a.round_id) == (1, "Head", 0.0, 3, 2)
    assert (b.fighter_id, b.speed_kmh, b.frame) == (0, 7.2, 5)


def test_wav_blocks(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"".join(struct.pack("<hh", i * 100, i * 300) for i in range(10)))
    rows = sorted(R.read_wav_blocks(spark, str(tmp_path), block=4).collect(), key=lambda r: r.block_no)
    assert [len(r.samples) for r in rows] == [4, 4, 2] and rows[0].sr == 8000
    assert np.concatenate([r.samples for r in rows]) == pytest.approx(np.arange(10) * 200 / 32768.0)


def test_unregistered_match_raises(spark):
    d = spark.createDataFrame([("a",), ("b",)], "match_id string")
    reg = spark.createDataFrame([("a", "box")], "match_id string, tracking_format string")
    with pytest.raises(Exception, match="unregistered match"):
        R.registry_lookup(d, reg).collect()


def test_sinks_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, 0, 5, 0.5), (2, 1, 6, 0.7)], "match_id int, round_id int, frame int, score double")
    K.write_table(d, str(tmp_path / "t"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).select(*d.columns).collect())) == sorted(map(tuple, d.collect()))
    first = d.first()
    own = (d.match_id == first.match_id) & (d.round_id == first.round_id)
    K.write_table(d.where(own), str(tmp_path / "t"))  # other recordings stay
    assert spark.read.parquet(str(tmp_path / "t")).count() == d.count()
    m = spark.createDataFrame([("c1", "impact", 4), ("c2", None, None)], "clip string, label string, impact_frame int")
    K.write_manifest(m, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m/counters")).first().labeled == 1
    K.publish_version(m, str(tmp_path / "v"))
    K.publish_version(m.where("label is not null"), str(tmp_path / "v"))
    assert K.read_current(spark, str(tmp_path / "v")).count() == 1
    K.write_parts_csv(spark.createDataFrame([("a", 1, "f0", "part01", "x")], "fight string, round int, fighter string, part string, path string"), str(tmp_path / "c"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).first().part == "part01"


def test_streaming_cooldown_over_batches_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(1, 0, int(f), str(rng.integers(2)), i) for i, f in enumerate(sorted(rng.choice(900, 120, replace=False)))]
    d = spark.createDataFrame(rows, "match_id long, round_id int, frame int, pair string, det_id long").withColumn("ts", F.timestamp_seconds("frame"))
    src = str(tmp_path / "src")
    for lo in range(0, 900, 300):  # three files, one per micro-batch
        d.where(F.col("frame").between(lo, lo + 299)).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = {r.det_id for r in J.drain(J.cooldown_events(s, 30, 10), "t").collect()}
    want = pair_global_cooldown(d, ["match_id", "round_id"], "frame", F.col("pair"), pair_cooldown=30, global_cooldown=10, tie=["det_id"])
    assert got == {r.det_id for r in want.collect()}


def test_updated_counts_over_batches_equal_batch(spark, tmp_path):
    d = spark.range(900).select((F.col("id") % 2).alias("match_id"), F.lit(0).alias("round_id"), F.lit("c").alias("event_type"),
                                (F.col("id") % 7).cast("double").alias("value"), F.timestamp_seconds("id").alias("ts"))
    src = str(tmp_path / "src")
    for lo in range(0, 900, 250):  # windows of 100 seconds go on over batches
        d.where(F.unix_seconds("ts").between(lo, lo + 249)).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = J.drain(J.tumbling_counts(s, "100 seconds"), "t", "update", ["match_id", "start_sec"])
    want = d.groupBy("match_id", (F.floor(F.unix_seconds("ts") / 100) * 100).alias("start_sec")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("max_value"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    total = J.drain(J.running_counters(s), "t", "update", ["match_id", "round_id", "event_type"])
    assert sorted((r.match_id, r.n) for r in total.collect()) == [(0, 450), (1, 450)]


def test_tracker_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows, i = [], 0
    for f in list(range(0, 30)) + list(range(70, 100)):
        for k in range(2):
            x = 100.0 * k + f * 0.5 + float(rng.normal())
            rows.append((1, 0, f, i, x, 0.0, x + 50, 100.0))
            i += 1
    d = spark.createDataFrame(rows, "match_id long, round_id int, frame int, det_id long, x1 double, y1 double, x2 double, y2 double")
    batch = {r.det_id: r.track_id for r in T.track_batch(d, ["match_id", "round_id"]).collect()}
    assert set(batch.values()) == {0, 1, 2, 3}  # a pause of 40 frames ends both tracks
    src = str(tmp_path / "src")
    d.coalesce(1).write.parquet(src)
    s = spark.readStream.schema(d.schema).parquet(src)
    assert {r.det_id: r.track_id for r in J.drain(T.track_stream(s), "t").collect()} == batch


def test_sticky_pair():
    people = [(1, 50.0, 0, 0), (2, 40.0, 10, 0), (3, 90.0, 500, 0), (4, 10.0, 501, 0), (5, 60.0, 300, 300)]
    assert set(T.sticky_pair(people, set())) == {1, 2}
    assert set(T.sticky_pair(people, {1, 4})) == {1, 4}
    assert set(T.sticky_pair(people, {2, 9})) == {2, 3}
    # far apart but large beats close but small
    assert set(T.sticky_pair([(1, 900.0, 0, 0), (2, 900.0, 60, 0), (3, 30.0, 500, 0), (4, 30.0, 510, 0)], set())) == {1, 2}
    # people at the frame's edge count only where fewer than two others are there
    assert set(T.sticky_pair([(1, 9.0, 500, 0), (2, 8.0, 700, 0), (3, 99.0, 20, 0)], set(), 1000)) == {1, 2}
    assert set(T.sticky_pair([(1, 9.0, 500, 0), (3, 99.0, 20, 0)], set(), 1000)) == {1, 3}


def test_tensor_table_survives_a_failed_write(spark, tmp_path):
    from contactflow.sources.writers import read_tensors, write_tensors
    schema = "x array<array<double>>, mask array<double>, y int, group int, name string"
    good = [([[1.0, 2.0], [3.0, 4.0], [3.0, 4.0]], [1.0, 1.0, 0.0], k % 2, k % 3, f"clip{k}") for k in range(9)]
    root = str(tmp_path / "tensors")
    first = write_tensors(spark.createDataFrame(good, schema), ["a", "b"], root, parts=4)
    for bad in (spark.createDataFrame([([[1.0]], [1.0], 0, 0, "odd"), *good], schema),  # shapes differ: found in the written parts
                spark.createDataFrame(good, schema).withColumn("y", F.when(F.col("name") == "clip7", F.raise_error(F.lit("lost"))).otherwise(F.col("y")).cast("int"))):
        with pytest.raises(Exception):
            write_tensors(bad, ["a", "b"], root)
        t, names = read_tensors(spark, root)
        assert names == ["a", "b"] and sorted(map(tuple, t.collect()), key=lambda r: r[4]) == [(x, m, y, g, n) for x, m, y, g, n in good]
    second = write_tensors(spark.createDataFrame(good[:2], schema), ["a", "b"], root)
    assert second > first and read_tensors(spark, root)[0].count() == 2


def _batches(spark, path, parts, schema):
    """A stream that reads one file a trigger, in order."""
    import os
    import time as clock
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
        new = [f for f in os.listdir(path) if f.endswith(".parquet") and not f.startswith("b")]
        os.rename(path / new[0], path / f"b{k}.parquet")
        os.utime(path / f"b{k}.parquet", (clock.time() - 1000 + k, clock.time() - 1000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_stream_over_triggers_equals_batch_and_ended_state_goes(spark, tmp_path):
    import datetime as dt
    schema = "match_id long, round_id int, frame int, pair string, det_id long, ts timestamp"
    at = lambda f: dt.datetime(2024, 1, 1) + dt.timedelta(hours=f)
    rows = [(1, 0, f, str(f % 2), f, at(f)) for f in range(0, 90, 3)]
    cut = _batches(spark, tmp_path / "a", [rows[:11], rows[11:20], rows[20:]], schema)
    got = {r.det_id for r in J.drain(J.cooldown_events(cut, 12, 5), "t").collect()}
    d = spark.createDataFrame(rows, schema)
    assert got == {r.det_id for r in pair_global_cooldown(d, ["match_id", "round_id"], "frame", F.col("pair"), pair_cooldown=12, global_cooldown=5, tie=["det_id"]).collect()}
    # a recording that starts again after its state has gone is not blocked by it; one that still counts is
    again = [[(1, 0, 100, "0", 1, at(100)), (2, 0, 100, "0", 2, at(100))], [(3, 0, 0, "0", 3, at(2000))], [(1, 0, 101, "0", 4, at(2001)), (3, 0, 1, "0", 5, at(2001))]]
    got = {r.det_id for r in J.drain(J.cooldown_events(_batches(spark, tmp_path / "b", again, schema), 12, 5), "t").collect()}
    assert got == {1, 2, 3, 4}


def test_late_rows_have_no_step(spark, tmp_path):
    import datetime as dt
    schema = "match_id long, round_id int, track_id int, frame int, event_id long, value double, ts timestamp"
    row = lambda f, i, v: (1, 0, 0, f, i, v, dt.datetime(2024, 1, 1) + dt.timedelta(hours=f))
    s = _batches(spark, tmp_path / "s", [[row(3, 1, 10.0), row(5, 2, 12.0)], [row(4, 3, 99.0), row(6, 4, 15.0)], [row(7, 5, 11.0)]], schema)
    got = {r.event_id: None if r.step is None or np.isnan(r.step) else r.step for r in J.drain(J.value_steps(s, delay="100 hours"), "t").collect()}
    assert got == {1: None, 2: 2.0, 3: None, 4: 3.0, 5: -4.0}
