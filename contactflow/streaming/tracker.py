"""Multi-object tracking by greedy overlap, and sticky selection of two fighters.

The step functions hold the per-frame rule once; the batch form runs them over
runs of frames, the streaming form over micro-batches with the tracks as state.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from contactflow.operators.ordering import islands, running_sum
from contactflow.streaming.jobs import _RECORDING, SHARDS, held, hold, recordings, runs_of, sharded

IOU_MIN, MAX_MISSED, EDGE = 0.25, 20, 0.05  # fixed values
FEW = 64  # overlaps computed one by one; more as a matrix


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lo = np.maximum(a[:, None, :2], b[None, :, :2])
    hi = np.minimum(a[:, None, 2:], b[None, :, 2:])
    wh = np.clip(hi - lo, 0, None)
    inter = wh[..., 0] * wh[..., 1]
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    return np.where(inter > 0, inter / (area(a)[:, None] + area(b)[None, :] - inter + 1e-6), 0.0)


def _overlaps(a: list[list[float]], b: list[list[float]]) -> list[tuple[float, int, int]]:
    """(overlap, place in a, place in b) of at least IOU_MIN, best first, earlier places first on ties."""
    if len(a) * len(b) > FEW:
        m = iou_matrix(np.asarray(a, float), np.asarray(b, float))
        r, c = np.nonzero(m >= IOU_MIN)
        order = np.argsort(-m[r, c], kind="stable")
        return list(zip(m[r, c][order].tolist(), r[order].tolist(), c[order].tolist()))
    out = []
    for t, (p1, q1, p2, q2) in enumerate(a):
        area = (p2 - p1) * (q2 - q1)
        for d, (x1, y1, x2, y2) in enumerate(b):
            w = (p2 if p2 < x2 else x2) - (p1 if p1 > x1 else x1)
            h = (q2 if q2 < y2 else y2) - (q1 if q1 > y1 else y1)
            if w > 0 and h > 0:
                v = w * h / (area + (x2 - x1) * (y2 - y1) - w * h + 1e-6)  # not a number where a coordinate is none
                if v >= IOU_MIN:
                    out.append((v, t, d))
    out.sort(key=lambda x: -x[0])
    return out


class Tracks:
    """Live tracks: ids, boxes and frames since last seen."""

    def __init__(self, ids=(), boxes=(), missed=(), next_id: int = 0, frame: int | None = None):
        self.ids, self.boxes, self.missed = list(ids), [list(b) for b in boxes], list(missed)
        self.next_id, self.frame = next_id, frame

    def idle(self, frames: int) -> None:
        """Frames without detections age every track."""
        keep = [i for i, m in enumerate(self.missed) if m + frames < MAX_MISSED]
        self.ids, self.boxes = [self.ids[i] for i in keep], [self.boxes[i] for i in keep]
        self.missed = [self.missed[i] + frames for i in keep]

    def update(self, frame: int, boxes: list[list[float]]) -> list[int]:
        if self.frame is not None and frame - self.frame > 1:
            self.idle(frame - self.frame - 1)
        self.frame = frame
        out = [-1] * len(boxes)
        hit = set()
        if self.ids and boxes:
            for _, t, d in _overlaps(self.boxes, boxes):
                if out[d] < 0 and self.ids[t] not in hit:
                    self.boxes[t], self.missed[t], out[d] = boxes[d], 0, self.ids[t]
                    hit.add(self.ids[t])
        for c, got in enumerate(out):
            if got < 0:
                out[c] = self.next_id
                self.ids.append(self.next_id)
                self.boxes.append(boxes[c])
                self.missed.append(0)
                hit.add(self.next_id)
                self.next_id += 1
        keep = []
        for i, t in enumerate(self.ids):
            if t not in hit:
                self.missed[i] += 1
            if t in hit or self.missed[i] < MAX_MISSED:
                keep.append(i)
        self.ids, self.boxes, self.missed = ([x[i] for i in keep] for x in (self.ids, self.boxes, self.missed))
        return out


def _ids(tracks: Tracks, frames: list[int], boxes: list[list[float]]) -> list[int]:
    """Track id of every row; rows are ordered by frame."""
    ids: list[int] = []
    a, n = 0, len(frames)
    while a < n:
        b, f = a + 1, frames[a]
        while b < n and frames[b] == f:
            b += 1
        ids += tracks.update(int(f), boxes[a:b])
        a = b
    return ids


def track_batch(dets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Track ids for (keys, frame, det_id, x1..y2).

    A pause of MAX_MISSED empty frames ends every track, so runs between pauses are
    independent; ids continue over a recording through a running count.
    """
    keys = list(keys)
    axis = islands(dets.select(*keys, "frame").distinct(), keys, "frame", MAX_MISSED + 1)
    d = dets.join(axis, [*keys, "frame"])
    runs = d.groupBy(*keys, "island").agg(F.sort_array(F.collect_list(F.struct("frame", "det_id", "x1", "y1", "x2", "y2"))).alias("_a"))

    @F.pandas_udf("array<int>")
    def assign(frame: pd.Series, x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
        return pd.Series([_ids(Tracks(), np.asarray(f).tolist(), np.stack([np.asarray(c, float) for c in box], axis=1).tolist())
                          for f, *box in zip(frame, x1, y1, x2, y2)])

    runs = runs.withColumn("_t", assign(*[F.col(f"_a.{c}") for c in ("frame", "x1", "y1", "x2", "y2")]))
    runs = (runs.select(*keys, "island", F.explode(F.zip_with("_a", "_t", lambda a, t: F.struct(a.alias("a"), t.alias("track")))).alias("z"))
            .select(*keys, "island", "z.a.*", "z.track"))
    born = runs.groupBy(*keys, "island").agg((F.max("track") + 1).alias("n"))
    born = running_sum(born, keys, "island", "n", "offset", inclusive=False)
    out = runs.join(born.select(*keys, "island", "offset"), [*keys, "island"])
    return out.select(*keys, "frame", "det_id", "x1", "y1", "x2", "y2", (F.col("track") + F.col("offset")).cast("int").alias("track_id"))


TRACK_STATE = ("m array<long>, r array<int>, z array<int>, ids array<array<int>>, boxes array<array<double>>, missed array<array<int>>, "
               "next_id array<int>, frame array<int>")


def track_stream(stream: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Streaming form per recording: (match_id, round_id, frame, det_id, track_id)."""
    keys = ["_m", "_r", "_z"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = held(state, 3)
        rows = pd.concat(list(batches)).sort_values([*keys, "frame", "det_id"], kind="stable")
        frames, boxes = rows["frame"].tolist(), rows[["x1", "y1", "x2", "y2"]].to_numpy(dtype=float).tolist()
        ids: list[int] = []
        for k, a, b in runs_of(rows, keys):
            t = Tracks()
            if k in known:
                own, flat, missed, nxt, frame = known[k]
                t = Tracks(own, [flat[i:i + 4] for i in range(0, len(flat), 4)], missed, nxt, frame)
            ids += _ids(t, frames[a:b], boxes[a:b])
            known[k] = (t.ids, [v for box in t.boxes for v in box], t.missed, t.next_id, t.frame)
        hold(state, known, 8)
        yield rows[[*keys, "frame", "det_id"]].assign(track_id=np.array(ids, dtype="int32"))

    return recordings(sharded(stream, shards).groupBy("_shard").applyInPandasWithState(
        step, f"{_RECORDING}, frame int, det_id long, track_id int", TRACK_STATE, "append", GroupStateTimeout.NoTimeout))


def sticky_pair(people: list[tuple[int, float, float, float]], chosen: set[int], width: float | None = None) -> list[int]:
    """The two fighters of a frame from (track, area, cx, cy), keeping earlier ones while visible.

    Given the frame's width, people centred in its outer 5 % on either side count only
    where fewer than two others are there. Both known: keep. One known: add the largest
    other. Else, of the four largest, the pair with the least distance for its summed
    area. Fewer than two people: whoever is there.
    """
    if width is not None:
        central = [p for p in people if EDGE * width <= p[2] <= (1 - EDGE) * width]
        people = central if len(central) >= 2 else people
    known = [p for p in people if p[0] in chosen]
    if len(known) == 2:
        return [p[0] for p in known]
    if len(known) == 1:
        others = [p for p in people if p[0] not in chosen]
        if others:
            return [known[0][0], max(others, key=lambda p: p[1])[0]]
    top = sorted(people, key=lambda p: -p[1])[:4]
    if len(top) <= 2:
        return [p[0] for p in top]
    apart = lambda a, b: np.hypot(a[2] - b[2], a[3] - b[3]) / (a[1] + b[1] + 1e-6)
    pairs = [(apart(top[i], top[j]), i, j) for i in range(len(top)) for j in range(i + 1, len(top))]
    _, i, j = min(pairs)
    return [top[i][0], top[j][0]]


def select_fighters_stream(stream: DataFrame, width: float | None = None, shards: int = SHARDS) -> DataFrame:
    """Sticky selection with the two chosen ids as state: (match_id, round_id, frame, track_id)."""
    keys = ["_m", "_r", "_z"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = held(state, 3)
        rows = pd.concat(list(batches)).sort_values([*keys, "frame", "track_id"], kind="stable")
        people = list(zip(*[c.tolist() for c in (rows["track_id"], (rows["x2"] - rows["x1"]) * (rows["y2"] - rows["y1"]), (rows["x1"] + rows["x2"]) / 2, (rows["y1"] + rows["y2"]) / 2)]))
        out: list[tuple] = []
        chosen: set[int] = set()
        last = None
        for (*k, f), a, b in runs_of(rows, [*keys, "frame"]):
            if k != last:
                chosen, last = set(known.get(tuple(k), ((),))[0]), k
            pick = sticky_pair(people[a:b], chosen, width)
            if len(pick) == 2:
                chosen = set(pick)
            known[tuple(k)] = (list(chosen),)
            out += [(*k, f, t) for t in pick]
        hold(state, known, 4)
        yield pd.DataFrame(out, columns=[*keys, "frame", "track_id"])

    return recordings(sharded(stream, shards).groupBy("_shard").applyInPandasWithState(
        step, f"{_RECORDING}, frame int, track_id int", "m array<long>, r array<int>, z array<int>, chosen array<array<int>>", "append", GroupStateTimeout.NoTimeout))
