"""Centroid clustering by Shallot search: exact k-means over integer vectors, with bounds that spare most distances.

A vector remembers its centroid, the second-nearest one, an upper bound of the distance to the first and a lower bound of the distance
to all others. After a round the bounds are moved by what the centroids moved; a vector whose upper bound stays below the
lower one (or half the way to the next centroid) is settled. Every other one measures both remembered centroids, starts from the closer one
and scans its neighbours by distance, within a ball of radius d(start) + d(second best), which shrinks with each closer find.
Survivors are compared in integers (squared distances; ties: smaller number); bounds are rounded outwards, so results are exact.

Scale: vectors are packed once in blocks (BLOCK vectors as int32 bytes) in a table bucketed by block, and never written again.
Each round writes the small states only (20 bytes a vector; k is at most 32,767), bucketed alike, so both join without a shuffle. Rounds sum what vectors moved
between centroids; k * (dims + 1) sums reach the driver. Tables are written, so a lost executor costs the open round at most.

Edge cases: vectors that are null, have another length, a null, NaN or infinite component, or one of LIMIT or more (squared distances
would leave 64 bits) are left out. Null ids are clustered, but do not seed while others are left. Equal ids are rows of their own. Fewer than k vectors: as many
centroids as vectors. An empty table gives an empty result. Extra columns are ignored.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactflow.llm.common import run_dir, written

BLOCK, SCALE, LIMIT = 4096, 1024, 1 << 17
#: Bounds are rounded outwards by this share.
SLACK = 1e-9
#: Bytes of packed vectors in a bucket.
BUCKET = 64 << 20
STATE = "block long, first binary, second binary, upper binary, lower binary, moved binary"


def kept(rows: DataFrame, id: str, vector: str, dims: int, scale: int = SCALE) -> DataFrame:
    """(id, q): usable vectors as integers floor(scale * x)."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LIMIT * 1024 / scale))
    rows = rows.filter((F.size(vector) == dims) & F.coalesce(fine, F.lit(False)))
    return rows.select(F.col(id).alias("id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("q"))


def seeds(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors with the least SHA-256 of salt:id."""
    rank = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    return [r.q for r in vectors.select(rank.alias("h"), "q").orderBy(F.col("h").asc_nulls_last(), "q").limit(k).collect()]


class Centroids:
    """Centroids of one round: distances among them, neighbours in order, and how far each has moved."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None) -> None:
        self.c, self.k = now, len(now)
        apart = np.sqrt((((now[:, None, :] - now[None, :, :]) ** 2).sum(axis=2)).astype(float))
        self.near = np.argsort(apart, axis=1, kind="stable")
        self.apart = apart * (1 - SLACK)
        others = np.where(np.eye(self.k, dtype=bool), np.inf, self.apart)
        self.half = others.min(axis=1) / 2
        self.step = np.zeros(self.k) if before is None else np.sqrt(((now - before) ** 2).sum(axis=1).astype(float)) * (1 + SLACK)
        self.rest = np.array([np.delete(self.step, j).max(initial=0.0) for j in range(self.k)])

    def square(self, x: np.ndarray, to: np.ndarray | int) -> np.ndarray:
        d = x - self.c[to]
        return np.einsum("ij,ij->i", d, d)


def up(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(float)) * (1 + SLACK)


def down(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(float)) * (1 - SLACK)


def nearest(x: np.ndarray, cents: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First assignment: every distance once."""
    d = np.stack([cents.square(x, j) for j in range(cents.k)], axis=1)
    rows = np.arange(len(x))
    first = d.argmin(axis=1)
    best = d[rows, first]
    if cents.k == 1:
        return first, first.copy(), up(best), np.full(len(x), np.inf)
    d[rows, first] = np.iinfo(np.int64).max
    second = d.argmin(axis=1)
    return first, second, up(best), down(d[rows, second])


def search(x: np.ndarray, first: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray, cents: Centroids) -> int:
    """Brings the states up to date with moved centroids, in place; returns how many vectors were scanned."""
    upper += cents.step[first]
    lower -= cents.rest[first]
    if cents.k == 1:
        return 0
    todo = np.flatnonzero(upper >= np.maximum(lower, cents.half[first]))
    own = cents.square(x[todo], first[todo])
    upper[todo] = up(own)
    open_ = upper[todo] >= np.maximum(lower[todo], cents.half[first[todo]])
    todo, own = todo[open_], own[open_]
    y, a, b = x[todo], first[todo], second[todo]
    next_ = cents.square(y, b)
    swap = (next_ < own) | ((next_ == own) & (b < a))
    a, b, own, next_ = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, next_, own), np.where(swap, own, next_)
    start, remembered, radius = a.copy(), b.copy(), up(own)
    for s in np.unique(start):
        live = np.flatnonzero(start == s)
        for j in cents.near[s]:
            if j == s:
                continue
            live = live[cents.apart[s, j] <= radius[live] + up(next_[live])]  # the ball shrinks, so who leaves it stays out
            if not len(live):
                break
            at = live[remembered[live] != j]
            d = cents.square(y[at], j)
            closer = (d < own[at]) | ((d == own[at]) & (j < a[at]))
            at1, at2 = at[closer], at[~closer & (d < next_[at])]
            b[at1], next_[at1] = a[at1], own[at1]
            a[at1], own[at1] = j, d[closer]
            b[at2], next_[at2] = j, d[~closer & (d < next_[at])]
    first[todo], second[todo], upper[todo], lower[todo] = a, b, up(own), down(next_)
    return len(todo)


def moves(x: np.ndarray, old: np.ndarray | None, new: np.ndarray, k: int) -> np.ndarray:
    """(k, dims + 1): sums and counts of the vectors that came, less those that left."""
    at = np.arange(len(x)) if old is None else np.flatnonzero(old != new)
    out = np.zeros((k, x.shape[1] + 1), dtype=np.int64)
    y = np.column_stack([x[at], np.ones(len(at), dtype=np.int64)])
    np.add.at(out, new[at], y)
    if old is not None:
        np.subtract.at(out, old[at], y)
    return out


def _packed(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = part.column("q").flatten().to_numpy().reshape(-1, dims).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.concat_arrays([part.column("id")]))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), ids, pa.array([x.tobytes()], pa.binary())], names=["block", "ids", "x"])
                block += 1
    return run


class Tables:
    """Tables bucketed by block in the shared folder: written once, joined without a shuffle, forgotten at the end."""

    def __init__(self, spark: SparkSession, buckets: int) -> None:
        self.spark, self.buckets, self.names = spark, buckets, []

    def add(self, df: DataFrame, name: str) -> DataFrame:
        path = run_dir(self.spark, name)
        table = f"shallot_{name}_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "block").sortBy("block").option("path", path).saveAsTable(table)
        self.names.append(table)
        return self.spark.table(table)


def _assign(now: np.ndarray, before: np.ndarray | None, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cents = Centroids(now, before)
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["x"], dtype=np.int32).reshape(-1, dims).astype(np.int64)
                if before is None:
                    old, (first, second, upper, lower) = None, nearest(x, cents)
                else:
                    old, second = (np.frombuffer(row[c], dtype=np.int16).astype(np.int64) for c in ("first", "second"))
                    upper, lower = (np.frombuffer(row[c], dtype=float).copy() for c in ("upper", "lower"))
                    first = old.copy()
                    search(x, first, second, upper, lower, cents)
                cells = [first.astype(np.int16), second.astype(np.int16), upper, lower, moves(x, old, first, cents.k)]
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), *[pa.array([c.tobytes()], pa.binary()) for c in cells]],
                                                 names=["block", "first", "second", "upper", "lower", "moved"])
    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for cell in batch.column(0).to_pylist():
            m = np.frombuffer(cell, dtype=np.int64)
            total = m.copy() if total is None else total + m
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total)], names=["place", "total"])


def _measured(cents: np.ndarray, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Centroids(cents)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            for k, (x, first) in enumerate(zip(batch.column("x").to_pylist(), batch.column("first").to_pylist(), strict=True)):
                x = np.frombuffer(x, dtype=np.int32).reshape(-1, dims).astype(np.int64)
                first = np.frombuffer(first, dtype=np.int16).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([ids.slice(k, 1).flatten()]), pa.array(first.astype(np.int32)), pa.array(own.square(x, first))], names=["id", "cluster", "distance"])
    return run


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, salt: str = "3", id: str = "vec_id", vector: str = "embedding", dims: int = 64,
            scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every usable vector, and the centroids."""
    spark = rows.sparkSession
    vectors = kept(rows, id, vector, dims, scale)
    kind = dict(vectors.dtypes)["id"]
    now = np.array(seeds(vectors, k, salt), dtype=np.int64).reshape(-1, dims)
    if not len(now):
        return spark.createDataFrame([], f"{id} {kind}, cluster int, distance long"), now
    packed = written(vectors.mapInArrow(_packed(dims), f"block long, ids array<{kind}>, x binary"), "packed")
    n = packed.agg(F.sum(F.size("ids"))).first()[0]
    tables = Tables(spark, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * dims * 4 // BUCKET)))
    data = tables.add(packed.repartition(tables.buckets, "block"), "vectors")
    before, state, sums = None, None, np.zeros((len(now), dims + 1), dtype=np.int64)
    for r in range(rounds + 1):
        given = data.select("block", "x") if state is None else data.select("block", "x").join(state.drop("moved").hint("merge"), "block")
        state = tables.add(given.mapInArrow(_assign(now, before, dims), STATE), f"state{r}")
        if r < rounds:
            total = state.select("moved").mapInArrow(_summed, "place long, total long").groupBy("place").agg(F.sum("total").alias("total"))
            for place, t in total.collect():  # k * (dims + 1) rows
                sums[place // (dims + 1), place % (dims + 1)] += t
            full = sums[:, -1] > 0
            before, now = now, now.copy()
            now[full] = sums[full, :-1] // sums[full, -1:]
    last = data.join(state.select("block", "first").hint("merge"), "block")
    out = written(last.mapInArrow(_measured(now, dims), f"id {kind}, cluster int, distance long"), "clusters")
    for name in tables.names:
        spark.sql(f"DROP TABLE {name}")
    return out.withColumnRenamed("id", id), now


def report(rows: DataFrame, id: str = "vec_id", **how) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector."""
    out, cents = cluster(rows, id=id, **how)
    sums = out.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows
    whole = sum(r.cluster_inertia for r in sums)
    each = [(r.cluster, r.cluster_inertia, whole, sha256(",".join(map(str, cents[r.cluster].tolist())).encode()).hexdigest()) for r in sums]
    each = out.sparkSession.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(each), "cluster").select(id, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
