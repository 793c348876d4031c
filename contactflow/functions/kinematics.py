"""Kinematic gates over trajectory arrays.

A trajectory is array<struct<frame, x, y[, z], ...>> ordered by frame: either a
range-framed window around a frame or all frames of one action window. Every
gate maps such an array to a Column, so the same expression serves both.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactflow.functions.geometry import mean_of


def cap1(c: Column) -> Column:
    """At most 1; NULL stays NULL (least alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.lit(1.0), c))


def clip01(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with value evaluated once: bound to a lambda variable, not repeated."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def pairwise(arr: Column, fn: Callable[[Column, Column], Column]) -> Column:
    """fn(previous, current) over neighbours; empty when fewer than two."""
    return let(arr, lambda a: F.zip_with(
        F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))),
        F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), lambda cur, prev: fn(prev, cur)))


def step(prev: Column, cur: Column) -> Column:
    return F.greatest(cur["frame"] - prev["frame"], F.lit(1)).cast("double")


def velocity(arr: Column, dims: str = "xyz") -> Column:
    """array<struct<frame, dt, v..., speed>> between available neighbours."""
    def one(p: Column, c: Column) -> Column:
        dt = step(p, c)
        v = [((c[d] - p[d]) / dt) for d in dims]
        s = v[0] * v[0]
        for k in v[1:]:
            s = s + k * k
        return F.struct(c["frame"].alias("frame"), dt.alias("dt"),
                        *[k.alias(d) for d, k in zip(dims, v)], F.sqrt(s).alias("speed"))
    return pairwise(arr, one)


def _derive(arr: Column, dims: str) -> Column:
    return pairwise(arr, lambda p, c: F.struct(
        c["frame"].alias("frame"), c["dt"].alias("dt"),
        *[((c[d] - p[d]) / c["dt"]).alias(d) for d in dims]))


def _speeds(vel: Column) -> Column:
    return F.transform(vel, lambda v: v["speed"])


def peak_speed(arr: Column, dims: str = "xy", min_points: int = 3) -> Column:
    return F.when(F.size(arr) >= min_points, F.array_max(_speeds(velocity(arr, dims)))).otherwise(0.0)


def decel_score(arr: Column, dims: str = "xyz", min_points: int = 3, per_frame: bool = True) -> Column:
    """Sharpest speed drop relative to peak speed, scaled by 0.6."""
    def score(vel: Column) -> Column:
        peak = F.array_max(_speeds(vel))
        drop = F.array_min(pairwise(vel, lambda p, c: (
            (c["speed"] - p["speed"]) / c["dt"] if per_frame else c["speed"] - p["speed"])))
        return F.when((F.size(vel) >= 2) & (peak >= 1e-6),
                      F.least(F.lit(1.0), F.greatest(F.lit(0.0), -drop) / peak / 0.6)).otherwise(0.0)
    return F.when(F.size(arr) >= min_points, let(velocity(arr, dims), score)).otherwise(0.0)


def jerk_peak(arr: Column, dims: str = "xyz") -> Column:
    """struct(jerk, frame) of the largest third-derivative norm, earliest on ties."""
    jerk = _derive(_derive(velocity(arr, dims), dims), dims)

    def mag(j: Column) -> Column:
        s = j[dims[0]] * j[dims[0]]
        for d in dims[1:]:
            s = s + j[d] * j[d]
        return F.sqrt(s)

    best = F.array_max(F.transform(jerk, lambda j: F.struct(mag(j).alias("jerk"), (-j["frame"]).alias("nf"))))
    return let(best, lambda b: F.when(b.isNotNull(), F.struct(b["jerk"].alias("jerk"), (-b["nf"]).alias("frame"))))


def jerk_score(arr: Column, dims: str = "xyz", scale: float = 0.03, min_points: int = 4) -> Column:
    return F.when(F.size(arr) >= min_points,
                  F.coalesce(cap1(jerk_peak(arr, dims)["jerk"] / scale), F.lit(0.0))).otherwise(0.0)


def scalar_jerk_score(arr: Column, dims: str = "xyz", scale: float = 1.5) -> Column:
    """Largest change of scalar acceleration."""
    acc = pairwise(velocity(arr, dims), lambda p, c: (c["speed"] - p["speed"]) / c["dt"])
    jerk = F.array_max(pairwise(acc, lambda p, c: F.abs(c - p)))
    return F.when(F.size(arr) >= 4, F.coalesce(cap1(jerk / scale), F.lit(0.0))).otherwise(0.0)


def speed_change_score(arr: Column, dims: str = "xy", scale: float = 15.0) -> Column:
    """Largest change of speed between neighbouring steps, over ``scale``."""
    jump = F.array_max(pairwise(velocity(arr, dims), lambda p, c: F.abs(c["speed"] - p["speed"])))
    return F.when(F.size(arr) >= 3, F.coalesce(cap1(jump / scale), F.lit(0.0))).otherwise(0.0)


def depth_convergence(arr: Column) -> Column:
    """Direction reversal between the first and the second half of the path."""
    n = F.size(arr)
    a, m, z = F.get(arr, F.lit(0)), F.get(arr, F.floor(n / 2).cast("int")), F.get(arr, n - 1)
    u = [m[c] - a[c] for c in "xyz"]
    v = [z[c] - m[c] for c in "xyz"]
    dot = u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    nu = F.sqrt(u[0] * u[0] + u[1] * u[1] + u[2] * u[2])
    nv = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    ok = (n >= 4) & (nu >= 1e-6) & (nv >= 1e-6)
    return F.when(ok, clip01((1.0 - dot / (nu * nv)) / 1.5)).otherwise(0.0)


def falling_share(arr: Column, field: str, min_points: int = 4) -> Column:
    """Share of steps in which a value decreases."""
    down = pairwise(arr, lambda p, c: (c[field] < p[field]).cast("double"))
    return F.when(F.size(arr) >= min_points, mean_of(down)).otherwise(0.0)


def slope(values: Column) -> Column:
    """Least-squares slope of an array against 0, 1, 2, ...; NULL below two points."""
    n = F.size(values).cast("double")
    mx = (n - 1) / 2
    sxy = F.aggregate(F.transform(values, lambda v, i: (i - mx) * v), F.lit(0.0), lambda a, v: a + v)
    return sxy / F.nullif(n * (n * n - 1) / 12, F.lit(0.0))


def correlation(a: Column, b: Column, min_den: float = 1e-8) -> Column:
    """Pearson correlation of two equally long arrays; NULL when undefined."""
    add = lambda acc, v: acc + v

    def centred(arr: Column) -> Column:
        return let(arr, lambda x: let(mean_of(x), lambda m: F.transform(x, lambda v: v - m)))

    def total(arr: Column) -> Column:
        return F.aggregate(arr, F.lit(0.0), add)

    def ratio(p: Column) -> Column:
        den = F.sqrt(total(F.transform(p["a"], lambda v: v * v)) * total(F.transform(p["b"], lambda v: v * v)))
        num = total(F.zip_with(p["a"], p["b"], lambda x, y: x * y))
        return let(den, lambda d: F.when(d >= min_den, num / d))

    return let(F.struct(centred(a).alias("a"), centred(b).alias("b")), ratio)


def dual_body_score(arr: Column, a: str, b: str, dims: str = "xyz") -> Column:
    """Striker deceleration against receiver acceleration, mapped from [-1, 1] to [0, 1]."""
    def side(name: str) -> Column:
        t = F.transform(arr, lambda p: F.struct(p["frame"].alias("frame"), *[p[name][c].alias(c) for c in dims]))
        return pairwise(velocity(t, dims), lambda p, c: c["speed"] - p["speed"])
    r = correlation(F.transform(side(a), lambda v: -v), side(b))
    return F.when(F.size(arr) >= 4, let(r, lambda v: F.coalesce(clip01((v + 1.0) / 2.0), F.lit(0.0)))).otherwise(0.0)


def ema(arr: Column, alpha: float = 0.7) -> Column:
    """Exponential smoothing of a numeric array in order: last value."""
    return F.aggregate(arr, F.lit(None).cast("double"),
                       lambda acc, v: F.coalesce(alpha * v + (1 - alpha) * acc, v))
