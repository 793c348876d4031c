"""Geometry as Column expressions: no UDFs, everything stays in the JVM.

Points are structs with x, y (and z); boxes are structs x1, y1, x2, y2.
"""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactflow.schema import JointProfile, REGION_MARKER, REGION_MARKER_DEFAULT


def joint(joints: Column, i: int) -> Column:
    return F.get(joints, F.lit(i))


def joints_of(joints: Column, idx: Iterable[int]) -> Column:
    """Array of the listed joints, missing ones removed."""
    return F.filter(F.array(*[joint(joints, i) for i in idx]), lambda p: p.isNotNull())


def null_if_zero(p: Column, dims: str = "xy") -> Column:
    """A joint at the origin means 'not detected'."""
    near0 = None
    for c in dims:
        t = F.abs(p[c]) <= 1e-8
        near0 = t if near0 is None else near0 & t
    return F.when(~near0, p)


def dist(a: Column, b: Column, dims: str = "xy") -> Column:
    s = None
    for c in dims:
        d = a[c] - b[c]
        s = d * d if s is None else s + d * d
    return F.sqrt(s)


def norm(v: Iterable[Column]) -> Column:
    s = None
    for c in v:
        s = c * c if s is None else s + c * c
    return F.sqrt(s)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def mean_of(values: Column) -> Column:
    """Mean of a numeric array; NULL when empty."""
    n = F.size(values)
    return F.when(n > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n)


def field(arr: Column, name: str) -> Column:
    """One field of every struct in an array."""
    return F.transform(arr, lambda p: p[name])


def centroid(joints: Column, idx: Iterable[int], dims: str = "xy") -> Column:
    """Mean of the listed joints that are present; NULL when none is."""
    pts = joints_of(joints, idx)
    return F.when(F.size(pts) > 0, F.struct(*[mean_of(field(pts, c)).alias(c) for c in dims]))


def min_dist(points_a: Column, points_b: Column, dims: str = "xy") -> Column:
    """Smallest distance between two point arrays (inside the row, no shuffle)."""
    return F.array_min(F.transform(points_a, lambda a: F.array_min(
        F.transform(points_b, lambda b: dist(a, b, dims)))))


# ---- boxes

def box_center(b: Column) -> Column:
    return point((b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2)


def box_area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def box_head(b: Column, share: float = 0.18) -> Column:
    return point((b["x1"] + b["x2"]) / 2, b["y1"] + share * (b["y2"] - b["y1"]))


def box_diag(b: Column) -> Column:
    return norm([b["x2"] - b["x1"], b["y2"] - b["y1"]]) + 1e-6


def box_iou(a: Column, b: Column) -> Column:
    iw = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    ih = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    inter = iw * ih
    return F.when(inter > 0, inter / (box_area(a) + box_area(b) - inter + 1e-6)).otherwise(0.0)


def in_box(p: Column, b: Column, margin: float = 0.0) -> Column:
    return (p["x"] >= b["x1"] - margin) & (p["x"] <= b["x2"] + margin) & (
        p["y"] >= b["y1"] - margin) & (p["y"] <= b["y2"] + margin)


def outside_distance(p: Column, b: Column) -> Column:
    """Distance from a point to a box; zero inside, NULL if a coordinate is missing (``greatest`` skips NULL)."""
    dx = F.greatest(b["x1"] - p["x"], F.lit(0.0), p["x"] - b["x2"])
    dy = F.greatest(b["y1"] - p["y"], F.lit(0.0), p["y"] - b["y2"])
    there = p["x"].isNotNull() & p["y"].isNotNull() & b["x1"].isNotNull() & b["y1"].isNotNull() & b["x2"].isNotNull() & b["y2"].isNotNull()
    return F.when(there, norm([dx, dy]))


def padded_square_side(a: Column, b: Column, factor: float = 1.4, floor: float = 200.0) -> Column:
    """Side of the square crop around the union of two boxes."""
    w = F.greatest(a["x2"], b["x2"]) - F.least(a["x1"], b["x1"])
    h = F.greatest(a["y2"], b["y2"]) - F.least(a["y1"], b["y1"])
    return F.greatest(F.lit(floor), F.greatest(w, h) * factor)


def depth_from_box(b: Column, focal: Column, body_height: float) -> Column:
    """Metric depth from apparent height."""
    return focal * body_height / F.nullif(b["y2"] - b["y1"], F.lit(0.0))


def depth_proxy(b: Column, frame_area: float) -> Column:
    return box_area(b) / (frame_area + 1e-6)


def shift_depth(p: Column, offset: Column) -> Column:
    """Bring a point into the other person's depth frame; no offset leaves it as it is."""
    return F.struct(p["x"].alias("x"), p["y"].alias("y"), (p["z"] + F.coalesce(offset, F.lit(0.0))).alias("z"))


# ---- joints in image space

def project_to_box(joints: Column, b: Column, p: Column) -> Column:
    """Map a body-centred joint into the box through the extent of all joints."""
    xs, ys = F.transform(joints, lambda j: j["x"]), F.transform(joints, lambda j: j["y"])
    x0, x1, y0, y1 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    return F.when((x1 > x0) & (y1 > y0), point(
        b["x1"] + (p["x"] - x0) / (x1 - x0) * (b["x2"] - b["x1"]),
        b["y1"] + (p["y"] - y0) / (y1 - y0) * (b["y2"] - b["y1"])))


def pinhole(p: Column, focal: Column, width: int, height: int, near: float = 0.1, up: bool = False, whole: bool = False) -> Column:
    """Perspective projection; NULL behind the near plane or off screen. up: y grows upwards in space; whole: pixels cut to integers."""
    u = focal * p["x"] / p["z"] + width / 2
    v = height / 2 - focal * p["y"] / p["z"] if up else focal * p["y"] / p["z"] + height / 2
    if whole:
        u, v = u.cast("int").cast("double"), v.cast("int").cast("double")
    ok = (p["z"] > near) & (u >= 0) & (u < width) & (v >= 0) & (v < height)
    return F.when(ok, point(u, v))


def to_camera_space(joints: Column, cam_t: Column) -> Column:
    return F.transform(joints, lambda j: F.struct(
        *[(j[c] + cam_t[c]).alias(c) for c in "xyz"]))


def shoulder_width(joints: Column, profile: JointProfile, fallback_box: Column | None = None,
                   dims: str = "xy") -> Column:
    w = dist(joint(joints, profile.left_shoulder), joint(joints, profile.right_shoulder), dims) + 1e-6
    return w if fallback_box is None else F.coalesce(w, box_diag(fallback_box) * 0.30)


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    """Distance from p to segment a-b; distance to a when the segment is a point."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    den = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (
        (p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / F.nullif(den, F.lit(0.0))))
    on = norm([p["x"] - (a["x"] + t * dx), p["y"] - (a["y"] + t * dy)])
    return F.when(den < 1e-9, dist(p, a)).otherwise(on)


def fist_position(wrists: Column, own: Column, other: Column) -> Column:
    """First wrist present, else the box edge facing the opponent at 28 % height."""
    lead = F.when((own["x1"] + own["x2"]) / 2 < (other["x1"] + other["x2"]) / 2, own["x2"]).otherwise(own["x1"])
    return F.coalesce(F.get(F.filter(wrists, lambda w: w.isNotNull()), F.lit(0)),
                      point(lead, own["y1"] + 0.28 * (own["y2"] - own["y1"])))


def contact_zone(wrist: Column, joints: Column, profile: JointProfile, head_radius: float = 100.0) -> Column:
    """Six zones: head, upper and lower torso, each left or right of the body centre."""
    sh = joints_of(joints, (profile.left_shoulder, profile.right_shoulder))
    hp = joints_of(joints, (profile.left_hip, profile.right_hip))
    body = F.concat(sh, hp)
    cx = mean_of(F.transform(body, lambda p: p["x"]))
    sy = mean_of(F.transform(sh, lambda p: p["y"]))
    hy = mean_of(F.transform(hp, lambda p: p["y"]))
    side = F.when(wrist["x"] < cx, "left").otherwise("right")
    head = F.array_min(F.transform(joints_of(joints, profile.head), lambda p: dist(wrist, p)))
    return (F.when(head < head_radius, F.concat(F.lit("head_"), side))
            .when(sy.isNotNull() & hy.isNotNull() & (wrist["y"] < (sy + hy) / 2), F.concat(F.lit("upper_torso_"), side))
            .when(sy.isNotNull() & hy.isNotNull(), F.concat(F.lit("lower_torso_"), side))
            .when(sy.isNotNull(), F.concat(F.lit("upper_torso_"), side))
            .otherwise("torso"))


def nearest_joint_region(wrists: Column, joints: Column, profile: JointProfile) -> Column:
    """Struct (d, k, region) of the receiver joint closest to any wrist."""
    groups = [(i, "head") for i in profile.head] + [(i, "torso") for i in profile.torso] + [
        (i, "arm") for i in (profile.left_elbow, profile.right_elbow)]

    def closest(i: int) -> Column:
        return F.array_min(F.transform(wrists, lambda w: dist(w, joint(joints, i))))

    cands = F.array(*[F.struct(closest(i).alias("d"), F.lit(i).alias("k"), F.lit(r).alias("region"))
                      for i, r in groups])
    return F.array_min(F.filter(cands, lambda c: c["d"].isNotNull()))


def region_marker(b: Column, region: Column) -> Column:
    share = F.lit(REGION_MARKER_DEFAULT)
    for name, v in REGION_MARKER.items():
        share = F.when(region == name, F.lit(v)).otherwise(share)
    return F.struct(((b["x1"] + b["x2"]) / 2).cast("int").alias("x"),
                    (b["y1"] + share * (b["y2"] - b["y1"])).cast("int").alias("y"))


def head_roi(joints: Column, profile: JointProfile, pad: int, width: int, height: int) -> Column:
    """Padded, clamped box of the head joints, else of the torso joints."""
    head = joints_of(joints, profile.head)
    pts = F.when(F.size(head) > 0, head).otherwise(joints_of(joints, profile.torso))
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    x1, y1, x2, y2 = (c.cast("int") for c in (F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))
    roi = F.struct(F.greatest(F.lit(0), x1 - pad).alias("x1"), F.greatest(F.lit(0), y1 - pad).alias("y1"),
                   F.least(F.lit(width), x2 + pad).alias("x2"), F.least(F.lit(height), y2 + pad).alias("y2"))
    return F.when((F.size(pts) > 0) & (roi["x2"] > roi["x1"]) & (roi["y2"] > roi["y1"]), roi)


def joint_subset(joints: Column, n: int) -> Column:
    """First n joints with a synthetic confidence: 0 for an undetected joint, else 1."""
    return F.transform(F.slice(joints, 1, n), lambda j: F.struct(
        j["x"].alias("x"), j["y"].alias("y"),
        F.when((F.abs(j["x"]) <= 1e-8) & (F.abs(j["y"]) <= 1e-8), 0.0).otherwise(1.0).alias("conf")))


# ---- roles

def hand_of_action(action: Column, default: str = "right") -> Column:
    """Striking hand from the action name (suffix first, then the unsuffixed names)."""
    return (F.when(action.endswith("_left"), "left").when(action.endswith("_right"), "right")
            .when(action == "jab", "left").when(action == "cross", "right").otherwise(default))


def track_of_fighter(fighter: Column) -> Column:
    """``fighter_N`` to N; any other text is an error."""
    n = F.regexp_extract(fighter, r"^fighter_(\d+)$", 1)
    return F.when(n != "", n.cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("not a fighter id: "), fighter)).cast("int"))
