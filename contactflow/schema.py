"""Table schemas, joint profiles and fixed parameter values."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

XY = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
XYZ = T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"])
BBOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x1", "y1", "x2", "y2")])
KEYS = ["match_id", "round_id"]


@dataclass(frozen=True)
class JointProfile:
    """Which array index holds which joint; passed into every pose operator."""

    left_wrist: int
    right_wrist: int
    head: tuple[int, ...] = (0, 1, 2, 3, 4)
    left_shoulder: int = 5
    right_shoulder: int = 6
    left_elbow: int = 7
    right_elbow: int = 8
    left_hip: int = 9
    right_hip: int = 10

    @property
    def wrists(self) -> tuple[int, int]:
        return (self.left_wrist, self.right_wrist)

    @property
    def hands(self) -> tuple[int, ...]:
        return (*self.wrists, self.left_elbow, self.right_elbow)

    @property
    def torso(self) -> tuple[int, ...]:
        return (self.left_shoulder, self.right_shoulder, self.left_hip, self.right_hip)

    @property
    def guard(self) -> tuple[int, ...]:
        return (self.left_elbow, self.right_elbow, self.right_wrist, self.left_wrist)

    def arm(self, side: str) -> tuple[int, int, int]:
        """(wrist, elbow, shoulder) of one side."""
        return ((self.left_wrist, self.left_elbow, self.left_shoulder) if side == "left"
                else (self.right_wrist, self.right_elbow, self.right_shoulder))


# Joint layouts.
MHR70 = JointProfile(left_wrist=62, right_wrist=41)
COCO17 = JointProfile(left_wrist=9, right_wrist=10, left_hip=11, right_hip=12)
COMPACT21 = JointProfile(left_wrist=19, right_wrist=20)

# Weight of the struck region, and the defaults for an unknown one.
REGION_WEIGHT = {"head": 1.00, "torso": 0.85, "left_arm": 0.20, "right_arm": 0.20,
                 "left_leg": 0.30, "right_leg": 0.30}
REGION_WEIGHT_UNKNOWN_EVENT = 0.5
REGION_WEIGHT_UNKNOWN = 0.6
# Where a region's marker sits on the receiver box (share of its height).
REGION_MARKER = {"head": 0.13, "left_arm": 0.40, "right_arm": 0.40, "left_leg": 0.80, "right_leg": 0.80}
REGION_MARKER_DEFAULT = 0.45

# Fusion weights. Each set sums to 1.
WEIGHTS = {
    "phase": {"decel": 0.30, "jerk": 0.25, "ext": 0.15, "depth": 0.15, "conf": 0.15},
    "standard": {"mask": 0.40, "decel": 0.20, "prox3d": 0.15, "jerk": 0.12, "conf": 0.08, "ext": 0.05},
    "reaction": {"mask": 0.33, "decel": 0.18, "react": 0.14, "prox3d": 0.12, "jerk": 0.10, "conf": 0.08, "ext": 0.05},
    "dual_body": {"mask": 0.28, "decel": 0.16, "dual": 0.18, "prox3d": 0.12, "jerk": 0.10, "conf": 0.08, "ext": 0.08},
    "dense_scan": {"mask": 0.36, "decel": 0.18, "react": 0.16, "prox3d": 0.12, "jerk": 0.10, "ext": 0.08},
    "window_scan": {"gap": 0.28, "ce_prob": 0.10, "region": 0.08, "decel": 0.12, "react": 0.04, "bbox_react": 0.04,
                    "approach": 0.06, "guard": 0.10, "audio": 0.02, "conf": 0.10},
    "anchored": {"gap": 0.26, "ce_prob": 0.08, "region": 0.10, "decel": 0.08, "ext": 0.10, "speed": 0.08,
                 "react": 0.06, "approach": 0.06, "audio": 0.04, "conf": 0.04, "guard": 0.10},
    "live": {"proximity": 0.35, "directed_velocity": 0.40, "extension": 0.15, "confidence": 0.10},
    "and_or": {"mask": 0.45, "depth": 0.35, "react": 0.20},
    "relabel": {"dist": 0.55, "audio": 0.30, "react": 0.15},
}

# Hard precision filters of the anchored detector.
GAP_MAX, IOU_REJECT, EXT_MIN, APPROACH_MIN, MIN_PEAK_SPEED, CLINCH_PENALTY = 0.95, 0.18, 0.45, 0.45, 0.42, 0.6

pose_frame = T.StructType([
    T.StructField("match_id", T.StringType()), T.StructField("round_id", T.IntegerType()),
    T.StructField("track_id", T.IntegerType()), T.StructField("frame", T.IntegerType()),
    T.StructField("bbox", BBOX),
    T.StructField("joints_2d", T.ArrayType(XY)),
    T.StructField("shared_space_coords", T.ArrayType(XYZ)),
    T.StructField("normalized_coords", T.ArrayType(XYZ)),
    T.StructField("focal_normalized_coords", T.ArrayType(XYZ)),
    T.StructField("world_coords", T.ArrayType(XYZ)),
    T.StructField("keypoint_conf", T.ArrayType(T.DoubleType())),
    T.StructField("world_coords_reliable", T.BooleanType()),
    T.StructField("pred_cam_t", XYZ), T.StructField("focal_length", T.DoubleType()),
])

# Raw JSON entry of a track; coordinate lists are arrays of numbers.
_NUMS = T.ArrayType(T.DoubleType())
raw_entry = T.StructType([
    T.StructField("track_id", T.IntegerType()), T.StructField("frame", T.IntegerType()),
    T.StructField("bbox", _NUMS), T.StructField("joints_2d", T.ArrayType(_NUMS)),
    T.StructField("frame_dims", T.StructType([T.StructField(c, T.DoubleType()) for c in (
        "original_width", "original_height", "resized_width", "resized_height")])),
    T.StructField("shared_space_coords", T.ArrayType(_NUMS)),
    T.StructField("normalized_coords", T.ArrayType(_NUMS)),
    T.StructField("focal_normalized_coords", T.ArrayType(_NUMS)),
    T.StructField("world_coords", T.ArrayType(_NUMS)),
    T.StructField("keypoint_conf", _NUMS), T.StructField("world_coords_reliable", T.BooleanType()),
    T.StructField("pred_cam_t", _NUMS), T.StructField("focal_length", T.DoubleType()),
])
raw_contact = T.StructType([
    T.StructField("frame", T.IntegerType()), T.StructField("time_sec", T.DoubleType()),
    T.StructField("striker_id", T.IntegerType()), T.StructField("receiver_id", T.IntegerType()),
    T.StructField("striker_keypoint", T.IntegerType()), T.StructField("striker_body_part", T.StringType()),
    T.StructField("receiver_keypoint", T.IntegerType()), T.StructField("receiver_body_part", T.StringType()),
    T.StructField("contact_prob", T.DoubleType()), T.StructField("contact_3d_distance_m", T.DoubleType()),
    T.StructField("contact_region", T.StringType()),
])
raw_action = T.StructType([
    T.StructField("fighter_id", T.IntegerType()), T.StructField("fighter_type", T.StringType()),
    T.StructField("action", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("frame", T.IntegerType()), T.StructField("window_start", T.IntegerType()),
    T.StructField("window_end", T.IntegerType()), T.StructField("timestamp_seconds", T.DoubleType()),
    T.StructField("target", T.StringType()), T.StructField("part", T.StringType()),
    T.StructField("is_significant", T.BooleanType()),
    T.StructField("speed_estimation", T.StructType([T.StructField("estimated_speed_kmh", T.DoubleType())])),
    T.StructField("power_estimation", T.StructType([T.StructField("estimated_power_watts", T.DoubleType())])),
])
raw_clip = T.StructType([
    T.StructField("clip", T.StringType()), T.StructField("round", T.IntegerType()),
    T.StructField("fighter_id", T.IntegerType()), T.StructField("action", T.StringType()),
    T.StructField("window_start", T.IntegerType()), T.StructField("window_end", T.IntegerType()),
    T.StructField("label", T.StringType()), T.StructField("impact_frame", T.IntegerType()),
])
