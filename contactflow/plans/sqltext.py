"""SQL text for the oracle: derived tables and small expression builders."""
from __future__ import annotations

from contactflow.plans.registry import view
from contactflow.sources.adapters import ACTIONS, N_JOINTS, PROFILE, REGIONS

P = PROFILE


def arr(names) -> str:
    return "[" + ",".join(f"'{n}'" for n in names) + "]"


view("hev", """
  SELECT event_id, user_id AS match_id, CAST(h // 240 AS INTEGER) AS round_id, CAST(h % 240 AS INTEGER) AS frame,
         event_type, value
  FROM (SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS h FROM events)""")
view("act", f"""
  SELECT match_id, round_id, event_id AS action_id, CAST(event_id % 2 AS INTEGER) AS fighter_id,
         {arr(ACTIONS)}[event_id % 6 + 1] AS action, least(1.0::DOUBLE, value / 200) AS confidence,
         frame AS action_frame, frame - 2 AS window_start, CAST(frame + 1 + event_id % 4 AS INTEGER) AS window_end,
         value / 10 AS speed_kmh, value * 10 AS power_watts
  FROM hev WHERE event_type = 'purchase'""")
view("ce", f"""
  SELECT match_id, round_id, event_id AS contact_id, frame AS ce_frame, CAST(event_id % 2 AS INTEGER) AS striker_id,
         CAST(1 - event_id % 2 AS INTEGER) AS receiver_id, least(1.0::DOUBLE, value / 150) AS contact_prob,
         CAST(event_id % 150 AS DOUBLE) / 1000 AS contact_3d_distance_m, {arr(REGIONS)}[event_id % 6 + 1] AS contact_region
  FROM hev WHERE event_type = 'error'""")
view("det", f"""
  SELECT match_id, round_id, event_id AS det_id, frame, value / 500 AS score, CAST(event_id % 2 AS INTEGER) AS striker_id,
         CAST(1 - event_id % 2 AS INTEGER) AS receiver_id, {arr(REGIONS)}[event_id % 6 + 1] AS region
  FROM hev WHERE event_type = 'click'""")
view("gt", "SELECT DISTINCT match_id, round_id, frame FROM hev WHERE event_type = 'signup'")
view("ons", """SELECT match_id, round_id, frame AS onset_frame, max(value / 350) AS strength
  FROM hev WHERE event_type = 'view' GROUP BY ALL""")
view("box", """
  SELECT *, x1 + 30 + frame % 40 AS x2, y1 + 60 + frame % 50 AS y2 FROM (
    SELECT match_id, round_id, CAST(event_id % 2 AS INTEGER) AS track_id, frame, max(value) AS x1,
           max(CAST(event_id * 37 % 101 AS DOUBLE)) AS y1
    FROM hev GROUP BY match_id, round_id, event_id % 2, frame)""")

_XS = ",".join(f"e[{3 * j + 1}]" for j in range(N_JOINTS))
_YS = ",".join(f"e[{3 * j + 2}]" for j in range(N_JOINTS))
view("pz", f"""
  SELECT *, list_min([{_XS}]) * 400 + 960 AS x1, list_min([{_YS}]) * 400 + 540 AS y1,
         list_max([{_XS}]) * 400 + 960 AS x2, list_max([{_YS}]) * 400 + 540 AS y2 FROM (
    SELECT vec_id, CAST(vec_id // 2 // 500 AS INTEGER) AS match_id, CAST((vec_id // 2 // 50) % 10 AS INTEGER) AS round_id,
           CAST(vec_id % 2 AS INTEGER) AS track_id, CAST((vec_id // 2) % 50 AS INTEGER) AS frame, label,
           CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""")
view("pact", f"""
  SELECT match_id, round_id, vec_id AS action_id, track_id AS fighter_id, {arr(ACTIONS)}[vec_id % 6 + 1] AS action,
         least(1.0::DOUBLE, abs(e[64]) * 4) AS confidence, frame AS action_frame, frame - 2 AS window_start,
         frame + 3 AS window_end FROM pz WHERE label < 3""")
view("pce", f"""
  SELECT match_id, round_id, frame AS ce_frame, track_id AS striker_id, 1 - track_id AS receiver_id,
         least(1.0::DOUBLE, abs(e[64]) * 5) AS contact_prob, {arr(REGIONS)}[vec_id % 6 + 1] AS contact_region
  FROM pz WHERE label BETWEEN 3 AND 5""")

view("pons", "SELECT match_id, round_id, frame AS onset_frame, max(least(1.0::DOUBLE, abs(e[64]) * 6)) AS strength FROM pz WHERE label >= 6 GROUP BY ALL")


# ---- expression builders over the pose view (alias a, joint j)

def X(a: str, j: int) -> str:
    return f"{a}.e[{3 * j + 1}]"


def Y(a: str, j: int) -> str:
    return f"{a}.e[{3 * j + 2}]"


def Z(a: str, j: int) -> str:
    return f"{a}.e[{3 * j + 3}]"


def PX(a: str, j: int) -> str:
    return f"({X(a, j)}*400+960)"


def PY(a: str, j: int) -> str:
    return f"({Y(a, j)}*400+540)"


def hyp(*terms: str) -> str:
    return "sqrt(" + "+".join(f"({t})*({t})" for t in terms) + ")"


def dj(a: str, i: int, b: str, j: int, dims: str = "xy") -> str:
    f = {"x": X, "y": Y, "z": Z}
    return hyp(*[f"{f[c](a, i)}-{f[c](b, j)}" for c in dims])


def dpx(a: str, i: int, b: str, j: int) -> str:
    return hyp(f"{PX(a, i)}-{PX(b, j)}", f"{PY(a, i)}-{PY(b, j)}")


def least_of(terms) -> str:
    return "least(" + ",".join(terms) + ")"


def mean(terms) -> str:
    terms = list(terms)
    return "((" + "+".join(terms) + f")/{len(terms)})"


def HX(a: str) -> str:
    return mean(X(a, j) for j in P.head)


def HY(a: str) -> str:
    return mean(Y(a, j) for j in P.head)


def HZ(a: str) -> str:
    return mean(Z(a, j) for j in P.head)


def SW(a: str) -> str:
    return f"({dj(a, P.left_shoulder, a, P.right_shoulder)}+1e-6)"


def min_pair(s: str, wrists, r: str, joints, fn=dj) -> str:
    return least_of(fn(s, w, r, j) for w in wrists for j in joints)


def iou(a: str, b: str) -> str:
    iw = f"greatest(0.0::DOUBLE, least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))"
    ih = f"greatest(0.0::DOUBLE, least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1))"
    aa, ab = f"({a}.x2-{a}.x1)*({a}.y2-{a}.y1)", f"({b}.x2-{b}.x1)*({b}.y2-{b}.y1)"
    return f"(CASE WHEN ({iw})*({ih}) > 0 THEN ({iw})*({ih})/({aa}+{ab}-({iw})*({ih})+1e-6) ELSE 0 END)"


def segdist(px, py, ax, ay, bx, by) -> str:
    dx, dy = f"({bx}-{ax})", f"({by}-{ay})"
    den = f"({dx}*{dx}+{dy}*{dy})"
    t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, (({px}-{ax})*{dx}+({py}-{ay})*{dy})/nullif({den},0)))"
    on = hyp(f"{px}-({ax}+{t}*{dx})", f"{py}-({ay}+{t}*{dy})")
    return f"(CASE WHEN {den} < 1e-9 THEN {hyp(f'{px}-{ax}', f'{py}-{ay}')} ELSE {on} END)"


PAIR = """pz s JOIN pz r ON s.match_id=r.match_id AND s.round_id=r.round_id AND s.frame=r.frame AND s.track_id<>r.track_id"""
PKEY = "s.match_id, s.round_id, s.frame, s.track_id AS striker_id, r.track_id AS receiver_id"
BPAIR = PAIR.replace("pz", "box")
