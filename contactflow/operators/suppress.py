"""Temporal suppression: score-greedy NMS and frame-ordered cooldowns.

All of these are order dependent. Rows are first reduced to one winner per frame
(every later row of that frame would be suppressed anyway), then resolved in
frame blocks, so neither a hot recording nor a dense run of candidates is ever
gathered whole.
"""
from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactflow.operators.ordering import BLOCK, block_of
from contactflow.session import cut_lineage

DROPPED, KEPT, UNKNOWN = 0, 1, 2
#: No row.
NONE = -(1 << 62)


def _winner_per_frame(df: DataFrame, keys: list[str], frame: str,
                      order: Sequence[Column]) -> DataFrame:
    """The row that comes first in ``order`` for every (key, frame)."""
    rest = [c for c in df.columns if c not in (*keys, frame)]
    best = F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)],
                          F.struct(*rest).alias("_row")))
    return df.groupBy(*keys, frame).agg(best.alias("_w"))


# ---------------------------------------------------------------- first-fit cooldown

def _walk(frames: np.ndarray, allowed: int, cooldown: int) -> tuple[np.ndarray, int]:
    """Kept positions when nothing before ``allowed`` may be kept; and the next allowed frame."""
    kept = []
    i = int(np.searchsorted(frames, allowed))
    while i < len(frames):
        kept.append(i)
        allowed = int(frames[i]) + cooldown
        i = int(np.searchsorted(frames, allowed))
    return np.asarray(kept, dtype=np.int64), allowed


def first_fit(df: DataFrame, keys: Sequence[str], frame: str, cooldown: int, *,
              tie: Sequence[str], size: int = BLOCK) -> DataFrame:
    """Keep a row iff it lies at least ``cooldown`` frames after the last kept row.

    Per block a table maps every possible entry state (0..cooldown-1 frames still
    blocked) to the exit state; composing these small tables gives each block its
    true entry state, after which all blocks resolve independently.
    """
    keys = list(keys)
    size = max(size, 2 * cooldown)
    rows = _winner_per_frame(df, keys, frame, [F.col(c) for c in tie])
    blocks = (rows.withColumn("_blk", block_of(frame, size))
              .groupBy(*keys, "_blk")
              .agg(F.sort_array(F.collect_list(F.struct(F.col(frame).alias("f"), F.col("_w._row").alias("row"))))
                   .alias("_rows"))
              .withColumn("_f", F.transform("_rows", lambda x: (x["f"] - F.col("_blk") * size).cast("int"))))

    @F.pandas_udf("array<int>")
    def exits(frames: pd.Series) -> pd.Series:
        out = []
        for f in frames:
            f = np.asarray(f)
            # states that lead to the same first kept row share one walk
            first = np.searchsorted(f, np.arange(cooldown))
            memo: dict[int, int] = {}
            table = []
            for c, i in enumerate(first):
                i = int(i)
                if i == len(f):
                    table.append(max(0, c - size))
                    continue
                if i not in memo:
                    memo[i] = max(0, _walk(f, c, cooldown)[1] - size)
                table.append(memo[i])
            out.append(table)
        return pd.Series(out)

    @F.pandas_udf("array<int>")
    def entries(blks: pd.Series, tables: pd.Series) -> pd.Series:
        out = []
        for b, t in zip(blks, tables):
            state, prev, got = 0, None, []
            for blk, table in zip(b, t):
                if prev is not None and blk != prev + 1:
                    state = 0  # an empty block is longer than any cooldown
                got.append(state)
                state, prev = int(table[state]), blk
            out.append(got)
        return pd.Series(out)

    @F.pandas_udf("array<boolean>")
    def resolve(frames: pd.Series, entry: pd.Series) -> pd.Series:
        out = []
        for f, e in zip(frames, entry):
            f = np.asarray(f)
            mask = np.zeros(len(f), dtype=bool)
            mask[_walk(f, int(e), cooldown)[0]] = True
            out.append(mask.tolist())
        return pd.Series(out)

    # one small row per block (its state table), gathered per recording
    tables = blocks.select(*keys, "_blk", exits("_f").alias("_x"))
    per_key = (tables.groupBy(*keys)
               .agg(F.sort_array(F.collect_list(F.struct("_blk", "_x"))).alias("_t"))
               .withColumn("_e", entries(F.col("_t._blk"), F.col("_t._x"))))
    entry = (per_key.select(*keys, F.explode(F.arrays_zip(F.col("_t._blk").alias("b"), F.col("_e").alias("e"))).alias("z"))
             .select(*keys, F.col("z.b").alias("_blk"), F.col("z.e").alias("_entry")))
    out = (blocks.join(entry, [*keys, "_blk"])
           .withColumn("_m", resolve("_f", "_entry"))
           .select(*keys, F.explode(F.filter(
               F.zip_with("_rows", "_m", lambda r, m: F.struct(r.alias("r"), m.alias("m"))),
               lambda z: z["m"])).alias("_z"))
           .select(*keys, F.col("_z.r.f").alias(frame), "_z.r.row.*"))
    return out.select(*df.columns)


# ---------------------------------------------------------------- score-greedy NMS

def _nms_block(frames, score, tie, status, lo, hi, cooldown):
    """Resolve what can be decided from the frames visible in [lo, hi)."""
    frames = np.asarray(frames)
    status = np.array(status)
    order = np.lexsort((np.asarray(tie), frames, -np.asarray(score, dtype=float)))
    done = status != UNKNOWN
    for i in order:
        a = np.searchsorted(frames, frames[i] - cooldown, side="right")
        b = np.searchsorted(frames, frames[i] + cooldown, side="left")
        if status[i] == UNKNOWN:
            near = status[a:b][done[a:b]]
            if (near == KEPT).any():
                status[i] = DROPPED
            elif (near == UNKNOWN).any() or frames[i] - cooldown + 1 < lo or frames[i] + cooldown - 1 >= hi:
                status[i] = UNKNOWN
            else:
                status[i] = KEPT
        done[i] = True
    return status


class _Open:
    """The open rows of a block, with those of its neighbours that reach over its edges; rows are named by frame."""

    def __init__(self, frames, score, tie, lo: int, hi: int, cooldown: int) -> None:
        order = np.lexsort((np.asarray(tie), np.asarray(frames), -np.asarray(score, dtype=float)))
        self.f, self.lo, self.hi, self.cd = [int(x) for x in frames], lo, hi, cooldown
        self.rank = np.empty(len(order), dtype=np.int64)
        self.rank[order] = np.arange(len(order))
        self.near = [(bisect_left(self.f, x - cooldown + 1), bisect_left(self.f, x + cooldown)) for x in self.f]
        self.own = [int(i) for i in order if lo <= self.f[i] < hi]

    def beaten(self, i: int) -> list[int]:
        a, b = self.near[i]
        return [j for j in range(a, b) if self.rank[j] > self.rank[i] and self.lo <= self.f[j] < self.hi]

    def outside(self, left: bool) -> list[int]:
        """Frames of neighbours' rows that, if kept, drop a row of this block."""
        return [x for i, x in enumerate(self.f) if (x < self.lo if left else x >= self.hi) and self.beaten(i)]

    def kept(self, *outside: int) -> list[int]:
        """Own rows kept if these neighbours' rows are."""
        gone = bytearray(len(self.f))
        for x in outside:
            if x != NONE:
                for j in self.beaten(bisect_left(self.f, x)):
                    gone[j] = 1
        out = []
        for i in self.own:
            if not gone[i]:
                out.append(self.f[i])
                a, b = self.near[i]
                gone[a:b] = b"\1" * (b - a)
        return out

    def table(self) -> list[dict[str, int]]:
        """For each kept row of either neighbour (at most one can reach in) the own kept rows that reach out."""
        out = []
        for left in [NONE, *self.outside(True)]:
            for right in [NONE, *self.outside(False)]:
                kept = self.kept(left, right)
                out.append({"left": left, "right": right, "first": max((x for x in kept if x < self.lo + self.cd - 1), default=NONE),
                            "last": max((x for x in kept if x > self.hi - self.cd), default=NONE)})
        return out


def _chained(blks, tables) -> list[tuple[int, int]]:
    """The kept rows of either neighbour for each block: the one choice with which all tables of a recording agree.

    tables: for each block its rows (left, right, first, last). A block says what it takes its right neighbour's first row to be, which
    that block's own result must meet (a row that matters to nobody counts as none)."""
    out: list[tuple[int, int]] = []
    trail: list[dict] = []

    def close() -> None:
        at, back = next(k for k in trail[-1] if k[1] == NONE), []
        for step in reversed(trail):
            before, left = step[at]
            back.append((left, at[1]))
            at = before
        out.extend(reversed(back))
        trail.clear()

    states, asked, before = {(NONE, NONE): None}, set(), None
    for b, rows in zip(blks, tables):
        if before is not None and b != before + 1:
            close()
            states, asked = {(NONE, NONE): None}, set()
        known: dict[int, list] = {}
        for left, right, first, last in rows:
            known.setdefault(left, []).append((right, first, last))
        step: dict = {}
        for last_before, want in states:
            left = last_before if last_before in known else NONE
            for right, first, last in known[left]:
                if first == want if want != NONE else first not in asked:
                    step[last, right] = ((last_before, want), left)
        trail.append(step)
        states, asked, before = step, {r[1] for r in rows} - {NONE}, b
    if trail:
        close()
    return out


def greedy_nms(df: DataFrame, keys: Sequence[str], frame: str, score: str, cooldown: int, *,
               tie: str, size: int = BLOCK) -> DataFrame:
    """Highest score first; keep a row iff no kept row lies closer than ``cooldown``.

    Equal scores resolve by (frame, tie). A block sees a halo of neighbours and
    decides every row whose outcome cannot depend on anything further away. What stays
    open (long runs of equal scores or monotone ramps across block edges) is a problem of
    its own over the open rows: at most one kept row of either neighbour reaches into a block, so
    a block tabulates its edges' outcomes for each of these, one walk per recording
    over the tables finds the outcomes that agree, and every block settles its rows.
    So the work takes a fixed number of steps however long the runs are, and rows wait outside until their frames are
    settled. Rows without a score are no candidates: they neither suppress nor are kept.
    """
    keys = list(keys)
    df = df.where(F.col(score).isNotNull())
    halo = 16 * cooldown
    size = max(size, 8 * halo)
    rows = _winner_per_frame(df, keys, frame, [-F.col(score), F.col(tie)])
    rows = cut_lineage(rows.select(*keys, F.col(frame).alias("_frame"), F.col("_w._row").alias("_row"), (-F.col("_w._o0")).alias("_sc"), F.col("_w._o1").alias("_tie")))

    def dealt(d: DataFrame, reach: int) -> DataFrame:
        """A row for each block: its rows and those of its neighbours within reach."""
        spots = F.sequence(block_of(F.col("_frame") - reach, size), block_of(F.col("_frame") + reach, size))
        return (d.withColumn("_blk", F.explode(spots)).groupBy(*keys, "_blk")
                .agg(F.sort_array(F.collect_list(F.struct("_frame", "_sc", "_tie"))).alias("_a")))

    @F.pandas_udf("array<int>")
    def resolve(blk: pd.Series, f: pd.Series, s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([
            _nms_block(a, b, c, np.full(len(a), UNKNOWN), k * size - halo, (k + 1) * size + halo, cooldown).tolist()
            for k, a, b, c in zip(blk, f, s, t)])

    part = lambda n: lambda t: t[n]
    made = lambda k, a, b, c: _Open(a, b, c, int(k) * size, (int(k) + 1) * size, cooldown)

    @F.pandas_udf("array<struct<left:bigint,right:bigint,first:bigint,last:bigint>>")
    def table(blk: pd.Series, f: pd.Series, s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([made(*x).table() for x in zip(blk, f, s, t)])

    @F.pandas_udf("array<struct<left:bigint,right:bigint>>")
    def chained(blks: pd.Series, *cells: pd.Series) -> pd.Series:
        return pd.Series([[{"left": x, "right": y} for x, y in _chained(own[0], [list(zip(*t)) for t in zip(*own[1:])])] for own in zip(blks, *cells)])

    @F.pandas_udf("array<bigint>")
    def settle(blk: pd.Series, f: pd.Series, s: pd.Series, t: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([made(*x[:4]).kept(*x[4:]) for x in zip(blk, f, s, t, left, right)])

    cells = ["_blk", "_a._frame", "_a._sc", "_a._tie"]
    d = dealt(rows, halo).withColumn("_n", resolve(*cells))
    d = d.select(*keys, "_blk", F.explode(F.zip_with("_a", "_n", lambda a, n: F.struct(a.alias("a"), n.alias("n")))).alias("z"))
    d = d.where((block_of("z.a._frame", size) == F.col("_blk")) & (F.col("z.n") != DROPPED))
    d = cut_lineage(d.select(*keys, "z.a.*", F.col("z.n").alias("_st")))
    kept = d.where(F.col("_st") == KEPT).select(*keys, "_frame")
    open_ = d.where(F.col("_st") == UNKNOWN)
    if not open_.isEmpty():
        open_ = cut_lineage(dealt(open_, cooldown - 1))
        tables = open_.select(*keys, "_blk", table(*cells).alias("_t"))
        whole = tables.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_blk", "_t"))).alias("_b"))
        chosen = whole.withColumn("_c", chained("_b._blk", *[F.transform("_b._t", part(n)) for n in ("left", "right", "first", "last")]))
        chosen = chosen.select(*keys, F.explode(F.arrays_zip(F.col("_b._blk").alias("b"), F.col("_c").alias("c"))).alias("z"))
        chosen = chosen.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("z.b").alias("_b"), "z.c.*")
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        more = open_.join(chosen, [*same, F.col("_blk") == F.col("_b")])
        more = more.select(*keys, F.explode(settle(*cells, "left", "right")).alias("_frame"))
        kept = kept.unionByName(more.withColumn("_frame", F.col("_frame").cast(rows.schema["_frame"].dataType)))
    kept = kept.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_frame").alias("_f"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    kept = rows.join(kept, [*same, F.col("_frame") == F.col("_f")], "left_semi")
    return kept.select(*keys, F.col("_frame").alias(frame), "_row.*").select(*df.columns)


# ---------------------------------------------------------------- two-level cooldowns

#: Frames still blocked: for every pair, and for each pair that is blocked at all.
State = tuple[int, tuple[tuple[str | None, int], ...]]
FREE: State = (0, ())


class Automaton:
    """The cooldown as an automaton over the rows (frame, pair) of a block; its states are relative to a frame."""

    def __init__(self, frames: Sequence[int], pairs: Sequence[str | None], base: int, pair_cooldown: int, global_cooldown: int) -> None:
        self.f, self.p, self.base = [int(f) for f in frames], list(pairs), int(base)
        self.pc, self.gc = pair_cooldown, global_cooldown
        self.head = bisect_left(self.f, base + max(pair_cooldown, global_cooldown))
        self.memo: dict[tuple, State] = {}

    def left(self, until: int, last: dict, frame: int) -> State:
        """The state at ``frame``."""
        return max(0, until - frame), tuple(sorted(((p, u - frame) for p, u in last.items() if u > frame), key=lambda x: (x[0] is not None, x[0])))

    def walk(self, state: State, frame: int, lo: int, hi: int, to: int, share: bool = False) -> tuple[list[int], State]:
        """Rows lo..hi accepted from a state at ``frame``, and the state at frame ``to``; walks that meet share their ends."""
        until, last = frame + state[0], {p: frame + n for p, n in state[1]}
        taken, met, end = [], [], None
        i = bisect_left(self.f, until, lo, hi)
        while i < hi:
            f, p = self.f[i], self.p[i]
            if f < last.get(p, f):
                i += 1
                continue
            taken.append(i)
            until, last[p] = f + self.gc, f + self.pc
            if share:
                here = (i, self.left(until, last, f))
                if (end := self.memo.get(here)) is not None:
                    break
                met.append(here)
            i = bisect_left(self.f, until, i + 1, hi)
        if end is None:
            end = self.left(until, last, to)
        for here in met:
            self.memo[here] = end
        return taken, end

    @property
    def settled(self) -> int:
        """The frame from which on nothing before the block counts."""
        return self.base + max(self.pc, self.gc)

    def middle(self, entry: State) -> State:
        return self.walk(entry, self.base, 0, self.head, self.settled)[1]

    def exit(self, middle: State, size: int) -> State:
        return self.walk(middle, self.settled, self.head, len(self.f), self.base + size, share=True)[1]

    def likely(self) -> list[State]:
        """Middle states after no or one acceptance in the frames before the block."""
        pairs = list(dict.fromkeys(self.p[:self.head]))
        entries = [FREE, *[(max(0, self.gc - o), ((p, self.pc - o),) if o < self.pc else ()) for o in range(1, max(self.pc, self.gc)) for p in pairs]]
        return list(dict.fromkeys(map(self.middle, entries)))


def _text(state: State) -> str:
    return json.dumps(state)


def _state(text: str) -> State:
    n, pairs = json.loads(text)
    return n, tuple((p, k) for p, k in pairs)


def pair_global_cooldown(df: DataFrame, keys: Sequence[str], frame: str, pair: Column, *,
                         pair_cooldown: int, global_cooldown: int, tie: Sequence[str], size: int = BLOCK) -> DataFrame:
    """Frame-ordered acceptance with a cooldown per pair and one over all pairs.

    Pass an unordered pair key for symmetric cooldowns or a directed one for
    per-direction cooldowns. Rows of one frame are tried in pair order.

    A block of frames is an automaton. What came before it counts in its first
    ``max(cooldowns)`` frames only, so a block is its rows of these frames and a table
    from the state after them to the state at its end. Tables hold the states that
    follow from at most one earlier acceptance; a walk over the blocks of a recording
    asks for the few others, which their blocks add until none is missing. Then every block
    accepts its own rows. No array holds a run, however dense it is.
    """
    keys = list(keys)
    gap = max(pair_cooldown, global_cooldown, 1)
    size = max(size, 2 * gap)
    d = df.withColumn("_p", pair)
    # later rows of the same frame and pair are always blocked
    rest = [c for c in df.columns if c not in (*keys, frame)]
    d = (d.groupBy(*keys, frame, "_p")
         .agg(F.min(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(tie)],
                             F.struct(*rest).alias("_row"))).alias("_w")))
    blocks = d.groupBy(*keys, block_of(frame, size).alias("_blk")).agg(F.sort_array(F.collect_list(
        F.struct(F.col(frame).alias("f"), F.col("_p").alias("p"), F.col("_w").alias("w")))).alias("_a"))
    blocks = cut_lineage(blocks)
    made = lambda b, f, p: Automaton(f, p, b * size, pair_cooldown, global_cooldown)

    @F.pandas_udf("array<struct<middle:string,exit:string>>")
    def likely(blks: pd.Series, frames: pd.Series, pairs: pd.Series) -> pd.Series:
        out = []
        for b in map(made, blks, frames, pairs):
            out.append([{"middle": _text(m), "exit": _text(b.exit(m, size))} for m in b.likely()])
        return pd.Series(out)

    @F.pandas_udf("string")
    def exit_(blks: pd.Series, frames: pd.Series, pairs: pd.Series, middles: pd.Series) -> pd.Series:
        return pd.Series([_text(made(b, f, p).exit(_state(m), size)) for b, f, p, m in zip(blks, frames, pairs, middles)])

    @F.pandas_udf("array<struct<entry:string,middle:string,missing:boolean>>")
    def passed(blks: pd.Series, frames: pd.Series, pairs: pd.Series, middles: pd.Series, exits: pd.Series) -> pd.Series:
        out = []
        for recording in zip(blks, frames, pairs, middles, exits):
            state, before, got = FREE, None, []
            for b, f, p, ms, es in zip(*recording):
                entry = state if before is not None and b == before + 1 else FREE  # an absent block outlasts any cooldown
                middle, table = _text(made(b, f, p).middle(entry)), dict(zip(ms, es))
                got.append({"entry": _text(entry), "middle": middle, "missing": middle not in table})
                state, before = _state(table.get(middle, es[0])), b
            out.append(got)
        return pd.Series(out)

    @F.pandas_udf("array<boolean>")
    def accept(blks: pd.Series, frames: pd.Series, pairs: pd.Series, entries: pd.Series) -> pd.Series:
        out = []
        for b, f, p, e in zip(blks, frames, pairs, entries):
            mask = np.zeros(len(f), dtype=bool)
            mask[made(b, f, p).walk(_state(e), b * size, 0, len(f), (b + 1) * size)[0]] = True
            out.append(mask.tolist())
        return pd.Series(out)

    head = F.filter("_a", lambda x: x["f"] < F.col("_blk") * size + gap)
    heads = blocks.select(*keys, "_blk", head.alias("_h")).select(*keys, "_blk", F.col("_h.f").alias("hf"), F.col("_h.p").alias("hp"))
    known = cut_lineage(blocks.select(*keys, "_blk", likely("_blk", "_a.f", "_a.p").alias("_t")))
    while True:
        whole = (heads.join(known, [*keys, "_blk"]).groupBy(*keys)
                 .agg(F.sort_array(F.collect_list(F.struct("_blk", "hf", "hp", F.col("_t.middle").alias("m"), F.col("_t.exit").alias("e")))).alias("_b")))
        steps = whole.select(*keys, F.explode(F.arrays_zip(F.col("_b._blk").alias("b"), passed("_b._blk", "_b.hf", "_b.hp", "_b.m", "_b.e").alias("s"))).alias("z"))
        steps = cut_lineage(steps.select(*keys, F.col("z.b").alias("_blk"), "z.s.*"))
        asked = steps.where("missing")
        if asked.isEmpty():
            break
        more = blocks.join(asked, [*keys, "_blk"]).select(*keys, "_blk", "middle", exit_("_blk", "_a.f", "_a.p", "middle").alias("exit"))
        more = more.select(*keys, "_blk", F.array(F.struct("middle", "exit")).alias("_n"))
        known = known.join(more, [*keys, "_blk"], "left")
        known = cut_lineage(known.select(*keys, "_blk", F.when(F.col("_n").isNull(), F.col("_t")).otherwise(F.concat("_t", "_n")).alias("_t")))
    out = (blocks.join(steps.select(*keys, "_blk", "entry"), [*keys, "_blk"])
           .withColumn("_m", accept("_blk", "_a.f", "_a.p", "entry"))
           .select(*keys, F.explode(F.filter(
               F.zip_with("_a", "_m", lambda a, m: F.struct(a.alias("a"), m.alias("m"))),
               lambda z: z["m"])).alias("z"))
           .select(*keys, F.col("z.a.f").alias(frame), "z.a.w._row.*"))
    return out.select(*df.columns)


def unordered_pair(a: str, b: str) -> Column:
    return F.concat_ws("-", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))
