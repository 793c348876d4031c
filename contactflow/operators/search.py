"""Parameter grids and sweeps."""
from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import suppress
from itertools import chain, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactflow.operators.ordering import islands
from contactflow.session import cut_lineage


def with_grid(df: DataFrame, grid: Mapping[str, Sequence]) -> DataFrame:
    """Each row once per parameter combination.

    The combinations live in the plan as an array literal, so the expansion is a
    narrow explode: nothing is joined or broadcast.
    """
    names = list(grid)
    combos = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, c)])
                       for c in product(*grid.values())])
    out = df.withColumn("_g", F.explode(combos))
    for n in names:
        out = out.withColumn(n, F.col(f"_g.{n}"))
    return out.drop("_g")


def threshold_sweep(cands: DataFrame, truth: DataFrame, keys: Sequence[str], *, frame: str, score: str,
                    tie: str, thresholds: Sequence[float], cooldowns: Sequence[int], tol: int) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 for every (cooldown, threshold) with a detection.

    Score-greedy suppression runs once per cooldown: a row is only ever
    suppressed by a higher score, so suppressing and thresholding commute.
    """
    from contactflow.operators.matching import match, with_prf
    from contactflow.operators.suppress import greedy_nms

    keys = list(keys)
    kept = None
    for cd in cooldowns:
        k = greedy_nms(cands, keys, frame, score, cd, tie=tie).withColumn("cd", F.lit(cd))
        kept = k if kept is None else kept.unionByName(k)
    thr = F.array(*[F.lit(float(t)) for t in thresholds])
    d = kept.withColumn("thr", F.explode(F.filter(thr, lambda t: t <= F.col(score))))
    return score_configs(d, truth, keys, ["cd", "thr"], frame, tol,
                         {"cd": list(cooldowns), "thr": [float(t) for t in thresholds]})


def score_configs(detections: DataFrame, truth: DataFrame, keys: Sequence[str], config: Sequence[str],
                  frame: str, tol: int, grid: Mapping[str, Sequence]) -> DataFrame:
    """Closest-pair matching of every configuration's detections, summed over recordings."""
    from contactflow.operators.matching import match, with_prf

    keys, config = list(keys), list(config)
    t = truth.select(*keys, frame).distinct()
    m = match(detections, t, keys, tol, "closest_pair", frame=frame, config=config)
    c = m.groupBy(*config).agg(F.count("gt_frame").alias("tp"), F.count(F.lit(1)).alias("n_det"))
    n = with_grid(t.agg(F.count(F.lit(1)).alias("n_gt")).where("n_gt > 0"), grid)
    c = c.join(n, config)
    return with_prf(c.select(*config, "tp", (F.col("n_det") - F.col("tp")).alias("fp"),
                             (F.col("n_gt") - F.col("tp")).alias("fn")))


def best_config(table: DataFrame, config: Sequence[str]) -> DataFrame:
    """Highest F1; the first configuration wins ties."""
    rest = [c for c in table.columns if c not in ("f1", *config)]
    b = table.agg(F.min(F.struct((-F.col("f1")).alias("nf"), *config, *rest)).alias("b"))
    return b.select(*[F.col(f"b.{c}").alias(c) for c in config], *[F.col(f"b.{c}").alias(c) for c in rest],
                    (-F.col("b.nf")).alias("f1"))


def constrained_best(table: DataFrame, config: Sequence[str], floor: float, fallback: float) -> DataFrame:
    """Precision at least ``floor``: most recall, then F1. Else precision at least
    ``fallback``: best F1. Else best F1 overall."""
    tier = F.when(F.col("precision") >= floor, 0).when(F.col("precision") >= fallback, 1).otherwise(2)
    first = F.when(tier == 0, -F.col("recall")).otherwise(-F.col("f1"))
    b = table.agg(F.min(F.struct(tier.alias("tier"), first.alias("_a"), (-F.col("f1")).alias("_b"), *config,
                                 "precision", "recall", "f1")).alias("b"))
    return b.select(*[f"b.{c}" for c in (*config, "tier", "precision", "recall", "f1")])


# ---------------------------------------------------------------- searches over many trials

#: Scores of rows under trials lo..hi: (features n x f, lo, hi) -> n x (hi - lo), a new array. Summed term by term, so SQL gives the same digits.
Scorer = Callable[[np.ndarray, int, int], np.ndarray]
CELLS, LONG = 64_000, 4_000  # scores held at a time, which a processor's cache takes; rows of a run that one task still takes
CHUNK, TOGETHER, WORDS = 25, 500, 1 << 23  # trials of a row of sums; rows decided together; words of 64 trials held for them
#: Rows that guess where a cut lies; places around it that are counted; scores between two such places that are then compared.
GUESS, PLACES, FEW = 100_000, 96, 4_000
#: Rows that are scored together; their numbers fit the last bits of a score, which then is known but for one part in 2^37.
NUMBERED = 1 << 14


def linear_scorer(weights: np.ndarray) -> Scorer:
    by_term = np.ascontiguousarray(weights.T)

    def scores(x: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Line by line along the longer side, which lies together in memory."""
        lines, terms = (weights[lo:hi], np.ascontiguousarray(x.T)) if len(x) > hi - lo else (x, by_term[:, lo:hi])
        out, term = np.empty((len(lines), terms.shape[1])), np.empty(terms.shape[1])
        for own, line in zip(out, lines.tolist()):
            np.multiply(terms[0], line[0], out=own)
            for v, each in zip(line[1:], terms[1:]):
                if v != 0:  # adds nothing
                    np.multiply(each, v, out=term)
                    np.add(own, term, out=own)
        return out.T if len(x) > hi - lo else out
    scores.weights = weights
    return scores


def vote_scorer(least: np.ndarray, most: np.ndarray) -> Scorer:
    """One vote for each feature within [least, most] of its trial."""
    def scores(x: np.ndarray, lo: int, hi: int) -> np.ndarray:
        out = np.zeros((len(x), hi - lo))
        for k in range(least.shape[1]):
            out += (x[:, k, None] >= least[None, lo:hi, k]) & (x[:, k, None] <= most[None, lo:hi, k])
        return out
    return scores


def _keep_freed() -> None:
    """Lets the C library keep up to 256 MB of freed arrays for the next ones, whose pages would else be made anew. No matter where it has no such setting."""
    with suppress(AttributeError, OSError):
        adjust = ctypes.CDLL(None).mallopt
        adjust(-3, 32 << 20)  # M_MMAP_THRESHOLD
        adjust(-1, 256 << 20)  # M_TRIM_THRESHOLD


def _chunks(values: np.ndarray) -> pd.DataFrame:
    """A row of bytes for each CHUNK trials of whole numbers by trial."""
    at = range(0, len(values), CHUNK)
    return pd.DataFrame({"at": at, "v": [values[lo:lo + CHUNK].tobytes() for lo in at]})


def _added(part: pd.DataFrame) -> pd.DataFrame:
    """The sum of all tasks' rows of a chunk."""
    total = np.zeros(len(part["v"].iloc[0]) // 8, dtype=np.int64)
    for v in part["v"]:
        total += np.frombuffer(v, dtype=np.int64)
    return pd.DataFrame({"at": part["at"].iloc[:1], "v": [total.tobytes()]})


def score_cuts(rows: DataFrame, features: Sequence[str], scorer: Scorer, trials: int, top: Sequence[float], *, guess: int = GUESS, few: int = FEW) -> np.ndarray:
    """(trials x shares): the score at place floor(n * (1 - share)) among a trial's n positive scores, in ascending order.

    Exact selection: a few rows say about where each cut lies, a pass over all rows counts the scores below places around it,
    further passes divide what is left until at most ``few`` scores (or equal ones) lie between two places, and a last pass selects among these. A bad guess costs
    passes, never the result. Linear scores are matrix products first, whose last digits may be others: places are held apart by their error, positive scores and
    those of the last pass are taken term by term. Tasks count in arrays of one size, emitted once, however many rows they read, and tasks add them; the driver
    holds places of trials and shares, and does the passes itself where the few rows are all rows."""
    features, top = list(features), list(top)
    rows = rows.select(*[F.col(c).cast("double").alias(c) for c in features])
    shape = (trials, len(top))
    n, *most = rows.agg(F.count(F.lit(1)), *[F.max(F.when(F.col(c).isNull(), F.lit(float("nan"))).otherwise(F.abs(c))) for c in features]).first()
    weights = getattr(scorer, "weights", None)
    reach = np.inf if weights is None or not n else float(np.abs(weights).max(axis=0) @ np.array(most))  # no score is larger
    rough = bool(np.isfinite(reach))
    error = 4 * len(features) * 2.0 ** -53 * reach + 1e-300 if rough else 0.0
    blur = error + 2.0 ** -37 * reach if rough else 0.0

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        rest = np.zeros((0, len(features)))
        for frame in frames:
            x = frame[features].to_numpy(dtype=float)
            rest = np.concatenate([rest, x[x.any(axis=1)] if rough else x])  # a row of zeros has no positive score
            while len(rest) >= NUMBERED:
                yield rest[:NUMBERED]
                rest = rest[NUMBERED:]
        if len(rest):
            yield rest

    def lines(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first trial, scores of some trials by row), within ``error`` of the scores."""
        across = np.ascontiguousarray(x.T)
        step = max(1, CELLS // len(x))
        for lo in range(0, trials, step):
            yield lo, weights[lo:lo + step] @ across if rough else np.fmax(scorer(x, lo, min(trials, lo + step)).T, 0.0)

    drawn = (rows if n <= guess else rows.sample(guess / n, seed=0)).toPandas()  # about ``guess`` rows

    def passed(of: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], kind: str, then: Callable[[pd.DataFrame], pd.DataFrame], to: str) -> Iterator:
        """What ``then`` makes of the rows that ``of`` gives for each CHUNK trials."""
        if n > guess:
            return iter(rows.mapInPandas(of, kind).groupBy("at").applyInPandas(then, to).collect())
        return (r for _, part in pd.concat(of(iter([drawn]))).groupby("at") for r in then(part).to_dict("records"))

    places = np.full((*shape, PLACES), np.inf)
    sampled = [*blocks(iter([drawn]))]
    if sampled:
        for lo, s in lines(np.concatenate(sampled)):
            s.sort(axis=1)
            for t, own in enumerate(s, lo):
                own = own[np.searchsorted(own, error, side="right"):]
                for c, p in enumerate(top if len(own) else ()):
                    far = 5 * np.sqrt(len(own) * p * (1 - p)) + 2
                    near = own[np.clip(np.linspace(-far, far, PLACES // 2) + int(len(own) * (1 - p)), 0, len(own) - 1).astype(np.int64)]
                    apart = np.maximum(2 * error, np.spacing(near))
                    places[t, c] = np.sort(np.concatenate([near - apart, near + apart]))  # equal scores are found at once
    low, high = np.zeros(shape), np.full(shape, np.inf)
    under = np.zeros(shape, dtype=np.int64)  # products below low
    inside = rank = None
    while True:
        flat = np.concatenate([np.tile([-error, np.nextafter(error, 1.0)], (trials, 1)), places.reshape(trials, -1)], axis=1)

        def counts(frames: Iterator[pd.DataFrame], flat=flat) -> Iterator[pd.DataFrame]:
            _keep_freed()
            total = np.zeros((trials, 2 + flat.shape[1]), dtype=np.int64)  # rows, positive scores, scores below places
            for x in blocks(frames):
                for lo, s in lines(x):
                    s.sort(axis=1)
                    for t, own in enumerate(s, lo):
                        n = np.searchsorted(own, flat[t])
                        total[t, 0] += len(own)
                        total[t, 1] += len(own) - n[1] if n[0] == n[1] or not rough else (scorer(x, t, t + 1) > 0).sum()
                        total[t, 2:] += n
            yield _chunks(total)

        total = np.zeros((trials, 2 + flat.shape[1]), dtype=np.int64)
        for r in passed(counts, "at int, v binary", _added, "at int, v binary"):  # a row for each CHUNK trials
            total[r["at"]:r["at"] + CHUNK] = np.frombuffer(r["v"], dtype=np.int64).reshape(-1, total.shape[1])
        if rank is None:
            rank = np.array([[a - m + int(m * (1 - p)) if m else -1 for p in top] for a, m in total[:, :2].tolist()], dtype=np.int64).reshape(shape)
            inside = np.repeat(total[:, :1], len(top), axis=1)
        there = total[:, 4:].reshape(places.shape)
        for t, c in np.ndindex(shape):
            k = int(np.searchsorted(there[t, c], rank[t, c], side="right"))  # places with no more than rank scores below
            above = under[t, c] + inside[t, c]
            if k and places[t, c, k - 1] > low[t, c]:
                low[t, c], under[t, c] = places[t, c, k - 1], there[t, c, k - 1]
            if k < places.shape[2] and places[t, c, k] < high[t, c]:
                high[t, c], above = places[t, c, k], there[t, c, k]
            inside[t, c] = above - under[t, c]
        first, last = low.view(np.int64), high.view(np.int64)  # bits order like positive numbers
        wide = (rank >= 0) & (inside > few) & (high - low > 8 * error) & (last - first > PLACES)
        if not wide.any():
            break
        step = (last - first) // PLACES + 1
        places = np.where(wide[..., None], np.minimum(first[..., None] + 1 + step[..., None] * np.arange(PLACES), last[..., None]).view(np.float64), np.inf)
    begin, stop = np.where(rank >= 0, low - error - blur, np.inf), np.where(rank >= 0, high + error + blur, np.inf)

    def between(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Scores below ``begin``, and each score from it to ``stop`` with its number, by trial and share."""
        _keep_freed()
        below, got = np.zeros(shape, dtype=np.int64), []
        for x in blocks(frames):
            for lo, s in lines(x):
                if rough:
                    bits = s.view(np.int64)
                    bits &= ~(NUMBERED - 1)
                    bits |= np.arange(len(x))
                s.sort(axis=1)
                a = np.array([np.searchsorted(own, v) for own, v in zip(s, begin[lo:])])
                n = np.array([np.searchsorted(own, v, side="right") for own, v in zip(s, stop[lo:])]) - a
                below[lo:lo + len(s)] += a
                n = n.ravel()
                where = np.repeat(np.arange(len(n)), n)
                t = where // len(top)
                v = s[t, np.arange(len(where)) - np.repeat(np.cumsum(n) - n - a.ravel(), n)]
                if rough:
                    line = x[v.view(np.int64) & (NUMBERED - 1)]
                    v = weights[lo + t, 0] * line[:, 0]
                    for k in range(1, len(features)):
                        v += weights[lo + t, k] * line[:, k]
                got.append(_told(where + lo * len(top), v, np.ones(len(v), dtype=np.int64)))
        where, v, n = _told(*(np.concatenate(v) for v in zip(*got))) if got else (np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64))
        for lo in range(0, trials, CHUNK):
            own = slice(*np.searchsorted(where, [lo * len(top), (lo + CHUNK) * len(top)]))
            yield pd.DataFrame({"at": [lo], "below": [below[lo:lo + CHUNK].tobytes()], "place": [where[own].tobytes()], "v": [v[own].tobytes()], "n": [n[own].tobytes()]})

    def select(part: pd.DataFrame) -> pd.DataFrame:
        lo, joined = int(part["at"].iloc[0]), lambda c, kind: np.frombuffer(b"".join(part[c]), dtype=kind)
        below = joined("below", np.int64).reshape(len(part), -1).sum(axis=0)
        where, v, n = _told(joined("place", np.int64), joined("v", np.float64), joined("n", np.int64))
        out, upto = [], np.cumsum(n)
        for k, less in enumerate(below.tolist(), lo * len(top)):
            a, b = np.searchsorted(where, [k, k + 1])
            if a < b:
                at = int(np.searchsorted(upto[a:b] - upto[a] + n[a], rank[divmod(k, len(top))] - less, side="right"))
                assert rank[divmod(k, len(top))] >= less and a + at < b
                out.append((k, v[a + at]))
        return pd.DataFrame(out, columns=["k", "v"]).astype({"k": "int64", "v": "float64"})

    found = np.full(trials * len(top), np.inf)
    for r in passed(between, "at int, below binary, place binary, v binary, n binary", select, "k long, v double"):  # a row for each trial and share
        found[r["k"]] = r["v"]
    return found.reshape(shape)


def _told(where: np.ndarray, v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, value, number) in order, equal ones added up."""
    order = np.lexsort((v, where))
    where, v, n = where[order], v[order], n[order]
    start = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (v[1:] != v[:-1])][:len(v)])
    return where[start], v[start], np.add.reduceat(n, start) if len(start) else n


def _words(flags: np.ndarray) -> np.ndarray:
    """Rows of flags by trial as words of 64 trials."""
    return np.packbits(flags, axis=1, bitorder="little").view(np.uint64)


def _sums(bits: np.ndarray) -> np.ndarray:
    """How many rows have each bit: rows x ... x words -> ... x (64 trials a word). Three rows of a digit make one of it and one of the next."""
    total = np.zeros((*bits.shape[1:-1], 64 * bits.shape[-1]), dtype=np.int64)
    digit = 0
    while len(bits):
        carried = []
        while len(bits) > 2:
            n = len(bits) // 3
            a, b, c = bits[:n], bits[n:2 * n], bits[2 * n:3 * n]
            one, two = a ^ b, a & b
            left = np.empty((len(bits) - 2 * n, *bits.shape[1:]), dtype=np.uint64)
            np.bitwise_xor(one, c, out=left[:n])
            left[n:] = bits[3 * n:]
            one &= c
            two |= one
            carried.append(two)
            bits = left
        if len(bits) == 2:
            carried.append(bits[:1] & bits[1:])
            bits = bits[:1] ^ bits[1:]
        total += np.unpackbits(np.ascontiguousarray(bits[0]).view(np.uint8), axis=-1, bitorder="little").astype(np.int64) << digit
        bits = np.concatenate(carried) if carried else bits[:0]
        digit += 1
    return total


def _kept(i: np.ndarray, j: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Score-greedy suppression of n rows, all trials at once. i < j: rows (in tie order) closer than the cooldown; first: the bits of the trials where i wins."""
    out = np.full((n, first.shape[1]), ~np.uint64(0))
    if not len(i):
        return out
    loser, winner = np.concatenate([j, i]), np.concatenate([i, j])
    order = np.argsort(loser, kind="stable")
    loser, beats = loser[order], np.concatenate([first, ~first])[order]
    starts = np.flatnonzero(np.r_[True, loser[1:] != loser[:-1]])
    nodes = loser[starts]
    winner = np.searchsorted(nodes, winner[order])
    gone = np.zeros((len(nodes), first.shape[1]), dtype=np.uint64)
    while True:
        kept = ~(np.bitwise_or.reduceat(beats & ~gone[winner], starts) | gone)
        new = np.bitwise_or.reduceat(beats & kept[winner], starts) & ~gone
        if not new.any():
            out[nodes] = kept
            return out
        gone |= new


def _close(frames: np.ndarray, run: np.ndarray, other: np.ndarray, other_run: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in frames, place in other) of one run at most ``reach`` frames apart; both sides ordered by run and frame."""
    far = 4 * reach + 4 + int(max(frames.max(initial=0), other.max(initial=0)) - min(frames.min(initial=0), other.min(initial=0)))
    a, b = frames + run * far, other + other_run * far
    lo, hi = np.searchsorted(b, a - reach), np.searchsorted(b, a + reach, side="right")
    left = np.repeat(np.arange(len(a)), hi - lo)
    return left, np.arange(len(left)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)


def _compared(run: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, scorer: Scorer, lo: int, hi: int, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x cuts x words: scores of at least the cut, pairs x words: row i has at least the score of row j), for trials lo..hi.

    Runs are scored some at a time. A row below all cuts is only compared with rows like it, which it may beat: others beat it."""
    words = -(-(hi - lo) // 64)
    there = np.zeros((len(x), cuts.shape[1], words), dtype=np.uint64)
    first = np.zeros((len(i), words), dtype=np.uint64)
    limits, least = np.ascontiguousarray(cuts.T), cuts.min(axis=1)
    unknown = np.isnan(x).any()  # such a score is below no cut and beats earlier rows
    ends = np.r_[np.flatnonzero(run[1:] != run[:-1]) + 1, len(run)]
    a = 0
    while a < len(x):
        b = int(ends[max(np.searchsorted(ends, a, side="right"), np.searchsorted(ends, a + CELLS // (hi - lo), side="right") - 1)])
        pairs = np.arange(*np.searchsorted(i, [a, b]))
        step = max(1024, CELLS // (b - a) // 64 * 64)
        for p in range(lo, hi, step):
            q = min(hi, p + step)
            at = slice((p - lo) // 64, -(-(q - lo) // 64))
            s = np.ascontiguousarray(scorer(x[a:b], p, q))
            own = np.ones(b - a, dtype=bool) if unknown else (s >= least[p:q]).any(axis=1)
            rows = np.flatnonzero(own)
            some = s if len(rows) == len(s) else s[rows]
            flags = np.zeros((len(rows), 64 * (at.stop - at.start)), dtype=bool)
            for c, limit in enumerate(limits):
                np.greater_equal(some, limit[p:q], out=flags[:, :q - p])
                there[a + rows, c, at] = _words(flags)
            left, right = own[i[pairs] - a], own[j[pairs] - a]
            first[pairs[left & ~right], at] = ~np.uint64(0)
            pairs_here = pairs[left & right]
            much = max(1, CELLS // (q - p))
            for o in range(0, len(pairs_here), much):
                e = pairs_here[o:o + much]
                flags = np.zeros((len(e), 64 * (at.stop - at.start)), dtype=bool)
                np.greater_equal(s[i[e] - a], s[j[e] - a], out=flags[:, :q - p])
                first[e, at] = _words(flags)
        a = b
    return there, first


def _counts(frames, run, x, gt, gt_run, scorer: Scorer, trials: int, cuts: np.ndarray, cooldowns: Sequence[int], tol: int) -> np.ndarray:
    """By trial: (matched, kept) by cut and cooldown for the rows of some runs. A bit stands for a trial, so a step on words decides 64 of them."""
    i, j = _close(frames, run, frames, run, max(cooldowns) - 1)
    i, j = i[i < j], j[i < j]
    det, truth = _close(frames, run, gt, gt_run, tol)
    rank = np.lexsort((gt[truth], frames[det], np.abs(frames[det] - gt[truth]), run[det]))
    det, truth = det[rank], truth[rank]
    start = np.flatnonzero(np.r_[True, run[det][1:] != run[det][:-1]]) if len(det) else np.zeros(0, dtype=np.int64)
    turn = np.arange(len(det)) - np.repeat(start, np.diff(np.r_[start, len(det)]))
    order = np.argsort(turn, kind="stable")
    det, truth, turn = det[order], truth[order], turn[order]
    met, truth = np.unique(truth, return_inverse=True)
    turns = np.split(np.arange(len(det)), np.flatnonzero(turn[1:] != turn[:-1]) + 1)  # the r-th closest pair of every run
    out = np.zeros((2, len(cooldowns), cuts.shape[1], trials), dtype=np.int64)
    width = 64 * max(1, WORDS // max(1, 6 * len(i) + (3 * len(frames) + 2 * len(met)) * cuts.shape[1] * len(cooldowns)))
    for lo in range(0, trials, width):
        hi = min(trials, lo + width)
        there, first = _compared(run, x, i, j, scorer, lo, hi, cuts)
        live = there.any(axis=(1, 2)) | np.isnan(x).any(axis=1)  # a row below all cuts suppresses only its like
        near = np.flatnonzero(live[i] & live[j])
        bound, ends = np.unique(np.concatenate([i[near], j[near]]), return_inverse=True)  # rows with others close
        u, v = ends[:len(near)], ends[len(near):]
        gap = frames[j[near]] - frames[i[near]]
        first = first[near]
        stay = np.stack([_kept(u[gap < cd], v[gap < cd], first[gap < cd], len(bound)) for cd in cooldowns], axis=1)
        alone = live.copy()
        alone[bound] = False
        kept = stay[:, :, None] & there[bound][:, None]
        n = _sums(there[alone])[None] + _sums(kept)
        place = np.full(len(frames), -1)
        place[bound] = np.arange(len(bound))
        paired = np.unique(det)
        free = np.repeat(there[paired][:, None], len(cooldowns), axis=1)
        held = np.flatnonzero(place[paired] >= 0)
        free[held] = kept[place[paired[held]]]
        at = np.searchsorted(paired, det)
        taken = np.zeros((len(met), *free.shape[1:]), dtype=np.uint64)
        for own in turns:
            d, g = at[own], truth[own]
            hit, was = free[d], taken[g]
            hit &= ~was
            free[d] ^= hit
            was |= hit
            taken[g] = was
        out[0, ..., lo:hi], out[1, ..., lo:hi] = _sums(taken)[..., :hi - lo], n[..., :hi - lo]
    return out.transpose(3, 0, 2, 1)


def _blocks(frames: Iterator[pd.DataFrame], of: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Whole runs, about TOGETHER rows at a time, each row with the number of its run. ``of`` names the columns that tell runs apart; rows come in their order."""
    rest = None
    for frame in chain(frames, [None]):
        rows = rest if frame is None else frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if rows is None or not len(rows):
            continue
        new = np.arange(len(rows)) == 0
        for c in of:
            new |= ((rows[c] != rows[c].shift()) & ~(rows[c].isna() & rows[c].shift().isna())).to_numpy()
        starts = np.flatnonzero(new)
        end = len(rows) if frame is None else int(starts[-1])  # the last run may go on
        number = np.cumsum(new)
        stops = np.append(starts[starts <= end], end)
        at = 0
        while at < end:
            stop = int(stops[np.searchsorted(stops, min(end, at + TOGETHER))])
            yield rows.iloc[at:stop], number[at:stop] - number[at]
            at = stop
        rest = rows.iloc[end:]


def search_trials(rows: DataFrame, truth: DataFrame, keys: Sequence[str], *, frame: str, tie: str, features: Sequence[str], scorer: Scorer, trials: int,
                  cuts: np.ndarray, cooldowns: Sequence[int], tol: int, long: int = LONG) -> DataFrame:
    """(trial, cut, cd, tp, fp, fn, precision, recall, f1) of every trial, cut (by number) and cooldown.

    Rows score by trial, those of at least the cut stay, score-greedy suppression and closest-pair matching follow. Rows and truths that
    are further apart than cooldown and tolerance never meet, so a recording falls into runs. A task takes some runs and all
    trials: which rows are close and the order of pairs are the same for all trials, so these decide whole trial vectors at once.
    Runs of more than ``long`` rows take the operators keyed by trial, whose work no run gathers.
    """
    from contactflow.operators.matching import match, with_prf
    from contactflow.operators.suppress import greedy_nms

    spark, keys, features, cooldowns = rows.sparkSession, list(keys), list(features), list(cooldowns)
    xs = [f"_x{k}" for k in range(len(features))]
    dets = rows.select(*keys, F.col(frame).cast("long").alias("_f"), F.col(tie).alias("_t"), *[F.col(c).cast("double").alias(x) for c, x in zip(features, xs)], F.lit(False).alias("_truth"))
    truths = truth.select(*keys, F.col(frame).cast("long").alias("_f")).distinct().withColumn("_truth", F.lit(True))
    both = dets.unionByName(truths, allowMissingColumns=True)
    axis = cut_lineage(islands(both.select(*keys, "_f").distinct(), keys, "_f", max(*cooldowns, tol + 1), "_run"))
    both = cut_lineage(both.join(axis, [*keys, "_f"]))
    dets, truths = both.where(~F.col("_truth")), both.where("_truth").select(*keys, "_f", "_run")
    sizes = both.groupBy(*keys, "_run").agg(F.count_if(~F.col("_truth")).alias("_m"), F.count_if("_truth").alias("_g"))
    wide = cut_lineage(sizes.where((F.col("_m") > long) | (F.col("_g") > long)))
    big = wide.where(F.col("_m") > long).select(*keys, "_run")
    # no task takes a long run, or truths without rows
    each = both if wide.isEmpty() else both.join(sizes.where((F.col("_m") > long) | (F.col("_m") == 0)), [*keys, "_run"], "left_anti")
    # a number of tasks, as few bytes make much work
    each = each.repartition(4 * spark.sparkContext.defaultParallelism, *keys, "_run").sortWithinPartitions(*keys, "_run", "_f", "_t")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _keep_freed()
        total = None
        for block, number in _blocks(frames, [*keys, "_run"]):
            goal = block["_truth"].to_numpy(dtype=bool)
            if not goal.all():
                f = block["_f"].to_numpy(dtype=np.int64)
                own = _counts(f[~goal], number[~goal], block.loc[~goal, xs].to_numpy(dtype=float), f[goal], number[goal], scorer, trials, cuts, cooldowns, tol)
                total = own if total is None else total + own
        if total is not None:
            yield _chunks(total)

    def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame_ in frames:
            for lo, v in zip(frame_["at"], frame_["v"]):
                matched, n = np.frombuffer(v, dtype=np.int64).reshape(-1, 2, cuts.shape[1], len(cooldowns)).swapaxes(0, 1)
                t, c, k = np.indices(n.shape).reshape(3, -1)
                yield pd.DataFrame({"trial": lo + t, "cut": c, "cd": np.array(cooldowns)[k], "tp": matched.ravel(), "n": n.ravel()})

    out = each.mapInPandas(run, "at int, v binary").groupBy("at").applyInPandas(_added, "at int, v binary").mapInPandas(told, "trial int, cut int, cd int, tp long, n long")
    if not big.isEmpty():
        def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame_ in frames:
                x = frame_[xs].to_numpy(dtype=float)
                for t in range(trials):
                    s = scorer(x, t, t + 1)[:, 0]
                    own = s >= cuts[t].min()
                    yield frame_[own].drop(columns=xs).assign(trial=t, _s=s[own])

        kind = ", ".join(f"{c} {t}" for c, t in dets.select(*keys, "_run", "_f", "_t").dtypes)
        rest = dets.join(big, [*keys, "_run"]).select(*keys, "_run", "_f", "_t", *xs).mapInPandas(scored, kind + ", trial int, _s double")
        limits = spark.createDataFrame([(t, c, float(v)) for t, line in enumerate(cuts) for c, v in enumerate(line)], "trial int, cut int, _l double")
        grid = [*keys, "_run", "trial", "cd"]
        kept = None
        for cd in cooldowns:
            one = greedy_nms(rest, [*keys, "_run", "trial"], "_f", "_s", cd, tie="_t").withColumn("cd", F.lit(cd))
            kept = one if kept is None else kept.unionByName(one)
        kept = cut_lineage(kept.join(limits, "trial").where("_s >= _l").select(*grid, "cut", "_f"))
        goal = truths.join(big, [*keys, "_run"]).join(kept.select(*grid, "cut").distinct(), [*keys, "_run"])
        m = match(kept, goal, [*grid, "cut"], tol, "closest_pair", frame="_f")
        out = out.unionByName(m.groupBy("trial", "cut", "cd").agg(F.count("gt_frame").alias("tp"), F.count(F.lit(1)).alias("n")))
    n_gt = truths.count()
    out = out.groupBy("trial", "cut", "cd").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    return with_prf(out.select("trial", "cut", "cd", "tp", (F.col("n") - F.col("tp")).alias("fp"), (F.lit(n_gt) - F.col("tp")).alias("fn")))
