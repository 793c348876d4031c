"""Searches over many trials against whole-list brute force."""
import random

import numpy as np
import pytest

from contactflow.operators import search as SE

FEATURES = ["a", "b", "c"]


def fixture(seed=3):
    r = random.Random(seed)
    rows = [(r.randrange(3), r.randrange(400), i, round(r.random(), 1), r.random(), float(r.randrange(3))) for i in range(220)]
    truth = sorted({(r.randrange(3), r.randrange(400)) for _ in range(90)})
    return rows, truth


def brute_search(rows, truth, score, trials, cuts, cooldowns, tol):
    out = {}
    for t in range(trials):
        s = {i: score(t, x) for _, _, i, *x in rows}
        for c, cut in enumerate(cuts[t]):
            for cd in cooldowns:
                tp = n = 0
                for k in {x[0] for x in rows}:
                    kept = []
                    for f, i in sorted(((f, i) for kk, f, i, *_ in rows if kk == k and s[i] >= cut), key=lambda v: (-s[v[1]], v[0], v[1])):
                        if all(abs(f - g) >= cd for g in kept):
                            kept.append(f)
                    n += len(kept)
                    used = set()
                    for _, f, g in sorted((abs(f - g), f, g) for f in kept for kk, g in truth if kk == k and abs(f - g) <= tol):
                        if ("d", f) not in used and ("g", g) not in used:
                            used |= {("d", f), ("g", g)}
                            tp += 1
                out[t, c, cd] = (tp, n - tp, len(truth) - tp)
    return out


@pytest.mark.parametrize("long", [SE.LONG, 5])
@pytest.mark.parametrize("kind", ["weights", "votes"])
def test_search_equals_brute_force(spark, kind, long):
    rows, truth = fixture()
    d = spark.createDataFrame(rows, "k int, frame int, id int, a double, b double, c double").repartition(3)
    g = spark.createDataFrame(truth, "k int, frame int")
    n, cooldowns = 6, [3, 9]
    if kind == "weights":
        w = np.random.default_rng(1).random((n, 3))
        scorer, score = SE.linear_scorer(w), lambda t, x: w[t, 0] * x[0] + w[t, 1] * x[1] + w[t, 2] * x[2]
        cuts = SE.score_cuts(d, FEATURES, scorer, n, [0.1, 0.5])
        for t in range(n):
            scs = sorted(s for s in (score(t, x[3:]) for x in rows) if s > 0)
            assert cuts[t].tolist() == [scs[int(len(scs) * (1 - p))] for p in (0.1, 0.5)]
    else:
        least = np.random.default_rng(2).random((n, 3))
        scorer, score = SE.vote_scorer(least, np.full((n, 3), 2.0)), lambda t, x: sum(least[t, k] <= x[k] <= 2 for k in range(3))
        cuts = np.tile([1.0, 2.0], (n, 1))
    got = SE.search_trials(d, g, ["k"], frame="frame", tie="id", features=FEATURES, scorer=scorer, trials=n, cuts=cuts, cooldowns=cooldowns, tol=4, long=long)
    want = brute_search(rows, truth, score, n, cuts, cooldowns, 4)
    assert {(r.trial, r.cut, r.cd): (r.tp, r.fp, r.fn) for r in got.collect()} == want


def test_cuts_without_positive_scores(spark):
    d = spark.createDataFrame([(0.0,), (-1.0,)], "a double")
    assert SE.score_cuts(d, ["a"], SE.linear_scorer(np.ones((2, 1))), 2, [0.5]).tolist() == [[np.inf], [np.inf]]


@pytest.mark.parametrize("small", [False, True])
def test_bits_decide_like_rows(monkeypatch, small):
    """all trials of some runs at once, 64 to a word, in pieces of any size; runs end where tasks cut them."""
    if small:
        monkeypatch.setattr(SE, "CELLS", 300)
        monkeypatch.setattr(SE, "WORDS", 1)
    monkeypatch.setattr(SE, "TOGETHER", 40)
    rows, truth = fixture(5)
    n, cooldowns = 150, [3, 9, 6]
    w = np.random.default_rng(4).random((n, 3)).round(1)  # many equal scores
    scores = {x[2]: sum(w[:, k] * x[3 + k] for k in range(3)) for x in rows}
    cuts = np.quantile(np.array(list(scores.values())), [0.8, 0.5], axis=0, method="lower").T
    cuts[7] = np.inf  # no row is there
    lines = sorted([(k, f, False, i, *x) for k, f, i, *x in rows] + [(k, f, True, -1, None, None, None) for k, f in truth])
    frame = SE.pd.DataFrame(lines, columns=["k", "f", "g", "id", *FEATURES])
    got = np.zeros((n, 2, 2, 3), dtype=np.int64)
    blocks = list(SE._blocks(iter([frame[:100], frame[100:100], frame[100:]]), ["k"]))
    assert sum(len(b) for b, _ in blocks) == len(lines) and all(b["k"].nunique() == number.max() + 1 for b, number in blocks)
    for b, number in blocks:
        g, f = b["g"].to_numpy(dtype=bool), b["f"].to_numpy()
        got += SE._counts(f[~g], number[~g], b.loc[~g, FEATURES].to_numpy(dtype=float), f[g], number[g], SE.linear_scorer(w), n, cuts, cooldowns, 4)
    want = brute_search(rows, truth, lambda t, x: w[t, 0] * x[0] + w[t, 1] * x[1] + w[t, 2] * x[2], n, cuts, cooldowns, 4)
    assert {(t, c, cd): tuple(got[t, :, c, k].tolist()) for t in range(n) for c in range(2) for k, cd in enumerate(cooldowns)} == {key: (tp, tp + fp) for key, (tp, fp, _) in want.items()}


def test_runs_go_to_tasks_once(spark):
    """rows and truths were copied for every 250 trials, and bytes told how many tasks decide them."""
    rows, truth = fixture()
    d = spark.createDataFrame(rows, "k int, frame int, id int, a double, b double, c double")
    g = spark.createDataFrame(truth, "k int, frame int")
    w = np.random.default_rng(1).random((600, 3))
    out = SE.search_trials(d, g, ["k"], frame="frame", tie="id", features=FEATURES, scorer=SE.linear_scorer(w), trials=600, cuts=np.full((600, 1), 0.5), cooldowns=[3], tol=4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "RepartitionByExpression [k" in plan
    assert out.count() == 600


@pytest.mark.parametrize("odd", [None, float("inf"), float("nan"), 1e-15])
def test_cuts_hold_where_products_differ(spark, odd):
    """F1: cuts are scores summed term by term, also next to equal ones, tiny ones and values that no product bounds."""
    r = np.random.default_rng(8)
    x = r.random((900, 3)) * (r.random((900, 3)) < 0.4)
    x[:200, 0], x[100:300, 1:], x[300:400] = 1.0, 0.0, [0.3, 0.1, 0.2]
    x[400:500] = 1e-15 * r.random((100, 3))
    lines = [[float(v) for v in line] for line in x] + [[odd, 0.5, 0.5]] * 3
    d = spark.createDataFrame(lines, "a double, b double, c double").repartition(2)
    w, top = r.random((7, 3)).round(2), [0.01, 0.3, 0.6, 0.999]
    w[5] = [0.1, 0.2, 0.3]
    w[6] = 0.0
    full = np.array(lines, dtype=float)
    with np.errstate(invalid="ignore"):
        s = w[:, 0, None] * full[:, 0] + w[:, 1, None] * full[:, 1] + w[:, 2, None] * full[:, 2]
    want = [[sorted(v[v > 0])[int((v > 0).sum() * (1 - p))] if (v > 0).any() else np.inf for p in top] for v in s]
    for guess, few in ((50, 2), (50, 300), (10_000, 2)):
        assert SE.score_cuts(d, FEATURES, SE.linear_scorer(w), 7, top, guess=guess, few=few).tolist() == want
