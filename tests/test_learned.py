"""Grouped logistic fits: the optimum, stored coefficients, folds and reports."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from contactflow.operators import learned as ML

FEATURES = ["a", "b"]


def rows(n=400, seed=5):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 2)) * [2.0, 0.5] + [1.0, -3.0]
    y = (r.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 1) + 2 * (x[:, 1] + 3)))).astype(int)
    return [(int(k % 4), float(u), float(v), int(t)) for k, ((u, v), t) in enumerate(zip(x, y))]


def slope(data, table, balance):
    """Gradient of the penalised loss at a coefficient table: zero at the optimum."""
    x, y = np.array([d[1:3] for d in data]), np.array([d[3] for d in data])
    z = np.column_stack([*[(x[:, i] - table[c].mean) / table[c].sd for i, c in enumerate(FEATURES)], np.ones(len(x))])
    w = np.array([table[c].weight for c in [*FEATURES, ""]])
    c = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if balance else np.ones(len(y))
    return z.T @ (c * (1 / (1 + np.exp(-z @ w)) - y)) / len(y) + 1e-3 * w


@pytest.mark.parametrize("balance", [False, True])
def test_every_key_reaches_its_optimum(spark, balance):
    data = rows()
    d = spark.createDataFrame(data, "fold int, a double, b double, y int").repartition(3)
    got = ML.grouped_logistic(ML.left_out(d, "fold", 4), ["held"], FEATURES, "y", balance=balance).collect()
    for held in range(4):
        table = {r.feature: r for r in got if r.held == held}
        mine = [v for v in data if v[0] != held]
        assert table["a"].mean == pytest.approx(np.mean([v[1] for v in mine])) and table[""].sd == 1.0
        assert np.abs(slope(mine, table, balance)).max() < 1e-8


def test_separable_and_single_class_keys_converge(spark):
    data = [(0, float(k), 0.0, int(k >= 5)) for k in range(10)] + [(1, float(k), 1.0, 1) for k in range(6)]
    d = spark.createDataFrame(data, "fold int, a double, b double, y int")
    got = ML.grouped_logistic(d, ["fold"], FEATURES, "y").collect()
    for g in (0, 1):
        assert np.abs(slope([v for v in data if v[0] == g], {r.feature: r for r in got if r.fold == g}, False)).max() < 1e-6


def test_stored_scorer_scores_unseen_rows(spark, tmp_path):
    data = rows()
    d = spark.createDataFrame(data, "fold int, a double, b double, y int")
    path = ML.store_scorer(ML.grouped_logistic(d.where("fold > 0").withColumn("model", F.lit("m")), ["model"], FEATURES, "y"), str(tmp_path / "scorer"))
    table = {r.feature: r for r in ML.load_scorer(spark, path).collect()}
    unseen = d.where("fold = 0").withColumn("model", F.lit("m"))
    for r in ML.apply_scorer(unseen, ML.load_scorer(spark, path), ["model"], FEATURES).collect():
        z = sum(table[c].weight * (r[c] - table[c].mean) / table[c].sd for c in FEATURES) + table[""].weight
        assert r.prob == pytest.approx(1 / (1 + np.exp(-z)))


def test_fold_report_has_a_mean_row(spark):
    data = [("s", 0, 1, 0.9), ("s", 0, 0, 0.8), ("s", 0, 0, 0.1), ("s", 1, 1, 0.2), ("s", 1, 0, 0.1)]
    got = {r.fold: r for r in ML.fold_report(spark.createDataFrame(data, "k string, f int, y int, p double"), ["k"], "f", "y", "p").collect()}
    assert (got["0"].n, got["0"].precision, got["0"].recall, got["0"].auc) == (3, 0.5, 1.0, 1.0) and got["0"].accuracy == pytest.approx(2 / 3)
    assert (got["1"].n, got["1"].recall, got["1"].auc) == (2, 0.0, 1.0)
    assert got["mean"].n == 5 and got["mean"].precision == 0.25 and got["mean"].auc == 1.0
