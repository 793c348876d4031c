"""Learned scorers: grouped logistic regressions with stored coefficients, boosted trees and out-of-fold scoring."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactflow.session import cut_lineage


def balanced(df: DataFrame, label: str, min_per_class: int = 3) -> DataFrame:
    """Adds class-balancing weights; refuses a class with too few rows."""
    n = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(n) < 2 or min(n.values()) < min_per_class:
        raise ValueError(f"need {min_per_class} rows per class, got {n}")
    total = sum(n.values())
    w = F.lit(0.0)
    for k, v in n.items():
        w = F.when(F.col(label) == k, total / (2.0 * v)).otherwise(w)
    return df.withColumn("_w", w)


def pipeline(kind: str, features: Sequence[str], label: str, **params) -> Pipeline:
    stages = [VectorAssembler(inputCols=list(features), outputCol="_x")]
    if kind == "logistic":
        stages += [StandardScaler(inputCol="_x", outputCol="_z", withMean=True),
                   LogisticRegression(featuresCol="_z", labelCol=label, weightCol="_w", **{"regParam": 1e-3, "maxIter": 50, **params})]
    elif kind == "boosted":
        stages += [GBTClassifier(featuresCol="_x", labelCol=label, weightCol="_w", seed=0,
                                 **{"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8, **params})]
    else:
        raise ValueError(kind)
    return Pipeline(stages=stages)


def fit(df: DataFrame, kind: str, features: Sequence[str], label: str, **params) -> PipelineModel:
    # iterative training reads its input many times: materialise the narrow table once
    data = cut_lineage(balanced(df.select(*features, F.col(label).cast("double").alias(label)), label))
    return pipeline(kind, features, label, **params).fit(data)


def score(model: PipelineModel, df: DataFrame, out: str = "prob") -> DataFrame:
    keep = df.columns
    s = model.transform(df).withColumn(out, vector_to_array("probability")[1])
    return s.select(*keep, out)


def out_of_fold(df: DataFrame, fold: str, folds: Sequence[int], kind: str, features: Sequence[str], label: str, **params) -> DataFrame:
    """Every row scored by the model that did not see its fold; folds are a short fixed list."""
    df = cut_lineage(df)
    out = None
    for f in folds:
        m = fit(df.where(F.col(fold) != f), kind, features, label, **params)
        s = score(m, df.where(F.col(fold) == f))
        out = s if out is None else out.unionByName(s)
    return out


def importances(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    """Feature weights, largest first (boosted importances or absolute coefficients)."""
    last = model.stages[-1]
    w = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    return sorted(((n, float(abs(v))) for n, v in zip(features, w.toArray())), key=lambda t: (-t[1], t[0]))


# ---------------------------------------------------------------- many logistic fits in one job

#: Added to a feature's deviation, so a constant feature scales to zero.
TINY = 1e-6


def grouped_logistic(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, *, l2: float = 1e-3, balance: bool = False,
                     passes: int = 60, tol: float = 1e-7) -> DataFrame:
    """Coefficients (keys, feature, mean, sd, weight) of a logistic regression for every key, all fitted by the same passes.

    Features are standardised within their key; the feature '' is the constant; the penalty is on all weights. Each pass is one
    aggregate (gradient, curvature and loss of every key, combined before its shuffle), so no key's rows meet in a task. The driver holds
    one small system for each key: keys are configurations such as (window length, held-out fold), not data. A step that does not
    lower the loss is halved. The optimum is unique, so any method gives these weights."""
    keys, features = list(keys), list(features)
    d = len(features) + 1
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label)).alias("_pos"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(features)],
                                  *[F.stddev_pop(c).alias(f"_s{i}") for i, c in enumerate(features)])
    stats = cut_lineage(stats)
    scaled = [(F.col(c) - F.col(f"_m{i}")) / (F.col(f"_s{i}") + TINY) for i, c in enumerate(features)]
    weight = F.when(F.col(label) == 1, F.col("_n") / (2.0 * F.col("_pos"))).otherwise(F.col("_n") / (2.0 * (F.col("_n") - F.col("_pos")))) if balance else F.lit(1.0)
    rows = cut_lineage(df.join(F.broadcast(stats), keys).select(*keys, F.array(*[c.cast("double") for c in scaled], F.lit(1.0)).alias("_x"), F.col(label).cast("double").alias("_y"), weight.alias("_c"), "_n"))
    groups = {tuple(r[k] for k in keys): r for r in stats.collect()}
    best = {g: (np.zeros(d), np.inf) for g in groups}
    asked = {g: np.zeros(d) for g in groups}
    kinds = [df.schema[k] for k in keys]
    names = [f.name for f in kinds]
    at = np.triu_indices(d)

    def sums(weights: dict[tuple, np.ndarray]):
        """Partial sums of a task for every key: loss, gradient and upper triangle of the curvature."""
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[tuple, np.ndarray] = {}
            for frame in frames:
                for g, part in frame.groupby(names):
                    if (w := weights.get(g)) is None:
                        continue
                    x, y, c = np.array(part["_x"].to_list()), part["_y"].to_numpy(), part["_c"].to_numpy()
                    z = x @ w
                    p = 1 / (1 + np.exp(-z))
                    loss = c * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z)
                    curve = (x * (c * p * (1 - p))[:, None]).T @ x
                    own = np.concatenate([[loss.sum()], x.T @ (c * (p - y)), curve[at]])
                    total[g] = total[g] + own if g in total else own
            if total:
                yield pd.DataFrame([(*g, v.tolist()) for g, v in total.items()], columns=[*names, "_v"])
        return run

    kind = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    size = 1 + d + len(at[0])
    for _ in range(passes):
        if not asked:
            break
        part = rows.select(*keys, "_x", "_y", "_c").mapInPandas(sums(asked), f"{kind}, _v array<double>")
        got = part.groupBy(*keys).agg(*[F.sum(F.get("_v", F.lit(i))).alias(f"_{i}") for i in range(size)])
        todo = {}
        for row in got.collect():  # a row for each key
            g = tuple(row[k] for k in keys)
            n, v = groups[g]["_n"], np.array([row[f"_{i}"] for i in range(size)])
            w = asked[g]
            value = v[0] / n + l2 / 2 * float(w @ w)
            if value > best[g][1] + 1e-12:
                todo[g] = (best[g][0] + w) / 2
                continue
            slope, curve = v[1:d + 1] / n + l2 * w, np.zeros((d, d))
            curve[at] = v[d + 1:] / n
            curve = curve + np.triu(curve, 1).T
            step = np.linalg.solve(curve + l2 * np.eye(d), slope)
            best[g] = (w, value)
            if np.abs(step).max() > tol:
                todo[g] = w - step
        asked = todo
    out = []
    for g, row in groups.items():
        w = best[g][0]
        out += [(*g, c, row[f"_m{i}"], row[f"_s{i}"] + TINY, float(w[i])) for i, c in enumerate(features)] + [(*g, "", 0.0, 1.0, float(w[-1]))]
    double = [T.StructField(c, T.DoubleType()) for c in ("mean", "sd", "weight")]
    return df.sparkSession.createDataFrame(out, T.StructType([*kinds, T.StructField("feature", T.StringType()), *double]))


def store_scorer(table: DataFrame, path: str) -> str:
    """Keeps a coefficient table; any session can score with it later."""
    table.coalesce(1).write.parquet(path)
    return path


def load_scorer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def apply_scorer(df: DataFrame, table: DataFrame, keys: Sequence[str], features: Sequence[str], out: str = "prob") -> DataFrame:
    """Scores rows by the coefficients of their key, by plain expressions; a row for each key is broadcast."""
    keys = list(keys)
    terms = {c: f"_k{i}" for i, c in enumerate([*features, ""])}
    wide = table.groupBy(*keys).agg(*[F.max(F.when(F.col("feature") == c, F.struct("mean", "sd", "weight"))).alias(n) for c, n in terms.items()])
    z = F.col(f"{terms['']}.weight")
    for c in features:
        z = z + F.col(f"{terms[c]}.weight") * (F.col(c) - F.col(f"{terms[c]}.mean")) / F.col(f"{terms[c]}.sd")
    return df.join(F.broadcast(wide), keys).withColumn(out, 1 / (1 + F.exp(-z))).select(*df.columns, out)


def left_out(df: DataFrame, fold: str, folds: int, out: str = "held") -> DataFrame:
    """Training rows: a copy of each row for every fold but its own, with that fold in ``out``."""
    return df.withColumn(out, F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col(fold))))


def fold_report(scored: DataFrame, keys: Sequence[str], fold: str, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """n, accuracy, precision, recall, F1 and AUC of every fold, and a row of their means with fold 'mean' (folds as text)."""
    from contactflow.operators.evaluate import confusion
    from contactflow.operators.matching import with_prf
    from contactflow.operators.ranking import roc_auc

    keys = list(keys)
    rows = cut_lineage(scored.select(*keys, F.col(fold).cast("string").alias("fold"), F.col(label).alias("_y"), F.col(score).alias("_s")))
    one = with_prf(confusion(rows, [*keys, "fold"], "_y", "_s", threshold))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    one = one.withColumn("n", n).withColumn("accuracy", (F.col("tp") + F.col("tn")) / n)
    one = one.join(roc_auc(rows, [*keys, "fold"], "_y", "_s").drop("n_pos", "n_neg"), [*keys, "fold"])
    names = ["accuracy", "precision", "recall", "f1", "auc"]
    one = cut_lineage(one.select(*keys, "fold", "n", *names))
    mean = one.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.avg(c).alias(c) for c in names])
    return one.unionByName(mean.withColumn("fold", F.lit("mean")))
