"""Exact ranks without an unpartitioned or single-key sort."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactflow.session import cut_lineage


def _splits(df: DataFrame, score: str, parts: int) -> list[float]:
    probs = [i / parts for i in range(1, parts)]
    return sorted(set(df.approxQuantile(score, probs, 0.5 / parts))) if probs else []


HOT_SCORE = 200_000  # rows sharing one score before their tie order is split


def _null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Equi-join that also matches NULL with NULL, so rows without a key or score stay (they rank first).

    Both sides grow with the data (a row for each key and score), and their shuffles compress far below what the rows take
    in memory: asked to merge, so the driver never builds a table of them."""
    own = right.withColumnsRenamed({c: f"_j_{c}" for c in on}).hint("merge")
    same = [F.col(c).eqNullSafe(F.col(f"_j_{c}")) for c in on]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return left.join(own, cond, how).drop(*[f"_j_{c}" for c in on])


def _place(df: DataFrame, name: str) -> Column:
    """A number that never falls along a column's order: its value, or for text its first six bytes."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.TimestampType):
        return c.cast("double")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.lit(0.0)


def _rank_table(df: DataFrame, keys: list[str], score: str, ends: Sequence[Column] = (), parts: int | None = None) -> DataFrame:
    """A row for each key and score: ``rank_min``, ``rank_avg``, ``n``, its number of rows ``_m`` and the aggregates ``ends``.

    Scores are cut at approximate quantiles (any cut is exact, good cuts are
    balanced). Equal scores are counted before ranking, so one repeated score
    costs one row."""
    parts = parts or min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1024)
    # counted once; the cut points and both levels of the scan read the small result
    counts = cut_lineage(df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_m"), *ends))
    cuts = _splits(counts, score, parts)
    bucket = F.lit(0)
    if cuts:
        lit = F.array(*[F.lit(float(c)) for c in cuts])
        bucket = F.size(F.filter(lit, lambda c: c <= F.col(score)))
    counts = counts.withColumn("_b", bucket)
    w = Window.partitionBy(*keys, "_b").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    local = counts.withColumn("_below", F.coalesce(F.sum("_m").over(w), F.lit(0)))
    ws = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy(*keys, "_b").agg(F.sum("_m").alias("_s"))
    sums = sums.select(*keys, "_b", F.coalesce(F.sum("_s").over(ws), F.lit(0)).alias("_base"),
                       F.sum("_s").over(Window.partitionBy(*keys)).alias("n"))
    return (_null_safe(local, sums, [*keys, "_b"], "inner").drop("_b")
            .withColumn("rank_min", F.col("_below") + F.col("_base") + 1)
            .withColumn("rank_avg", F.col("rank_min") + (F.col("_m") - 1) / 2.0).drop("_below", "_base"))


def ranked(df: DataFrame, keys: Sequence[str], score: str, *, tie: Sequence[str] = (),
           parts: int | None = None, hot: int = HOT_SCORE) -> DataFrame:
    """Add ``rank_min``, ``rank_avg``, ``n`` and, given a tie column, ``rank_first`` per key.

    A score's rows get their order within slices of the first tie
    column, about ``hot`` rows each, so no task sorts all rows of a hot score.
    """
    keys = list(keys)
    place = _place(df, tie[0]) if tie else None
    ends = [F.min(place).alias("_t0"), F.max(place).alias("_t1")] if tie else []
    table = _rank_table(df, keys, score, ends, parts)
    out = _null_safe(df, table, [*keys, score], "inner")
    if not tie:
        return out.drop("_m")
    width = (F.col("_t1") - F.col("_t0") + 1) / F.ceil(F.col("_m") / hot)
    out = out.withColumn("_sl", F.floor((place - F.col("_t0")) / width))
    base = out.where(F.col("_m") > hot).groupBy(*keys, score, "_sl").agg(F.count(F.lit(1)).alias("_c"))
    wb = Window.partitionBy(*keys, score).orderBy("_sl").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select(*keys, score, "_sl", F.sum("_c").over(wb).alias("_before"))
    inner = Window.partitionBy(*keys, score, "_sl").orderBy(*tie)
    out = out.withColumn("_rn", F.row_number().over(inner))
    out = _null_safe(out, base, [*keys, score, "_sl"], "left")
    out = out.withColumn("rank_first", F.col("rank_min") + F.coalesce("_before", F.lit(0)) + F.col("_rn") - 1)
    return out.drop("_m", "_t0", "_t1", "_sl", "_rn", "_before")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], highest: str | None = None) -> DataFrame:
    """Linearly interpolated quantiles per key from distributed ranks, and the largest value if ``highest`` names it.

    No aggregation state grows with the group, unlike percentile(). The ranks of distinct values say it all, so rows are not joined back.
    """
    keys = list(keys)
    r = _rank_table(df.where(F.col(value).isNotNull()).select(*keys, value), keys, value)
    aggs = [F.max(value).alias(highest)] if highest else []
    for name, p in probs.items():
        pos = p * (F.col("n") - 1)
        for tag, idx in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            aggs.append(F.max(F.when(F.col("rank_min") - 1 <= idx, F.col(value))).alias(f"_{name}_{tag}"))
    g = r.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)
    for name, p in probs.items():
        pos = p * (F.col("n") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        g = g.withColumn(name, lo + (hi - lo) * (pos - F.floor(pos)))
    return g.select(*keys, "n", *probs, *([highest] if highest else []))


def roc_auc(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Rank-sum AUC per key; NULL when a class is missing."""
    keys = list(keys)
    r = ranked(df, keys, score)
    pos = F.col(label) == 1
    g = r.groupBy(*keys).agg(F.count_if(pos).alias("n_pos"), F.count_if(~pos).alias("n_neg"),
                             F.sum(F.when(pos, F.col("rank_avg"))).alias("_r"))
    u = F.col("_r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2
    return g.select(*keys, "n_pos", "n_neg", F.try_divide(u, (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auc"))


def blocks_by_rank(df: DataFrame, keys: Sequence[str], order: str, k: int, out: str,
                   tie: Sequence[str]) -> DataFrame:
    """k consecutive, near-equal blocks in order: the first n mod k hold one more row."""
    r = ranked(df, keys, order, tie=tie)
    i, n = F.col("rank_first") - 1, F.col("n")
    q, rem = F.floor(n / k), n % k
    cut = rem * (q + 1)
    fold = F.when(i < cut, F.floor(i / (q + 1))).otherwise(rem + F.floor((i - cut) / F.greatest(q, F.lit(1))))
    return r.withColumn(out, fold.cast("int")).drop("rank_first", "rank_min", "rank_avg", "n")
