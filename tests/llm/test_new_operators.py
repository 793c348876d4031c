"""Exact dedup, Merkle manifest and Shallot clustering against brute force."""
import random
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactflow.llm import exact_dedup, merkle, shallot
from tests.llm.conftest import LONG

# ---------------------------------------------------------------- exact dedup


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_dedup_equals_brute_force(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, exact_dedup.mark(odd).collect()), key=repr) == brute_groups(rows)


@pytest.mark.parametrize("sizes", [{}, {"most": 1}, {"load": 1, "most": 2}])
def test_a_full_filter_changes_no_result(spark, sizes):
    r = random.Random(3)
    rows = [(i, f"text {r.randrange(4000)}" if i % 3 else "hot") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, exact_dedup.mark(docs, **sizes).collect()), key=repr) == brute_groups(rows)


def test_only_possibly_repeated_rows_shuffle(spark):
    rows = [(i, f"text {i if i < 9000 else i % 500}") for i in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    maybe = {r.row.doc_id for r in exact_dedup.tested(docs).filter("maybe").collect()}
    twice = {i for i, t in rows if i >= 9000 or i < 500}
    assert twice <= maybe and len(maybe - twice) < 200  # false positives of the filter


def test_filter_documents_keeps_rows_whole(spark, odd, empty):
    kept = exact_dedup.filter_documents(odd.withColumns({"maybe": F.lit(1), "row": F.lit("r"), "sha": F.lit(None).cast("int"), "h": F.lit(0.5), "bits": F.lit(b"x"), "of": F.lit(2)}))
    got = kept.collect()
    assert kept.columns == [*odd.columns, "maybe", "row", "sha", "h", "bits", "of"]
    want = {(i, keep) for i, keep, _, same, _ in brute_groups([(r.doc_id, r.text) for r in odd.collect()]) if same}
    assert {(r.doc_id, r.doc_id) for r in got} == want and all(r.maybe == 1 and r.row == "r" for r in got)
    assert exact_dedup.mark(empty).count() == 0 and exact_dedup.filter_documents(empty).count() == 0


def test_texts_may_be_normalised(spark):
    docs = spark.createDataFrame([(1, "A b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.text_sha256) for r in exact_dedup.mark(docs, normal=F.lower).collect()}
    assert got == {1: (2, sha256(b"a b").hexdigest()), 2: (2, sha256(b"a b").hexdigest()), 3: (3, sha256(b"c").hexdigest())}


# ---------------------------------------------------------------- Merkle manifest

def h(x):
    return sha256(x.encode()).hexdigest()


def brute_tree(leaves, fan):
    """Root, and for each leaf its path: (left siblings, right siblings) level by level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, i in enumerate(at):
            lo = i // fan * fan
            paths[k].append(("".join(level[lo:i]), "".join(level[i + 1:lo + fan])))
            at[k] = i // fan
        level = [h("".join(level[i:i + fan])) for i in range(0, len(level), fan)]
    return level[0], paths


def brute_manifest(rows, fan):
    """rows: (doc_id, source, text, other leaf)."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees = defaultdict(list)
    for i, s, t, o in rows:
        trees[s].append((i is not None, i or 0, h(enc(i) + enc(s) + enc(t)), o or "", i))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    roots, below = [], {}
    for s in order:
        trees[s].sort(key=lambda x: x[:4])
        root, paths = brute_tree([x[2] for x in trees[s]], fan)
        roots.append(root)
        below[s] = paths
    root, above = brute_tree(roots, fan)
    out = []
    for k, s in enumerate(order):
        for (_, _, d, o, i), path in zip(trees[s], below[s], strict=True):
            x = o or d
            for left, right in path + above[k]:
                x = h(left + x + right)
            out.append((i, d, roots[k], root, h("".join(a + b for a, b in path + above[k])), x, x == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fan,levels,n", [(16, 3, 300), (2, 2, 90), (3, 1, 40), (16, 3, 1)])
def test_manifest_equals_brute_force(spark, fan, levels, n):
    r = random.Random(n)
    rows = [(None if k % 37 == 5 else k, r.choice([None, "", "a", "b", "é"]) if k % 3 else "hot", None if k % 11 == 3 else f"T {k}", h(str(k)) if k % 5 == 0 else None) for k in range(n)]
    rows += [rows[0], rows[-1]]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, o string").repartition(4)
    got = merkle.manifest(docs, ("doc_id", "source", "text"), other=F.col("o"), fan=fan, levels=levels)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_manifest(rows, fan)
    assert {x.verified for x in got.collect()} == ({True, False} if n > 1 else {False})


def test_manifest_of_odd_tables(spark, odd, empty):
    clash = odd.withColumns({"tree": F.lit(1), "leaf": F.lit("x"), "other": F.lit("y"), "i": F.lit(0), "n": F.lit(9), "task": F.lit(2)})
    got = merkle.manifest(clash)
    assert got.count() == odd.count() and got.filter("not verified").isEmpty()
    assert merkle.manifest(empty).count() == 0
    assert merkle.manifest(odd.filter(F.col("text") == LONG)).filter("not verified").isEmpty()


# ---------------------------------------------------------------- Shallot clustering

def brute_kmeans(x, cents, rounds):
    for _ in range(rounds):
        d = ((x[:, None, :] - cents[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        for k in set(own.tolist()):
            cents[k] = x[own == k].sum(axis=0) // (own == k).sum()
    d = ((x[:, None, :] - cents[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1), cents


@pytest.mark.parametrize("kind,k", [("clouds", 8), ("uniform", 20), ("ties", 5), ("single", 1)])
def test_search_equals_all_distances(kind, k):
    r = np.random.default_rng(k)
    x = {"clouds": lambda: (r.normal(size=(3000, 6)) * 40 + r.integers(0, 4, 3000)[:, None] * 300), "uniform": lambda: r.uniform(-500, 500, (3000, 4)),
         "ties": lambda: r.integers(0, 3, (3000, 2)), "single": lambda: r.normal(size=(50, 3)) * 9}[kind]().astype(np.int64)
    cents = np.unique(x, axis=0)[:k].copy()
    want = brute_kmeans(x, cents.copy(), 10)
    first, second, upper, lower = shallot.nearest(x, shallot.Centroids(cents))
    scanned = 0
    for _ in range(10):
        now = cents.copy()
        for j in set(first.tolist()):
            now[j] = x[first == j].sum(axis=0) // (first == j).sum()
        scanned += shallot.search(x, first, second, upper, lower, shallot.Centroids(now, cents))
        cents = now
    assert (first == want[0]).all() and (cents == want[2]).all()
    assert kind != "clouds" or scanned < 10 * len(x) / 2  # the bounds spare most scans


def test_cluster_equals_brute_force(spark):
    r = np.random.default_rng(5)
    vectors = (r.normal(size=(400, 4)) + r.integers(0, 3, 400)[:, None]).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(400, None), (401, [1.0]), (402, [1.0, None, 0.0, 0.0]), (403, [float("nan")] * 4), (404, [float("inf"), 0.0, 0.0, 0.0]), (None, vectors[0]), (7, vectors[7])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"q": F.lit(1), "block": F.lit(2), "cluster": F.lit(3)}).repartition(3)
    good = [(i, v) for i, v in rows if i not in range(400, 405)]
    x = np.floor(np.array([v for _, v in good]) * 1024).astype(np.int64)
    rank = sorted((sha256(f"3:{i}".encode()).hexdigest(), k) for k, (i, _) in enumerate(good) if i is not None)
    own, far, cents = brute_kmeans(x, x[[k for _, k in rank[:5]]].copy(), 6)
    want = sorted((repr(i), int(c), int(d), int(far[own == c].sum()), int(far.sum()), sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for (i, _), c, d in zip(good, own, far, strict=True))
    got = shallot.report(table, k=5, rounds=6, dims=4)
    assert sorted((repr(t[0]), *t[1:]) for t in map(tuple, got.collect())) == want
    few = shallot.report(table.filter("vec_id in (1, 2)"), k=5, rounds=2, dims=4).collect()
    assert len(few) == 2 and {r.distance for r in few} == {0}
    assert shallot.report(table.filter("vec_id > 900"), dims=4).count() == 0
