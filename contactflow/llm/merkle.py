"""Merkle dataset manifest by time-forward processing.

Every row is a leaf of its tree (one tree for each value of `tree`), leaves ascend by id; FAN consecutive nodes become one parent until one is
left. The roots of the trees, ordered by name, are the leaves of a last tree, whose root stands for the dataset.

Nodes are labelled (level, place), so children come before parents. A node, once computed, sends its digest to its parent through
a priority queue ordered by label. The queue is external: it is cut into strata of LEVELS levels. Inside a block of FAN ** LEVELS
neighbours a heap in one task holds it; between strata it is a table of messages (tree, block, place, digest) that a
shuffle deals by receiver and sorts, so each stratum extracts what the one below has sent. The reversed sweep reads the same blocks
from the last stratum down: every parent sends its children the rest of their proofs (siblings left and right, level by level)
and the leaves fold them.

Scale: leaves are numbered by a range sort and counts per partition, so a tree with a third of all rows is spread over tasks; a
task holds one block (4,096 digests). Rounds: one for each factor 4,096 of the largest tree. The driver sees the greatest size and the root.

Edge cases: null values are leaves' values of their own (`-`), null ids come first, the null tree is a tree and comes first. Repeated rows are leaves
each; equal ids are ordered by leaf digest. An empty table gives an empty result. Extra columns are ignored.
"""
from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactflow.llm.common import written

FAN, LEVELS = 16, 3
NODE = "tree string, i long, n long, id string, leaf string, other string"
#: The siblings of a node and of each of its ancestors: (left, right, those of the parent).
Chain = tuple[str, str, "Chain"] | None


def encoded(value: Column) -> Column:
    """`-` for null, else UTF-8 byte count, colon, value."""
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def height(n: int, whole: bool, fan: int = FAN, levels: int = LEVELS) -> int:
    """Levels above the n nodes of a block; a whole tree goes on to one node."""
    if not whole:
        return levels
    h = 0
    while n > 1:
        n, h = -(-n // fan), h + 1
    return h


def forward(leaves: Sequence[str], top: int, fan: int = FAN) -> tuple[str, dict[tuple[int, int], list[str]]]:
    """The digest of the block's top, and what each inner node received: nodes are visited in the order of their labels."""
    queue = [(1, k // fan, k % fan, d) for k, d in enumerate(leaves)] if top else []  # ascending, so a heap already
    received: dict[tuple[int, int], list[str]] = {}
    last = leaves[0]
    while queue:
        level, place = queue[0][:2]
        got = []
        while queue and queue[0][:2] == (level, place):
            got.append(heapq.heappop(queue)[3])
        received[level, place], last = got, digest("".join(got))
        if level < top:
            heapq.heappush(queue, (level + 1, place // fan, place % fan, last))
    return last, received


def backward(n: int, top: int, received: dict[tuple[int, int], list[str]], above: Chain, fan: int = FAN) -> list[Chain]:
    """The proof chain of each leaf: nodes are visited against the order of their labels."""
    queue: list[tuple[int, int, Chain]] = [(-top, 0, above)]
    out: list[Chain] = [None] * n
    while queue:
        level, place, chain = heapq.heappop(queue)
        level, place = -level, -place
        if not level:
            out[place] = chain
            continue
        got = received[level, place]
        for k in range(len(got)):
            heapq.heappush(queue, (1 - level, -(place * fan + k), ("".join(got[:k]), "".join(got[k + 1:]), chain)))
    return out


def fold(start: str, chain: Chain, known: dict | None = None) -> str:
    """The root that a leaf and its siblings give. known: results by chain and digest, shared by the leaves of a block."""
    if chain is None:
        return start
    if known is None or (found := known.get((id(chain), start))) is None:
        found = fold(digest(chain[0] + start + chain[1]), chain[2], known)
        if known is not None:
            known[id(chain), start] = found
    return found


def proof(chain: Chain) -> str:
    """Digest of all siblings, level by level, left to right."""
    h = sha256()
    while chain is not None:
        h.update((chain[0] + chain[1]).encode())
        chain = chain[2]
    return h.hexdigest()


def numbered(leaves: DataFrame) -> DataFrame:
    """Leaves (tree, key, leaf, other, id) with their place i in the tree and its size n: a range sort, then counts per partition and tree."""
    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, tree, n = TaskContext.get().partitionId(), None, 0
        for frame in frames:
            at = []
            for t in frame["tree"]:
                tree, n = t, n + 1 if t == tree else 0
                at.append(n)
            yield frame[["tree", "id", "leaf", "other"]].assign(task=task, at=at)

    order = [F.col("tree"), F.col("key").asc_nulls_first(), F.col("leaf"), F.col("other")]
    rows = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.mapInPandas(places, "tree string, id string, leaf string, other string, task int, at long"), "sorted-leaves")
    counts = rows.groupBy("tree", "task").agg(F.count(F.lit(1)).alias("m"))
    tree = Window.partitionBy("tree")  # a row for each task that has leaves of the tree
    before = F.sum("m").over(tree.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    start = counts.select("tree", "task", F.sum("m").over(tree).alias("n"), F.coalesce(before, F.lit(0)).alias("start"))
    return rows.join(start, ["tree", "task"]).select("tree", (F.col("start") + F.col("at")).alias("i"), "n", "id", "leaf", "other")


def blocks(nodes: DataFrame, size: int) -> DataFrame:
    """Deals the nodes to their blocks: (tree, block, n, ids, leaves, others), the arrays in the order of places."""
    own = nodes.groupBy("tree", F.expr(f"i div {size}").alias("block"), "n").agg(F.sort_array(F.collect_list(F.struct("i", "id", "leaf", "other"))).alias("l"))
    return written(own.select("tree", "block", "n", F.col("l.id").alias("ids"), F.col("l.leaf").alias("leaves"), F.col("l.other").alias("others")), "blocks")


class Forest:
    """The strata of a forest: blocks of each round, and the roots of its trees (tree, root)."""

    def __init__(self, leaves: DataFrame, fan: int = FAN, levels: int = LEVELS) -> None:
        self.fan, self.levels, self.size = fan, levels, fan ** levels
        self.rounds: list[DataFrame] = []
        nodes, self.roots = numbered(leaves), None
        while True:
            own = blocks(nodes, self.size)
            self.rounds.append(own)
            tops = written(own.select("tree", "block", "n", "leaves").mapInPandas(self._up, "tree string, i long, n long, leaf string"), "tops")
            done = tops.filter("n = 1").select("tree", F.col("leaf").alias("root"))
            self.roots = done if self.roots is None else self.roots.unionByName(done)
            nodes = tops.filter("n > 1").selectExpr("tree", "i", "n", "'' as id", "leaf", "cast(null as string) as other")
            if nodes.isEmpty():
                return

    @property
    def _up(self) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        fan, levels, size = self.fan, self.levels, self.size

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                tops = [forward(x, height(len(x), n <= size, fan, levels), fan)[0] for n, x in zip(frame["n"], frame["leaves"], strict=True)]
                yield pd.DataFrame({"tree": frame["tree"], "i": frame["block"], "n": -(-frame["n"] // size), "leaf": tops})

        return run

    def sweep(self, above: DataFrame, last: Callable, schema: str) -> DataFrame:
        """The reversed sweep. above: (tree, root, lefts, rights) for each tree; last(block, chains) makes the rows of the leaves' stratum."""
        fan, levels, size, sent = self.fan, self.levels, self.size, None
        message = "tree string, block long, root string, lefts array<string>, rights array<string>"

        def down(rows: Callable) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
            def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for frame in frames:
                    for b in frame.itertuples(index=False):
                        top = height(len(b.leaves), b.n <= size, fan, levels)
                        chain: Chain = None
                        for pair in zip(reversed(b.lefts), reversed(b.rights), strict=True):
                            chain = (*pair, chain)
                        yield rows(b, backward(len(b.leaves), top, forward(b.leaves, top, fan)[1], chain, fan))
            return run

        def deliver(b, chains: list[Chain]) -> pd.DataFrame:
            both = [listed(c) for c in chains]
            return pd.DataFrame({"tree": b.tree, "block": [b.block * size + k for k in range(len(both))], "root": b.root,
                                 "lefts": [x for x, _ in both], "rights": [x for _, x in both]})

        for r in range(len(self.rounds) - 1, -1, -1):
            own = self.rounds[r]
            ends = own.filter(F.col("n") <= size).join(above, "tree")
            if sent is not None:
                ends = ends.unionByName(own.filter(F.col("n") > size).join(sent, ["tree", "block"]))
            if not r:
                return ends.mapInPandas(down(last), schema)
            sent = written(ends.mapInPandas(down(deliver), message), "messages")
        raise AssertionError("a forest has a round")


def listed(chain: Chain) -> tuple[list[str], list[str]]:
    left, right = [], []
    while chain is not None:
        left.append(chain[0])
        right.append(chain[1])
        chain = chain[2]
    return left, right


def manifest(docs: DataFrame, values: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id: str = "doc_id", tree: str = "source",
             other: Column | None = None, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """A row for each row: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    other: leaf digest of a row as it is found when checked (null: unchanged); folded_root is the root it gives with the original siblings."""
    name = F.when(F.col(tree).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(tree).cast("string")))  # "-" sorts before "="
    rows = docs.select(name.alias("tree"), F.col(id).alias("key"), F.col(id).cast("string").alias("id"), leaf([F.col(v) for v in values]).alias("leaf"),
                       (F.lit(None) if other is None else other).cast("string").alias("other"))
    trees = Forest(rows, fan, levels)
    roots = written(trees.roots, "roots")
    whole = Forest(roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("tree").alias("id"), F.col("root").alias("leaf"), F.lit(None).cast("string").alias("other")), fan, levels)
    root = whole.roots.first()
    root = root["root"] if root else ""

    def paths(b, chains: list[Chain]) -> pd.DataFrame:
        both = [listed(c) for c in chains]
        return pd.DataFrame({"tree": b.ids, "root": b.leaves, "lefts": [x for x, _ in both], "rights": [x for _, x in both]})

    def checked(b, chains: list[Chain]) -> pd.DataFrame:
        known: dict = {}
        folded = [fold(o or d, c, known) for d, o, c in zip(b.leaves, b.others, chains, strict=True)]
        return pd.DataFrame({"id": b.ids, "leaf": b.leaves, "subroot": b.root, "root": root, "proof_sha256": [proof(c) for c in chains],
                             "folded_root": folded, "verified": [x == root for x in folded]})

    path = "tree string, root string, lefts array<string>, rights array<string>"
    start = docs.sparkSession.createDataFrame([("", root, [], [])], path)
    above = written(whole.sweep(start, paths, path), "paths")
    out = trees.sweep(above, checked, "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumn("id", F.col("id").cast(docs.schema[id].dataType)).withColumnRenamed("id", id)
