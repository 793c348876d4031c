"""SimHash near-duplicates by bit-sliced comparison.

A text's fingerprint has a bit for every bit set in over half of its shingles' XXH64 values. Fingerprints that
differ in at most RADIUS = 2 bits are linked; groups are the connected components.

1. Distinct fingerprints only: thousands of exact copies are one fingerprint.
2. Candidates: of BLOCKS = 4 blocks of 16 bits two must agree, so each fingerprint is filed under six 32-bit keys.
   A key with more than CELL fingerprints is dealt over pairs of sub-blocks (cells) of at most about CELL fingerprints
   each, so no task holds a whole bucket.
3. Within a run of cells the fingerprints are stored vertically, one plane per bit. A set of queries is
   compared with all lanes at once: differing bits go through a carry-save adder into two counter planes, an
   overflow plane marks lanes beyond the radius, and the block is abandoned once every lane has overflowed.
4. Only a spanning star of each local component leaves the task: linear output even inside dense groups.
5. Stars merge by alternating large-star and small-star rounds over written tables.

Edge cases: a null text or one without a word has fingerprint 0 and links like any other. Null ids take part, but
never name a component unless all its ids are null (then it is null). Repeated rows share everything.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactflow.llm.common import written

RADIUS, BLOCKS, BLOCK_BITS, CELL, LANES, QUERIES = 2, 4, 16, 4096, 2048, 64
SEED, SHINGLE = 42, 3
WORD = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number. bytes.lower and bytes.split treat exactly A-Z and the six ASCII spaces."""
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else [b" ".join(w)]
    h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        part = h[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(text: Column) -> Column:
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return F.pandas_udf("long")(of)(text)


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes of n fingerprints: 64 rows of n / 64 words, lane i at bit i % 64 of word i // 64; unused lanes are zero."""
    n = -(-len(values) // 64) * 64
    bits = np.zeros((n, 64), dtype=np.uint8)
    bits[: len(values)] = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def earlier_lanes(first: int, count: int, n: int, words: int) -> np.ndarray:
    """For queries that are lanes first, first + 1, ...: the lanes up to their own and the unused ones, as packed words."""
    lane = np.arange(words * 64)
    off = (lane[None, :] <= np.arange(first, first + count)[:, None]) | (lane >= n)[None, :]
    return np.packbits(off, axis=1, bitorder="little").view(np.uint64)


def within(planes: np.ndarray, queries: np.ndarray, skip: np.ndarray, radius: int = RADIUS) -> np.ndarray | None:
    """Lanes within the radius of each query as packed words, without those in skip; None if the block was abandoned.

    Counters hold the distance so far modulo 4 as two planes; `over` keeps lanes that passed the radius."""
    if not 0 <= radius <= 2:
        raise ValueError("two counter planes hold a radius of 2 at most")
    one, two, over = np.zeros_like(skip), np.zeros_like(skip), skip.copy()
    for bit in range(64):
        mask = np.where((queries >> np.uint64(bit)) & np.uint64(1), WORD, np.uint64(0))
        differ = planes[bit][None, :] ^ mask[:, None]
        carry = one & differ
        one ^= differ
        over |= two & carry  # from 3 to 4
        two ^= carry
        over |= (two & one) if radius == 2 else two if radius == 1 else (one | two)
        if bit % 4 == 3 and (over == WORD).all():
            return None
    return ~over


def linked(values: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stars (members, centres) that span the components among distinct values."""
    n = len(values)
    planes, label = planes_of(values), np.arange(n)
    for at in range(0, n, QUERIES):
        queries = values[at:at + QUERIES]
        found = within(planes, queries, earlier_lanes(at, len(queries), n, planes.shape[1]), radius)
        if found is None:
            continue
        hits = np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")[:, :n]
        for k in np.flatnonzero(hits.any(axis=1)):
            own = np.unique(label[np.append(np.flatnonzero(hits[k]), at + k)])
            if len(own) > 1:
                label[np.isin(label, own)] = own[0]
    member = np.flatnonzero(label != np.arange(n))
    yield values[member], values[label[member]]


def _compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells arrive sorted; whole cells are gathered up to LANES lanes and compared as one block (a larger cell is one block)."""
    def stars(parts: list[np.ndarray]) -> pd.DataFrame:
        values = np.unique(np.concatenate(parts)).view(np.uint64)
        pairs = list(linked(values))
        a = np.concatenate([x for x, _ in pairs]).view(np.int64)
        b = np.concatenate([y for _, y in pairs]).view(np.int64)
        return pd.DataFrame({"a": a, "b": b})

    block: list[np.ndarray] = []
    lanes, rest = 0, None
    for frame in frames:
        frame = pd.concat([rest, frame], ignore_index=True) if rest is not None else frame
        if frame.empty:
            continue
        key = frame[["t", "key", "i", "j"]].to_numpy()
        cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        last = cut[-1] if len(cut) else 0
        rest = frame.iloc[last:]
        values = frame["fp"].to_numpy()
        for v in np.split(values[:last], cut[:-1]) if last else []:
            if len(v) < 2:
                continue
            if lanes and lanes + len(v) > LANES:
                yield stars(block)
                block, lanes = [], 0
            block.append(v)
            lanes += len(v)
    if rest is not None and len(rest) > 1:
        block.append(rest["fp"].to_numpy())
    if block:
        yield stars(block)


def links(fps: DataFrame, cell: int = CELL) -> DataFrame:
    """Links (a, b) that span the groups among distinct fingerprints (column fp)."""
    fp = F.col("fp")
    keys = []
    for t, chosen in enumerate(combinations(range(BLOCKS), 2)):
        part = [F.shiftright(fp, BLOCK_BITS * b).bitwiseAND(F.lit(0xFFFF)) for b in chosen]
        keys.append(F.struct(F.lit(t).alias("t"), (part[0] * F.lit(1 << BLOCK_BITS) + part[1]).cast("long").alias("key")))
    filed = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.t", "k.key")
    sizes = filed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    large = written(sizes.filter(F.col("n") > cell), "large-buckets")
    parts = F.coalesce(F.ceil(F.col("n") / F.lit(cell)).cast("int"), F.lit(1))
    dealt = filed.join(large, ["t", "key"], "left").withColumn("g", parts)
    own = F.pmod(F.xxhash64(F.lit("cell"), fp), F.col("g")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    return dealt.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j").mapInPandas(_compare, "a long, b long")


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link: root is the least node of its component."""
    edges = written(pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                                             F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = written(small.filter("a <> b").distinct(), "stars")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def group(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: id, fingerprint, component_id, component_size (documents)."""
    prints = written(docs.select(F.col(id), fingerprints(F.col(text)).alias("fp")), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min(id).alias("least"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    roots = components(links(nodes.select("fp")))
    nodes = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = nodes.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"))
    named = written(nodes.join(names, "root").select("fp", "component_id", "component_size"), "components")
    return prints.join(named, "fp").select(id, hex16(F.col("fp")).alias("fingerprint"), "component_id", "component_size")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without all but one of each group: that with the least id stays.

    Repeated rows of the id that stays are reduced to one; a group whose ids are all null keeps one row."""
    found = written(group(docs, id, text), "groups")
    stays = found.filter(F.col(id).eqNullSafe(F.col("component_id")))
    stays = stays.groupBy(F.col(id).alias("_id"), F.col("fingerprint").alias("_fp"), F.col("component_id").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    once = written(stays, "stays")
    plain = docs.join(once.filter("_n = 1 and _id is not null"), F.col(id) == F.col("_id"), "left_semi")
    odd = once.filter("_n > 1 or _id is null")
    marked = docs.withColumn("_f", F.lit(0)).join(odd.select("_id", "_fp"), F.col(id).eqNullSafe(F.col("_id")))
    marked = marked.filter(hex16(fingerprints(F.col(text))) == F.col("_fp")).dropDuplicates(["_fp"])
    return plain.unionByName(marked.select(*docs.columns))
