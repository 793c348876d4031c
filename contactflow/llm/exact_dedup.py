"""Exact dedup by two-pass Bloom filtering, with DataFrame functions only.

Pass 1: the 64-bit hash of every text is a slot of a counting filter that the shuffle shards (eight bytes a row, counted before
it); slots hit twice or more are possibly repeated hashes. They are put in a Bloom filter of bitmaps: BITS bits a bitmap, one
bitmap and HASHES bits a hash, about LOAD bits a hash, at most MAX_BITMAPS bitmaps (64 MB, so the broadcast is bounded).
Pass 2: every row tests its hash. Rows outside the filter are unique and pass straight through; only the others shuffle,
to be counted by SHA-256. A full filter lets more unique rows through to that count and changes no result.

Scale: groups are counted before their shuffle. Groups with a share of 1 / HOT_GROUPS of the candidates or more number HOT_GROUPS at
most: their totals are broadcast, so no task receives a large group; the other groups join by shuffle.

Edge cases: a null text counts as empty. Null ids are least and keep a group only where all its ids are null. Rows with equal id and text
stay or go together and each counts in group_size. An empty table gives an empty result. Extra columns of any name are kept by
`filter_documents` and left out by `mark`.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactflow.llm.common import written

#: Fixed value: Spark's bitmap functions build bitmaps of 32,768 bits.
BITS = 1 << 15
HASHES, LOAD, MAX_BITMAPS, HOT_GROUPS = 3, 16, 1 << 14, 10_000
Normal = Callable[[Column], Column]


def as_it_is(text: Column) -> Column:
    return text


def _hash(text: str, normal: Normal) -> Column:
    return F.xxhash64(normal(F.coalesce(F.col(text), F.lit(""))))


def _place(h: Column, k: int) -> Column:
    """The k-th bit of a hash in its bitmap: 15 bits of the hash, above those that choose the bitmap."""
    return F.shiftrightunsigned(h, 14 + 15 * k).bitwiseAND(F.lit(BITS - 1))


def repeated(docs: DataFrame, text: str = "text", normal: Normal = as_it_is) -> DataFrame:
    """Pass 1: the hashes that two rows or more have."""
    counts = docs.select(_hash(text, normal).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return written(counts.filter("n > 1").select("h"), "repeated-hashes")


def bloom(hashes: DataFrame, load: int = LOAD, most: int = MAX_BITMAPS) -> tuple[DataFrame, int]:
    """(bitmap, bits) of a Bloom filter of the hashes, and its number of bitmaps: a power of two, at most `most`."""
    wanted = -(-hashes.count() * load // BITS)
    n = min(most, 1 << max(0, wanted - 1).bit_length())
    places = F.explode(F.array(*[_place(F.col("h"), k) for k in range(HASHES)]))
    set_ = hashes.select(F.col("h").bitwiseAND(F.lit(n - 1)).alias("bitmap"), places.alias("place"))
    return written(set_.groupBy("bitmap").agg(F.bitmap_construct_agg("place").alias("bits")), "bloom"), n


def _has(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, (place % 8).cast("int")) == 1


def _tested(rows: DataFrame, filter_: DataFrame, n: int) -> tuple[DataFrame, Column]:
    """Rows with a hash h joined with its bitmap, and whether it is in the filter."""
    rows = rows.withColumn("bitmap", F.col("h").bitwiseAND(F.lit(n - 1))).join(F.broadcast(filter_), "bitmap", "left")
    maybe = F.col("bits").isNotNull()
    for k in range(HASHES):
        maybe = maybe & _has(F.col("bits"), _place(F.col("h"), k))
    return rows, F.coalesce(maybe, F.lit(False))


def tested(docs: DataFrame, text: str = "text", normal: Normal = as_it_is, load: int = LOAD, most: int = MAX_BITMAPS) -> DataFrame:
    """Pass 2: (row, maybe): every row as a struct, and whether the filter holds its hash."""
    rows, maybe = _tested(docs.select(F.struct(*docs.columns).alias("row"), _hash(text, normal).alias("h")), *bloom(repeated(docs, text, normal), load, most))
    return rows.select("row", maybe.alias("maybe"))


def within(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key may be among `keys` (one column): all that are, and a few others, found without a shuffle of the rows."""
    hashes = keys.select(F.xxhash64(F.col(keys.columns[0])).alias("h"))
    found, maybe = _tested(rows.select(F.struct(*rows.columns).alias("row"), F.xxhash64(F.col(key)).alias("h")), *bloom(hashes))
    return found.filter(maybe).select("row.*")


def _settled(rows: DataFrame) -> DataFrame:
    """Candidates (id, sha and more) with keep_id and group_size of their group."""
    stats = rows.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    stats = written(stats, "groups").withColumnRenamed("sha", "of")
    least = max(2, -(-rows.count() // HOT_GROUPS))
    hot = F.broadcast(stats.filter(F.col("group_size") >= least))
    same = F.col("sha") == F.col("of")
    cold = rows.join(hot, same, "left_anti").join(stats.filter(F.col("group_size") < least), same)
    return rows.join(hot, same).drop("of").unionByName(cold.drop("of"))


def _sha(text: str, normal: Normal) -> Column:
    return F.sha2(normal(F.coalesce(F.col(f"row.{text}"), F.lit(""))), 256)


def mark(docs: DataFrame, id: str = "doc_id", text: str = "text", normal: Normal = as_it_is, **sizes: int) -> DataFrame:
    """A row for each row: id, keep_id (the greatest id of its group), group_size, kept, text_sha256."""
    rows = tested(docs.select(id, text), text, normal, **sizes)
    out = lambda d: d.select(
        F.col("id").alias(id), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
    flat = lambda d: d.select(F.col(f"row.{id}").alias("id"), _sha(text, normal).alias("sha"))
    alone = flat(rows.filter(~F.col("maybe"))).withColumns({"keep_id": F.col("id"), "group_size": F.lit(1).cast("long")})
    found = written(flat(rows.filter("maybe")), "possibly-repeated")
    return out(alone).unionByName(out(_settled(found)))


def filter_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", normal: Normal = as_it_is, **sizes: int) -> DataFrame:
    """The rows that stay, whole: of rows with equal texts those with the greatest id."""
    rows = tested(docs, text, normal, **sizes)
    found = written(rows.filter("maybe").select("row", F.col(f"row.{id}").alias("id"), _sha(text, normal).alias("sha")), "possibly-repeated")
    kept = _settled(found.select("id", "sha")).filter(F.col("id").eqNullSafe(F.col("keep_id"))).select(F.col("id").alias("i"), F.col("sha").alias("s")).distinct()
    kept = found.join(kept, (F.col("sha") == F.col("s")) & F.col("id").eqNullSafe(F.col("i")), "left_semi")
    return rows.filter(~F.col("maybe")).select("row.*").unionByName(kept.select("row.*"))
