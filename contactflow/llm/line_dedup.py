"""Line dedup by overlapping three-line windows.

Lines with a word are read in order; every three consecutive ones are a window, hashed to 128 bits. Of each window found
more than once in the whole table its first occurrence (least document id, then place) stays; every later one
marks its three lines. Marked places of a document are merged and its text is rebuilt without these lines.

Scale: one aggregate on the hash (combined before its shuffle) finds repeated windows and their first places;
the repeated ones are written and joined back on the hash, so a passage in a third of all documents is a
skewed join that Spark splits, never one task's group. A document's marks are bounded by its own lines. Texts are
shuffled once, by document, at every size: marks grow with the documents, so they are never broadcast.

Edge cases: a null text stays null; texts with fewer than three lines with words are unchanged; null ids sort first. Rows
with equal id and text count as one document and are trimmed alike. Extra columns are kept.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactflow.llm.common import SPACES, text_key, written

WINDOW = 3


def _windows(docs: DataFrame, id: str, text: str) -> DataFrame:
    """A row for each window: document (id, key of the text), the places of its three lines, hash."""
    lines = F.transform(F.split(F.col(text), "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("p")))
    lines = F.filter(lines, lambda s: F.btrim(s["x"], F.lit(SPACES)) != "")
    many = docs.select(F.col(id).alias("id"), text_key(F.col(text)).alias("doc"), lines.alias("l")).filter(F.size("l") >= WINDOW)
    three = [F.get("l", F.col("k") + d) for d in range(WINDOW)]
    many = many.select("id", "doc", "l", F.explode(F.sequence(F.lit(0), F.size("l") - WINDOW)).alias("k"))
    return many.select(
        "id", "doc", F.xxhash64(*[s["x"] for s in three]).alias("h1"), F.xxhash64(F.lit("second"), *[s["x"] for s in three]).alias("h2"),
        *[s["p"].alias(f"p{d}") for d, s in enumerate(three)],
    )


def later_lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, doc, places): the places of lines in later occurrences of repeated windows."""
    order = F.struct("id", "doc", "p0")
    first = _windows(docs, id, text).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).filter("n > 1")
    first = written(first.drop("n"), "repeated-windows").withColumnsRenamed({"h1": "g1", "h2": "g2"})
    rows = _windows(docs, id, text)
    later = rows.join(first, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).filter(order != F.col("first"))
    places = later.select("id", "doc", F.explode(F.array("p0", "p1", "p2")).alias("p"))
    return places.groupBy("id", "doc").agg(F.collect_set("p").alias("places"))


def remove(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its text without later occurrences, and n_lines, n_removed."""
    marks = written(later_lines(docs, id, text), "later-lines").select(F.col("id").alias("_id"), F.col("doc").alias("_doc"), "places")
    rows = docs.withColumn("_key", text_key(F.col(text)))
    rows = rows.join(marks.hint("merge"), F.col(id).eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_doc")), "left")
    rows = rows.withColumn("_l", F.split(F.col(text), "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_l") - 1), F.col("places"))
    cut = F.array_join(F.transform(left, lambda i: F.get(F.col("_l"), i)), "\n")
    rows = rows.withColumns({
        "n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size("_l")).cast("long"),
        "n_removed": F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long"),
        text: F.when(F.col("places").isNull(), F.col(text)).otherwise(cut),
    })
    return rows.drop("_key", "_id", "_doc", "_l", "places")


def filter_documents(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with their later lines removed; those that lose every word go, for nothing of their own is left."""
    left = remove(docs, id, text)
    return left.filter((F.col("n_removed") == 0) | (F.btrim(F.col(text), F.lit(SPACES)) != "")).select(*docs.columns)
