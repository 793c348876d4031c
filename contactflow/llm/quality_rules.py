"""Quality rules with cross-document line frequency, in DataFrame operations only.

Base rules look at one text: too few words, or more than half of its words in three-word windows that
the text repeats. The corpus rule looks at lines: every line is normalised (lower case, white space
squeezed, digit runs to one 0) and hashed; per host the distinct documents that have the line are counted,
where copies and near copies of a document (same longest line) count once, so that a text is not held against itself and
near duplicates reach their own stage. (So a notice longer than every own line of its pages counts as one document and stays.)
Lines in more documents than a host's limit are boiler-plate: `remove_lines` takes them out. A document is depleted,
and rejected, when the lines left to it hold less than `min_left` of the words of its distinct lines.

Scale: the counts are two-level aggregates on (host, line, document), so a hot host or a hot line is spread and
combined before it is shuffled. Lines over the limit and depleted texts are written tables; the joins
against them broadcast only below Spark's size threshold. `judge` shuffles texts only where depleted texts exceed that size.

Edge cases: a null text has no words and fails the base rules; `remove_lines` leaves it null. A null host is a host of its own. Rows with
equal host and text get equal verdicts, whatever their ids (null or repeated). Extra columns are kept by
`filter_documents` and ignored by `measure`; an empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactflow.llm.common import SPACES, text_key, words, written

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED, MIN_DOCS, HOST_SHARE, MIN_LEFT = 50, 0.5, 10, 0.002, 0.5


def _repeated_words(w: Column, s: Column) -> Column:
    """Words covered by windows that occur twice or more; s: the windows' (hash, place), sorted."""
    same = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
    twice = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
    return F.sort_array(F.transform(twice, lambda x: x["p"]))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to every row (columns of these names are replaced).

    The measures leave through one exploded struct: a filter on them is then not pushed below, where the optimizer would repeat
    their array expressions for every element."""
    t = F.coalesce(F.col(text), F.lit(""))
    count = lambda c: c.cast("long")
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = docs.withColumns({
        "_w": words(F.col(text)),
        "_l": lines,
        "n_symbols": count(F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", ""))),
    })
    w = F.col("_w")
    windows = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(
        F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p"))))
    out = out.withColumns({
        "n_words": count(F.size(w)),
        "word_chars": count(F.length(F.array_join(w, ""))),
        "n_dup_lines": count(F.size("_l") - F.size(F.array_distinct("_l"))),
        "_s": F.sort_array(windows),
    }).withColumn("_p", _repeated_words(w, F.col("_s")))
    p = F.col("_p")
    steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
    out = out.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    made = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))
    own = [F.col(f"`{c}`") for c in docs.columns if c not in MEASURES]
    return out.select(*own, F.explode(F.array(made)).alias("_m")).select(*own, "_m.*")


def _normal(text: str) -> Column:
    """The text's normalised lines, as many as it has lines."""
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    squeezed = F.regexp_replace(F.regexp_replace(lower, r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " "), "[0-9]+", "0")
    return F.transform(F.split(squeezed, "\n"), lambda x: F.trim(x))


def _lines(docs: DataFrame, host: str, text: str) -> DataFrame:
    """A row for each distinct normalised line of each text: host, key of the text, key of its longest line, words of its distinct lines, hash, words."""
    lines = F.array_distinct(F.filter(_normal(text), lambda x: x != ""))
    count = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    longest = F.array_max(F.transform("lines", lambda x: F.named_struct(F.lit("n"), F.length(x), F.lit("x"), x)))["x"]
    total = F.aggregate("lines", F.lit(0), lambda a, x: a + count(x))
    return (
        docs.select(F.col(host).alias("host"), text_key(F.col(text)).alias("doc"), lines.alias("lines"))
        .select("host", "doc", F.xxhash64(longest).alias("copy"), total.alias("total"), "lines")
        .select("host", "doc", "copy", "total", F.explode("lines").alias("line"))  # apart, or all is computed for each line
        .select("host", "doc", "copy", "total", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), count(F.col("line")).alias("n"))
    )


def frequent_lines(docs: DataFrame, host: str = "source", text: str = "text", min_docs: int = MIN_DOCS,
                   host_share: float = HOST_SHARE) -> DataFrame:
    """Lines (host, h1, h2) in more distinct documents of the host than max(min_docs, host_share of its documents)."""
    by = _lines(docs, host, text).groupBy("host", "h1", "h2").agg(F.count_distinct("copy").alias("n_docs")).filter(F.col("n_docs") > min_docs)
    hosts = docs.groupBy(F.col(host).alias("host_")).agg(F.count(F.lit(1)).alias("total"))
    return by.join(hosts, by.host.eqNullSafe(hosts.host_)).filter(F.col("n_docs") > host_share * F.col("total")).select("host", "h1", "h2", "n_docs")


def depleted_texts(docs: DataFrame, host: str = "source", text: str = "text", min_left: float = MIN_LEFT, **limits) -> DataFrame:
    """(host, doc) of texts that lose more than 1 - min_left of their distinct lines' words; with the words lost."""
    bad = written(frequent_lines(docs, host, text, **limits), "frequent-lines").select(F.col("host").alias("bh"), F.col("h1").alias("b1"), F.col("h2").alias("b2"))
    rows = _lines(docs, host, text)
    lost = rows.join(bad, rows.host.eqNullSafe(F.col("bh")) & (rows.h1 == F.col("b1")) & (rows.h2 == F.col("b2")), "left_semi")
    lost = lost.groupBy("host", "doc", "h1", "h2").agg(F.max("n").alias("n"), F.max("total").alias("total"))
    lost = lost.groupBy("host", "doc").agg(F.sum("n").alias("lost"), F.max("total").alias("total"))
    return written(lost.filter(F.col("total") - F.col("lost") < min_left * F.col("total")).select("host", "doc", "lost"), "depleted")


def remove_lines(docs: DataFrame, host: str = "source", text: str = "text", **limits) -> DataFrame:
    """Every row with its text less the lines above its host's limit, and n_over, the number of lines taken out."""
    bad = written(frequent_lines(docs, host, text, **limits), "frequent-lines").select(F.col("host").alias("bh"), F.col("h1").alias("b1"), F.col("h2").alias("b2"))
    rows = _lines(docs, host, text)
    own = rows.join(bad, rows.host.eqNullSafe(F.col("bh")) & (rows.h1 == F.col("b1")) & (rows.h2 == F.col("b2")), "left_semi")
    over = own.groupBy("host", "doc").agg(F.collect_set(F.struct("h1", "h2")).alias("_over"))
    over = written(over, "lines-over").withColumnsRenamed({"host": "_oh", "doc": "_od"})
    out = docs.withColumn("_key", text_key(F.col(text)))
    out = out.join(over, F.col(f"`{host}`").eqNullSafe(F.col("_oh")) & (F.col("_key") == F.col("_od")), "left")
    both = F.arrays_zip(F.split(F.col(text), "\n").alias("own"), _normal(text).alias("normal"))
    stays = F.filter(both, lambda z: ~F.array_contains("_over", F.struct(F.xxhash64(z["normal"]).alias("h1"), F.hash(z["normal"]).alias("h2"))))
    cut = F.transform(stays, lambda z: z["own"])
    made = F.when(F.col("_over").isNull(), F.struct(F.col(text).alias("t"), F.lit(0).cast("long").alias("n"))).otherwise(
        F.struct(F.array_join(cut, "\n").alias("t"), (F.size(F.split(F.col(text), "\n")) - F.size(cut)).cast("long").alias("n")))
    return out.withColumn("_made", made).withColumns({text: F.col("_made.t"), "n_over": F.col("_made.n")}).drop("_key", "_oh", "_od", "_over", "_made")


def judge(docs: DataFrame, host: str = "source", text: str = "text", **limits) -> DataFrame:
    """Every row with its measures and `kept`."""
    gone = depleted_texts(docs, host, text, **limits).select(F.col("host").alias("_gh"), F.col("doc").alias("_gd"))
    out = measure(docs, text).withColumn("_key", text_key(F.col(text)))
    out = out.join(gone, out[host].eqNullSafe(F.col("_gh")) & (F.col("_key") == F.col("_gd")), "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("_gd").isNull()).drop("_key", "_gh", "_gd")


def filter_documents(docs: DataFrame, host: str = "source", text: str = "text", **limits) -> DataFrame:
    """The rows that all rules keep, with their own columns."""
    plain = docs.select(F.col(host).alias("_host"), F.col(text).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return judge(plain, "_host", "_text", **limits).filter("kept").select("_row.*")
