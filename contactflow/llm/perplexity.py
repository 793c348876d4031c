"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text gives each document's perplexity.

Symbols are the bytes of the text (lower case, white space squeezed, digits to 0), so a gram of ORDER = 5 is a 40-bit number, no
vocabulary is cut and any language works. Trusted texts are those with a good quality label; one in CALIBRATION of them is
left out of the counts and sets the thresholds.

1. Counts: tasks count the grams of their trusted texts (partial sums), one aggregate adds them up. All trusted text is counted.
2. Model: continuation counts, discounts, contexts' totals and back-off weights of every order are aggregates of these counts. The
   probability of any set of grams is a chain of joins on grams and contexts, sharded by hash (`probabilities`).
3. Scoring: the most frequent grams (at most HEAD, of trusted text and of the corpus) and their log-probabilities are a bounded table that tasks
   read from the shared folder. Every other gram of a text leaves the task once, with its count, is joined with its probability, and is
   summed per text. So frequent grams, which would be hot join keys, never shuffle, and rare ones are exact.
4. A document is kept when its perplexity is at most MARGIN times its language's QUANTILE over the left-out trusted documents
   (over all documents of the language where there is none).

A Bloom filter of the trusted ids (bounded, broadcast) lets only trusted texts and a few others on; these meet their labels compressed,
which is the only shuffle of text. Edge cases: a null text, or one without a symbol, has null
perplexity and is not kept. A null language is a language of its own. Repeated rows get equal results; repeated label rows count a
text once; null ids are never trusted. Without trusted text every symbol has probability 1/256.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactflow.llm import exact_dedup
from contactflow.llm.common import run_dir, text_key, written

ORDER, HEAD, LOCAL, CALIBRATION, QUANTILE, MARGIN = 5, 1 << 20, 16, 10, 0.99, 1.25
SLOTS, MIX = 22, np.uint64(0x9E3779B97F4A7C15)
BLOCK, TEXTS = 1 << 20, 1000  # symbols, and texts' results, that a task holds at a time
SPACE, DIGIT = re.compile(r"\s+"), re.compile(r"\d")


def normal(text: str | None) -> bytes:
    return DIGIT.sub("0", SPACE.sub(" ", (text or "").lower())).strip().encode("utf-8", "replace")


def grams(data: bytes) -> np.ndarray:
    """The gram that ends at each byte; before the text stand zero bytes."""
    b = np.frombuffer(b"\0" * (ORDER - 1) + data, dtype=np.uint8).astype(np.int64)
    out = np.zeros(len(data), dtype=np.int64)
    for k in range(ORDER):
        out = (out << 8) | b[k:k + len(data)]
    return out


class Tally:
    """Counts of grams with bounded memory: a slot table for what is seen often, sorted counts for the rest."""

    def __init__(self):
        self.keys, self.counts = np.full(1 << SLOTS, -1, dtype=np.int64), np.zeros(1 << SLOTS, dtype=np.int64)

    def add(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts what has or finds a free slot; returns the others with their counts."""
        at = slot(g)
        fresh = self.keys[at] == -1
        self.keys[at[fresh]] = g[fresh]
        own = self.keys[at] == g
        self.counts += np.bincount(at[own], minlength=1 << SLOTS)
        return np.unique(g[~own], return_counts=True)

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        used = self.keys >= 0
        return self.keys[used], self.counts[used]


def slot(g: np.ndarray) -> np.ndarray:
    return ((g.astype(np.uint64) * MIX) >> np.uint64(64 - SLOTS)).astype(np.int64)


def counted(texts: DataFrame, packed: bool, least: int = 1) -> DataFrame:
    """(g, n): partial counts of the grams of a column `data` (zstd-compressed normal text, or plain text)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        tally, part, size = Tally(), [], 0

        def flush() -> pd.DataFrame:
            nonlocal part, size
            g, n = tally.add(np.concatenate(part)) if part else (np.zeros(0, np.int64),) * 2
            part, size = [], 0
            return pd.DataFrame({"g": g[n >= least], "n": n[n >= least]})

        for frame in frames:
            for d in frame["data"]:
                part.append(grams(zstandard.decompress(d) if packed else normal(d)))
                size += len(part[-1])
                if size >= BLOCK:
                    yield flush()
        yield flush()
        g, n = tally.all()
        yield pd.DataFrame({"g": g[n >= least], "n": n[n >= least]})

    return texts.select("data").mapInPandas(run, "g long, n long")


def _packed(texts: pd.Series) -> pd.Series:
    import zstandard

    return pd.Series([zstandard.compress(normal(t), 3) for t in texts], dtype=object)


class Model:
    """Counts and contexts of every order, and their discounts; `levels[k]` holds the k-grams."""

    def __init__(self, counts: DataFrame):
        self.levels: dict[int, tuple[DataFrame, DataFrame]] = {}
        own = counts
        for k in range(ORDER, 0, -1):
            if k < ORDER:
                own = written(own.groupBy(F.col("g").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("g")).agg(F.count(F.lit(1)).alias("n")), f"grams-{k}")
            d = self._discounts(own)
            left = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
            own_k = own.select("g", (F.col("n") - left).alias("rest"))
            contexts = own.groupBy(F.shiftright("g", 8).alias("c")).agg(F.sum("n").alias("total"), (F.sum(left) / F.sum("n")).alias("weight"))
            self.levels[k] = own_k, written(contexts, f"contexts-{k}")

    @staticmethod
    def _discounts(own: DataFrame) -> list[float]:
        row = own.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
        n = [0, *(row[f"n{k}"] for k in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        found = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k for k in (1, 2, 3)]
        return [min(max(d, 0.05 * k), 0.95 * k) for k, d in enumerate(found, 1)]

    def probabilities(self, wanted: DataFrame) -> DataFrame:
        """(g, p) of distinct ORDER-grams g: discounted count over the context's total, plus back-off weight times the order below.

        The suffixes wanted of each order are written going down, their probabilities going up, so no order is planned or shuffled twice."""
        wants = {ORDER: written(wanted.select("g"), "wanted")}
        for k in range(ORDER - 1, 0, -1):
            wants[k] = written(wants[k + 1].select(F.col("g").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("g")).distinct(), f"wanted-{k}")
        below = wanted.sparkSession.createDataFrame([(0, 1 / 256)], "s long, q double")
        for k in range(1, ORDER + 1):
            own, contexts = self.levels[k]
            suffix = F.col("g").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))
            rows = wants[k].join(own, "g", "left").withColumns({"s": suffix, "c": F.shiftright("g", 8)}).join(contexts, "c", "left").join(below, "s")
            p = F.coalesce(F.col("rest") / F.col("total"), F.lit(0.0)) + F.coalesce("weight", F.lit(1.0)) * F.col("q")
            found = rows.select("g", p.alias("p"))
            below = found if k == ORDER else written(found, f"probabilities-{k}").withColumnsRenamed({"g": "s", "p": "q"})
        return found


def head_of(counts: DataFrame, most: int = HEAD) -> DataFrame:
    """At most `most` grams (g): those whose count reaches the least power of two that few enough grams reach."""
    size = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    sizes = {r[0]: r[1] for r in counts.groupBy(size.alias("b")).agg(F.count(F.lit(1))).collect()}  # at most 64 rows
    total, least = 0, 64
    for b in range(63, -1, -1):
        total += sizes.get(b, 0)
        if total > most:
            break
        least = b
    return counts.filter(size >= least).select("g")


def _known(path: str) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow.parquet as pq

    from contactflow.llm.warc_index import _open

    fs, root = _open(path)
    t = pq.read_table(root, filesystem=fs, columns=["g", "l"])
    g, p = t["g"].to_numpy(), t["l"].to_numpy()
    order = np.argsort(g)
    return g[order], p[order]


def sums(docs: DataFrame, head: str, text: str = "text") -> DataFrame:
    """Every row without its text: key of the text, number of symbols, sum of known log-probabilities, other grams and their counts."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        g, p = _known(head)
        place = np.full(1 << SLOTS, -1, dtype=np.int32)
        place[slot(g)] = np.arange(len(g), dtype=np.int32)
        keys, values = np.append(g, -1), np.append(p, 0.0)
        for batch in batches:
            rows: list[tuple] = []
            for nth, t in enumerate(batch, 1):
                data, total, rest = normal(t), 0.0, []
                x = grams(data)
                for at in range(0, len(x), BLOCK):
                    part = x[at:at + BLOCK]
                    k = place[slot(part)]
                    hit = keys[k] == part
                    total += values[k[hit]].sum()
                    part = part[~hit]
                    if len(part) and len(g):
                        k = np.minimum(np.searchsorted(g, part), len(g) - 1)
                        hit = g[k] == part
                        total += p[k[hit]].sum()
                        part = part[~hit]
                    rest.append(part)
                other, n = np.unique(np.concatenate(rest), return_counts=True) if rest else (np.zeros(0, np.int64),) * 2
                rows.append((len(data), total, other, n))
                if len(rows) == TEXTS or nth == len(batch):
                    yield pd.DataFrame(rows, columns=["symbols", "known", "others", "times"])
                    rows = []

    found = F.pandas_udf(run, "symbols long, known double, others array<long>, times array<long>", F.PandasUDFType.SCALAR_ITER)(F.col(text))
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, text_key(F.col(text)).alias("key"), found.alias("s")).select(*keep, "key", "s.*")


def perplexities(docs: DataFrame, trusted: DataFrame, id: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """Every row without its text, with `perplexity` (null without a symbol). trusted: ids (column `id`) of the texts to learn from."""
    good = written(trusted.select(F.col(id).alias("_id")).distinct(), "trusted")
    own = exact_dedup.within(docs.filter(F.col(id).isNotNull()).select(F.col(id).alias("_id"), F.col(text).alias("text")), "_id", good)
    own = own.select("_id", F.pandas_udf("binary")(_packed)("text").alias("data"))
    learn = own.join(good, "_id", "left_semi")
    counts = written(counted(learn, True).groupBy("g").agg(F.sum("n").alias("n")), "gram-counts")
    corpus = counted(docs.select(F.col(text).alias("data")), False, LOCAL)
    often = written(counts.unionByName(corpus).groupBy("g").agg(F.sum("n").alias("n")), "often")
    model = Model(counts)
    place = run_dir(docs.sparkSession, "head")
    model.probabilities(head_of(often, head)).select("g", F.log("p").alias("l")).write.parquet(place)
    rows = written(sums(docs, place, text), "sums")
    rest = rows.filter(F.size("others") > 0).select("key", F.explode(F.arrays_zip("others", "times")).alias("o")).select("key", F.col("o.others").alias("g"), F.col("o.times").alias("n"))
    rest = rest.groupBy("key", "g").agg(F.max("n").alias("n"))
    rest = written(rest, "rare")
    p = model.probabilities(rest.select("g").distinct())
    rest = rest.join(p, "g").groupBy("key").agg(F.sum(F.col("n") * F.log("p")).alias("rest"))
    total = F.col("known") + F.coalesce("rest", F.lit(0.0))
    value = F.when(F.col("symbols") > 0, F.exp(-total / F.col("symbols")))
    return rows.join(rest.withColumnRenamed("key", "_k"), F.col("key") == F.col("_k"), "left").withColumn("perplexity", value).drop("key", "_k", "symbols", "known", "others", "times", "rest")


def left_out(id: str) -> Column:
    """Trusted texts that set the thresholds instead of being counted."""
    return F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(CALIBRATION)) == 0


def judge(docs: DataFrame, trusted: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE,
          margin: float = MARGIN, **options) -> DataFrame:
    """id, lang, perplexity, threshold and kept for every row."""
    good = trusted.select(F.col(id)).filter(F.col(id).isNotNull()).distinct()
    rows = written(perplexities(docs.select(id, lang, text), good.filter(~left_out(id)), id, text, **options), "perplexities")
    mark = good.filter(left_out(id)).select(F.col(id).alias("_id"), F.lit(True).alias("_set"))
    at = lambda c: F.percentile_approx(c, quantile, 10_000)
    limits = rows.join(mark, F.col(id) == F.col("_id"), "left").groupBy(F.col(lang).alias("_lang")).agg(
        (margin * F.coalesce(at(F.when(F.col("_set"), F.col("perplexity"))), at(F.col("perplexity")))).alias("threshold"))
    out = rows.join(limits, F.col(lang).eqNullSafe(F.col("_lang")), "left")
    return out.select(id, lang, "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))
