"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. Words of the test items are counted over all training texts. A seed is a five-word n-gram of an item; it is rare when
   its words would meet by chance in at most MAX_CHANCE of all places (product of word shares). An item without a
   rare seed keeps all. Rarity by chance, not by count, so a passage that leaked thousands of times stays rare.
2. Every training text is searched for the rare seeds; seeds of one item that lie near each other give one passage.
3. The passage, with as many words around it as the item is long, is aligned with the item (match 2, mismatch -1,
   gap -1). It is a copy when the score reaches MIN_SCORE of the item's own, or MIN_WORDS words match.

The test set is a stated query set: it goes to the tasks in blocks of BLOCK_WORDS words at most, one pass over the texts
per block, so memory is bounded whatever its size. Nothing is kept of a text without seeds and no text is shuffled.

Edge cases: null or empty items and items shorter than the seed (whole item = one seed) are handled; items without a
word match nothing. Null texts match nothing. Repeated rows give repeated matches. Null ids are carried.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED, MAX_CHANCE, MIN_SCORE, MIN_WORDS, BLOCK_WORDS = 5, 1e-7, 0.5, 24, 2_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
TOKEN = re.compile(r"\w+")
BASE = np.uint64(0x9E3779B97F4A7C15)
Item = tuple[int, list[str]]


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


class _Hash(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for every n consecutive word hashes."""
    out = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
    for k in range(n if len(out) else 0):
        out = out * BASE + h[k:len(h) - n + 1 + k]
    return out


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman over word hashes: best score, matched words on its path, start and end in a.

    Each row carries (score, matches, start) packed in one number, so the maximum prefers score, then matches, then a later start; gaps along
    a row are resolved by a running maximum."""
    if not len(a) or not len(b):
        return 0, 0, 0, 0
    step = np.int64(1) << np.int64(42)  # score | matches (18 bits) | start (24 bits)
    unit = np.int64(1) << np.int64(24)
    at = np.arange(len(b) + 1, dtype=np.int64)
    row = np.zeros(len(b) + 1, dtype=np.int64)
    best, end = np.int64(0), 0
    for i in range(len(a)):
        same = a[i] == b
        fresh = np.int64(i)
        before = np.where(row[:-1] >= step, row[:-1], fresh)  # an alignment may start here
        diag = before + np.where(same, MATCH * step + unit, MISMATCH * step)
        up = row[1:] + GAP * step
        new = np.zeros_like(row)
        new[1:] = np.maximum(diag, up)
        new[new < step] = 0
        new = np.maximum.accumulate(new - GAP * step * at) + GAP * step * at
        new[new < step] = 0
        row = new
        top = row.max()
        if top >> np.int64(24) > best >> np.int64(24):
            best, end = top, i + 1
    return int(best >> 42), int((best >> 24) & ((1 << 18) - 1)), int(best & ((1 << 24) - 1)), end


def word_shares(docs: DataFrame, items: list[Item], text: str) -> dict[str, float]:
    """The share of all words of the training texts that each word of the items has; '' has the number of all words."""
    wanted = {w for _, ws in items for w in ws}

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        found: Counter = Counter()
        total = 0
        for frame in frames:
            for t in frame["text"]:
                ws = tokens(t)
                total += len(ws)
                found.update(filter(wanted.__contains__, ws))
        found[""] = total
        yield pd.DataFrame({"word": list(found), "n": list(found.values())}, columns=["word", "n"]).astype({"word": "object", "n": "int64"})

    rows = docs.select(F.col(text).alias("text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    n = {r["word"]: r["n"] for r in rows.collect()}  # bounded by the block's words
    total = n.get("") or 1
    return {w: c / total for w, c in n.items()} | {"": total}


def rare_seeds(items: list[Item], shares: dict[str, float], seed: int = SEED, max_chance: float = MAX_CHANCE) -> list[tuple[tuple[str, ...], int, int]]:
    """(words, item's place in the list, place in the item) of every seed that is searched for."""
    out = []
    for k, (_, ws) in enumerate(items):
        own = [(tuple(ws[p:p + seed]), k, p) for p in range(max(1, len(ws) - seed + 1))] if ws else []
        rare = [s for s in own if np.prod([shares.get(w, 0.0) for w in s[0]]) <= max_chance]
        out += rare or own
    return out


def _searcher(items: list[Item], seeds: list) -> Callable:
    lengths = sorted({len(s[0]) for s in seeds})

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = _Hash()
        index: dict[int, dict[int, list[tuple[int, int]]]] = {n: {} for n in lengths}
        for ws, k, p in seeds:
            index[len(ws)].setdefault(int(rolling(h.of(list(ws)), len(ws))[0]), []).append((k, p))
        known = {n: np.sort(np.fromiter(x, dtype=np.uint64, count=len(x))) for n, x in index.items()}
        sieve = {}
        for n, x in known.items():
            sieve[n] = np.zeros(1 << 20, dtype=bool)
            sieve[n][(x >> np.uint64(44)).astype(np.int64)] = True
        own = [h.of(ws) for _, ws in items]
        for frame in frames:
            out = []
            for doc, t in zip(frame["id"], frame["text"], strict=True):
                ws = h.of(tokens(t))
                hits: dict[int, list[tuple[int, int]]] = {}
                for n in lengths:
                    r = rolling(ws, n)
                    maybe = np.flatnonzero(sieve[n][(r >> np.uint64(44)).astype(np.int64)])
                    place = np.minimum(np.searchsorted(known[n], r[maybe]), len(known[n]) - 1)
                    for q in maybe[known[n][place] == r[maybe]]:
                        for k, p in index[n][int(r[q])]:
                            hits.setdefault(k, []).append((int(q), p))
                for k, places in hits.items():
                    out += [(doc, items[k][0], *x) for x in _passages(ws, own[k], sorted(places))]
            yield pd.DataFrame(out, columns=["id", "item_id", "start", "end", "matched", "score"])

    return search


def _passages(ws: np.ndarray, item: np.ndarray, places: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, float]]:
    """Aligned passages of one text for one item that are copies; seeds less than an item's length apart are one passage."""
    size, groups = len(item), [[places[0]]]
    for q in places[1:]:
        if q[0] - groups[-1][-1][0] > size:
            groups.append([])
        groups[-1].append(q)
    for g in groups:
        # within a group windows of a few item lengths, each overlapping the next by one item, bound the alignment
        lo, hi = max(0, g[0][0] - size), min(len(ws), g[-1][0] + 2 * size)
        step = 4 * size
        best: dict[int, tuple[int, int, int, float]] = {}
        for at in range(lo, max(lo + 1, hi - 2 * size), step):
            part = ws[at:min(hi, at + step + 2 * size)]
            score, matched, a, b = align(part, item)
            share = score / (MATCH * size)
            if share >= MIN_SCORE or matched >= MIN_WORDS:
                best[at + a] = (at + a, at + b, matched, round(share, 4))
        yield from best.values()


def _blocks(benchmark: DataFrame, id: str, text: str, most: int) -> Iterator[list[Item]]:
    """Test items in blocks; one row at a time reaches the driver."""
    block, size = [], 0
    for row in benchmark.select(F.col(id), F.col(text)).toLocalIterator():
        ws = tokens(row[1])
        if not ws:
            continue
        if block and size + len(ws) > most:
            yield block
            block, size = [], 0
        block.append((row[0], ws))
        size += len(ws)
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
            item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each copied passage: doc_id, item_id, start and end (words of the text), matched words, score (0 to 1)."""
    kind = docs.schema[id].dataType.simpleString()
    item_kind = benchmark.schema[item_id].dataType.simpleString()
    schema = f"id {kind}, item_id {item_kind}, start long, end long, matched long, score double"
    parts = []
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    for items in _blocks(benchmark, item_id, item_text, block_words):
        seeds = rare_seeds(items, word_shares(docs, items, text))
        parts.append(texts.mapInPandas(_searcher(items, seeds), schema))
    if not parts:
        parts = [texts.limit(0).select("id", F.lit(None).cast(item_kind).alias("item_id"), *[F.lit(0).cast("long").alias(c) for c in ("start", "end", "matched")], F.lit(0.0).alias("score"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("id", "doc_id")


def filter_documents(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without a copied passage. Rows with a null id stay out of the match by id and are judged by their text."""
    from contactflow.llm.common import text_key, written

    keyed = docs.select(text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    found = written(matches(keyed, benchmark, "key", "text").select(F.col("doc_id").alias("_key")).distinct(), "contaminated")
    return docs.withColumn("_own", text_key(F.col(text))).join(found, F.col("_own") == F.col("_key"), "left_anti").drop("_own")
