"""Language identification by a byte convolutional network in numpy.

A text's lower-cased UTF-8 bytes are cut into windows of WINDOW bytes that overlap by the widest filter less one, so
every byte of a text is scored. Filters of several widths run over the bytes, each filter's maximum over the window is
kept, and a softmax layer gives the languages. A text's log-probabilities are the mean over its windows, weighted by
their bytes. Filters act on one-hot bytes, so a filter bank is a table for each place; tables of neighbouring places are
joined into tables of byte pairs, and a width costs one gather for every two bytes.

The network is fitted on the driver on a bounded sample of labelled rows: about SAMPLE snippets of SNIPPET characters for
each language, chosen by a hash over all labelled rows. The model (under 1 MB) goes with the tasks; scoring is one pass
without a shuffle, in blocks of BATCH windows.

Edge cases: a text that is null or has no letter is `und` with score 1. Rows with a null label are not learned from, but predicted. Without
any labelled row every text is `und`. Equal texts get equal results; extra columns are kept; null ids are never learned from.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, WIDTHS, FILTERS, BATCH = 256, (2, 3, 4), 16, 256
SAMPLE, SNIPPET, EPOCHS, RATE, LANGUAGES = 1500, 256, 6, 0.01, 200
LETTER = re.compile(r"[^\W\d_]")
Model = dict[str, object]


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a text (zero-padded) and the bytes of the text in each."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)
    step = WINDOW - max(WIDTHS) + 1
    n = max(1, -(-(len(data) - (WINDOW - step)) // step))
    padded = np.zeros((n - 1) * step + WINDOW, dtype=np.uint8)
    padded[: len(data)] = data
    view = np.lib.stride_tricks.as_strided(padded, (n, WINDOW), (step, 1))
    return view.copy(), np.minimum(WINDOW, len(data) - step * np.arange(n)).astype(np.float64)


def start(languages: list[str], seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    conv = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
    return {"languages": languages, "conv": conv, "bias": np.zeros(len(WIDTHS) * FILTERS, np.float32),
            "out": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32), "out_bias": np.zeros(len(languages), np.float32)}


class Net:
    """Scoring: tables of byte pairs for every width."""

    def __init__(self, model: Model):
        self.model, self.pairs = model, {}
        for w, c in model["conv"].items():
            joined = [(c[k][:, None, :] + c[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, w - 1, 2)]
            self.pairs[w] = joined, c[-1] if w % 2 else None

    def features(self, x: np.ndarray) -> np.ndarray:
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        out = []
        for w, (joined, single) in self.pairs.items():
            n = WINDOW - w + 1
            total = np.take(joined[0], pair[:, :n], axis=0)
            for k, t in enumerate(joined[1:], 1):
                total += np.take(t, pair[:, 2 * k:2 * k + n], axis=0)
            if single is not None:
                total += np.take(single, x[:, w - 1:w - 1 + n], axis=0)
            out.append(total.max(axis=1))
        return np.maximum(np.concatenate(out, axis=1) + self.model["bias"], 0)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.features(x) @ self.model["out"] + self.model["out_bias"]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def fit(texts: list[str], labels: list[str], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """Adam on cross-entropy; a filter's gradient goes to the bytes at its maximum."""
    languages = sorted(set(labels))
    m = start(languages, seed)
    x = np.concatenate([windows_of(t)[0][:1] for t in texts])
    y = np.array([languages.index(v) for v in labels])
    rng = np.random.default_rng(seed)
    flat = {f"conv{w}": m["conv"][w] for w in WIDTHS} | {k: m[k] for k in ("bias", "out", "out_bias")}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in flat.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            b, t = x[order[at:at + 128]], y[order[at:at + 128]]
            tops, values = [], []
            for w in WIDTHS:
                n = WINDOW - w + 1
                total = sum(np.take(m["conv"][w][k], b[:, k:k + n], axis=0) for k in range(w))
                top = total.argmax(axis=1)
                tops.append(top)
                values.append(np.take_along_axis(total, top[:, None, :], axis=1)[:, 0])
            pre = np.concatenate(values, axis=1) + m["bias"]
            feat = np.maximum(pre, 0)
            z = feat @ m["out"] + m["out_bias"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = z / z.sum(axis=1, keepdims=True)
            d[np.arange(len(t)), t] -= 1
            d /= len(t)
            back = (d @ m["out"].T) * (pre > 0)
            grad = {"out": feat.T @ d, "out_bias": d.sum(axis=0), "bias": back.sum(axis=0)}
            rows, cols = np.arange(len(b))[:, None], np.broadcast_to(np.arange(FILTERS), (len(b), FILTERS))
            for i, w in enumerate(WIDTHS):
                g = np.zeros_like(m["conv"][w])
                part = back[:, i * FILTERS:(i + 1) * FILTERS]
                for k in range(w):
                    np.add.at(g[k], (b[rows, tops[i] + k], cols), part)
                grad[f"conv{w}"] = g
            step += 1
            for k, v in flat.items():
                m1, m2 = moment[k]
                m1 += 0.1 * (grad[k] - m1)
                m2 += 0.001 * (grad[k] ** 2 - m2)
                v -= rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
    return m


def sample(docs: DataFrame, label: str = "lang", id: str = "doc_id", text: str = "text", size: int = SAMPLE) -> list:
    """About `size` snippets for each of at most LANGUAGES labels, by a hash of the id; ordered, so fits repeat."""
    known = docs.filter(F.col(label).isNotNull() & F.col(id).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = known.groupBy(label).count().orderBy(F.desc("count"), label).limit(LANGUAGES).collect()  # bounded
    if not counts:
        return []
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col(label) == r[0], min(1.0, size / r["count"])).otherwise(share)
    place = F.pmod(F.xxhash64(F.lit("place"), id), F.greatest(F.length(text) - SNIPPET + 1, F.lit(1))).cast("int") + 1
    chosen = known.filter(F.pmod(F.xxhash64(F.lit("sample"), id), F.lit(1_000_000)) < share * 1_000_000)
    rows = chosen.select(F.col(id), F.col(label), F.substring(F.col(text), place, F.lit(SNIPPET)).alias("t"))
    return sorted((r for r in rows.limit(2 * size * len(counts)).collect() if LETTER.search(r["t"] or "")), key=lambda r: (r[0], r["t"]))


def scores(texts: pd.Series, net: Net | None) -> pd.DataFrame:
    langs = net.model["languages"] if net else []
    total = np.zeros((len(texts), len(langs)))
    named = np.zeros(len(texts), dtype=bool)
    waiting, owners, weights, held = [], [], [], 0

    def flush() -> None:
        nonlocal held
        if held:
            x, who, w = np.concatenate(waiting), np.concatenate(owners), np.concatenate(weights)
            for at in range(0, len(x), BATCH):
                np.add.at(total, who[at:at + BATCH], net.log_probabilities(x[at:at + BATCH]) * w[at:at + BATCH, None])
            waiting.clear(), owners.clear(), weights.clear()
            held = 0

    for k, t in enumerate(texts):
        if net and t and LETTER.search(t):
            named[k] = True
            x, n = windows_of(t)
            waiting.append(x)
            owners.append(np.full(len(x), k))
            weights.append(n / n.sum())
            held += len(x)
            if held >= 16 * BATCH:
                flush()
    flush()
    if not net:
        return pd.DataFrame({"lang": ["und"] * len(texts), "score": [1.0] * len(texts)})
    p = np.exp(total - total.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    return pd.DataFrame({"lang": [langs[b] if ok else "und" for b, ok in zip(best, named, strict=True)], "score": np.where(named, p.max(axis=1), 1.0)})


def train(docs: DataFrame, **columns) -> Model | None:
    rows = sample(docs, **columns)
    return fit([r["t"] for r in rows], [r[1] for r in rows]) if rows else None


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Every row with lang_pred and score."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net = Net(model) if model else None
        for batch in batches:
            yield scores(batch, net)

    found = F.pandas_udf(run, "lang string, score double", F.PandasUDFType.SCALAR_ITER)(F.col(text))
    return docs.withColumn("_p", found).withColumns({"lang_pred": F.col("_p.lang"), "score": F.col("_p.score")}).drop("_p")


def fold(id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null ids have none."""
    return F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(folds))
