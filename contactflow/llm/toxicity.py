"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text's lower-cased words are cut into windows of WINDOW words, each STRIDE after the one before, so all words are scored
and windows overlap. A word enters as an embedding (words of the training sample; any other word has the unknown word's) plus the mean
of hashed character-trigram embeddings. Two gated recurrent units read the window forwards and backwards, attention pools their
states, a logistic layer scores the window; a text's score is its highest window's.

Fitted on the driver on a bounded sample of labelled rows: about SAMPLE texts of each label, chosen by a hash over all labelled
rows, at most SAMPLE_WINDOWS windows of each. Labels are of texts, so after a first epoch over all windows a toxic
text teaches by its highest window only, a clean one by its highest windows and a random one.

Scoring is one pass without a shuffle, in blocks of BATCH windows; the model (a few MB) goes with the tasks.

Edge cases: a null text or one without a word is one window of padding and has a score like any other. Rows with a null label are
not learned from. With labels of one kind only every score is 0. Equal texts get equal scores: windows and words
are computed in blocks of one shape, and scores are rounded to DIGITS digits before the threshold. Tokens of any length count whole; null ids are scored, not learned from.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, STRIDE, WIDTH, HIDDEN, TRIGRAMS, ATTENTION = 48, 40, 8, 8, 4096, 8
BATCH, SAMPLE, SAMPLE_WINDOWS, MIN_COUNT, VOCABULARY, EPOCHS, RATE, THRESHOLD, DIGITS = 1024, 1000, 16, 3, 20_000, 5, 0.01, 0.7, 6
WORD = re.compile(r"[^\W_]+(?:['’*@$][^\W_]+)*")
Model = dict[str, object]


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def starts(n: int) -> range:
    """First words of the windows over n words; the last window ends the text."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


def trigrams(word: str) -> list[int]:
    w = f"<{word}>"
    return [zlib.crc32(w[k:k + 3].encode("utf-8", "surrogatepass")) % TRIGRAMS for k in range(max(1, len(w) - 2))]


def start(vocabulary: list[str], seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    r = lambda *s, a=0.2: rng.normal(0, a, s).astype(np.float32)
    weights = {"word": r(len(vocabulary) + 1, WIDTH, a=0.05), "char": r(TRIGRAMS, WIDTH, a=0.05), "A": r(2 * HIDDEN, ATTENTION), "a": np.zeros(ATTENTION, np.float32),
               "v": r(ATTENTION, a=0.5), "o": r(2 * HIDDEN), "b": np.full(1, -1.0, np.float32)}
    for d in "fb":
        weights |= {f"W{d}": r(2 * WIDTH, 3 * HIDDEN), f"U{d}": r(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return {"vocabulary": {w: k + 1 for k, w in enumerate(vocabulary)}, "weights": weights}


def sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


class Words:
    """Numbers of words and, for every number, its word's embedding and trigrams. Number 0 is padding."""

    def __init__(self, model: Model):
        self.vocabulary, self.number = model["vocabulary"], {}
        self.known: list[int] = [0]
        self.parts: list[list[int]] = [[]]

    def ids(self, ws: list[str]) -> np.ndarray:
        out = np.empty(len(ws), dtype=np.int64)
        for k, w in enumerate(ws):
            n = self.number.get(w)
            if n is None:
                self.number[w] = n = len(self.known)
                self.known.append(self.vocabulary.get(w, 0))
                self.parts.append(trigrams(w))
            out[k] = n
        return out

    def trigram_rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for p in self.parts])
        return np.concatenate([np.array(p, dtype=np.int64) for p in self.parts]), np.repeat(np.arange(len(sizes)), sizes), np.maximum(sizes, 1)

    def vectors(self, w: dict[str, np.ndarray]) -> np.ndarray:
        flat, owner, sizes = self.trigram_rows()
        chars = np.stack([np.bincount(owner, weights=w["char"][flat, d], minlength=len(sizes)) for d in range(WIDTH)], axis=1) / sizes[:, None]
        out = np.concatenate([w["word"][self.known], chars], axis=1).astype(np.float32)
        out[0] = 0
        return out


def cut(ids: np.ndarray, first: range) -> np.ndarray:
    out = np.zeros((len(first), WINDOW), dtype=np.int64)
    for k, s in enumerate(first):
        part = ids[s:s + WINDOW]
        out[k, : len(part)] = part
    return out


def forward(w: dict[str, np.ndarray], table: dict[str, np.ndarray], x: np.ndarray, keep: bool = False, length: int = 0) -> tuple[np.ndarray, dict]:
    """Window scores (logits). table: for each direction the words' input projections. length: steps, at least those of the longest window."""
    n, mask = len(x), (x > 0).astype(np.float32)
    states = np.zeros((n, WINDOW, 2 * HIDDEN), dtype=np.float32)
    cache: dict = {"f": [], "b": []}
    length = length or max(1, int((x > 0).sum(axis=1).max(initial=0)))  # padding stands at the end
    for k, d in enumerate("fb"):
        h = np.zeros((n, HIDDEN), dtype=np.float32)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            p, q = table[d][x[:, t]], h @ w[f"U{d}"]
            gates = sigmoid(p[:, : 2 * HIDDEN] + q[:, : 2 * HIDDEN])
            r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(p[:, 2 * HIDDEN:] + r * q[:, 2 * HIDDEN:])
            m = mask[:, t, None]
            new = h + m * (1 - z) * (c - h)
            if keep:
                cache[d].append((t, h, r, z, c, q[:, 2 * HIDDEN:], m))
            h = new
            states[:, t, k * HIDDEN:(k + 1) * HIDDEN] = h
    states = states[:, :length]
    u = np.tanh(states @ w["A"] + w["a"])
    e = u @ w["v"] + (mask[:, :length] - 1) * 1e4
    e -= e.max(axis=1, keepdims=True)
    a = np.exp(e) * mask[:, :length]
    a /= np.maximum(a.sum(axis=1, keepdims=True), 1e-9)
    pooled = (a[:, :, None] * states).sum(axis=1)
    return pooled @ w["o"] + w["b"][0], cache | {"states": states, "u": u, "att": a, "pooled": pooled, "length": length}


def projections(w: dict[str, np.ndarray], vectors: np.ndarray, step: int = 1) -> dict[str, np.ndarray]:
    """step: rows are filled up to a multiple, so a word's projection does not depend on how many words there are."""
    vectors = np.concatenate([vectors, np.zeros((-len(vectors) % step, vectors.shape[1]), vectors.dtype)])
    return {d: vectors @ w[f"W{d}"] + w[f"c{d}"] for d in "fb"}


def gradients(w: dict[str, np.ndarray], vectors: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Cross-entropy gradients of the weights, and of the vectors of the words in x (by number)."""
    logit, c = forward(w, projections(w, vectors), x, keep=True)
    g = {k: np.zeros_like(v) for k, v in w.items() if k not in ("word", "char")}
    d = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
    g["b"][0], g["o"] = d.sum(), c["pooled"].T @ d
    dp = d[:, None] * w["o"]
    da = np.einsum("nts,ns->nt", c["states"], dp)
    de = c["att"] * (da - (c["att"] * da).sum(axis=1, keepdims=True))
    g["v"] = np.einsum("nt,nta->a", de, c["u"])
    du = de[:, :, None] * w["v"] * (1 - c["u"] ** 2)
    g["A"], g["a"] = np.einsum("nts,nta->sa", c["states"], du), du.sum(axis=(0, 1))
    ds = c["att"][:, :, None] * dp[:, None, :] + du @ w["A"].T
    dx = np.zeros((len(x), c["length"], 2 * WIDTH), dtype=np.float32)
    for k, way in enumerate("fb"):
        carry = np.zeros((len(x), HIDDEN), dtype=np.float32)
        U = w[f"U{way}"]
        for t, h, r, z, cand, q, m in reversed(c[way]):
            carry = carry + ds[:, t, k * HIDDEN:(k + 1) * HIDDEN]
            dc = carry * m * (1 - z) * (1 - cand ** 2)
            dz = carry * m * (h - cand) * z * (1 - z)
            dr = dc * q * r * (1 - r)
            dpre = np.concatenate([dr, dz, dc], axis=1)
            dq = np.concatenate([dr, dz, dc * r], axis=1)
            g[f"U{way}"] += h.T @ dq
            g[f"c{way}"] += dpre.sum(axis=0)
            xv = vectors[x[:, t]]
            g[f"W{way}"] += xv.T @ dpre
            dx[:, t] += dpre @ w[f"W{way}"].T
            carry = carry * (1 - m * (1 - z)) + dq @ U.T
    dv = np.zeros_like(vectors)
    np.add.at(dv, x[:, : c["length"]].ravel(), dx.reshape(-1, 2 * WIDTH))
    dv[0] = 0
    return g, dv


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 11) -> Model:
    tokens = [words(t) for t in texts]
    seen = Counter(w for ws in tokens for w in set(ws))
    model = start([w for w, n in sorted(seen.items(), key=lambda p: (-p[1], p[0]))[:VOCABULARY] if n >= MIN_COUNT], seed)
    w, book, rng = model["weights"], Words(model), np.random.default_rng(seed)
    x, owner = [], []
    for k, ws in enumerate(tokens):
        first = starts(len(ws))
        if len(first) > SAMPLE_WINDOWS:
            first = sorted(rng.choice(first, SAMPLE_WINDOWS, replace=False))
        x.append(cut(book.ids(ws), first))
        owner += [k] * len(first)
    x, owner = np.concatenate(x), np.array(owner)
    y = np.array(labels, dtype=np.float32)[owner]
    flat, who, sizes = book.trigram_rows()
    known = np.array(book.known)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    step = 0
    for epoch in range(epochs):
        if epoch:
            s = logits(w, projections(w, book.vectors(w)), x)
            order = np.lexsort((-s, owner))
            rank = np.empty(len(x), dtype=np.int64)
            new = np.flatnonzero(np.r_[True, owner[order][1:] != owner[order][:-1]])
            rank[order] = np.arange(len(x)) - np.repeat(new, np.diff(np.r_[new, len(x)]))
            chosen = np.flatnonzero((rank == 0) | (y == 0) & ((rank == 1) | (rng.random(len(x)) < 0.15)))
        else:
            chosen = np.arange(len(x))
        chosen = rng.permutation(chosen)
        for at in range(0, len(chosen), 128):
            part = chosen[at:at + 128]
            numbers, local = np.unique(x[part], return_inverse=True)
            if numbers[0] != 0:
                numbers, local = np.r_[0, numbers], local + 1
            local = local.reshape(len(part), WINDOW)
            lo, hi = np.searchsorted(who, numbers), np.searchsorted(who, numbers, side="right")
            rows = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])
            mine = np.repeat(np.arange(len(numbers)), hi - lo)
            chars = np.zeros((len(numbers), WIDTH), dtype=np.float32)
            np.add.at(chars, mine, w["char"][flat[rows]])
            vectors = np.concatenate([w["word"][known[numbers]], chars / sizes[numbers, None]], axis=1).astype(np.float32)
            vectors[0] = 0
            g, dv = gradients(w, vectors, local, y[part])
            g["word"], g["char"] = np.zeros_like(w["word"]), np.zeros_like(w["char"])
            np.add.at(g["word"], known[numbers[1:]], dv[1:, :WIDTH])
            np.add.at(g["char"], flat[rows], (dv[:, WIDTH:] / sizes[numbers, None])[mine])
            step += 1
            for k, v in w.items():
                m1, m2 = moment[k]
                m1 += 0.1 * (g[k] - m1)
                m2 += 0.001 * (g[k] ** 2 - m2)
                v -= rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
    return model


def logits(w: dict[str, np.ndarray], table: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Windows in blocks of one shape, so a window's score does not depend on its neighbours."""
    full = np.concatenate([x, np.zeros((-len(x) % BATCH, WINDOW), dtype=x.dtype)])
    return np.concatenate([forward(w, table, full[at:at + BATCH], length=WINDOW)[0] for at in range(0, len(full), BATCH)])[:len(x)]


def score(texts: pd.Series, model: Model | None, group: int = 500_000) -> pd.Series:
    """Scores of a batch of texts; about `group` words are held as windows at a time."""
    if model is None:
        return pd.Series(np.zeros(len(texts)))
    w, best = model["weights"], np.full(len(texts), -np.inf)
    book, x, owner, held = Words(model), [], [], 0

    def flush() -> None:
        nonlocal book, held
        if x:
            s, who = logits(w, projections(w, book.vectors(w), BATCH), np.concatenate(x)), np.concatenate(owner)
            np.maximum.at(best, who, s)
            x.clear(), owner.clear()
            book, held = Words(model), 0

    for k, t in enumerate(texts):
        ids = book.ids(words(t))
        first = starts(len(ids))
        x.append(cut(ids, first))
        owner.append(np.full(len(first), k))
        held += len(ids)
        if held >= group:
            flush()
    flush()
    return pd.Series(np.round(sigmoid(best), DIGITS))


def sample(docs: DataFrame, labels: DataFrame, id: str = "doc_id", label: str = "toxic", text: str = "text", size: int = SAMPLE) -> list:
    """About `size` texts of each label (0 and 1), by a hash of the id; the chosen labels are bounded, so they are broadcast."""
    known = labels.select(F.col(id).alias("_id"), F.col(label).cast("int").alias("_y")).filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1))
    n = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    share = F.when(F.col("_y") == 1, min(1.0, size / n.get(1, 1))).otherwise(min(1.0, size / n.get(0, 1)))
    chosen = known.filter(F.pmod(F.xxhash64(F.lit("sample"), "_id"), F.lit(1_000_000)) < share * 1_000_000).limit(3 * size)
    found = docs.select(F.col(id), F.col(text)).join(F.broadcast(chosen), F.col(id) == F.col("_id")).limit(3 * size)
    longest = 20 * SAMPLE_WINDOWS * STRIDE * 8  # characters of a sampled text that may teach
    rows = found.select("_id", "_y", F.substring(F.coalesce(F.col(text), F.lit("")), 1, longest).alias("t")).collect()
    return sorted(rows, key=lambda r: (r["_id"], r["_y"], r["t"]))


def train(docs: DataFrame, labels: DataFrame, **columns) -> Model | None:
    rows = sample(docs, labels, **columns)
    return fit([r["t"] for r in rows], [r["_y"] for r in rows]) if len({r["_y"] for r in rows}) == 2 else None


def predict(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every row with score and predicted."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield score(batch, model)

    scored = docs.withColumn("score", F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)(F.col(text)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
