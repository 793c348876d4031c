"""Packing by vector bin packing with the dot-product heuristic.

Every example is a vector (tokens, segments, loss-bearing tokens); a sequence is a bin with a limit on each. An open
bin takes, among the waiting pieces that fit, the one whose vector has the largest dot product with the bin's free
capacity (both as shares of the limits), so pieces that are large where the bin is free go first. When none fits,
the best by dot product is cut to what is free and its rest waits on; what is free is thus filled to the token.

Waiting pieces are classed by vector, so a choice looks at the distinct vectors, not at all pieces. Full sequences are cut
off a long example first. A task packs the rows that it reads in pools of POOL_PIECES pieces, carries what is left to
the next pool and closes the last bin at its end: no shuffle, and memory bounded by a pool. A sequence id is the
partition and a number in it. The tail of a task is cut at powers of two, which need no padding.

Loss: a column of character spans names the parts of a text that bear loss (answers in a conversation, say). The text is cut at the spans'
borders and each part is encoded on its own, so no token stands over a border; the end token bears loss where the text's last character does.
Null spans, or no such column, put loss on all tokens; an empty array on none.

Edge cases: a null or empty text is its end token alone, with loss unless its spans are an empty array; null ids are carried; repeated rows are packed once each.
"""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS, POOL_PIECES, END_ID = 2048, 128, 2048, 4096, 1
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]


@dataclass(slots=True)
class Piece:
    """Part of an example: ids as little-endian 32-bit numbers, and which of them bear loss (one byte each; None: all)."""

    owner: object
    start: int
    total: int
    ids: bytes
    mask: bytes | None = None

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    @property
    def loss(self) -> int:
        return self.length if self.mask is None else sum(self.mask)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        mask = (None, None) if self.mask is None else (self.mask[:n], self.mask[n:])
        return Piece(self.owner, self.start, self.total, self.ids[:4 * n], mask[0]), Piece(self.owner, self.start + n, self.total, self.ids[4 * n:], mask[1])


class Packer:
    def __init__(self, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, pool: int = POOL_PIECES):
        self.limits, self.pool = np.array([max_tokens, max_segments, max_loss], dtype=np.int64), pool
        self.count = self.tokens = 0
        self._rebuild({})

    def _rebuild(self, waiting: dict[tuple[int, int, int], list[Piece]]) -> None:
        """Classes of equal pieces as rows of arrays that live across sequences; a class that empties keeps its row until half are empty."""
        self.slots = {kind: k for k, kind in enumerate(waiting)}
        self.waiting = list(waiting.values())
        self.kinds = np.zeros((max(64, 2 * len(waiting)), 3), dtype=np.int64)
        self.kinds[:len(waiting)] = np.array(list(waiting), dtype=np.int64).reshape(-1, 3)
        self.shares, self.many = self.kinds / self.limits, np.zeros(len(self.kinds), dtype=np.int64)
        self.many[:len(waiting)] = [len(x) for x in self.waiting]

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Takes a piece; yields sequences that it fills alone."""
        full = int(self.limits[0])
        while piece.length >= full:
            head, rest = piece.cut(full)
            if head.loss > self.limits[2]:
                head, rest = piece.cut(self._most(piece, full, int(self.limits[2])))
            yield [head]
            piece = rest
            if not piece.length:
                return
        while piece.loss > self.limits[2]:
            head, piece = piece.cut(self._most(piece, piece.length, int(self.limits[2])))
            yield [head]
        self._wait(piece)

    @staticmethod
    def _most(piece: Piece, room: int, loss: int) -> int:
        """The longest prefix with at most `room` tokens and `loss` loss-bearing ones."""
        if piece.mask is None:
            return min(room, loss, piece.length)
        run = np.cumsum(np.frombuffer(piece.mask[:room], dtype=np.uint8), dtype=np.int64)
        return int(np.searchsorted(run, loss, side="right"))

    def _wait(self, piece: Piece) -> None:
        kind = (piece.length, 1, piece.loss)
        k = self.slots.get(kind)
        if k is None:
            if len(self.waiting) == len(self.kinds):
                self._rebuild({c: self.waiting[k] for c, k in self.slots.items() if self.waiting[k]})
            k = self.slots[kind] = len(self.waiting)
            self.waiting.append([])
            self.kinds[k], self.shares[k] = kind, kind / self.limits
        self.waiting[k].append(piece)
        self.many[k] += 1
        self.count += 1
        self.tokens += piece.length

    def _take(self, k: int) -> Piece:
        piece = self.waiting[k].pop()
        self.many[k] -= 1
        self.count -= 1
        self.tokens -= piece.length
        return piece

    def fill(self, keep: int, last: bool = False) -> Iterator[list[Piece]]:
        """Packs until at most `keep` pieces wait. Unless it is the last call, a bin is opened only if the waiting tokens fill it."""
        while self.count > keep:
            if not last and self.tokens < self.limits[0]:
                return
            free, sequence = self.limits.copy(), []
            while free[:2].min() > 0 and self.count:  # pieces without loss still fit where no loss is free
                n = len(self.waiting)
                kinds, there = self.kinds[:n], self.many[:n] > 0
                fits = there & (kinds[:, 0] <= free[0]) & (kinds[:, 2] <= free[2])
                worth = self.shares[:n] @ (free / self.limits)
                if fits.any():
                    piece = self._take(int(np.argmax(np.where(fits, worth, -1.0))))
                else:
                    piece = self._take(int(np.argmax(np.where(there, worth, -1.0))))
                    n = self._most(piece, int(free[0]), int(free[2]))
                    if not n:
                        self._wait(piece)
                        break
                    piece, rest = piece.cut(n)
                    self._wait(rest)
                sequence.append(piece)
                free -= (piece.length, 1, piece.loss)
            yield from self._tail(sequence) if last and not self.count else [sequence]

    def _tail(self, sequence: list[Piece]) -> Iterator[list[Piece]]:
        """A last, partly filled sequence as sequences whose lengths are powers of two, largest first."""
        todo, left = list(sequence), sum(p.length for p in sequence)
        if left == self.limits[0]:
            yield sequence
            return
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            out = []
            while room:
                piece = todo.pop(0)
                if piece.length > room:
                    piece, rest = piece.cut(room)
                    todo.insert(0, rest)
                out.append(piece)
                room -= piece.length
            yield out


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def tokenizer(path: str, remembered: int = 1_000_000) -> Callable[[str], bytes]:
    """ids of a text (little-endian 32-bit) under a byte-level BPE file of the tokenizers library, without added special tokens.

    Where a space stands between two other characters that are no white space a pre-token begins, so such a text is its
    space-separated chunks, whose ids are remembered (up to a bound). Other texts, and texts that may hold a special token, are encoded whole."""
    import json
    import re
    from array import array

    import tiktoken

    file = json.loads(open(path, encoding="utf-8").read())
    letters = byte_alphabet()
    special = {x["content"]: x["id"] for x in file["added_tokens"]}
    ranks = {bytes(letters[c] for c in w): i for w, i in file["model"]["vocab"].items() if w not in special}
    # Fixed value: the pre-token pattern of byte-level BPE vocabularies.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    whole, plain = encoding.encode, encoding.encode_ordinary
    odd = re.compile("|".join([r" \s", r"\s ", "^ ", " $", *map(re.escape, special)]))

    marked = re.compile(r"([^\W\d_]+)([.,;:!?]+)")  # letters, then marks: two pre-tokens

    class Known(dict):
        def __missing__(self, chunk: str) -> bytes:
            if len(self) >= remembered:
                self.clear()
            m = marked.fullmatch(chunk)
            ids = self[m[1]] + array("I", plain(m[2])).tobytes() if m else array("I", plain(" " + chunk)).tobytes()
            self[chunk] = ids
            return ids

    known = Known()
    get = known.__getitem__

    def ids(text: str) -> bytes:
        if odd.search(text):
            return array("I", whole(text, allowed_special="all")).tobytes()
        first, *rest = text.split(" ")
        return array("I", plain(first)).tobytes() + b"".join(map(get, rest))

    return ids


def parts(text: str, spans: Iterable[tuple[int, int]]) -> Iterator[tuple[str, bool]]:
    """The text cut at the borders of the character spans (clipped and merged), each part with whether it bears loss."""
    merged: list[list[int]] = []
    for start, end in sorted((max(0, a), min(len(text), b)) for a, b in spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        elif start < end:
            merged.append([start, end])
    at = 0
    for start, end in merged:
        if start > at:
            yield text[at:start], False
        yield text[start:end], True
        at = end
    if at < len(text):
        yield text[at:], False


def masked(text: str, spans: Iterable[tuple[int, int]], ids: Callable[[str], bytes], end: bytes) -> tuple[bytes, bytes]:
    """Ids of a text with its end token, and a byte for each: whether it bears loss."""
    spans, own, mask, last = list(spans), b"", b"", False
    for part, last in parts(text, spans):
        new = ids(part)
        own, mask = own + new, mask + bytes([last]) * (len(new) // 4)
    return own + end, mask + bytes([last if text else bool(spans)])


def pack(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS,
         max_loss: int = MAX_LOSS, pool: int = POOL_PIECES, end_id: int = END_ID, loss: str | None = None) -> DataFrame:
    """A row for each piece of each document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    loss: a column array<struct<start, end>> of the characters that bear loss, from 0 and without the end."""
    if min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("each limit is 1 at least")
    kind = docs.schema[id].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        ids, packer = tokenizer(path), Packer(max_tokens, max_segments, max_loss, pool)
        number = TaskContext.get().partitionId() << 36

        def rows(sequences: Iterable[list[Piece]]) -> Iterator[tuple]:
            nonlocal number
            for sequence in sequences:
                at = 0
                for p in sequence:
                    yield p.owner, p.start, p.length, zlib.crc32(p.ids), p.total, number, at, p.loss
                    at += p.length
                number += 1

        for frame in frames:
            out: list[tuple] = []
            for owner, t, spans in zip(frame["id"], frame["text"], frame["loss"] if loss else repeat(None)):  # noqa: B905
                if spans is None:
                    own, mask = ids(t or "") + end, None
                else:
                    own, mask = masked(t or "", [(x["start"], x["end"]) for x in spans], ids, end)
                out += rows(packer.add(Piece(owner, 0, len(own) // 4, own, mask)))
                if packer.count >= pool:
                    out += rows(packer.fill(pool // 2))
            yield pd.DataFrame(out, columns=COLUMNS)
        yield pd.DataFrame(list(rows(packer.fill(0, last=True))), columns=COLUMNS)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
    own = [F.col(loss).cast("array<struct<start:long,end:long>>").alias("loss")] if loss else []
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text"), *own).mapInPandas(run, schema)
