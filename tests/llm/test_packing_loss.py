"""Packing of conversations: only answers bear loss."""
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from contactflow.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_spans_and_masks():
    assert list(packing.parts("abcdef", [(4, 9), (1, 2), (1, 3)])) == [("a", False), ("bc", True), ("d", False), ("ef", True)]
    ids = lambda x: b"\x07\x00\x00\x00" * len(x)
    assert packing.masked("abcd", [(2, 4)], ids, b"end.")[1] == b"\x00\x00\x01\x01\x01"
    assert packing.masked("abcd", [(0, 1)], ids, b"end.")[1] == b"\x01\x00\x00\x00\x00"
    assert packing.masked("abcd", [], ids, b"end.")[1] == bytes(5)
    assert packing.masked("", [], ids, b"end.") == (b"end.", b"\x00")


def test_conversations_keep_the_loss_limit(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    talks = defaultdict(list)
    for r in sorted(turns, key=lambda r: (r.conv_id, r.turn)):
        talks[r.conv_id].append((r.role, r.text or ""))
    encode, rows, want = packing.tokenizer(PATH), [], {}
    for i, talk in talks.items():
        at, spans, n, text = 0, [], 0, ""
        for role, t in talk:
            text += t + "\n"
            if role == "assistant":
                spans.append((at, len(text)))
            at = len(text)
        for part, bears in packing.parts(text, spans):
            n += bears * (len(encode(part)) // 4)
        rows.append((i, text, spans))
        want[i] = n + (bool(spans) and spans[-1][1] == len(text))
    assert any(want.values()) and any(want[i] < len(encode(t)) // 4 + 1 for i, t, _ in rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, loss array<struct<start:long,end:long>>").repartition(2)
    got = packing.pack(docs, PATH, max_tokens=512, max_loss=64, loss="loss").collect()
    loss, sequences = defaultdict(int), defaultdict(lambda: [0, 0, 0])
    for r in got:
        loss[r.doc_id] += r.loss_tokens
        sequences[r.sequence_id] = [x + y for x, y in zip(sequences[r.sequence_id], (r.length, 1, r.loss_tokens))]
    assert dict(loss) == want
    assert all(n <= 512 and k <= packing.MAX_SEGMENTS and m <= 64 for n, k, m in sequences.values())
    assert any(m == 64 and n < 512 for n, _, m in sequences.values())  # the third limit binds
    plain = packing.pack(docs.withColumn("loss", F.lit(None).cast("array<struct<start:long,end:long>>")), PATH, loss="loss")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, packing.pack(docs, PATH).collect()))
