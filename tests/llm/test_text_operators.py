"""Quality rules, line dedup, SimHash groups, decontamination and packing against brute force and odd input."""
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from contactflow.llm import decontamination as dec
from contactflow.llm import line_dedup, packing, quality_rules, queries, simhash
from tests.llm.conftest import ODD
from tests.oracle import compare, connect

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_oracles(spark, name):
    ok, msg = compare(spark, connect("0.001"), "0.001", name, queries.QUERIES[name], queries.ORACLE[name])
    assert ok, msg


def brute_base(text):
    w = (text or "").encode().split()
    win = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    cover = {k + j for k in range(len(w) - 2) if win[tuple(w[k:k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)


def test_quality_rules_on_odd_input(spark, odd, empty):
    rows = quality_rules.judge(odd.select("doc_id", "source", "text")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_base(r.text)
        assert r.kept <= (not r.base_failed)
    kept = quality_rules.filter_documents(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in rows)
    assert quality_rules.filter_documents(empty).count() == 0
    assert quality_rules.remove_lines(empty).count() == 0
    assert Counter((r.text, r.n_over) for r in quality_rules.remove_lines(odd).collect()) == Counter((r.text, 0) for r in rows)


def test_frequent_lines_deplete_only_their_documents(spark):
    filler = lambda k: " ".join(f"w{k}n{j}" for j in range(60))
    rows = [(k, f"{filler(k)}\nShared line of a host {k}", "a") for k in range(30)]
    rows += [(100 + k, "\n".join(["Accept all 12 cookies now please dear reader of this host", f"tail {k}"] * 6), "a") for k in range(30)]
    rows += [(200 + k, filler("copy") + "\n" + filler("copied"), "a") for k in range(50)]  # copies do not count against themselves
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_docs=10, host_share=0.01).collect()}
    assert all(got[k] for k in range(30)) and not any(got[100 + k] for k in range(30)) and all(got[200 + k] for k in range(50))


def test_lines_over_the_limit_are_removed(spark):
    letters = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    own = lambda k, n: " ".join(f"{letters(k)}x{letters(j)}" for j in range(n))
    notices = ["\n".join(f"Notice {c} " + " ".join(f"{c}{d}" for d in "abcdefghij") for c in "pqrstu"), "NOTICE  p " + " ".join(f"P{d}" for d in "abcdefghij")]
    rows = [(k, f"{notices[0]}\n{own(1000 + k, 20)}", "a") for k in range(30)]  # mostly notices
    rows += [(100 + k, f"{own(1100 + k, 70)}\n{notices[1]}\n\n{own(1200 + k, 90)}", "a" if k < 15 else None) for k in range(30)]
    rows += [(200 + k, f"{own(2000, 50)}\n{own(3000, 50)}\nlast {letters(k)}", "a") for k in range(30)]  # near copies
    docs = spark.createDataFrame(rows + [(900, None, "a")], "doc_id long, text string, source string")
    got = {r.doc_id: r.kept for r in quality_rules.judge(docs, min_docs=10, host_share=0.01).collect()}
    assert not any(got[k] for k in range(30)) and all(got[100 + k] and got[200 + k] for k in range(30)) and not got[900]
    left = {r.doc_id: (r.text, r.n_over) for r in quality_rules.remove_lines(docs, min_docs=10, host_share=0.01).collect()}
    assert left[900] == (None, 0)
    assert all(left[k] == (own(1000 + k, 20), 6) for k in range(30))
    assert all(left[100 + k] == (f"{own(1100 + k, 70)}\n\n{own(1200 + k, 90)}", 1) for k in range(30))
    assert all(left[i] == (t, 0) for i, t, _ in rows if i >= 200)


def brute_lines(rows):
    """Rows (id, text): text with later windows removed, in order of id, text key and place."""
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = t.split("\n")
        full = [k for k, x in enumerate(lines) if x.encode().split()]
        gone = set()
        for a, b, c in zip(full, full[1:], full[2:]):
            w = (lines[a], lines[b], lines[c])
            gone |= {a, b, c} if w in seen else set()
            seen.add(w)
        out[i, t] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup(spark, odd, empty):
    rng = random.Random(3)
    rows = [(k, "\n".join(rng.choice(["a", "b", "c", "", "d e"]) for _ in range(rng.randrange(12)))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_lines(rows)
    assert {(r.doc_id, r.text) for r in line_dedup.remove(docs).collect()} == {(i, x) for (i, _), x in want.items()}
    got = line_dedup.remove(odd).collect()
    want = brute_lines([(r.doc_id, r.text) for r in odd.collect()])
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text if r.text is None else want[r.doc_id, r.text]) for r in odd.collect())
    assert line_dedup.filter_documents(odd).columns == odd.columns and line_dedup.filter_documents(empty).count() == 0


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[k:k + 3]) for k in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute_groups(prints):
    values = sorted(set(prints.values()))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for k, a in enumerate(values):
        for b in values[k + 1:]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = defaultdict(lambda: 1 << 62)
    for d, v in prints.items():
        least[find(v)] = min(least[find(v)], d)
    return {d: least[find(v)] for d, v in prints.items()}


def test_simhash_groups(spark):
    texts = {i: t for i, t in duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    got = simhash.group(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    want = brute_groups(prints)
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{v:016x}" for i, v in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("cell", [4096, 7])
def test_bit_sliced_links_find_dense_groups(spark, cell):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    values = {s for s in seeds}
    for s in seeds[:6]:  # chains and dense groups
        v = s
        for _ in range(60):
            v ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            values.add(v)
    prints = dict(enumerate(sorted(values)))
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in prints.values()]
    roots = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"), cell)).collect()}
    want, groups = brute_groups(prints), defaultdict(set)
    for d, v in prints.items():
        s = v - (1 << 64) if v >> 63 else v
        groups[roots.get(s, s)].add(want[d])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_within_counts_exactly():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 63, 130).astype(np.uint64)
    v[64:100] = v[:36] ^ np.uint64(1 << 40) ^ np.uint64(3)
    v[100:130] = v[:30] ^ np.uint64(5)
    for radius in (0, 1, 2):
        planes = simhash.planes_of(v)
        found = simhash.within(planes, v, simhash.earlier_lanes(0, len(v), len(v), planes.shape[1]), radius)
        bits = np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")[:, : len(v)] if found is not None else np.zeros((130, 130))
        want = np.array([[i < j and int(a ^ b).bit_count() <= radius for j, b in enumerate(v)] for i, a in enumerate(v)])
        assert (bits.astype(bool) == want).all()


def test_simhash_on_odd_input(spark, odd, empty):
    rows = simhash.group(odd).collect()
    assert len(rows) == odd.count() and {r.component_id for r in rows if r.fingerprint == "0" * 16} == {0}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len({r.component_id for r in rows})
    assert simhash.group(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def brute_score(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best


def test_alignment_and_matches(spark, odd, empty):
    rng = random.Random(9)
    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        assert dec.align(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64))[0] == brute_score(a, b)
    item = [f"t{k}" for k in range(40)]
    edited = [w if k % 9 else "changed" for k, w in enumerate(item) if k % 13]
    noise = [f"n{k}" for k in range(500)]
    docs = [(1, " ".join(noise + item + noise)), (2, " ".join(noise[:90] + edited)), (3, " ".join(noise)), (4, " ".join(noise + item[:9])), (5, " ".join(item)), (6, None)]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, ""), (10, "n1 zz")], "item_id long, text string")
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    for words in (dec.BLOCK_WORDS, 1):  # all items in one block, and a block each
        got = dec.matches(docs, bench, block_words=words).filter("item_id = 7").collect()
        assert {r.doc_id for r in got} == {1, 2, 5}
        assert all((r.start, r.end) == (500, 540) for r in got if r.doc_id == 1)
    assert dec.filter_documents(odd, bench).columns == odd.columns
    assert dec.filter_documents(empty, bench).count() == 0 and dec.matches(docs, bench.limit(0)).count() == 0


def unpack(rows, docs, encode):
    ids = {i: encode(t or "") + [1] for i, t in docs}
    seqs = defaultdict(list)
    for r in rows:
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], dtype="<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seqs[r.sequence_id].append((r.offset, r.length))
    for i, x in ids.items():
        own = sorted((r.start, r.length) for r in rows if r.doc_id == i)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) == len(x)
    for s in seqs.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:]))
    return [sum(n for _, n in s) for s in seqs.values()]


def test_packing_round_trip(spark, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    docs = list(enumerate(ODD)) + [(100 + k, x) for k, (x,) in enumerate(duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall())]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    for pool in (4096, 8):
        rows = packing.pack(df, PATH, pool=pool).collect()
        sizes = unpack(rows, docs, lambda x: t.encode(x, add_special_tokens=False).ids)
        assert max(sizes) <= 2048 and sum(2048 - n for n in sizes if n & (n - 1)) < 0.02 * sum(sizes)
    assert packing.pack(empty, PATH).count() == 0


def test_packer_keeps_all_limits():
    rng = random.Random(2)
    p, out, total = packing.Packer(64, 3, 20, 10), [], 0
    for k in range(300):
        n = rng.randrange(1, 200)
        total += n
        out += list(p.add(packing.Piece(k, 0, n, bytes(4 * n), bytes(rng.random() < 0.4 for _ in range(n)))))
        if p.count >= 10:
            out += list(p.fill(5))
    out += list(p.fill(0, last=True))
    assert sum(x.length for s in out for x in s) == total
    assert all(sum(x.length for x in s) <= 64 and len(s) <= 3 and sum(x.loss for x in s) <= 20 for s in out)
