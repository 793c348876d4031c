"""WARC index, page text, language identification, toxicity, perplexity and the pipeline."""
import base64
import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from contactflow.llm import html_extract, language_id, packing, perplexity, quality_rules, toxicity, warc_index
from tests.llm.conftest import ODD
from tests.llm.test_text_operators import PATH, brute_base, brute_lines

PAGES = "page_id long, url string, html string, key string"


def test_warc_round_trip(spark):
    rows = [(k, f"http://h{k % 3}.example/p?{k % 5}", t, "x") for k, t in enumerate(ODD + ["same"] * 50)] + [(900, None, "same", "x"), (None, "::odd", "same", "x")]
    for least in (0, 10):
        back = warc_index.round_trip(spark.createDataFrame(rows, PAGES).repartition(4), least).collect()
        assert Counter(r.page_id for r in back) == Counter(r[0] for r in rows)
        top = defaultdict(lambda: -1)
        for i, _, t, _ in rows:
            top[t or ""] = max(top[t or ""], -1 if i is None else i)
        for r in back:
            t = (next(x[2] for x in rows if x[0] == r.page_id) or "")
            data = t.encode()
            again = len(data) >= least and r.page_id != top[t]
            assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
            assert (r.record_type, r.refers_to) == (("revisit", top[t]) if again else ("response", None))
    assert warc_index.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_index_search_over_block_edges(spark):
    rows = [(k, f"http://{'abc'[k % 3]}.example/{k % 4}", f"body {k}", "x") for k in range(300)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    folder, directory = warc_index.run_dir(spark, "t"), warc_index.run_dir(spark, "t")
    captures = warc_index.written(warc_index.write(pages, folder), "t")
    warc_index.index(captures, folder, block=7).write.parquet(directory)
    back = warc_index.lookup(captures.select("page_id", "url"), folder, directory)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, captures.collect()))
    missing = spark.createDataFrame([(5000, "http://b.example/1"), (1, "http://zz.example/")], "page_id long, url string")
    assert warc_index.lookup(missing, folder, directory).count() == 0
    assert warc_index.surt("https://www.A.example:8080/x?q#f") == "example,a,www:8080)/x?q#f"


def test_page_text(spark):
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><header><h1>Site</h1></header>
    <div class="ad">Buy</div><article><h1>T &amp; U</h1><script>var t="</p>";</script><p>one <b>two</b>\n three<br>four<p>five &lt; 6 < 7<ul><li>a<li>b</ul>
    <aside>side</aside><form>f</form><section class="comments"><p>c</p></section><!-- x --><p>last</p></article><footer>&copy;</footer></body></html>"""
    want = "T & U\none two three four\nfive < 6 < 7\na\nb\nlast"
    assert html_extract.main_text(page) == want
    assert html_extract.main_text(page[: page.index("<ul>")]) == "T & U\none two three four\nfive < 6 < 7"
    # without a main element the host's template tells text from boiler-plate
    plain = "<html><body><div><p>Welcome to our host</p><ul><li><a href=/>Home</a></li></ul></div><div><p>Text {0} of page</p><p>More {0}</p></div><div><p>All rights</p></div></body></html>"
    rows = [(k, "http://one.example/%d" % k, plain.format(f"n{k}"), "k") for k in range(6)] + [(10, None, None, "k"), (11, "x", "", "k"), (None, "http://two.example", page, "k")]
    got = html_extract.extract(spark.createDataFrame(rows, PAGES))
    texts = {r.page_id: r.text for r in got.collect()}
    assert got.columns == ["page_id", "url", "key", "text"]
    assert all(texts[k] == f"Text n{k} of page\nMore n{k}" for k in range(6)) and texts[10] == texts[11] == "" and texts[None] == want
    assert html_extract.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_nested_classes():
    order = [(-4, 4, 1, 0.0, 10), (-4, 4, 1, 5.0, 11), (-3, 3, 2, 1.0, 20), (-3, 3, 2, 2.0, 21), (-3, 3, 3, 1.0, 30), (-3, 3, 3, 9.0, 31)]
    assert html_extract.nest([10, 20, 21, 11, 30, 31], order) == {10, 11, 20, 21, 30, 31}
    assert html_extract.nest([10, 21, 20, 11], order) == {10, 11}  # out of order
    assert html_extract.nest([10, 30, 11, 31], order) == {10, 11}  # over two slots


def read(table, sf="0.001"):
    return duckdb.sql(f"select * from '/root/testdata/sf{sf}/{table}.parquet'").df()


def test_language_id(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs.filter(language_id.fold("doc_id", 5) != 0))
    rows = language_id.predict(docs.filter(language_id.fold("doc_id", 5) == 0), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    got = language_id.predict(odd, model).collect()
    assert all((r.lang_pred == "und") == (not r.text or not any(c.isalpha() for c in r.text)) for r in got)
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"} and language_id.train(empty) is None
    x, n = language_id.windows_of("aé" * 400)
    assert n[-1] == len("aé".encode()) * 400 - (len(x) - 1) * 253 and x.shape[1] == language_id.WINDOW
    net = language_id.Net(model)  # tables of pairs give the plain convolution
    for w, c in model["conv"].items():
        plain = sum(c[k][x[:, k:k + language_id.WINDOW - w + 1]] for k in range(w)).max(axis=1)
        i = language_id.WIDTHS.index(w) * language_id.FILTERS
        assert np.allclose(np.maximum(plain + model["bias"][i:i + language_id.FILTERS], 0), net.features(x)[:, i:i + language_id.FILTERS], atol=1e-4)


def test_toxicity(spark, odd, empty):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(500):
        ws = [rng.choice(vocabulary) for _ in range(rng.randrange(10, 200))]
        if k % 3 == 0:
            ws[rng.randrange(len(ws))] = "idiot"
        rows.append((k, " ".join(ws), int(k % 3 == 0)))
    model = toxicity.fit([r[1] for r in rows[:400]], [r[2] for r in rows[:400]], epochs=8)
    docs = spark.createDataFrame(rows[400:], "doc_id long, text string, y int")
    got = toxicity.predict(docs, model).collect()
    assert np.mean([r.predicted == r.y for r in got]) > 0.95
    out = toxicity.predict(odd, model).collect()
    assert all(0 <= r.score <= 1 for r in out) and len({r.score for r in out if r.text == ODD[8]}) == 1
    assert {r.score for r in toxicity.predict(odd, None).collect()} == {0.0} and toxicity.predict(empty, model).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (4, None)], "doc_id long, toxic int")
    assert toxicity.train(odd, labels) is None
    assert [list(toxicity.starts(n)) for n in (0, 48, 49, 89)] == [[0], [0], [0, 40], [0, 40, 80]]


def brute_kneser_ney(texts):
    counts = [Counter() for _ in range(6)]
    for t in texts:
        counts[5].update(perplexity.grams(perplexity.normal(t)).tolist())
    for k in range(4, 0, -1):
        counts[k] = Counter(g & ((1 << 8 * k) - 1) for g in counts[k + 1])
    discounts = {}
    for k in range(1, 6):
        n = Counter(counts[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        discounts[k] = [0.0] + [min(max(j - (j + 1) * y * n[j + 1] / n[j] if n[j] else 0.5 * j, 0.05 * j), 0.95 * j) for j in (1, 2, 3)]
    followers = {k: defaultdict(list) for k in range(1, 6)}
    for k in range(1, 6):
        for g, c in counts[k].items():
            followers[k][g >> 8].append(c)

    def p(g, k):
        if k == 0:
            return 1 / 256
        below, own, d = p(g & ((1 << 8 * (k - 1)) - 1), k - 1), followers[k].get(g >> 8), discounts[k]
        if not own:
            return below
        c = counts[k][g]
        return ((c - d[min(c, 3)]) + sum(d[min(x, 3)] for x in own) * below) / sum(own)
    return p


@pytest.mark.parametrize("head", [1 << 20, 40])
def test_perplexity(spark, odd, empty, head):
    d, l = read("documents"), read("labels")
    docs = spark.createDataFrame(d[["doc_id", "text", "lang"]].head(80))
    trusted = spark.createDataFrame(l[l.quality == 1][["doc_id"]])
    ids = set(l[l.quality == 1].doc_id)
    p = brute_kneser_ney([t for i, t in zip(d.doc_id.head(80), d.text.head(80)) if i in ids])
    got = {r.doc_id: r.perplexity for r in perplexity.perplexities(docs, trusted, head=head).collect()}
    for i, t in list(zip(d.doc_id, d.text))[:25]:
        g = perplexity.grams(perplexity.normal(t)).tolist()
        assert got[i] == pytest.approx(math.exp(-sum(math.log(p(x, 5)) for x in g) / len(g)), rel=1e-5)
    rows = perplexity.judge(odd, trusted, head=head).collect()
    assert len(rows) == odd.count() and all(r.perplexity is not None or not r.kept for r in rows)
    assert perplexity.judge(empty, trusted.limit(0)).count() == 0
    assert perplexity.judge(docs, trusted.limit(0)).filter("abs(perplexity - 256) > 1e-6").count() == 0


def near_copies_of(texts, width=5, threshold=0.8):
    """The least id of each text's group: sets of five-word shingles, all pairs, groups as connected components."""
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        n = min(width, len(w))
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if n else set()
    group = {i: i for i in texts}
    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both >= threshold * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((group[a], group[b]))
            group = {i: x if g == y else g for i, g in group.items()}
    return group


def test_pipeline_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    d = read("documents")
    texts = dict(zip(d.doc_id.tolist(), d.text.tolist()))
    bad = {r.doc_id for r in quality_rules.judge(spark.createDataFrame(d)).filter("not kept and not base_failed").collect()}
    base = {i: brute_base(t) for i, t in texts.items()}
    texts = {i: t for i, t in texts.items() if i not in bad and base[i][0] >= 50 and 2 * base[i][4] <= base[i][0]}
    texts = {i: x for (i, t), x in brute_lines(texts.items()).items() if x == t or x.split()}
    groups = near_copies_of(texts)
    texts = {i: t for i, t in texts.items() if groups[i] == i}
    items = [t for t in read("benchmark").text]
    leaked = {i for i, t in texts.items() if any(x in t for x in items)}
    got = corpus_pipeline.run(spark, sf).collect()
    ids = packing.tokenizer(PATH)
    want = {i: len(ids(t)) // 4 + 1 for i, t in texts.items() if i not in leaked}
    found = Counter()
    for r in got:
        found[r.doc_id] += r.length
    assert dict(found) == want


def test_stages_on_odd_input(spark, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert out.columns == docs.columns and out.count() <= docs.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").count() >= docs.count()


def test_scores_are_series():
    assert len(language_id.scores(pd.Series([], dtype=object), None)) == 0 and len(toxicity.score(pd.Series([], dtype=object), None)) == 0
