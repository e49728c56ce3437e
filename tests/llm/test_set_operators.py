"""Sharding, main text, nearest neighbours, similarity join, licences and the pipeline against brute force, and on odd inputs."""

import math
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import ann, common, components, decontaminate, html_extract, html_table, license_scan, ngram_join, sharding
from weftgraph.llm.common import table

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


# sharding


def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)

    def fits(c):
        used, left = 1, c
        for s in sizes:
            if s > left:
                used, left = used + 1, c
            left -= s
        return used <= shards

    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_minimax_over_hash_order(spark, shards):
    docs = table(spark, SF, "documents")
    keyed = rows(docs.groupBy(F.substring(F.md5("text"), 1, 15).alias("k")).agg(F.sum(F.octet_length("text") + 1).alias("s")).orderBy("k").select("s"))
    got = rows(sharding.shard(docs, shards))
    loads, slots, of = {}, {}, {}
    text = dict(rows(docs.select("doc_id", "text")))
    for doc, size, crc, law, shard, slot, grown in got:
        assert size == len(text[doc].encode()) + 1 and crc == zlib.crc32(text[doc].encode()) and law == "bytes" and grown is None
        loads[shard] = loads.get(shard, 0) + size
        slots.setdefault(shard, []).append(slot)
        assert of.setdefault(text[doc], shard) == shard
    assert max(loads.values()) == least_capacity([s for (s,) in keyed], shards)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("bits,groups", [(3, 4), (3, 100), (14, 3), (2, 1)])
def test_shards_are_alike_however_ranges_are_opened(spark, monkeypatch, bits, groups):
    docs = table(spark, SF, "documents")
    want = sorted((r[0], r[4]) for r in rows(sharding.shard(docs, 5)))
    monkeypatch.setattr(sharding, "RANGE_BITS", bits)
    monkeypatch.setattr(sharding, "OPEN_GROUPS", groups)
    assert sorted((r[0], r[4]) for r in rows(sharding.shard(docs, 5))) == want


def test_shards_of_odd_rows(spark):
    odd = [(1, None, "x"), (2, "", "x"), (None, "a", "x"), (3, "b" * 100_000, "x"), (4, "c", "x"), (4, "c", "x"), (5, "é", None)]
    df = spark.createDataFrame(odd, "doc_id bigint, text string, shard string").withColumn("size", F.lit(1))
    got = {(r[0], r[1]): r for r in rows(sharding.shard(df))}
    assert got[(1, 1)][2] == 0 and got[(1, 1)][4] == got[(2, 1)][4]
    assert got[(5, 3)][2] == zlib.crc32("é".encode())
    assert sharding.shard(df).count() == 7 and sharding.shard(df.limit(0)).count() == 0


# main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">One</a></li></ul></nav><div class="ad">Buy this.</div>
<article><h1>Head &amp; tail</h1><p>First <b>bold
  text</b>.<br>More.<p>Second &copy 5 < 6 &#233;</p><ul><li>Point</li></ul><aside>Aside text of many words that is not part of it</aside></article>
<!-- c <p>no</p> --><section class="comments"><p>A reader says something rather long about all of this here.</p></section>
<form><label>Name</label></form><div id="cookie-notice">We use cookies on this site.</div><footer>End</footer></body></html>"""


def test_main_text(spark):
    want = "Head & tail\n\nFirst bold text. More.\n\nSecond © 5 < 6 é\n\nPoint"
    odd = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p"), (4, "u", "plain words only"), (5, "u", "<script>never closed"), (6, "u", "<!-- open"), (7, "u", "<a title='x>y" * 3000), (1, "u", PAGE)]
    df = spark.createDataFrame([(*r, 9) for r in odd], "page_id bigint, url string, html string, text int")
    got = {r[0]: r for r in rows(html_extract.extract(df))}
    assert got[1] == (1, "u", want, len(want))
    assert [got[k][2] for k in (2, 3, 5, 6)] == ["", "", "", ""]
    assert html_extract.extract(df).count() == len(odd) and html_extract.extract(df.limit(0)).count() == 0


def test_main_text_of_all_pages(spark):
    import html
    import re

    source = {r[0]: r[1] for r in rows(table(spark, SF, "pages").select("page_id", "html"))}
    got = rows(html_extract.extract(table(spark, SF, "pages")))
    assert len(got) == len(source)
    for page, _, text, n in got:
        inner = source[page][source[page].find("<article>") + 9 : source[page].rfind("</article>")]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner))
        assert text == "\n\n".join(p for p in parts if p)
        assert n == len(text) > 0


def decided(block_row, tree):
    node = tree
    while len(node) > 1:
        node = node[2] if block_row[node[0]] <= node[1] else node[3]
    return node[0]


def test_tree_splits_on_neighbours_and_judges_pages_it_has_not_seen():
    used = set()

    def walk(node):
        if len(node) > 1:
            used.add(html_extract.FEATURES[node[0]])
            walk(node[2])
            walk(node[3])

    tree = html_extract.trained()
    walk(tree)
    assert len([f for f in used if f.endswith(("before", "after"))]) >= 4
    right = total = 0
    for page in html_table.labelled_pages(90, seed=5):
        found = html_extract.blocks(page)
        for block, row in zip(found, html_extract.features(found)):
            right, total = right + (decided(row, tree) == block.label), total + 1
    assert right / total > 0.98


def test_features_are_those_of_the_neighbours():
    found = html_extract.blocks("<p>a b c</p><p>d <a>e</a></p><h2>f</h2><p><a>g h</a></p>")
    x = html_extract.features(found).tolist()
    assert [b.text for b in found] == ["a b c", "d e", "f", "g h"]
    assert x[1] == [2, 0.5, 3, 0, 1, 0, 0, 0, 2, 1, 0, 0, 0]
    assert x[2] == [1, 0, 2, 0.5, 2, 1, 3, 0, 0, 0, 0, 1, 0]
    marked = html_extract.blocks("<p>a</p><main><p>b</p><aside>c</aside><article>d<article>e</article></article></main><nav>f</nav>")
    assert html_extract.features(marked)[:, -3].tolist() == [-1, 1, -1, 1, -1, -1]


LONG = "The harbour was quiet in the morning and the boats lay still, while the old men sat on the wall and talked about the weather, the price of fish and the years before the war."


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<div><h2>Title</h2><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div>", ["Title", LONG, "Short one.", LONG]),
        (f"<div><a>Home</a> <a>News</a> <a>About</a></div><div><h1>On the wall</h1><p>{LONG} {LONG}</p><p>So it was.</p><p>{LONG}</p></div><div><a>One more</a> | <a>Two more</a></div><div>(c) 2020 the house</div>", ["On the wall", f"{LONG} {LONG}", "So it was.", LONG]),
        (f"<article><p>{LONG}</p><button>Go<p>{LONG}</p><svg><p>Next</p></article><div>x</div>", [LONG, LONG, "Next"]),
        (f"<article><p>{LONG}<svg><g><svg></svg></g></svg> on</p><button>a</button><p>End</p><select><option>1<option>2</select></article>", [f"{LONG} on", "End"]),
        (f"<article><p>{LONG}</p><button>x<p>kept</p><button>y</button><p>too</p><template><p>no</p></template></article>", [LONG, "kept", "too"]),
        (f"<main><p>{LONG}</p><article><p>Story</p><article>A reader's word</article></article></main>", [LONG, "Story"]),
    ],
)
def test_pages_without_class_names_and_with_open_elements(page, want):
    assert html_extract.main_text(page).split("\n\n") == want


@pytest.mark.parametrize("page", ["<button>" * 60_000, "<ul>" * 60_000 + "</div>" * 60_000, "<svg>" * 60_000, "<p><svg></p>" * 30_000, "<article>" * 60_000, "<select x" * 60_000, "<div>" * 60_000 + "<article></article>" * 60_000])
def test_odd_pages_take_no_long_time(page):
    began = time.perf_counter()
    html_extract.main_text(page)
    assert time.perf_counter() - began < 30


# nearest neighbours


def brute_nearest(ids, x, every, k):
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = (x[q] * x).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_nearest_against_brute_force(spark):
    df = table(spark, SF, "embeddings")
    data = df.orderBy("vec_id").toPandas()
    ids, x = data["vec_id"].to_numpy(), np.stack(data["embedding"]).astype(np.float32).astype(np.float64)
    want = brute_nearest(ids, x, 20, 20)
    got = {}
    for q, rank, v, s in rows(ann.nearest(df)):
        got.setdefault(q, []).append((rank, v, s))
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 21))
        assert all(abs(s - float((x[ids == q][0] * x[ids == v][0]).sum())) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & {v for v, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.9


def test_nearest_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [2.0, 0.0]), (7, [1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (20, [0.0, 3.0]), (9, [])]
    vectors += [(100 + k, [0.5, 0.5]) for k in range(60)]
    df = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id bigint, embedding array<float>, rank string")
    got = {}
    for q, rank, v, s in sorted(rows(ann.nearest(df))):
        got.setdefault(q, []).append((v, s))
    assert set(got) == {0, 20, 100, 120, 140}
    assert got[0] == [(6, 2.0), (1, 1.0), *((100 + k, 0.5) for k in range(18))]
    assert [v for v, _ in got[100]] == [20, 6, 0, 1, *range(101, 117)]  # ties to smaller ids
    assert ann.nearest(df.limit(0)).count() == 0 and ann.nearest(df.filter("vec_id < 2")).count() == 1


def test_nearest_with_repeated_rows(spark):
    rng = np.random.default_rng(3)
    vectors = [(k, rng.standard_normal(4).tolist()) for k in range(200)]
    vectors += [(1000 + k, [9.0, 9.0, 9.0, 9.0]) for k in range(40)]  # equal vectors
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    want = sorted(rows(ann.nearest(df)))
    assert {sum(r[0] == q for r in want) for q in (0, 20, 1000, 1020)} == {20}
    many = df.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(25))))
    assert sorted(rows(ann.nearest(many))) == want
    hot = df.withColumn("n", F.explode(F.sequence(F.lit(1), F.when(F.col("vec_id") == 1000, 25).otherwise(1))))
    assert sorted(rows(ann.nearest(hot))) == want
    # one id with 25 vectors of one score, and 20 other ids that score less
    same = [(1, [1.0, float(k)]) for k in range(25)] + [(k, [0.5, 0.0]) for k in range(2, 22) if k != 20] + [(20, [1.0, 0.0])]
    got = sorted(r for r in rows(ann.nearest(spark.createDataFrame(same, "vec_id bigint, embedding array<float>"))) if r[0] == 20)
    assert [r[2] for r in got] == [1, *(k for k in range(2, 22) if k != 20)]


def test_chi_square_quantiles():
    assert ann.chi_square_quantile(0.95, 8) == pytest.approx(15.507313, abs=1e-5)
    assert ann.chi_square_quantile(0.5, 2) == pytest.approx(2 * math.log(2), abs=1e-9)


# similarity join


def brute_links(texts):
    sets = [None if t is None else set(ngram_join.grams(t.encode()).tolist()) for t in texts]
    n = len(sets)
    links = [[j for j in range(n) if j != i and sets[i] is not None and sets[j] is not None and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in links[i]:
                root[j] = root[i] = min(root[i], root[j])
    return links, root


def family(seed, n, words=120, edits=2):
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in rng.integers(0, 5000, words)]
    out = []
    for _ in range(n):
        own = list(base)
        for at in rng.integers(0, words, edits):
            own[at] = f"v{rng.integers(0, 9999)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("chunk", [256, 16])
def test_similarity_join_against_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK_DOCS", chunk)
    texts = [*family(1, 60), *family(2, 25, edits=1), *["same words again and again here"] * 30, None, None, "", "", "!!", "a b", "A, b", "a b c", *family(3, 3, words=3000, edits=30)]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id bigint, text string, place string, n_links int").repartition(3)
    links, root = brute_links(texts)
    for doc, cls, n, size in rows(ngram_join.near_duplicates(df)):
        assert (n, cls, size) == (len(links[doc]), root[doc], root.count(root[doc])), texts[doc]
    kept = rows(ngram_join.one_of_each(df))
    assert len(kept) == len(set(root)) and {root[r[0]] for r in kept} == set(root) and all(r[2:] == ("x", 1) for r in kept)


def test_similarity_join_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "one two three four five six"), (None, "one two three four five six"), (1, "z")], "doc_id bigint, text string")
    assert sorted(rows(ngram_join.near_duplicates(df)), key=str) == [(1, 1, 0, 1), (None, None, 1, 2), (None, None, 1, 2)]
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0


def test_bands_reach_the_recall():
    bands, per_band = ngram_join.bands_and_rows()
    assert 1 - (1 - 0.8**per_band) ** bands >= ngram_join.RECALL and bands * per_band <= ngram_join.MAX_HASHES
    rng = np.random.default_rng(1)
    minhash, same = ngram_join.MinHash(*ngram_join.bands_and_rows()), []
    for _ in range(60):
        both, a, b = (rng.integers(0, 1 << 63, k, dtype=np.int64).astype(np.uint64) for k in (400, 50, 50))
        s = [minhash.signature(np.concatenate([both, x])) for x in (a, b)]
        same.append((s[0] == s[1]).mean())
    assert np.mean(same) == pytest.approx(0.8, abs=0.02)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), *((k, k + 1) for k in range(20, 60)), (5, 5)]
    got = dict(rows(components.components(spark.createDataFrame(edges, "a bigint, b bigint"))))
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, **{k: 20 for k in range(20, 61)}}


@pytest.mark.parametrize("order", ["descending", "shuffled"])
def test_components_of_long_paths(spark, order):
    names = [0, *range(999, 0, -1)] if order == "descending" else np.random.default_rng(5).permutation(1000).tolist()
    got = dict(rows(components.components(spark.createDataFrame(list(zip(names, names[1:])), "a bigint, b bigint"))))
    assert got == dict.fromkeys(range(1000), 0)


# licences


def test_licences_and_inheritance(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    filler = "some other words of prose that speak of nothing in particular and go on " * 3
    files = [
        ("p/LICENSE", mit), ("p/a/x.py", filler), ("p/a/b/y.py", filler), ("p/a/b/LICENSE", apache), ("p/a/b/c/z.py", filler),
        ("q/x.py", filler + "\n" + apache + "\n" + filler), ("q/y.py", filler), ("r.py", filler), ("LICENSE2", None), (None, mit), (None, ""), ("p/a/x.py", filler),
        ("s/n.py", filler + "\n" + "Licensed under CC BY-NC 4.0."), ("s/long.py", filler * 2000 + "\n" + mit),
    ]
    df = spark.createDataFrame([(k, *f, "x") for k, f in enumerate(files)], "doc_id bigint, path string, text string, license string")
    got = {r[0]: r[1:] for r in rows(license_scan.licenses(df, keep=("doc_id",)))}
    assert got[0] == ("p/LICENSE", "MIT", 1.0, "file", None)
    assert got[1][1:] == got[11][1:] == ("MIT", None, "inherited", "p/LICENSE")
    assert got[2][1:] == got[4][1:] == ("Apache-2.0", None, "inherited", "p/a/b/LICENSE")
    assert got[5][1:] == ("Apache-2.0", 1.0, "header", None)
    assert got[6][1:] == got[7][1:] == got[8][1:] == got[10][1:] == (None, None, "none", None)
    assert got[9] == (None, "MIT", 1.0, "file", None)
    assert got[12][1] == "CC-BY-NC-4.0" and got[13][1:4] == ("MIT", 1.0, "header")
    assert license_scan.licenses(df.limit(0), keep=("doc_id",)).count() == 0


MIT = """MIT License

Copyright (c) 2021 Jane Q. Example and the Frobnicator Authors

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""


def test_complete_licence_files(spark):
    docs = [(f"{SF}-{k}", t) for k, t in rows(table(spark, SF, "documents").select("doc_id", "text"))]
    whole = dict(license_scan.whole_texts())
    holder = "Copyright (c) 2019, 2020 Some Company of Somewhere\nAll rights reserved.\n\n"
    files = {"MIT": MIT, **{k: holder + " ".join(t.split(" ")) for k, t in whole.items() if k.startswith("BSD")}}
    files |= {k: "\n\n".join(" ".join(p.split()) for p in t.split("\n\n")) for k, t in whole.items() if k not in files}  # unwrapped lines
    prose = "nothing in particular is said here and it goes on like that for a while " * 3
    tree = [r for k, t in files.items() for r in ((f"{k}/LICENSE", t), (f"{k}/src/x.py", prose))]
    got = {r[0]: r[1:] for r in rows(license_scan.licenses(spark.createDataFrame(tree + docs, "path string, text string")))}
    for k in files:
        assert got[f"{k}/LICENSE"][::2] == (k, "file") and got[f"{k}/LICENSE"][1] > 0.9, k
        assert got[f"{k}/src/x.py"] == (k, None, "inherited", f"{k}/LICENSE")


def test_no_passage_is_cut_that_reaches_the_threshold():
    rare = license_scan.Scorer((("X", "alpha beta gamma delta"),), 10**6, {})
    name, score, _ = license_scan.scan_text(b"alpha beta gamma delta one two three four five", rare, 0.6)
    assert name == "X" and score == pytest.approx(math.sqrt(4 / 9))
    rng = np.random.default_rng(2)
    scorer = license_scan.Scorer((("X", "a b c c d"), ("Y", "c d e f f")), 1000, {b"c": 900, b"d": 300, b"f": 2})
    for _ in range(2000):
        line = rng.choice(list("abcdefxyzuvw"), rng.integers(1, 12))
        line = [w.encode() for w in line]
        plain = scorer.best(line)
        assert scorer.best(line, 0.6) == plain if plain[0] >= 0.6 else scorer.best(line, 0.6)[0] < 0.6


def test_licences_of_documents_against_plain_scores(spark):
    docs = table(spark, SF, "documents").withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    text = {r[0]: r[1] for r in rows(docs.select("path", "text"))}
    vocabulary = {w for _, t in license_scan.TEMPLATES for w in decontaminate.words(t.encode())}
    df = {w: sum(w in set(decontaminate.words(t.encode())) for t in text.values()) for w in vocabulary}
    idf = lambda w: math.log((1 + len(text)) / (1 + df.get(w, 0))) + 1

    def vector(run):
        v = {}
        for w in run:
            v[w] = v.get(w, 0) + idf(w)
        return v

    def cosine(a, b):
        norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
        return sum(x * b.get(w, 0) for w, x in a.items()) / (norm(a) * norm(b))

    templates = [(name, vector(decontaminate.words(t.encode()))) for name, t in license_scan.TEMPLATES]
    found = 0
    for path, name, score, origin, _ in rows(license_scan.licenses(docs)):
        best = max(((cosine(vector(run), t), k) for line in text[path].split("\n") if (run := decontaminate.words(line.encode())) for k, (_, t) in enumerate(templates)), default=(0, 0), key=lambda x: (x[0], -x[1]))
        if best[0] >= license_scan.LEAST and origin in ("header", "file"):
            assert score == pytest.approx(best[0], abs=1e-5) and name == templates[best[1]][0]
            found += 1
        else:
            assert best[0] < license_scan.LEAST
    assert found > 3


# pipeline


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline
    from weftgraph.llm import pii
    from weftgraph.llm.pretokens import Pieces
    import public_tokenizers

    docs = table(spark, SF, "documents")
    data = rows(docs.orderBy("doc_id").select("doc_id", "text"))
    _, root = brute_links([t for _, t in data])
    bench = [decontaminate.words(t.encode()) for (t,) in rows(table(spark, SF, "benchmark").select("text"))]
    windows = {tuple(b[k : k + 10]) for b in bench for k in range(len(b) - 9)}
    kept = {}
    for k, (doc, text) in enumerate(data):
        run = decontaminate.words(text.encode())
        if root[k] == k and any(map(str.isalpha, text)) and not any(tuple(run[j : j + 10]) in windows for j in range(len(run) - 9)):
            kept[doc] = pii.masked_text(text, pii.find([text])[0][1])
    tok = Pieces(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {}
    for doc, piece, start, length, *_ in rows(corpus_pipeline.run(spark, SF)):
        lengths[doc] = lengths.get(doc, 0) + length
    assert lengths == {doc: len(tok.whole(text)) + 1 for doc, text in kept.items()}
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("docs,items", [(0, 5), (40, 0), (0, 0)])
def test_pipeline_on_empty_tables(spark, tmp_path, docs, items):
    import corpus_pipeline

    table(spark, SF, "documents").orderBy("doc_id").limit(docs).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, SF, "benchmark").limit(items).coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = rows(corpus_pipeline.run(spark, str(tmp_path)))
    texts = dict(rows(table(spark, str(tmp_path), "documents").select("doc_id", "text")))
    if not docs:
        assert got == []
        return
    _, root = brute_links(list(texts.values()))
    assert {r[0] for r in got} == {d for k, (d, t) in enumerate(texts.items()) if root[k] == k and any(map(str.isalpha, t))}


def test_stages_take_odd_documents(spark):
    import corpus_pipeline

    odd = [(1, "some words of english text here", "en", "a", 5, "e"), (2, None, None, None, None, "e"), (3, "", "en", "a", 0, "e"), (1, "some words of english text here", "en", "a", 5, "e"), (None, "the other words are there", None, "b", 1, "e")]
    docs = spark.createDataFrame(odd, "doc_id bigint, text string, lang string, source string, n_chars bigint, place string")
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, SF)
            if name != "packing":
                assert out.columns == docs.columns, name
            n = out.count()
            assert n == {"language": 3, "near_copies": 4}.get(name, 5) if df is docs else n == 0, name
    common.release(spark, "pipeline")
