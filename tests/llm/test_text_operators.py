"""Token counts, packing, language ID, decontamination and PII against brute force, and on odd inputs."""

import hashlib
import random
import re
import unicodedata
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
import regex

from weftgraph.llm import common, decontaminate, lang_id, packing, pii, pretokens, token_counts
from weftgraph.llm.common import table

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "plain words here", "en", "a"),
    (2, None, None, None),
    (3, "", "fr", "a"),
    (4, "<|endoftext|> mid <|startoftext|>", "en", "b"),
    (5, "日本語 текст ñandú İstanbul ΣΑΣ ά ́x \U0001f600\U0001f600", None, "b"),
    (5, "日本語 текст ñandú İstanbul ΣΑΣ ά ́x \U0001f600\U0001f600", None, "b"),
    (None, "it's 12,345.67 \t\n\n   end   ", "en", None),
    (7, "word " * 30_000, "en", "c"),
    (8, "$$$ 123 !!!", "en", "c"),
    (9, "x" * 50_000, "de", "c"),
    (10, "\x1c\x1d \x85  a͸b", "de", "c"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_tokens string, size int, rank int, place int, words string, score string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "w", "s") for r in ODD], SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("name,pattern", [("byte_bpe_50k.json", pretokens.BYTE_LEVEL), ("word_bpe_49k.json", pretokens.WORD_END)])
def test_safe_characters_are_split_as_the_library_does(name, pattern):
    tok = pretokens.Pieces(public_tokenizers.path(name))
    for low, high in regex.findall(r"(.)-(.)", pretokens.SAFE, regex.DOTALL):
        for at in range(ord(low), ord(high) + 1, 40):
            text = " ".join(f"A{c}{c}1{c} b" for c in map(chr, range(at, min(at + 40, ord(high) + 1))))
            norm = tok.tokenizer.normalizer.normalize_str(text) if tok.tokenizer.normalizer else text
            # Spans, since the library spells pieces in its own byte alphabet.
            said = [norm[a:b] for _, (a, b) in tok.tokenizer.pre_tokenizer.pre_tokenize_str(norm)]
            assert tok.split(text) == said, hex(at)


def test_token_counts_equal_the_library(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = pretokens.Pieces(path).tokenizer
    for df in (odd, table(spark, SF, "documents")):
        got = rows(token_counts.token_counts(df, path))
        want = [(d, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t in rows(df.select("doc_id", "text"))]
        assert sorted((g[:3] for g in got), key=str) == sorted(want, key=str)
        assert all(g[3] == (g[2] > 1024) for g in got)


@pytest.mark.parametrize("words", [0, 1, 40, 400])
def test_token_counts_by_a_shuffle_of_rare_words(spark, odd, monkeypatch, words):
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(token_counts, "BROADCAST_WORDS", words)
    tok = pretokens.Pieces(path).tokenizer
    df = odd.select("doc_id", "text").unionByName(table(spark, SF, "documents").limit(60).select("doc_id", "text"))
    got = sorted((tuple(r)[:3] for r in token_counts.token_counts(df, path).collect()), key=str)
    assert got == sorted(((d, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t in rows(df)), key=str)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_each_distinct_pretoken_is_counted_once(spark, name):
    """Any text is its pre-tokens, also where the library has to split it, and their numbers of pieces sum up to its tokens."""
    path = public_tokenizers.path(name)
    tok = pretokens.Pieces(path)
    for text in [t or "" for _, t, *_ in ODD] + ["\u1c89\ua7cb \U000105c0\U00011380 x", "ΣΑΣ ΣΑς \u0130\u0307 e\u0301\u0301 \u1100\u1161\u11a8", "\U0001f468\u200d\U0001f469\u200d\U0001f467 \U0001f1e9\U0001f1ea ١٢٣ שלום ไทย हिन्दी"]:
        freq, special = token_counts.frequencies(text, path)
        numbers = dict(zip(freq, tok.numbers(list(freq))))
        assert special + sum(freq[w] * numbers[w] for w in freq) == len(tok.whole(text)), text[:40]
    common._state.clear()
    before = []
    docs = table(spark, SF, "documents").select("doc_id", "text")
    token_counts.token_counts(docs.unionByName(docs), path).collect()
    before = [p for p in common._written[(spark.sparkContext.applicationId, "queries")] if "/pieces-" in p][-1]
    pieces = spark.read.parquet(before)
    assert pieces.count() == pieces.select("word").distinct().count() > 100


def check_packing(df, got):
    tok = pretokens.Pieces(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    want = []
    for doc, text in rows(df.select("doc_id", "text")):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want.append((doc, piece, start, len(part), zlib.crc32(array("I", part).tobytes())))
    assert sorted((g[:5] for g in got), key=str) == sorted(want, key=str)
    by = {}
    for g in got:
        by.setdefault(g[5], []).append((g[6], g[3]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    return len(by), -(-sum(g[3] for g in got) // 4096)


def test_packing_is_exact_and_tight(spark, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    for df in (odd, table(spark, SF, "documents")):
        used, least = check_packing(df, rows(packing.pack(df, path)))
        assert used <= least + max(2, 0.02 * least)
    assert rows(packing.pack(odd.limit(0), path)) == []


def test_plans_place_every_piece_once():
    rng = np.random.default_rng(3)
    for trial in range(30):
        length = int(rng.choice([16, 64, 256]))
        sizes = rng.integers(1, length + 1, rng.integers(1, 400))
        histogram = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True))}
        plan = packing.best_plan(histogram, length)
        fill = {}
        ranks = {}
        for size, rank, n, first, offset in plan.runs:
            ranks.setdefault(size, []).extend(range(rank, rank + n))
            for k in range(n):
                fill.setdefault(first + k, []).append((offset, size))
        assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in histogram.items()}
        for places in fill.values():
            at = 0
            for offset, size in sorted(places):
                assert offset == at
                at += size
            assert at <= length
        assert plan.sequences == len(fill)


def test_nnls_finds_the_constrained_optimum():
    rng = np.random.default_rng(5)
    for _ in range(20):
        a, b = rng.random((6, 9)), rng.random(6)
        x = packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope <= 1e-6).all() and np.abs(slope[x > 1e-9]).max(initial=0) < 1e-6


def brute_bits(text: bytes, lang_grams, langs, seen):
    """Code lengths by walking the trees one byte at a time with plain dictionaries."""
    out = []
    for lang in langs:
        counts = [dict() for _ in range(4)]
        for code, n in zip(*lang_grams[lang]):
            g = [(int(code) >> s) & 255 for s in (24, 16, 8, 0)]
            for order in range(4):
                c = counts[order].setdefault(tuple(g[3 - order : 3]), {})
                c[g[3]] = c.get(g[3], 0) + int(n)
        total, padded = 0.0, b"   " + text
        for k in range(3, len(padded)):
            bits = 0.0
            for order in (3, 2, 1, 0):
                c = counts[order].get(tuple(padded[k - order : k]))
                if not c:
                    continue
                n, d = sum(c.values()), len(c)
                if padded[k] in c:
                    bits -= np.log2(c[padded[k]] / (n + d))
                    break
                bits -= np.log2(d / (n + d))
            else:
                bits += 8
            total += bits
        out.append(total)
    return out


def test_language_code_lengths_are_exact():
    grams = {"en": lang_id.gram_counts([b"the thing there", b"with them"]), "fr": lang_id.gram_counts(["été à la mer".encode(), b"le chat"])}
    trees = lang_id.Trees(["en", "fr"], grams)
    texts = [b"the mer", "là été zz".encode(), b"", b"q" * 40, b"thethe le chat"]
    want = np.array([brute_bits(t, grams, ["en", "fr"], None) for t in texts])
    assert np.allclose(trees.bits(texts), want, rtol=1e-5, atol=1e-4)


def test_language_of_held_out_documents(spark, odd):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    lang = dict(rows(docs.select("doc_id", "lang")))
    got = rows(lang_id.identify_languages(docs))
    for doc, held, _, score in got:
        assert held == (zlib.crc32(str(doc).encode()) % 3 == 1) and 0 <= score <= 1
    held = [(lang[d], p) for d, h, p, _ in got if h]
    assert np.mean([a == b for a, b in held]) > 0.97
    # The label of a held-out row is no input.
    from pyspark.sql import functions as F

    blind = docs.withColumn("lang", F.when(lang_id.held_out("doc_id"), None).otherwise(F.col("lang")))
    assert sorted(rows(lang_id.identify_languages(blind))) == sorted(got)
    by = {}
    for r in rows(lang_id.identify_languages(odd)):
        by.setdefault(r[0], []).append(r)
    assert by[2][0][2:] == by[3][0][2:] == by[8][0][2:] == ("und", 0.0)
    assert len(by[5]) == 2 and len(by[None]) == 1
    assert rows(lang_id.identify_languages(odd.limit(0))) == []
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r[2] for r in rows(lang_id.identify_languages(unlabelled))} == {"und"}


def test_languages_in_several_passes(spark, odd, monkeypatch):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang", "source")
    every = docs.unionByName(odd.select("doc_id", "text", "lang", "source"))
    want = sorted(rows(lang_id.identify_languages(every)), key=str)
    kept = sorted(rows(lang_id.keep_identified(every)), key=str)
    for most in (1, 30_000_000):
        monkeypatch.setattr(lang_id, "TABLE_BYTES", most)
        got = sorted(rows(lang_id.identify_languages(every)), key=str)
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert np.allclose([g[3] for g in got], [w[3] for w in want])
        assert sorted(rows(lang_id.keep_identified(every)), key=str) == kept
    langs, grams = lang_id.fit(docs)
    assert len(lang_id.language_blocks(langs, grams, 1)) == len(langs) > 2
    assert lang_id.language_blocks(langs, grams, 1 << 40) == [langs]


def test_training_texts_are_bounded_whatever_the_ids(spark):
    many = [(None, f"plain words number {k:04}", "en") for k in range(300)] + [(None, "the same again and again", "en")] * 300 + [(7, f"encore des mots {k:04}", "fr") for k in range(5)] + [(7, "encore", "fr")] * 50
    df = spark.createDataFrame(many, "doc_id bigint, text string, lang string")
    assert df.filter(~lang_id.held_out("doc_id")).count() > 300
    langs, grams = lang_id.fit(df, 10)
    assert "en" in langs and 1 < grams["en"][1].sum() <= 10 * 24
    if "fr" in langs:
        assert grams["fr"][1].sum() <= 6 * 20


def test_decontamination_finds_windows(spark, odd):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, "Zero ONE two, three four five six seven eight nine ten? no"), (2, "two three four five six seven eight nine ten ELEVEN twelve"), (3, item + " " + item), (4, "short item"), (5, "a Short-Item b"), (6, None), (7, ""), (8, "one two three four")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(10, item), (2, item), (3, "short item"), (4, None), (None, "zero one"), (5, "!!"), (6, item.split(" ")[0] + " never seen here at all by any one of them")], "item_id bigint, text string")
    got = {r[0]: r[1:] for r in rows(decontaminate.contamination(docs, bench))}
    both = hashlib.sha256(b"10,2").hexdigest()
    assert got[1] == (12, 10, 2, both, True)
    assert got[2] == (11, 10, 2, both, True)
    assert got[3] == (22, 22, 2, both, True)
    assert got[4][1:3] == (2, 1) and got[5][1:3] == (2, 1)
    empty = hashlib.sha256(b"").hexdigest()
    assert got[6] == got[7] == (0, 0, 0, empty, False) and got[8] == (4, 0, 0, empty, False)
    assert len(rows(decontaminate.contamination(odd, bench))) == len(ODD)
    assert not any(r[5] for r in rows(decontaminate.contamination(docs, bench.limit(0))))
    assert rows(decontaminate.contamination(docs.limit(0), bench)) == []
    assert sorted(r[0] for r in rows(decontaminate.keep_clean(docs, bench))) == [6, 7, 8]


def test_decontamination_in_blocks_gives_the_same(spark, monkeypatch):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    want = sorted(rows(decontaminate.contamination(docs, bench)))
    blocks = decontaminate.blocks_of
    monkeypatch.setattr(decontaminate, "blocks_of", lambda b: blocks(b, 1500))
    assert sorted(rows(decontaminate.contamination(docs, bench))) == want


def test_wu_manber_against_every_place():
    rng = random.Random(2)
    for _ in range(200):
        m = rng.randint(1, 6)
        search = decontaminate.WuManber(m)
        run = [rng.choice("abc").encode() for _ in range(60)]
        patterns = {tuple(rng.choice("abc").encode() for _ in range(m)) for _ in range(4)}
        for p in patterns:
            search.add(p, str(p))
        assert [a for a, _ in search.find(run)] == [k for k in range(61 - m) if tuple(run[k : k + m]) in patterns]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(5000):
        t = "".join(rng.choice("a1.@+-( )2%5 é\n4") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == plain_base(t), t


def test_pii_rows(spark, odd):
    docs = table(spark, SF, "documents")
    text = dict(rows(docs.select("doc_id", "text")))
    for doc, *n, sha, spans in rows(pii.personal_data(docs)):
        base = plain_base(text[doc])
        assert n == [sum(s[1] == k for s in base) for k in range(4)]
        assert sha == hashlib.sha256(pii.spelled(base).encode()).hexdigest()
        assert set(filter(None, pii.spelled(base).split(","))) <= set(filter(None, spans.split(",")))
    assert len(rows(pii.personal_data(odd))) == len(ODD)
    assert rows(pii.personal_data(odd.limit(0))) == []


def test_the_field_adds_repeats_and_lost_data_only():
    texts = [
        "call +1 (269) 555-3296 now. Later 555-3296 rings, or (269) 555-3296, not 555-1111 nor 1234567.",
        "so +1 (269) 555-3296 4524132264652876 and",
        "on 2024-01-15 at 12:30 we paid 1,299.00 for v1.2.3 with 4524132264652877 and 555-3296 @home",
        "",
        "+ @ 1 " * 2000,
    ]
    found = pii.find(texts)
    added = [[(t[s:e], pii.KINDS[k]) for s, k, e in every if (s, k, e) not in base] for t, (base, every) in zip(texts, found)]
    assert added[0] == [("555-3296", "phone"), ("(269) 555-3296", "phone")]
    assert added[1] == [("+1 (269) 555-3296", "phone"), ("4524132264652876", "card")]
    assert added[2] == added[3] == added[4] == []


def test_messages_agree_with_enumeration_on_a_small_graph():
    from itertools import product

    graph = pii.Graph()
    graph.add(0, "so +1 (269) 555-3296 xx", [])
    w, pair = pii.trained()
    p = pii.marginals(graph, w, pair, rounds=60)  # a chain, so message passing is exact
    unary, n = graph.unary(w), len(graph.at)
    exact = np.zeros((n, 5))
    for labels in product(range(5), repeat=n):
        s = sum(unary[i, y] for i, y in enumerate(labels)) + sum(pair[k][labels[a], labels[b]] for a, b, k in graph.edges)
        for i, y in enumerate(labels):
            exact[i, y] += np.exp(s)
    assert np.allclose(p, exact / exact.sum(1, keepdims=True), atol=1e-4)


@pytest.mark.parametrize("form", ["2695553296", "555-3296"])
@pytest.mark.parametrize("between", [" ", " then some words and "])
def test_evidence_reaches_every_repeat(form, between):
    repeats, evident = between.join([form] * 50), "call +1 (269) 555-3296 now"
    for text in (f"{evident}. {repeats}", f"{repeats}. So {evident}", f"{repeats}. So {evident}. {repeats}"):
        _, every = pii.find([text])[0]
        masked = pii.masked_text(text, every)
        assert "3296" not in masked and {kind for _, kind, _ in every} == {3}
    if between != " ":  # a run of such numbers side by side counts as a phone number by itself
        assert pii.find([repeats])[0] == ([], [])


@pytest.mark.parametrize("form", ["555-3296", "(269) 555-3296", "2695553296"])
def test_any_number_of_repeats_gets_the_same_label(form):
    for n in (1, 2, 3, 4, 5, 8, 10, 20, 40, 100, 250, 500):
        text = "call +1 (269) 555-3296 now." + f" Later {form} rings." * n
        base, every = pii.find([text])[0]
        assert [kind for _, kind, _ in every] == [3] * (n + 1) and len(base) == 1, n
        assert all(text[start:end] == form for start, _, end in every[1:])


def test_evident_number_without_punctuation():
    text = "at +1 (555) 234-5678 or 5552345678 by day"
    assert [text[a:b] for a, _, b in pii.find([text])[0][1]] == ["+1 (555) 234-5678", "5552345678"]


def test_messages_on_a_loop_settle_near_enumeration():
    from itertools import product

    graph = pii.Graph()
    text = "so 5553296 1115553296 5553296 at"  # chains of three, an equal and two similar links: a graph with loops
    graph.add(0, text, [])
    assert len(graph.edges) > len(graph.at) - 1
    w, pair = pii.trained()
    w, pair = w * 0.5, pair * 0.2  # weak enough that loopy marginals are near the exact ones
    p = pii.marginals(graph, w, pair)
    unary, n = graph.unary(w), len(graph.at)
    exact = np.zeros((n, 5))
    for labels in product(range(5), repeat=n):
        s = sum(unary[i, y] for i, y in enumerate(labels)) + sum(pair[k][labels[a], labels[b]] for a, b, k in graph.edges)
        for i, y in enumerate(labels):
            exact[i, y] += np.exp(s)
    exact /= exact.sum(1, keepdims=True)
    assert np.abs(p - exact).max() < 0.05 and (p.argmax(1) == exact.argmax(1)).all()


def plain_find(text, least=pii.LEAST):
    """Added spans by plain message passing: parallel rounds over dictionaries, a field of its own links."""
    w, pair = pii.trained()
    base, graph = plain_base(text), pii.Graph()
    graph.add(0, text, base)
    n = len(graph.at)
    unary = graph.unary(w)
    held = [any(s < e2 and e > s2 for s, _, e in base) for _, s2, e2 in graph.at]
    near = {i: [] for i in range(n)}
    for a, b, kind in graph.edges:
        near[a].append((b, pair[kind]))
        near[b].append((a, pair[kind].T))
    sent = {(a, b): np.zeros(5) for a in near for b, _ in near[a]}
    for _ in range(3000):
        new = {}
        for a in near:
            for b, t in near[a]:
                x = unary[a] + (0 if held[a] else sum((sent[c, a] for c, _ in near[a] if c != b), np.zeros(5)))
                z = x[:, None] + t
                m = np.log(np.exp(z - z.max(0)).sum(0)) + z.max(0)
                new[a, b] = sent[a, b] + 0.5 * (m - m.max() - sent[a, b])
        change = max((np.abs(new[k] - sent[k]).max() for k in new), default=0)
        sent = new
        if change < 1e-7:
            break
    label = {}
    for a in range(n):
        belief = unary[a] + sum((sent[c, a] for c, _ in near[a]), np.zeros(5))
        p = np.exp(belief - belief.max())
        p /= p.sum()
        if not held[a] and p[1:].max() >= least:
            label[a] = int(p[1:].argmax())
    spans, chained = list(base), {(a, b) for a, b, kind in graph.edges if kind == 0}
    for a in sorted(label):
        if a - 1 in label and label[a - 1] == label[a] and (a - 1, a) in chained:
            start, kind, _ = spans.pop()
            spans.append((start, kind, graph.at[a][2]))
        else:
            spans.append((graph.at[a][1], label[a], graph.at[a][2]))
    return sorted(spans)


def test_added_spans_against_plain_message_passing(spark):
    text = dict(rows(table(spark, SF, "documents").filter("text rlike '[0-9@]'").select("doc_id", "text")))
    found = {doc: spans for doc, *_, spans in rows(pii.personal_data(table(spark, SF, "documents")))}
    checked = added = 0
    for doc, t in text.items():
        if t and len(pii.tokens(t)) <= 60:
            want = plain_find(t)
            assert found[doc] == pii.spelled(want), doc
            checked, added = checked + 1, added + (len(want) > len(plain_base(t)))
    assert checked > 10
    for t in ("so +1 (269) 555-3296 4524132264652876 and 555-3296 or (269) 555-3296", "a@b.org then a@b.org x A@B.org 10.1.2.3 10.1.2.3"):
        assert pii.find([t])[0][1] == plain_find(t)


def test_evidence_passes_a_long_chain():
    graph = pii.Graph()
    graph.add(0, " ".join(["+1 (269) 555-3296", *["7777777"] * 300]), [(0, 3, 17)])
    w, pair = pii.trained()
    w, same = np.zeros_like(w), np.stack([np.eye(5) * 12] * 3)
    assert pii.marginals(graph, w, same)[:, 4].min() > 0.9


def test_masking_keeps_rows_and_columns(spark, odd):
    docs = spark.createDataFrame([(1, "mail a@b.org and a@b.org now", "x", 28), (2, None, None, None), (3, "clean text", "y", 10)], "doc_id bigint, text string, note string, n_chars bigint")
    got = sorted(rows(pii.mask(docs, chars_col="n_chars")))
    assert got == [(1, "mail <EMAIL> and <EMAIL> now", "x", 28), (2, None, None, None), (3, "clean text", "y", 10)]
    assert unicodedata.name("é")
