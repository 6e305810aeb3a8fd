"""Line dedup, leaks, secrets, packing, fingerprints and page texts against plain code."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from feedloom.llm import extract, leaks, lines, packing, secrets, winnow

BPE = public_tokenizers.path("byte_bpe_50k.json")


# --- lines --------------------------------------------------------------------------------
def test_lines_above_the_ratio_go(spark):
    rows = [(i, "s", f"Menu \nown {i}\n\nMenu\nrare" if i < 4 else f" Menu\nown {i}", "x") for i in range(10)]
    rows += [(20, None, "Menu\nkept", "y"), (21, "t", None, "y"), (22, "t", "", "y"), (23, "s", "Menu", "z")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, host string")
    got = {r.doc_id: (r.text, r.host) for r in lines.dedup_lines(df, ratio=0.5, min_pages=3).collect()}
    assert got[0] == ("own 0\n\nrare", "x") and got[9] == ("own 9", "x")
    assert got[20] == ("Menu\nkept", "y") and got[21] == (None, "y") and got[22] == ("", "y") and got[23] == ("", "z")
    assert lines.dedup_lines(df.limit(0)).count() == 0
    assert lines.dedup_lines(df).columns == df.columns


def test_copies_are_one_page(spark):
    body = [f"line {k} of a copied text with words of its own" for k in range(20)]
    rows = [(i, "s", f"Menu\nown {i} " + "w" * 60) for i in range(50)]
    rows += [(100 + i, "s", "\n".join(["Menu", *body])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}
    assert got == {i: f"own {i} " + "w" * 60 for i in range(50)} | {100 + i: "\n".join(body) for i in range(30)}
    salted = lines.BROADCAST
    try:
        lines.BROADCAST = 0
        assert {r.doc_id: r.text for r in lines.dedup_lines(df).collect()} == got
    finally:
        lines.BROADCAST = salted


def test_near_copies_keep_one_whole_text(spark):
    """The line stage leaves near copies whole but for their menu, and near-dedup keeps one of them."""
    rng = random.Random(11)
    near = [" ".join(rng.choices([f"n{j}" for j in range(900)], k=9)) for _ in range(20)]
    rows = [(i, "s", f"Menu\nown {i} " + " ".join(f"u{i}x{j}" for j in range(12)), i) for i in range(100)]
    rows += [(200 + i, "s", "\n".join(["Menu", *near[: i % 20], f"edit {i}", *near[i % 20 + 1 :]]), i) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars int")
    cleaned = corpus_pipeline.line_stage(spark, df, "")
    got = {r.doc_id: r for r in cleaned.collect()}
    assert cleaned.columns == df.columns and all(got[i].n_chars == len(got[i].text) for i in got)
    assert all(got[r[0]].text == r[2].removeprefix("Menu\n") for r in rows)
    kept = [r.doc_id for r in corpus_pipeline.neardup_stage(spark, cleaned, "").collect()]
    assert sorted(kept) == [*range(100), 200]


# --- leaks --------------------------------------------------------------------------------
def _distance(pattern, text):
    """Least edit distance of the pattern to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def _edited(rng, text, edits):
    for _ in range(edits):
        i = rng.randrange(len(text))
        text = text[:i] + rng.choice(["", "x", "zé", text[i] + "q"]) + text[i + rng.randint(0, 1) :]
    return text


def test_short_items_and_items_without_id(spark):
    """A short item counts where it stands between word boundaries, an item without an id as any other."""
    long = "an item that has no id and is certainly longer than forty characters"
    items = [(1, "Capital of Peru?"), (2, "no"), (None, long), (None, "(x)")]
    texts = ["tell the capital  OF peru? now", "capital of peru", "nor know", "say no.", f"<<{long.replace('certainly', 'certainli')}>>", "f(x)", "a no (x) b", long, "kno"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in leaks.find_leaks(docs, benchmark).collect()}
    assert got == {(0, 1, 0), (3, 2, 0), (4, None, 1), (4, 2, 0), (5, None, 0), (6, 2, 0), (6, None, 0), (7, None, 0), (7, 2, 0)}
    assert sorted(r.doc_id for r in leaks.without_leaks(docs, benchmark).collect()) == [1, 2, 8]


def test_leaks_equal_dynamic_programming(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randint(9, 16)))) for i in range(12)] + [(50, "Short one"), (51, None), (52, "  ")]
    docs = [(0, None), (1, ""), (2, "short  ONE"), (3, "a short one inside")]
    for d in range(4, 90):
        parts = [" ".join(word() for _ in range(8))]
        for _ in range(rng.randint(0, 2)):
            parts += [_edited(rng, items[rng.randrange(12)][1], rng.randint(0, 8)).upper(), " \n ".join(word() for _ in range(5))]
        docs.append((d, " ".join(parts)))
    docs.append((4, docs[4][1]))
    got = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_chars=300)
    want = []
    for d, text in docs:
        for i, item in items:
            item, t = leaks.normalized(item), leaks.normalized(text)
            if not item or not t:
                continue
            if len(item) < leaks.MIN_CHARS:
                want += [(d, i, 0)] if re.search(rf"(?<!\w){re.escape(item)}(?!\w)", t) else []
            elif (n := _distance(item, t)) <= int(len(item) * leaks.ERROR_RATE):
                want.append((d, i, n))
    found = sorted((r.doc_id, r.item_id, r.distance) for r in got.collect())
    assert found == sorted(want) and len(want) > 40
    kept = leaks.without_leaks(spark.createDataFrame(docs, "doc_id long, text string").withColumn("hits", F.lit(1)), spark.createDataFrame(items, "item_id long, text string"), block_chars=300)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in {w[0] for w in want})
    assert leaks.find_leaks(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


# --- secrets ------------------------------------------------------------------------------
def test_base_spans():
    text = "é Password: 'abc_1x' token=ab TOKEN = \"" + "a1" * 12 + "\" api-key=no APIKEY:zzzzzz AKIA" + "A" * 16 + " AKIAB"
    spans = secrets.base_spans(text)
    assert [(k, text[a:b]) for a, _, k, b in spans] == [
        ("assign", "Password: 'abc_1x"), ("assign", "TOKEN = \"" + "a1" * 12), ("hex", "a1" * 12), ("assign", "APIKEY:zzzzzz"), ("access", "AKIA" + "A" * 16)
    ]
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    assert [(a, b) for a, _, k, b in spans if k == "assign"] == [m.span() for m in pattern.finditer(text) if len(m[2]) >= 6]


def _secret_docs(rng, n):
    words = ["the", "of", "report", "Paris", "city", "value", "and", "year", "2024", "3.5"]
    docs = []
    for i in range(n):
        parts = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if i % 3 == 0:
            value = "".join(rng.choice("0123456789abcdef") for _ in range(40))
            parts.insert(rng.randrange(len(parts)), f'token = "{value}"')
        docs.append((i, " ".join(parts)))
    return docs


def test_tagger_marks_values_that_no_pattern_names(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame(_secret_docs(rng, 600), "doc_id long, text string")
    field = secrets.fit(docs)
    rows = field.rows()
    value = "".join(rng.choice("0123456789abcdef") for _ in range(40)).upper()
    text = f'the city and token = "{value}" of the year'
    hidden = f'report of token > "{value}" and the city'
    assert secrets.base_spans(hidden) == []
    assert [text[a:b] for a, b in secrets.tagged_spans(text.replace(value, value.lower()), field, rows)] == [value]  # same places
    assert secrets.tagged_spans("the city of Paris and the report of 2024", field, rows) == []
    held = _secret_docs(rng, 90)
    right = sum(
        [held[i][1][a:b] for a, b in secrets.tagged_spans(held[i][1], field, rows)] == re.findall(r'token = "([0-9a-f]{40})"', held[i][1]) for i in range(90)
    )
    assert right >= 86


def test_sample_is_the_first_different_windows(spark, monkeypatch):
    """However often texts repeat and however many tasks there are, the field sees the first windows by hash, each once."""
    docs = _secret_docs(random.Random(5), 400)
    df = spark.createDataFrame(docs + docs[:1] * 300, "doc_id long, text string").repartition(16)
    columns = "secret boolean, place long, tokens array<string>, labels array<int>, file array<int>"
    all_windows = {(r.secret, r.place): (r.tokens, r.labels, r.file) for r in df.select("text").mapInArrow(secrets._windows, columns).collect()}
    want = [all_windows[k] for secret in (True, False) for k in sorted(k for k in all_windows if k[0] == secret)[:20]]
    seen = []
    monkeypatch.setattr(secrets, "fit_windows", lambda windows: seen.extend(windows))
    secrets.fit(df, sample=40)
    assert [tuple(w) for w in seen] == want
    assert secrets._shape("a1" * 100) != secrets._shape("a1" * 32 + "a" * 136)  # the whole token counts


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(3)
    moves = rng.normal(size=(3, 3))
    moves[0, 2] = -1e4
    for n in (1, 2, 5):
        emission = rng.normal(size=(n, 3)) * 2

        def score(path, emission=emission):
            return sum(moves[a, b] for a, b in zip((0, *path), path, strict=False)) + sum(emission[i, y] for i, y in enumerate(path))

        paths = [tuple(p) for p in np.ndindex(*(3,) * n)]
        assert tuple(secrets._viterbi(emission, moves)) == max(paths, key=score)


def test_scan_rows(spark):
    rows = [(1, "token = abcdef1"), (1, "token = abcdef1"), (None, None), (3, ""), (4, "x" * 300_000 + " secret:abcdefg")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, spans int")
    got = sorted(((r.doc_id or 0, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.scan(df).collect()))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    one = (1, 1, 0, 0, digest("assign:0:15"))
    assert got == [(0, 0, 0, 0, digest("")), one, one, (3, 0, 0, 0, digest("")), (4, 1, 0, 0, digest("assign:300001:300015"))]
    assert secrets.scan(df.limit(0)).count() == 0


# --- packing ------------------------------------------------------------------------------
def test_encoder_equals_tokenizers():
    rng, reference, encode = random.Random(5), Tokenizer.from_file(BPE), packing.load_encoder(BPE)
    pool = ["the ", "don't", " ñandú", "  \n\n", "\t", "123", "٣", "²", "_x", "😀", "<|endoftext|>", "é", " ", " ", "\x1c", "###", "'s", "I'LL", "日本語", "\r\n", "-", "​"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(400)]
    for text in texts:
        assert encode(text).tolist() == reference.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("text", ["a" + " " * 2_000_000 + "b", "\n" * 1_200_000, "x<|endoftext|>" + " \t" * 1_000_000 + "don't", "a" * 1_100_000])
def test_encoder_reads_long_runs(text):
    assert packing.load_encoder(BPE)(text).tolist() == Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids


def test_pieces_cover_all_documents(spark):
    rng, reference = random.Random(6), Tokenizer.from_file(BPE)
    texts = [None, "", "one", " ".join(rng.choice(["alpha", "beta", "été"]) for _ in range(9000))] + [
        " ".join(rng.choice(["red", "green", "blue,"]) for _ in range(rng.randint(1, 900))) for _ in range(60)
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, "one"), (None, "none")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, start int").repartition(3)
    pieces = packing.pack_documents(df, BPE).collect()
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for group in by_sequence.values():
        group.sort(key=lambda p: p.offset)
        assert [p.offset for p in group] == [sum(q.length for q in group[:k]) for k in range(len(group))]
        assert sum(p.length for p in group) <= 1024 and len(group) <= packing.SEGMENTS
    for doc_id, text in rows:
        ids = np.array([*reference.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((p for p in pieces if p.doc_id == doc_id), key=lambda p: p.start)
        copies = rows.count((doc_id, text))
        assert sum(p.length for p in mine) == copies * len(ids) and {p.doc_tokens for p in mine} == {len(ids)}
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in mine)
    assert packing.pack_documents(df.limit(0), BPE).count() == 0


def test_bins_keep_all_limits():
    rng = np.random.default_rng(7)
    demand = np.stack([rng.integers(1, 700, 500), np.ones(500, int), rng.integers(0, 300, 500)], 1).astype(float)
    limits = np.array([1024.0, 3.0, 400.0])
    bins, places = packing.dot_product_bins(demand, limits)
    for b in range(bins.max() + 1):
        assert (demand[bins == b].sum(0) <= limits).all()
        assert sorted(places[bins == b]) == list(range((bins == b).sum()))
    assert bins.max() + 1 <= 1.15 * max(demand.sum(0) / limits) + 1
    with pytest.raises(ValueError, match="exceeds"):
        packing.dot_product_bins(np.array([[2000.0, 1, 1]]), limits)


# --- fingerprints -------------------------------------------------------------------------
def test_loss_limit_binds(spark):
    rng = random.Random(7)
    rows = [(i, n := rng.randint(10, 60), 1, rng.randint(n // 2, n)) for i in range(300)]
    df, limits = spark.createDataFrame(rows, "row long, length long, segments long, loss long"), {"length": 200, "segments": 8, "loss": 60}
    sums = packing.pack(df, limits).groupBy("sequence_id").agg(*(F.sum(c).alias(c) for c in limits), F.count("*").alias("n")).collect()
    assert sum(r.n for r in sums) == 300 and all(r[c] <= most for r in sums for c, most in limits.items())
    free = packing.pack(df, limits | {"loss": 200}).groupBy("sequence_id").agg(F.sum("loss").alias("loss")).collect()
    assert max(r.loss for r in free) > 60 and len(free) < len(sums)


def _picks(hashes, window):
    out = []
    for s in range(max(1, len(hashes) - window + 1) if hashes else 0):
        best = min(range(s, min(len(hashes), s + window)), key=lambda k: (hashes[k], -k))
        if best not in out:
            out.append(best)
    return out


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(a) for _ in range(n)) for n in (0, 1, 15, 16, 17, 46, 47, 48, 79, 200, 700) for a in ("ab", "abcdefgh é😀 ", "a")]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "i int, t string").withColumn("p", winnow.rendered(winnow.winnowed(F.col("t").cast("binary"))))
    got = {r.i: r.p for r in df.collect()}
    rows = [(i, t.encode()) for i, t in rows]
    grams = [(i, k, t[k : k + 16]) for i, t in rows for k in (range(max(1, len(t) - 15)) if t else ())]
    hashed = spark.createDataFrame(grams, "i int, k int, g binary").select(
        "i", "k", F.shiftright(F.xxhash64("g").bitwiseAND(F.lit(winnow._HASH)), 32).alias("h")
    )
    h = {(r.i, r.k): r.h for r in hashed.collect()}
    for i, t in rows:
        own = [h[i, k] for k in range(max(1, len(t) - 15))] if t else []
        assert got[i] == ",".join(f"{own[k] - 1:x}:{k}" for k in _picks(own, 32))


def test_reused_picks_equal_fresh_ones(spark):
    rng, rows = random.Random(12), []
    for _ in range(250):
        n, letters = rng.choice([0, 1, 15, 47, 60, 92, 100, 200, 500]), rng.choice(["ab", "abcdefgh é😀 ", "a"])
        text, after = ("".join(rng.choice(letters) for _ in range(k)) for k in (n, rng.choice([0, 10, 300])))
        head = text[: n - n // 2]
        rows.append((text.encode(), (head + after[: n // 2]).encode(), len(head.encode())))
    df = spark.createDataFrame(rows, "t binary, e binary, same int").withColumn("p", winnow.winnowed(F.col("t")))
    got = df.select(winnow.winnowed(F.col("e")).alias("a"), winnow.rewinnowed(F.col("p"), F.col("e"), F.col("same")).alias("b")).collect()
    assert all(r.a == r.b for r in got)


def test_shared_passage_is_found(spark):
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    rows = []
    for i in range(40):
        passage = noise(winnow.GRAM + winnow.WINDOW - 1)
        rows.append((i, noise(rng.randint(0, 90)) + passage + noise(rng.randint(0, 90)), noise(rng.randint(0, 90)) + passage + noise(rng.randint(0, 90))))
    df = spark.createDataFrame(rows, "i int, a string, b string")
    both = F.size(F.array_intersect(winnow.hashes(winnow.winnowed(F.col("a").cast("binary"))), winnow.hashes(winnow.winnowed(F.col("b").cast("binary")))))
    assert df.where(both == 0).count() == 0


def test_neighbours_and_edited_texts(spark):
    rng = random.Random(10)
    texts = {i * 7 - 50: "".join(rng.choice("abcdé ") for _ in range(rng.choice([0, 1, 2, 40, 300]))) for i in range(60)}
    rows = [*texts.items(), (None, "no id"), (None, None)]
    got = winnow.fingerprint_neighbours(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bucket int")).collect()
    order = sorted(texts, reverse=True)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == len(rows)
    for k, d in enumerate(order[:-1]):
        text, after = texts[d], texts[order[k + 1]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (by_id[d].n_chars, by_id[d].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert by_id[d].near_edited == 1.0 if edited == text else 0 <= by_id[d].near_edited <= 1
        assert (by_id[d].edited_fingerprint == by_id[d].fingerprint) == (edited == text) or len(text) < 60
    assert winnow.fingerprint_neighbours(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- pages --------------------------------------------------------------------------------
MARKED = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<header><h1>Site</h1><nav><a href=/>Home</a></nav></header><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
<main><article><header><h1>Head&amp;line &lt;1&gt;</h1></header><p>One <b>bo</b>ld
&nbsp; text<br>more<p>Two <span class="ad">Buy!</span> end<div class="share-buttons">Share</div><ul><li>a<li>b</ul>
<aside>Side</aside><form><label>Name</label><input></form><section id="comments"><p>First!</p></section></article></main>
<aside>Other</aside><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize(("html", "text"), [
    (MARKED, "Head&line <1> One bold text more Two end a b"),
    ("<article><p>a<p>b</article>", "a b"),
    ("<div role=main><p>x</p></div><p>out</p>", "x"),
    ("<article hidden><p>x</p></article><article><p>y &amp z &eacute;</p>", "y & z é"),
    ("<article><p>1 < 2 <b>and</b> <a title='>'>3</a></p></article", "1 < 2 and 3"),
    ("<article><table><tr><td>a<td>b</table><pre> c\n  d</pre></article>", "a b c d"),
    ("", ""), (None, ""), ("<article></article>", ""), ("plain", "plain"),
])
def test_page_text(spark, html, text):
    df = spark.createDataFrame([(1, "http://a.example/x", html, 5)], "page_id long, url string, html string, n_chars int")
    assert [tuple(r) for r in extract.main_texts(df).collect()] == [(1, "http://a.example/x", text, len(text))]


@pytest.mark.parametrize(("html", "text"), [
    *((f"<article {a}><p>x <a {a}>y</a></p></article>", "x y") for a in (
        'data-hidden="false"', 'title="the hidden cost"', "href='/hidden-costs'", "href=/hidden", 'aria-label="hidden"', 'data-id="search"', 'href="/q?id=search"',
        'data-class="ad"', 'title="class=ad id=menu"', 'class="category-social"', 'title="a > b" data-role=alert', "class=no-sidebar")),
    ('<div class="layout has-sidebar"><article><p>x</p></article></div>', "x"),
    ('<main class="no-sidebar"><p>x</p></main>', "x"),
    ('<div class="social"><div id=search><article class="ad"><p>x</p><p class="ad">buy</p></article></div>out</div>', "x"),
    ('<div class=widget><div role="main"><p>x</p></div></div>', "x"),
    ('<form id=f><header><main><h1>t</h1><div class="widget"><article>x</article></div></main></header></form>', "t x"),
    ('<article>x</article><div class="comments"><article>first!</article></div>', "x"),
    ('<div hidden><article>h</article></div><article>x</article>', "x"),
    *((f"<article><p>a</p><{n}><p>b</p></article>", "a b") for n in ("svg", "iframe src=x", "noscript", "video", "select", "object", "template")),
    *((f"<article><p>a</p><{n}><p>b</p></article>", "a") for n in ("script", "style", "title", "textarea")),
])
def test_loose_hints_keep_the_article(html, text):
    has_content, found = extract.blocks(html)
    assert has_content and " ".join(t for t, inside in found if inside) == text


def test_attributes_equal_those_of_a_parser():
    rng = random.Random(12)
    names = ["class", "id", "role", "hidden", "aria-hidden", "style", "data-hidden", "data-id", "title", "href", "xclass", "aria-label"]
    values = ["hidden", "ad", "menu", "x", "the hidden cost", "/q?id=search", "class=ad", "no-sidebar", "main", "true", "display: none", "has-ad", "a b ad"]
    for _ in range(2000):
        pairs = {n: rng.choice([None, *values]) for n in rng.sample(names, rng.randint(0, 4))}
        quote = lambda v: rng.choice([f'"{v}"', f"'{v}'"] + [v] * (" " not in v))
        raw = " ".join(n if v is None else n + rng.choice(["=", " = "]) + quote(v) for n, v in pairs.items())
        words = {n: (pairs.get(n) or "").split() for n in ("class", "id", "role")}
        unseen = "hidden" in pairs or pairs.get("aria-hidden") == "true" or pairs.get("style") == "display: none"
        hint = any(w in extract._HINTS for each in words.values() for w in each)
        assert extract._hinted(" " + raw) == (unseen, hint, "main" in words["role"]), raw


def test_unmarked_pages_lose_what_the_nearest_page_shares(spark):
    page = lambda body: f"<div>Top bar</div><div>Welcome</div>{body}<div>All rights</div>"
    rows = [(i, f"http://h.example/a/{i}", page(f"<p>Own text number {i} with many words of its own.</p>" * 2), "k") for i in range(40)]
    rows += [(100, "http://h.example/b/1", page("<p>Twin text with words enough to be a page of its own, copied to another place.</p>"), "k")]
    rows += [(101, "http://h.example/b/1", page("<p>Twin text with words enough to be a page of its own, copied to another place.</p>"), "k")]
    rows += [(102, "http://alone.example/", page("<p>Alone</p>"), "k"), (103, None, None, "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, key string")
    got = {r.page_id: r.text for r in extract.main_texts(df).collect()}
    assert all(got[i] == " ".join([f"Own text number {i} with many words of its own."] * 2) for i in range(40))
    assert "Twin text" in got[100] and got[100] == got[101]
    assert got[102] == "Top bar Welcome Alone All rights" and got[103] == ""


def test_all_pages_are_differenced_and_marked_articles_guarded(spark):
    """Against a loop over the pages in order, for hosts of several pages, repeated rows and few or many ranges."""
    rng = random.Random(13)
    rows = []
    for i in range(120):
        own = "".join(f"<p>{rng.choice(['shared passage', f'own {i}', f'text {rng.randrange(30)}'])}</p>" for _ in range(5))
        body = rng.choice([f"<article>{own}</article>", own, f"<script>'<article>'</script>{own}"])
        rows.append((i, f"http://h{rng.randrange(4)}.example/{rng.choice('ab')}/{i}", f"<div>Top bar</div>{body}<div>All rights</div>"))
    rows += rows[:10] + [(500, None, None), (501, None, "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    keyed = {}
    for page_id, url, html in rows:
        digest = hashlib.sha256("\x01".join(str(x) for x in (page_id, url, html) if x is not None).encode()).hexdigest()
        host, _, path = (url or "").removeprefix("http://").partition("/")
        keyed[host, "/" * bool(path) + path, digest] = page_id, extract.blocks(html)
    order, want = sorted(keyed), {}
    for i, key in enumerate(order):
        found, best, near = keyed[key][1][1], -1, []
        for other in (order[(i + 1) % len(order)], order[i - 1]):
            same = len(os.path.commonprefix([key[1], other[1]]))
            if other != key and other[0] == key[0] and same > best:
                best, near = same, [hash(t) for t, _ in keyed[other][1][1]]
        shared = extract.common_lines([hash(t) for t, _ in found], near)
        size = sum(len(found[j][0]) for j in shared)
        if size > extract.COPY_SHARE * sum(len(t) for t, _ in found):
            shared, size = set(), 0
        text = " ".join(t for j, (t, inside) in enumerate(found) if (inside if keyed[key][1][0] else j not in shared))
        want[keyed[key][0]] = text, size
    assert any(want[page_id][1] for page_id, (has_content, _) in keyed.values() if has_content)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "7", "60"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = extract.differenced(df).collect()
            assert sorted(r.page_id for r in got) == sorted(r[0] for r in rows)
            assert {r.page_id: (r.text, r.n_shared) for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert extract.differenced(df.limit(0)).collect() == []


def test_copies_meet_the_nearest_page_that_differs(spark):
    """Against a walk over the pages in order: copies under other URLs, more than ranges hold, each lose what the nearest other page shares."""
    rng = random.Random(17)
    rows, page_id = [], 0
    for host, groups in (("a.example", 12), ("b.example", 1), ("c.example", 2), ("d.example", 1)):
        for group in range(groups):
            copies = 1 if host == "d.example" else rng.choice([1, 1, 2, 70]) if groups > 2 else 30
            own = "".join(f"<p>Own passage {k} of group {group} with many words, long enough to be most of its page.</p>" for k in range(3))
            for k in range(copies):
                body = f"<article>{own}</article>" if k % 3 == 1 else own
                rows.append((page_id, f"http://{host}/{group // 3}/{group}-{k:02}", f"<div>Top bar</div>{body}<div>All rights</div><script>{page_id}</script>"))
                page_id += 1
    rows += rows[:4]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    order = sorted(set(rows), key=lambda r: r[1].removeprefix("http://").partition("/")[::2])
    found, want = {r[0]: extract.blocks(r[2]) for r in order}, {}
    for i, (own_id, url, _) in enumerate(order):
        has_content, lines = found[own_id]
        marks, best, near = [t for t, _ in lines], -1, []
        for turn in (1, -1):
            others = (order[(i + turn * far) % len(order)] for far in range(1, len(order)))
            other = next((o for o in others if o[1].split("/")[2] != url.split("/")[2] or [t for t, _ in found[o[0]][1]] != marks), None)
            if other and other[1].split("/")[2] == url.split("/")[2] and len(os.path.commonprefix([url, other[1]])) > best:
                best, near = len(os.path.commonprefix([url, other[1]])), [t for t, _ in found[other[0]][1]]
        shared = extract.common_lines(marks, near)
        want[own_id] = " ".join(t for j, (t, inside) in enumerate(lines) if (inside if has_content else j not in shared)), sum(len(marks[j]) for j in shared)
    on = {r[0]: r[1].split("/")[2] for r in rows}
    assert all((n > 0) == (on[k] in ("a.example", "c.example")) and ("Top bar" in text) == (n == 0 and not found[k][0]) for k, (text, n) in want.items())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "9", "80"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = extract.differenced(df).collect()
            assert sorted(r.page_id for r in got) == sorted(r[0] for r in rows)
            assert {r.page_id: (r.text, r.n_shared) for r in got} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_the_query_of_a_url_tells_which_page_is_nearest(spark):
    own = lambda i: f"<p>Own text number {i} with many words of its own, long enough to be most of it.</p>"
    rows = [(i, f"http://h.example/show?id={i}&utm=x#top", f"<p>Section {i // 10}</p>{own(i)}") for i in (11, 12, 13, 21, 22, 23, 31, 32, 33)]
    got = {r.page_id: r.text for r in extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: own(i)[3:-4] for i, *_ in rows}


def test_common_lines_is_a_longest_common_subsequence():
    rng = random.Random(11)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        found = [a[i] for i in sorted(extract.common_lines(a, b))]
        rest = iter(b)
        assert len(found) == table[-1][-1] and all(x in rest for x in found)
