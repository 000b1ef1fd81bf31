"""Operators for training data against brute force, round trips, held-out labels and odd tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shardwell.llm import ann, cleaning, extraction, katz, mixing, neardup, packing, passages, quality, registry, toxicity
from shardwell.llm._common import table
from shardwell.llm._graph import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and names that operators might use themselves."""
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
    rows = [(1, "a b c. d e f.", "en", "s"), (1, "a b c. d e f.", "en", "s"), (2, None, None, None), (3, "", "en", ""), (None, "x y z", "en", "s"), (None, None, None, None), (4, long, "en", "é"), (5, long, "en", "é"), (6, " \t\n ", "de", "s"), (7, "naïve 漢字 😀 \x00 end", "fr", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({"n_chars": F.length("text").cast("long"), "size": F.lit("clash"), "_id": F.lit(9), "score": F.lit("x"), "length": F.lit(1), "u": F.lit(2), "node": F.lit(3), "_text": F.lit("t"), "n": F.lit(0), "words": F.lit(0)})


def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1 mixing


def targets(sizes, share=1.5, weights=(3, 1, 2), cap=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, out, left = set(), {}, share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        each = (left - sum(cap * sizes[s] for s in full)) / max(1, sum(w[s] for s in rest))
        over = {s for s in rest if w[s] * each > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else w[s] * each for s in names}
        full |= over


def test_mix_meets_targets(spark, docs, texts):
    rows = mixing.mix(docs).collect()
    size = {k: len([w for w in cleaning.words_of(t)]) for k, t in texts.items()}
    assert {r.doc_id: r["size"] for r in rows} == size
    by = defaultdict(int)
    source = {r.doc_id: r.source for r in docs.collect()}
    for k, n in size.items():
        by[source[k]] += n
    want, got = targets(by), defaultdict(int)
    for r in rows:
        got[r.source] += r.taken
        assert r.source_size == by[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-12) and 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
    for s in by:
        assert abs(got[s] - want[s]) <= max(0.02 * want[s], 30), s
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_mix_rates_are_the_exponential_tilt(spark, docs):
    """The multiplier found by Newton's steps is the root that bisection finds."""
    rows = mixing.mix(docs).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for rs in list(by.values())[:6]:
        s, t = sum(r["size"] for r in rs), rs[0].target
        if t >= 2 * s * (1 - 1e-9):
            assert all(r.rate == 2.0 for r in rs)
            continue
        f = lambda lam: sum(2 * r["size"] / (1 + math.exp(-max(-700.0, min(700.0, lam * r["size"])))) for r in rs) - t  # noqa: E731, B023
        lo, hi = -10.0, 10.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
        assert all(math.isclose(r.rate, 2 / (1 + math.exp(-lo * r["size"])), rel_tol=1e-5, abs_tol=1e-6) for r in rs)


def test_mix_odd_tables(spark):
    rows = mixing.mix(odd(spark)).collect()
    assert len(rows) == 10 and all(r.taken == 0 for r in rows if r["size"] == 0)
    assert mixing.mix(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "en", "s", 0)], DOCS)
    assert mixing.mix(blank).first().target == 0.0
    out = mixing.repeat_documents(odd(spark))
    assert out.columns == odd(spark).columns
    taken = Counter()
    for r in rows:
        taken[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: v for k, v in taken.items() if v})


def test_repeating_leaves_odd_columns_alone(spark):
    """Columns of types without an order or a hash, ids that repeat, rows that repeat: as many copies as the mix takes."""
    rows = [(None if i % 3 else i % 7, "a b c d" if i % 2 else f"w{i} x", "s" if i % 5 else None, {"k": i % 2}) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra map<string,int>")
    got = mixing.repeat_documents(df)
    assert got.columns == df.columns
    taken = mixing.mix(df).agg(F.sum("copies"), F.sum("taken")).first()
    again = [r.text for r in got.collect()]
    assert len(again) == taken[0] and sum(len(t.split()) for t in again) == taken[1]


# 2 packing


def test_encoder_is_the_tokenizer(texts):
    import pyarrow as pa
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(packing.word_bpe()), packing.encoder(packing.word_bpe())
    odd_ = ["don't DON'T it's", "é É é Éx", "a<|endoftext|>b <|ENDOFTEXT|>", "x\xa0y z\x1cw", "12ab34 a1! !a", "İstanbul ΣΑΣ ẞ", "漢字 テスト", "a'tx 'll x'", "_a_ a_b", "", " ", "\x00 a\x00b", "a👍b"]
    some = [*list(texts.values())[:60], *odd_, None]
    ids, bounds = enc(pa.array(some, pa.string()))
    for i, t in enumerate(some):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == tok.encode(t or "", add_special_tokens=False).ids, t
    part, cuts = enc(pa.array(some, pa.string()).slice(17, 40))
    assert (part == ids[bounds[17] : bounds[57]]).all() and (cuts == bounds[17:58] - bounds[17]).all()


def test_encoder_cuts_words_as_the_tokenizer():
    """Letters, signs, digits, marks, special tokens and letters whose small form ends in a mark, in any order."""
    import pyarrow as pa
    import tokenizers

    rng = random.Random(25)
    tok = tokenizers.Tokenizer.from_file(packing.word_bpe())
    letters = "abzAZ09 ,.'-<|>_[]~éßİΣςK漢각²½ªʰ\u0301ǅ😀\t\n"
    some = ["".join(rng.choice(letters) for _ in range(rng.randrange(20))) for _ in range(3000)] + ["İ, x", "<|endoftext|> a<|endoftext|>B", "it's we'll", "a0b 10c2", None]
    ids, bounds = packing.encoder(packing.word_bpe())(pa.array(some))
    for t, lo, hi in zip(some, bounds, bounds[1:]):
        assert ids[lo:hi].tolist() == tok.encode(t or "", add_special_tokens=False).ids, t


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack_round_trip(spark, docs, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.word_bpe())
    rows = packing.pack(docs, keep_ids=True).collect()
    n = check_packing(rows, 4096)
    assert n <= -(-sum(r.length for r in rows) // 4096) + 1
    whole = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.piece):
        assert r.start == len(whole[r.doc_id]) and r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        whole[r.doc_id] += r.ids
    for k, t in texts.items():
        assert whole[k] == [*tok.encode(t, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_every_piece(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 500])
    counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 600)))
    if seed == 0:
        counts = Counter({1: 100_000, 7: 3})
    ranges, n = packing.plan_sequences(counts, capacity)
    used, seen = Counter(), defaultdict(list)
    for length, first, total, each, seq, offset in ranges:
        assert used[length] == first
        used[length] += total
        for i in range(total):
            seen[seq + i // each].append((offset + i % each * length, length))
    assert used == counts and len(seen) == n
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    bound = -(-sum(k * v for k, v in counts.items()) // capacity)
    assert n <= bound * 1.15 + 2


def test_exact_complements_are_found():
    assert packing.plan_sequences({7: 2, 3: 2}, 10)[1] == 2
    assert packing.plan_sequences({5: 1, 3: 1, 2: 1}, 10)[1] == 1
    assert packing.plan_sequences({4: 1, 3: 1, 2: 1, 1: 1}, 10)[1] == 1


def test_triples_are_found_whatever_their_first():
    # the first of the three lies beyond 256 longer lengths that fit nothing
    longer = {k: 1 for k in range(1002, 1602, 2)}
    ranges, _ = packing.plan_sequences({2400: 1, 1000: 1, 397: 1, 299: 1, **longer}, 4096)
    assert len({r[4] for r in ranges if r[0] in (2400, 1000, 397, 299)}) == 1
    # more than 64 triples for one length
    assert packing.plan_sequences({2000: 100, 300: 100, **{1500 + i: 1 for i in range(100)}, **{296 - i: 1 for i in range(100)}}, 4096)[1] == 100


def test_pack_odd_tables(spark):
    rows = packing.pack(odd(spark)).collect()
    check_packing(rows, 4096)
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter({1: 2, None: 2, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1})
    assert all(r.length == 1 for r in rows if r.doc_id in (2, 3, 6)) and max(r.piece for r in rows) > 5
    assert packing.pack(empty(spark)).count() == 0


# 3 toxicity


def test_toxicity_learns_and_points(spark):
    bad, clean = "zorgle", [f"word{i}" for i in range(300)]
    rng = random.Random(1)
    rows, lab = [], []
    for i in range(400):
        t = int(rng.random() < 0.3)
        sents = [" ".join(rng.choices(clean, k=8)) + "." for _ in range(6)]
        if t:
            sents[3] = f"you {bad} {rng.choice(clean)}."
        rows.append((i, " ".join(sents)))
        lab.append((i, t, 1))
    d, lb = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(lab, "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, lb).collect()}
    held = [r for r in got.values() if r.held_out]
    assert {r.doc_id for r in held} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r.predicted == lab[r.doc_id][1] for r in held)
    for r in got.values():
        for s in r.offending:
            assert bad in rows[r.doc_id][1][s.start : s.end]
        assert bool(r.offending) == bool(lab[r.doc_id][1])


def test_toxicity_is_the_noisy_or(spark):
    """Scores recomputed from the fitted model, sentence by sentence, by the definition."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.train(docs, labels)
    weights = dict(zip(model["features"], model["weights"]))
    got = {r.doc_id: (r.score, r.offending) for r in toxicity.score(docs, model).collect()}
    for r in docs.collect():
        clean, bad = 1 - model["p0"], 0
        for part in re.split("[.!?\n…]", (r.text or "").lower()):
            found = {f for w in re.findall(r"\w+", part) for f in (w, *(w[:k] + "-" for k in (4, 5, 6, 7) if len(w) > k)) if f in weights}
            if found:
                p = 1 / (1 + math.exp(-(model["bias"] + sum(weights[f] for f in found))))
                clean *= 1 - p
                bad += p >= 0.5
        assert math.isclose(got[r.doc_id][0], 1 - clean, abs_tol=1e-9) and len(got[r.doc_id][1]) == bad


def test_training_samples_are_bounded_in_rows(spark):
    rows = [(i % 2 + 1, f"text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.training_sample(docs, labels, "toxic", 1, 1, 10, "doc_id", "text").collect()
    assert sorted((r._id, r._y) for r in got) == [(1, 1.0), (2, 0.0)]


def test_toxicity_on_the_tables(spark):
    sf = "/root/testdata/sf0.1"
    model = toxicity.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    rows = toxicity.score(table(spark, sf, "documents"), model).join(table(spark, sf, "labels"), "doc_id").filter(toxicity.fold("doc_id", 5) == 0).collect()
    hit = [r.score >= 0.5 for r in rows if r.toxic]
    wrong = [r.score >= 0.5 for r in rows if not r.toxic]
    assert sum(hit) / len(hit) > 0.85 and sum(wrong) / len(wrong) < 0.02


def test_toxicity_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1, None), (2, 0, 1), (None, 1, 1), (3, None, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(odd(spark), labels).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert toxicity.toxicity(empty(spark), labels).count() == 0
    none = labels.filter("false")
    assert toxicity.toxicity(odd(spark), none).count() == 10
    model = {"features": ["bad"], "weights": [9.0], "bias": -1.0, "p0": 0.01}
    kept = toxicity.filter_documents(odd(spark).withColumn("text", F.when(F.col("doc_id") == 3, F.lit("so bad")).otherwise(F.col("text"))), model)
    assert kept.columns == odd(spark).columns and kept.count() == 9


# 4 extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<main><article><header><h1>Title &amp; more</h1></header><p>First&nbsp;&nbsp;para<b>graph</b>
with a<br>break.</p><div class="ad">Buy now</div><p>Second &lt;one&gt; &#233;.<p>Third, unclosed
<form><input name=q> search</form><section class="comments"><p>A reader says a lot of things here, at length, on and on.</p></section></article></main>
<aside>Related things to read</aside><footer>&copy; 2024</footer></body></html>"""


def test_extract_page():
    assert extraction.text_of(PAGE, {}) == "Title & more\n\nFirst paragraph with a break.\n\nSecond <one> é.\n\nThird, unclosed"


ARTICLE = " ".join(f"word{i}" for i in range(80))


@pytest.mark.parametrize(
    "html, dropped",
    [
        (f"<body><p class=share>Share this<p>{ARTICLE}</body>", True),
        (f"<body><p class=share>Share this<div>{ARTICLE}</div></body>", True),
        (f"<html><head><meta charset=u><title>T</title><body><p>{ARTICLE}</p></body></html>", True),
        (f"<head><title>T</title><p>{ARTICLE}", True),
        (f"<head><title>T</title>{ARTICLE}", True),
        (f"<ul><li class=share>Share this<li>{ARTICLE}</ul>", True),
        (f"<ul><li class=share>Share this</ul><p>{ARTICLE}</p>", True),
        (f"<dl><dt class=share>Share this<dd>{ARTICLE}</dl>", True),
        (f"<table><tr><td class=sidebar>Share this<td>{ARTICLE}</table>", True),
        (f"<table><tr class=sidebar><td>Share this<tr><td>{ARTICLE}</table>", True),
        (f"<select><option>Share this</select><p>{ARTICLE}</p>", True),
        (f"<div><aside>Share this</div><p>{ARTICLE}</p></aside>", True),
        (f"<body><aside>Share this<p>{ARTICLE}</p></body>", False),
        (f"<body><form action=x>Share this<div>{ARTICLE}</div></body>", False),
        (f"<div class=sidebar><div>Share this</div><p>{ARTICLE}</p>", False),
        (f"<aside><div><aside>Share this</aside>Share this</div></aside><p>{ARTICLE}</p>", True),
    ],
)
def test_boilerplate_ends_where_html_ends_it(html, dropped):
    got = extraction.text_of(html, {})
    assert ARTICLE in got
    if dropped:
        assert got == ARTICLE


def test_extract_the_table(spark):
    import html
    import re

    pages = table(spark, SF, "pages")
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in extraction.extract(pages).collect():
        a = re.search(r"<article>(.*?)(</article>|$)", raw[r.page_id], re.S)[1]
        a = re.sub("<[^>]+>", "", re.sub("<br>", " ", re.sub("</?(p|h1)>", "\x00", a)))
        assert r.text == "\n\n".join(b for b in (" ".join(html.unescape(s).split()) for s in a.split("\x00")) if b) and r.n_chars == len(r.text)


CONTENT = " ".join(f"word{i}" for i in range(60)) + "."


@pytest.mark.parametrize(
    "page",
    [
        '<body><div class="layout no-sidebar"><p>%s</p></div></body>',
        '<body><form id="aspnetForm"><div><p>%s</p></div></form></body>',
        '<body><div class="page-header-wrapper menu"><main><p>%s</p></main></div></body>',
        '<body><div class="sidebar"><p>%s</p></div></body>',
        '<body><nav>home news</nav><article class="post"><p>%s</p><article class="comment"><p>I like it very much indeed.</p></article></article></body>',
        '<body><article><p>%s</p><ol class="commentlist"><li>First of all, no. I do not think so at all.</li></ol></article></body>',
        '<body><article><p>%s</p><form><label>Your name</label><input></form></article></body>',
    ],
)
def test_names_do_not_decide_against_the_content(page):
    assert extraction.text_of(page % CONTENT, {}) == CONTENT


@pytest.mark.parametrize("html", [None, "", "<p>", "<div><div>", "plain words only", "<p>a < b & c</p>", "<script>x", "<!-- c", "a" * 100_000, "<p>" * 20_000 + "x"])
def test_extract_broken_pages(html):
    out = extraction.text_of(html, {})
    assert isinstance(out, str) and (out or not html or "x" not in html.replace("<script>x", ""))


def test_best_region_is_the_brute_force_maximum():
    rng = random.Random(2)
    for _ in range(300):
        x = [rng.choice([-3, -1, 0, 1, 2]) for _ in range(rng.randint(0, 12))]
        lo, hi = extraction.best_region([float(v) for v in x])
        assert sum(x[lo:hi]) == max([0, *(sum(x[a:b]) for a in range(len(x)) for b in range(a + 1, len(x) + 1))])


def test_perceptron_learns_regions():
    page = [("tag:div", 1), ("word", 12), ("tag:/div", 1), ("tag:article", 1), ("tag:p", 1), ("word", 30), ("tag:/p", 1), ("tag:/article", 1), ("tag:div", 1), ("word", 9), ("tag:/div", 1)]
    w = extraction.learn([page] * 20, 10)
    lo, hi = extraction.best_region([extraction.weight(w, k.replace(":/", ":")) * n for k, n in page])
    assert [n for k, n in page[lo:hi] if k == "word"] == [30] and w["word"] > 0 > w["tag:div"]


def test_extract_odd_tables(spark):
    df = spark.createDataFrame([(1, "u", "<p>Hi there</p>"), (1, "u", "<p>Hi there</p>"), (None, None, None), (2, "v", "")], "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "_id": F.lit(1)})
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in extraction.extract(df).collect()) == [(0, "", 0), (1, "Hi there", 8), (1, "Hi there", 8), (2, "", 0)]
    assert extraction.extract(df.filter("false")).count() == 0


# 5 quality


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.quality(table(spark, sf, "documents"), table(spark, sf, "labels")).join(table(spark, sf, "labels"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95


def test_compiled_rules_are_the_rules(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3)).round(3)
    y = ((x[:, 0] > 0.2) & (x[:, 1] <= 0.5)).astype(float)
    model = quality.fit(x, y)
    z = model["bias"] + sum(w * quality.holds(x, r) for r, w in zip(model["rules"], model["weights"]))
    p = 1 / (1 + np.exp(-z))
    assert ((p >= 0.5) == y).mean() > 0.97 and len(model["rules"]) < 150
    df = spark.createDataFrame(x.tolist(), ["a", "b", "c"]).coalesce(1)
    got = [r[0] for r in df.select(quality.compile_rules(model, ["a", "b", "c"])).collect()]
    assert np.allclose(got, p)


def test_quality_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.quality(odd(spark), labels).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality(empty(spark), labels).count() == 0 and quality.quality(odd(spark), labels.filter("false")).count() == 10


# 6 near-duplicates


def edit(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_banded_alignment():
    rng = random.Random(4)
    for _ in range(1500):
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 14))]
        b = [rng.randint(0, 3) for _ in range(rng.randint(0, 14))] if rng.random() < 0.5 else [x if rng.random() < 0.8 else 9 for x in a]
        m, e = rng.randint(0, 8), edit(a, b)
        assert neardup.distance_within(a, b, m) == (e if e <= m else None)
        ok = 1 - e / max(1, len(a), len(b)) >= 0.8 - 1e-12
        assert neardup.similar(np.array(a, dtype="<u4"), np.array(b, dtype="<u4"), 0.8) == ok


def test_long_alignment_is_the_table():
    rng = random.Random(8)
    for n, share in ((700, 0.1), (700, 0.19), (400, 0.25)):
        a = [rng.randint(0, 200) for _ in range(n)]
        b = edited(rng, a, share, lambda: rng.randint(0, 200))
        e = edit(a, b)
        for most in (e - 1, e, e + 30, n):
            assert neardup.distance_within(a, b, most) == (e if e <= most else None)


def edited(rng, words, share, new):
    """``words`` with that share of substitutions, insertions and deletions."""
    out = list(words)
    for _ in range(int(share * len(words))):
        i, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[i] = new()
        elif kind == 1:
            out.insert(i, new())
        else:
            del out[i]
    return out


def test_near_copies_are_found_over_the_whole_range(spark):
    """Of pairs that the alignment confirms, nine in ten meet at each share of edits, whatever their kind."""
    rng = random.Random(15)
    new = lambda: f"n{rng.randint(0, 10**6)}"
    rows, pairs = [], defaultdict(list)
    for i in range(600):
        share = (0.05, 0.10, 0.15, 0.19)[i % 4]
        base = [new() for _ in range((15, 60, 200, 600)[i // 4 % 4])]
        other = edited(rng, base, share, new)
        a, b = (np.array([zlib.crc32(w.encode()) for w in t], dtype="<u4") for t in (base, other))
        if neardup.similar(a, b, 0.8):
            pairs[share].append((2 * i, 2 * i + 1))
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for found in pairs.values():
        assert len(found) >= 100 and sum(got[a] == got[b] for a, b in found) >= 0.9 * len(found)
    assert all(got[i] == i for i, _ in rows if i % 2 == 0)  # unrelated texts stay apart


def test_sketches_allow_similar_texts():
    rng = random.Random(12)
    kept = 0
    for _ in range(300):
        base = [rng.randint(0, 10**6) for _ in range(rng.choice((20, 100, 400)))]
        other = edited(rng, base, 0.19, lambda: rng.randint(0, 10**6))
        x, y = (neardup.sketch(np.array(t, dtype="<u4")) % 2**64 for t in (base, other))
        kept += sum((x ^ y) >> (4 * i) & 15 != 0 for i in range(16)) <= neardup.DIFFER
    assert kept >= 299


def test_versions_that_drift_are_one_class(spark):
    """More versions of a page than a key is paired fully for; the last has little in common with the first."""
    rng = random.Random(21)
    page = [f"p{i}" for i in range(200)]
    rows = []
    for i in range(130):
        rows.append((i, " ".join(page)))
        for _ in range(4):
            page[20 + rng.randrange(180)] = f"v{rng.randint(0, 10**6)}"
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.select("class_id").distinct().count() == 1


def test_near_copies_among_pages_of_one_template(spark):
    """All texts share half their words, so their keys are large; near copies are found all the same, and the others stay apart."""
    rng = random.Random(22)
    shared = [f"s{i}" for i in range(70)]
    rows = []
    for i in range(120):
        own = [f"w{rng.randint(0, 10**6)}" for _ in range(70)]
        for j in range(2):
            rows.append((2 * i + j, " ".join(shared + (edited(rng, own, 0.08, lambda: f"x{rng.randint(0, 10**6)}") if j else own))))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(120)) >= 117 and all(got[2 * i] == 2 * i for i in range(120))


def test_a_worker_gives_freed_memory_back(spark):
    """After a task over large texts its worker holds little more than before."""
    from shardwell.llm._common import map_texts

    def held(rows):
        import re

        return int(re.search(r"VmRSS:\s+(\d+)", open("/proc/self/status").read())[1])

    def setup():
        kept = []

        def make(rows):
            kept.extend(f"{i}" * 20 for i in range(2_000_000 // len(rows)))
            return [0], [[held(rows)]]

        return make

    small = lambda: (lambda rows: ([0], [[held(rows)]]))
    one = spark.createDataFrame([("t",)], "t string").coalesce(1)
    peak = map_texts(one, [], F.col("t"), setup, "kb long").first().kb
    assert map_texts(one, [], F.col("t"), small, "kb long").first().kb < peak - 100_000


def test_prefixes_of_similar_texts_meet():
    rng = random.Random(23)
    for _ in range(300):
        base = [rng.randint(0, 60) for _ in range(rng.choice((1, 4, 9, 40, 150)))]
        a, b = (np.array(t, dtype="<u4") for t in (base, edited(rng, base, rng.choice((0.1, 0.2)), lambda: rng.randint(0, 60))))
        held = np.array([rng.randint(0, 9) for _ in range(neardup.COUNTED)])
        if len(b) and neardup.similar(a, b, 0.8):
            assert set(neardup.prefix(a, held, 0.8)) & set(neardup.prefix(b, held, 0.8))


def test_similar_texts_share_pairs_of_words():
    rng = random.Random(25)
    seen = 0
    for _ in range(400):
        base = [rng.randint(0, 60) for _ in range(rng.choice((1, 2, 4, 5, 9, 40, 150)))]
        a, b = (np.array(t, dtype="<u4") for t in (base, edited(rng, base, rng.choice((0.1, 0.2)), lambda: rng.randint(0, 60))))
        if len(b) and neardup.similar(a, b, 0.8):
            both = len(set(neardup.word_pairs(a).tolist()) & set(neardup.word_pairs(b).tolist()))
            assert both >= neardup.kept_pairs(np.array([len(a) - 1, len(b) - 1]), 0.8).max()
            seen += 1
    assert seen > 100


def prefix_rows(spark, texts):
    """What the prefixes of texts (root, words) are found from."""
    import zlib

    rows = [(f"{i:016}".encode(), len(w), 0, f"{root:016}".encode(), zlib.compress(np.array(w, dtype="<u4").tobytes(), 1)) for i, (root, w) in enumerate(texts)]
    return spark.createDataFrame(rows, "node binary, n int, sketch long, root binary, words binary").repartition(3)


def test_connected_texts_make_no_prefix_rows(spark):
    """However large their class is: only words that texts of another class hold make rows."""
    rng = random.Random(26)
    base = list(range(200))
    copies = [edited(rng, base, 0.1, lambda: rng.randint(10**6, 10**9)) for _ in range(120)]
    rows = prefix_rows(spark, [(0, w) for w in copies])
    assert neardup._with_prefix(rows, 0.8).count() == 0 and neardup._may_meet(rows, 0.8).count() == 0
    # a passage of theirs in 120 other texts changes nothing; a text that may be near does, with what it may be near to
    others = [(1 + i, base[:60] + [rng.randint(10**6, 10**9) for _ in range(140)]) for i in range(120)]
    assert neardup._may_meet(prefix_rows(spark, [(0, w) for w in copies] + others), 0.8).count() == 0
    near = edited(rng, base, 0.1, lambda: rng.randint(10**6, 10**9))
    got = {int(r.node) for r in neardup._may_meet(prefix_rows(spark, [(0, w) for w in copies] + others + [(500, near)]), 0.8).collect()}
    for i, w in enumerate(copies):
        assert i in got or not neardup.similar(np.array(w, dtype="<u4"), np.array(near, dtype="<u4"), 0.8)
    assert 240 in got and not got & set(range(120, 240))


def test_texts_meet_at_one_word_of_their_prefixes(spark):
    rng = random.Random(27)
    texts = [(i, edited(rng, list(range(100)), 0.08, lambda: rng.randint(10**6, 10**9))) for i in range(12)]
    rows = neardup._with_prefix(prefix_rows(spark, texts), 0.8).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r.key, []).append(r)
    met = [(a.node, b.node) for same in by.values() for a in same for b in same if a.node < b.node and not set(a.early) & set(b.early)]
    assert len(met) == len(set(met)) == 66 < sum(len(x) * (len(x) - 1) // 2 for x in by.values())


@pytest.mark.parametrize("block", [neardup.BLOCK, 30])
def test_near_copies_without_a_rare_phrase_are_found(spark, monkeypatch, block):
    """Each text takes one of three phrases for each place, so more texts than are paired fully hold every k-mer of any text."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(24)
    phrases = [[[f"p{i}v{v}w{k}" for k in range(12)] for v in range(3)] for i in range(20)]
    picks = []
    for _ in range(500):
        own = [rng.randrange(3) for _ in range(20)]
        near = list(own)
        for i in rng.sample(range(20), 4):
            near[i] = (near[i] + 1) % 3
        picks += [own, near]
    rows = [(i, " ".join(w for j, v in enumerate(p) for w in phrases[j][v])) for i, p in enumerate(picks)]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    x = np.array(picks)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero((x[i + 1 :] == x[i]).sum(axis=1) >= 16) + i + 1:  # similarity of 16 places in 20
            lo, hi = sorted((find(i), find(int(j))))
            root[hi] = lo
    assert got == {i: find(i) for i in range(len(rows))}


def test_near_duplicates_are_the_brute_force_classes(spark):
    rng = random.Random(5)
    rows, i = [], 0
    for _ in range(25):
        base = [f"w{rng.randint(0, 4000)}" for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 5)):
            t = [w if rng.random() > 0.02 else f"v{rng.randint(0, 999)}" for w in base]
            rows += [(i, " ".join(t))] + [(i + 1, "  ".join(t))] * (rng.random() < 0.3)
            i += 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    root = {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, ta in rows:
        for b, tb in rows:
            x, y = ta.split(), tb.split()
            if a < b and abs(len(x) - len(y)) <= 0.2 * max(len(x), len(y)) and 1 - edit(x, y) / max(len(x), len(y)) >= 0.8:
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {k: find(k) for k, _ in rows}
    kept = neardup.keep_one(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_a_shared_passage_is_no_near_duplicate(spark):
    rng = random.Random(6)
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(i, shared + " " + " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60))) for i in range(150)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.select("class_id").distinct().count() == 150


def test_components(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_near_duplicates_odd_tables(spark):
    got = neardup.near_duplicates(odd(spark)).collect()
    assert len(got) == 10
    classes = defaultdict(set)
    for r in got:
        classes[r.class_id].add(r.doc_id)
    assert classes[1] == {1} and classes[4] == {4, 5} and classes[2] == {2, 3, 6, None}
    assert neardup.near_duplicates(empty(spark)).count() == 0 and neardup.keep_one(empty(spark)).count() == 0
    two = spark.createDataFrame([(1, "one two three four five six"), (1, "an other text of six words"), (None, "one two three four five six")], "doc_id long, text string")
    assert sorted(r.text[:3] for r in neardup.keep_one(two).collect()) == ["an ", "one"]
    kept = neardup.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 4, 7]


# 7 passages


def brute(texts):
    seen = defaultdict(list)
    for k in sorted(texts):
        w = texts[k].split()
        for i in range(len(w) - 49):
            seen[tuple(w[i : i + 50])].append((k, i))
    rep, gone = ({k: np.zeros(len(t.split()), bool) for k, t in texts.items()} for _ in range(2))
    for places in seen.values():
        if len(places) > 1:
            for j, (k, i) in enumerate(places):
                rep[k][i : i + 50] = True
                if j:
                    gone[k][i : i + 50] = True
    return rep, gone


def test_passages_are_the_brute_force_ones(spark):
    rng = random.Random(7)
    shared = [[f"p{j}_{i}" for i in range(rng.randint(50, 130))] for j in range(6)]
    texts = {}
    for k in range(60):
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 150))]
        if rng.random() < 0.6:
            at, p = rng.randint(0, len(w)), rng.choice(shared)
            cut = rng.randint(0, 20) if rng.random() < 0.3 else 0
            w[at:at] = p[cut:]
        texts[k] = " ".join(w)
    texts[60] = texts[3]
    texts[61] = " ".join(texts[5].split() * 3)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rep, gone = brute(texts)
    for r in passages.repeated_passages(df, with_text=True).collect():
        x, y = np.zeros(r.n_words, bool), np.zeros(r.n_words, bool)
        for s in r.repeated:
            x[s.start : s.end] = True
        for s in r.removed:
            y[s.start : s.end] = True
        assert (x == rep[r.doc_id]).all() and (y == gone[r.doc_id]).all(), r.doc_id
        assert r.clean_text.split() == [w for w, g in zip(texts[r.doc_id].split(), gone[r.doc_id]) if not g]
    left = {r.doc_id: r.text.split() for r in passages.remove_repeats(df).collect()}
    want = {k: [w for w, g in zip(t.split(), gone[k]) if not g] for k, t in texts.items()}
    assert left == {k: v for k, v in want.items() if v or not texts[k].split()}


def test_a_run_over_many_partitions_keeps_one(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    rng = random.Random(8)
    p = [f"p{i}" for i in range(70)]
    texts = {k: " ".join([f"a{rng.random()}" for _ in range(20)] + p + [f"b{rng.random()}" for _ in range(20)]) for k in range(200)}
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        rows = passages.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert {r.doc_id: r.n_removed for r in rows} == {0: 0, **{k: 70 for k in range(1, 200)}}
    assert all(r.n_repeated == 70 for r in rows) and all(r.seen_in == [0] for r in rows if r.doc_id)


def check_passages(spark, texts):
    rep, gone = brute(texts)
    for r in passages.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        for spans, want in ((r.repeated, rep), (r.removed, gone)):
            x = np.zeros(r.n_words, bool)
            for s in spans:
                x[s.start : s.end] = True
            assert (x == want[r.doc_id]).all(), r.doc_id


def test_shared_words_before_a_hot_stretch(spark):
    rng = random.Random(9)
    new = lambda n: [f"w{rng.random()}" for _ in range(n)]
    hot, pairs = new(45), [new(10) for _ in range(15)]
    texts = {k: " ".join(new(30) + (pairs[k % 20] if k % 20 < 15 and k < 40 else new(10)) + hot + new(30)) for k in range(400)}
    assert sum(x.any() for x in brute(texts)[1].values()) == 15
    check_passages(spark, texts)


def test_later_places_of_a_stretch_in_one_text(spark):
    rng = random.Random(10)
    new = lambda n: [f"w{rng.random()}" for _ in range(n)]
    texts = {}
    for k in range(0, 60, 3):
        s, before, more = new(40), new(15), new(20)
        texts[k] = " ".join(new(60) + before + s + new(60))
        texts[k + 1] = " ".join(new(60) + s + new(60) + before + s + new(60))  # the second place shares more with another text
        texts[k + 2] = " ".join(new(60) + s[:40] + new(60) + s + more + new(60) + s + more + new(60))  # and the third with the second
    check_passages(spark, texts)


def test_passages_are_the_same_on_any_partitions(spark, docs):
    said = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for n in ("1", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted((r.doc_id, r.n_repeated, r.n_removed) for r in passages.repeated_passages(docs).collect()))
        assert got[0] == got[1] and any(r[1] for r in got[0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", said)


def test_neighbours_reach_as_far_as_any_suffix(spark):
    """Windows stay up to the longest prefix that a suffix shares with any other, over Arrow batches of two rows too."""
    rng = random.Random(12)
    rows = []
    for i in range(120):
        beyond = np.array([rng.randint(0, 1) for _ in range(passages.BEYOND)], dtype="<u2")
        at = rng.randint(0, 23)
        first = rng.randint(0, at)
        rows.append((bytes([i]), i, at, rng.randint(0, 2) if i else 9, beyond.tobytes(), first, list(range(100 * i, 100 * i + at - first + 1))))
    df = spark.createDataFrame(rows, "u binary, id long, at int, f long, beyond binary, s int, w array<long>").coalesce(1)
    want = {}
    for r in rows:
        shared = [0]
        for o in rows:
            if o[0] != r[0] and o[3] == r[3]:
                x, y = (np.frombuffer(v[4], "<u2") for v in (r, o))
                shared.append(passages.REACH + next((j for j in range(passages.BEYOND) if x[j] != y[j]), passages.BEYOND))
        kept = [w for j, w in enumerate(r[6]) if r[5] + j + passages.MIN_WORDS <= r[2] + max(shared)]
        if kept:
            want[r[1]] = (r[5], kept)
    edges = [f(rows, key=lambda r: (r[3], r[4], r[0], r[2])) for f in (min, max)]  # without a neighbour on one side: whole
    said = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 1)
        for n in (2, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            got = {r.id: (r.s, r.w) for r in passages._matched(df).collect()}
            assert got == {**want, **{r[1]: (r[5], r[6]) for r in edges}}
    finally:
        for k, v in said.items():
            spark.conf.set(k, v)
    assert 0 < len(want) < len(rows)


def test_passages_odd_tables(spark):
    got = passages.repeated_passages(odd(spark)).collect()
    assert len(got) == 10
    assert {r.doc_id: r.n_removed for r in got if r.doc_id in (4, 5)}[5] == 30_000 and all(r.n_removed == 0 for r in got if r.doc_id in (1, 2, 3, 6, 7))
    assert passages.repeated_passages(empty(spark)).count() == 0 and passages.remove_repeats(empty(spark)).count() == 0
    left = passages.remove_repeats(odd(spark))
    assert left.columns == odd(spark).columns and 5 not in {r.doc_id for r in left.collect()} and left.count() == 9


# 8 language model


class Katz:
    """The backoff model by its definition, one dictionary an order."""

    def __init__(self, train, most):
        self.most = most
        pads = [[None] * (most - 1) + t for t in train]
        self.count = {n: Counter(tuple(t[i - n + 1 : i + 1]) for t in pads for i in range(most - 1, len(t))) for n in range(1, most + 1)}
        self.after = {n: defaultdict(list) for n in range(1, most + 1)}
        for n in range(2, most + 1):
            for g in self.count[n]:
                self.after[n][g[:-1]].append(g[-1])
        self.n = sum(self.count[1].values())
        self.d = {n: katz.discounts([sum(c == k for c in x.values()) for k in range(1, 7)]) for n, x in self.count.items()}
        self.unknown = 1 - sum(self.kept(1, g) for g in self.count[1]) / self.n
        self.weights = {}

    def kept(self, n, g):
        c = self.count[n][g]
        return c * (self.d[n][c] if c <= 5 else 1)

    def total(self, h):
        """What a history's counts are divided by: one more than they sum to if none is discounted."""
        n = len(h) + 1
        c = sum(self.count[n][(*h, w)] for w in self.after[n][h])
        return c, c + (sum(self.kept(n, (*h, w)) for w in self.after[n][h]) > c - 1e-6)

    def weight(self, h):
        if h not in self.weights:
            n = len(h) + 1
            left = 1 - sum(self.kept(n, (*h, w)) for w in self.after[n][h]) / self.total(h)[1]
            rest = 1 - sum(self.p(h[1:], w) for w in self.after[n][h])
            self.weights[h] = left / rest if rest > 1e-12 else 1.0
        return self.weights[h]

    def p(self, h, w):
        n = len(h) + 1
        if n == 1:
            return self.kept(1, (w,)) / self.n if self.count[1][(w,)] else self.unknown
        if not self.after[n][h]:
            return self.p(h[1:], w)
        if self.count[n][(*h, w)]:
            return self.kept(n, (*h, w)) / self.total(h)[1]
        return self.weight(h) * self.p(h[1:], w)


@pytest.mark.parametrize("order", [2, 3])
def test_katz_is_the_brute_force_model(spark, docs, order):
    rows = [(r.doc_id, [*katz.tokens(r.text), None]) for r in docs.limit(60).collect()]
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    model = Katz(train, order)
    uni, n, v = model.count[1], model.n, len(model.count[1])
    for h in [(None,) * (order - 1), *[t[k : k + order - 1] for t in map(tuple, train[:6]) for k in (0, 5)]]:
        if None not in h[1:] and len(h) == order - 1:  # every history's probabilities, the unknown word's included, sum to one
            assert math.isclose(sum(model.p(h, w[0]) for w in uni) + model.p(h, "no such word"), 1.0, rel_tol=1e-9)
    got = {r.doc_id: r for r in katz.score(docs.filter(F.col("doc_id").isin([i for i, _ in rows])), order=order).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(uni[w,] > 0 for w in t), n, zlib.crc32(str(i).encode()) % 5 == 1)
        assert math.isclose(r.base_score, sum(math.log10((uni[w,] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
        padded = [None] * (order - 1) + t
        want = sum(math.log10(model.p(tuple(padded[k : k + order - 1]), w)) for k, w in enumerate(t))
        assert math.isclose(r.score, want, rel_tol=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_katz_beats_unigrams_on_held_out_texts(spark, docs, order):
    got = katz.score(docs, order=order).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_katz_discounts_are_good_turing_on_the_tables(spark):
    """No order falls back: the factors are those of the tables' own counts of counts, between 0 and 1 and rising with the count."""
    rows = [[*katz.tokens(r.text), None] for r in table(spark, "/root/testdata/sf0.01", "documents").select("text").collect()]
    for n in (1, 2, 3):
        c = Counter(tuple(p[i : i + n]) for t in rows for p in [[None] * (n - 1) + t] for i in range(len(t)))
        low = [sum(x == k for x in c.values()) for k in range(1, 7)]
        d = katz.discounts(low)[1:]
        assert all(0 < x < 1 for x in d) and d == sorted(d)
        star = 2 * low[1] / low[0]  # Turing's estimate for what is seen once, which the smoothed one is near to
        assert abs((d[0] * (1 - 6 * low[5] / low[0]) + 6 * low[5] / low[0]) - star) < 0.15


def test_katz_counts_beyond_32_bits():
    many = [katz._pack(katz._gaps(np.array([5, 9], dtype=np.uint64)), np.array([2**32 - 1, 1], dtype="<u4")) for _ in range(3)]
    keys, counts = katz._merged(many)
    assert keys.tolist() == [5, 9] and counts.tolist() == [3 * (2**32 - 1), 3]


def test_katz_blocks_and_shards_do_not_matter(spark, docs, monkeypatch):
    want = {r.doc_id: r.score for r in katz.score(docs).collect()}
    monkeypatch.setattr(katz, "BLOCK", 3000)
    monkeypatch.setattr(katz, "SHARD", 5000)
    got = {r.doc_id: r.score for r in katz.score(docs.repartition(5)).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


@pytest.mark.parametrize("counts", [[], [0, 1], [10, 5, 3, 2, 1, 1], [100, 40, 20, 12, 8, 6], [1, 9, 1, 9, 1, 9], [0, 0, 0, 0, 0, 7], [5, 50, 500, 0, 1, 2]])
def test_discounts_are_between_0_and_1(counts):
    assert all(0 < d < 1 for d in katz.discounts(counts)[1:])


def test_katz_odd_tables(spark):
    rows = katz.score(odd(spark)).collect()
    assert len(rows) == 10 and all(r.n_tokens == 1 for r in rows if r.doc_id in (2, 3, 6)) and all(math.isfinite(r.score) for r in rows)
    assert katz.score(empty(spark)).count() == 0
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    assert katz.score(spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).first().train_tokens == 0


# 9 cleaning, 10 neighbours, and SQL


def views():
    import os

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_is_its_sql(spark, name):
    a = registry.queries()[name](spark, SF).toPandas()
    b = views().sql(registry.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    rows = lambda x: sorted(map(tuple, x[cols].astype(object).values.tolist()))
    assert rows(a) == rows(b)


def test_line_rules():
    good = "This is a whole sentence, with some words in it and an end."
    assert cleaning.line_fails(good, 12) == ""
    assert cleaning.line_fails("Home | News | About | Contact", 7) == "navigation"
    assert cleaning.line_fails("Licensed under the terms", 4) == "boilerplate"
    assert cleaning.line_fails("a$$$ b### c%%%", 3) == "symbols"
    assert cleaning.line_fails("BUY NOW HERE!!", 3) == "shouting"
    assert cleaning.line_fails("word " * 15, 15) == "punctuation"
    doc = "\n".join([f"Line a{i} b{i} has c{i} words d{i}, e{i} f{i} g{i} and ends." for i in range(8)] + ["Home | News | About | Contact"] * 2)
    out = cleaning.judge(doc)
    assert out["kept"] and out["lines_failed"] == {"navigation": 1, "repeat": 1} and "Home" not in out["clean_text"] and out["n_dup_lines"] == 1
    assert not cleaning.judge("\n".join(f"A{i} | B | C | D | E | F" for i in range(20)))["kept"]
    assert cleaning.repeated_words("a b c a b c d".split()) == 6 and cleaning.repeated_words(["x"] * 5) == 5


def test_cleaning_odd_tables(spark):
    rows = cleaning.clean(odd(spark)).collect()
    assert len(rows) == 10 and all(r.base_failed and not r.kept and r.n_words == 0 for r in rows if r.doc_id in (2, 3, 6))
    assert cleaning.clean(empty(spark)).count() == 0


@pytest.mark.parametrize("factor", [1.0, 1.6])
def test_neighbours_recall(spark, factor):
    rng = np.random.default_rng(9)
    x = np.concatenate([c + rng.normal(size=(60, 16)) * 0.3 for c in rng.normal(size=(25, 16)) * 3]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest(df, factor=factor, shard=400).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hit = 0
    for q in range(0, len(x), 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        hit += len(set(np.lexsort((np.arange(len(x)), d))[:10]) & set(got[q]))
    recall = hit / (10 * len(got))
    assert recall == 1.0 if factor == 1.0 else recall >= 0.9


def test_neighbours_of_many_shards_are_their_sql(spark, tmp_path):
    """Several pivots and shards, repeated ids and equal vectors: the operator and its SQL agree."""
    rng = np.random.default_rng(19)
    x = np.round(rng.normal(size=(900, 6)) * 2).astype(np.float32)
    rows = [(i % 700, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/e")
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/e/*.parquet'")
    want = sorted((q, r, round(s, 9)) for q, r, _, s in c.execute(ann.ORACLE).fetchall())
    for shard in (64, 4096):
        got = sorted((r.query_id, r.rank, round(r.score, 9)) for r in ann.nearest(df, shard=shard).collect())
        assert got == want


def test_neighbours_odd_tables(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (100, [1.0, 0.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (None, [1.0, 1.0]), (200, []), (300, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit("x"), "rank": F.lit(0)})
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got] == [(0, 1, 1), (0, 2, 100), (0, 3, 7), (0, 4, 7), (100, 1, 0), (100, 2, 1), (100, 3, 7), (100, 4, 7)]
    assert ann.nearest(df.filter("false")).count() == 0


def test_registry_names():
    names = list(registry.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
