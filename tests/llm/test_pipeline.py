"""The pipeline's stages by their contracts on a small corpus, and its result against a plain version of each stage."""

import random

import pytest

import corpus_pipeline
from shardwell.llm import neardup
from shardwell.llm._common import cut
from tests.llm.test_llm import brute, check_packing, edit

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean documents, toxic ones, copies, near copies and passages that repeat, as tables in a folder."""
    rng = random.Random(11)
    line = lambda n: " ".join(f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.randint(0, 3000)}" for _ in range(n)) + "."
    rows, labels, kinds = [], [], {}
    shared = line(80)

    def add(text, kind, toxic):
        i = len(rows)
        rows.append((i, text, "en", f"s{i % 5}", len(text)))
        kinds[i] = kind
        labels.append((i, 1, toxic))

    for _ in range(150):
        add("\n".join(line(rng.randint(8, 15)) for _ in range(8)), "clean", 0)
    for _ in range(60):
        add("\n".join([line(10), f"You stupidzorg {line(4)}", f"What a stupidzorg {line(3)}", line(9)]), "toxic", 1)
    for i in range(0, 20):
        add(rows[i][1], "copy", 0)
    for i in range(20, 40):
        w = rows[i][1].split(" ")
        for _ in range(3):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 999)}"
        add(" ".join(w), "near", 0)
    for _ in range(20):
        add("\n".join([line(70), shared, line(70)]), "passage", 0)
    add("", "blank", 0)
    base = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return str(base), rows, kinds


def test_stages(spark, corpus):
    base, rows, kinds = corpus
    docs = spark.read.parquet(f"{base}/documents.parquet")
    names = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, base), "test-" + name.replace(" ", "-"))
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == names
    ids = lambda name: {r.doc_id for r in kept[name]}
    assert not [i for i in ids("toxicity") if kinds[i] == "toxic"] and all(i in ids("toxicity") for i, k in kinds.items() if k != "toxic")
    left = ids("near-duplicates")
    texts = {r.doc_id: r.text.split() for r in kept["toxicity"]}
    for i in ids("toxicity") - left:
        assert any(1 - edit(texts[i], texts[j]) / max(1, len(texts[i]), len(texts[j])) >= 0.8 for j in left if abs(len(texts[i]) - len(texts[j])) <= 20)
    assert {i for i in left if kinds[i] in ("copy", "near")} == set() and all(i in left for i, k in kinds.items() if k in ("clean", "passage"))
    before = {r.doc_id: r.text for r in kept["near-duplicates"]}
    _, gone = brute(before)
    after = {r.doc_id: r.text for r in kept["repeated passages"]}
    for i, t in before.items():
        want = [w for w, g in zip(t.split(), gone[i]) if not g]
        assert (after[i].split() if i in after else []) == want
    assert all(r.n_chars == len(r.text) for r in kept["repeated passages"])
    copies = {}
    for r in kept["mixing"]:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        assert r.text == after[r.doc_id]
    assert max(copies.values()) <= 2
    words = sum(len(t.split()) for t in after.values())
    assert abs(sum(len(r.text.split()) for r in kept["mixing"]) - 1.5 * words) < 0.02 * words
    check_packing(kept["packing"], 4096)
    assert sum(r.piece == 0 for r in kept["packing"]) == len(kept["mixing"])


def test_run_is_its_stages(spark, corpus):
    base, *_ = corpus
    rows = corpus_pipeline.run(spark, base).collect()
    docs = spark.read.parquet(f"{base}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, base), "again")
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, rows)) == sorted(map(key, docs.collect()))


def test_stages_on_odd_tables(spark, corpus):
    """Null ids, sources and texts, repeated rows, a long text and columns of clashing names and of types without an order."""
    base, *_ = corpus
    long = " ".join(f"w{i % 7919}x{i % 13}" for i in range(30_000))
    rows = [(1, "a b c. d e f.", "s"), (1, "a b c. d e f.", "s"), (None, None, None), (None, "x y z", "s"), (None, "x y z", "s"), (3, "", "t"), (4, long, "t"), (5, long, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.selectExpr("doc_id", "text", "'en' as lang", "source", "cast(length(text) as bigint) as n_chars", "map('k', 1) as extra", "1 as size", "2 as node", "'u' as u", "3 as _lot")
    for table in (docs, docs.filter("false")):
        before = table
        for name, stage in corpus_pipeline.STAGES:
            after = cut(stage(spark, before, base), "odd")
            if name != "packing":
                assert after.columns == docs.columns
            if table is not docs:
                assert after.isEmpty()
            before = after


def test_near_copies_in_large_groups_go(spark, corpus, monkeypatch):
    """Every k-mer is in more texts than are paired fully; of each two near copies one goes."""
    base, *_ = corpus
    monkeypatch.setattr(neardup, "SMALL", 1)
    rng = random.Random(26)
    rows = []
    for i in range(40):
        own = [rng.randrange(3) for _ in range(20)]
        for j in range(2):
            rows.append((2 * i + j, " ".join(f"p{k}v{v}w{n}" for k, v in enumerate(own) for n in range(12))))
            own[rng.randrange(20)] += 3
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, base).collect()) == list(range(0, 80, 2))


def test_a_lazy_result_can_be_handed_on(spark, corpus):
    """A stage's result that isn't written yet still finds the tables that it reads."""
    base, *_ = corpus
    docs = spark.read.parquet(f"{base}/documents.parquet")
    kept = corpus_pipeline.drop_near_copies(spark, docs, base)
    assert corpus_pipeline.mix(spark, kept, base).count() > 0


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "repeated passages", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None


def test_near_copies_look_again_only_at_texts_that_may_be_near_others(spark, monkeypatch):
    """A passage in copies that are connected and in other texts makes a large group, of which no text is left to be paired by its words."""
    rng = random.Random(28)
    base, word = [f"b{i}" for i in range(200)], lambda: f"w{rng.randint(0, 10**9)}"
    texts = []
    for _ in range(100):
        w = list(base)
        for i in rng.sample(range(200), 8):
            w[i] = word()
        texts.append(" ".join(w))
    texts += [" ".join(base[:60] + [word() for _ in range(140)]) for _ in range(100)]
    seen, found = [], neardup._with_prefix
    monkeypatch.setattr(neardup, "_with_prefix", lambda rows, least: seen.append(rows.count()) or found(rows, least))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert kept == [0, *range(100, 200)]
    assert seen == [0]
