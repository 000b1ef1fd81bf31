"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is logistic in the features it holds (words and their beginnings); the
document's is the noisy-or of its sentences, ``1 - (1 - p0) * prod(1 - p_s)``, so that labels of documents train the scores of sentences,
and the sentences that make a document toxic can be pointed out.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwell.llm._common import cut, fold, map_texts

#: Labelled documents that the model is fitted on at most (by hash of the id).
SAMPLE = 20_000
_sentence = re.compile(r"[^.!?\n…]+")
_word = re.compile(r"\w+")
BEGINNINGS = (4, 5, 6, 7)


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each stretch between sentence marks that holds a word."""
    return [m.span() for m in _sentence.finditer(text) if _word.search(m[0])]


def features(word: str) -> list[str]:
    """The word itself and its first letters, marked as such."""
    return [word, *(word[:k] + "-" for k in BEGINNINGS if len(word) > k)]


def training_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, most: int, id_col: str, text_col: str) -> DataFrame:
    """_id, _text and _y of at most ``most`` labelled documents outside the held-out fold, the first by hash of the id.

    Of the rows of a repeated id the text with the least hash is taken.  The bound makes the labels' side small enough to broadcast, whatever
    the input's size, and holds for what is returned too.
    """
    lab = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, mod) != held))
    lab = lab.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("double").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = texts.join(F.broadcast(lab), "_id").groupBy("_id", "_y").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), "_text")).alias("x"))
    return rows.select("_id", F.col("x._text").alias("_text"), "_y")


def choose(sample: DataFrame) -> tuple[list[str], int, int]:
    """All features whose share of documents is significantly higher among toxic ones, by log-likelihood ratio; bounded by the sample."""

    def setup():
        def make(rows):
            count: dict[str, list[int]] = {}
            for text in rows:
                y, text = text[0] == "1", text[1:]
                for f in {f for w in set(_word.findall(text.lower())) for f in features(w)}:
                    count.setdefault(f, [0, 0])[y] += 1
            return [0] * len(count), [list(count), [v[0] for v in count.values()], [v[1] for v in count.values()]]

        return make

    text = F.concat(F.when(F.col("_y") > 0, F.lit("1")).otherwise(F.lit("0")), F.col("_text"))
    counts = map_texts(sample, [], text.alias("_t"), setup, "f string, clean long, toxic long", rows=512)
    counts = counts.groupBy("f").agg(F.sum("clean").alias("b"), F.sum("toxic").alias("a")).filter("a >= 2")
    n = sample.agg(F.sum((F.col("_y") > 0).cast("long")), F.sum((F.col("_y") <= 0).cast("long"))).first()
    na, nb = int(n[0] or 0), int(n[1] or 0)
    if not na or not nb:
        return [], na, nb
    p = (F.col("a") + F.col("b")) / (na + nb)

    def term(k, of):
        q = (k + 1e-9) / of
        return k * F.log(q / p) + (of - k) * F.log((1 - q + 1e-9) / (1 - p + 1e-9))

    gain = 2 * (term(F.col("a"), float(na)) + term(F.col("b"), float(nb)))
    top = counts.withColumn("g", gain).filter((F.col("a") / na > 2 * F.col("b") / nb) & (F.col("g") > 6)).select("f")
    return sorted(r[0] for r in top.collect()), na, nb


def bags(text: str, index: dict[str, int]) -> list[tuple[int, int, list[int]]]:
    """(start, end, features) of the sentences that hold any chosen feature."""
    low = text.lower()
    if len(low) != len(text):  # a few letters change length in lower case: keep the spans right
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out = []
    for lo, hi in sentences(low):
        found = {index[f] for w in set(_word.findall(low, lo, hi)) if w[:4] in index["\0heads"] for f in features(w) if f in index}
        if found:
            out.append((lo, hi, sorted(found)))
    return out


def with_heads(chosen: list[str]) -> dict:
    """Feature to number, and the first four letters of all, which tell at once that a word has none."""
    index: dict = {f: i for i, f in enumerate(chosen)}
    index["\0heads"] = {f.rstrip("-")[:4] for f in chosen}
    return index


def fit(rows: list[tuple[float, list[list[int]]]], n: int, rounds: int = 300, l2: float = 2e-4) -> tuple[np.ndarray, float, float]:
    """Weights, bias and p0 by Adam on the documents' log-likelihood."""
    y = np.array([r[0] for r in rows]) > 0
    doc = np.array([i for i, r in enumerate(rows) for _ in r[1]], dtype=np.int64)
    sent = np.array([k for k, s in enumerate(s for r in rows for s in r[1]) for _ in s], dtype=np.int64)
    feat = np.array([f for r in rows for s in r[1] for f in s], dtype=np.int64)
    none = np.array([not r[1] for r in rows])
    p0 = min(0.4, max(1e-4, (y[none].sum() + 0.5) / (none.sum() + 1.0)))
    w, b = np.full(n, 1.0), -2.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(sent, w[feat], len(doc)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_clean = math.log(1 - p0) + np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(rows))
        dirty = np.maximum(1 - np.exp(log_clean), 1e-9)
        # d loss / d log_clean, then d log_clean / dz = -p
        d = np.where(y, np.exp(log_clean) / dirty, -1.0)
        gz = -d[doc] * p / len(rows)
        g = np.append(np.bincount(feat, gz[sent], n) + l2 * w, gz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:n], b - step[n]
    return w, float(b), float(p0)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 5, held: int = 0, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The fitted model: features, weights, bias, p0."""
    sample = cut(training_sample(docs, labels, label, mod, held, most, id_col, text_col), "toxic-sample")
    chosen, na, nb = choose(sample)
    if not chosen:
        return {"features": [], "weights": [], "bias": 0.0, "p0": min(0.4, (na + 0.5) / (na + nb + 1.0) if na + nb else 0.1)}
    index = with_heads(chosen)

    def setup():
        def make(texts):
            return list(range(len(texts))), [[[x[2] for x in bags(t, index)] for t in texts]]

        return make

    rows = map_texts(sample, [F.col("_y")], F.col("_text"), setup, "bags array<array<int>>").collect()  # bounded by the sample
    w, b, p0 = fit(sorted((r[0], r[1]) for r in rows), len(chosen))
    return {"features": chosen, "weights": [round(float(x), 6) for x in w], "bias": round(b, 6), "p0": p0}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", mark: float = 0.5) -> DataFrame:
    """Per row: id, score, and ``offending``: (start, end, score) of the sentences with a probability of at least ``mark``.

    Null or empty text: no sentence, so the score is p0.  Null ids and repeated rows: each row is scored.  Empty table: no rows.  Whole
    texts are read.  Other columns are ignored, whatever their names.
    """
    index = with_heads(model["features"])
    w, b, p0 = model["weights"], model["bias"], model["p0"]

    def setup():
        def make(texts):
            scores, spans = [], []
            for t in texts:
                clean, bad = 1.0 - p0, []
                for lo, hi, found in bags(t or "", index):
                    p = 1 / (1 + math.exp(-max(-30.0, min(30.0, b + sum(w[f] for f in found)))))
                    clean *= 1 - p
                    if p >= mark:
                        bad.append({"start": lo, "end": hi, "score": p})
                scores.append(1.0 - clean)
                spans.append(bad)
            return list(range(len(texts))), [scores, spans]

        return make

    return map_texts(docs, [F.col(id_col).alias("_id")], F.col(text_col).alias("_text"), setup, "score double, offending array<struct<start:int,end:int,score:double>>").withColumnRenamed("_id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Train on ``labels`` outside the held-out fold and score all ``docs``: id, held_out, score, predicted, offending.

    Labels that are null are left out; a document labelled more than once is toxic if any label says so.  Without labels of both kinds the
    score is the share of toxic labels.  See ``score`` for nulls, empty texts and repeated rows.
    """
    out = score(docs, train(docs, labels, mod=mod, held=held, id_col=id_col, text_col=text_col, **options), id_col, text_col)
    return out.select(id_col, (fold(id_col, mod) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


def filter_documents(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score is 0.5 or more; the columns stay as they are."""
    names = docs.columns
    index = with_heads(model["features"])
    w, b, p0 = model["weights"], model["bias"], model["p0"]

    def setup():
        def make(texts):
            stay = []
            for i, t in enumerate(texts):
                clean = 1.0 - p0
                for _, _, found in bags(t or "", index):
                    clean *= 1 - 1 / (1 + math.exp(-max(-30.0, min(30.0, b + sum(w[f] for f in found)))))
                if 1.0 - clean < 0.5:
                    stay.append(i)
            return stay, []

        return make

    return map_texts(docs, list(names), F.col(text_col), setup, "")
