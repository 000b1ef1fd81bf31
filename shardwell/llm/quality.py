"""Quality classifier by a sparse rule ensemble.

Statistics of each text are Spark columns.  On a bounded sample of labelled rows, small boosted trees are grown over the statistics; each
path from a root to a node is a rule, a conjunction of comparisons.  Lasso logistic regression keeps few of the rules, and those are
compiled into one Spark expression that scores every row in the JVM.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwell.llm._common import WORD, fold
from shardwell.llm.toxicity import training_sample

#: Labelled documents that the rules are fitted on at most (by hash of the id).
SAMPLE = 20_000
TREES, DEPTH, BINS = 40, 3, 32


#: Counted signs, as character classes.
SIGNS = {
    "white": r"[ \t\n\r]",
    "symbols": r"[#*$%&<>@~^_=+{}\[\]\\]",
    "bars": r"[|]",
    "shouts": r"[!]",
    "stops": r"[.?…]",
    "commas": r"[,;:]",
    "digits": r"[0-9]",
    "capitals": r"[A-Z]",
}
NAMES = ("words", "word_length", "symbols", "bars", "shouts", "stops", "commas", "digits", "capitals", "line_words", "own_lines", "own_words")


def _with(docs: DataFrame, text_col: str, keep: list[Column]) -> tuple[DataFrame, list[str]]:
    """Statistics of each text as columns; every one is defined (0 or more) for null and empty texts.

    Counts are columns of their own first, so that what several statistics need is counted once.
    """
    kept = [f"k{i}" for i in range(len(keep))]
    names = docs.select(*keep).columns
    rows = docs.select(*[c.alias(k) for c, k in zip(keep, kept)], F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    counts = {k: F.regexp_count("t", F.lit(v)).cast("double").alias(k) for k, v in SIGNS.items()}
    lines, tokens = F.filter(F.split("t", "\n"), lambda x: F.length(F.trim(x)) > 0), F.split(F.lower("t"), r"[\x20\x09-\x0D]+")
    rows = rows.select(*kept, F.length("t").cast("double").alias("n"), F.regexp_count("t", F.lit(WORD)).cast("double").alias("words"), *counts.values(), lines.alias("lines"), tokens.alias("tokens"))

    def share(of: Column, by: Column) -> Column:
        return F.when(by > 0, of / by).otherwise(F.lit(0.0))

    words, n, size = F.col("words"), F.col("n"), lambda c: F.size(c).cast("double")
    stats = {
        "words": words,
        "word_length": share(n - F.col("white"), words),
        **{k: share(F.col(k), words) for k in ("symbols", "bars", "shouts", "stops", "commas")},
        **{k: share(F.col(k), n) for k in ("digits", "capitals")},
        "line_words": share(words, size("lines")),
        "own_lines": share(size(F.array_distinct("lines")), size("lines")),
        "own_words": share(size(F.array_distinct("tokens")), size("tokens")),
    }
    out = rows.select(*kept, *[F.round(stats[k], 6).alias(f"s_{k}") for k in NAMES])
    return out.toDF(*names, *[f"s_{k}" for k in NAMES]), [f"s_{k}" for k in NAMES]


def grow(x: np.ndarray, y: np.ndarray, seed: int = 3) -> list[tuple[tuple[int, float, bool], ...]]:
    """Rules of boosted trees: each a sorted tuple of (column, threshold, above)."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    f = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rules: dict[tuple, None] = {}

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray, columns: np.ndarray):
        best = (1e-6, None)
        for j in columns:
            k = len(cuts[j])
            if not k:
                continue
            gs, hs = np.bincount(binned[rows, j], g[rows], k + 1).cumsum(), np.bincount(binned[rows, j], h[rows], k + 1).cumsum()
            gl, hl = gs[:-1], hs[:-1]
            gr, hr = gs[-1] - gl, hs[-1] - hl
            gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - gs[-1] ** 2 / (hs[-1] + 1)
            gain[(hl < 0.5) | (hr < 0.5)] = 0
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (float(gain[at]), (int(j), at))
        return best[1]

    def node(rows, g, h, path, depth, out, columns):
        if path:
            rules.setdefault(tuple(sorted(path)))
        at = split(rows, g, h, columns) if depth < DEPTH and len(rows) >= 10 else None
        if at is None:
            out[rows] = -g[rows].sum() / (h[rows].sum() + 1)
            return
        j, k = at
        low = binned[rows, j] <= k
        node(rows[low], g, h, [*path, (j, float(cuts[j][k]), False)], depth + 1, out, columns)
        node(rows[~low], g, h, [*path, (j, float(cuts[j][k]), True)], depth + 1, out, columns)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        rows = np.sort(rng.choice(len(y), max(1, len(y) * 7 // 10), replace=False))
        columns = rng.permutation(x.shape[1])[: max(4, x.shape[1] * 2 // 3)]
        out = np.zeros(len(y))
        g, h = p - y, p * (1 - p) + 1e-9
        node(rows, g, h, [], 0, out, columns)
        f = f + 0.3 * out
    return list(rules)


def holds(x: np.ndarray, rule) -> np.ndarray:
    ok = np.ones(len(x), dtype=bool)
    for j, cut, above in rule:
        ok &= (x[:, j] > cut) if above else (x[:, j] <= cut)
    return ok


def lasso(r: np.ndarray, y: np.ndarray, strength: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights with an absolute-value penalty, by accelerated proximal gradient; the intercept is free."""
    n, k = r.shape
    step = 4.0 * n / max(1.0, float(np.linalg.norm(np.hstack([r, np.ones((n, 1))]), 2) ** 2))
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    zw, zb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        e = 1 / (1 + np.exp(-np.clip(r @ zw + zb, -30, 30))) - y
        nw = zw - step * (r.T @ e) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * strength, 0)
        nb = zb - step * float(e.mean())
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        zw, zb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def fit(x: np.ndarray, y: np.ndarray, strength: float = 1e-3) -> dict:
    """{"rules": [...], "weights": [...], "bias": b}; constant labels give no rule."""
    if not len(y) or y.min() == y.max():
        p = min(0.999, max(0.001, float(y.mean()) if len(y) else 0.5))
        return {"rules": [], "weights": [], "bias": float(np.log(p / (1 - p)))}
    rules = grow(x, y)
    r = np.stack([holds(x, rule) for rule in rules], axis=1).astype(np.float64)
    _, first = np.unique(r, axis=1, return_index=True)  # rules that hold for the same rows: the first
    first = np.sort(first)
    w, b = lasso(r[:, first], y, strength)
    keep = np.flatnonzero(np.abs(w) > 1e-9)
    return {"rules": [rules[first[i]] for i in keep], "weights": [round(float(w[i]), 6) for i in keep], "bias": round(b, 6)}


def compile_rules(model: dict, names: list[str]) -> Column:
    """The score as one expression over statistics columns."""
    z = F.lit(model["bias"])
    for rule, w in zip(model["rules"], model["weights"]):
        ok = None
        for j, cut, above in rule:
            c = F.col(names[j]) > F.lit(cut) if above else F.col(names[j]) <= F.lit(cut)
            ok = c if ok is None else ok & c
        z = z + F.when(ok, F.lit(w)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 3, held: int = 1, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Rules fitted on at most ``most`` labelled documents outside the held-out fold, the first by hash of the id; see ``training_sample``."""
    texts = training_sample(docs, labels, label, mod, held, most, id_col, text_col)
    rows, names = _with(texts, "_text", [F.col("_id"), F.col("_y")])
    data = np.array(sorted(tuple(r)[1:] for r in rows.collect()), dtype=np.float64).reshape(-1, len(names) + 1)  # `most` rows
    return fit(data[:, 1:], data[:, 0])


def quality(docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Train on ``labels`` outside the held-out fold and score all ``docs``: id, held_out, score, predicted and the statistics (s_...).

    Null or empty text: all statistics are 0 and the rules apply to them.  Null labels are left out; a document labelled more than once is
    good if any label says so; without labels of both kinds the score is the share of good labels.  Null ids and repeated rows: each row is
    scored.  Empty table: no rows.  Whole texts are read.  Other columns are ignored, whatever their names.
    """
    model = train(docs, labels, mod=mod, held=held, id_col=id_col, text_col=text_col, **options)
    rows, names = _with(docs, text_col, [F.col(id_col).alias("_id")])
    out = rows.withColumn("score", compile_rules(model, names))
    return out.select(F.col("_id").alias(id_col), (fold("_id", mod) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *names)
