"""Mixing sources to target weights by entropy balancing.

Every document gets a rate between 0 and ``cap`` copies.  Among all rates that meet each source's token target, entropy balancing takes
those nearest (in relative entropy of a draw of up to ``cap`` copies) to one copy of each document; they are an exponential tilt in the
document's token count, ``rate / (cap - rate) = exp(b + lambda_source * tokens)``, and the multipliers minimise a convex dual function.
Newton steps find them; each step is one distributed aggregate.  A rate depends only on source and size, so the sums run over counts of
(source, size), which lose nothing.  The rates are then rounded into whole copies.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwell.llm._common import cut, n_words

#: Newton steps at most; each is a job of its own, with a small plan.
STEPS = 60
#: Documents of one (source, size) that are ranked together, about.
GROUP = 1000


def _rate(lam: Column, x: Column, cap: int) -> Column:
    b = F.log(F.lit(1.0 / (cap - 1))) if cap > 1 else F.lit(20.0)
    z = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), b + lam * x))
    return F.lit(float(cap)) / (F.lit(1.0) + F.exp(-z))


def targets(cells: DataFrame, weights: tuple[float, ...], share: float, cap: int) -> DataFrame:
    """A row per source: its size, target and scale.

    Sources in code point order, null last, take ``weights`` in turn and share ``share`` times all sizes; a target stops at ``cap`` times
    its source's size and the rest is shared by weight among the others (solved at once: sorted by the level at which each source is full).
    """
    per = cells.groupBy("_k").agg(
        F.first("_src").alias("_src"),
        F.sum(F.col("_size") * F.col("_n")).alias("_s"),
        F.sum(F.col("_size").cast("double") * F.col("_size") * F.col("_n")).alias("_s2"),
    )
    every = Window.partitionBy()
    turn = F.row_number().over(Window.orderBy(F.col("_src").asc_nulls_last()))
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((turn - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("_full", F.col("_s") * F.lit(float(cap))).withColumn("_level", F.col("_full") / F.col("_w"))
    upward = Window.orderBy("_level", F.col("_src").asc_nulls_last())
    before = upward.rowsBetween(Window.unboundedPreceding, -1)
    onward = upward.rowsBetween(0, Window.unboundedFollowing)
    budget = F.sum("_s").over(every) * F.lit(float(share))
    level = (budget - F.coalesce(F.sum("_full").over(before), F.lit(0.0))) / F.sum("_w").over(onward)
    per = per.withColumn("_theta", level).withColumn("_is_full", F.col("_level") <= F.col("_theta"))
    theta = F.min(F.when(~F.col("_is_full"), F.struct("_level", "_theta"))).over(every)["_theta"]
    return per.withColumn("_t", F.when(F.col("_is_full"), F.col("_full")).otherwise(F.least(F.col("_full"), F.col("_w") * theta))).select(
        "_k", "_s", "_t", (F.when(F.col("_s") > 0, F.col("_s2") / F.col("_s")).otherwise(F.lit(1.0))).alias("_scale")
    )


def _newton(state: DataFrame, cells: DataFrame, cap: int) -> DataFrame:
    """One safeguarded Newton step of every source's multiplier."""
    x = F.col("_size") / F.col("_scale")
    rate = _rate(F.col("_lam"), x, cap)
    s = (
        cells.join(state, "_k")
        .groupBy(*state.columns)  # one row a source
        .agg(
            F.sum(F.col("_n") * F.col("_size") * rate).alias("_got"),
            F.sum(F.col("_n") * F.col("_size") * x * rate * (1 - rate / cap)).alias("_slope"),
        )
    )
    off = F.col("_got") - F.col("_t")
    lo = F.when(off < 0, F.col("_lam")).otherwise(F.col("_lo"))
    hi = F.when(off > 0, F.col("_lam")).otherwise(F.col("_hi"))
    s = s.withColumn("_off", F.when(F.col("_t") > 0, F.abs(off) / F.col("_t")).otherwise(F.lit(0.0))).withColumn("_lo", lo).withColumn("_hi", hi)
    reach = F.greatest(F.lit(1.0), F.abs(F.col("_lam")))
    step = F.greatest(-reach, F.least(reach, -off / F.greatest(F.col("_slope"), F.lit(1e-30))))
    new = F.col("_lam") + step
    new = F.when((new <= F.col("_lo")) | (new >= F.col("_hi")), (F.col("_lo") + F.col("_hi")) / 2).otherwise(new)
    return s.select("_k", "_s", "_t", "_scale", "_lo", "_hi", "_off", F.when(F.col("_free") & (F.col("_off") > 1e-12), new).otherwise(F.col("_lam")).alias("_lam"), "_free")


def rates(cells: DataFrame, weights: tuple[float, ...], share: float, cap: int) -> tuple[DataFrame, DataFrame]:
    """(cells with the tilted rate, per-source state).  ``cells``: _k, _src, _size, _n."""
    state = targets(cells, weights, share, cap)
    free = (F.col("_t") > 0) & (F.col("_t") < F.col("_s") * F.lit(cap * (1 - 1e-9)))
    state = cut(
        state.select("*", F.lit(-1e9).alias("_lo"), F.lit(1e9).alias("_hi"), F.lit(1.0).alias("_off"), F.lit(0.0).alias("_lam"), free.alias("_free")),
        "mix-state",
    )
    for _ in range(STEPS):
        state = cut(_newton(state, cells, cap), "mix-state")
        worst = state.filter("_free").agg(F.max("_off")).first()[0]
        if worst is None or worst < 1e-9:
            break
    else:
        if worst > 1e-6:
            raise RuntimeError(f"no multipliers after {STEPS} steps: a source is off its target by {worst:.2g}")
    lam = F.round(F.col("_lam"), 9)
    rate = F.when(F.col("_free"), _rate(lam, F.col("_size") / F.col("_scale"), cap)).when(F.col("_t") > 0, F.lit(float(cap))).otherwise(F.lit(0.0))
    return cells.join(state.select("_k", "_s", "_t", "_scale", "_lam", "_free"), "_k").withColumn("_rate", rate), state


def rounded(cells: DataFrame, state: DataFrame, cap: int) -> DataFrame:
    """Whole copies of each cell.

    Cumulated rates are rounded in order of falling size, so that a source's words miss its target by half its longest document at most;
    two repairs then move one copy of the size nearest to what is still missing.
    """
    down = Window.partitionBy("_k").orderBy(F.col("_size").desc())
    upto = F.round(F.round(F.sum(F.col("_rate") * F.col("_n")).over(down.rowsBetween(Window.unboundedPreceding, 0)), 6)).cast("long")
    out = cells.withColumn("_upto", upto)
    out = out.withColumn("_c", F.col("_upto") - F.coalesce(F.lag("_upto").over(down), F.lit(0)))
    out = cut(out.withColumn("_c", F.greatest(F.lit(0), F.least(F.col("_c"), F.col("_n") * cap))).drop("_upto"), "mix-cells")
    for _ in range(2):
        got = out.groupBy("_k").agg(F.sum(F.col("_c") * F.col("_size")).alias("_got"))
        miss = F.col("_t") - F.col("_got")
        can = F.when(miss > 0, F.col("_c") < F.col("_n") * cap).otherwise(F.col("_c") > 0) & (F.col("_size") > 0)
        left = F.abs(F.abs(miss) - F.col("_size"))
        pick = (
            out.join(got, "_k")
            .filter(F.col("_free") & can & (left < F.abs(miss)))
            .groupBy("_k")
            .agg(F.min(F.struct(left.alias("left"), F.col("_size").alias("size"), F.signum(miss).cast("long").alias("by"))).alias("_p"))
        )
        out = out.join(pick, "_k", "left").withColumn("_c", F.col("_c") + F.when(F.col("_size") == F.col("_p.size"), F.col("_p.by")).otherwise(F.lit(0))).drop("_p")
    return cut(out, "mix-cells")


def _lot(id_col: str, text_col: str) -> Column:
    """A number by which the documents of one source and size are ordered; rows of equal id and text have the same."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def _narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    source = F.col(source_col)
    return [F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source)).alias("_k"), n_words(text_col).alias("_size"), _lot(id_col, text_col).alias("_lot")]


def plan(docs: DataFrame, weights: tuple[float, ...], share: float, cap: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """A row per source and size: what every document of it gets (``_each``), and up to which lot one copy more (``_upto``).

    Of the ``_have`` documents with that very lot (more than one only if rows repeat) ``_need`` get it.  The lot is found by counting lots in
    ranges of about ``GROUP`` documents and ordering one range.
    """
    base = cut(docs.select(F.col(source_col).alias("_src"), *_narrow(docs, id_col, text_col, source_col)), "mix-docs")
    cells = cut(base.groupBy("_k", "_size").agg(F.first("_src").alias("_src"), F.count("*").alias("_n")), "mix-cells")
    rated, state = rates(cells, weights, share, cap)
    out = rounded(rated, state, cap)
    out = out.withColumn("_each", F.floor(F.col("_c") / F.col("_n"))).withColumn("_more", F.col("_c") - F.col("_each") * F.col("_n"))
    some = out.filter("_more > 0").select("_k", "_size", "_more", F.ceil(F.col("_n") / GROUP).alias("_groups"))
    # ranges in the order of lots: the upper 32 bits, moved above 0, times the number of ranges
    range_ = F.shiftright((F.shiftright("_lot", 32) + F.lit(2**31)) * F.col("_groups"), 32)
    lots = base.select("_k", "_size", "_lot").join(some, ["_k", "_size"]).withColumn("_b", range_)
    counts = lots.groupBy("_k", "_size", "_b").agg(F.count("*").alias("_in"), F.first("_more").alias("_more"))
    below = Window.partitionBy("_k", "_size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_from", F.coalesce(F.sum("_in").over(below), F.lit(0)))
    hit = counts.filter((F.col("_from") < F.col("_more")) & (F.col("_from") + F.col("_in") >= F.col("_more"))).select("_k", "_size", "_b", "_from")
    same = lots.join(hit, ["_k", "_size", "_b"]).groupBy("_k", "_size", "_lot").agg(F.count("*").alias("_have"), F.first("_from").alias("_from"), F.first("_more").alias("_more"))
    before = Window.partitionBy("_k", "_size").orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)
    same = same.withColumn("_below", F.col("_from") + F.coalesce(F.sum("_have").over(before), F.lit(0)))
    last = same.filter((F.col("_below") < F.col("_more")) & (F.col("_below") + F.col("_have") >= F.col("_more")))
    last = last.select("_k", "_size", F.col("_lot").alias("_upto"), "_have", (F.col("_more") - F.col("_below")).alias("_need"))
    return cut(out.join(last, ["_k", "_size"], "left").select("_k", "_size", "_s", "_t", "_rate", "_each", "_upto", "_have", "_need"), "mix-plan")


def _copies(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """``rows`` (with _k, _size and _lot) with the plan's columns and ``_copies``."""
    rows = rows.join(planned, ["_k", "_size"])
    more = F.col("_lot") <= F.col("_upto")
    if not planned.filter("_need < _have").isEmpty():  # rows that are alike in id and text share what is left
        tied = F.col("_lot") == F.col("_upto")
        same = F.coalesce(tied & (F.col("_need") < F.col("_have")), F.lit(False))
        rest = rows.filter(~same).withColumn("_nth", F.lit(0))
        alike = rows.filter(same).withColumn("_nth", F.row_number().over(Window.partitionBy("_k", "_size").orderBy("_lot")))
        rows = rest.unionByName(alike)
        more = more & ((F.col("_nth") == 0) | (F.col("_nth") <= F.col("_need")))
    return rows.withColumn("_copies", F.col("_each") + F.coalesce(more, F.lit(False)).cast("long"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    cap: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Copies of each document that bring every source to its token target.

    Returns a row per input row: ``id_col``, source, size (words), source_size, target (of its source), rate, copies, taken = copies * size.

    Null or empty text: size 0, one copy, nothing taken.  Null source: a source of its own, ordered last.  Repeated rows and ids: each row
    counts.  Ties: rows of equal source and size are told apart by a hash of id and text; rows equal in both are alike.  Very long texts: only
    their number of words counts.  Empty table: no rows.  A source without words has target 0.  Other columns are ignored, whatever their names.
    """
    planned = plan(docs, weights, share, cap, id_col, text_col, source_col)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_src"), *_narrow(docs, id_col, text_col, source_col))
    copies = F.col("_copies")
    return _copies(rows, planned).select(
        F.col("_id").alias(id_col),
        F.col("_src").alias(source_col),
        F.col("_size").alias("size"),
        F.col("_s").cast("long").alias("source_size"),
        F.col("_t").cast("double").alias("target"),
        F.col("_rate").alias("rate"),
        copies.alias("copies"),
        (copies * F.col("_size")).alias("taken"),
    )


def repeat_documents(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    cap: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with each row repeated as often as ``mix`` takes it (not at all if it takes none); the columns stay as they are.

    A row's copies follow from its own source, size and lot and from the plan, so texts stay where they are.  Columns of any type and name may
    be there; nulls, empty texts, repeated rows and empty tables are as for ``mix``.
    """
    names = docs.columns
    planned = plan(docs, weights, share, cap, id_col, text_col, source_col)
    at = {c: f"c{i}" for i, c in enumerate(names)}
    keyed = docs.select(*[F.col(c).alias(at[c]) for c in names])
    rows = keyed.select("*", *_narrow(keyed, at[id_col], at[text_col], at[source_col]))
    rows = _copies(rows, planned).filter("_copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*[F.col(at[c]).alias(c) for c in names])
