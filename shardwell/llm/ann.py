"""Nearest neighbours by vantage-point trees, one tree a shard.

Vectors belong to the nearest of a bounded number of pivots, and a pivot's vectors to shards.  A node of a shard's tree keeps a vantage point
and the median distance to it; a search leaves a side out when the triangle inequality shows that nothing there can beat the k-th best so
far.  ``factor`` relaxes the bound: a side is entered only if ``factor * gap < k-th best`` holds, so 1 gives exact results and larger factors
look at less.

A query meets one shard of its own pivot first, and takes the k-th best distance from there to the other shards: only to those of pivots
whose ball (of the greatest distance to one of its vectors) is not further away than that.  Vectors move once, into the tables that both
searches read; a query moves as often as there are shards that may hold a neighbour.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardwell.llm._common import cut, cut_by

#: Vectors of a shard (about), of a leaf, and pivots of the vectors of one length at most.
SHARD, LEAF, PIVOTS = 4096, 128, 256


def distances(point: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, each squared difference added in component order."""
    d = to - point
    return np.sqrt(np.cumsum(d * d, axis=1)[:, -1]) if d.shape[1] else np.zeros(len(d))


def build(vectors: np.ndarray, seed: int = 7):
    """Vantage-point tree over row numbers: ('leaf', rows) or ('node', row, median, inner, outer).  Depth is logarithmic: sides are split by rank."""
    rng = np.random.default_rng(seed)

    def grow(rows: np.ndarray):
        if len(rows) <= LEAF:
            return ("leaf", rows)
        vantage = int(rows[rng.integers(len(rows))])
        rest = rows[rows != vantage]
        d = np.sqrt(((vectors[rest] - vectors[vantage]) ** 2).sum(axis=1))
        order = np.argsort(d, kind="stable")
        half = len(rest) // 2
        return ("node", vantage, float(d[order[half - 1]]), float(d[order[half]]), grow(rest[order[:half]]), grow(rest[order[half:]]))

    return grow(np.arange(len(vectors)))


def search(tree, vectors: np.ndarray, ids: list, rows_own: set, query: np.ndarray, k: int, factor: float, most: float = np.inf) -> list[tuple[float, int]]:
    """The k nearest rows as (distance, row) that are no further than ``most``, ties to the smaller id; rows in ``rows_own`` are left out."""
    best: list[tuple[float, object, int]] = []  # a heap with the worst on top

    def offer(distance: float, row: int) -> None:
        if row in rows_own or distance > most:
            return
        item = (-distance, _Back(ids[row]), row)
        if len(best) < k:
            heapq.heappush(best, item)
        elif item > best[0]:
            heapq.heapreplace(best, item)

    def slack() -> float:
        return -best[0][0] if len(best) == k else most

    todo = [(0.0, tree)]
    while todo:
        gap, node = todo.pop()
        reach = slack()
        if factor * gap > reach * (1 + 1e-9) + 1e-12:  # ties stay inside
            continue
        if node[0] == "leaf":
            d = distances(query, vectors[node[1]])
            for j in np.flatnonzero(d <= reach) if np.isfinite(reach) else range(len(d)):
                offer(float(d[j]), int(node[1][j]))
            continue
        _, vantage, inner_most, outer_least, inner, outer = node
        d = float(distances(query, vectors[vantage : vantage + 1])[0])
        offer(d, vantage)
        sides = [(max(gap, d - inner_most), inner), (max(gap, outer_least - d), outer)]
        todo += sides if sides[1][0] < sides[0][0] or (sides[1][0] == sides[0][0] and d > inner_most) else sides[::-1]
    return sorted(((-x[0], x[2]) for x in best), key=lambda x: (x[0], ids[x[1]]))


class _Back:
    """Reverses the order of ids, so that a heap drops the larger id of equal distances."""

    __slots__ = ("v",)

    def __init__(self, v) -> None:
        self.v = v

    def __lt__(self, other) -> bool:
        return self.v > other.v

    def __eq__(self, other) -> bool:
        return self.v == other.v


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """_id and _v (doubles) of the vectors that take part: not null, with an id, no null or non-finite component, not all zero."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.col(id_col).cast("long").alias("_id"), v.cast("array<double>").alias("_v")
    )


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, factor: float = 1.0, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """The ``k`` nearest other vectors of each query, a row whose id is divisible by ``every``: query_id, rank (from 1), vec_id, score.

    score: Euclidean distance in double precision.  ``factor`` 1 is exact; larger factors prune more and may miss some.

    Vectors that are null, zero or have null or non-finite components, and null ids, take no part.  Vectors of another length than the
    query's are no candidates.  Ties go to the smaller id.  Repeated ids: each row is a candidate, and a query leaves out its own id's rows
    only once: the row itself.  Fewer than ``k`` candidates: all of them.  Empty table: no rows.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col).withColumn("_dim", F.size("_v"))
    rows = cut(rows.withColumn("_u", F.monotonically_increasing_id()), "ann-rows")  # written, so a row keeps its number
    sizes = rows.groupBy("_dim").agg(F.count("*").alias("n"), F.count_if(F.col("_id") % every == 0).alias("q")).filter("q > 0").collect()  # a row a length
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.col("_dim").isin([r["_dim"] for r in sizes]))
    # pivots: of each length the vectors of least hash, at most PIVOTS, at most one for each shard's worth of vectors
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["_dim"], max(1, r["n"] // (PIVOTS * 16)))])
    most = F.create_map(*[F.lit(x) for r in sizes for x in (r["_dim"], min(PIVOTS, -(-r["n"] // shard)))])
    lot = Window.partitionBy("_dim").orderBy(F.xxhash64("_id", "_u"), "_u")
    some = rows.filter(F.pmod(F.xxhash64("_u", "_id"), share[F.col("_dim")]) == 0)
    some = some.withColumn("_nth", F.row_number().over(lot)).filter((F.col("_nth") <= PIVOTS) & (F.col("_nth") <= most[F.col("_dim")]))
    pivots: dict[int, np.ndarray] = {}
    for r in some.select("_dim", "_nth", "_v").orderBy("_dim", "_nth").collect():  # PIVOTS a length of vectors
        pivots.setdefault(r[0], []).append(r[2])
    pivots = {d: np.array(v, dtype=np.float64).reshape(len(v), d) for d, v in pivots.items()}

    def near_pivot(batches):
        import pyarrow as pa

        for batch in batches:
            vecs, dims = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            cell, far = [0] * len(vecs), [0.0] * len(vecs)
            for d in {d for d in dims if d in pivots}:
                at = [i for i, x in enumerate(dims) if x == d]
                for i in at:
                    to = distances(np.asarray(vecs[i], dtype=np.float64), pivots[d])
                    cell[i] = int(to.argmin())
                    far[i] = float(to[cell[i]])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(cell, pa.int32()), pa.array(far, pa.float64())], names=["_id", "_u", "_v", "_dim", "_cell", "_far"])

    rows = rows.select("_id", "_u", "_v", "_dim").mapInArrow(near_pivot, "_id long, _u long, _v array<double>, _dim int, _cell int, _far double")
    rows = cut(rows, "ann-cells")
    cells = rows.groupBy("_dim", "_cell").agg(F.count("*").alias("n"), F.max("_far").alias("_radius")).withColumn("_shards", F.ceil(F.col("n") / shard))
    balls: dict[int, list] = {}
    for r in cells.orderBy("_dim", "_cell").collect():  # a row a pivot
        balls.setdefault(r["_dim"], []).append((r["_cell"], r["_radius"], r["_shards"]))
    part = lambda piece: F.xxhash64("_dim", "_cell", piece)
    known_cells = F.broadcast(cells.select("_dim", "_cell", "_shards"))  # a row a pivot
    points = rows.join(known_cells, ["_dim", "_cell"])
    points = points.withColumn("_part", part(F.pmod(F.xxhash64("_id", "_u"), F.col("_shards")))).select("_part", "_id", "_u", "_v")
    points = cut_by(points, "_part", "ann-points")
    queries = rows.filter(F.col("_id") % every == 0)

    def run(key, points, queries):
        import pandas as pd

        out: dict[str, list] = {n: [] for n in ("query_id", "_qu", "vec_id", "_vu", "score")}
        if len(points) and len(queries):
            points = points.sort_values(["_id", "_u"])
            vecs = np.array(points["_v"].tolist(), dtype=np.float64)
            ids = list(zip(points["_id"].tolist(), points["_u"].tolist()))
            at = {x: i for i, x in enumerate(ids)}
            tree = build(vecs)
            for q, u, v, most in zip(queries["_id"].tolist(), queries["_u"].tolist(), queries["_v"], queries["_most"].tolist()):
                own = {at[(q, u)]} if (q, u) in at else set()
                for d, row in search(tree, vecs, ids, own, np.asarray(v, dtype=np.float64), k, factor, most):
                    for n, x in zip(out, (q, u, *ids[row], d)):
                        out[n].append(x)
        return pd.DataFrame(out).astype({"query_id": "int64", "_qu": "int64", "vec_id": "int64", "_vu": "int64", "score": "float64"})

    def searched(asked: DataFrame) -> DataFrame:
        """The k best of each (query, shard); ``asked``: _part, _id, _u, _v, _most."""
        return points.groupBy("_part").cogroup(asked.groupBy("_part")).applyInPandas(run, "query_id long, _qu long, vec_id long, _vu long, score double")

    first = queries.join(known_cells, ["_dim", "_cell"]).withColumn("_piece", F.pmod(F.xxhash64("_u", "_id"), F.col("_shards")))
    home = cut(searched(first.select(part(F.col("_piece")).alias("_part"), "_id", "_u", "_v", F.lit(float("inf")).alias("_most"))), "ann-home")
    bound = home.groupBy("query_id", "_qu").agg(F.count("*").alias("_k"), F.max("score").alias("_most")).filter(F.col("_k") >= k)  # k rows a query
    known = first.join(bound.select(F.col("query_id").alias("_id"), F.col("_qu").alias("_u"), "_most"), ["_id", "_u"], "left").withColumn("_most", F.coalesce("_most", F.lit(float("inf"))))

    def reach(batches):
        """The other shards that may hold a neighbour: (query, cell, piece)."""
        import pyarrow as pa

        for batch in batches:
            got: list[list] = [[], [], []]
            for i, (v, dim, most, cell, piece) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 7)))):
                to = distances(np.asarray(v, dtype=np.float64), pivots[dim])
                for c, radius, shards in balls[dim]:
                    if factor * (to[c] - radius) <= most * (1 + 1e-9) + 1e-12:
                        mine = [x for x in range(shards) if (c, x) != (cell, piece)]
                        got[0] += [i] * len(mine)
                        got[1] += [c] * len(mine)
                        got[2] += mine
            at = pa.array(got[0], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in (0, 1, 2, 3, 4)), pa.array(got[1], pa.int32()), pa.array(got[2], pa.int64())], names=["_id", "_u", "_v", "_dim", "_most", "_cell", "_piece"])

    other = known.select("_id", "_u", "_v", "_dim", "_most", "_cell", F.col("_piece").cast("long").alias("_piece"))
    other = other.mapInArrow(reach, "_id long, _u long, _v array<double>, _dim int, _most double, _cell int, _piece long")
    found = home.unionByName(searched(other.select(part(F.col("_piece")).alias("_part"), "_id", "_u", "_v", "_most")))
    order = Window.partitionBy("query_id", "_qu").orderBy("score", "vec_id", "_vu")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS u, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, q.u AS u, c.vec_id AS vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (c.e[i] - q.e[i]) * (c.e[i] - q.e[i])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.u <> c.u AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, u ORDER BY score, vec_id) AS rank FROM d
) WHERE rank <= 10
"""
