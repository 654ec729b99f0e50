"""Exact top-k search by inner product (operator 3), with multi-resolution segment statistics.

Vectors are cut into segments. With the mean m and deviation s of each segment, the squared distance of two vectors is at
least sum(len * ((m1 - m2)^2 + (s1 - s2)^2)). As the inner product is (|x|^2 + |y|^2 - distance^2) / 2, that lower bound
on the distance is an upper bound on the score: sum(len * (m1 * m2 + s1 * s2)). It is tried on few segments first, then
on more; what still may reach the k-th best score gets its exact score. Ties at the bound survive, so ties are exact.

Queries and candidates are dealt into blocks of bounded size, and each pair of blocks is one group: a stated set of
queries against all rows, in blocks. Each group gives k rows for each query; a ranking over those gives the result.

Cases: vectors that are null, empty, or hold null, NaN or infinite components take no part; of rows that repeat an id
the least vector counts; rows with a null id take no part; shorter vectors count as filled up with zeros; ties go to the
smaller id; fewer candidates than k give fewer rows; components up to 2^53 and scores up to 2^63 are exact; an empty table gives an empty table; other columns take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 20
LEVELS = (4, 16)
CANDIDATES = 1 << 14, 1 << 10  # rows of a block, at most; and at least, where blocks are fewer than cores
QUERIES = 1 << 14


def usable(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def features(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, scaled so that a product of two rows is the upper bound on their score."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    size = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / size
    square = np.add.reduceat(x * x, edges[:-1], axis=1) / size
    return np.concatenate([mean, np.sqrt(np.maximum(square - mean * mean, 0))], axis=1) * np.sqrt(np.tile(size, 2))


def upper(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bounds on the scores of all pairs from their features, widened by what rounding can take away."""
    bound = x @ y.T
    return bound + 1e-6 * (1 + np.abs(bound))


def search(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int = K) -> tuple[list, list, list]:
    """query id, candidate id, score: the k best of each query among these candidates, without its own row."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    coarse_c, fine_c = features(c, LEVELS[0]), features(c, LEVELS[1])
    # doubles are exact while no sum can reach 2^53; else the scores are those of 64-bit integers
    kind = np.float64 if float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * c.shape[1] < 1 << 53 else np.int64
    c, few = c.astype(kind, copy=False), min(4 * k, len(c))
    out: tuple[list, list, list] = ([], [], [])
    for i in range(0, len(q), 128):
        part, own = q[i : i + 128], q_ids[i : i + 128]
        asked = part.astype(kind, copy=False)
        bound = upper(features(part, LEVELS[0]), coarse_c)
        bound[own[:, None] == c_ids] = -np.inf
        # the k-th best score of those that promise most: what can't reach it drops out, by the coarse bound and then by the fine one
        first = np.argpartition(bound, len(c) - few, axis=1)[:, len(c) - few :]
        some = np.einsum("qfd,qd->qf", c[first], asked).astype(float)
        some[np.take_along_axis(bound, first, 1) == -np.inf] = -np.inf
        least = np.sort(some, axis=1)[:, [-k]] if few >= k else np.full((len(part), 1), -np.inf)
        left = (bound >= least) & (bound > -np.inf)
        left &= upper(features(part, LEVELS[1]), fine_c) >= least
        columns = np.flatnonzero(left.any(axis=0))
        exact = asked @ c[columns].T
        for own_id, row, kept in zip(own.tolist(), exact, left[:, columns], strict=True):
            at = np.flatnonzero(kept)
            best = at[np.lexsort((at, -row[at]))[:k]]  # candidates are in order of their ids
            out[0].extend([own_id] * len(best))
            out[1].extend(c_ids[columns[best]].tolist())
            out[2].extend(row[best].astype(np.int64).tolist())
    return out


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as rows of doubles, filled up with zeros: integers under 2^53 are exact in them."""
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(flat.offsets.to_numpy())
    out = np.zeros((len(flat), width))
    rows = np.repeat(np.arange(len(flat)), sizes)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat.flatten().to_numpy()
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score; components are taken as floor(scale * x)."""
    x = F.transform(F.col("x"), lambda v: F.floor(v.cast("double") * scale).cast("long"))
    df = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"), is_query.alias("asks")).where(F.col("id").isNotNull() & usable(F.col("x")))
    df = df.groupBy("id").agg(F.min("x").alias("x"), F.max("asks").alias("asks")).select("id", x.alias("x"), "asks")
    rows, asking = df.agg(F.count(F.lit(1)), F.sum(F.col("asks").cast("long"))).first()
    n_q = max(1, -(-(asking or 0) // QUERIES))
    n_c = max(1, -(-rows // CANDIDATES[0]), min(2 * vectors.sparkSession.sparkContext.defaultParallelism // n_q, -(-rows // CANDIDATES[1])))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = df.select(block(n_c).alias("cb"), every(n_q).alias("qb"), F.lit(False).alias("asks"), "id", "x")
    queries = df.where("asks").select(every(n_c).alias("cb"), block(n_q).alias("qb"), F.lit(True).alias("asks"), "id", "x")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asks, ids = group.column("asks").to_numpy(), group.column("id").to_numpy()
        width = max(1, int(np.diff(group.column("x").combine_chunks().offsets.to_numpy()).max()))
        m = _matrix(group.column("x"), width)
        got = search(ids[asks], m[asks], ids[~asks], m[~asks], k) if asks.any() and not asks.all() else ([], [], [])
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("query_id", "vec_id", "score"), got, strict=True)})

    best = candidates.unionByName(queries).groupBy("cb", "qb").applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
