"""Parts shared by the vector searches: reading vectors, centroids of a sample, results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vec_col: str, nonzero: bool) -> DataFrame:
    """``id``, ``vec`` (array of double) of the rows whose vector is there, not empty and finite in every component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    vec = F.col("vec")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).filter(F.col("id").isNotNull() & vec.isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, bad))
    return rows.filter(F.exists(vec, lambda x: x != 0)) if nonzero else rows


def matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def sample(rows: DataFrame, limit: int) -> np.ndarray:
    """At most ``limit`` vectors, those of smallest id hash."""
    return sample_rows_of(rows, limit)[1]


def sample_rows_of(rows: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of ``sample``."""
    top = rows.orderBy(F.xxhash64("id"), "id").limit(limit).select("id", "vec").collect()
    return np.array([r.id for r in top], np.int64), np.array([r.vec for r in top]) if top else np.zeros((0, 1))


def centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """At most k centres of a sample by Lloyd's steps; a centre without vectors splits the largest group."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        new = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], 1) / np.maximum(n, 1)[:, None]
        for e in np.flatnonzero(n == 0):
            members = np.flatnonzero(near == n.argmax())
            new[e] = x[rng.choice(members)]
        c = new
    return c


def nearest(x: np.ndarray, c: np.ndarray, step: int = 4096) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmin(half - x[i : i + step] @ c.T, 1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, int)


def best(found: DataFrame, k: int, nearest_first: bool) -> DataFrame:
    """The k best of each query's partial results (query_id, vec_id, score), with ranks; ties to the smaller id."""
    order = F.asc("score") if nearest_first else F.desc("score")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(order, "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query_blocks(queries: DataFrame, per_block: int):
    """The queries as (ids, matrix) blocks of at most ``per_block``, in order of id: a stated query set against all rows, in blocks."""
    n, after = queries.count(), None
    for _ in range(-(-n // per_block)):
        rest = queries if after is None else queries.filter(F.col("id") > after)
        rows = rest.orderBy("id").limit(per_block).collect()
        if rows:
            after = rows[-1].id
            yield np.array([r.id for r in rows], np.int64), np.array([r.vec for r in rows])
