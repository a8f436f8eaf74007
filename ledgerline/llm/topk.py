"""Exact top-k inner products by block-at-a-time pruning.

Vectors are ordered so that similar ones are neighbours and cut into blocks,
each with a forward index and, per term, its largest and smallest component.
For a query, the summed term maxima bound every score in a block; blocks are
scored through their forward indexes in order of that bound, until it falls
below the k-th score found.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import stage, table
from ledgerline.llm.vectors import best, centroids, matrix, nearest, query_blocks, sample, sample_rows_of, usable


def build_blocks(rows: DataFrame, block_rows: int = 128, sample_rows: int = 4000, ranges: int = 64) -> DataFrame:
    """``ids``, ``forward`` (row-major int64 components), ``high`` and ``low`` per term, of blocks of ``block_rows`` vectors.

    The order puts each vector at its nearest of ``ranges`` centres of a
    sample of at most ``sample_rows`` vectors; the sample shapes the order
    alone, and every vector is in a block. Ties of a centre are spread by id.
    """
    spark = rows.sparkSession
    c = centroids(sample(rows, sample_rows), ranges)
    held = spark.sparkContext.broadcast(c)  # ranges x dimensions

    def place(batches):
        import pyarrow as pa

        for b in batches:
            x = matrix(b.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(nearest(x, held.value) if len(x) else [], pa.int32()), b.column(0), b.column(1)], names=["cell", "id", "vec"])

    order = ["cell", "id"]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = stage(rows.mapInArrow(place, "cell int, id long, vec array<double>"), "topk-cells")
    ranged = placed.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def cut(batches):
        import pyarrow as pa

        def block(ids, x):
            return [ids.tobytes(), x.tobytes(), x.max(0).tobytes(), x.min(0).tobytes(), len(ids)]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.binary()] * 4 + [pa.int32()], strict=True)], names=["ids", "forward", "high", "low", "n"])

        ids, x, ready = np.zeros(0, np.int64), None, []
        for b in batches:
            if not b.num_rows:
                continue
            new = matrix(b.column(2)).astype(np.int64)
            ids, x = np.append(ids, b.column(1).to_numpy()), new if x is None else np.concatenate([x, new])
            while len(ids) >= block_rows:
                ready.append(block(ids[:block_rows], x[:block_rows]))
                ids, x = ids[block_rows:], x[block_rows:]
            if len(ready) >= 64:
                yield out(ready)
                ready = []
        if len(ids):
            ready.append(block(ids, x))
        if ready:
            yield out(ready)

    return ranged.mapInArrow(cut, "ids binary, forward binary, high binary, low binary, n int")


def merge(top_score, top_id, score, ids, k: int):
    """The k best columns of each row of (top | new), by falling score, then rising id."""
    s, i = np.concatenate([top_score, score], 1), np.concatenate([top_id, np.broadcast_to(ids, score.shape)], 1)
    pick = np.lexsort((i, -s), axis=1)[:, :k]
    return np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)


#: Stands for no result; below every score.
NONE = np.iinfo(np.int64).min // 4


#: Components below this give products whose sums over 1,024 dimensions are exact as floats.
EXACT = 1 << 21
#: Components below this give sums over 1,024 dimensions that fit into 64 bits.
FITS = 1 << 26


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integer rows."""
    if max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) < EXACT and q.shape[1] <= 1024:
        return np.rint(q.astype(float) @ x.T.astype(float)).astype(np.int64)
    return q @ x.T


def search_blocks(qid, q, blocks, top_score, top_id, k: int) -> int:
    """Update the running top k of all queries with some blocks; the number of (query, block) pairs scored.

    Scores are exact: whole numbers below 2**53 as floats (``EXACT``), larger ones as 64-bit integers.
    """
    high, low = np.stack([b[2] for b in blocks]), np.stack([b[3] for b in blocks])
    plus, minus = np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float)
    bound = plus @ high.T.astype(float) + minus @ low.T.astype(float)
    bound += np.abs(bound) * 1e-9 + 1  # no rounding takes it below a score
    order = np.argsort(-bound, 1, kind="stable")
    scored, active = 0, np.arange(len(q))
    for r in range(len(blocks)):
        nth = order[active, r]
        active = active[bound[active, nth] >= top_score[active, -1]]
        if not len(active):
            break
        nth = order[active, r]
        for b in np.unique(nth):
            who = active[nth == b]
            ids, x = blocks[b][:2]
            score = products(q[who], x)
            score = np.where(ids[None, :] == qid[who][:, None], NONE, score)
            if len(ids) > 4 * k:  # the k best of the block, with their ties; rows with the query's id are out already
                kth = np.partition(score, len(ids) - k, 1)[:, len(ids) - k : len(ids) - k + 1]
                keep = (score >= kth) & (score >= top_score[who, -1:])
                cols = np.flatnonzero(keep.any(0))
                score, ids = score[:, cols], ids[cols]
            top_score[who], top_id[who] = merge(top_score[who], top_id[who], score, ids, k)
            scored += len(who)
    return scored


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, block_rows: int = 128, queries_at_once: int = 8192) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's k largest inner products of floor(scale * x) components.

    A query's own id is no candidate; ties go to the smaller id; fewer than
    k candidates are all returned. Null ids and vectors that are null, empty
    or hold null or non-finite components take no part; vectors must have one
    length. Components of 2**26 / ``scale`` and more raise: their scores might
    not fit into a long. Queries go to the tasks in blocks of ``queries_at_once``
    (a bounded broadcast); each pass reads the blocks once and writes what it
    found, so that plans stay small with any number of queries. Repeated rows
    are candidates each; a repeated query id is searched once.
    """
    spark = vectors.sparkSession
    whole = lambda df: usable(df, id_col, vec_col, False).withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale).cast("double")))
    rows, asked = whole(vectors), stage(whole(queries).dropDuplicates(["id"]), "topk-queries")
    largest = lambda df: df.agg(F.max(F.expr("array_max(transform(vec, x -> abs(x)))"))).first()[0] or 0.0
    if max(largest(rows), largest(asked)) >= FITS:
        raise ValueError(f"components of {FITS} and more after scaling")
    index = stage(build_blocks(rows, block_rows), "topk-blocks")
    seed_ids, seeds = sample_rows_of(rows, 1500)
    passes = []
    for qid, q in query_blocks(asked, queries_at_once):
        q = q.astype(np.int64)
        # the k-th score among a few rows that do not carry the query's id is a floor for the k-th among all such rows
        floor = np.full(len(q), NONE)
        if len(seeds) >= k:
            s = np.where(seed_ids[None, :] == qid[:, None], NONE, products(q, seeds.astype(np.int64)))
            floor = np.partition(s, len(seeds) - k, 1)[:, len(seeds) - k]
        held = spark.sparkContext.broadcast((qid, q, floor))

        def run(batches, held=held):
            import pyarrow as pa

            qid, q, floor = held.value
            score, ids = np.full((len(q), k), NONE), np.full((len(q), k), np.iinfo(np.int64).max)
            score[:, -1] = floor  # held as the bound; dropped below
            dim = q.shape[1]
            for b in batches:
                blocks = [(np.frombuffer(i, np.int64), np.frombuffer(x, np.int64).reshape(-1, dim), np.frombuffer(h, np.int64), np.frombuffer(lo, np.int64)) for i, x, h, lo, _ in zip(*(c.to_pylist() for c in b.columns), strict=True)]
                if blocks:
                    search_blocks(qid, q, blocks, score, ids, k)
            r, c = np.nonzero((ids < np.iinfo(np.int64).max) & (score > NONE))
            for i in range(0, max(len(r), 1), 50_000):
                a, z = r[i : i + 50_000], c[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(qid[a]), pa.array(ids[a, z]), pa.array(score[a, z])], names=["query_id", "vec_id", "score"])

        passes.append(stage(index.mapInArrow(run, "query_id long, vec_id long, score long"), "topk-found"))
    schema = "query_id long, vec_id long, score long"
    files = [f for df in passes for f in df.inputFiles()]
    found = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return best(found, k, nearest_first=False)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"))
