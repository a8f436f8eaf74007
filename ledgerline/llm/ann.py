"""Approximate nearest neighbours with balanced posting lists.

Vectors lie in the lists of their nearest centres; those near a border are
replicated to several. A query finds its nearest centres by walking an
in-memory graph over them, keeps the lists whose centre is within a ratio of
the nearest one's distance, and scans these with exact distances.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import stage, table
from ledgerline.llm.vectors import best, centroids, matrix, nearest, sample, usable
from ledgerline.llm.wordtokens import worker_cache


def balanced(x: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """Centres of a sample whose lists are of like size: the largest lists are parted in two, the smallest given up."""
    c = centroids(x, k)
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        large = [i for i in np.argsort(-n)[: max(1, len(c) // 16)] if n[i] > 2 * len(x) / len(c)]
        if not large:
            break
        new = [h for i in large if len(h := centroids(x[near == i], 2, 4)) == 2]
        if not new:
            break
        gone = set(large[: len(new)]) | set(np.argsort(n)[: len(new)].tolist())
        c = np.concatenate([np.stack([v for i, v in enumerate(c) if i not in gone]), *new])
    return c


class Graph:
    """Centres joined to their nearest others, both ways; best-first search from entries that lie far apart.

    Each entry is the centre farthest from the entries before it, one in
    ``spread`` centres and 16 at least; a part of the graph that holds none of
    these gets one more, so every centre can be reached.
    """

    def __init__(self, c: np.ndarray, degree: int = 24, spread: int = 16):
        self.c = c
        d = ((c * c).sum(1) / 2)[None, :] - c @ c.T
        np.fill_diagonal(d, -np.inf)
        near = np.argsort(d, 1)[:, 1 : degree + 1] if len(c) > 1 else np.zeros((len(c), 0), int)
        a, b = np.repeat(np.arange(len(c)), near.shape[1]), near.ravel()
        both = np.unique(np.stack([np.concatenate([a, b]), np.concatenate([b, a])], 1), axis=0)
        self.links = np.split(both[:, 1], np.searchsorted(both[:, 0], np.arange(1, len(c))))
        entries, gap = [0], ((c - c[0]) ** 2).sum(1)
        while len(entries) < min(len(c), max(16, len(c) // spread)) and gap.max() > 0:
            entries.append(int(gap.argmax()))
            gap = np.minimum(gap, ((c - c[entries[-1]]) ** 2).sum(1))
        reached, ahead = np.zeros(len(c), bool), list(entries)
        while True:
            while ahead:
                i = ahead.pop()
                if not reached[i]:
                    reached[i] = True
                    ahead.extend(self.links[i][~reached[self.links[i]]].tolist())
            if reached.all():
                break
            ahead = [int(np.flatnonzero(~reached)[0])]
            entries += ahead
        self.entries = np.array(entries)

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(centres, squared distances) of about the ``width`` nearest, nearest first."""
        c = self.c
        seen = np.zeros(len(c), bool)
        seen[self.entries] = True
        d = ((c[self.entries] - q) ** 2).sum(1)
        heap = list(zip(d.tolist(), self.entries.tolist(), strict=True))
        heapq.heapify(heap)
        found = sorted(((-a, i) for a, i in heap), reverse=True)[:width]
        kept = list(found)
        heapq.heapify(kept)
        while heap:
            a, i = heapq.heappop(heap)
            if len(kept) >= width and a > -kept[0][0]:
                break
            new = self.links[i][~seen[self.links[i]]]
            if not len(new):
                continue
            seen[new] = True
            for b, j in zip(((c[new] - q) ** 2).sum(1).tolist(), new.tolist(), strict=True):
                if len(kept) < width:
                    heapq.heappush(kept, (-b, j))
                    heapq.heappush(heap, (b, j))
                elif b < -kept[0][0]:
                    heapq.heapreplace(kept, (-b, j))
                    heapq.heappush(heap, (b, j))
        kept = sorted((-a, i) for a, i in kept)
        return np.array([i for _, i in kept]), np.array([a for a, _ in kept])


def between_centres(c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1)
    return (half[:, None] + half[None, :]) - 2 * c @ c.T


def lists_of(x: np.ndarray, c: np.ndarray, copies: int, border: float, between: np.ndarray, apart: float = 0.15):
    """(row, centre) of each vector's lists: its nearest centre, and others within ``1 + border`` of that distance
    unless a chosen centre lies far nearer to them (``apart`` of the squared distance) than the vector does."""
    half = (c * c).sum(1)
    among = min(4 * copies, len(c))
    rows, cells = [], []
    for i in range(0, len(x), 2048):
        part = x[i : i + 2048]
        d = np.maximum((part * part).sum(1)[:, None] + half - 2 * part @ c.T, 0)
        near = np.argpartition(d, among - 1, 1)[:, :among]
        dn = np.take_along_axis(d, near, 1)
        o = np.argsort(dn, 1, kind="stable")
        near, dn = np.take_along_axis(near, o, 1), np.take_along_axis(dn, o, 1)
        chosen = np.zeros(near.shape, bool)
        chosen[:, 0] = True
        count = np.ones(len(part), int)
        for j in range(1, among):
            ok = (dn[:, j] <= dn[:, 0] * (1 + border) ** 2) & (count < copies)
            for m in range(j):
                ok &= ~(chosen[:, m] & (between[near[:, m], near[:, j]] < apart * dn[:, j]))
            chosen[:, j] = ok
            count += ok
        r, k = np.nonzero(chosen)
        rows.append(r + i)
        cells.append(near[r, k])
    return (np.concatenate(rows), np.concatenate(cells)) if rows else (np.zeros(0, int), np.zeros(0, int))


def build_lists(rows: DataFrame, list_rows: int = 256, copies: int = 4, border: float = 0.25, sample_rows: int = 16_000, max_centres: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """(posting lists ``cell``, ``id``, ``vec``, ``home``: the vector's nearest list?; centres). Centres are fitted on at most ``sample_rows`` vectors; every row is indexed.

    Beyond ``list_rows`` * ``max_centres`` vectors lists grow with the table, as the centres of one in-memory graph do not.
    """
    n = rows.count()
    c = balanced(sample(rows, sample_rows), int(min(max_centres, max(1, n // list_rows), sample_rows // 8)))
    held = rows.sparkSession.sparkContext.broadcast(c)  # max_centres x dimensions

    def run(batches):
        import pyarrow as pa

        between = None
        for b in batches:
            if b.num_rows:
                between = between_centres(held.value) if between is None else between
                r, cell = lists_of(matrix(b.column(1)), held.value, copies, border, between)
                home = np.append(True, r[1:] != r[:-1])  # a row's nearest list comes first
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b.column(0).take(pa.array(r)), b.column(1).take(pa.array(r)), pa.array(home)], names=["cell", "id", "vec", "home"])

    return stage(rows.mapInArrow(run, "cell int, id long, vec array<double>, home boolean"), "ann-lists"), c


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", lists: int = 32, share: float = 0.16, ratio: float = 0.35, shard_rows: int = 4096, **index) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: about the k nearest by Euclidean distance, exactly measured.

    A query scans at most ``lists`` lists or ``share`` of all, whichever is
    more, and of these the lists whose centre is within ``1 + ratio`` of the
    nearest centre's distance; where these hold fewer than k other ids, the next
    nearest lists too, until they do or no list is left. A share, as in data without clusters the same
    recall takes the same share of the lists at every size. Lists with more than
    ``shard_rows`` vectors, such as those of one very common vector, are
    scanned in shards by different tasks. A query's own id is no candidate;
    ties go to the smaller id; null ids and vectors that are null, zero, empty
    or hold null or non-finite components take no part; repeated query ids
    are searched once, and of repeated rows of an id the nearest counts once.
    Vectors must have one length.
    """
    rows = stage(usable(vectors, id_col, vec_col, True), "ann-rows")
    asked = usable(queries, id_col, vec_col, True).dropDuplicates(["id"])
    spark = rows.sparkSession
    if not rows.limit(1).count():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    posted, c = build_lists(rows, **index)
    width = max(lists, -int(-share * len(c) // 1))
    # each id counts in one list, so that a sum over lists is at most the number of different ids in them
    homes = posted.filter("home").groupBy("id").agg(F.min("cell").alias("cell")).groupBy("cell").count()
    ids_in = np.zeros(len(c), np.int64)
    for r in homes.collect():  # one row a centre, max_centres at most
        ids_in[r["cell"]] = r["count"]
    held = spark.sparkContext.broadcast(c)
    key = f"graph {id(c)} {spark.sparkContext.applicationId} {c[:1].tobytes()!r} {len(c)}"

    def walk(batches):
        import pyarrow as pa

        g = worker_cache(key, lambda: Graph(held.value))
        for b in batches:
            if not b.num_rows:
                continue
            q = matrix(b.column(1))
            rows, cells = [], []
            for i in range(len(q)):
                at, d = g.search(q[i], width)
                near = at[np.sqrt(d) <= np.sqrt(d[0]) * (1 + ratio) + 1e-12]
                if ids_in[near].sum() <= k:  # the query itself may be one of them
                    order = np.argsort(((g.c - q[i]) ** 2).sum(1), kind="stable")
                    enough = int(np.searchsorted(ids_in[order].cumsum(), k, side="right")) + 1
                    near = np.union1d(near, order[:enough])
                rows += [i] * len(near)
                cells += near.tolist()
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), b.column(0).take(take), b.column(1).take(take)], names=["cell", "query_id", "q"])

    probes = asked.mapInArrow(walk, "cell int, query_id long, q array<double>")
    sizes = posted.groupBy("cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    sizes = F.broadcast(stage(sizes, "ann-sizes"))  # one row a centre, max_centres at most
    held_lists = posted.join(sizes, "cell").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int")).select("cell", "shard", "id", "vec")
    sent = probes.join(sizes, "cell").withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)"))).select("cell", "shard", "query_id", "q")

    def scan(left, right):
        import pyarrow as pa

        ids, x = left.column("id").combine_chunks().to_numpy(), matrix(left.column("vec").combine_chunks()) if left.num_rows else None
        out = [], [], []
        if left.num_rows and right.num_rows:
            qid, q = right.column("query_id").combine_chunks().to_numpy(), matrix(right.column("q").combine_chunks())
            for a, v in zip(qid, q, strict=True):
                d = np.sqrt(((x - v) ** 2).sum(1))
                other = np.flatnonzero(ids != a)
                if len(other) > k:
                    dd = d[other]
                    other = other[dd <= np.partition(dd, k - 1)[k - 1]]
                o = other[np.lexsort((ids[other], d[other]))[:k]]
                out[0].extend([a] * len(o))
                out[1].extend(ids[o].tolist())
                out[2].extend(d[o].tolist())
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = held_lists.groupBy("cell", "shard").cogroup(sent.groupBy("cell", "shard")).applyInArrow(scan, "query_id long, vec_id long, score double")
    return best(found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), k, nearest_first=True)


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.filter("vec_id % 100 = 0"))
