"""Boosted regression trees of many fits at once: tasks sum histograms of their rows, the driver chooses splits from the sums.

A fit is a (held-out fold, configuration). All grow together, a level of a round of
every fit in one pass over the rows, so a job of 60 fits takes as many passes as one.
As in the published learner (squared error): fits start from their mean, a leaf is the rate times
its mean residual, candidate splits are quantiles of the training rows. Trees depend
on the order of a feature's values alone, so a feature is not scaled first. Sums of partitions are
added in order of partitions: the same rows in the same layout give the same trees.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import partial
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.sources.scratch import drop, fresh, staged

#: Rows of a block of arrays, bin that no value exceeds (a node that is not split), rounds from one checkpoint to the next.
BLOCK, NONE, EVERY = 16_384, 255, 20


def candidate_splits(rows: DataFrame, names: list[str], folds: int, bins: int) -> list[list[np.ndarray]]:
    """Per fold (``_fold``, from 0) and feature, ascending: values of the rows of other folds that end a bin.

    They are exact quantiles, or all values if there are no more than ``bins``. Distinct values are counted per fold;
    their running counts are taken by ranges of values, so no task sorts a whole feature.
    """
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(c).alias("x")) for i, c in enumerate(names)))).alias("_c")
    values = rows.select("_fold", each).groupBy("_c.f", "_c.x").agg(*(F.count_if(F.col("_fold") == k).alias(f"n{k}") for k in range(folds)))
    values = staged(values.withColumn("n", sum(F.col(f"n{k}") for k in range(folds))), fresh(rows.sparkSession, "values"))
    whole = values.groupBy("f").agg(
        F.percentile_approx("x", [i / 32 for i in range(1, 32)]).alias("_cuts"), F.sum("n").alias("_n"),
        F.array(*(F.sum(f"n{k}") for k in range(folds))).alias("_of"), F.array(*(F.count_if(F.col("n") > F.col(f"n{k}")) for k in range(folds))).alias("_distinct"),
    )
    ranged = values.join(F.broadcast(whole), "f").withColumn("_b", F.expr("size(filter(_cuts, c -> c < x))"))  # one row a feature
    counts = ["n", *(f"n{k}" for k in range(folds))]
    per = ranged.groupBy("f", "_b").agg(*(F.sum(c).alias(c) for c in counts))
    before = W.partitionBy("f").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)  # at most 32 ranges a feature
    per = per.select("f", "_b", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in counts))
    within = W.partitionBy("f", "_b").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    ran = ranged.join(F.broadcast(per), ["f", "_b"]).select("*", *((F.col(f"_before_{c}") + F.sum(c).over(within)).alias(f"_to_{c}") for c in counts))

    def ends(k: int):
        own, to, of = F.col("n") - F.col(f"n{k}"), F.col("_to_n") - F.col(f"_to_n{k}"), F.col("_n") - F.col("_of")[k]
        full = F.floor(to * bins / of) > F.floor((to - own) * bins / of)
        return F.when((own > 0) & (to < of) & (full | (F.col("_distinct")[k] <= bins)), F.lit(k))

    found = ran.select("f", "x", F.explode(F.array_compact(F.array(*(ends(k) for k in range(folds))))).alias("k"))
    out: list[list[list[float]]] = [[[] for _ in names] for _ in range(folds)]
    for r in found.collect():  # under ``bins`` rows a fold and feature
        out[r.k][r.f].append(r.x)
    return [[np.sort(np.array(x, dtype=float)) for x in of] for of in out]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(cut, x[i]).astype(np.uint8) for i, cut in enumerate(cuts)])


def _blocks(frames: Iterator[pd.DataFrame], names: list[str], scores: list[str], cuts: list[list[np.ndarray]]) -> Iterator[pd.DataFrame]:
    """Blocks of rows: per fit (folds by scores) the bins and scores of its training rows. Fits of a fold share their bins."""

    def block(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held)
        x, y, fold, out = rows[names].to_numpy(float).T, rows[scores].to_numpy(float).T, rows["_fold"].to_numpy(), []
        for k in range(len(cuts)):
            train = fold != k
            b = binned(x[:, train], cuts[k])
            for scored in y[:, train]:
                known = ~np.isnan(scored)
                out.append((b, scored) if known.all() else (b[:, known], scored[known]))
        return pd.DataFrame({"block": [pickle.dumps(out, 5)]})

    held: list[pd.DataFrame] = []
    for frame in frames:
        held.append(frame)
        if sum(map(len, held)) >= BLOCK:
            yield block(held)
            held = []
    if held:
        yield block(held)


def place(b: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The node at a depth of a complete binary tree that each row falls in."""
    at = np.zeros(b.shape[1], np.uint8 if depth < 8 else np.uint32)
    for d in range(depth):
        right = np.zeros(len(at), bool)
        for j in range(1 << d):
            node = (1 << d) - 1 + j
            if cut[node] != NONE:
                right |= (at == j) & (b[feature[node]] > cut[node])
        at = at * 2 + right
    return at


def _means(blocks: Iterator[list], width: int) -> Iterator[tuple]:
    """Counts of all bins, counts and sums of scores."""
    n = s = 0
    for block in blocks:
        n, s = n + _tally(block, None, None, 0, 1, width, True)[0], s + np.array([(len(y), y.sum()) for _, y in block])
    if not isinstance(n, int):
        yield n, s


def _start(base: np.ndarray, block: list) -> list:
    return [(b, (y - base[m]).astype(np.float32)) for m, (b, y) in enumerate(block)]


def _step(tree: tuple, depth: int, block: list) -> list:
    """Residuals after a round."""
    feature, cut, value = tree
    return [(b, (r - value[m][place(b, feature[m], cut[m], depth)]).astype(np.float32)) for m, (b, r) in enumerate(block)]


def _tally(block: list, tree: tuple | None, slots: np.ndarray | None, depth: int, count: int, width: int, counted: bool) -> tuple:
    """Rows (if ``counted``) and sums per fit, slot (a node that is looked at), feature and bin of a block."""
    names = len(block[0][0])
    size = count * names * width
    n, s = np.zeros((len(block), size), np.int64), np.zeros((len(block), size))
    first = (np.arange(names) * width)[:, None]
    for m, (b, r) in enumerate(block):
        at = first
        if depth:
            slot = slots[m][place(b, tree[0][m], tree[1][m], depth)]
            some = np.flatnonzero(slot != NONE)
            b, r, at = b.take(some, 1), r[some], first + slot[some].astype(np.int32) * (names * width)
        at = np.add(at, b, dtype=np.intp).ravel()
        s[m] = np.bincount(at, np.tile(r.astype(float), names), size)
        if counted:
            n[m] = np.bincount(at, minlength=size)
    return (n.reshape(len(block), count, names, width), s.reshape(len(block), count, names, width))


def _tallies(blocks: Iterator[list], *how) -> Iterator[tuple]:
    n = s = None
    for block in blocks:
        a, b = _tally(block, *how)
        n, s = (a, b) if n is None else (n + a, s + b)
    if s is not None:  # counts in as few bytes as hold them
        yield (n.astype(np.uint16 if n.max(initial=0) < 1 << 16 else np.int64) if how[-1] else None), s


def _best(n: np.ndarray, s: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Per node of a fit: whether it is split, by which feature after which bin, and rows and sum of its left side. Ties go to the first feature and bin."""
    left, sums = n.cumsum(-1), s.cumsum(-1)
    whole, total = left[..., -1:], sums[..., -1:]
    right = whole - left
    gain = sums * sums
    gain /= np.maximum(left, 1)
    rest = total - sums
    rest *= rest
    rest /= np.maximum(right, 1)
    gain += rest
    gain -= total * total / np.maximum(whole, 1)
    gain[(left < max(least, 1)) | (right < max(least, 1))] = 0
    gain = gain.reshape(len(n), -1)
    at, node = gain.argmax(-1), np.arange(len(n))
    take = lambda x: x.reshape(gain.shape)[node, at]
    return take(gain) > 0, at // n.shape[-1], at % n.shape[-1], take(left), take(sums)


def _children(whole: np.ndarray, few: np.ndarray, smaller: np.ndarray, split: np.ndarray) -> np.ndarray:
    """Histograms of both children of a fit's nodes: the smaller one's, and what is left; none below a node that is not split."""
    out = np.zeros((len(split), 2, *whole.shape[1:]), whole.dtype)
    node, right = np.flatnonzero(split), smaller[split, 1].astype(int)
    out[node, right], out[node, 1 - right] = few[node], whole[node] - few[node]
    return out.reshape(-1, *whole.shape[1:])


def _grow(state: RDD, rows: np.ndarray, s, pool: ThreadPool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree of every fit on its residuals; ``rows`` are the counts of all bins. Of two children the smaller is tallied, the other is what is left."""
    fits, _, _, width = rows.shape
    feature, cut = np.zeros((fits, (1 << s.depth) - 1), np.uint8), np.full((fits, (1 << s.depth) - 1), NONE, np.uint8)

    def summed(*how):
        counts, totals = zip(*state.mapPartitions(partial(_pass, how)).collect(), strict=True)
        return sum(x.astype(np.int64) for x in counts) if how[-1] else None, sum(totals)

    n, sums = list(rows), list(summed(None, None, 0, 1, width, False)[1])
    node_n, node_s = rows[:, :, 0].sum(-1), np.array([x[:, 0].sum(-1) for x in sums])
    for d in range(s.depth):
        split, by, after, left_n, left_s = (np.array(x) for x in zip(*pool.map(lambda m: _best(n[m], sums[m], s.least), range(fits)), strict=True))
        level = slice((1 << d) - 1, (2 << d) - 1)
        feature[:, level], cut[:, level] = np.where(split, by, 0), np.where(split, after, NONE)
        left_n, left_s = np.where(split, left_n, node_n), np.where(split, left_s, node_s)
        pair_n, pair_s = np.stack([left_n, node_n - left_n], -1), np.stack([left_s, node_s - left_s], -1)
        node_n, node_s = pair_n.reshape(fits, -1), pair_s.reshape(fits, -1)
        if d + 1 == s.depth or not split.any():  # nothing below to choose
            node_n, node_s = (np.stack([x] + [np.zeros_like(x)] * ((1 << (s.depth - d - 1)) - 1), -1).reshape(fits, -1) for x in (node_n, node_s))
            break
        smaller = (pair_n[..., 1] < pair_n[..., 0])[..., None] == np.array([False, True])
        slots = np.where(smaller & split[..., None], np.arange(1 << d)[:, None], NONE).reshape(fits, -1).astype(np.uint8)
        few_n, few_s = summed((feature, cut), slots, d + 1, 1 << d, width, True)
        n, sums = (pool.map(lambda m, whole=whole, few=few, smaller=smaller, split=split: _children(whole[m], few[m], smaller[m], split[m]), range(fits)) for whole, few in ((n, few_n), (sums, few_s)))
    return feature, cut, s.rate * node_s / np.maximum(node_n, 1)


def _pass(how: tuple, blocks: Iterator[list]) -> Iterator[tuple]:
    return _tallies(blocks, *how)


def boost(rows: DataFrame, names: list[str], scores: list[str], folds: int, s) -> tuple[list[list[np.ndarray]], np.ndarray, list[tuple]]:
    """Candidate splits, means and ``s.rounds`` trees of the fits of rows with ``_fold``: fit ``k * len(scores) + c`` is of fold k and score c.

    Residuals are 4 bytes a fit and row, kept from round to round; every ``EVERY`` rounds they are written to the shared folder, as their lineage would grow.
    """
    if not 2 <= s.bins <= NONE or s.depth < 1:
        raise ValueError(f"bins must be 2 to {NONE} and depth at least 1")
    spark, sc = rows.sparkSession, rows.sparkSession.sparkContext
    cuts = candidate_splits(rows, names, folds, s.bins)
    width = max(len(cut) for of in cuts for cut in of) + 1
    packed = rows.select("_fold", *names, *scores).mapInPandas(partial(_blocks, names=names, scores=scores, cuts=cuts), "block binary")
    state = packed.rdd.map(_unpacked).persist(StorageLevel.MEMORY_AND_DISK)
    found = state.mapPartitions(partial(_means, width=width)).collect()
    counts, known = sum(x[0] for x in found), sum(x[1] for x in found)
    base = np.divide(known[:, 1], known[:, 0], out=np.full(len(known), np.nan), where=known[:, 0] > 0)
    before, trees, step, written = sc.getCheckpointDir(), [], partial(_start, base), None
    sc.setCheckpointDir(fresh(spark, "rounds"))
    pool = ThreadPool(4)  # arrays of the fits
    try:
        for r in range(s.rounds):
            last, state = state, state.map(step).persist(StorageLevel.MEMORY_AND_DISK)
            if r % EVERY == EVERY - 1:
                state.checkpoint()
            trees.append(_grow(state, counts, s, pool))
            step = partial(_step, trees[-1], s.depth)
            last.unpersist()
            if state.isCheckpointed():
                drop(spark, written)
                written = state.getCheckpointFile()
    finally:
        pool.terminate()
        state.unpersist()
        drop(spark, written)
        if before:
            sc.setCheckpointDir(before)
    return cuts, base, trees


def _unpacked(row) -> list:
    return pickle.loads(row.block)


def predict(frames: Iterator[pd.DataFrame], names: list[str], cuts: list[list[np.ndarray]], base: np.ndarray, trees: list[tuple], depth: int) -> Iterator[pd.DataFrame]:
    """``key``, ``_fold`` and ``p``, the predictions of the fits of a row's own fold, which have not seen it."""
    each = len(base) // len(cuts)
    for frame in frames:
        x, fold, out = frame[names].to_numpy(float).T, frame["_fold"].to_numpy(), np.empty((len(frame), each))
        for k in np.unique(fold):
            mine = np.flatnonzero(fold == k)
            b = binned(x[:, mine], cuts[k])
            for c in range(each):
                m = k * each + c
                p = np.full(len(mine), base[m])
                for feature, cut, value in trees:
                    p += value[m][place(b, feature[m], cut[m], depth)]
                out[mine, c] = p
        yield pd.DataFrame({"key": frame["key"], "_fold": fold, "p": list(out)})
