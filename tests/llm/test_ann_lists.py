"""Reaching every list, and enough candidates of isolated queries."""

import numpy as np
import pytest

from ledgerline.llm import ann


def clusters(n, each, dim=16, seed=4, spread=100.0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, 1, dim)) * spread + rng.normal(size=(n, each, dim))).reshape(-1, dim)


@pytest.mark.parametrize(("n", "each"), [(48, 30), (90, 26), (3, 25)])
def test_every_cluster_of_centres_is_reached(n, each):
    c = clusters(n, each)
    c = c[np.random.default_rng(1).permutation(len(c))]
    g = ann.Graph(c)
    for i in range(0, len(c), 7):
        q = c[i] + 0.1
        at, d = g.search(q, max(32, len(c) * 16 // 100))
        true = ((c - q) ** 2).sum(1)
        assert at[0] == true.argmin() and abs(d[0] - true.min()) < 1e-9
        assert len(set(at[:10].tolist()) & set(np.argsort(true)[:10].tolist())) >= 9


def test_isolated_queries_get_k(spark):
    x = np.concatenate([clusters(8, 200, 8, spread=20.0), np.full((1, 8), 1e4), np.full((1, 8), -1e4), np.full((3, 8), 5e3)])
    ids = np.arange(len(x))
    ids[-3:] = 1700  # a group of three rows of one id, far from all others
    table = spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = ann.search(table, table.filter("vec_id >= 1600"), list_rows=20).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {1600: 10, 1601: 10, 1700: 10}
    few = table.filter("vec_id >= 1595")  # fewer candidates than k: all of them
    assert ann.search(few, few, list_rows=2).groupBy("query_id").count().filter("count != 7").count() == 0
