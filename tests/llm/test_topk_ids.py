"""Repeated query ids: rows with the query's id are no candidates, however many there are."""

import numpy as np
import pytest

from ledgerline.llm import topk


def wanted(ids, x, asked, k=10):
    q, out = np.floor(1024 * x).astype(np.int64), []
    for i in asked:
        s = q @ q[np.flatnonzero(ids == i)[0]]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out += [(int(i), n, int(ids[j]), int(s[j])) for n, j in enumerate(order, 1)]
    return sorted(out)


@pytest.mark.parametrize("case", ["twice", "third", "block"])
def test_repeated_query_ids(spark, case):
    x = np.random.default_rng(3).normal(size=(300, 8))
    ids = np.arange(300)
    if case == "twice":
        ids, x = np.repeat(ids, 2), np.repeat(x, 2, 0)
    else:  # one id on many rows of high scores: more than the seeds, or more than k in each block
        n = 2000 if case == "third" else 40
        ids, x = np.concatenate([ids, np.zeros(n, int)]), np.concatenate([x, np.repeat(3 * x[:1], n, 0)])
        x[0] = 3 * x[0]
    table = spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    asked = [0, 100, 200]
    got = topk.top_k(table, table.filter("vec_id % 100 = 0"), block_rows=64).collect()
    assert sorted(map(tuple, got)) == wanted(ids, x, asked)


def test_large_components_are_exact(spark):
    import numpy as np
    import pytest

    rng = np.random.default_rng(2)
    x = rng.integers(-(1 << 25), 1 << 25, (60, 5))
    table = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(60)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(table, table.filter("vec_id % 10 = 0"), scale=1, block_rows=8, queries_at_once=2).collect()}
    for i in range(0, 60, 10):
        s = x @ x[i]
        order = [j for j in np.lexsort((np.arange(60), -s)) if j != i][:10]
        assert [got[i, k] for k in range(1, 11)] == [(j, s[j]) for j in order]
    with pytest.raises(ValueError, match="components"):
        topk.top_k(table, table, scale=1024)


def test_fewer_candidates_than_k(spark):
    from ledgerline.llm import ann

    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.score) for r in topk.top_k(table, table.filter("vec_id = 0"), scale=1).collect()) == [(1, 5), (1, 5), (2, 5)]
    assert sorted((r.rank, r.vec_id) for r in ann.search(table, table.filter("vec_id = 0")).collect()) == [(1, 1), (2, 2)]
