"""The mix against a scheduler that takes one slot after the other, and its deviation from the true weights."""

import math
import random
from collections import Counter
from fractions import Fraction

import pytest

from ledgerline.llm import mixing

SCHEMA = "doc_id long, source string, _n string, _row int, _src int, total long"


def table(spark, sizes, start=0):
    rows = [(s, i) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame([(k + start, s, "x", 1, 2, 3) for k, (s, _) in enumerate(rows)], SCHEMA)


def scheduled(spark, sizes, **a):
    got = mixing.mix(table(spark, sizes), block_rows=1, **a).select("doc_id", "_source", "_slot", "_position", "_n").collect()
    assert {r._n for r in got} <= {"x"}
    assert sorted(r._position for r in got) == list(range(len(got)))
    return [r._source for r in sorted(got, key=lambda r: r._slot)]


def worst(order, weights):
    total, done, most = sum(weights.values()), Counter(), 0.0
    for t, s in enumerate(order, 1):
        done[s] += 1
        most = max(most, *(abs(done[x] - t * w / total) for x, w in weights.items()))
    return most


def brute(weights, needed):
    """Earliest deadline first among released blocks, in fractions, until every source has had what it needs."""
    a = mixing.whole_weights(weights)
    total = math.fsum(a.values())
    if any(isinstance(x, float) for x in a.values()):
        a = {s: max(1, round(x / total * mixing.UNIT)) for s, x in weights.items()}
    w = {s: Fraction(x, sum(a.values())) for s, x in a.items()}
    done, out = Counter(), []
    while any(done[s] < n for s, n in needed.items()):
        ready = [s for s in sorted(w) if math.floor(done[s] / w[s]) <= len(out)]
        s = min(ready, key=lambda s: math.ceil((done[s] + 1) / w[s]))
        done[s] += 1
        out.append(s)
    return out


@pytest.mark.parametrize(("sizes", "weights"), [
    ({"a": 1500, "b": 600}, {"a": 2**0.5, "b": 0.611}),
    ({"a": 1500, "b": 700, "c": 90}, {"a": 1.0, "b": 0.4567, "c": 0.0613}),
    ({"a": 3000, "b": 1}, None),  # a source of one row, by n ** 0.9
    ({"a": 900, "b": 300, "c": 280, "d": 3, "e": 40, "f": 41, "g": 1}, None),
    ({f"s{i:02}": random.Random(i).randint(1, 60) for i in range(40)}, {f"s{i:02}": 1.17**i for i in range(40)}),
])
def test_earliest_deadline_first(spark, sizes, weights):
    order = scheduled(spark, sizes, weights=weights)
    true = weights or {s: n**0.9 for s, n in sizes.items()}
    assert order == brute(true, sizes)
    assert worst(order, true) < 1


def test_any_number_of_sources(spark):
    sizes = {f"site{i}": 1 + i % 3 for i in range(300)}
    order = scheduled(spark, sizes)
    assert set(order) == set(sizes) and worst(order, {s: n**0.9 for s, n in sizes.items()}) < 1


def test_longer_blocks_bound_the_schedule(spark):
    got = mixing.mix(table(spark, {"a": 500, "b": 100}), weights={"a": 1, "b": 1}, block_rows=1, max_blocks=100).collect()
    assert max(r._slot for r in got) < 110 and sorted(r._position for r in got) == list(range(len(got)))
    assert {r.doc_id for r in got} == set(range(600))


def test_weights_that_are_none(spark):
    rows = table(spark, {"a": 5, "b": 5, "c": 5, "d": 5, "e": 5})
    got = mixing.mix(rows, weights={"a": 1, "b": 0, "c": -1, "d": None, "e": float("nan")}).collect()
    assert {r._source for r in got} == {"a"} and len({r.doc_id for r in got}) == 5
    assert not mixing.mix(rows, weights={}).count() and not mixing.mix(rows.limit(0)).count()
    with pytest.raises(ValueError, match="_slot"):
        mixing.mix(rows.withColumnRenamed("total", "_slot"))
