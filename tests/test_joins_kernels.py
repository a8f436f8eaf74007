"""Strict joins, identity checks, readers, budgets and draws, each against a plain computation."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import kernels as K
from ledgerline.operators import stats as S
from ledgerline.operators import validate as V
from ledgerline.sources import readers as R

TWO = ["C0", "C1"]


def records(spark, rows):
    return spark.createDataFrame(rows, "task string, key string, configuration string, score double, note string, ord int")


BASE = [("t", "1", "C0", 0.5, "n", 0), ("t", "1", "C1", 0.6, "n", 1), ("t", "2", "C0", 0.7, None, 2), ("t", "2", "C1", 0.8, None, 3)]


def test_strict_join(spark):
    authority = spark.createDataFrame([("t", "1"), ("t", "2")], "task string, key string")
    wide = V.strict_join(records(spark, BASE), authority, "score", TWO, ("note", "task")).collect()
    assert {(r.key, r.C0, r.C1) for r in wide} == {("1", 0.5, 0.6), ("2", 0.7, 0.8)}
    for rows, problem in ((BASE[:3], "missing"), ([*BASE, ("t", "3", "C0", 0.1, "n", 4)], "unexpected"), ([*BASE, ("t", "1", "C0", 0.9, "n", 5)], "repeated"), ([*BASE, ("t", "1", "C9", 0.9, "n", 5)], "unexpected")):
        with pytest.raises(ValueError, match=problem):
            V.strict_join(records(spark, rows), authority, "score", TWO)
    with pytest.raises(ValueError, match="note differ"):
        V.strict_join(records(spark, [*BASE[:3], ("t", "2", "C1", 0.8, "x", 3)]), authority, "score", TWO, ("note",))


def test_last_record_counts(spark):
    rows = records(spark, [*BASE, ("t", "1", "C0", 0.1, "n", 9), ("t", "3", "C0", 0.1, "n", 10)])
    assert {(r.key, r.C0) for r in V.pivot_join(rows, "score", TWO, order="ord").collect()} == {("1", 0.1), ("2", 0.7)}
    assert V.incomplete(rows, TWO).first().asDict() == {"task": "t", "dropped": 1, "kept": 2}
    with pytest.raises(ValueError, match="repeated"):
        V.pivot_join(rows, "score", TWO, strict=True)


def test_identity_and_pilots(spark):
    assert V.identity_differences({"a": 1, "b": {"c": 2, "d": None}}, {"a": 1, "b": {"c": 3}, "e": 0}) == ["b.c", "b.d", "e"]
    V.require_identity({"a": {"b": [1]}}, {"a": {"b": [1]}}, "run")
    with pytest.raises(ValueError, match="run: a"):
        V.require_identity({"a": True}, {"a": 1}, "run")
    events = spark.createDataFrame([(1, None, None), (2, "p", None), (3, None, json.dumps({"cuda_feasibility": {}})), (4, None, "{}")], "n int, pilot_profile string, method_metadata string")
    assert sorted(r.n for r in V.pilot_markers(events).collect()) == [2, 3]
    assert not V.pilot_markers(events.select("n")).count()


def test_canonical_order(spark):
    registry = spark.createDataFrame([("b", 0), ("a", 1)], "task string, task_ord int")
    rows = spark.createDataFrame([("a", 0, "x"), ("b", 2, "y"), ("b", 1, "z"), ("b", 1, "w")], "task string, source_index int, key string")
    assert [r.key for r in V.canonical(rows, registry).collect()] == ["w", "z", "y", "x"]
    with pytest.raises(Exception, match="unknown task"):
        V.canonical(rows.withColumn("task", F.lit("q")), registry).collect()


def test_cut_files_and_routing_rows(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.jsonl").write_text('{"n": 1}\n')
    assert R.read_json_lines(spark, str(tmp_path / "j"), "n int").first().n == 1
    (tmp_path / "j" / "b.jsonl").write_text('{"n": 2}')
    with pytest.raises(ValueError, match="b.jsonl"):
        R.read_json_lines(spark, str(tmp_path / "j"), "n int")
    (tmp_path / "m1.jsonl").write_text(json.dumps({"task": "t", "sample_idx": 3, "scores": {"C0": 1, "C1": 0.5}, "compression": {"C0": 1, "C1": 4}}) + "\n")
    rows = R.read_routing(spark, str(tmp_path / "{model}.jsonl"), "m1").collect()
    assert [(r.task, r.key, r.configuration, r.cfg_ord, r.score, r.compression) for r in rows] == [("t", "t:3", "C0", 0, 1.0, 1.0), ("t", "t:3", "C1", 1, 0.5, 4.0)]


def test_kept_positions(spark):
    rng = np.random.default_rng(8)
    scores = np.round(rng.random((3, 40)) ** 3, 6)
    rows = spark.createDataFrame([("g", h, p, float(scores[h, p])) for h in range(3) for p in range(40)], "g string, head int, pos int, score double")
    for target, window in ((12, 4), (12, 12), (50, 4), (3, 8)):
        recent = min(window, 40)
        if target >= 40:
            want = set(range(40))
        else:
            before = scores[:, : 40 - recent]
            best = np.sort(before, 1)[:, ::-1][:, : min(target, before.shape[1])].sum(1).clip(1e-6)
            budget = np.rint(best / best.sum() * max(0, 3 * target - 3 * recent)).astype(int).clip(0, before.shape[1])
            votes = np.zeros(before.shape[1])
            for h in range(3):
                top = np.argsort(-before[h], kind="stable")[: budget[h]]
                votes[top] += before[h, top]
            want = set(range(40 - recent, 40)) | set(np.argsort(-votes, kind="stable")[: max(0, target - recent)].tolist())
        assert {r.pos for r in K.keep_positions(rows, "g", target, window).collect()} == want


def test_layer_reallocation(spark):
    rng = np.random.default_rng(9)
    scores = {layer: rng.random((2, 30)) * (layer + 1) for layer in range(4)}
    rows = spark.createDataFrame([("g", layer, h, p, float(scores[layer][h, p])) for layer in scores for h in range(2) for p in range(30)], "g string, layer int, head int, pos int, score double")
    flat = sorted(((-scores[layer][h, p], layer) for layer in scores for h in range(2) for p in range(30)))[: 5 * 2 * 4]
    counts = [sum(layer == x for _, x in flat) for layer in range(4)]
    for ratio, cap in ((10.0, None), (2.0, None), (10.0, 6)):
        hard = min(int(ratio * 5), 30) if cap is None else min(int(ratio * 5), cap, 30)
        got = {r.layer: r.budget for r in K.reallocate(rows, 5, ratio, "g", cap).collect()}
        assert [got[x] for x in range(4)] == K.water_fill(20, [float(c) for c in counts], [hard] * 4)
        assert max(got.values()) <= hard and sum(got.values()) == min(20, 4 * hard)


def test_masked_vectors(spark):
    x = [5.0, 1.0, 2.0, 3.0, 100.0]
    one = spark.createDataFrame([(x, [False, False, False, False, True], 2)], "x array<double>, m array<boolean>, b int")
    assert one.select(K.apply_bits(F.col("x"), F.col("b"), F.col("m")).alias("r")).first().r == pytest.approx([5.0, 1.0, 1.0 + 4 / 3, 1.0 + 8 / 3, 100.0])
    assert one.select(K.tail_outliers(F.col("x"), 0.01).alias("r")).first().r == [False, False, False, False, True]
    assert one.select(K.tail_outliers(F.slice("x", 1, 2), 0.5).alias("r")).first().r == [False, False]
    all_out = one.withColumn("m", F.transform("m", lambda v: F.lit(True)))
    assert all_out.select(K.quantize_masked(F.col("x"), F.col("m"), 4, 2).alias("r")).first().r == x


def test_draws_do_not_depend_on_partitions(spark):
    pairs = spark.createDataFrame([(i, i % 7 / 7, i % 5 / 5) for i in range(300)], "key long, a double, b double")
    a, b = (S.paired_bootstrap(pairs.repartition(n), 300).first() for n in (1, 7))
    assert (a.low, a.high, a.p) == (b.low, b.high, b.p) and abs(a.mean - b.mean) < 1e-12 and a.low < a.mean < a.high
    labels = spark.createDataFrame([(k, c, (k * c) % 11 / 11) for k in range(60) for c in range(4)], "key long, cfg_ord int, score double")
    assert S.random_router_draws(labels.repartition(2), 200).first() == S.random_router_draws(labels.repartition(9), 200).first()
