import pytest

from ledgerline.operators import aggregate as A
from ledgerline.operators import validate as V
from ledgerline.sinks import export as E


def test_picks_report(spark):
    rows = [("a", "C1", 1.0, 2.0), ("a", "C2", 0.0, 4.0), ("b", "C1", 0.5, 2.0), ("b", "C1", 0.25, 1.0)]
    got = {r.task: r for r in A.picks_report(spark.createDataFrame(rows, "task string, configuration string, score double, compression double"), ["C1", "C2", "C3"]).collect()}
    assert (got["a"].q, got["a"].cr, got["a"].n, got["a"].picks_C1, got["a"].picks_C2, got["a"].picks_C3) == (0.5, 2.667, 2, 1, 1, 0)
    assert (got["overall"].q, got["overall"].cr, got["overall"].n, got["overall"].picks_C1) == (0.4375, 1.778, 4, 3)


def test_truncation_differences(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 11), ("b", 12), ("c", 1)], "task string, tokens int")
    expected = spark.createDataFrame([("a", 1), ("b", 0), ("d", 0)], "task string, truncated long")
    got = {(r.task, r.found, r.truncated) for r in A.truncation_differences(rows, "tokens", 10, expected).collect()}
    assert got == {("b", 1, 0), ("c", 0, None), ("d", None, 0)}


def test_lookup(spark):
    registry = spark.createDataFrame([("a", 7), ("b", 8)], "task string, max_new_tokens int")
    rows = spark.createDataFrame([("a", "k")], "task string, key string")
    assert V.lookup(rows, registry).select("key", "max_new_tokens").collect() == [("k", 7)]
    with pytest.raises(ValueError, match="registry"):
        V.lookup(rows.unionByName(spark.createDataFrame([("z", "k")], "task string, key string")), registry)


def test_index_violations(spark):
    registry = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1)], "task string, expected long")
    schema = "task string, source_index long, key string, original_tokens long, token_count long, truncated boolean"
    good = [("a", 0, "x", 4, 4, False), ("a", 1, "y", 12, 10, True), ("b", 0, "x", 10, 10, False), ("b", 1, "y", 1, 1, False), ("c", 0, "x", 1, 1, False)]
    assert not V.index_violations(spark.createDataFrame(good, schema), registry, 10).count()
    bad = [("a", 0, "x", 4, 4, False), ("a", 0, "x", 12, 10, False), ("b", 0, "x", 11, 11, True), ("z", 0, "x", 1, 1, None)]
    got = {(r.rule, r.task, r.n) for r in V.index_violations(spark.createDataFrame(bad, schema), registry, 10).collect()}
    assert got == {("repeated place", "a", 1), ("repeated id", "a", 1), ("incomplete task", "a", 2), ("incomplete task", "b", 1), ("incomplete task", "c", 0), ("unknown task", "z", 1), ("truncation", "a", 1), ("truncation", "b", 1), ("truncation", "z", 1)}


def test_master(spark):
    one, two = spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(3, 4)], "a int, c int")
    got = E.master({"one": one, "two": two}).orderBy("part_ord")
    assert got.columns == ["part_ord", "part", "a", "b", "c"]
    assert [tuple(r) for r in got.collect()] == [(0, "one", 1, 2, None), (1, "two", 3, None, 4)]


def test_environment(spark, tmp_path):
    found = E.environment(spark, str(tmp_path), ("pyspark", "no-such-package"))
    assert found["packages"] == {"pyspark": spark.version, "no-such-package": None}
    assert found["git"] == {"commit": None, "branch": None, "dirty": None}


def test_finalize_is_final(spark, tmp_path):
    rows, other = spark.createDataFrame([(1,), (1,)], "a int"), spark.createDataFrame([(1,)], "a int")
    artifact, path = tmp_path / "x.csv", str(tmp_path / "manifest.json")
    artifact.write_text("a\n")
    run = lambda stored, **m: E.finalize({"rows": (rows, stored)}, {"x": str(artifact)}, m, path)
    with pytest.raises(ValueError, match="rows"):
        run(other, run="r")
    digest = run(rows, run="r")
    assert run(rows, run="r") == digest == E.file_sha256(path)
    with pytest.raises(ValueError, match="already complete"):
        run(rows, run="s")
    artifact.write_text("b\n")
    with pytest.raises(ValueError, match="changed since"):
        run(rows, run="r")
    with E.exclusive(f"{path}.lock"), pytest.raises(RuntimeError, match="held"):
        run(rows, run="r")
