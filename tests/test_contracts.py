"""Small contracts that queries do not reach: readers, sinks, checks, byte counts, and the narrow plans of bucketed tables."""

import hashlib
import json
import struct
import zipfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerline.functions import features as X
from ledgerline.functions import kernels as K
from ledgerline.functions import text as T
from ledgerline.operators import sweep as P
from ledgerline.operators import validate as V
from ledgerline.sinks import export as E
from ledgerline.sources import readers as R


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def ids_sha(ids):
    return hashlib.sha256(b"".join(struct.pack("<I", i) for i in ids)).hexdigest()


def test_tokens_meet_their_index_without_a_shuffle(spark, tmp_path):
    ids = {(f"t{k % 3}", f"k{k}"): list(range(k % 5 + 1)) for k in range(60)}
    index = spark.createDataFrame([(t, k, len(v) + (k == "k7"), ids_sha(v if k != "k8" else [9])) for (t, k), v in ids.items()], "task string, key string, token_count int, token_sha256 string")
    tokens = spark.createDataFrame([(t, k, v) for (t, k), v in ids.items() if k != "k9"], "task string, key string, ids array<long>")
    assert {r.key for r in R.check_tokens(index, tokens).collect()} == {"k7", "k8", "k9"}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = E.write_buckets(index, "prepared_index", 4, str(tmp_path / "i")), E.write_buckets(tokens, "prepared_tokens", 4, str(tmp_path / "t"))
        found = R.check_tokens(a, b)
        assert {r.key for r in found.collect()} == {"k7", "k8", "k9"}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for name in ("prepared_index", "prepared_tokens"):
            spark.sql(f"drop table if exists {name}")


def test_canonical_rows(spark):
    rows = [Row(b={"y": [1, None], "x": None}, a=Row(z="é\"\\\n\x01/", k=1.5), c=[Row(q=True, p=None)], d=1e16, e=None), Row(b={}, a=None, c=[], d=-0.0, e="x"), Row(b=None, a=Row(z="", k=1e-7), c=None, d=0.1, e="")]
    schema = "b map<string, array<long>>, a struct<z: string, k: double>, c array<struct<q: boolean, p: long>>, d double, e string"
    want = [E.canonical_json(v) for v in ({"b": {"y": [1, None], "x": None}, "a": {"z": "é\"\\\n\x01/", "k": 1.5}, "c": [{"q": True, "p": None}], "d": 1e16, "e": None}, {"b": {}, "a": None, "c": [], "d": -0.0, "e": "x"}, {"b": None, "a": {"z": "", "k": 1e-7}, "c": None, "d": 0.1, "e": ""})]
    assert [r.json for r in E.canonical_rows(spark.createDataFrame(rows, schema)).collect()] == want
    assert E.canonical_rows(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(Exception, match="JSON"):
        E.canonical_rows(spark.createDataFrame([(float("nan"),)], "x double")).collect()
    with pytest.raises(TypeError, match="date"):
        E.canonical_rows(spark.sql("select current_date() as d"))
    assert one(spark, E.canonical_column("id")) == '{"id":0}'


def test_logs_results_and_locked_documents(spark, tmp_path):
    rows = spark.createDataFrame([("t", 0.12345678, None, 1.23456)], "task string, score double, kv_bytes double, compression double")
    E.log_rows(rows, str(tmp_path / "C1"))
    got, gone = R.read_logs(spark, {"C1": str(tmp_path / "C1"), "C2": str(tmp_path / "no")})
    (row,) = got.collect()
    assert (row.score, row.compression, row.configuration, gone) == (0.123457, 1.2346, "C1", ["C2"]) and "kv_bytes" not in got.columns
    E.write_once(rows, str(tmp_path / "once"))
    assert "kv_bytes" in spark.read.json(str(tmp_path / "once")).columns
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        E.write_once(rows, str(tmp_path / "once"))
    (tmp_path / "r.json").write_text(json.dumps({"new": 2, "old": 3}))
    assert R.read_results(spark, str(tmp_path / "r.json"), ("newer", "new", "old")).first().ratio == 2.0
    assert R.read_results(spark, str(tmp_path / "r.json"), ("none",)).first().ratio is None
    assert R.locked(str(tmp_path / "r.json"), {"new": 2, "old": 3})["old"] == 3
    with pytest.raises(ValueError, match="drifted in old"):
        R.locked(str(tmp_path / "r.json"), {"new": 2, "old": 4})


def test_csv_bundle_markdown_and_tokens(spark, tmp_path):
    E.write_csv(spark.createDataFrame([(2, 'a "b", c'), (3, None)], "n int, t string"), str(tmp_path / "csv"))
    (file,) = (tmp_path / "csv").glob("part-*")
    assert file.read_text() == 'n,t\n2,"a \\"b\\", c"\n3,\n'
    E.bundle({"b.csv": str(file), "a.csv": str(file)}, str(tmp_path / "x.zip"))
    with zipfile.ZipFile(tmp_path / "x.zip") as z:
        assert z.namelist() == ["a.csv", "b.csv"] and z.read("a.csv") == file.read_bytes()
    with pytest.raises(FileExistsError):
        E.bundle({}, str(tmp_path / "x.zip"))
    assert E.markdown([{"a": 1, "b": "x"}], ["b", "a"]) == "| b | a |\n|-|-|\n| x | 1 |"
    E.write_tokens(spark.createDataFrame([("t", "k", [1, 2])], "task string, key string, ids array<long>"), str(tmp_path / "tok"))
    assert spark.read.parquet(str(tmp_path / "tok")).filter("task = 't'").first().ids == [1, 2]


def test_prompts_and_byte_counts(spark):
    assert one(spark, T.fill_template("{a}|{a}", {"a": F.lit("{a}")})) == "{a}|{a}"
    assert one(spark, T.fill_template("<{a}>", {"a": F.lit(None)}, strict=False)) == "<>"
    with pytest.raises(Exception, match="field a is null"):
        one(spark, T.fill_template("<{a}>", {"a": F.lit(None).cast("string")}))
    with pytest.raises(ValueError, match="no field for b"):
        T.fill_template("{b}", {"a": F.lit("")})
    per = X.bytes_per_token(F.lit(2), F.lit(3), F.lit(5))
    assert one(spark, per) == 120 and one(spark, X.fp16_growth_bytes(F.lit(10), per)) == 1200 and one(spark, X.fp16_growth_bytes(F.lit(10), per, 5)) == 480
    assert one(spark, X.compression_ratio(F.lit(6.0), F.lit(2.0))) == 3.0 and one(spark, X.compression_ratio(F.lit(6.0), F.lit(0.0), strict=False)) == 1.0
    with pytest.raises(Exception, match="positive"):
        one(spark, X.compression_ratio(F.lit(6.0), F.lit(0.0)))
    ids = F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(9))
    assert one(spark, X.stop_ids(*ids, F.lit(True))) == [1, 2, 9] and one(spark, X.stop_ids(*ids, F.lit(False))) == [1, 2]
    assert one(spark, X.middle_truncate(F.array(*map(F.lit, range(9))), 5)) == [0, 1, 7, 8]


def test_shares_of_negative_weights_and_window_sums(spark):
    assert K.water_fill(10, [3.0, -1.0, 2.0], [100, 100, 100]) == [6, 0, 4]
    assert sum(K.water_fill(10, [-3.0, -1.0, 0.0], [100, 2, 100])) == 10
    scores = spark.createDataFrame([(q, p, float(q * 10 + p)) for q in range(4) for p in range(2)], "q int, pos int, score double")
    assert sorted(map(tuple, K.window_sum(scores, 2).collect())) == [(0, 50.0), (1, 52.0)]


def test_pilots_features_and_fields(spark):
    rows = spark.createDataFrame([(0, 1, "b", 50, 8), (0, 0, "a", 90, 4), (1, 0, "c", 90, 8), (1, 1, "d", 95, 8)], "task_ord int, source_index int, key string, tokens int, max_new_tokens int")
    assert [r.key for r in V.pilot(rows, 80, 8).collect()] == ["c"] and [r.key for r in V.pilot(rows, 0, 0, limit=2).collect()] == ["a", "b"]
    gib = 2**30
    pilots = spark.createDataFrame([("C0", "completed", 10 * gib, gib, 7 * gib), ("C1", "completed", 10 * gib, gib, 8 * gib), ("C2", "failed", 10 * gib, 0, 0)], "configuration string, status string, total_bytes long, non_torch_bytes long, peak_reserved_bytes long")
    every = spark.createDataFrame([(f"C{i}",) for i in range(4)], "configuration string")
    assert sorted(r.configuration for r in V.pilot_gate(pilots, every).collect()) == ["C1", "C2", "C3"]
    feats = spark.createDataFrame([(0, 1, 0.5, None), (1, -1, 0.5, None), (2, 1, float("nan"), None), (3, 1, 0.5, 1.2), (4, None, 0.5, 0.3), (5, 1, 0.5, 1.0)], "k int, n int, x double, s double")
    assert [r.k for r in V.feature_violations(feats, ["n"], ["x"], ["s"]).orderBy("k").collect()] == [1, 2, 3, 4]
    registry = spark.createDataFrame([("qa", "qa_f1"), ("trec", "classification")], "task string, scorer string")
    shared = spark.createDataFrame([("qa", 1, "qa_f1", None), ("qa", 2, "count", None), ("qa", 3, "qa_f1", ["a"]), ("trec", 4, "classification", ["a"]), ("trec", 5, "classification", None), ("new", 6, "qa_f1", None)], "task string, key int, metric string, all_classes array<string>")
    assert sorted(r.key for r in V.shared_violations(shared, registry).collect()) == [2, 3, 5, 6]
    left = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0), (3, None, 3.0)], "key int, x string, y double")
    right = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.5), (3, None, 3.0)], "key int, x string, y double")
    assert [(r.key, r.fields) for r in V.field_differences(left, right, ["key"], ["x", "y"]).collect()] == [(2, ["x", "y"])]


def test_points_that_dominate_and_gaps(spark):
    points = spark.createDataFrame([("a", 2, 0.9, 0.5, 2.0, 10), ("b", 2, 0.9, 0.6, 1.5, 10), ("c", 3, 0.9, 0.7, 0.9, 9)], "pool_key string, size int, tau double, q double, cr double, n long")
    assert [r.pool_key for r in P.best_dominating(points, 0.5, 1.0).collect()] == ["b"]
    assert P.best_dominating(points, 0.9, 1.0).count() == 0
    assert [r.pool_key for r in P.coverage_gaps(points, 10).collect()] == ["c"]
