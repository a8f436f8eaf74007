"""Contracts of JSON records: types, absent fields, canonical values; evaluations on a split."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import contracts as C
from ledgerline.operators import router as R

GOOD = {
    "task": "t", "model": "m", "model_id": "m/1", "source_index": 0, "metric": "qa_f1", "references": ["x", 2, 2.5], "all_classes": None, "category": "c",
    "features": {"seq_len_tokens": 3, "seq_len_chars": 9, "token_entropy": 1.5, "gzip_ratio": 1.1, "unique_token_ratio": 1, "newline_density": 0.0, "question_position": None},
    "pre_truncation_token_count": 9, "post_truncation_token_count": 8, "truncated": True, "max_new_tokens": 64, "token_hash_algorithm": "sha256",
}


def lines(spark, *records):
    return C.parsed(spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)], "i int, value string"))


def broken(spark, *records):
    registry = spark.createDataFrame([("t", "c", "qa_f1", 64), ("k", "c", "classification", 64)], "task string, category string, scorer string, max_new_tokens int")
    return {r.i: r.broken for r in C.shared_violations(lines(spark, *records), registry, 8, "sha256").collect()}


@pytest.mark.parametrize("bad", ["", "  ", "[1]", "7", "{", '{"a":NaN}'])
def test_lines_must_be_objects(spark, bad):
    with pytest.raises(Exception, match="no JSON object"):
        lines(spark, bad).collect()


def test_null_line_raises(spark):
    with pytest.raises(Exception, match="no JSON object"):
        C.parsed(spark.createDataFrame([(None,)], "value string")).collect()


def test_good_record_and_each_broken_rule(spark):
    gone = {k: v for k, v in GOOD.items() if k != "category"}
    cases = [
        (GOOD, None), (gone, None), (GOOD | {"category": None}, ["category"]), (GOOD | {"task": "u"}, ["task", "metric", "new_tokens", "category"]),
        (GOOD | {"model": 7}, ["model"]), (GOOD | {"model_id": None}, ["model_id"]), (GOOD | {"source_index": True}, ["place"]), (GOOD | {"source_index": -1}, ["place"]), (GOOD | {"source_index": 0.5}, ["place"]),
        (GOOD | {"references": []}, ["references"]), (GOOD | {"references": [True]}, ["references"]), (GOOD | {"references": [None]}, ["references"]), (GOOD | {"references": "x"}, ["references"]),
        (GOOD | {"all_classes": ["a"]}, ["classes"]), (GOOD | {"task": "k", "metric": "classification"}, ["classes"]), (GOOD | {"task": "k", "metric": "classification", "all_classes": ["a", ""]}, ["classes"]), (GOOD | {"task": "k", "metric": "classification", "all_classes": ["a"]}, None),
        (GOOD | {"features": GOOD["features"] | {"more": 1}}, ["features"]), (GOOD | {"features": GOOD["features"] | {"gzip_ratio": 0}}, ["features"]), (GOOD | {"features": GOOD["features"] | {"seq_len_chars": True}}, ["features"]), (GOOD | {"features": None}, ["features"]),
        (GOOD | {"post_truncation_token_count": 9}, ["lengths", "truncation"]), (GOOD | {"truncated": False}, ["truncation"]), (GOOD | {"pre_truncation_token_count": 7, "post_truncation_token_count": 7}, ["truncation"]),
        (GOOD | {"pre_truncation_token_count": 7, "post_truncation_token_count": 7, "truncated": False}, None), (GOOD | {"truncated": 1}, ["truncation"]), (GOOD | {"max_new_tokens": "64"}, ["new_tokens"]), (GOOD | {"token_hash_algorithm": "md5"}, ["hash"]),
    ]
    found = broken(spark, *(r for r, _ in cases))
    assert [found.get(i) for i in range(len(cases))] == [want for _, want in cases]


def test_shared_fields_by_presence_and_canonical_value(spark):
    records = [
        ("same", '{"a":{"y":1,"x":[1,null]}}'), ("same", '{"a": {"x": [1, null], "y": 1}}'),
        ("other", '{"a":[1,2]}'), ("other", '{"a":[2,1]}'),
        ("null", '{"a":null}'), ("null", '{"a":null}'),
        ("null and text", '{"a":null}'), ("null and text", '{"a":"null"}'),
        ("some", '{"a":1,"b":null}'), ("some", '{"a":1}'),
        ("gone", '{"b":1}'), ("gone", '{"b":1}'),
    ]
    rows = C.parsed(spark.createDataFrame(records, "key string, value string"))
    found = {(r.key, r.field, r.problem) for r in C.shared_field_differences(rows, ["key"], ["a"], ["b"]).collect()}
    assert found == {("other", "a", "value"), ("null and text", "a", "value"), ("some", "b", "presence"), ("gone", "a", "missing")}
    assert C.shared_field_differences(rows.limit(0), ["key"], ["a"]).count() == 0


def test_wide_rows(spark):
    good = {"C0_prediction": "", "C0_kv_accounting": "plain", "C0_generated_token_count": 0, "C0_score": 1, "C0_kv_bytes": 10, "C0_kv_bytes_fp16": 25.0, "C0_compression": 2.5}
    bad = [good | {"C0_prediction": None}, good | {"C0_score": -0.1}, good | {"C0_compression": 2.51}, good | {"C0_kv_bytes": True}, {k: v for k, v in good.items() if k != "C0_score"}]
    found = {r.i: r.broken for r in C.wide_violations(lines(spark, good, *bad), ["i"], ["C0"], {"C0": "plain"}).collect()}
    assert found == {1: ["prediction"], 2: ["score"], 3: ["ratio"], 4: ["bytes", "ratio"], 5: ["fields", "score"]}


def test_registry(spark):
    schema = "task string, category string, expected long, scorer string, max_new_tokens int"
    good = [("a", "x", 2, "qa_f1", 32), ("b", "x", 3, "count", 64)]
    published = spark.createDataFrame([("a", 32), ("b", 64), ("z", 64)], "task string, max_new_tokens int")
    check = lambda rows, total=5: {(r.rule, r.task) for r in C.registry_violations(spark.createDataFrame(rows, schema), published, ["z"], ["x"], ["qa_f1", "count"], total).collect()}
    assert check(good) == set()
    assert check(good, 6) == {("total", None)}
    assert check(good[:1], 2) == {("covered", "b")}
    assert check([*good, good[0]], 7) == {("repeated", "a")}
    assert check([good[0], ("z", "y", 0, "none", 64), ("q", "x", 3, "count", 1)]) == {("covered", "b"), ("excluded", "z"), ("category", "z"), ("scorer", "z"), ("expected", "z"), ("published", "q")}
    assert check([good[0], ("b", "x", 3, "count", 65)]) == {("max_new_tokens", "b")}
    assert check([], 0) == {("covered", "a"), ("covered", "b")}


def _labels(spark):
    rows = [("t" if k < 8 else "u", "c", k, f"C{c}", c, (k % 5) / 10 + c / 20, 1.0 + c) for k in range(10) for c in range(3)]
    return spark.createDataFrame(rows, "task string, category string, key long, configuration string, cfg_ord int, score double, compression double")


def test_split_uses_the_training_side_alone(spark):
    labels = _labels(spark)
    split = labels.select("key", (F.col("key") < 7).alias("train")).distinct()
    predicted = R.split_predictions(labels, split)
    means = {r.cfg_ord: r.prediction for r in predicted.filter("key = 9").collect()}  # a task without training rows
    assert means == pytest.approx({c: sum((k % 5) / 10 + c / 20 for k in range(7)) / 7 for c in range(3)})
    found = {(r.side, r.tau): r for r in R.evaluate_split(labels, split, predicted, (0.5, 2.0)).collect()}
    assert {k: r.n for k, r in found.items()} == {("train", 0.5): 7, ("train", 2.0): 7, ("test", 0.5): 3, ("test", 2.0): 3}
    assert all(r.cr == pytest.approx(3.0) for r in found.values())  # C2 has the best prediction and the largest ratio
    filtered = {(r.side, r.tau): r.n for r in R.evaluate_split(labels, split, predicted, (0.5,), filter_candidates=True).collect()}
    assert filtered == {("train", 0.5): 7, ("test", 0.5): 3}
    fit = {(r.configuration, r.side): r.n for r in R.split_fit(labels, split, predicted).collect()}
    assert fit == {(f"C{c}", s): n for c in range(3) for s, n in (("train", 7), ("test", 3))}


def test_line_through_other_folds(spark):
    labels = _labels(spark).filter("cfg_ord = 0")
    folds = labels.select("key", (F.col("key") % 2).cast("int").alias("fold"))
    straight = labels.select("key", (F.col("score") * 4 + 1).alias("x"), F.lit(3.0).alias("flat"))
    for x, want in (("x", {k: (k % 5) / 10 for k in range(10)}), ("flat", {k: sum((j % 5) / 10 for j in range(10) if j % 2 != k % 2) / 5 for k in range(10)})):
        found = {r.key: r.prediction for r in R.line_predictions(labels, folds, straight, x).collect()}
        assert found == pytest.approx(want)
    absent = straight.withColumn("x", F.when(F.col("key") != 3, F.col("x")))
    assert 3 not in {r.key for r in R.line_predictions(labels, folds, absent, "x").collect()}
