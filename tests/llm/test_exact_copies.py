"""Exact copies against a brute-force grouping: nulls, empty and long texts, ties, repeated rows, clashing columns, an empty table."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import exact_copies as X

SCHEMA = "doc_id long, text string, _len int, _row string, kept string, id int"


def corpus():
    rng = random.Random(7)
    texts = [None, "", None, "a", "a", "A", "x" * 300 + "1", "x" * 300 + "2", "x" * 300 + "1", "é" * 150_000, "é" * 150_000]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    texts += ["the hot one"] * 200
    rows = [(i, t, 1, "r", "k", 2) for i, t in enumerate(texts)]
    rows += [(4, "a", 1, "r", "k", 2), (None, "a", 1, "r", "k", 2), (None, "nobody", 1, "r", "k", 2), (None, "nobody", 1, "r", "k", 2), (9000, "alone", 1, "r", "k", 2)]
    return rows


def check(got, rows, change=lambda t: t):
    groups = defaultdict(list)
    for r in rows:
        groups[change(r[1] or "")].append(r[0])
    assert len(got) == len(rows)
    stay = defaultdict(int)
    for r in got:
        ids = groups[r.t]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        stay[r.t] += r.kept
        assert not r.kept or r.id == r.keep_id
    assert set(stay.values()) == {1} and stay.keys() == groups.keys()


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    check(X.copies(docs, carry={"t": F.coalesce("text", F.lit(""))}).collect(), rows)


def test_normalised(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    lower = lambda c: F.lower(c)
    check(X.copies(docs, normalise=lower, prefix=2, carry={"t": F.lower(F.coalesce("text", F.lit("")))}).collect(), rows, str.lower)


def test_few_bits_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(X, "MOST_BITS", 64)
    monkeypatch.setattr(X, "ROW_BITS", 64)
    rows = corpus()
    check(X.copies(spark.createDataFrame(rows, SCHEMA), carry={"t": F.coalesce("text", F.lit(""))}).collect(), rows)


def test_whole_rows_and_empty_table(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = X.without_copies(docs)
    assert kept.columns == docs.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {r[1] or "" for r in rows}
    assert X.copies(docs.limit(0)).count() == 0 and X.without_copies(docs.limit(0)).count() == 0


def test_only_copies_are_read_whole(spark):
    docs = spark.createDataFrame([(i, "p" * 300 + str(i)) for i in range(50)] + [(50, "q" * 500), (51, "q" * 500)], "doc_id long, text string")
    seen = X.stage
    staged = {}

    def watch(df, tag, *a):
        staged[tag] = seen(df, tag, *a)
        return staged[tag]

    with pytest.MonkeyPatch.context() as m:
        m.setattr(X, "stage", watch)
        m.setattr(X, "free", lambda *a: None)
        X.copies(docs).collect()
    whole = {r._whole for r in staged["copies-rows"].filter("_whole is not null and _id >= 50").collect()}
    assert whole == {hashlib.sha256(b"q" * 500).hexdigest()}
    assert staged["copies-groups"].count() == 1


def test_main_path_is_native(spark):
    plan = X.copies(spark.createDataFrame(corpus(), SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
