"""The pipeline's stages on nulls, empty and long texts, repeated rows, repeated ids, further columns and an empty table."""

import random

from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _n int, token string"


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    prose = [" ".join(word() for _ in range(rng.randint(20, 80))).capitalize() + "." for _ in range(60)]
    rows = [(i, t, "en", ["a", "b", None][i % 3]) for i, t in enumerate(prose)]
    rows += [(5, prose[5], "en", "a"), (100, prose[7], "en", "b"), (8, prose[9] + " More words follow here today.", "en", "a"), (None, prose[11] + " End.", "en", None), (None, None, None, "a"), (101, "", "en", "a"), (102, "$$$ !!! ??? " * 30, "en", "a")]
    rows.append((103, " ".join(word() for _ in range(30_000)) + ".", "en", "a"))
    return prose, [(*r, 0, 1, "t") for r in rows]


def test_stages(spark):
    prose, rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {}
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, "")
        if name != "packing":
            assert out.columns == docs.columns
        kept[name] = [r.asDict() for r in out.collect()]
        docs = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in kept[name]], SCHEMA) if name != "packing" else docs
    good = kept["quality"]
    assert {t for t in prose} <= {r["text"] for r in good} and not {None, "", "$$$ !!! ??? " * 30} & {r["text"] for r in good}
    once = kept["near_duplicates"]
    texts = [r["text"] for r in once]
    assert len(texts) == len(set(texts)) and sum(r["doc_id"] == 5 for r in once) == 1
    assert {r["doc_id"] for r in once if r["text"] == prose[7]} == {7}
    mixed = kept["source_mix"]
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"])
    assert {key(r) for r in mixed} == {key(r) for r in once}
    pieces = kept["packing"]
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in mixed}
    assert max(r["offset"] + r["length"] for r in pieces) <= 2048


def test_empty_table_passes_through(spark):
    docs = spark.createDataFrame(corpus()[1], SCHEMA).limit(0)
    for _, function in corpus_pipeline.STAGES:
        assert not function(spark, docs, "").count()


def test_near_copies_leave_one(spark):
    prose, _ = corpus()
    long = " ".join(prose[:6])
    docs = spark.createDataFrame([(k, f"{long} ending {k}", "en", "a", 0, 1, "t") for k in range(30, 0, -1)], SCHEMA)
    (row,) = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert row.doc_id == 1 and corpus_pipeline.near_duplicates(spark, docs.filter(F.col("doc_id") == 3), "").count() == 1


def test_columns_named_like_those_of_the_mix(spark):
    names = ("_source", "_epoch", "_block", "_slot", "_position", "_src", "_row")
    docs = spark.createDataFrame([(i, f"text {i}", "en", "ab"[i % 2], 1, *([i] * len(names))) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} long" for n in names))
    out = corpus_pipeline.source_mix(spark, docs, "")
    assert out.columns == docs.columns
    rows = out.collect()
    assert {r.doc_id for r in rows} == set(range(40)) and all(r[n] == r.doc_id for r in rows for n in names)
    assert corpus_pipeline.source_mix(spark, docs.limit(0), "").count() == 0
