"""The quality classifier: held-out labels, long texts, labellers without size switches."""

from pyspark.sql import functions as F

from ledgerline.llm import quality


def test_agrees_with_labels_it_never_saw(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.op2_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id")
    right, n = got.agg(F.avg((F.col("keep") == (F.col("quality") == 1)).cast("double")), F.count("*")).first()
    assert n > 300 and right >= 0.97


def test_words_are_looked_at_whole():
    a, b = "x" * 100 + "1", "x" * 100
    assert quality.word_shape(a) != quality.word_shape(b)
    assert quality.word_shape("aB1-" * 50) == quality.word_shape("aB1-" * 20) != quality.word_shape("aB1-" * 20 + "$")


def test_distinct_share_has_no_steps():
    for different in (1, 7, 500):
        values = [quality._distinct(min(different, n), n) for n in range(1, 8000)]
        assert all(abs(x - y) < 0.2 for x, y in zip(values, values[1:]))


def test_long_and_repeated_rows(spark):
    prose = "The reader found a quiet place and opened the old book again. "
    rows = [(1, prose * 3), (1, prose * 3), (2, "".join(f"Sentence {i} speaks of the {chr(97 + i % 26)}{i} matter at hand.\n" for i in range(20_000))), (3, None), (4, ""), (None, prose)]
    table = spark.createDataFrame(rows * 8, "doc_id long, text string").withColumn("keep", F.lit("mine"))
    model = quality.fit(table)
    kept = quality.keep_good(table, model)
    assert kept.columns == ["doc_id", "text", "keep"] and kept.filter("text is null or text = ''").count() == 0
    scores = quality.score(table, model).groupBy("doc_id").agg(F.countDistinct("score").alias("k"), F.count("*").alias("n")).collect()
    assert all(r.k == 1 for r in scores) and sum(r.n for r in scores) == 48
