from pyspark.sql import functions as F

from ledgerline.functions import features as X
from ledgerline.functions import text as T


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("r")).first().r


def test_token_f1(spark):
    f1 = lambda p, g: one(spark, T.token_f1(F.lit(p), F.lit(g)))
    assert f1("A quiet, Harbour?", "the quiet harbour") == 1.0
    assert f1("", "boat") == 0.0 and f1("an", "a") == 0.0
    assert abs(f1("oar oar sail", "oar mast") - 0.4) < 1e-12


def test_counts_and_paragraphs(spark):
    assert abs(one(spark, T.count_score(F.lit("7 of the 12 boats, then 7"), F.lit("7"))) - 2 / 3) < 1e-12
    assert one(spark, T.count_score(F.lit("007"), F.lit("7"))) == 0.0
    assert one(spark, T.retrieval_score(F.lit("Either 11 or 5, see there"), F.lit("Paragraph 5"))) == 0.5


def test_classification_generations(spark):
    classes = F.array(F.lit("sea"), F.lit("port"), F.lit("seaport"))  # two that are part of the third
    assert one(spark, T.classification(F.lit("by the seaport"), F.lit("seaport"), classes, strict=False)) == 1.0
    assert one(spark, T.classification(F.lit("by the seaport"), F.lit("seaport"), classes, strict=True)) == 0.5
    assert one(spark, T.classification(F.lit("tide or wind"), F.lit("wind"), F.array(F.lit("tide"), F.lit("wind")))) == 0.5


def test_code_and_rouge(spark):
    assert one(spark, T.code_line(F.lit("\n```sh\n# list\nls -l\ncd .."))) == "ls -l"
    assert one(spark, T.code_similarity(F.lit("\n// step\ngo on;"), F.lit("go on;"))) == 1.0
    assert abs(one(spark, T.rouge_l(F.lit("hello world"), F.lit("hello world"))) - 0.999999995) < 1e-9
    assert one(spark, T.rouge_l(F.lit(""), F.lit("x"))) == 0.0


def test_postprocess_and_template(spark):
    assert one(spark, T.postprocess(F.lit("\n\n a \nb"), F.lit(True))) == " a "
    assert one(spark, T.postprocess(F.lit("\n\n a \nb"), F.lit(True), strict=False)) == "a"
    assert one(spark, T.fill_template("{a}-{b}", {"a": F.lit("{b}"), "b": F.lit("x")})) == "{b}-x"


def test_features(spark):
    ids = F.array(*map(F.lit, (1, 1, 2, 3)))
    f = {k: one(spark, c) for k, c in X.prompt_features(F.lit("ab?\n"), ids).items()}
    assert f == {"seq_len_tokens": 4, "seq_len_chars": 4, "token_entropy": 1.5, "unique_token_ratio": 0.75, "question_position": 0.5, "newline_density": 0.25}
    assert one(spark, X.prompt_features(F.lit("ab"), ids)["question_position"]) is None


def test_truncation_and_digest(spark):
    import hashlib
    import struct

    ids = F.array(*(F.lit(x).cast("long") for x in (0, 1, 2, 3, 4, 5, 6, 2**32 - 1)))
    cut = one(spark, X.middle_truncate(ids, 6))
    assert cut == [0, 1, 2, 5, 6, 2**32 - 1]
    assert one(spark, X.ids_sha256(ids)) == hashlib.sha256(struct.pack("<8I", 0, 1, 2, 3, 4, 5, 6, 2**32 - 1)).hexdigest()


def test_lcs_is_that_of_the_table():
    import random

    rng = random.Random(4)
    for _ in range(60):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 90))] for _ in range(2))
        row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                row[i][j] = row[i - 1][j - 1] + 1 if x == y else max(row[i - 1][j], row[i][j - 1])
        assert T.lcs_length(a, b) == row[-1][-1]
    assert T.lcs_length(["w"] * 20_000, ["w", "v"] * 10_000) == 10_000


def test_dispatch(spark):
    rows = [("qa_f1", "red boat", ["blue", "the red boat"], 1.0), ("rouge_l", "red boat", ["blue", "red boat"], 0.999999995), ("code_similarity", "# x\ngo on;", ["stop", "go on;"], 1.0),
            ("count", "3 or 4", ["5", "4"], 0.5), ("retrieval", "it is 2", ["Paragraph 2"], 1.0), ("classification", "wind", ["wind"], 1.0), ("other", "x", ["x"], None)]
    table = spark.createDataFrame(rows, "scorer string, p string, refs array<string>, want double").withColumn("classes", F.array(F.lit("wind"), F.lit("tide")))
    for r in table.withColumn("got", T.dispatch(F.col("scorer"), F.col("p"), F.col("refs"), F.col("classes"))).collect():
        assert r.got == r.want or abs(r.got - r.want) < 1e-9, r
    empty = table.withColumn("refs", F.expr("cast(array() as array<string>)")).filter("scorer in ('rouge_l', 'qa_f1')")
    assert {r.got for r in empty.withColumn("got", T.dispatch(F.col("scorer"), F.col("p"), F.col("refs"), F.col("classes"), strict=False)).collect()} == {0.0}
    import pytest

    with pytest.raises(Exception, match="no references"):
        empty.withColumn("got", T.dispatch(F.col("scorer"), F.col("p"), F.col("refs"), F.col("classes"))).collect()


def test_subset_and_tokenized(spark):
    names = ["seq_len_tokens", "seq_len_chars", "token_entropy"]
    assert one(spark, X.subset(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), names, X.LENGTH_ONLY["both"])) == [1.0, 2.0]
    prompts = spark.createDataFrame([("ab", True, 1), ("c", False, 2), (None, True, 3)], "prompt string, chat boolean, n int")
    got = X.tokenized(prompts, lambda: lambda t: [ord(c) for c in t], wrap=lambda t: f"<{t}>").collect()
    assert [(r.n, r.ids) for r in got] == [(1, [60, 97, 98, 62]), (2, [99]), (3, [60, 62])]
