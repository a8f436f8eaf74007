"""ROUGE-L over sentences, exact signed ranks, and tables compared in order, each against a plain form."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.operators import stats as S
from ledgerline.operators import validate as V


def common(a, b):
    """The words of a longest common subsequence from the whole table."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    i, j, out = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif table[i - 1][j] > table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    assert len(out) == table[-1][-1]
    return set(out)


def test_common_words_are_those_of_the_table():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 14))] for _ in range(2))
        assert T.lcs_words(a, b) == common(a, b)
    assert T.lcs_words([str(i) for i in range(20_000)], [str(i) for i in range(0, 20_000, 2)]) == {str(i) for i in range(0, 20_000, 2)}


@pytest.mark.parametrize(
    ("prediction", "gold", "hits", "mine", "theirs"),
    [
        ("a b c", "a b c", 3, 3, 3),
        ("the cat sat. the dog ran", "the cat ran. a dog sat", 5, 5, 6),  # the cat, the ran; sat, dog
        ("one two. three four", "one four", 2, 4, 2),  # each predicted sentence gives its part
        ("x x x y", "x y y", 2, 2, 2),  # words count once
        ("a b.", "a b", 2, 2, 2),  # nothing after the stop is no sentence
        ("a b. ", "a b", 2, 3, 2),  # a blank after it is one with an empty word
        ("a b. ", "c. ", 1, 3, 2),  # and it is common to both
        ("b a", "a b", 1, 2, 2),
    ],
)
def test_sentences_by_hand(spark, prediction, gold, hits, mine, theirs):
    p, r = hits / mine, hits / theirs
    assert abs(T._rouge(prediction, gold) - 2 * p * r / (p + r + 1e-8)) < 1e-12


def test_no_sentence_scores_nothing(spark):
    rows = [("", "a"), ("...", "a"), ("a", "."), (None, "a"), ("a", None), ("a.b", "b")]
    got = spark.createDataFrame(rows, "p string, g string").select(T.rouge_l("p", "g").alias("x")).collect()
    assert [round(r.x, 6) for r in got] == [0, 0, 0, 0, 0, round(2 * 0.5 / 1.5, 6)]


def test_token_f1_against_counters(spark):
    rng = random.Random(2)
    rows = [(" ".join(rng.choice("uvwxyz") for _ in range(rng.randint(0, 30))), " ".join(rng.choice("uvwxyz") for _ in range(rng.randint(0, 30)))) for _ in range(200)]
    rows.append((" ".join(f"w{i % 7000}" for i in range(30_000)), " ".join(f"w{i % 9000}" for i in range(20_000))))
    for r, (p, g) in zip(spark.createDataFrame(rows, "p string, g string").select(T.token_f1(F.col("p"), F.col("g")).alias("f")).collect(), rows, strict=True):
        a, b = Counter(p.split()), Counter(g.split())
        same = sum((a & b).values())
        assert abs(r.f - (2 * same / (a.total() + b.total()) if same else 0.0)) < 1e-12


def test_signed_ranks_by_all_sign_patterns(spark):
    for n in (1, 2, 5, 9):
        sums = Counter(sum(k for k, s in enumerate(signs, 1) if s) for signs in itertools.product((0, 1), repeat=n))
        assert S.signed_rank_counts(n) == [sums[t] for t in range(n * (n + 1) // 2 + 1)]
    pairs = [(0.0, x) for x in (0.3, -0.1, 0.7, 0.2, 0.9, 1.1)]  # only rank 1 is negative: 2 * (1 + 1) / 64
    row = S.wilcoxon(spark.createDataFrame(pairs, "b double, a double")).first()
    assert (row.statistic, row.n, row.exact, row.p) == (1.0, 6, True, 4 / 64)
    for more in ([(0.0, 0.0)], [(0.0, 0.3)]):  # a zero difference, a tie
        row = S.wilcoxon(spark.createDataFrame(pairs + more, "b double, a double")).first()
        assert not row.exact and 0 < row.p < 1
    many = S.wilcoxon(spark.createDataFrame([(0.0, (-1) ** i * (i + 1) / 8) for i in range(51)], "b double, a double")).first()
    assert not many.exact and many.n == 51
    assert S.wilcoxon(spark.createDataFrame([], "b double, a double")).first().p is None


def test_tables_in_order(spark):
    a = spark.range(20_000).select(F.col("id").alias("place"), (F.col("id") * 7 % 1000).alias("x"), F.when(F.col("id") % 5 > 0, "t").alias("y"))
    assert V.ordered_differences(a, a.repartition(5), "place").count() == 0 and V.same_rows(a, a.orderBy(F.desc("x")))
    swap = a.withColumn("place", F.when(F.col("place") == 11, 15_000).when(F.col("place") == 15_000, 11).otherwise(F.col("place")))
    assert sorted(map(tuple, V.ordered_differences(a, swap, "place").collect())) == [(11, "changed"), (15_000, "changed")]
    assert V.same_rows(a.drop("place"), swap.drop("place")) and not V.same_rows(a, swap)
    cut = a.filter("place != 19999").unionByName(a.limit(1).withColumn("place", F.lit(30_000).cast("long")))
    assert sorted(map(tuple, V.ordered_differences(a, cut, "place").collect())) == [(19_999, "missing"), (30_000, "unexpected")]
    assert not V.same_rows(a, a.unionAll(a.limit(1))) and V.same_rows(a.limit(0), a.limit(0)) and not V.same_rows(a, a.drop("y"))
