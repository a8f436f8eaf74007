"""Runs against trying every period, and the edge cases of the operator."""

import random

import pytest

from ledgerline.llm import periodic as P


def brute(w, least, times):
    best = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            begin = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > begin:
                best.setdefault((begin, i + q), q)
            i += i == begin
    return sorted(((s, e - s, q) for (s, e), q in best.items() if e - s >= max(least, times * q)), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("least", "times"), [(6, 4), (4, 2), (5, 3), (1, 2)])
def test_against_brute_force(least, times):
    rng = random.Random(least)
    for _ in range(800):
        letters, n, w = rng.choice([1, 2, 3, 5]), rng.randint(0, 70), []
        while len(w) < n:
            part = [rng.randrange(letters) for _ in range(rng.randint(1, 7))]
            w += [rng.randrange(letters)] if rng.random() < 0.5 else (part * rng.randint(2, 8))[: rng.randint(3, 50)]
        w = [b"%d" % x for x in w]
        assert P.runs_of(w, least, times) == brute(w, least, times)


def test_masking_keeps_every_run_and_little_else():
    assert P.overlap(6, 4) == 5 and P.overlap(4, 2) == 2 and P.overlap(10, 3) == 7
    plain = [b"w%d" % i for i in range(3000)]
    assert P.segments(plain, 5, 6) == []
    words = plain[:1000] + [b"a", b"b", b"c"] * 6 + plain[1000:2000] + [b"x"] * 6 + plain[2000:]
    assert P.segments(words, 5, 6) == [(1000, 1018), (2018, 2024)]
    assert P.runs_of(words) == [(1000, 18, 3), (2018, 6, 1)]


def test_collapse():
    words = b"go on on on on on on stop a b a b a b a b a end".split()
    runs = P.runs_of(words)
    assert runs == [(1, 6, 1), (8, 9, 2)] and P.collapse(words, runs) == b"go on stop a b end"


def test_operator(spark):
    long = " ".join(str(i % 1009) for i in range(40_000))
    texts = [None, "", " \t\n", "one", "la " * 7, "la la la la la", "é  é  é \x0b" * 3, long, "same " * 9, "same " * 9]
    docs = spark.createDataFrame([(None if i == 3 else i % 9, t, i, "r") for i, t in enumerate(texts)], "doc_id long, text string, id int, runs string")
    got = P.find_runs(docs).collect()
    assert [r.id for r in got] == [None if i == 3 else i % 9 for i in range(len(texts))]
    as_rows = [[tuple(x) for x in r.runs] for r in got]
    assert as_rows == [[], [], [], [], [(0, 7, 1)], [], [(0, 9, 1)], [(0, 40_000, 1009)], [(0, 9, 1)], [(0, 9, 1)]]
    assert [r.collapsed for r in got[:7]] == ["", "", "", "one", "la", "la la la la la", "é "]
    assert got[7].collapsed == " ".join(map(str, range(1009)))
    assert P.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="twice"):
        P.find_runs(docs, times=1)
