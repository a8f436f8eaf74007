"""The n-gram join and its tries against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerline.llm import ngram_join as nj

SCHEMA = "doc_id long, text string, node int, root string, doc_ string, keys string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "r", None, "k") for i, t in rows], SCHEMA)


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(sets, percent):
    root = list(range(len(sets)))
    changed = True
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in linked:
            if root[i] != root[j]:
                root[i] = root[j] = min(root[i], root[j])
                changed = True
    return root


def mutated(rng, base, words, most):
    copy = list(base)
    for _ in range(rng.randint(0, most)):
        copy[rng.randrange(len(copy))] = rng.choice(words)
    return " ".join(copy)


def corpus(seed):
    """Families of near copies, short texts, and a passage that most texts of one kind share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    texts = [None, "", "A b", "a  B", "x y z", "q", "  \t\n"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(8, 120))]
        texts += [mutated(rng, base, words, 4) for _ in range(rng.randint(1, 9))]
    passage = [f"p{i}" for i in range(40)]
    texts += [" ".join([rng.choice(words) for _ in range(rng.randint(0, 9))] + passage + [rng.choice(words) for _ in range(rng.randint(0, 5))]) for _ in range(40)]
    texts.append("long text " * 20_000)
    return texts


@pytest.mark.parametrize(("k", "percent", "how"), [(4, 85, {}), (5, 80, {}), (4, 85, {"most_hot": 5})])
def test_components_match_brute_force(spark, monkeypatch, k, percent, how):
    # small blocks, so that subtrees and probes fall into several
    monkeypatch.setattr(nj.subtrees, "__defaults__", (None, 3))
    monkeypatch.setattr(nj.within, "__defaults__", (2,))
    texts = corpus(k)
    table = frame(spark, list(enumerate(texts))).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.link(table, k=k, percent=percent, **how).collect()}
    sets = [shingles(t, k) for t in texts]
    root = components(sets, percent)
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}
    kept = nj.keep_one(table, k=k, percent=percent, **how)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


def test_empty_table(spark):
    table = frame(spark, [(1, "a b c d e f")]).limit(0)
    assert not nj.link(table).count() and not nj.keep_one(table).count()


def test_repeated_and_null_ids(spark):
    one, other, third = ("alpha " * 3 + "beta gamma delta epsilon zeta eta theta"), "nothing in common with that text at all here", "yet another text that is not like any of the others"
    rows = [(1, one), (1, other), (1, one), (2, one), (None, third), (None, third), (3, third), (None, "only here without an id so it stays"), (4, None), (4, ""), (4, None)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in nj.keep_one(frame(spark, rows)).collect())
    assert got == sorted([(False, 1, one), (False, 1, other), (False, 3, third), (True, 0, "only here without an id so it stays"), (False, 4, ""), (False, 4, ""), (False, 4, "")])
    linked = nj.link(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in linked) == sorted([(1, 1), (1, 1), (1, 1), (2, 1), (0, 3), (0, 3), (3, 3), (0, 0), (4, 4), (4, 4), (4, 4)])


def test_trie_walk_is_exact_on_whole_sets():
    rng = np.random.default_rng(3)
    for percent in (60, 85):
        sets = []
        for _ in range(12):
            base = rng.choice(500, rng.integers(1, 200), replace=False)
            sets += [np.unique(np.append(rng.choice(base, max(1, int(len(base) * rng.uniform(0.8, 1))), replace=False), rng.choice(500, rng.integers(0, 6)))).astype(np.uint64) for _ in range(6)]
        trie = nj.build_trie([(s, len(s), len(s), i, i) for i, s in enumerate(sets)])
        for x in sets:
            want = {j for j, y in enumerate(sets) if 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y))}
            assert set(nj.walk_trie(x, len(x), len(x), trie, percent)) == want
            # beginnings lose none
            short = nj.build_trie([(s[: nj.prefix_length(len(s), percent)], len(s), len(s), i, i) for i, s in enumerate(sets)])
            assert set(nj.walk_trie(x[: nj.prefix_length(len(x), percent)], len(x), len(x), short, percent)) >= want


def test_trie_shares_beginnings():
    a = np.arange(100, dtype=np.uint64)
    b = np.append(a[:90], np.uint64(500))
    root = nj.build_trie([(a, 100, 100, 5, 0), (b, 91, 91, 6, 1), (a, 100, 100, 5, 2)])
    (shared,) = root.children
    assert (shared.start, shared.end, shared.least, shared.most, shared.group) == (0, 90, 91, 100, None) and len(shared.children) == 2


def test_nodes_are_the_same_in_sql(spark):
    digests = [xxhash.xxh3_128_intdigest(str(i).encode()) for i in range(50)]
    table = spark.createDataFrame([(i, *nj.halves(d)) for i, d in enumerate(digests)], "i int, s0 long, s1 long")
    for turn in (0, 1, 17, 63):
        assert {r.i: r.node for r in table.withColumn("node", F.expr(nj.node_sql(turn))).collect()} == {i: nj.node_of(d, turn) for i, d in enumerate(digests)}
