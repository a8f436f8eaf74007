"""The manifest and its paths against a tree built in one go."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import manifest as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, _t int, path string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r[:5]))


def tree(nodes):
    """(root, per leaf its siblings upwards as (before, after))."""
    paths, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for k, p in enumerate(at):
            run = level[p // 8 * 8 : p // 8 * 8 + 8]
            paths[k].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        level = [h("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        at = [p // 8 for p in at]
    return level[0], paths


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 200, 511, 512])
def test_traversal(n):
    nodes = [h(str(i)) for i in range(n)]
    root, paths = tree(nodes)
    reads = []
    walk = M.Traversal(lambda i: reads.append(i) or nodes[i], n, M.height(n))
    assert (walk.root() if n > 1 else nodes[0]) == root
    for want, sides in zip(paths, walk.paths(), strict=True):
        assert list(sides) == want
        held = sum(map(len, walk.exist)) + sum(map(len, walk.desired)) + sum(len(run) for b in walk.builders for run in b.runs)
        assert held <= 8 * (2 * walk.levels + walk.levels**2)


def rows():
    rng = random.Random(3)
    out = [(i, "s", rng.choice(["en", "de", None, "é", "z" * 40, "Z"]), i, f"Text {i} ÄA") for i in rng.sample(range(5000), 1400)]
    out += [(9000 + i, None, "one", None, None) for i in range(1)]
    out += [(7, "s", "en", 1, ""), (7, "s", "en", 1, ""), (None, None, None, None, None), (None, "x", "en", 3, "T"), (5, "s", "hot", 5, "w" * 200_000)]
    out += [(i, "s", "hot", 1, "same") for i in range(20_000, 24_400)]
    return [(*r, 1, "p") for r in out]


def wanted(data):
    trees = {}
    for r in data:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    subs = {}
    for name in names:
        trees[name].sort(key=lambda x: x[:3])
        subs[name] = tree([x[2] for x in trees[name]])
    root, top = tree([subs[name][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for (_, _, digest, r), path in zip(trees[name], subs[name][1], strict=True):
            path = path + top[k]
            cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            acc = leaf((*r[:4], "".join(c.lower() if c.isascii() else c for c in r[4]))) if cut else digest
            for b, a in path:
                acc = h(b + acc + a)
            out.append((-1 if r[0] is None else r[0], digest, subs[name][0], root, h("".join(b + a for b, a in path)), acc, acc == root))
    return sorted(out)


def test_query_against_one_tree(spark, tmp_path):
    data = rows()
    spark.createDataFrame(data, SCHEMA).repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in M.op11_manifest(spark, str(tmp_path)).collect())
    assert got == wanted(data)


def test_small_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(*r, 1, "p") for r in [(1, "s", "en", 2, "t")]], SCHEMA)
    build = lambda d: M.manifest(d, F.col("lang"), ["doc_id"], M.digest(F.col("doc_id"), F.col("text")), {"_t": F.col("_t")}).collect()
    (r,) = build(docs)
    assert r.path == [] and r.leaf == r.subroot == r.root == h("1:11:t") and r._t == 1 and r.position == 0
    assert build(docs.limit(0)) == []
    monkeypatch.setattr(M, "FEW", 1)
    a, b = sorted(build(docs.unionAll(docs.withColumn("lang", F.lit(None).cast("string")))), key=lambda r: r.tree or "")
    assert a.tree is None and a.root == b.root == h(a.subroot + b.subroot) and (a.path[0].before, a.path[0].after) == ("", b.subroot)
