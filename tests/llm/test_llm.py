"""Small tests of the pipeline operators: brute force, round trips, edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import ann, chat, html_text, mixing, packing, quality, token_counts, topk, warc

P = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, node long"
ODD = [None, "", " \n\t", "one", "one two", "The same text twice, here.", "The same text twice, here.", "İΣ ΑΣ don't\x1cstop <|endoftext|> é é", "long word " * 3000]


def docs(spark, texts):
    return spark.createDataFrame([(i if i != 3 else None, t, None, None, None, 1.0, 7) for i, t in enumerate(texts)], DOC)


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P)


def test_token_counts(spark, tok):
    got = token_counts.count_tokens(docs(spark, ODD), P, memo_entries=3).collect()
    assert [r.n_tokens for r in got] == [len(tok.encode(t or "", add_special_tokens=False).ids) for t in ODD]
    assert [r.n_bytes for r in got] == [len((t or "").encode()) for t in ODD]
    assert not token_counts.count_tokens(docs(spark, ODD).limit(0), P).count()


def test_memo_is_exact(tok):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    enc = packing.Encoder(P, 50)
    count = token_counts.Counter(P, token_counts.prove_single_tokens(P), 50)
    texts = st.one_of(st.text(), st.text(alphabet="aA'sSt.,!? \n\x1c\x85\xa0éÉİΣσ012²µ<|endoftext>"), st.lists(st.sampled_from(["<|endoftext|>", "<|EndOfText|>", "don't", "word.,", "ΣΑΣ", " "])).map("".join))

    @settings(max_examples=300, deadline=None)
    @given(texts)
    def check(t):
        want = tok.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(enc.ids(t), enc.kind).tolist() == want and count.count(t) == len(want)

    check()


def test_packing_covers_every_id(spark, tok):
    texts = ODD + ["alpha beta gamma " * k for k in range(40)]
    got = packing.pack(docs(spark, texts).withColumn("doc_id", F.coalesce("doc_id", F.lit(3))), P).withColumn("crc", F.crc32("ids")).collect()
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    seen, places = {i: [] for i in ids}, {}
    for r in got:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.crc and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id].append((r.start, r.length))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, parts in seen.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == len(ids[i])
    for parts in places.values():
        total = 0
        for offset, n in sorted(parts):
            assert offset == total
            total += n
        assert total <= 2048 and total & (total - 1) == 0
    assert not packing.pack(docs(spark, ODD).limit(0), P).count()


def test_hilbert_neighbours():
    cells = np.array([[x, y] for x in range(8) for y in range(8)])
    key = packing.hilbert_key(cells, 3)
    path = cells[np.argsort(key)]
    assert sorted(key) == list(range(64)) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi <|im_end|>\\n"), (1, 1, "assistant", None), (1, 2, "assistant", "a\\|b <|"), (2, None, "sys\ntem", ""), (None, 0, "user", "x"), (None, 0, "user", "x")]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, tree string")
    done = chat.format_trees(chat.chains(turns))
    got = {r.tree: chat.parse_turns(r.formatted) for r in done.collect()}
    assert got == {"1": [("user", "hi <|im_end|>\\n"), ("assistant", ""), ("assistant", "a\\|b <|")], "2": [("sys\ntem", "")], "null": [("user", "x"), ("user", "x")]}
    back = {r.tree: r for r in chat.read_back(done).collect()}
    assert back["1"].loss_sha256 == hashlib.sha256(b"a\\|b <|").hexdigest() and back["1"].loss_chars == 7


def test_branches_are_ranked(spark):
    nodes = spark.createDataFrame([("t", 1, None, 0.0, "user", "q"), ("t", 2, 1, 1.0, "assistant", "a"), ("t", 3, 1, 2.0, "assistant", "b"), ("t", 4, 3, 0.5, "user", "c"), ("t", 5, 6, 9.0, "user", "loop"), ("t", 6, 5, 9.0, "user", "loop"), ("u", 1, 99, None, "user", None)], "tree string, node long, parent long, score double, role string, text string")
    got = {(r.tree, r.branch_rank): [t for _, t in chat.parse_turns(r.formatted)] for r in chat.format_trees(nodes, top=2).collect()}
    assert got == {("t", 1): ["q", "b", "c"], ("t", 2): ["q", "a"], ("u", 1): [""]}


def test_mixing_stays_within_a_block(spark):
    texts = [(i, "t", None, ["a", "b", None][0 if i % 10 < 7 else 1 if i % 10 < 9 else 2], 1, 0.0, 0) for i in range(400)] + [(1, "t", None, "a", 1, 0.0, 0)]
    got = mixing.mix(spark.createDataFrame(texts, DOC), weights={"a": 3, "b": 2, None: 1}, block_rows=4).collect()
    assert len({r._position for r in got}) == len(got) and {r.doc_id for r in got} == set(range(400))
    slots = sorted({(r._slot, r._source or "-") for r in got})
    assert [s for s, _ in slots] == list(range(len(slots)))
    for source, share in (("a", 3 / 6), ("b", 2 / 6), ("-", 1 / 6)):
        done = 0
        for t, (_, s) in enumerate(slots, 1):
            done += s == source
            assert abs(t * share - done) < 1
    assert not mixing.mix(spark.createDataFrame([], DOC)).count()


def test_quality_keeps_clean_text(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    clean = [" ".join(word() for _ in range(rng.randint(6, 60))).capitalize() + "." for _ in range(150)]
    junk = [" ".join(word() + "$$$" for _ in range(40)) for _ in range(12)] + ["BUY!! NOW!! " * 30] * 6 + ["same " * 200] * 6 + ["cell | " * 40] * 6
    table = docs(spark, clean + junk + [None, ""]).withColumn("doc_id", F.monotonically_increasing_id())
    model = quality.fit(table)
    keep = {r.text: r.keep for r in quality.score(table.withColumn("doc_id", F.col("text")), model, "doc_id").withColumnRenamed("doc_id", "text").collect()}
    assert all(keep[t] for t in clean) and not any(keep[t] for t in [*junk, None, ""])
    assert quality.keep_good(table, model).count() == len(clean)
    assert not quality.score(table.limit(0), quality.fit(table.limit(0))).count()


def test_html_layout():
    page = "<title>t</title><p>a<p>b <b>c</b><ul><li>x<li>y<ol><li>z</ol></ul><table><tr><td>a<td>bbb<tr><td>cccc<td>d</table><div style='display: none'>no</div>x&amp;y<br>z<pre>\n  k\n v</pre><!-- c --><script>var a='<p>'</script>end<p hidden>h<details><summary>s</summary>no</details>"
    assert html_text.render(page) == "a\n\nb c\n\n- x\n- y\n  1. z\n\na     bbb\ncccc  d\n\nx&y\nz\n\n  k\n v\n\nend\ns"
    assert html_text.render("<div>" * 5000 + "deep") == "deep"
    assert html_text.render("a<b") == "a<b" and html_text.render("<p") == "<p"


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, None, "u"), (None, "", "u"), (2, "<p>x", "u"), (2, "<p>x", "u")], "page_id long, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in html_text.extract(pages).collect()) == [(0, ""), (1, ""), (2, "x"), (2, "x")]


def test_warc_round_trip(spark):
    evil = "x" * 50 + "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.0\r\n" + "y" * 80
    rows = [(1, "u", evil), (2, "u\r\nv", evil), (3, None, None), (4, "", ""), (5, "a", "small"), (6, "a", "small"), (7, "b", "WARC/1.0\r\n"), (8, "b", "é" * 60), (0, "b", "é" * 60), (9, "c", evil * 300)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        path = warc.new_path(spark, "test")
        warc.write_archives(warc.records(pages), path)
        got = {r.id: r for r in warc.read_archives(spark, path).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(got) == len(rows)
    for i, _, h in rows:
        r = got[f"<urn:page:{i}>"]
        assert (r.bytes, r.digest) == (len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest())
        assert r.type == ("revisit" if i in (2, 8) else "response")


def vectors(spark, n=400, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8))
    x[50:120] = x[50]
    rows = [(i, [float(v) for v in x[i]], 0.0) for i in range(n)] + [(9001, None, 0.0), (9100, [1.0, None] + [0.0] * 6, 0.0), (9200, [float("nan")] * 8, 0.0), (None, [0.5] * 8, 0.0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double"), x


def test_topk_is_exact(spark):
    table, x = vectors(spark)
    got = topk.top_k(table, table.filter("vec_id % 100 = 0"), block_rows=16).collect()
    q = np.floor(1024 * x).astype(np.int64)
    want = []
    for i in range(0, 400, 100):
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(400), -s)) if j != i][:10]
        want += [(i, k, int(j), int(s[j])) for k, j in enumerate(order, 1)]
    assert sorted(map(tuple, got)) == want
    assert not topk.top_k(table.limit(0), table.limit(0)).count()


def test_ann_recall(spark):
    table, x = vectors(spark, 2000)
    got = ann.search(table, table.filter("vec_id % 100 = 0"), list_rows=50, shard_rows=64, lists=8, share=0.3).collect()
    hit = 0
    for i in range(0, 2000, 100):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        own = {r.vec_id: r.score for r in got if r.query_id == i}
        assert len(own) == 10 and all(abs(d[j] - s) < 1e-12 for j, s in own.items())
        hit += len(own.keys() & set(np.lexsort((np.arange(2000), d))[:10].tolist()))
    assert hit >= 0.9 * 200
    assert not ann.search(table.limit(0), table.limit(0)).count()


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() and "sequence_id" in got.columns
