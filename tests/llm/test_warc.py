"""Archives whose payloads hold many magics, null ids, and an empty table."""

import hashlib

from ledgerline.llm import warc


def read_back(spark, pages, small_blocks):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        if small_blocks:
            spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
        path = warc.new_path(spark, "test")
        warc.write_archives(warc.records(pages), path)
        return warc.read_archives(spark, path).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_magic_in_every_payload(spark):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:9999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    html = [f"page {i} " + fake * (1 + i % 50 * 40 * (i % 7 == 0) + i % 5) + "WARC/1.0\r\n" * (i % 3) + "end" for i in range(120)]
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], "page_id long, url string, html string").coalesce(1)
    got = {r.id: r for r in read_back(spark, pages, True)}
    assert len(got) == 120
    for i, h in enumerate(html):
        r = got[f"<urn:page:{i}>"]
        assert (r.bytes, r.digest, r.type) == (len(h), hashlib.sha256(h.encode()).hexdigest(), "response")


def test_null_ids_and_empty_table(spark):
    long = "same text " * 20
    rows = [(None, None, long), (5, "u", long), (None, "u", None), (None, "u", "x" * 200), (None, "v", "x" * 200)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")
    got = sorted((r.id, r.type, r.refers or "", r.bytes) for r in read_back(spark, pages, False))
    assert got == sorted([("<urn:page:null>", "revisit", "<urn:page:5>", 200), ("<urn:page:5>", "response", "", 200), ("<urn:page:null>", "response", "", 0), ("<urn:page:null>", "response", "", 200), ("<urn:page:null>", "response", "", 200)])
    assert read_back(spark, pages.limit(0), False) == []
