"""WARC archives: deduplicating writer and a reader by boundary-chain verification.

The reader splits files anywhere. Tasks find every record magic in their
block and emit its successor's offset as the candidate's header says; pointer
jumping from each file's start keeps the candidates that the chain reaches.
A magic inside a payload begins no reachable record.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.llm.common import new_path, stage, table

MAGIC, CRLF = "WARC/1.0\r\n", "\r\n"
GAP = CRLF + CRLF
#: Bytes of a file within which parts and the records they belong to are brought together.
STRETCH = 1 << 16


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 100, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One text column ``value``: a WARC record per row, without its closing blank lines.

    Null html is an empty payload. Of rows with equal payloads of at least
    ``min_bytes`` bytes the smallest id is a response (rows repeated with that
    very id too), the others are revisits without payload that name it; rows
    with null ids are revisits wherever an id is there. Only groups of two and
    more are looked up, by a join whose hot keys can be split.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]+", " ").alias("url"), payload.alias("p"))
    base = base.withColumn("n", F.octet_length("p").cast("long")).withColumn("digest", F.sha2(F.col("p").cast("binary"), 256))
    twice = base.filter(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("c")).filter("c > 1").select("digest", "first")
    twice = stage(twice, "warc-twice")
    found = base.join(twice, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(">"))
    head = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(again, "revisit").otherwise("response"), F.lit(f"{CRLF}WARC-Record-ID: "), name,
        F.when(again, F.concat(F.lit(f"{CRLF}WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))).otherwise(""),
        F.when(F.col("url") != "", F.concat(F.lit(f"{CRLF}WARC-Target-URI: "), F.col("url"))).otherwise(""),
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}Content-Type: text/html; charset=utf-8{CRLF}WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.lit(f"{CRLF}X-Payload-Bytes: "), F.col("n").cast("string"), F.lit(f"{CRLF}Content-Length: "), F.when(again, "0").otherwise(F.col("n").cast("string")), F.lit(GAP),
    )
    return found.select(F.concat(head, F.when(again, "").otherwise(F.col("p"))).alias("value"))


def write_archives(recs: DataFrame, path: str, max_records: int = 100_000) -> None:
    """Archives of at most ``max_records`` records, by Spark's own committed text writer: the line end is the records' gap."""
    recs.write.option("lineSep", GAP).option("maxRecordsPerFile", max_records).text(path)


_FIELD = re.compile(rb"^([A-Za-z-]+): *(.*?)\r?$", re.M)


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """What lies between two magics, in the order of the file, with the block that a task read."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary").alias("part"))


def candidates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Each magic: ``file``, ``at``, ``next`` (its successor by its own header), what its header says and its payload's digest;
    and ``file``, ``block``, ``base``: where each block that a task read begins.

    ``whole`` is false where the payload goes on past the next magic.
    ``head`` is the bytes from the magic to the payload.
    """
    schema = "file string, block long, at long, head long, length long, bytes long, digest string, type string, id string, refers string, whole boolean, size long"

    def run(batches):
        import pyarrow as pa

        last, at = None, 0
        for b in batches:
            rows = []
            for file, block, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if (file, block) != last:
                    last, at = (file, block), 0
                start, size = at - len(MAGIC), len(part) + len(MAGIC)
                at += size
                row = [file, block, start, None, None, None, None, None, None, None, None, size]
                end = part.find(b"\r\n\r\n")
                if end >= 0:
                    fields = {k.lower(): v for k, v in _FIELD.findall(part[:end])}
                    length = fields.get(b"content-length", b"")
                    if length.isdigit():
                        n, kind = int(length), fields.get(b"warc-type", b"").decode("latin-1")
                        body = part[end + 4 : end + 4 + n]
                        row[3:6] = len(MAGIC) + end + 4, n, n
                        row[7:11] = kind, fields.get(b"warc-record-id", b"").decode("latin-1"), fields.get(b"warc-refers-to", b"").decode("latin-1"), len(body) == n
                        if kind == "revisit":
                            row[5] = int(fields.get(b"x-payload-bytes", b"0"))
                            row[6] = fields.get(b"warc-payload-digest", b"").decode("latin-1").rpartition(":")[2]
                        elif len(body) == n:
                            row[6] = hashlib.sha256(body).hexdigest()
                rows.append(row)
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [pa.string(), *[pa.int64()] * 5, *[pa.string()] * 4, pa.bool_(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    found = stage(_scan(spark, path).mapInArrow(run, schema), "warc-scan")
    blocks = found.groupBy("file", "block").agg(F.sum("size").alias("total"))
    before = F.coalesce(F.sum("total").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = stage(blocks.select("file", "block", before.alias("base")), "warc-bases")  # one row a block
    based = found.join(bases, ["file", "block"])
    at = F.col("base") + F.col("at")
    return based.select("file", at.alias("at"), (at + F.col("head") + F.col("length") + len(GAP)).alias("next"), "head", "length", "bytes", "digest", "type", "id", "refers", "whole"), bases


def reachable(cand: DataFrame) -> DataFrame:
    """The candidates that the chain of successors from offset 0 of their file reaches, by pointer jumping.

    A group is the candidates of one archive, about 200 bytes each, whose
    number the writer's ``max_records`` (and the customary 1 GB a file) bounds.
    """

    def jump(pdf):
        import numpy as np

        pdf = pdf[pdf["next"].notna()].sort_values("at", ignore_index=True)
        n = len(pdf)
        if not n or pdf["at"][0] != 0:
            return pdf[:0]
        at, to = pdf["at"].to_numpy(np.int64), pdf["next"].to_numpy(np.int64)
        k = np.minimum(np.searchsorted(at, to), n - 1)
        hop = np.append(np.where(at[k] == to, k, n), n)  # n: no record there
        seen = np.zeros(n + 1, bool)
        seen[0] = True
        for _ in range(max(1, n.bit_length())):
            seen[hop[seen]] = True
            hop = hop[hop]
        return pdf[seen[:n]]

    return cand.filter("next is not null").groupBy("file").applyInPandas(jump, cand.schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``id``, ``type``, ``refers``, ``bytes`` and ``digest`` (of the full payload) of each true record.

    Payloads that hold the magic were cut there; their parts alone are read
    again and joined before the digest is taken.
    """
    cand, bases = candidates(spark, path)
    true = stage(reachable(cand), "warc-true")
    out = ["id", "type", "refers", "bytes", "digest"]
    cut = true.filter("not whole and type != 'revisit'")
    if not cut.limit(1).count():
        return true.select(*out)

    def parts(batches):
        import pyarrow as pa

        last, at = None, 0
        for b in batches:
            rows = []
            for file, block, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if (file, block) != last:
                    last, at = (file, block), 0
                rows.append((file, block, at - len(MAGIC), part))
                at += len(part) + len(MAGIC)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["file", "block", "at", "part"])

    cut_files = F.broadcast(cut.select(F.col("file").alias("file_path")).distinct()) if cut.count() <= 100_000 else cut.select(F.col("file").alias("file_path")).distinct()
    scanned = _scan(spark, path).select("file_path", "file_block_start", "part").mapInArrow(parts, "file string, block long, at long, part binary")
    placed = scanned.join(cut_files, F.col("file") == F.col("file_path"), "left_semi").join(bases, ["file", "block"]).select("file", (F.col("base") + F.col("at")).alias("abs"), "part")
    # the part's owner is the last cut record that begins at or before it, sought among what lies in the same stretch of the file
    owner = cut.select("file", F.struct(F.col("at").alias("own"), "next", "head", "length", "id", "type", "refers").alias("o"))
    reach = owner.withColumn("stretch", F.explode(F.expr(f"sequence(o.own div {STRETCH}, (o.next - 1) div {STRETCH})")))
    begins = reach.select("file", "stretch", F.expr(f"greatest(o.own, stretch * {STRETCH})").alias("abs"), F.lit(0).alias("kind"), "o", F.lit(None).cast("binary").alias("part"))
    lies = placed.select("file", F.expr(f"abs div {STRETCH}").alias("stretch"), "abs", F.lit(1).alias("kind"), F.lit(None).cast(owner.schema["o"].dataType).alias("o"), "part")
    last = F.last("o", ignorenulls=True).over(W.partitionBy("file", "stretch").orderBy("abs", "kind"))
    held = begins.unionByName(lies).withColumn("o", last).filter("kind = 1 and abs < o.next").select("file", "abs", "part", "o.*")

    def join(pdf):
        import pandas as pd

        pdf = pdf.sort_values("abs")
        x = pdf.iloc[0]
        whole = MAGIC.encode() + MAGIC.encode().join(bytes(p) for p in pdf["part"])
        body = whole[x["head"] : x["head"] + x["length"]]
        return pd.DataFrame([(x["id"], x["type"], x["refers"], len(body), hashlib.sha256(body).hexdigest())], columns=out)

    again = held.groupBy("file", "own").applyInPandas(join, "id string, type string, refers string, bytes long, digest string")
    return true.filter("whole or type = 'revisit'").select(*out).unionByName(again)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(records(table(spark, sf_dir, "pages")), path)
    number = r"<urn:page:(-?\d+)>"
    back = read_archives(spark, path)
    return back.select(
        F.regexp_extract("id", number, 1).try_cast("long").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.regexp_extract(F.coalesce("refers", F.lit("")), number, 1).try_cast("long").alias("refers_to"),
    )
