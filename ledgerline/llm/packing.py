"""Packing along a space-filling curve.

Each document's hashed token vector is projected to four dimensions and
given its place on a Hilbert curve. Documents are range-sorted by that key
and cut into sequences in this order, so that neighbours share sequences.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import stage, table
from ledgerline.llm.wordtokens import Memo, chunks, load_tokenizer, slices, worker_cache

DIMS, BITS = 4, 12


def hashed_signs(vocab: int, dims: int = DIMS) -> np.ndarray:
    """A hash of each (id, dimension) to -1 or 1: the projection of the hashed vector."""
    x = np.arange(vocab * dims, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return np.where(x & np.uint64(1), 1, -1).astype(np.int8).reshape(vocab, dims)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers below 2**bits.

    The transposed form: undo the excess work from the highest bit down,
    Gray-encode, then interleave the bits.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Encoder:
    """Ids of a text as little-endian bytes, two or four to an id."""

    def __init__(self, path: str, limit: int):
        self.tok = load_tokenizer(path)
        self.kind = "<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4"
        self.signs = hashed_signs(self.tok.get_vocab_size())
        self.memo = Memo(self.encoded, limit)

    def encoded(self, text: str) -> bytes:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind).tobytes()

    def ids(self, text: str) -> bytes:
        keys = chunks(text)
        return self.encoded(text) if keys is None else b"".join(map(self.memo.__getitem__, keys))


def tokenize(docs: DataFrame, path: str, id_col: str, text_col: str, end_id: int, memo_entries: int) -> DataFrame:
    """``doc``, ``curve_key``, ``width`` (bytes per id), ``ids`` (with the end id) of each row."""
    schema = T.StructType([T.StructField("doc", docs.schema[id_col].dataType), T.StructField("curve_key", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("ids", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        enc = worker_cache(("encode", path, memo_entries), lambda: Encoder(path, memo_entries))
        width = int(enc.kind[-1])
        end = np.array([end_id], enc.kind).tobytes()
        for b in slices(batches):
            rows, mean = [], np.zeros((b.num_rows, DIMS))
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = enc.ids(text) if text else b""
                if ids:
                    a = np.frombuffer(ids, enc.kind)
                    mean[i] = sum(enc.signs[a[k : k + 100_000]].sum(0, dtype=np.int64) for k in range(0, len(a), 100_000)) / len(a)
                rows.append(ids + end)
            cells = np.clip((mean + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hilbert_key(cells)), pa.array([width] * len(rows), pa.int32()), pa.array(rows, pa.binary())], names=schema.names)

    return docs.select(F.col(id_col).alias("doc"), F.col(text_col)).mapInArrow(run, schema)


def cut(rows, length: int):
    """Pieces (row, start, size, total, sequence, offset, ids) of (row, ids) in order, gapless.

    Full sequences hold ``length`` ids. The ids left at the end go to
    sequences of falling powers of two, which need no padding.
    """
    seq, at, held = 0, 0, []
    for row, ids in rows:
        start = 0
        while start < len(ids):
            n = min(length - at, len(ids) - start)
            held.append((row, start, n, len(ids), seq, at, ids[start : start + n]))
            start, at = start + n, at + n
            if at == length:
                yield from held
                seq, at, held = seq + 1, 0, []
    room = 1 << (at.bit_length() - 1) if at else 0
    used = 0
    for row, start, n, total, _, _, ids in held:
        done = 0
        while done < n:
            k = min(room - used, n - done)
            yield row, start + done, k, total, seq, used, ids[done : done + k]
            done, used, at = done + k, used + k, at - k
            if used == room:
                seq, used = seq + 1, 0
                room = 1 << (at.bit_length() - 1) if at else 0


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, length: int = 2048, memo_entries: int = 1_000_000) -> DataFrame:
    """Pieces of all documents: id, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset``, ``ids``.

    ``ids`` are little-endian unsigned 32-bit ids. A null or empty text is
    its end id alone; repeated rows and null ids are packed like any other;
    an empty table gives no piece; other columns are not read. Ranges are cut
    by (curve key, id, hash of the ids), so that a third of all rows with one
    key still spread over many tasks. A task holds one batch of documents
    and one open sequence.
    """
    spark = docs.sparkSession
    tokens = stage(tokenize(docs, path, id_col, text_col, end_id, memo_entries), "pack", 1000)  # range-sorting reads its input twice
    order = [F.col("curve_key"), F.col("doc"), F.xxhash64("ids")]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = tokens.repartitionByRange(n, *order).sortWithinPartitions(*order)
    names = [id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(x, T.LongType()) for x in names[1:-1]), T.StructField("ids", T.BinaryType())])

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33

        def rows():
            for b in batches:
                for doc, width, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    yield doc, np.frombuffer(ids, f"<u{width}").astype("<u4")

        def batch(out):
            doc, start, size, total, seq, at, ids = zip(*out, strict=True)
            longs = [pa.array(x, pa.int64()) for x in (start, size, total, [first + s for s in seq], at)]
            return pa.RecordBatch.from_arrays([pa.array(doc, kind), *longs, pa.array([x.tobytes() for x in ids], pa.binary())], names=names)

        out, kind = [], pa_kind
        for piece in cut(rows(), length):
            out.append(piece)
            if len(out) == 2000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    from pyspark.sql.pandas.types import to_arrow_type

    pa_kind = to_arrow_type(docs.schema[id_col].dataType)
    return ranged.mapInArrow(run, schema)


def packed(docs: DataFrame, **how) -> DataFrame:
    """What query and pipeline return of the pieces, with the digest of their ids."""
    import public_tokenizers

    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"), **how)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
