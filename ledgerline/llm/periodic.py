"""Runs of repeated words: masking by repeated k-grams, then Main and Lorentz's method on what is left.

A run is a stretch of words with smallest period q that is as long as can be
and has at least max(``least``, ``times`` * q) words. Its words but the last q
equal those q further on, so at least k = min over q of (max(least, times * q)
- q) words in a row occur again: every word of a run lies in a k-gram that its
document has twice. Words outside such k-grams part the document into
segments, and only those of ``least`` words and more are searched: halves are
searched alone, and runs across the middle come from longest common
extensions of one half with itself and with the other (Z functions).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import table
from ledgerline.llm.wordtokens import slices

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def overlap(least: int, times: int) -> int:
    """The fewest words that a run has in common with itself one period further on."""
    return min(max(least, times * q) - q for q in range(1, max(2, least) + 1))


def segments(words: list[bytes], k: int, least: int) -> list[tuple[int, int]]:
    """Stretches (begin, end) of words that lie in a k-gram found twice; k-grams that only share a hash make them longer, never shorter."""
    n = len(words)
    if n < max(least, k + 1):
        return []
    with np.errstate(over="ignore"):
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        g = h[: n - k + 1].copy()
        for j in range(1, k):
            g = g * np.uint64(0xD6E8FEB86659FD93) + h[j : n - k + 1 + j]
    order = np.argsort(g, kind="stable")
    same = g[order[1:]] == g[order[:-1]]
    if not same.any():
        return []
    again = np.zeros(len(g), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    inside = np.concatenate(([False], np.cumsum(edge[:n]) > 0, [False]))
    begins, ends = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
    return [(int(b), int(e)) for b, e in zip(begins, ends, strict=True) if e - b >= least]


def z_function(s: list[int], upto: int) -> list[int]:
    """For each place below ``upto`` how many elements from there equal those from the beginning."""
    n, left, right = len(s), 0, 0
    z = [n] * min(1, upto)
    for i in range(1, upto):
        k = min(z[i - left], right - i) if i < right else 0
        if k < 0:
            k = 0
        if i + k >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            if i + k > right:
                left, right = i, i + k
        z.append(k)
    return z


def common(s: list[int], of: list[int], upto: int) -> list[int]:
    """For each of the first ``upto`` places of ``s`` how many elements from there equal the beginning of ``of``."""
    m = len(of)
    joined = [*of, -1, *s]
    return z_function(joined, m + 1 + upto)[m + 1 :]


def crossing(w: list[int], least: int, times: int, found: dict[tuple[int, int], int]) -> None:
    """Main and Lorentz: the runs of ``w`` by (begin, end), each with its smallest period."""
    todo = [(0, len(w))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < max(2, least):
            continue
        mid = (lo + hi) // 2
        todo += [(lo, mid), (mid, hi)]
        left, right, most = w[lo:mid], w[mid:hi], (hi - lo) // times
        back, kcab = left[::-1], right[::-1]
        for u, v, mirrored in ((left, right, False), (kcab, back, True)):
            # u ends where v begins, and the run has a period's words in v
            upto = min(most, len(v))
            if upto < 1:
                continue
            ahead = [*z_function(v, min(upto + 1, len(v))), 0]  # v against itself, p further on
            u_back = u[::-1]
            # u's end against what lies p further on, backwards: v[p-1], ..., v[0], u's end, ...
            whole = [*v[:upto][::-1], *u_back]
            behind = common(whole, u_back, upto)
            for p in range(1, upto + 1):
                b, a = behind[upto - p], ahead[p]
                if b + a + p < max(least, times * p):
                    continue
                begin, end = (mid - b, mid + p + a) if not mirrored else (mid - p - a, mid + b)
                # at the ends of this part a run may go on: then a part above has found it
                if (begin == lo and lo > 0 and w[lo - 1] == w[lo - 1 + p]) or (end == hi and hi < len(w) and w[hi] == w[hi - p]):
                    continue
                if found.get((begin, end), p) >= p:
                    found[begin, end] = p


def runs_of(words: list[bytes], least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a document, by start, then period."""
    out = []
    for b, e in segments(words, overlap(least, times), least):
        known: dict[bytes, int] = {}
        found: dict[tuple[int, int], int] = {}
        crossing([known.setdefault(x, len(known)) for x in words[b:e]], least, times, found)
        out += [(b + s, t - s, p) for (s, t), p in found.items()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, one space between them, without those that a run has beyond its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """One row per row: ``id``, ``runs`` (start, length and period in words, by start, then period) and ``collapsed``, the text without repeated periods.

    Words are what lies between blanks and the control characters 9 to 13;
    null texts have none, as empty ones, and give no runs and an empty text.
    Texts of any length are searched whole: memory grows with the length, time with length times its
    logarithm, in repeated segments alone. Null and repeated ids each keep
    their row; other columns are not read. One narrow pass without a shuffle.
    ``times`` must be 2 at least.
    """
    if times < 2:
        raise ValueError("a run repeats its period at least twice")
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for b in slices(batches):
            found, texts = [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                words = t.split() if t else []  # bytes are split at exactly these six characters
                runs = runs_of(words, least, times)
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                texts.append(collapse(words, runs))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind), pa.array(texts, pa.binary()).cast(pa.string())], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (h % 10 == 0).alias("made"), F.floor(h / 10).alias("g"))
    words = F.expr(r"filter(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), x -> x <> '')")
    made = F.expr("concat(slice(w, 1, a), transform(sequence(a, size(w) - 1), i -> w[a + (i - a) % p]))")
    period = F.expr("cast(1 + floor((size(w) - a) / (3 + g % 8)) as int)")
    tail = docs.filter("made").withColumn("w", words).withColumn("a", F.expr("cast(if(size(w) = 0, 0, g % size(w)) as int)")).withColumn("p", period)
    tail = tail.select("doc_id", F.when(F.size("w") > 0, F.array_join(made, " ")).otherwise(F.lit("")).alias("text"))
    found = find_runs(docs.filter("made is null or not made").select("doc_id", "text").unionByName(tail))
    # greatest exact length / period: compared by products, the earlier run stays at ties
    best = F.expr("aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
