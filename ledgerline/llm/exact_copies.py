"""Exact copies by progressive refinement, in DataFrame functions only.

Texts are told apart first by length, then by a hash of their beginning, and
only where both occur again by a hash of the whole. What occurs again at one
step is handed to the next as a bitmap of bounded size that every task gets:
a text whose bit is not set has no copy, and is not read to its end. Bits that
texts happen to share only cost further reading; copies are told by whole hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import free, stage, table

#: Bits of one row of a bitmap, and the most bits of a whole one (16 MB).
ROW_BITS, MOST_BITS = 32_768, 1 << 27


def bitmap(keys: DataFrame, *columns: str) -> tuple[DataFrame, int]:
    """Which hashes of ``columns`` occur in ``keys``: rows ``_bucket``, ``_bits`` and the number of bits, eight a key up to ``MOST_BITS``."""
    keys = stage(keys, "copies-keys")
    bits = min(MOST_BITS, max(ROW_BITS, 1 << (8 * keys.count()).bit_length()))
    at = keys.select(F.pmod(F.xxhash64(*columns), F.lit(bits)).alias("at"))
    rows = at.groupBy(F.expr(f"at div {ROW_BITS}").alias("_bucket")).agg(F.bitmap_construct_agg(F.expr(f"at % {ROW_BITS}")).alias("_bits"))
    rows = stage(rows, "copies-bits")
    free(keys.sparkSession, keys)
    return rows, bits


def marked(rows: DataFrame, found: tuple[DataFrame, int], name: str, *columns: str) -> DataFrame:
    """``rows`` with ``name``: whether the bit of their hash of ``columns`` is set. At most 4,096 rows are broadcast."""
    kept, (bitmaps, bits) = rows.columns, found
    placed = rows.withColumn("_at", F.pmod(F.xxhash64(*columns), F.lit(bits))).withColumn("_bucket", F.expr(f"_at div {ROW_BITS}"))
    byte = f"cast(conv(hex(substring(_bits, cast(_at % {ROW_BITS} div 8 as int) + 1, 1)), 16, 10) as int)"
    test = F.expr(f"_bits is not null and (shiftright({byte}, cast(_at % 8 as int)) & 1) = 1")
    return placed.join(F.broadcast(bitmaps), "_bucket", "left").select(*kept, test.alias(name))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None, prefix: int = 256, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``keep_id``, ``group_size``, ``kept`` and the columns of ``carry``.

    Texts are equal if identical after ``normalise`` (by default as they are);
    null is an empty text, so null and empty texts are copies of each other. Of
    equal texts the row with the largest id stays, and ``keep_id`` is its id;
    null ids come before all others, and of rows that share the largest id
    exactly one stays. A text without a copy stays, in a group of one. An empty table gives an empty result;
    other columns are read only if ``carry`` (name to expression) asks for
    them, so their names may clash with anything but the four above.

    ``docs`` is scanned twice: for lengths and hashes of the first ``prefix``
    characters, then for whole hashes of texts where both occur again. No text
    is shuffled or staged. Groups are aggregated before shuffles; those of over
    a thousandth of all rows (under a thousand groups) meet their rows by
    broadcast, so the shuffle join has no hot key.
    """
    spark, carry = docs.sparkSession, carry or {}
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = F.coalesce(normalise(text), F.lit("")) if normalise else text
    begin = F.xxhash64(F.substring(text, 1, prefix))
    keys = stage(docs.select(F.octet_length(text).alias("_len"), begin.alias("_begin")), "copies-begins")
    lengths = bitmap(keys.groupBy("_len").count().filter("count > 1").select("_len"), "_len")
    begins = marked(keys, lengths, "_again", "_len").filter("_again").groupBy("_len", "_begin").count().filter("count > 1")
    found = bitmap(begins.select("_len", "_begin"), "_len", "_begin")
    free(spark, keys)
    free(spark, lengths[0])
    read = docs.select(F.col(id_col).alias("_id"), F.struct(*(c.alias(n) for n, c in carry.items()), F.lit(0).alias("_")).alias("_carry"), text.alias("_text"))
    read = read.withColumn("_len", F.octet_length("_text")).withColumn("_begin", F.xxhash64(F.substring("_text", 1, prefix)))
    hashed = marked(read, found, "_again", "_len", "_begin").select("_id", "_carry", F.when(F.col("_again"), F.sha2("_text", 256)).alias("_whole"), F.monotonically_increasing_id().alias("_row"))
    hashed = stage(hashed, "copies-rows")
    free(spark, found[0])
    groups = hashed.filter("_whole is not null").groupBy("_whole").agg(F.count("*").alias("_n"), F.max(F.struct(F.col("_id"), F.col("_row"))).alias("_keep")).filter("_n > 1")
    groups = stage(groups, "copies-groups")
    most = hashed.count() // 1000
    hot, rest = F.broadcast(groups.filter(F.col("_n") > most)), groups.filter(F.col("_n") <= most)  # under a thousand groups are hot
    again = hashed.filter("_whole is not null")
    single = hashed.filter("_whole is null").select("*", F.lit(None).cast("long").alias("_n"), F.lit(None).cast(groups.schema["_keep"].dataType).alias("_keep")).drop("_whole")
    grouped = [again.join(hot, "_whole").drop("_whole"), again.join(hot, "_whole", "left_anti").join(rest, "_whole", "left").drop("_whole")]
    rows = single.unionByName(grouped[0]).unionByName(grouped[1])
    return rows.select(
        F.col("_id").alias("id"), F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep._id")).alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_row") == F.col("_keep._row"), F.lit(True)).alias("kept"), *(F.col("_carry")[n].alias(n) for n in carry),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; edge cases as in ``copies``."""
    carried = {f"c{i}": F.col(c) for i, c in enumerate(docs.columns)}
    kept = copies(docs, id_col, text_col, normalise, carry=carried).filter("kept")
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op13_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest column is asked of every text, so here each is read whole for it; groups are found as ever."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return copies(table(spark, sf_dir, "documents"), carry={"text_sha256": digest}).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")
