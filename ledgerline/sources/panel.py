"""The canonical long relation of scored records, and the panel derived from the star schema.

labels(task, category, key, configuration, cfg_ord, score, kv_bytes, kv_bytes_fp16, compression):
one row per item and configuration. All selections and rollups work on this form;
the wide form is made at a sink only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIGURATIONS = 6
CANDIDATES = "cfg_ord >= 1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (part, line number) group as a record, incomplete items included. Money and shares are summed as integers."""
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 6").select("l_partkey", "l_linenumber", "l_discount", "l_extendedprice", "l_quantity")
    # pre-aggregate before the join: the part side then meets one row per (part, line number)
    sums = lines.groupBy(F.col("l_partkey").alias("key"), (F.col("l_linenumber") - 1).cast("int").alias("cfg_ord")).agg(
        F.count("*").alias("n"), F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("d"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("p"), F.sum(F.col("l_quantity").cast("long")).alias("q")
    )
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_type").alias("category"), F.concat_ws("-", "p_type", (F.col("p_size") % 3).cast("string")).alias("task"))
    score = F.col("d").cast("double") / (10 * F.col("n"))
    ratio = F.when(F.col("cfg_ord") == 0, 1.0).otherwise(1 + (F.col("cfg_ord") * F.col("q")).cast("double") / (25 * F.col("n")))
    rows = sums.join(part, "key").select("task", "category", "key", F.concat(F.lit("C"), F.col("cfg_ord").cast("string")).alias("configuration"), "cfg_ord", score.alias("score"), F.col("p").cast("double").alias("kv_bytes_fp16"), ratio.alias("compression"))
    return rows.withColumn("kv_bytes", F.col("kv_bytes_fp16") / F.col("compression"))


def complete(records: DataFrame, configurations: int = CONFIGURATIONS) -> DataFrame:
    """Items that have every configuration."""
    whole = records.groupBy("key").agg(F.countDistinct("cfg_ord").alias("c")).filter(F.col("c") == configurations).select("key")
    return records.join(whole, "key", "left_semi")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete(all_records(spark, sf_dir))


#: The same in DuckDB: WITH {PANEL_SQL} SELECT ... FROM panel
PANEL_SQL = """records AS (
  SELECT p_type || '-' || CAST(p_size % 3 AS VARCHAR) AS task, p_type AS category, l_partkey AS key, 'C' || CAST(l_linenumber - 1 AS VARCHAR) AS configuration,
    CAST(l_linenumber - 1 AS INTEGER) AS cfg_ord, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / (10 * count(*)) AS score,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS kv_bytes_fp16,
    CASE WHEN l_linenumber = 1 THEN 1.0::DOUBLE ELSE 1 + CAST((l_linenumber - 1) * sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / (25 * count(*)) END AS compression
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <= 6 GROUP BY p_type, p_size, l_partkey, l_linenumber
), panel AS (
  SELECT *, kv_bytes_fp16 / compression AS kv_bytes FROM records WHERE key IN (SELECT key FROM records GROUP BY key HAVING count(*) = 6)
)"""
