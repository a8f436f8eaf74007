"""A corpus pipeline over ``documents``: quality, near duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents`` (and any further ones that come in).
An empty table passes through every stage; texts of any length are used whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import free, stage, table
from ledgerline.llm.mixing import mix
from ledgerline.llm.ngram_join import keep_one
from ledgerline.llm.packing import packed
from ledgerline.llm.quality import fit, keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer rejects go, null and empty texts among them; ids and other columns are not looked at, and repeated rows stay or go together."""
    return keep_good(docs, fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle similarity 0.8 and more stays: that with the smallest id (null: last).

    Rows that share an id but not the text are documents of their own; of rows
    that share both, one stays. Texts without words all stay.
    """
    return keep_one(docs, k=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; sources below their tempered weight begin further epochs until the shares hold.

    A null source is one of its own; repeated rows and null ids each count.
    Further columns are carried whatever their names; an empty table gives an empty one.
    """
    plain = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # names that cannot be those of the mix
    mixed = mix(docs.toDF(*plain.values()), source_col=plain["source"], id_col=plain["doc_id"])
    return mixed.select(*(F.col(p).alias(c) for c, p in plain.items()))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; a null text is packed as an empty one, and each repeated row has pieces of its own."""
    return packed(docs, memo_entries=150_000)  # a smaller memo than alone: workers also hold what earlier stages left


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("source_mix", source_mix), ("packing", packing)]

#: Model fitting, exact similarity of near copies and tokenization are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{name}")
            if before is not None:
                free(spark, before)
            before = docs
    return docs
