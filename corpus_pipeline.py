"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, BPE.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; ``run`` writes each
stage's result to the shared folder and reads it again for the next. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormlift.llm.bpe import bpe_encode
from stormlift.llm.common import keep, settle, table
from stormlift.llm.decontaminate import without_benchmark
from stormlift.llm.lines import dedup_lines
from stormlift.llm.simhash import without_near_duplicates
from stormlift.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. Learned from the labelled rows outside the held-out part."""
    settle(spark)
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that five documents and more share stay in one of them; texts that change get their new length."""
    settle(spark)
    kept = dedup_lines(docs)
    n_chars = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", F.when(kept[kept.columns[-1]] > 0, n_chars).otherwise(F.col("n_chars"))).select(*(f"`{c}`" for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one row of the smallest id stays; rows without an id stay."""
    settle(spark)
    return without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, in one piece or reordered, go."""
    settle(spark)
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    settle(spark)
    return bpe_encode(docs, with_ids=False)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("bpe", bpe)]

#: The classifier, the fingerprints and the tokens have no SQL; the tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
