"""Corpus pipeline: toxicity, near-duplicates, benchmark decontamination, mixing, sharding."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from pointgrain.llm.common import removed, shared_folder, table
from pointgrain.llm.decontamination import without_contaminated
from pointgrain.llm.mixing import mixed_rows
from pointgrain.llm.sharding import shard_by_bytes
from pointgrain.llm.simhash import one_of_each
from pointgrain.llm.toxicity import without_toxic

N_SHARDS = 8

# Defined cases of all stages: null and empty texts are no error (mixing takes no words from them, so they leave there);
# very long texts are taken whole; repeated rows are judged alone but for near duplicates, of which one stays; an empty
# table gives no rows; columns of any name pass through.


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go. Defined cases: a text without matches stays; see above."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents that with the smallest doc_id stays. Defined cases: texts without words are one
    group; null ids come last; of equal rows one stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Defined cases: texts without words hold none and stay."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gives whole documents, some repeated, up to its target, in the order of the schedule. Defined cases:
    null is a source; texts without words are not taken."""
    return mixed_rows(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and place in it. Defined cases: null ids come first; equal ids by the row's hash."""
    return shard_by_bytes(docs, N_SHARDS)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The first stage's model and the second's hash are not SQL's to give; tests hold each stage to a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. Each stage but the last is written to the shared folder and reread, and
    goes when the next one is written; the result reads the table before the last, which stays for it."""
    docs, at, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus-{uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            removed(spark, before)
        before = f"{at}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
