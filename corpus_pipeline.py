"""The corpus pipeline: each stage works on all that the stage before it kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import decontamination, jaccard_join, mixing, quality, surrogates
from linkloom.llm.queries import PII_KEY, PII_SETTING
from linkloom.llm.shared import Scratch, release, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained as in op3, gives a score of 0.7 or more. Null and empty texts are scored as
    texts of no bytes; repeated rows get one score and stay or go together; an empty table stays empty."""
    release(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), "crc32(cast(doc_id as string)) % 4 = 2").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at a similarity of 0.8 join: that of the smallest
    doc_id, once. Documents without words are no group and stay, so do all with an id but no text; of rows without an id
    those with the same shingles are a group. Very long texts are compared like all others."""
    release(spark)
    return jaccard_join.keep_one(docs.select(*COLUMNS), words=5, num=80, den=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands. Null and empty texts hold none and stay; repeated rows stay or go
    together; null and empty items are passed over; long texts are searched to their end."""
    release(spark)
    return decontamination.remove_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, entities in their texts replaced; n_chars follows the new text. Null texts stay null with their
    n_chars; repeated rows are rewritten alike. The key is the Spark setting spark.linkloom.pii.key."""
    release(spark)
    out = surrogates.replace_entities(docs.select(*COLUMNS), spark.conf.get(PII_SETTING, PII_KEY))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the number of copies that the mix takes of it, and the words that makes. Null texts and sources
    count as in op6 (size 0; a source of their own); repeated rows are documents of their own."""
    release(spark)
    return mixing.mix_sources(docs.select(*COLUMNS), keep=("source", "lang"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: No stage before the last can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Tables between stages stand in the shared folder until the next is written. Of documents the
    columns in COLUMNS are used; any others are left behind."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs)
            if before is not None:
                scratch.drop(before)
            before = docs
    return docs
