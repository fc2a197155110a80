"""A training-corpus pipeline: five stages over ``documents``, each calling one operator of folioflow.llm.

Every stage takes (spark, docs, sf_dir), works on all that the stage before
kept, and returns the columns of ``documents`` (the last: packed pieces).  Rows
without doc_id leave at the second stage; null texts become empty ones at the
third.  Rows that repeat an id stay rows of their own: no stage makes more rows
than it gets but the last, whose rows are pieces.  Other columns are left out.
Very long texts are handled whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import decontaminate, jaccard_join, packing, quality, rlz_dedup
from folioflow.llm.common import discard, load, materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the ranker, learnt from the labels, does not reject."""
    docs = docs.select(*COLUMNS)
    model = quality.learned_model(docs, load(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(F.col("score") >= quality.PREDICT_AT).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that five-word shingles at Jaccard 0.8 link, the document of the smallest id stays."""
    groups = jaccard_join.similar_components(docs, 5, 80)
    return docs.join(groups.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi").select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out words that 50-word passages of a smaller id hold already; documents of which nothing is left go."""
    kept = rlz_dedup.remove_repeats(docs, carry=("lang", "source")).where("n_removed = 0 or n_removed < n_words")
    return kept.select("doc_id", F.col("kept").alias("text"), "carried.lang", "carried.source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontaminate.overlaps(docs, load(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: A learned ranker is not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        if k:  # what the stage before wrote is read no more
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
