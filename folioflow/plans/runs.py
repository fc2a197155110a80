"""Runs over many documents: each fails alone, and a later run does only what isn't done.

A run writes its groups first and its ledger last.  The ledger's append is the
commit: groups of a run that broke off before it belong to no ledger row and
are not read.  A document that a ledger row calls done, with the blocks it has
now, is left out of later runs; all others (failed, new, changed) are done.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import text as T
from ..operators.answers import Answers
from ..sources.stored import appended, stored, written
from . import pipeline

LEDGER = "doc_id long, digest long, blocks long, status string, error string, groups long, nth long, run string"
GROUPS = "doc_id long, page_index int, group_id long, block_seqs array<long>, text string, hidden boolean, mode string, placed struct<x0:double,y0:double,x1:double,y1:double>, size double, line_height double, scale double, run string"


#: Options of the session that a run's parameters leave open.
LINE_HEIGHT = "spark.folioflow.lineHeight"


def line_height_option(spark: SparkSession, given: float | str | None = None) -> float:
    """The line height given, or the session's option, or the default; a ValueError says which of them is out of range."""
    if given is not None:
        return T.parse_line_height(str(given))
    try:
        return T.parse_line_height(spark.conf.get(LINE_HEIGHT, str(V.DEFAULT_LINE_HEIGHT)))
    except ValueError as e:
        raise ValueError(f"{LINE_HEIGHT}: {e}") from e


def document_states(blocks: DataFrame) -> DataFrame:
    """(doc_id, digest, blocks, reason): a checksum of a document's blocks in any order, their number, and why the rules can't read them.

    All of it in one pass over the blocks.  reason is the first by name, null where all blocks can be read.
    """
    own = F.xxhash64(*sorted(blocks.columns))
    return blocks.groupBy("doc_id").agg(F.bit_xor(own).alias("digest"), F.count(F.lit(1)).alias("blocks"), F.min(_unreadable()).alias("reason"))


def _unreadable() -> Column:
    edges = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return (
        F.when(F.col("block_id").isNull() | F.col("page_index").isNull(), "place")
        .when(F.col("text").isNull(), "text")
        .when(odd(edges[0]) | odd(edges[1]) | odd(edges[2]) | odd(edges[3]) | (edges[2] < edges[0]) | (edges[3] < edges[1]), "box")
        .when(odd(F.col("font_size")) | (F.col("font_size") <= 0), "font size")
        .when(F.col("line_count").isNull() | (F.col("line_count") < 0), "line count")
    )


def _broken(states: DataFrame) -> DataFrame:
    return states.where("reason is not null").select("doc_id", F.concat(F.lit("invalid block: "), F.col("reason")).alias("error"))


def broken_documents(blocks: DataFrame) -> DataFrame:
    """(doc_id, error) of documents with a block that the rules can't read: the first reason by name."""
    return _broken(document_states(blocks))


def _latest(ledger: DataFrame) -> DataFrame:
    """Each document's last row."""
    return ledger.withColumn("back", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("nth")))).where("back = 1").drop("back")


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """A row per document that any run came to: status (done or failed), error, blocks, groups, run."""
    return _latest(stored(spark, f"{folder}/ledger", LEDGER))


def run_documents(blocks: DataFrame, folder: str, make: type | None = None, max_items: int = V.MAX_BATCH_ITEMS, store: Answers | None = None, line_height: float | None = None) -> DataFrame:
    """Translate the documents of ``blocks`` that aren't done; gives this run's ledger rows.

    Documents with blocks that no rule can read, failed calls or missing answers fail alone, with a reason.  Answers are kept
    in the folder too, so what failed is done again without asking for what is known.  Runs over one folder follow each other.
    The provider and the line height are the session's options where they aren't given.
    """
    spark, run = blocks.sparkSession, uuid.uuid4().hex
    height = line_height_option(spark, line_height)
    store = store or Answers(spark, folder, make)
    before = stored(spark, f"{folder}/ledger", LEDGER)
    nth = (before.agg(F.max("nth")).first()[0] or 0) + 1
    done = ledger(spark, folder).where("status = 'done'").select("doc_id", F.col("digest").alias("was"))
    todo = written(document_states(blocks).join(done, "doc_id", "left").where("was is null or was <> digest").drop("was"))
    broken = _broken(todo)
    out = pipeline.translate_documents(blocks.join(todo.where("reason is null").select("doc_id"), "doc_id", "left_semi"), store.make, max_items, store, height)
    fit = [F.col(f"fit.{c}").alias(c) for c in ("size", "line_height", "scale")]
    kept = out["groups"].select("doc_id", F.col("page_index").cast("int").alias("page_index"), F.col("group_id").cast("long").alias("group_id"), F.col("block_seqs").cast("array<bigint>").alias("block_seqs"), "text", "hidden", "mode", "placed", *fit, F.lit(run).alias("run"))
    appended(kept, f"{folder}/groups", "run")
    counts = stored(spark, f"{folder}/groups", GROUPS).where(F.col("run") == run).groupBy("doc_id").agg(F.count(F.lit(1)).alias("groups"))
    failed = broken.unionByName(out["failed"])
    rows = todo.join(failed, "doc_id", "left").join(counts, "doc_id", "left")
    rows = rows.select("doc_id", "digest", "blocks", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), "error", F.coalesce("groups", F.lit(0).cast("long")).alias("groups"), F.lit(nth).cast("long").alias("nth"), F.lit(run).alias("run"))
    appended(rows, f"{folder}/ledger")
    return stored(spark, f"{folder}/ledger", LEDGER).where(F.col("run") == run)


def finished_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of the documents that are done, each from the run that did it."""
    return stored(spark, f"{folder}/groups", GROUPS).join(ledger(spark, folder).where("status = 'done'").select("doc_id", "run"), ["doc_id", "run"], "left_semi")


def summary(rows: DataFrame) -> DataFrame:
    """One row: documents done and failed, and whether a command would end well (0) or not (1)."""
    count = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0).cast("long"))
    return rows.agg(count("done").alias("succeeded"), count("failed").alias("failed")).withColumn("exit_code", F.when(F.col("failed") > 0, 1).otherwise(0))
