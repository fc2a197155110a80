"""A store of answers: no text is asked for twice, in one run or in the next.

Answers are rows of a table in a folder, by provider, kind of call (``batch``,
``unit``, ``title``) and SHA-256 of the text.  Texts without an answer are
found by an anti-join, each once however many units share it, and dealt out to
a fixed number of calling tasks.  They go out in waves; a wave's answers are
committed together, so a run that breaks off asks again for the texts of one
wave at most.  Failed calls are rows with an error, which are asked for anew
by the next run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..sources.stored import appended, shared_folder, stored
from . import provider

SCHEMA = "key string, translated string, error string, run string, provider string, kind string"


class Answers:
    """``ask`` answers rows of texts from the store, and from the provider where it has none.

    folder: where the store is, a new one if none is given.  name: what tells providers apart, the class's name by default.
    tasks, threads: calls that go out at once are at most tasks * threads.  waves: commits of one ``ask``.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, make: type | None = None, name: str | None = None, tasks: int = 8, threads: int = 4, waves: int = 1, sleep: float = V.RETRY_SLEEP_SECONDS, deadline: float | None = V.TIMEOUT_SECONDS):
        self.spark, self.path = spark, f"{folder or shared_folder(spark)}/answers"
        self.make = make or provider.named(spark)
        self.name, self.tasks, self.threads, self.waves, self.sleep, self.deadline = name or self.make.__name__, tasks, threads, waves, sleep, deadline
        self.run = uuid.uuid4().hex

    def table(self, kind: str) -> DataFrame:
        """This provider's rows of one kind."""
        return stored(self.spark, self.path, SCHEMA).where((F.col("provider") == self.name) & (F.col("kind") == kind))

    def ask(self, rows: DataFrame, kind: str = "batch") -> DataFrame:
        """(doc_id, unit_index, translated, error) for rows (doc_id, batch_id, unit_index, text).

        A text that a call left out has a null answer and no error.  Null texts are asked for as empty ones; an empty table
        gives no rows and makes no call.  Rows of one text share its answer; Spark splits the join where they are many.
        """
        keyed = rows.select("doc_id", "batch_id", "unit_index", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.sha2("text", 256))
        one = keyed.groupBy("key").agg(F.min_by(F.struct("doc_id", "batch_id", "unit_index", "text"), F.struct("doc_id", "unit_index")).alias("first")).select("key", "first.*")
        for wave in range(self.waves):
            part = one.where(F.pmod(F.xxhash64("key"), F.lit(self.waves)) == wave) if self.waves > 1 else one
            new = part.join(self.table(kind).where("error is null").select("key"), "key", "left_anti")
            got = provider.translate(new, self.make, self.threads, self.tasks, self.sleep, kind, self.deadline)
            appended(got.select("key", "translated", "error", F.lit(self.run).alias("run"), F.lit(self.name).alias("provider"), F.lit(kind).alias("kind")), self.path, "provider", "kind")
        have = self.table(kind).where("error is null or run = " + f"'{self.run}'").groupBy("key").agg(F.max("translated").alias("translated"), F.min("error").alias("failed"))
        found = keyed.join(have, "key", "left")
        return found.select("doc_id", F.col("unit_index").cast("int").alias("unit_index"), "translated", F.when(F.col("translated").isNull(), F.col("failed")).alias("error"))
