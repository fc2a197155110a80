"""Translation jobs: state folded from events, in batch or as a stream, snapshots of changes, uploads and restored files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.ranks import ranked

PROGRESS = ("pages", "blocks", "units", "batches_total", "batches_completed")
EVENT = "job_id string, seq bigint, kind string, payload string, ts timestamp"


def job_events(events: DataFrame) -> DataFrame:
    """The events table read as a job log: a user is a job, the event type picks the kind, and the value is the payload."""
    n = F.pmod(F.col("event_id"), F.lit(7))
    kind = F.when(n == 0, "start").when(n == 1, "pages").when(n == 2, "blocks").when(n == 3, "log").when(n == 6, F.when(F.pmod(F.col("event_id"), F.lit(5)) == 0, "failed").otherwise("done")).otherwise("batch")
    return events.select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_type").alias("payload"), F.pmod(F.col("event_id"), F.lit(50)).cast("int").alias("n"), "ts")


def _last(value: Column, when: Column) -> Column:
    return F.max_by(F.when(when, value), F.when(when, F.col("seq")))


def job_state(log: DataFrame) -> DataFrame:
    """Status and progress by the last writer, number of log lines, last error: one aggregation, no window."""
    k = F.col("kind")
    status = F.when(k == "start", "running").when(k == "done", "done").when(k == "failed", "failed")
    return log.groupBy("job_id").agg(
        F.coalesce(_last(status, status.isNotNull()), F.lit("queued")).alias("status"), F.coalesce(_last(F.col("n"), k == "pages"), F.lit(0)).alias("pages"),
        F.coalesce(_last(F.col("n"), k == "blocks"), F.lit(0)).alias("blocks"), F.coalesce(_last(F.col("n"), k == "batch"), F.lit(0)).alias("batches_completed"),
        F.sum((k == "log").cast("int")).alias("n_logs"), _last(F.col("payload"), k == "failed").alias("error"), F.max("seq").alias("last_seq"),
    )


def job_state_stream(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """The same state over a folder of event files that grows; write it in update or complete mode."""
    return job_state(job_events(spark.readStream.schema(schema or spark.read.parquet(folder).schema).parquet(folder)))


def job_changes(log: DataFrame) -> DataFrame:
    """Events after which a client would be sent a snapshot: the first, a new log line, another status or batch count.

    Nothing is sent after a job first ends.
    """
    by_job = Window.partitionBy("job_id").orderBy("seq")
    k = F.col("kind")
    status = F.when(k == "start", "running").when(k == "done", "done").when(k == "failed", "failed")
    upto = by_job.rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumns({"status": F.coalesce(F.last(status, True).over(upto), F.lit("queued")), "batches": F.coalesce(F.last(F.when(k == "batch", F.col("n")), True).over(upto), F.lit(0)), "logs": F.sum((k == "log").cast("int")).over(upto)})
    rows = rows.withColumn("prev", F.lag(F.struct("status", "batches", "logs")).over(by_job)).withColumn("ended", F.coalesce(F.max(k.isin("done", "failed")).over(by_job.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    new = F.col("prev").isNull() | (F.col("prev.status") != F.col("status")) | (F.col("prev.batches") != F.col("batches")) | (F.col("prev.logs") != F.col("logs"))
    return rows.where(new & ~F.col("ended")).select("job_id", "seq", "status", F.col("batches").alias("batches_completed"), F.col("logs").cast("int").alias("n_logs"))


def sse_frame(row: Column) -> Column:
    return F.concat(F.lit("data: "), F.to_json(row), F.lit("\n\n"))


def duplicate_sources(files: DataFrame, content: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, digest, first): each file's SHA-256 and the first file of the same content."""
    digest = files.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("digest"))
    first = digest.groupBy("digest").agg(F.min(key).alias("first"))
    return digest.join(first, "digest").select(key, "digest", "first")


def merge_jobs(current: DataFrame, incoming: DataFrame, key: str = "job_id") -> DataFrame:
    """Upsert: of rows that share a key the incoming one stays."""
    both = current.withColumn("src", F.lit(0)).unionByName(incoming.withColumn("src", F.lit(1)))
    return both.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("src")))).where("r = 1").drop("r", "src")


def new_uploads(uploads: DataFrame, sources: DataFrame, jobs: DataFrame, outputs: DataFrame) -> DataFrame:
    """What becomes of each upload (name, digest): an existing job, a finished one, one queued anew, or a new file.

    sources: name, digest; jobs: filename, job_id; outputs: filename of originals that have an output.
    """
    known = sources.groupBy("digest").agg(F.min("name").alias("source"))
    out = uploads.join(known, "digest", "left")
    out = out.join(jobs.groupBy(F.col("filename").alias("source")).agg(F.min("job_id").alias("job_id")), "source", "left")
    out = out.join(outputs.select(F.col("filename").alias("source"), F.lit(True).alias("has_output")).distinct(), "source", "left")
    action = F.when(F.col("source").isNull(), "save").when(F.col("job_id").isNotNull(), "existing").when(F.col("has_output"), "done").otherwise("queued")
    return out.select("name", "digest", "source", "job_id", action.alias("action"))


_NUMBERED = r"^(.*)_([1-9]\d*)(\.[^.]*)?$"


def _in_turn(pdf: pd.DataFrame) -> pd.DataFrame:
    """Free names for uploads whose names differ but may get in each other's way, one after another."""
    used, names = set(pdf["in_use"].iloc[0]), []
    for name in pdf.sort_values("seq")["name"]:
        free, n = name, 0
        stem, dot, end = name.rpartition(".") if name.rfind(".") > 0 else (name, "", "")
        while free in used:
            n += 1
            free = f"{stem}_{n}{dot}{end}"
        used.add(free)
        names.append(free)
    return pdf.sort_values("seq")[["seq", "name"]].assign(free_name=names)


def numbered_names(uploads: DataFrame, taken: DataFrame) -> DataFrame:
    """Free names (seq, name, free_name) for uploads whose names can't get in each other's way; a name of very many is spread.

    The r-th upload of a name takes the r-th number that is not in use (0: the name itself).  A number n in use that has i such
    numbers before it leaves n - i free ones below; so with uploads at their rank and numbers in use at n - i, uploads behind,
    an upload's place in one order is the number it takes: ranks twice, and neither a list of numbers nor a range join.
    """
    own = taken.select("name", F.lit(1).alias("own")).distinct()
    rows = ranked(uploads.select("seq", "name"), ["name"], ["seq"], "r").join(own, "name", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    numbers = taken.select(F.regexp_replace("name", _NUMBERED, "$1$3").alias("name"), F.regexp_extract("name", _NUMBERED, 2).try_cast("bigint").alias("n")).where("n is not null").distinct()
    numbers = numbers.join(uploads.select("name").distinct(), "name", "left_semi")
    used = ranked(numbers, ["name"], ["n"], "i").select("name", (F.col("n") - F.col("i")).alias("pos"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("own"), F.lit(None).cast(uploads.schema["seq"].dataType).alias("seq"))
    both = rows.select("name", (F.col("r") + F.col("own")).alias("pos"), F.lit(1).alias("kind"), "own", "seq").unionByName(used)
    free = ranked(both, ["name"], ["pos", "kind"], "free").where("kind = 1").withColumn("free", F.col("free") + F.col("own"))
    stem, suffix = F.regexp_replace("name", r"(?<=.)\.[^.]*$", ""), F.regexp_extract("name", r"(?<=.)(\.[^.]*)$", 1)
    return free.select("seq", "name", F.when(F.col("free") == 0, F.col("name")).otherwise(F.concat(stem, F.lit("_"), F.col("free").cast("string"), suffix)).alias("free_name"))


def safe_names(uploads: DataFrame, taken: DataFrame) -> DataFrame:
    """A free name for each upload (seq, name) in the order of seq: its own if it is free, else the first free ``stem_n``.

    taken: name.  Uploads of one name are numbered by rank, however many they are.  Names that differ by trailing numbers
    alone (``q.pdf``, ``q_1.pdf``) may get in each other's way; such a family is settled in turn, in one task.
    """
    family = F.regexp_replace("name", r"(?:_\d+)+(\.[^.]*)?$", "$1")
    uploads, taken = uploads.withColumn("family", family), taken.select("name").distinct().withColumn("family", family)
    kinds = uploads.groupBy("family").agg((F.min("name") != F.max("name")).alias("mixed"))
    rows = uploads.join(kinds, "family")
    alone = numbered_names(rows.where("not mixed"), taken)
    mixed = rows.where("mixed").join(taken.groupBy("family").agg(F.collect_list("name").alias("in_use")), "family", "left").withColumn("in_use", F.coalesce("in_use", F.array().cast("array<string>")))
    schema = uploads.select("seq", "name", F.col("name").alias("free_name")).schema
    return alone.unionByName(mixed.groupBy("family").applyInPandas(_in_turn, schema))


def name_uuid(name: Column) -> Column:
    """The version 5 UUID of a name in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), name.cast("binary")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    part = lambda at, n: F.substring(h, at, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def restore_jobs(outputs: DataFrame, originals: DataFrame, jobs: DataFrame) -> DataFrame:
    """Finished jobs for outputs (name, modified) whose original (name) exists and that no job (filename) knows."""
    named = outputs.where(F.col("name").endswith("_zh-CN.pdf")).withColumn("filename", F.concat(F.regexp_replace("name", r"_zh-CN\.pdf$", ""), F.lit(".pdf")))
    found = named.join(originals.select(F.col("name").alias("filename")).distinct(), "filename", "left_semi").join(jobs.select("filename").distinct(), "filename", "left_anti")
    return found.select(name_uuid(F.concat_ws(":", "filename", "name")).alias("job_id"), "filename", F.col("name").alias("translated_path"), F.lit("done").alias("status"), F.lit(1).alias("batches_completed"), F.lit(1).alias("batches_total"), F.col("modified").alias("created_at"))


def shown_requests(log: DataFrame) -> DataFrame:
    """An access log (method, path, status) without partial reads of job files."""
    part = (F.col("method") == "GET") & (F.col("status") == 206) & (F.col("path").startswith("/api/files/original/") | F.col("path").startswith("/api/files/translated/"))
    return log.where(~F.coalesce(part, F.lit(False)))


def safe_path(path: Column) -> Column:
    """A decoded file name, or null where it would leave its folder."""
    name = F.try_url_decode(path)
    return F.when(~name.rlike(r"[/\\]") & ~name.isin("", ".", ".."), name)


def listing(jobs: DataFrame) -> DataFrame:
    """Jobs, newest first, with the labels a viewer shows."""
    return jobs.withColumn("label", T.status_label(F.col("status"))).withColumn("percent", T.progress_percent(F.col("status"), F.col("batches_completed"), F.col("batches_total"))).orderBy(F.desc("created_at"), "job_id")
