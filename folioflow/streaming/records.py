"""Job records that live: folded from events in batch, kept as keyed state with a time to live in a stream, looked up by id.

An event sets fields as of its number, and the highest number of a field
stays.  ``create`` and ``requeue`` start a record anew: what has a lower number
counts no more.  So the fold doesn't depend on the order of arrival, and the
stream comes to the same records as the batch.  A job without ``create`` has
no record.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: at: seconds since 1970 that records tell; ts: the same as a time, for watermarks.
EVENT = "job_id string, seq long, kind string, payload string, n int, at double, ts timestamp"
#: Fields that an event's kind sets, each with how.
FIELDS = ("pages", "blocks", "units", "batches_total", "batches_completed")
RECORD = "job_id string, filename string, status string, " + ", ".join(f"{f} int" for f in FIELDS) + ", n_logs long, last_log string, error string, translated_path string, created_at double, last_seq long"


def record_events(events: DataFrame) -> DataFrame:
    """The events table read as a job log with creations and requeues: a user is a job, the event's number picks the kind."""
    k = F.pmod(F.col("event_id"), F.lit(11))
    kind = F.when(k == 0, "create").when(k == 1, "start").when(k == 2, "pages").when(k == 3, "blocks").when(k.isin(5, 6), "log").when(k == 8, "done").when(k == 9, "failed").when((k == 10) & (F.pmod(F.col("event_id"), F.lit(3)) == 0), "requeue").otherwise("batch")
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) / 1000000D")
    return events.select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_type").alias("payload"), F.pmod(F.col("event_id"), F.lit(50)).cast("int").alias("n"), at.alias("at"), F.timestamp_micros((at * 1_000_000).cast("long")).alias("ts"))


def _sets(field: str, kind: Column, n: Column) -> Column:
    """What an event makes of a field of the progress; null if it leaves it."""
    return {
        "pages": F.when(kind == "pages", n), "blocks": F.when(kind == "blocks", n), "units": F.when(kind == "blocks", F.floor(n / 2).cast("int")),
        "batches_total": F.when(kind == "blocks", (F.floor(n / 2) + 1).cast("int")), "batches_completed": F.when(kind == "batch", n),
    }[field]


def job_records(log: DataFrame) -> DataFrame:
    """RECORD of every job that was created: two aggregations by job and a join; a job of very many events is pre-aggregated.

    Null job ids are a job of their own.  Events that share a number: the larger value stays.
    """
    starts = log.where("kind in ('create', 'requeue')").groupBy(F.col("job_id").alias("of")).agg(F.max("seq").alias("reset"), F.max_by("payload", F.when(F.col("kind") == "create", F.col("seq"))).alias("filename"), F.max_by(F.struct("kind", "at"), F.struct("seq", "kind")).alias("started"), F.max(F.col("kind") == "create").alias("created"))
    rows = log.join(starts.where("created"), F.col("job_id").eqNullSafe(F.col("of")) & (F.col("seq") >= F.col("reset")))
    later, kind = F.col("seq") > F.col("reset"), F.col("kind")
    last = lambda value: F.max_by(value, F.when(value.isNotNull() & later, F.struct("seq", value)))
    status = F.when(kind == "start", "running").when(kind == "done", "done").when(kind == "failed", "failed")
    text = F.when(kind == "log", F.col("payload"))
    out = rows.groupBy("job_id", "filename", "reset", "started").agg(
        last(status).alias("s"), *(F.coalesce(last(_sets(f, kind, F.col("n"))), F.lit(0)).alias(f) for f in FIELDS), (F.count(F.when(later & (kind == "log"), 1)) + 1).alias("n_logs"),
        last(text).alias("l"), last(F.when(kind == "failed", F.col("payload"))).alias("error"), last(F.when(kind == "done", F.col("payload"))).alias("o"), F.max("seq").alias("last_seq"),
    )
    first = F.when(F.col("started.kind") == "create", F.concat(F.lit("Job initialized: "), F.col("filename"))).otherwise(F.concat(F.lit("Retranslation queued for: "), F.col("filename")))
    return out.select("job_id", "filename", F.coalesce("s", F.lit("queued")).alias("status"), *FIELDS, "n_logs", F.coalesce("l", first).alias("last_log"), "error", F.concat("o", F.lit("_zh-CN.pdf")).alias("translated_path"), F.col("started.at").alias("created_at"), "last_seq")


class JobRecords(StatefulProcessor):
    """State of a job: for each field its value with the number of the event that set it; log lines are a list of their own.

    ttl: seconds of event time after a job's last event until its state is dropped; its last row then says so (live = false).
    """

    def __init__(self, ttl: float):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.handle = handle
        pair = "struct<v:{},seq:bigint>"
        fields = ", ".join(f"{f} {pair.format('int')}" for f in FIELDS)
        self.record = handle.getValueState("record", f"filename {pair.format('string')}, started struct<kind:string,at:double,seq:bigint>, status {pair.format('string')}, {fields}, error {pair.format('string')}, output {pair.format('string')}, created boolean, last_seq bigint, last_ms bigint")
        self.logs = handle.getListState("logs", "seq bigint, text string")

    def _have(self) -> dict:
        if not self.record.exists():
            return dict.fromkeys(("filename", "started", "status", *FIELDS, "error", "output"), None) | {"created": False, "last_seq": -1, "last_ms": 0}
        names = ("filename", "started", "status", *FIELDS, "error", "output", "created", "last_seq", "last_ms")
        return dict(zip(names, self.record.get(), strict=True))

    @staticmethod
    def _put(have: dict, field: str, value, seq: int) -> None:
        old = have[field]
        if value is not None and (old is None or (old[1], old[0]) < (seq, value)):
            have[field] = (value, seq)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        have, logs = self._have(), []
        for r in rows:
            seq, kind, n = r["seq"], r["kind"], r["n"]
            have["last_seq"], have["last_ms"] = max(have["last_seq"], seq), max(have["last_ms"], int(r["at"] * 1000))
            if kind in ("create", "requeue"):
                have["created"] |= kind == "create"
                if kind == "create":
                    self._put(have, "filename", r["payload"], seq)
                if have["started"] is None or (have["started"][2], have["started"][0]) < (seq, kind):
                    have["started"] = (kind, r["at"], seq)
            elif kind in ("start", "done", "failed"):
                self._put(have, "status", {"start": "running"}.get(kind, kind), seq)
                if kind != "start":
                    self._put(have, "output" if kind == "done" else "error", r["payload"], seq)
            elif kind == "pages":
                self._put(have, "pages", n, seq)
            elif kind == "blocks":
                for field, value in (("blocks", n), ("units", n // 2), ("batches_total", n // 2 + 1)):
                    self._put(have, field, value, seq)
            elif kind == "batch":
                self._put(have, "batches_completed", n, seq)
            elif kind == "log":
                logs.append((seq, r["payload"]))
        reset = have["started"][2] if have["started"] else -1
        old = list(self.logs.get()) if self.logs.exists() else []
        if any(x[0] <= reset for x in old):
            self.logs.put([tuple(x) for x in old if x[0] > reset] or [(-1, None)])
            old = [x for x in old if x[0] > reset]
        new = [x for x in logs if x[0] > reset]
        if new:
            self.logs.appendList(new)
        self.record.update(tuple(tuple(v) if isinstance(v, (tuple, list, Row)) else v for v in have.values()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(have["last_ms"] + int(self.ttl * 1000))
        if have["created"]:
            yield self._row(key, have, [tuple(x) for x in old] + new, reset, True)

    def _row(self, key, have: dict, logs: list, reset: int, live: bool) -> Row:
        value = lambda f: have[f][0] if have[f] is not None and have[f][1] > reset else None
        logs = sorted(x for x in logs if x[0] > reset)
        name, kind = have["filename"][0] if have["filename"] else None, have["started"][0]
        first = None if name is None else ("Job initialized: " if kind == "create" else "Retranslation queued for: ") + name
        output = value("output")
        return Row(
            job_id=key[0], filename=name, status=value("status") or "queued", **{f: value(f) or 0 for f in FIELDS}, n_logs=len(logs) + 1, last_log=logs[-1][1] if logs else first, error=value("error"),
            translated_path=None if output is None else f"{output}_zh-CN.pdf", created_at=have["started"][1], last_seq=have["last_seq"], live=live,
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        have = self._have()
        if have["created"]:
            yield self._row(key, have, [tuple(x) for x in self.logs.get()] if self.logs.exists() else [], have["started"][2], False)
        self.record.clear()
        self.logs.clear()

    def close(self) -> None:
        pass


def job_record_stream(log: DataFrame, ttl: float, late: str = "1 hour") -> DataFrame:
    """RECORD and ``live`` after each batch of events (EVENT) for the jobs in it; write it in update mode.

    State is dropped ``ttl`` seconds of event time after a job's last event, so it doesn't grow with all jobs there ever were.
    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    return log.withWatermark("ts", late).groupBy("job_id").transformWithState(statefulProcessor=JobRecords(ttl), outputStructType=f"{RECORD}, live boolean", outputMode="Update", timeMode="EventTime")


def save_jobs(records: DataFrame, table: str, buckets: int = 64) -> None:
    """Write job records as a table dealt out and sorted by id, so that a lookup reads one bucket."""
    records.repartition(buckets, "job_id").write.mode("overwrite").bucketBy(buckets, "job_id").sortBy("job_id").saveAsTable(table)


def find_job(spark: SparkSession, table: str, job_id: str) -> DataFrame:
    """The record of one job; none if there is no such job."""
    return spark.table(table).where(F.col("job_id") == job_id)


def requeue(job: DataFrame, sources: DataFrame, at: float) -> DataFrame:
    """Events that queue jobs (of ``find_job`` or more) anew, if their original file (sources: name) is still there."""
    there = job.join(sources.select(F.col("name").alias("filename")).distinct(), "filename", "left_semi")
    return there.select("job_id", (F.col("last_seq") + 1).alias("seq"), F.lit("requeue").alias("kind"), F.lit(None).cast("string").alias("payload"), F.lit(0).alias("n"), F.lit(float(at)).alias("at"), F.timestamp_seconds(F.lit(at)).alias("ts"))
