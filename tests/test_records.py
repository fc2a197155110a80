"""Job records: the stream comes to what the batch does, in any order of arrival; state expires; lookups read one bucket."""

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.sources import tables
from folioflow.streaming import records

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
T0 = 1_700_000_000.0


@pytest.fixture
def rocks(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(PROVIDER)


def log(spark, rows):
    made = spark.createDataFrame([(j, s, k, p, n, T0 + 60.0 * m) for j, s, k, p, n, m in rows], records.EVENT.removesuffix(", ts timestamp"))
    return made.withColumn("ts", F.timestamp_seconds("at"))


def streamed(spark, folder, ttl=1e9, late="10000 days"):
    """Last row of each job after the stream has read the folder's files one by one."""
    source = spark.readStream.schema(records.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    seen = []

    def keep(df, batch):
        seen.extend((batch, r) for r in df.collect())

    q = records.job_record_stream(source, ttl, late).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return seen


LIFE = [
    ("a", 1, "create", "a.pdf", 0, 0), ("a", 2, "start", None, 0, 1), ("a", 3, "pages", None, 7, 2), ("a", 4, "blocks", None, 11, 3), ("a", 5, "log", "hello", 0, 4), ("a", 6, "batch", None, 3, 5), ("a", 7, "done", "a", 0, 6),
    ("a", 8, "requeue", None, 0, 60), ("a", 9, "start", None, 0, 61), ("a", 10, "failed", "down", 0, 62), ("b", 1, "start", None, 0, 0), ("b", 2, "log", "lost", 0, 1), ("c", 4, "log", "before", 0, 0), ("c", 5, "create", "c.pdf", 0, 1),
]


def test_records_of_literal_logs(spark):
    upto = lambda n: {r.job_id: r for r in records.job_records(log(spark, LIFE[:n])).collect()}
    a = upto(7)["a"]
    assert (a.filename, a.status, a.pages, a.blocks, a.units, a.batches_total, a.batches_completed, a.n_logs, a.last_log, a.error, a.translated_path) == ("a.pdf", "done", 7, 11, 5, 6, 3, 2, "hello", None, "a_zh-CN.pdf")
    a = upto(8)["a"]
    assert (a.status, a.pages, a.batches_total, a.n_logs, a.last_log, a.translated_path, a.error) == ("queued", 0, 0, 1, "Retranslation queued for: a.pdf", None, None)
    got = upto(len(LIFE))
    assert set(got) == {"a", "c"} and (got["a"].status, got["a"].error) == ("failed", "down") and (got["c"].status, got["c"].n_logs, got["c"].last_log) == ("queued", 1, "Job initialized: c.pdf")
    assert records.job_records(log(spark, LIFE).limit(0)).collect() == []


@pytest.mark.parametrize("order", ["seq", "rand"])
def test_the_stream_comes_to_the_batch(rocks, tmp_path, order):
    spark = rocks
    events = records.record_events(tables.table(spark, DATA, "events")).where("cast(job_id as int) < 60")
    part = F.ntile(4).over(Window.orderBy("seq" if order == "seq" else F.xxhash64("seq")))
    dealt = events.withColumn("part", part).collect()
    for k in range(1, 5):
        spark.createDataFrame([tuple(r)[:-1] for r in dealt if r.part == k], events.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    last = {}
    for _, r in streamed(spark, str(tmp_path)):
        last[r.job_id] = tuple(r)[:-1]
    want = {r.job_id: tuple(r) for r in records.job_records(events).collect()}
    assert last == want and len(want) > 10


def test_state_expires_after_its_time(rocks, tmp_path):
    spark = rocks
    for rows in ([LIFE[0], LIFE[1]], [("z", 1, "create", "z.pdf", 0, 600)], [("z", 2, "start", None, 0, 601)], [("a", 11, "log", "late", 0, 602)]):
        log(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = streamed(spark, str(tmp_path), ttl=3600, late="0 seconds")
    a = [(b, r.live, r.status) for b, r in seen if r.job_id == "a"]
    assert (True, "running") in [x[1:] for x in a] and a[-1][1:] == (False, "running")
    assert [r.live for _, r in seen if r.job_id == "z"] == [True, True]  # a's later log line finds no record any more


def test_lookups_read_one_bucket(spark, capsys):
    jobs = records.job_records(log(spark, LIFE))
    spark.sql("drop table if exists job_rows")
    records.save_jobs(jobs, "job_rows", 8)
    found = records.find_job(spark, "job_rows", "a")
    assert [r.status for r in found.collect()] == ["failed"] and records.find_job(spark, "job_rows", "nobody").collect() == []
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan prunes as well but doesn't say so
    capsys.readouterr()
    records.find_job(spark, "job_rows", "a").explain("formatted")
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 8" in capsys.readouterr().out
    sources = spark.createDataFrame([("a.pdf",)], "name string")
    again = records.requeue(found, sources, T0)
    both = records.job_records(log(spark, LIFE).unionByName(again))
    assert {r.job_id: r.status for r in both.collect()} == {"a": "queued", "c": "queued"}
    assert records.requeue(found, sources.limit(0), T0).collect() == []
    spark.sql("drop table job_rows")
