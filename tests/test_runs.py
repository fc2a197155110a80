"""Documents fail alone, and a second run does only what isn't done."""

import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from folioflow.operators.answers import Answers
from folioflow.plans import runs
from folioflow.sources import tables

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def provider_that(folder, fails):
    class Noting:
        def translate(self, texts):
            with open(f"{folder}/{os.getpid()}-{time.monotonic_ns()}.txt", "a") as f:
                f.writelines(t.replace("\n", " ") + "\n" for t in texts)
            if any(x in t for t in texts for x in fails):
                raise RuntimeError("down")
            return [t.upper() for t in texts]

    return Noting


def noted(folder):
    return [x for p in glob.glob(f"{folder}/*.txt") for x in open(p).read().splitlines()]


def some_blocks(spark):
    b = tables.blocks(spark, DATA).where("doc_id < 12")
    text = F.when((F.col("doc_id") == 3) & F.col("text").rlike("[a-z]{3}"), F.concat("text", F.lit(" unlucky"))).otherwise(F.col("text"))
    return b.withColumn("text", text).withColumn("font_size", F.when(F.col("doc_id") == 5, F.lit(None).cast("double")).otherwise(F.col("font_size")))


def test_a_second_run_does_what_failed(spark, tmp_path):
    calls, folder = tmp_path / "calls", f"file://{tmp_path}/out"
    calls.mkdir()
    b = some_blocks(spark)
    all_docs = {r.doc_id for r in b.select("doc_id").distinct().collect()}
    first = runs.run_documents(b, folder, store=Answers(spark, folder, provider_that(calls, ["unlucky"]), name="p", tasks=2, sleep=0.0))
    got = {r.doc_id: (r.status, r.error) for r in first.collect()}
    assert set(got) == all_docs and got[3] == ("failed", "RuntimeError: down") and got[5] == ("failed", "invalid block: font size")
    assert all(s == ("done", None) for d, s in got.items() if d not in (3, 5))
    assert tuple(runs.summary(first).first()) == (len(all_docs) - 2, 2, 1)
    done = {r.doc_id for r in runs.finished_groups(spark, folder).collect()}
    assert done and not done & {3, 5}
    before = noted(calls)
    second = runs.run_documents(b, folder, store=Answers(spark, folder, provider_that(calls, []), name="p", tasks=2))
    assert {r.doc_id: r.status for r in second.collect()} == {3: "done", 5: "failed"}
    lucky = lambda rows: sorted(x for x in rows if "unlucky" not in x)
    assert len(noted(calls)) > len(before) and lucky(noted(calls)) == lucky(before)  # only what failed is asked for again
    third = runs.run_documents(b.where("doc_id <> 5"), folder, store=Answers(spark, folder, provider_that(calls, []), name="p", tasks=2))
    assert third.count() == 0 and tuple(runs.summary(third).first()) == (0, 0, 0)
    changed = b.where("doc_id = 2").withColumn("text", F.concat("text", F.lit(".")))
    assert [r.doc_id for r in runs.run_documents(changed, folder, store=Answers(spark, folder, provider_that(calls, []), name="p", tasks=2)).collect()] == [2]
    assert {r.doc_id for r in runs.ledger(spark, folder).where("status = 'done'").collect()} == all_docs - {5}


def test_groups_without_a_ledger_row_are_not_read(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/out"
    b = tables.blocks(spark, DATA).where("doc_id < 3")
    append = runs.appended

    def breaks(df, path, *parts):
        if path.endswith("/ledger"):
            raise RuntimeError("the driver is lost")
        append(df, path, *parts)

    monkeypatch.setattr(runs, "appended", breaks)
    with pytest.raises(RuntimeError, match="lost"):
        runs.run_documents(b, folder)
    assert runs.finished_groups(spark, folder).count() == 0 and runs.ledger(spark, folder).count() == 0
    monkeypatch.setattr(runs, "appended", append)
    runs.run_documents(b, folder)
    groups = runs.finished_groups(spark, folder)
    assert groups.count() == groups.select("doc_id", "page_index", "group_id").distinct().count() > 0


def test_reasons_of_broken_documents(spark):
    row = {"doc_id": 0, "block_id": 0, "page_index": 0, "x0": 1.0, "y0": 1.0, "x1": 2.0, "y1": 2.0, "text": "a", "font_size": 9.0, "line_count": 1}
    odd = [{}, {"x0": float("nan")}, {"y1": 0.0}, {"x1": float("inf")}, {"text": None}, {"font_size": -1.0}, {"line_count": None}, {"page_index": None}]
    kinds = "doc_id long, block_id int, page_index int, x0 double, y0 double, x1 double, y1 double, text string, font_size double, line_count int"
    rows = [tuple((row | o | {"doc_id": i}).values()) for i, o in enumerate(odd)]
    got = {r.doc_id: r.error for r in runs.broken_documents(spark.createDataFrame(rows, kinds)).collect()}
    assert got == {1: "invalid block: box", 2: "invalid block: box", 3: "invalid block: box", 4: "invalid block: text", 5: "invalid block: font size", 6: "invalid block: line count", 7: "invalid block: place"}


def test_line_heights_are_given_or_the_session_s_or_the_default(spark):
    assert runs.line_height_option(spark) == 1.2 and runs.line_height_option(spark, 1.5) == 1.5
    spark.conf.set(runs.LINE_HEIGHT, "0.9")
    assert runs.line_height_option(spark) == 0.9 and runs.line_height_option(spark, "1.1") == 1.1
    spark.conf.set(runs.LINE_HEIGHT, "9")
    with pytest.raises(ValueError, match="spark.folioflow.lineHeight: "):
        runs.line_height_option(spark)
    with pytest.raises(ValueError, match="not a number"):
        runs.line_height_option(spark, "tall")
    spark.conf.unset(runs.LINE_HEIGHT)
