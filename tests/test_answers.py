"""The store of answers: what is asked for, how often, and what a failed second call comes to."""

import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from folioflow.operators import answers, provider
from folioflow.plans import pipeline

from .test_pipeline_rules import FLAGS


def counting(folder, fail=""):
    """A provider that notes every text it is asked for in a file, and fails on texts that hold ``fail``."""

    class Counting:
        def _note(self, kind, texts):
            with open(f"{folder}/{os.getpid()}-{time.monotonic_ns()}.txt", "a") as f:
                f.writelines(f"{kind}\t{t}\n" for t in texts)
            if fail and any(fail in t for t in texts):
                raise RuntimeError("down")

        def translate(self, texts):
            self._note("batch", texts)
            return [t.upper() for t in texts]

        def translate_title(self, texts):
            self._note("title", texts)
            return ["标题" for t in texts]

    return Counting


def asked(folder):
    return sorted(x for p in glob.glob(f"{folder}/*.txt") for x in open(p).read().splitlines())


ROWS = [(1, 0, 0, "a"), (1, 1, 1, "b"), (2, 0, 0, "a"), (2, 1, 1, "c"), (3, 0, 0, None), (3, 1, 1, "")]
KINDS = "doc_id long, batch_id int, unit_index int, text string"


def test_each_text_is_asked_for_once_in_two_runs(spark, tmp_path):
    calls, folder = tmp_path / "calls", f"file://{tmp_path}/store"
    calls.mkdir()
    rows = spark.createDataFrame(ROWS, KINDS)
    for _ in range(2):
        got = answers.Answers(spark, folder, counting(calls), tasks=2).ask(rows).collect()
        assert sorted(map(tuple, got)) == [(1, 0, "A", None), (1, 1, "B", None), (2, 0, "A", None), (2, 1, "C", None), (3, 0, "", None), (3, 1, "", None)]
        assert asked(calls) == ["batch\t", "batch\ta", "batch\tb", "batch\tc"]
    answers.Answers(spark, folder, counting(calls), tasks=2).ask(rows, "title").collect()
    assert len(asked(calls)) == 8  # another kind of call has answers of its own
    answers.Answers(spark, folder, counting(calls), name="other", tasks=2).ask(rows).collect()
    assert len(asked(calls)) == 12


def test_a_failed_text_is_asked_for_again_and_others_are_not(spark, tmp_path):
    calls, folder = tmp_path / "calls", f"file://{tmp_path}/store"
    calls.mkdir()
    rows = spark.createDataFrame(ROWS, KINDS)
    got = answers.Answers(spark, folder, counting(calls, "c"), name="p", tasks=2, sleep=0.0)
    assert sorted((r.doc_id, r.unit_index, r.translated, r.error) for r in got.ask(rows).collect() if r.doc_id == 2) == [(2, 0, "A", None), (2, 1, None, "RuntimeError: down")]
    assert asked(calls).count("batch\tc") == 3
    second = answers.Answers(spark, folder, counting(calls), name="p", tasks=2)
    assert sorted((r.doc_id, r.unit_index, r.translated, r.error) for r in second.ask(rows).collect() if r.doc_id == 2) == [(2, 0, "A", None), (2, 1, "C", None)]
    assert asked(calls).count("batch\tc") == 4 and asked(calls).count("batch\ta") == 1


def test_a_run_that_breaks_off_keeps_its_finished_waves(spark, tmp_path):
    calls, folder = tmp_path / "calls", f"file://{tmp_path}/store"
    calls.mkdir()
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.lit(0).alias("batch_id"), F.lit(0).alias("unit_index"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    wave = {r.text: r.w for r in rows.select("text", F.pmod(F.xxhash64(F.sha2("text", 256)), F.lit(4)).alias("w")).collect()}
    victim = next(t for t, w in wave.items() if w == 2)
    good = counting(calls)

    class Dying(good):
        def translate(self, texts):
            if victim in texts:
                os._exit(1)  # as an executor that is lost in the middle of a stage
            return super().translate(texts)

    with pytest.raises(Exception):  # noqa: B017
        answers.Answers(spark, folder, Dying, name="p", tasks=2, waves=4).ask(rows)
    kept = {t for t, w in wave.items() if w < 2}
    before = asked(calls)
    assert {x.split("\t")[1] for x in before} >= kept
    got = answers.Answers(spark, folder, good, name="p", tasks=2, waves=4).ask(rows).collect()
    assert len(got) == 40 and all(r.translated for r in got)
    after = asked(calls)
    assert all(after.count(f"batch\t{t}") == 1 for t in kept)
    assert all(after.count(f"batch\t{t}") == 1 for t, w in wave.items() if w == 3)


def test_a_call_past_its_deadline_fails():
    slow = lambda texts: time.sleep(2) or texts
    with pytest.raises(TimeoutError, match=r"0\.1 seconds"):
        provider.with_retries(slow, ["a"], attempts=2, sleep=0.0, deadline=0.1)
    assert provider.with_retries(lambda texts: texts, ["a"], deadline=5) == ["a"]


def test_providers_are_named_by_option(spark):
    assert provider.named(spark) is provider.OfflineTranslator and provider.named(spark, "OFFLINE ") is provider.OfflineTranslator
    assert provider.named(spark, "folioflow.operators.provider:OfflineTranslator") is provider.OfflineTranslator
    with pytest.raises(ValueError, match="nowhere"):
        provider.named(spark, "nowhere")


def unit_rows(spark, rows):
    flags, parts = [], []
    for i, (doc, text, on) in enumerate(rows):
        flags.append((doc, i, text, *(k in on for k in ("heading", "leading_bold", "ieee_page", "roman", "lettered", "title", "conference_header")), 0))
        parts.append((doc, i, [i], text))
    return spark.createDataFrame(parts, "doc_id long, unit_index int, indexes array<long>, text string"), spark.createDataFrame(flags, FLAGS)


def test_titles_have_a_call_of_their_own_and_failed_second_calls_fail_the_document(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    plain = "one two three four five six seven"
    u, f = unit_rows(spark, [(1, "A fine title", ("title", "ieee_page")), (2, plain, ()), (3, plain + " eight broken", ()), (4, "fine", ())])
    got = spark.createDataFrame([(1, 0, "一。二。三。"), (2, 1, "无"), (3, 2, plain), (4, 3, "好")], "doc_id long, unit_index int, translated string")
    store = answers.Answers(spark, f"file://{tmp_path}/store", counting(calls, "broken"), tasks=2, sleep=0.0)
    final = pipeline.translated_units(u, f, got, store=store)
    out = {r.doc_id: (r.final, r.error) for r in final.collect()}
    assert out[1] == ("标题", None) and out[4] == ("好", None) and out[2][1] is None
    assert out[3][1] == "RuntimeError: down"
    assert [x for x in asked(calls) if x.startswith("title")] == ["title\tA fine title"]
    assert not any("fine\n" in x or x == "batch\tA fine title" for x in asked(calls))
    failed = pipeline.failed_documents(u, got.withColumn("error", F.lit(None).cast("string")), final)
    assert [tuple(r) for r in failed.collect()] == [(3, "RuntimeError: down")]


def test_responses_become_rows_with_entities_decoded(spark):
    texts = ['```json\n{"translations":[{"id":1,"text":"a &lt; b &amp; c"},{"id":2,"text":"<sub>x</sub>y"},{"id":1,"text":"last &quot;one&quot;"}]}\n```', '[{"id":7,"text":"plain"}]', "no json", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, response string")
    assert sorted(map(tuple, provider.response_rows(rows, "response").collect())) == [(0, 1, 'last "one"'), (0, 2, "xy"), (1, 7, "plain")]
