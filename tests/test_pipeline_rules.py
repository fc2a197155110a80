"""The translation plan's rules on literal rows."""

import os

from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import units
from folioflow.plans import pipeline
from folioflow.sources import tables

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


class Upper:
    """Answers in capitals; a text that asks for it fails, or is left out with all behind it."""

    def translate(self, texts):
        if any("please fail" in t for t in texts):
            raise RuntimeError("down")
        return [t.upper() for t in texts if "left out" not in t]


FLAGS = "doc_id long, global_seq long, text string, heading boolean, leading_bold boolean, ieee_page boolean, roman boolean, lettered boolean, title boolean, conference_header boolean, page_index int"


def finals(spark, rows, answers):
    """rows: (unit's text, blocks of it, flags that hold for the first)."""
    flags, parts, seq = [], [], 0
    for i, (text, n, on) in enumerate(rows):
        flags += [(1, seq + j, text, *(k in on for k in ("heading", "leading_bold", "ieee_page", "roman", "lettered", "title", "conference_header")), 0) for j in range(n)]
        parts.append((1, i, list(range(seq, seq + n)), text))
        seq += n
    unit_rows = spark.createDataFrame(parts, "doc_id long, unit_index int, indexes array<long>, text string")
    got = spark.createDataFrame([(1, i, a) for i, a in enumerate(answers)], "doc_id long, unit_index int, translated string")
    return [r.final for r in pipeline.translated_units(unit_rows, spark.createDataFrame(flags, FLAGS), got, Upper).orderBy("unit_index").collect()]


def test_glossaries_are_for_single_blocks(spark):
    got = finals(spark, [("such that:", 1, ()), ("such that:", 2, ()), ("Related Work", 1, ("heading",)), ("II. RESULTS", 1, ("ieee_page", "roman"))], ["甲", "乙", "丙", "丁"])
    assert got[0] == "使得：" and got[1] == "乙" and got[2] == "相关工作" and got[3].startswith("II. ")


def test_answers_are_cleaned_and_doubtful_ones_asked_again(spark):
    plain = "one two three four five six seven"
    got = finals(spark, [("a b", 1, ()), (plain, 1, ()), ("The GNN model", 1, ())], ["x &amp; <sub>y</sub>", plain, "无"])
    assert got[0] == "x & y"
    assert got[1] == plain  # capitals are no better
    assert got[2] == "THE GNN MODEL"  # the first answer lost the term


def test_titles_are_asked_again(spark):
    got = finals(spark, [("A title", 1, ("title", "ieee_page")), ("A title", 1, ("title",))], ["一。二。三。", "一。二。三。"])
    assert got == ["A TITLE", "一。二。三。"]


def test_drop_caps_split_behind_their_heading(spark):
    cap = "I. INTRODUCTION T"
    lead = spark.range(1).select(T.drop_cap(F.lit(cap)).alias("d")).first().d
    assert lead is not None
    box = (100.0, 20.0, 10.0, 0)
    rows = [(1, 0, cap, *box, 50.0, 100.0, True, False), (1, 1, "HE next words", *box, 52.0, 110.0, True, False), (1, 2, "go on", *box, 52.0, 140.0, True, False), (1, 3, "such that:", *box, 52.0, 170.0, True, False)]
    flags = spark.createDataFrame(rows, "doc_id long, global_seq long, text string, w double, h double, font_size double, page_index int, x0 double, y0 double, ieee_page boolean, conference_header boolean").withColumn("drop_cap", T.drop_cap(F.col("text")))
    unit = spark.createDataFrame([(1, 0, [0, 1, 2], "I. 引言：甲乙丙丁戊己，庚辛")], "doc_id long, unit_index int, indexes array<long>, final string")
    got = [r.translated for r in pipeline.translated_blocks(flags, unit).orderBy("global_seq").collect()]
    assert got[0] == "I. 引言" and got[1] + got[2] == "甲乙丙丁戊己，庚辛" and got[1] and got[3] == "使得："


def test_a_document_fails_as_a_whole(spark):
    b = tables.blocks(spark, DATA)
    body = pipeline.translate_documents(b, Upper)["units"].orderBy("doc_id", "unit_index").limit(40).collect()
    bad, short = body[0].doc_id, next(r.doc_id for r in body if r.doc_id != body[0].doc_id)
    mark = F.when(F.col("doc_id") == bad, F.concat("text", F.lit(" please fail"))).when(F.col("doc_id") == short, F.concat("text", F.lit(" left out"))).otherwise(F.col("text"))
    out = pipeline.translate_documents(b.withColumn("text", mark), Upper)
    failed = {r.doc_id: r.error for r in out["failed"].collect()}
    assert set(failed) == {bad, short} and failed[bad] == "RuntimeError: down" and failed[short].startswith("missing ids: 0")
    kept = {r.doc_id for r in out["blocks"].select("doc_id").distinct().collect()}
    assert not kept & set(failed) and len(kept) > 100


def test_a_split_holds_the_whole_text(spark):
    text = "一二三四五六七。八九十，甲乙 丙丁戊己 word-a word_b 庚辛"
    box = "named_struct('w', 100D, 'h', 12D, 'font_size', 10D)"
    for n in (1, 2, 5, 30):
        got = spark.range(1).select(units.split_translation(F.lit(text), F.expr(f"array_repeat({box}, {n})")).alias("p")).first().p
        assert len(got) == n and "".join(got).replace(" ", "") == text.replace(" ", "")
