"""Queries over whole lines: nothing of a line is left out."""

import json
import os

from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import lines, provider
from folioflow.plans.queries import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def lines_of(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null")
    return docs.selectExpr("doc_id", "posexplode(split(text, '\\n')) as (line_no, line)")


def test_fragments_hold_every_character(spark):
    """A mark of four characters is put into each line; escapes count as the character they stand for."""
    bare = QUERIES["html_fragments"](spark, DATA).selectExpr("doc_id", "line_no", r"""length(regexp_replace(regexp_replace(fragments, '<br>|<span class="[a-z]+">|</span>', ''), '&(amp|lt|gt|quot|#x27);', '_')) as n""")
    both = bare.join(lines_of(spark).selectExpr("doc_id", "line_no", "length(line) as want"), ["doc_id", "line_no"])
    assert both.where("want > 80").count() > 0 and both.where("n <> want + 4").count() == 0


def test_prompts_hold_whole_lines(spark):
    want = {}
    for r in lines_of(spark).collect():
        want.setdefault(r.doc_id, []).append((r.line_no, r.line))
    got = {r.doc_id: [(x["id"], x["text"]) for x in json.loads(r.prompt)] for r in QUERIES["prompt_json"](spark, DATA).collect()}
    assert got == {k: sorted(v) for k, v in want.items()} and any(c in t for v in got.values() for _, t in v for c in "0\"\\é")


def test_responses_hold_what_json_escapes(spark):
    texts = ['say "yes"', "a\tb", "1 + 2 = 3; x_1", "C:/dir é ß 中文。 😀", "nul \x01 bell \x7f", "", "} ] , : {", "```"]
    whole = lines_of(spark).select("doc_id", F.col("line_no").alias("id"), "line")
    fixture = spark.createDataFrame([(-1, i, t) for i, t in enumerate(texts)], "doc_id long, id int, line string")
    rows = whole.unionByName(fixture)
    answers = rows.groupBy("doc_id").agg(F.collect_list(F.struct("id", "line")).alias("a")).collect()
    raw = [(r.doc_id, "```json\n" + json.dumps([{"id": x.id, "text": x.line} for x in r.a]) + "\n```") for r in answers]
    parsed = spark.createDataFrame(raw, "doc_id long, answer string").select("doc_id", F.explode(provider.parse_response(F.col("answer"))).alias("id", "got"))
    both = rows.join(parsed, ["doc_id", "id"], "left")
    assert both.where(~F.col("got").eqNullSafe(T.clean_translation(F.col("line"), entities=False))).count() == 0


def test_the_query_parses_whole_lines(spark):
    got = QUERIES["parse_response"](spark, DATA)
    both = lines_of(spark).withColumnRenamed("line_no", "id").join(got, ["doc_id", "id"], "full")
    assert both.where(~F.col("text").eqNullSafe(T.clean_translation(F.col("line"), entities=False))).count() == 0


def test_raw_blocks_hold_very_long_lines(spark):
    n = 1_000_020
    docs = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.repeat(F.lit("a"), n).alias("text"))
    assert lines.raw_blocks(docs).select(F.length(lines.raw_text(F.col("lines")[0])).alias("n")).first().n == n
