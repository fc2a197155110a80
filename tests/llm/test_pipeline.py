"""The five stages on a small corpus, each against what it should keep."""

import corpus_pipeline
from pyspark.sql import functions as F

from folioflow.llm import common

from .helpers import passage, words


def corpus(spark, path):
    item = passage(900, 30)
    good = [(i, passage(i, 30 + i * 37 % 200), "en", f"s{i % 3}") for i in range(0, 300)]
    junk = [(1000 + i, " $$$ ".join(passage(i, 40).split()) + " ### ###", "en", "s9") for i in range(120)]
    base = passage(500, 150)
    near = [(2000 + i, base.replace(base.split()[i + 5], "edited", 1), None, "s1") for i in range(4)]
    long = passage(600, 70)
    shared = [(3000, passage(601, 40) + " " + long, "en", "s1"), (3001, passage(602, 80) + " " + long + " " + passage(603, 80), "en", None)]
    leak = [(4000, passage(604, 50) + " " + item + " " + passage(605, 20), "en", "s1")]
    rows = good + junk + near + shared + leak
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 1000), 0) for i, *_ in rows if i < 2000], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    rows = corpus(spark, str(tmp_path))
    docs, seen = common.load(spark, str(tmp_path), "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, str(tmp_path)))
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "substring dedup":
            texts = {r.doc_id: r.text for r in docs.collect()}
    clean = set(range(300))
    assert seen["quality classifier"] & set(range(1000, 1120)) == set() and clean <= seen["quality classifier"]
    assert seen["n-gram Jaccard join"] & set(range(2000, 2004)) == {2000} and clean <= seen["n-gram Jaccard join"]
    assert {3000, 3001} <= seen["substring dedup"] and len(words(texts[3001])) == 160 and texts[0] == rows[0][1]
    assert 4000 not in seen["benchmark decontamination"] and clean | {3000, 3001, 2000} == seen["benchmark decontamination"]
    assert seen["packing"] == seen["benchmark decontamination"]


def test_an_empty_corpus_stays_empty(spark, tmp_path):
    corpus(spark, str(tmp_path))
    docs = common.load(spark, str(tmp_path), "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, str(tmp_path)))
        assert docs.count() == 0


def test_repeated_ids_nulls_long_texts_and_clashing_names(spark, tmp_path):
    rows = corpus(spark, str(tmp_path))
    docs = common.load(spark, str(tmp_path), "documents")
    long = passage(700, 250_000)
    odd = [(5000, passage(701, 60)), (5000, passage(702, 60)), (5000, passage(702, 60)), (5001, passage(701, 60) + " " + passage(703, 60)), (5002, long), (5003, passage(704, 40) + " " + long[: len(long) // 2]), (5004, None), (5005, ""), (None, passage(705, 60))]
    more = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("doc_id", "text", "cast(null as string) as lang", "cast(null as string) as source", "cast(null as long) as n_chars")
    docs = docs.unionByName(more).selectExpr("*", "1 as kept", "2 as score", "3 as label", "4 as n_words", "5 as carried", "6 as seeds", "7 as component_id")
    n, last = docs.count(), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, str(tmp_path)))
        assert docs.columns == corpus_pipeline.COLUMNS and docs.count() <= n, name
        n, last = docs.count(), name
        if name == "n-gram Jaccard join":
            here = [r.doc_id for r in docs.select("doc_id").collect()]
        if name == "substring dedup":
            got = docs.collect()
            # each row is judged by smaller ids alone, and stays one row
            assert sorted(r.doc_id for r in got if r.doc_id == 5000) == [x for x in sorted(i for i in here if i is not None) if x == 5000]
            assert {r.doc_id for r in got} >= set(range(300)) and None not in {r.doc_id for r in got}
            whole = {r.doc_id: r for r in got}
            assert whole[5002].text == long and whole[5002].n_chars == len(long)
            assert len(words(whole[5003].text)) < 100 and whole[5003].lang is None
            assert whole[0].lang == "en" and whole[0].source == "s0" and whole[0].text == rows[0][1]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert last == "benchmark decontamination" and {r.doc_id for r in packed} == {r.doc_id for r in docs.select("doc_id").collect()}
