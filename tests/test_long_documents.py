"""A document of very many blocks costs no more a block than a short one."""

import time

from pyspark.sql import functions as F

from folioflow.operators import units


def plain_units(lengths, most):
    out, now, total = [], [], 0
    for i, n in enumerate(lengths):
        if now and total + n + len(now) <= most:
            now.append(i)
            total += n
        else:
            now, total = [i], n
            out.append(now)
    return out


def plain_batches(lengths, items, chars):
    out, k, c, b = [], 0, 0, -1
    for n in lengths:
        if 0 < k < items and c + n <= chars:
            k, c = k + 1, c + n
        else:
            b, k, c = b + 1, 1, n
        out.append(b)
    return out


def test_a_document_of_100_000_blocks(spark):
    n, word = 100_000, lambda i: 1 + i * 7919 % 40
    false = F.lit(False)
    rows = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("global_seq"), F.expr("repeat('x', cast(1 + id * 7919 % 40 as int))").alias("text"))
    rows = rows.unionByName(spark.range(5).select(F.lit(2).cast("long").alias("doc_id"), F.col("id").cast("int").alias("global_seq"), F.lit("short").alias("text")))
    lead = F.lit(None).cast("struct<heading:string,letter:string>")
    flags = rows.withColumns({"body": F.lit(True), "breaks": false, "page_index": F.lit(0), "page_w": F.lit(612), "x0": F.lit(50.0), "y0": F.lit(100.0), "caption": false, "heading": false, "ieee_page": false, "roman": false, "lettered": false, "bold": false, "continues": F.lit(True), "drop_cap": lead})
    began = time.time()
    got = {r.unit_index: list(r.indexes) for r in units.translation_units(flags, 120).where("doc_id = 1").collect()}
    want = plain_units([word(i) for i in range(n)], 120)
    assert [got[i] for i in range(len(got))] == want
    texts = flags.select("doc_id", F.col("global_seq").alias("unit_index"), F.array("global_seq").alias("indexes"), "text")
    ids = {r.unit_index: r.batch_id for r in units.translation_batches(texts, 3, 90).where("doc_id = 1").collect()}
    assert [ids[i] for i in range(n)] == plain_batches([word(i) for i in range(n)], 3, 90)
    assert time.time() - began < 120
    assert [r.batch_id for r in units.translation_batches(texts, 1).where("doc_id = 2").orderBy("unit_index").collect()] == [0, 1, 2, 3, 4]
    assert units.translation_batches(texts.limit(0)).collect() == []
