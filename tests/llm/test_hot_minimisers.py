"""Strings that many texts hold in different surroundings."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.llm import suffix_dedup

from .helpers import frame, passage
from .test_dedup import brute_bytes


def texts(n_common):
    """Each text holds a common string; some share a passage across it, which is 400 bytes or more or just less."""
    r, common = random.Random(n_common), passage(1, 200)[:n_common]
    docs = [(i, passage(100 + i, 70) + common + passage(500 + i, 70)) for i in range(60)]
    for i in range(60, 90, 2):
        left, right = r.randint(0, 400 - n_common), r.randint(0, 420 - n_common)
        shared = passage(900 + i, 90)[-left - 1 :] + common + passage(1900 + i, 90)[:right]
        docs += [(j, passage(3000 + j, 30) + "|" + shared + "|" + passage(4000 + j, 30)) for j in (i, i + 1)]
    return [*docs, (200, common), (201, "ab" * 300), (202, "ab" * 300 + common)]


@pytest.mark.parametrize("n_common", [60, 300, 396])
def test_hot_minimisers_match_brute_force(spark, n_common):
    docs = texts(n_common)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame(spark, docs), shard=2000).collect()}
    assert got == brute_bytes(docs, 400)
    assert any(x[1] for i, x in got.items() if 60 <= i < 90)


def test_groups_stay_within_a_shard(spark):
    parts = suffix_dedup.stretches(frame(spark, texts(300)).select("doc_id", "text"), 400, 32)
    size = lambda df, g: df.groupBy(g).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("keys")).where("keys > 1").agg(F.max("b")).first()[0]
    shard = 10_000
    assert size(parts.groupBy("h", "key").agg(F.min("bytes").alias("bytes")), "h") > 3 * shard
    dealt = suffix_dedup.deal(parts, 400, 32, shard)
    assert len(dealt) > 1
    assert all((size(groups.selectExpr("g", "length(part) as bytes"), "g") or 0) <= shard for groups, _ in dealt)
