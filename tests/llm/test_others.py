import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioflow.llm import decontaminate, fingerprints, sharding

from .helpers import frame, passage


def test_masks_find_every_tolerated_overlap():
    assert decontaminate.covers(decontaminate.MASKS) == []


def test_overlaps_tolerate_substitutions(spark):
    items = [(1, passage(1, 20)), (2, passage(2, 13)), (3, passage(3, 4)), (4, None), (5, ""), (6, "!!! ---"), (7, passage(7, 50))]
    w = passage(1, 20).split()
    edited = " ".join("zz" if i in (3, 9, 15) else x for i, x in enumerate(w))
    broken = " ".join("zz" if i % 3 == 0 else x for i, x in enumerate(w))
    docs = [
        (1, passage(11, 30) + " " + passage(1, 20).upper() + ", " + passage(12, 9)), (2, edited), (3, broken), (4, passage(3, 4)), (5, " ".join(passage(3, 4).split()[:3])), (6, None), (7, ""),
        (8, passage(13, 500)), (9, passage(14, 5) + " " + " ".join(passage(7, 50).split()[10:30])), (10, passage(2, 13) + ". " + passage(2, 13)), (None, passage(1, 20)),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1))
    got = {(r.doc_id, r.item_id): (r.start, r.matched) for r in decontaminate.overlaps(frame(spark, docs), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (4, 3), (9, 7), (10, 2)}
    assert got[1, 1] == (30, 20) and got[2, 1] == (0, 17) and got[10, 2] == (0, 13)
    assert decontaminate.overlaps(frame(spark, []), bench).collect() == [] and decontaminate.overlaps(frame(spark, docs), bench.limit(0)).collect() == []


def test_fingerprints_of_edits_and_order(spark):
    rows = [(9, passage(1, 400)), (4, passage(2, 300)), (2, None), (1, "é" * 7), (30, passage(1, 400)), (31, "a" * 500)]
    got = {r.doc_id: r for r in fingerprints.fingerprints(frame(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()
    assert got[9].fingerprint == got[30].fingerprint and got[30].near_next == 1.0
    assert len({r.fingerprint for r in got.values()}) == 5 and 0.1 < got[9].near_edited < 0.7 and got[9].near_next < 0.1
    assert fingerprints.fingerprints(frame(spark, [])).collect() == []


def test_equal_substrings_share_phrases():
    import pyarrow as pa

    inner = passage(5, 400)
    _, (a, b) = fingerprints.sketches(pa.array([(passage(6, 3) + inner).encode(), (passage(7, 11) + "\n" + inner).encode()], pa.large_binary()))
    assert fingerprints.likeness(a, b) > 0.8


@pytest.mark.parametrize("n", [0, 1, 39, 40, 41, 997])
def test_shards_are_level_and_slots_gapless(spark, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("tie"), F.lit(-1).alias("shard"))
    got = sharding.bounded_ring(docs, tie="tie").collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == n and max(sizes.values(), default=0) - min([sizes.get(s, 0) for s in range(40)]) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))


def test_shards_of_repeated_and_null_keys(spark):
    docs = spark.createDataFrame([(1, str(i)) for i in range(300)] + [(None, str(i)) for i in range(200)], "doc_id long, tie string")
    got = sharding.bounded_ring(docs, shards=7, tie="tie").collect()
    assert sorted(Counter(r.shard for r in got).values()) == [71] * 4 + [72] * 3


def test_a_place_depends_on_the_key_alone_without_overflow(spark):
    a = {r.doc_id: r.shard for r in sharding.bounded_ring(spark.range(4000).withColumnRenamed("id", "doc_id")).collect()}
    b = {r.doc_id: r.shard for r in sharding.bounded_ring(spark.range(4200).withColumnRenamed("id", "doc_id")).collect()}
    assert sum(a[i] == b[i] for i in a) > 0.8 * len(a)


