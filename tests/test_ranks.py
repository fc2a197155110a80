"""Ranks of hot groups, and free names by them."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import ranks
from folioflow.streaming import jobs


def test_ranks_of_groups_ties_and_nulls(spark):
    rows = [("a", 3), ("a", 1), ("a", 1), (None, 2), (None, None), ("b", 9)]
    got = ranks.ranked(spark.createDataFrame(rows, "g string, o int"), ["g"], ["o"]).collect()
    assert sorted((r.g or "", r.o or 0, r.rank) for r in got) == [("", 0, 0), ("", 2, 1), ("a", 1, 0), ("a", 1, 1), ("a", 3, 2), ("b", 9, 0)]
    assert sorted(r.rank for r in ranks.ranked(spark.range(100), [], ["id"]).collect()) == list(range(100))
    assert ranks.ranked(spark.range(0), [], ["id"]).collect() == []


def test_a_group_of_all_rows_is_spread_over_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(40_000).select(F.lit("hot").alias("g"), F.xxhash64("id").alias("o"))
        parts = ranks.placed(rows, F.col("g"), F.col("o")).groupBy(F.shiftrightunsigned("at", 33)).count().collect()
        assert len(parts) == 8 and max(r["count"] for r in parts) < 2 * 40_000 / 8
        got = ranks.ranked(rows, ["g"], ["o"]).orderBy("o").collect()
        assert [r.rank for r in got] == list(range(40_000))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def in_turn(uploads, taken):
    used, out = set(taken), {}
    for seq, name in sorted(uploads):
        stem, dot, end = name.rpartition(".") if name.rfind(".") > 0 else (name, "", "")
        free, n = name, 0
        while free in used:
            n += 1
            free = f"{stem}_{n}{dot}{end}"
        used.add(free)
        out[seq] = free
    return out


@pytest.mark.parametrize("seed", range(4))
def test_free_names_equal_those_given_in_turn(spark, seed):
    r = random.Random(seed)
    names = ["q.pdf", "r", "ä b.pdf", ".x", "s_5.pdf"] + (["q_1.pdf", "q_2.pdf"] if seed % 2 else [])
    uploads = [(i, r.choice(names)) for i in r.sample(range(1000), 150)]
    taken = [f"{s}{r.choice(['', *(f'_{k}' for k in range(1, 12))])}{e}" for s, e in r.choices([("q", ".pdf"), ("r", ""), ("ä b", ".pdf"), ("s_5", ".pdf")], k=25)]
    got = jobs.safe_names(spark.createDataFrame(uploads, "seq long, name string").repartition(5), spark.createDataFrame([(t,) for t in taken], "name string")).collect()
    assert {x.seq: x.free_name for x in got} == in_turn(uploads, taken)
