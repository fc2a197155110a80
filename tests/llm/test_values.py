"""Columns of the queries whose values plain Python can give, over a whole table."""

import zlib
from collections import Counter

from folioflow.llm import decontaminate, fingerprints, quality, sharding

from .helpers import frame, passage
from .test_contracts import DATA


def texts(spark):
    return {r.doc_id: (r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_shards_sizes_checksums_and_slots(spark):
    want, got = texts(spark), sharding.op10_sharding(spark, DATA).collect()
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.grown_shard) for r in got} == {i: (len(t.encode()) + 16, zlib.crc32(t.encode()), "rows", None) for i, t in want.items()}
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert {(r.shard, r.slot) for r in got} == {(s, k) for s, n in sizes.items() for k in range(n)}


def test_quality_marks_the_held_out(spark):
    assert {r.doc_id: r.held_out for r in quality.op7_quality(spark, DATA).collect()} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in texts(spark)}


def test_fingerprint_likeness_equals_that_of_the_texts_alone(spark):
    """near_edited and near_next from each text's own sketch, made one text at a time."""
    import pyarrow as pa

    sketch = lambda t: [x[0] for x in fingerprints.sketches(pa.array([t.encode()], pa.large_binary()))]
    want = sorted(texts(spark).items(), reverse=True)
    got = {r.doc_id: r for r in fingerprints.op6_fingerprints(spark, DATA).collect()}
    for k, (i, t) in enumerate(want):
        after = want[(k + 1) % len(want)][1]
        (a, x), (b, y), (_, z) = sketch(t), sketch(fingerprints.edited(t, after)), sketch(after)
        r = got[i]
        assert (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == (a, b, fingerprints.likeness(x, y), fingerprints.likeness(x, z))


def test_fingerprints_of_one_row_and_of_repeated_ids(spark):
    one = fingerprints.fingerprints(frame(spark, [(1, passage(1, 50)), (None, "x")])).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(1, 1.0)]
    assert len(fingerprints.fingerprints(frame(spark, [(1, "a b"), (1, "a b"), (1, None), (2, "c")])).collect()) == 4


def test_overlaps_of_repeated_ids_count_once(spark):
    bench = spark.createDataFrame([(1, passage(1, 20)), (1, passage(1, 20))], "item_id long, text string")
    got = decontaminate.overlaps(frame(spark, [(4, passage(1, 20)), (4, passage(1, 20)), (5, passage(2, 20))]), bench).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(4, 1)]
