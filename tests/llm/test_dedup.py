import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioflow.llm import graph, jaccard_join, rlz_dedup, suffix_dedup
from folioflow.llm.graph import components

from .helpers import LOWER, frame, passage, words

SHARED = passage(1, 80)
DOCS = [
    (1, passage(2, 30) + " " + SHARED + " " + passage(3, 20)), (2, SHARED), (5, passage(4, 60) + "\n" + SHARED.replace(" ", "  ", 3)), (7, None), (8, ""), (9, passage(5, 49)), (10, passage(5, 49)),
    (11, passage(6, 50)), (12, passage(6, 50)), (13, "a " * 120), (14, "é " * 60 + passage(6, 50)), (20, SHARED), (21, SHARED),
]


def brute_windows(docs, width):
    first, out = {}, {}
    for i, t in sorted(docs):
        w = words(t)
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


def test_word_windows_match_brute_force(spark):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rlz_dedup.remove_repeats(frame(spark, [*DOCS, (None, SHARED)])).collect()}
    assert got == brute_windows(DOCS, 50)
    assert rlz_dedup.remove_repeats(frame(spark, [])).collect() == []


def test_factors_cut_where_the_source_or_its_place_changes():
    at, source, place = np.array([3, 4, 5, 9, 10, 11]), np.array([1, 1, 2, 2, 2, 2]), np.array([7, 8, 0, 4, 5, 90])
    assert rlz_dedup.greedy_factors(at, source, place, 50) == [(3, 51, 1, 7), (5, 50, 2, 0), (9, 51, 2, 4), (11, 50, 2, 90)]


def test_removed_words_are_those_of_the_factors(spark):
    docs = [(1, passage(1, 90)), (2, passage(2, 70)), (3, passage(3, 5) + " " + passage(2, 70) + " " + passage(1, 90)), (4, "b " * 130), (5, "b " * 80 + "c " + "b " * 60)]
    got = {r.doc_id: [tuple(f) for f in r.factors] for r in rlz_dedup.remove_repeats(frame(spark, docs)).collect()}
    assert got[1] == got[2] == got[4] == [] and got[3] == [(5, 70, 2, 0), (75, 90, 1, 0)]
    assert {(f[1], f[2]) for f in got[5]} == {(50, 4)} and {f[0] for f in got[5]} == {*range(31), *range(81, 92)}


def test_repeated_ids_keep_their_rows(spark):
    rows = [(1, passage(1, 60)), (3, passage(1, 60)), (3, passage(4, 60)), (3, None)]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in rlz_dedup.remove_repeats(frame(spark, rows)).collect())
    assert got == [(1, 60, 0), (3, 0, 0), (3, 60, 0), (3, 60, 60)]


def test_suffix_array_is_sorted():
    r = random.Random(5)
    for n in [*range(0, 30), 400]:
        for k in (1, 2, 4, 200):
            x = [r.randrange(k) for _ in range(n)]
            sa = suffix_dedup.suffix_array(np.array(x, np.int64))
            assert sa.tolist() == sorted(range(n), key=lambda i: x[i:])
            before, shared = suffix_dedup.permuted_common_prefixes(np.array(x, np.uint8), sa, n - np.arange(n))
            for a, b in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
                assert before[b] == a and shared[b] == next((m for m in range(n - max(a, b)) if x[a + m] != x[b + m]), n - max(a, b))


def test_common_prefixes_of_every_length_are_counted_to_the_byte():
    r = np.random.default_rng(5)
    buf = r.integers(0, 2, 300, dtype=np.uint8) * np.uint8(255)  # bytes that differ in their lowest or highest bits alone count too
    buf[100:200] = buf[:100]
    buf[150] ^= 128
    room = len(buf) - np.arange(len(buf))
    before, shared = suffix_dedup.permuted_common_prefixes(buf, suffix_dedup.suffix_array(buf.astype(np.int16)), room)
    raw = buf.tobytes()
    for i in np.flatnonzero(before >= 0):
        n = next((k for k in range(len(raw)) if raw[i + k : i + k + 1] != raw[before[i] + k : before[i] + k + 1] or i + k >= len(raw)), len(raw))
        assert shared[i] == n


def test_doubling_tells_ties_apart():
    r = np.random.default_rng(6)
    for x in (r.integers(0, 3, 400), np.tile(r.integers(0, 900, 40), 9), np.zeros(50, np.int64)):
        assert suffix_dedup._doubled(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


def test_each_end_of_a_part_is_a_symbol_of_its_own():
    r = random.Random(6)
    for _ in range(60):
        x = [v for _ in range(r.randrange(1, 12)) for v in [*(r.randrange(1, 3) for _ in range(r.randrange(1, 9))), 0]]
        y = [(v, (i if i < len(x) - 1 else -1) if v == 0 else 0) for i, v in enumerate(x)]
        assert suffix_dedup.suffix_array(np.array(x), ends=True).tolist() == sorted(range(len(x)), key=lambda i: y[i:])


def brute_bytes(docs, length):
    raw = {i: (t or "").encode() for i, t in docs}
    seen = Counter(t[k : k + length] for t in raw.values() for k in range(len(t) - length + 1))
    out = {}
    for i, t in raw.items():
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out[i] = (len(t), int(gone.sum()), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=False) if not g)).hexdigest())
    return out


def test_byte_strings_match_brute_force(spark):
    docs = [*DOCS, (30, "x" * 399), (31, "y" * 401), (32, passage(9, 20) + "y" * 420), (33, "ab" * 300)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame(spark, docs)).collect()}
    assert got == brute_bytes(docs, 400)
    assert suffix_dedup.remove_repeats(frame(spark, [])).collect() == []


def test_repeated_passages_go_by_bytes_not_words(spark):
    """A passage of over 50 words stays at 399 bytes and goes at 400, in both of its documents; n_bytes tells neither."""
    shared = passage(60, 90)[:399].rstrip().ljust(399, "z")
    assert len(words(shared)) > 50
    docs = [(1, "(" + shared + ")"), (2, "[" + shared + "]"), (3, "{" + shared[::-1] + "!}"), (4, "<" + shared[::-1] + "!>")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(frame(spark, docs)).collect()}
    assert got == {1: (401, 0, 0), 2: (401, 0, 0), 3: (402, 400, 1), 4: (402, 400, 1)}


def brute_components(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = [x.decode() for x in words((t or "").translate(LOWER))]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    low = {i: root(i) for i in sets}
    return {i: (len(s), low[i]) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_similar_components_match_brute_force(spark, k, percent, monkeypatch):
    base = passage(7, 200).split()
    near = [(100 + i, " ".join(w if j != 7 * i else "edit" for j, w in enumerate(base))) for i in range(12)]
    docs = [*DOCS, *near, (200, "one"), (201, "ONE"), (202, "one two"), (203, " ")]
    monkeypatch.setattr(jaccard_join, "CELL_SETS", 5)  # so that a part is dealt out to cells
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(frame(spark, docs), k, percent).collect()}
    assert got == brute_components(docs, k, percent)


def test_a_large_part_is_dealt_out_and_loses_no_link(spark, monkeypatch):
    """Clusters of near copies that only bridges join, over many cells and two rounds of representatives."""
    r, base = random.Random(8), passage(70, 120).split()
    docs = []
    for cluster in range(6):
        core = list(base)
        for j in range(11 * cluster):  # neighbouring clusters differ by 11 of 120 words: too many for a link but through a bridge
            core[j] = f"c{cluster if j >= 11 * (cluster - 1) else 9}x{j}"
        for i in range(40):
            w = list(core)
            w[100 + r.randrange(20)] = f"own{i % 7}"
            docs.append((1000 * cluster + i, " ".join(w)))
    docs += [(9000 + i, " ".join(base[: 60 + i])) for i in range(0, 60, 2)]  # a chain of growing texts
    monkeypatch.setattr(jaccard_join, "CELL_SETS", 6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(frame(spark, docs), 2, 80).collect()}
    assert got == brute_components(docs, 2, 80)


def test_sets_of_repeated_ids_are_one_row(spark):
    got = jaccard_join.similar_components(frame(spark, [(1, "a b c d"), (1, "a b c d"), (2, "A B C D"), (3, None), (3, "x y z"), (None, "a b c d")]), 3, 90).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 1), (2, 2, 1), (3, 0, 3)]
    assert jaccard_join.similar_components(frame(spark, []), 3, 90).collect() == []


def test_shared_rows_across_batches():
    import pyarrow as pa

    rows = [(1, 1), (2, 1), (2, 1), (3, 1), (3, 2), (4, 5), (5, 1), (5, 1), (5, 3), (6, 2), (6, 2)]
    want = [(3, 1), (3, 2), (5, 1), (5, 1), (5, 3)]
    for size in range(1, 12):
        batches = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in c]), pa.array([x[1] for x in c]), pa.array([0] * len(c))], ["h", "doc_id", "need"]) for c in (rows[i : i + size] for i in range(0, len(rows), size))]
        got = {x for b in jaccard_join._shared(batches) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
        assert got == set(want)


def test_count_tree_never_loses_a_link():
    r = random.Random(3)
    sets = [np.array(r.sample(range(4000), 60), np.int64) * 0x9E3779B97F4A7C1 for _ in range(150)]
    sets += [np.concatenate((s[:57], s[:3] + 1)) for s in sets[:50]]
    points, sizes = jaccard_join.count_vectors(sets), np.array([len(s) for s in sets])
    tree = jaccard_join.CountTree(points, sizes)
    assert len(tree.levels) == 3
    for i, s in enumerate(sets):
        near = set(tree.near(points[i], len(s), 90).tolist())
        want = {j for j, o in enumerate(sets) if 100 * len(np.intersect1d(s, o)) >= 90 * len(np.union1d(s, o))}
        assert want <= near


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200)]
    got = defaultdict(set)
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        got[r.component].add(r.node)
    assert got == {0: set(range(41)), 100: {100, 101, 102}}


def test_links_that_many_tasks_repeat_are_written_once(spark, monkeypatch):
    """Each of 16 tasks links the same nodes; what components writes first has about one row for each node, not for each node and task."""
    written, write = [], graph.materialise

    def counted(df):
        written.append((out := write(df)).count())
        return out

    monkeypatch.setattr(graph, "materialise", counted)
    edges = spark.range(16 * 49).selectExpr("id % 49 + 1 as a", "0L as b", "id div 49 as task").repartitionByRange(16, "task")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == dict.fromkeys(range(50), 0) and written[0] <= 2 * 49
